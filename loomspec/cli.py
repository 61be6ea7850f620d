"""Command line: python -m loomspec.cli COMMAND ... on specification files."""

from __future__ import annotations

import argparse
import json
import sys

from loomspec import schema
from loomspec.operators.suite import baseline_rules, to_json
from loomspec.plans import lineage
from loomspec.spec import TableDefinition, load


def specs_in(paths: list[str]) -> dict[str, TableDefinition]:
    found = [load(p) for p in paths]
    return {s.name: s for s in found}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomspec")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("ddl", "json-schema", "struct", "rules", "order", "manifest", "validate"):
        commands.add_parser(name).add_argument("specs", nargs="+")
    two = commands.add_parser("compat")
    two.add_argument("old")
    two.add_argument("new")
    run = commands.add_parser("run")
    run.add_argument("target")
    run.add_argument("--specs", nargs="*", default=[])
    run.add_argument("--table", action="append", default=[], metavar="NAME=PATH")
    run.add_argument("--out", required=True)
    a = parser.parse_args(args)
    if a.command == "compat":
        changes = lineage.compatibility(load(a.old), load(a.new))
        print(json.dumps([{"change": c, "column": n, "breaking": b} for c, n, b in changes], indent=2))
        return int(any(b for _, _, b in changes))
    if a.command == "run":
        from pyspark.sql import SparkSession

        from loomspec.plans.compiler import compile_table

        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        tables = {n: spark.read.parquet(p) for n, p in (x.split("=", 1) for x in a.table)}
        compile_table(spark, load(a.target), tables, specs_in(a.specs)).write.parquet(a.out)
        return 0
    specs = specs_in(a.specs)
    if a.command == "order":
        print("\n".join(lineage.build_order(specs)))
    elif a.command == "manifest":
        print(lineage.manifest(specs))
    elif a.command == "validate":
        problems = lineage.dangling(specs)
        print("\n".join(" ".join(p) for p in problems) or "no problems")
        return int(bool(problems))
    else:
        emit = {"ddl": schema.ddl, "json-schema": schema.json_schema, "struct": lambda s: schema.struct_type(s).json(), "rules": lambda s: to_json(baseline_rules(s))}[a.command]
        print("\n\n".join(emit(s) for s in specs.values()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
