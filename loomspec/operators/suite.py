"""Suites of rules: made from specifications and profiles, run by stage, scored, gated, and enforced on rows."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspec.operators.rules import Context, evaluate, row_test, stage, verdicts
from loomspec.schema import MOMENTS, NUMBERS, TEXT_TYPES, may_be_null, spark_type
from loomspec.spec import Rule, SpecError, TableDefinition

#: Prefixes of pairs of columns that begin and end something.
STARTS, ENDS = ("start_", "begin_", "effective_", "from_"), ("end_", "stop_", "expiry_", "to_", "termination_")


@dataclass(frozen=True)
class Thresholds:
    """Least shares of rules that must hold, and the most blocking failures."""

    success_rate: float | None = None
    critical_rate: float | None = None
    warning_rate: float | None = None
    info_rate: float | None = None
    blocking_failures: int | None = None


@dataclass(frozen=True)
class Score:
    total: int
    passed: int
    success_rate: float
    rates: dict[str, float] = field(default_factory=dict)
    blocking_failures: int = 0


def baseline_rules(spec: TableDefinition, typed_raw: bool = False) -> list[Rule]:
    """What a specification itself promises. typed_raw leaves out checks of the raw text's form."""
    names = [c.output_name for c in spec.ordered() if not c.internal]
    out = [Rule("table_column_count_to_equal", kwargs={"value": len(names)}, severity="critical", stage="ingested"), Rule("table_columns_to_match_set", kwargs={"column_set": tuple(names), "exact_match": False}, severity="critical", stage="ingested")]
    for c in spec.ordered():
        if c.internal:
            continue
        kind = c.type.upper()
        if isinstance(c.nullable, dict):
            for value, free in sorted(c.nullable.items()):
                if not free and spec.context_column:
                    out.append(Rule("values_to_not_be_null", c.name, row_condition=f"{spec.context_column} = '{value}'", severity="critical", name=f"not_null_{c.name}_{value}"))
        elif not may_be_null(c):
            out.append(Rule("values_to_not_be_null", c.name, severity="critical"))
        if c.length and kind in TEXT_TYPES and not typed_raw:
            out.append(Rule("value_lengths_to_be_between", c.name, {"min_value": 0, "max_value": c.length}))
        if kind == "EMBEDDING":
            out.append(Rule("embedding_dimension_multiple_of_16_advisory", c.name, severity="info"))
            if c.dimension:
                out.append(Rule("value_lengths_to_equal", c.name, {"value": c.dimension}, severity="critical", stage="ingested"))
        if not typed_raw and kind in MOMENTS + NUMBERS:
            out.append(Rule("values_to_cast_to_type", c.name, {"type": kind, "format": c.format, "precision": c.precision, "scale": c.scale}, severity="error"))
        if c.domain_type:
            out.append(Rule("values_to_match_domain_type", c.name, {"domain_type": c.domain_type, "mostly": 0.95}))
    if spec.primary_key:
        out.append(Rule("compound_columns_to_be_unique", kwargs={"column_list": spec.primary_key}, severity="critical", stage="ingested", name="primary_key_unique"))
    out += [Rule("compound_columns_to_be_unique", kwargs={"column_list": u}, severity="error", stage="ingested", name="unique_" + "_".join(u)) for u in spec.unique]
    return out + date_ranges(spec) + foreign_keys(spec)


def date_ranges(spec: TableDefinition) -> list[Rule]:
    names = {c.name.lower(): c.name for c in spec.columns if c.type.upper() in MOMENTS}
    out = []
    for low, name in sorted(names.items()):
        if start := next((s for s in STARTS if low.startswith(s)), None):
            for e in ENDS:
                if (other := names.get(e + low[len(start) :])) is not None:
                    out.append(Rule("pair_values_a_to_be_greater_than_b", kwargs={"column_A": other, "column_B": name, "or_equal": True}, name=f"{other}_after_{name}", stage="ingested"))
    return out


def foreign_keys(spec: TableDefinition) -> list[Rule]:
    return [Rule("foreign_key_to_exist", c, {"table": t, "parent_column": p}, severity="error", stage="ingested") for c, t, p in spec.foreign_keys]


def contract(spec: TableDefinition) -> list[Rule]:
    """Types and NULLs as declared."""
    own = [c for c in spec.ordered() if not c.internal]
    return [Rule("values_to_be_of_type", c.output_name, {"type_": spark_type(c).simpleString()}, severity="critical") for c in own] + [Rule("values_to_not_be_null", c.output_name, severity="critical") for c in own if not may_be_null(c)]


def rules_from_profile(profile: list[dict], tightness: str = "medium") -> list[Rule]:
    """Rules that the profiled data meet. Bounds are the data's own (tight), a tenth wider (medium), or the middle nine tenths (loose)."""
    out = []
    for p in profile:
        c, full = p["column"], p["completeness"]
        if full >= 1:
            out.append(Rule("values_to_not_be_null", c))
        elif full >= 0.95:
            out.append(Rule("values_to_not_be_null", c, {"mostly": round(full, 4)}))
        if p.get("uniqueness", 0) >= 0.99:
            out.append(Rule("column_proportion_of_unique_values_to_be_between", c, {"min_value": 0.99}))
        if p.get("values"):
            out.append(Rule("values_to_be_in_set", c, {"value_set": tuple(p["values"])}))
        low, high = p.get("min"), p.get("max")
        if p.get("numeric") and low is not None:
            width = abs(high - low) * 0.1
            bounds = {"tight": (low, high), "medium": (low - width, high + width), "loose": (p.get("p5", low - 2 * width), p.get("p95", high + 2 * width))}[tightness]
            out.append(Rule("values_to_be_between", c, {"min_value": bounds[0], "max_value": bounds[1], "mostly": 0.9 if tightness == "loose" else 1.0}))
        if p.get("min_length") is not None:
            out.append(Rule("value_lengths_to_be_between", c, {"min_value": p["min_length"], "max_value": p["max_length"]}))
        if p.get("pattern"):
            out.append(Rule("values_to_match_regex", c, {"regex": pattern_regex(p["pattern"]), "mostly": 0.6 if "+" in p["pattern"] else 0.8}))
    return out


def pattern_regex(form: str) -> str:
    """The regular expression of a structural pattern: A, a and N are classes, a plus after one of them is a run."""
    out, i = [], 0
    classes = {"A": "[A-Z]", "a": "[a-z]", "N": "[0-9]"}
    while i < len(form):
        c = form[i]
        if c in classes:
            n = 1
            while i + n < len(form) and form[i + n] == c:
                n += 1
            run = i + n < len(form) and form[i + n] == "+"
            out.append(classes[c] + ("+" if run else f"{{{n}}}" if n > 1 else ""))
            i += n + run
        else:
            out.append("\\" + c if c in r"\.^$*+?{}[]|()-/" else c)
            i += 1
    return "^" + "".join(out) + "$"


def staged(rules: list[Rule]) -> dict[str, list[Rule]]:
    out: dict[str, list[Rule]] = {"raw": [], "ingested": [], "redundant": [], "unknown": []}
    for r in rules:
        out[stage(r)].append(r)
    return out


def run_staged(raw: DataFrame | None, ingested: DataFrame, rules: list[Rule], context: Context | None = None) -> list[tuple]:
    """Raw rules on the raw frame, the others on the typed one. Redundant ones are not run; unknown ones fail."""
    by = staged(rules)
    out = evaluate(raw, by["raw"], context) if raw is not None and by["raw"] else []
    return out + evaluate(ingested, by["ingested"] + by["unknown"] + ([] if raw is not None else by["raw"]), context)


def with_defaults(rules: list[Rule], tags: tuple[str, ...] = ()) -> list[Rule]:
    """The check of the row count comes first, unless there is one or the defaults are off."""
    name = "row_count_change_within_percent"
    if "skip_defaults" in tags or any(r.type == name for r in rules):
        return rules
    return [Rule(name, kwargs={"percent": 20.0}), *rules]


def since(df: DataFrame, cutoff: float | None, column: str = "meta_load_dt") -> DataFrame:
    """Only rows that were loaded after the cutoff, in epoch seconds."""
    return df if cutoff is None else df.where(F.col(column) > F.timestamp_seconds(F.lit(cutoff)))


def quality_score(found: list[tuple]) -> Score:
    """Shares of verdicts that hold: all, and by severity, where error counts with critical."""
    groups: dict[str, list[bool]] = {}
    for v in found:
        groups.setdefault("critical" if v[3] in ("critical", "error") else v[3], []).append(v[5])
    passed = sum(v[5] for v in found)
    rate = lambda xs: sum(xs) / len(xs) if xs else 1.0
    return Score(len(found), passed, rate([v[5] for v in found]), {k: rate(groups.get(k, [])) for k in ("critical", "warning", "info")}, sum(v[4] and not v[5] for v in found))


def gate(found: list[tuple], thresholds: Thresholds = Thresholds()) -> list[str]:
    """Why a run must stop; nothing if it may go on."""
    score, out = quality_score(found), []
    out += [f"blocking rule {v[0]} failed" for v in found if v[4] and not v[5] and v[3] in ("critical", "error")]
    for name, value in (("success_rate", score.success_rate), ("critical_rate", score.rates["critical"]), ("warning_rate", score.rates["warning"]), ("info_rate", score.rates["info"])):
        least = getattr(thresholds, name)
        if least is not None and value < least:
            out.append(f"{name} {value:.4f} is under {least}")
    if thresholds.blocking_failures is not None and score.blocking_failures > thresholds.blocking_failures:
        out.append(f"{score.blocking_failures} blocking failures")
    return out


def score_frame(found: DataFrame) -> DataFrame:
    """The score from a frame of verdicts."""
    rate = lambda cond: F.coalesce(F.count_if(cond & F.col("success")) / F.nullif(F.count_if(cond), F.lit(0)), F.lit(1.0))
    severity = F.col("severity")
    return found.agg(F.count("*").alias("total"), F.count_if("success").alias("passed"), F.round(rate(F.lit(True)), 6).alias("success_rate"), F.round(rate(severity.isin("critical", "error")), 6).alias("critical_rate"), F.round(rate(severity == "warning"), 6).alias("warning_rate"), F.round(rate(severity == "info"), 6).alias("info_rate"), F.count_if(F.col("blocking") & ~F.col("success")).alias("blocking_failures"))


def results(df: DataFrame, rules: list[Rule], table: str, pipeline: str, context: Context | None = None) -> DataFrame:
    """Verdicts as rows for the history table."""
    run = uuid.uuid4().hex
    out = verdicts(df, rules, context)
    return out.select(F.lit(run).alias("run_id"), F.current_timestamp().alias("run_timestamp"), F.current_date().alias("run_date"), F.lit(pipeline).alias("pipeline_name"), F.lit(table).alias("table_name"), "*")


def action(rule: Rule) -> str:
    """What a violation does to a row: fail the run, drop the row, or only warn."""
    return "fail" if rule.blocking else "drop" if rule.severity in ("critical", "error", "warning") else "warn"


def enforce(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that are set aside with the names of the rules they break). Failing rules raise on the first row
    they meet when the frame is read; warnings stay."""
    broken, stop = [], F.lit(False)
    for r in rules:
        test = row_test(df, r)
        if test is None:
            raise SpecError(f"{r.type} is no rule on rows")
        if action(r) == "drop":
            broken.append(F.when(test[1], F.lit(r.id)))
        elif action(r) == "fail":
            stop = stop | test[1]
    names = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    marked = df.withColumn("__broken", F.when(stop, F.raise_error(F.lit("a blocking rule is broken")).cast("array<string>")).otherwise(names))
    return marked.where(F.size("__broken") == 0).drop("__broken"), marked.where(F.size("__broken") > 0).withColumnRenamed("__broken", "broken_rules")


def to_json(rules: list[Rule]) -> str:
    from loomspec.spec import to_dict

    return json.dumps([to_dict(r) for r in rules], indent=2, default=str)
