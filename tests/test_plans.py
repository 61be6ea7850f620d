import pytest

from loomspec import schema
from loomspec.operators import relational as R
from loomspec.operators.sample import from_regex, generate, key_groups
from loomspec.plans import lineage
from loomspec.plans.compiler import compile_table
from loomspec.plans.resolve import resolve
from loomspec.spec import Candidate, Column, Derivation, Metadata, Relationship, Source, SpecError, TableDefinition, from_dict, load, save, to_dict


def c(name, *candidates, **more):
    return Column(name, derivation=Derivation(tuple(candidates)), **more)


def test_or_join_plans_no_nested_loop(spark):
    a = spark.range(10).selectExpr("id AS x", "id + 1 AS y")
    b = spark.range(10).selectExpr("id AS p", "id AS q")
    plan = R.alternative_path_join(a, b, "b", ((("x", "p"),), (("y", "q"),)))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_alternative_paths_choose_before_they_join(spark, rows):
    """900 x 900 rows of one key: no operator makes more rows than there are on the left."""
    left = spark.range(900).selectExpr("id AS x", "1 AS y")
    right = spark.range(900).selectExpr("id + 890 AS p", "1 AS q", "CASE WHEN id > 1 THEN 5 - id END AS v").repartition(4)
    out = R.alternative_path_join(left, right, "b", ((("x", "p"),), (("y", "q"),)))
    assert rows(out.where("x > 887")) == sorted([(x, 1, max(x, 890), 1, None if x < 892 else 895 - x) for x in range(888, 900)], key=repr)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.index("Aggregate") > plan.index("Join")  # aggregates feed the joins


def test_alternative_paths_take_nulls_last(spark, rows):
    left = spark.createDataFrame([(1, 7), (None, 7), (2, None), (None, None), (1, 7)], "x int, y int")
    right = spark.createDataFrame([(1, 9, None), (1, 9, 4.0), (5, 7, 2.0), (None, 7, None), (None, None, 1.0)], "p int, q int, v double")
    paths = ((("x", "p"),), (("y", "q"),))
    found = [(1, 7, 1, 9, 4.0)] * 2 + [(None, 7, 5, 7, 2.0)]
    assert rows(R.alternative_path_join(left, right, "b", paths)) == sorted([*found, (2, None, None, None, None), (None, None, None, None, None)], key=repr)
    assert rows(R.alternative_path_join(left, right, "b", paths, "inner")) == sorted(found, key=repr)


def test_filters_and_columns_reach_the_scan(spark, small):
    target = TableDefinition("t", (c("k", Candidate("orders", "o_orderkey")),), metadata=Metadata("orders", base_filter="o_orderstatus = 'F'"))
    plan = compile_table(spark, target, {"orders": spark.read.parquet(f"{small}/orders.parquet")})._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan


def test_literals_in_filters_are_left_alone(spark, rows):
    base = spark.createDataFrame([(1,), (2,)], "id int")
    other = spark.createDataFrame([(1, "id"), (2, "x")], "id int, kind string")
    assert rows(R.direct_join(base, other, "o", (("id", "id"),), where="kind = 'id'")) == [(1, 1, "id"), (2, None, None)]


def test_strategies_are_inferred():
    base = TableDefinition("base", (Column("member_id"),), ("member_id",))
    other = TableDefinition("other", (Column("member_id"), Column("code")))
    many = Relationship("other", (("member_id", "member_id"),), cardinality="1:N")
    pivot = TableDefinition("t", (c("code_1", Candidate("other", "code")), c("code_2", Candidate("other", "code"))), relationships=(many,), metadata=Metadata("base"))
    assert resolve(pivot, {}).joins[0].strategy == "pivot"
    one = TableDefinition("t", (c("code", Candidate("other", "code")),), relationships=(many,), metadata=Metadata("base"))
    assert resolve(one, {}).joins[0].strategy == "first_record"
    synthetic = TableDefinition("t", (c("code", Candidate("other", "code")),), metadata=Metadata("base"))
    found = resolve(synthetic, {"base": base, "other": other}).joins[0]
    assert found.keys == (("member_id", "member_id"),) and found.strategy == "first_record"
    with pytest.raises(SpecError):
        resolve(synthetic, {})


def test_survivorship(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("", "b", 1, 2), (None, None, None, 3)], "x string, y string, p int, q int")
    got = df.select(R.survivor([F.col("x"), F.col("y")], text=True, default=F.lit("d")), R.survivor([F.col("p"), F.col("q")], "max_across_sources"), R.survivor([F.col("x"), F.col("y")], "longest_value"), R.survivor([F.col("x"), F.col("y")], "most_recent", stamps=[F.col("p"), F.col("q")]))
    assert rows(got) == sorted([("b", 2, "b", "b"), ("d", 3, None, None)], key=repr)


def test_lineage():
    specs = {"a": TableDefinition("a", (Column("k"),)), "b": TableDefinition("b", (c("k", Candidate("a", "k")),), metadata=Metadata("a")), "d": TableDefinition("d", (c("k", Candidate("b", "missing")),), metadata=Metadata("b"))}
    assert lineage.build_order(specs) == ["a", "b", "d"]
    assert lineage.dangling(specs) == [("d", "column", "b.missing")]
    assert lineage.roles(specs) == {"a": "SOURCE", "b": "INTERMEDIATE", "d": "GOLD"}
    new = specs | {"b": TableDefinition("b", (c("k", Candidate("a", "k")), Column("n")), metadata=Metadata("a"))}
    assert lineage.changed(specs, new) == ["b", "d"]
    with pytest.raises(SpecError, match="cycle"):
        lineage.build_order({"a": TableDefinition("a", (c("k", Candidate("b", "k")),)), "b": TableDefinition("b", (c("k", Candidate("a", "k")),))})


def test_compatibility():
    old = TableDefinition("t", (Column("a", "INTEGER"), Column("b"), Column("gone")))
    new = TableDefinition("t", (Column("a", "DECIMAL"), Column("b", nullable=False), Column("added", nullable=False), Column("kept", aliases=("gone",))))
    assert set(lineage.compatibility(old, new)) == {("type", "a", False), ("nullability", "b", True), ("added", "added", True), ("renamed", "gone", False)}
    assert lineage.diff(old, new)["columns_changed"] == ["a", "b"]


def test_specs_round_trip(tmp_path):
    spec = TableDefinition("t", (c("k", Candidate("a", "k", priority=1)), Column("v", "DECIMAL", precision=8, scale=3)), ("k",), relationships=(Relationship("a", (("k", "k"),)),), metadata=Metadata("a", branch_filters={"a": "x > 1"}), source=Source("parquet", "/x"))
    assert from_dict(to_dict(spec)) == spec
    for name in ("t.json", "t.yaml", "folder"):
        save(spec, tmp_path / name)
        back = load(tmp_path / name)
        assert {x.name for x in back.columns} == {"k", "v"} and back.metadata == spec.metadata


@pytest.mark.parametrize("bad", [lambda: Column("1x"), lambda: Column("a", "BLOB"), lambda: Candidate("t"), lambda: TableDefinition("t", (Column("a"), Column("A"))), lambda: TableDefinition("t", (Column("a"),), ("b",)), lambda: Source("jdbc", options={}), lambda: from_dict({"name": "t", "nope": 1})])
def test_bad_specs(bad):
    with pytest.raises(SpecError):
        bad()


def test_schema_emitters(spark):
    spec = TableDefinition("t", (Column("id", "INTEGER", nullable=False, position=1), Column("price", "DECIMAL", precision=12, scale=3, position=2), Column("e", "EMBEDDING", position=3), Column("hidden", internal=True)))
    assert schema.struct_type(spec).simpleString() == "struct<id:int,price:decimal(12,3),e:array<float>>"
    assert "`id` INT NOT NULL" in schema.ddl(spec) and '"required": [\n    "id"\n  ]' in schema.json_schema(spec)
    back = schema.reflect_schema("t", schema.struct_type(spec))
    assert [x.type for x in back.columns] == ["INTEGER", "DECIMAL", "EMBEDDING"]
    assert schema.reflect_sql_type("NVARCHAR(40)") == {"type": "VARCHAR", "length": 40} and schema.reflect_sql_type("numeric(10, 2)") == {"type": "DECIMAL", "precision": 10, "scale": 2}
    found = schema.reflect_information_schema([{"table_name": "o", "column_name": "b", "data_type": "int", "ordinal_position": 2}, {"table_name": "o", "column_name": "a", "data_type": "date", "ordinal_position": 1}], [{"table_name": "o", "column_name": "a", "ordinal_position": 1}], [])
    assert found[0].primary_key == ("a",) and [x.name for x in found[0].columns] == ["a", "b"]


def test_sample_data(spark):
    specs = {"child": TableDefinition("child", (Column("id", "INTEGER", nullable=False), Column("p", "INTEGER", nullable=False), Column("zip"), Column("e", "EMBEDDING", dimension=8, nullable=False)), ("id",), foreign_keys=(("p", "parent", "p"),)), "parent": TableDefinition("parent", (Column("p", "INTEGER", nullable=False),), ("p",))}
    a, b = generate(spark, specs, 200), generate(spark, specs, 200)
    assert a["child"].collect() == b["child"].collect()
    assert a["child"].join(a["parent"], "p", "left_anti").count() == 0
    norms = [sum(x * x for x in r["e"]) for r in a["child"].collect()]
    assert all(abs(n - 1) < 1e-3 for n in norms)
    assert key_groups(specs) == [{("child", "p"), ("parent", "p")}]
    made = spark.range(5).select(from_regex(r"[A-C]{2}-\d{3}", 1)).collect()
    import re

    assert all(re.fullmatch(r"[A-C]{2}-\d{3}", r[0]) for r in made)


def test_cli(tmp_path, capsys):
    from loomspec.cli import main

    save(TableDefinition("t", (Column("id", "INTEGER"),)), tmp_path / "t.json")
    assert main(["ddl", str(tmp_path / "t.json")]) == 0 and "CREATE TABLE" in capsys.readouterr().out
    assert main(["validate", str(tmp_path / "t.json")]) == 0
