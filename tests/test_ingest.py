import pytest

from loomspec.operators import ingest as I
from loomspec.spec import Column, Ingestion, TableDefinition

SPEC = TableDefinition("t", (Column("k", "VARCHAR", position=1), Column("v", "INTEGER", position=2)), ("k",), ingestion=Ingestion("incremental"))


def raw(spark, data):
    return spark.createDataFrame(data, "k string, v string, _load_ts string").withColumn("_load_ts", __import__("pyspark.sql.functions", fromlist=["x"]).col("_load_ts").cast("timestamp"))


def run(spark, spec, *batches):
    out = None
    for b in batches:
        out = I.ingest_batch(out, raw(spark, b), spec)
    return out.select("k", "v")


FIRST = [("a", "1", "2024-01-01"), ("a", "2", "2024-01-02"), ("b", "x", "2024-01-01"), (None, "5", "2024-01-01")]
SECOND = [("a", "3", "2023-01-01"), ("c", "4", "2024-01-01")]


def test_later_batch_wins_even_if_older(spark, rows):
    assert rows(run(spark, SPEC, FIRST, SECOND)) == sorted([("a", 3), ("b", None), ("c", 4), (None, 5)], key=repr)


def test_max_sequence(spark, rows):
    spec = TableDefinition(**(SPEC.__dict__ | {"ingestion": Ingestion("incremental", policy="max_sequence_wins")}))
    assert ("a", 2) in rows(run(spark, spec, FIRST, SECOND))


def test_upsert_is_idempotent(spark, rows):
    assert rows(run(spark, SPEC, FIRST, SECOND, SECOND)) == rows(run(spark, SPEC, FIRST, SECOND))


def test_append_and_snapshot(spark, rows):
    append = TableDefinition(**(SPEC.__dict__ | {"primary_key": ()}))
    assert len(rows(run(spark, append, FIRST, SECOND, SECOND))) == 8
    snapshot = TableDefinition(**(SPEC.__dict__ | {"ingestion": Ingestion("snapshot")}))
    assert len(rows(run(spark, snapshot, SECOND, FIRST))) == 4


def test_latest_does_not_depend_on_partitions(spark, rows):
    df = spark.createDataFrame([(i % 7, i % 3, i) for i in range(200)], "k int, o int, v int")
    once = rows(I.latest(df, ["k"], ("o desc",)))
    assert all(rows(I.latest(df.repartition(n), ["k"], ("o desc",))) == once for n in (1, 3, 8))
    assert len(rows(I.latest(df, ["k"], ("o asc",)))) == 7


def test_null_keys_stay_in_final_dedup(spark, rows):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 1), (1, 2)], "k int, v int")
    assert rows(I.latest(df, ["k"], ("v desc",), keep_null_keys=True)) == sorted([(None, 1), (None, 2), (1, 2)], key=repr)


def test_latest_needs_no_window(spark):
    df = spark.createDataFrame([(1, 2)], "k int, v int")
    plan = I.latest(df, ["k"], ("v desc",))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_merge_strategies(spark, rows):
    spec = TableDefinition("t", (Column("k"), Column("lo", "INTEGER", merge_strategy="keep_minimum"), Column("hi", "INTEGER", merge_strategy="keep_maximum"), Column("first", "INTEGER", merge_strategy="keep_existing"), Column("last", "INTEGER")), ("k",))
    old = spark.createDataFrame([("a", 5, 5, None, 5), ("b", 1, 1, 1, 1)], "k string, lo int, hi int, first int, last int")
    new = spark.createDataFrame([("a", 3, 3, 3, 3), ("c", 9, 9, 9, 9)], "k string, lo int, hi int, first int, last int")
    assert rows(I.merged(old, new, spec)) == [("a", 3, 5, 3, 3), ("b", 1, 1, 1, 1), ("c", 9, 9, 9, 9)]


def test_scored_merge_prefers_newest_then_first(spark, rows):
    a = spark.createDataFrame([(1, "2024-01-01", "a"), (2, "2024-01-05", "a")], "k int, ts string, v string")
    b = spark.createDataFrame([(1, "2024-01-02", "b"), (2, "2024-01-05", "b")], "k int, ts string, v string")
    assert rows(I.scored_merge([a, b], ["k"], ["ts"])) == [(1, "2024-01-02", "b"), (2, "2024-01-05", "a")]


def test_exclusions_and_post_rules(spark, rows):
    df = spark.createDataFrame([(1, 5), (2, 50)], "k int, v int")
    other = spark.createDataFrame([(2, True)], "k int, banned boolean")
    assert rows(I.excluded(df, ("xref.banned",), other, ["k"])) == [(1, 5)]
    assert rows(I.apply_post_rules(df, (("v > 10", "big", "'yes'"),))) == [(1, 5, None), (2, 50, "yes")]


def test_null_keys_and_new_columns_in_merges(spark, rows):
    spec = TableDefinition("t", (Column("k"), Column("v", "INTEGER", merge_strategy="keep_maximum"), Column("w")), ("k",))
    old = spark.createDataFrame([(None, 5), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([(None, 3, "x"), ("c", 9, "y")], "k string, v int, w string")
    assert rows(I.merged(old, new, spec)) == sorted([(None, 5, "x"), ("b", 1, None), ("c", 9, "y")], key=repr)
    assert rows(I.scored_merge([old, old], ["k"], ["v"])) == sorted([(None, 5), ("b", 1)], key=repr)


def test_scored_merge_shuffles_once(spark):
    a = spark.createDataFrame([(1, "2024-01-01")], "k int, ts string")
    plan = I.scored_merge([a, a], ["k"], ["ts"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_batches_see_their_reference(spark, rows):
    spec = TableDefinition("t", (Column("k"), Column("v", "INTEGER")), ("k",), ingestion=Ingestion("incremental", order_by=("v desc",), exclusions=("xref.banned",)))
    raw = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    banned = spark.createDataFrame([("a", True)], "k string, banned boolean")
    assert rows(I.ingest_batch(None, raw, spec, reference=banned)) == [("b", 2)]


def test_repeated_batch_changes_nothing(spark, tmp_path, rows):
    """A batch that fails after its commit, or before it, is there once."""
    from loomspec.sources.sinks import VersionedTable
    from loomspec.spec import Rule
    from loomspec.streaming import pipeline

    spec = TableDefinition("t", (Column("k"), Column("v", "INTEGER")), ingestion=Ingestion("incremental"))
    where = f"file://{tmp_path}"
    rules = [Rule("values_to_not_be_null", "v", severity="error")]
    schema = spark.createDataFrame([], "k string, v string").schema
    spark.createDataFrame([("a", "1"), ("b", None)], schema).write.parquet(f"{where}/in")

    def fail(table, number):
        raise RuntimeError("after the commit")

    def run(after=None):
        stream = pipeline.file_stream(spark, f"{where}/in", schema)
        pipeline.ingest_stream(stream, spec, f"{where}/t", f"{where}/c", rules, f"{where}/bad", after=after).awaitTermination()

    with pytest.raises(Exception, match="after the commit"):
        run(fail)
    for _ in range(2):
        run()
    assert rows(VersionedTable(spark, f"{where}/t").read()) == [("a", 1)]
    assert spark.read.parquet(f"{where}/bad").count() == 1


def test_streams_take_merge_strategies(spark, tmp_path, rows):
    from loomspec.sources.sinks import VersionedTable
    from loomspec.streaming import pipeline

    spec = TableDefinition("t", (Column("k"), Column("v", "INTEGER", merge_strategy="keep_maximum")), ("k",), ingestion=Ingestion("incremental", order_by=("v desc",), exclusions=("src.v > 100",), post_rules=(("v > 5", "big", "true"),)))
    where = f"file://{tmp_path}"
    schema = spark.createDataFrame([], "k string, v string").schema
    for batch in ([("a", "9"), ("b", "1")], [("a", "3"), ("b", "999"), ("c", "2")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{where}/in")
        pipeline.ingest_stream(pipeline.file_stream(spark, f"{where}/in", schema), spec, f"{where}/t", f"{where}/c").awaitTermination()
    assert rows(VersionedTable(spark, f"{where}/t").read()) == sorted([("a", 9, True), ("b", 1, None), ("c", 2, None)], key=repr)
