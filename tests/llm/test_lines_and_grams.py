import duckdb
import pytest
from pyspark.sql import functions as F

from loomspec.llm import decontamination, line_dedup, queries


def duck(spark, sql, **frames):
    con = duckdb.connect()
    for n, df in frames.items():
        con.register(n, df.toPandas())
    return sorted(con.sql(sql).fetchall(), key=repr)


def lines(prose):
    out = [(i, f"Shared Line\n{prose(6, i)}\n shared  LINE \n\nsemi", f"site{i % 12}") for i in range(40)]
    out += [(100 + i, f"semi\n{prose(4, 900 + i)}", f"site{i % 3}") for i in range(9)]
    return out + [(200, None, "site1"), (201, "", None), (202, "shared line", None), (203, "\n\n", "z")]


def test_lines_against_sql(spark, documents, prose):
    docs = documents(lines(prose))
    got = line_dedup.remove_boilerplate(docs, removed_col="n_removed").select("doc_id", "n_removed", F.length("text").alias("n"), F.sha2("text", 256).alias("s"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == duck(spark, queries.ORACLE_SQL["op3_line_dedup"], documents=docs)
    kept = {r["doc_id"]: r["text"] for r in line_dedup.remove_boilerplate(docs).collect()}
    assert len(kept) == 53 and kept[202] == "" and kept[200] is None and kept[203] == "\n\n" and "Shared" not in kept[0]


def test_lines_by_join_are_the_same(documents, prose):
    docs = documents(lines(prose)).withColumn("key", F.lit(1))
    one, two = (sorted((tuple(r) for r in line_dedup.remove_boilerplate(docs, removed_col="n", most_lines=most).collect()), key=repr) for most in (100, 0))
    assert one == two and any(r[-1] for r in one)


@pytest.mark.parametrize("sites", [9, 10, 11, 40])
def test_threshold_is_exact(documents, sites):
    docs = documents([(i, "footer", f"s{i}") for i in range(sites)] + [(1000 + i, "footer", "s0") for i in range(50)])
    gone = line_dedup.remove_boilerplate(docs, removed_col="n").where("n > 0").count()
    assert gone == (sites + 50 if sites >= line_dedup.LEAST_SITES else 0)


def test_lines_keep_columns_and_empty_tables(documents):
    docs = documents([(1, "a")]).withColumn("key", F.lit(1)).withColumn("hit", F.lit(2))
    assert line_dedup.remove_boilerplate(docs).columns == docs.columns
    assert line_dedup.remove_boilerplate(docs.limit(0)).count() == 0


ITEMS = [(1, "One two three four five six seven eight nine ten eleven"), (2, "short item"), (3, None), (4, "..."), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (5, "short item")]
TEXTS = [(1, "x ONE, two-three four five six seven eight nine ten! eleven y"), (2, "one two three four five six seven eight nine"), (3, "a Short  item, short item"), (4, None), (5, ""), (6, "short\nitem short"), (7, "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3), (7, "short item"), (None, "short item")]


def test_grams_against_sql(spark, documents):
    docs = documents(TEXTS).where("doc_id <> 7 OR text <> 'short item'").where("doc_id IS NOT NULL")
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    for most in (1000, 0):  # in the plan, and through a join
        hits = decontamination.find_hits(docs, bench, most_hashes=most)
        got = hits.select("doc_id", "n_words", F.size("hit_words"), F.size("items"), F.sha2(F.array_join("items", ","), 256), F.size("hit_words") > 0)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == duck(spark, queries.ORACLE_SQL["op6_decontamination"], documents=docs, benchmark=bench)


@pytest.mark.parametrize("most", [1000, 0])
def test_removal(spark, documents, most):
    docs, bench = documents(TEXTS).withColumn("w", F.lit("clash")), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    left = decontamination.decontaminate(docs, bench, most_hashes=most)
    assert left.columns == docs.columns and sorted((r["doc_id"] for r in left.collect())) == [2, 4, 5]
    spans = {(r["doc_id"], r["text"]) for r in decontamination.decontaminate(docs, bench, "spans", most_hashes=most).collect()}
    assert {(3, "a   ,  "), (1, "x , -       !  y"), (6, "\n short")} <= spans
    assert len(spans) == 9 and (2, TEXTS[1][1]) in spans


def test_empty_benchmark(spark, documents):
    docs, bench = documents(TEXTS), spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.decontaminate(docs, bench).count() == 9
    assert decontamination.find_hits(docs, bench).where(F.size("hit_words") > 0).count() == 0
    assert decontamination.find_hits(docs.limit(0), spark.createDataFrame(ITEMS, "item_id bigint, text string")).count() == 0


def test_native(documents, spark):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("x", F.lit(1))
    for df in (decontamination.find_hits(documents(TEXTS), bench), line_dedup.remove_boilerplate(documents(TEXTS))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_few_lines_go_to_few_files(spark, documents, prose, monkeypatch):
    """However many tasks make them: each file that is written starts processes beside the executor."""
    files, saved = [], line_dedup.saved

    def watched(*args, **more):
        out = saved(*args, **more)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(line_dedup, "saved", watched)
    many = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in many}
    for key, value in many.items():
        spark.conf.set(key, value)
    try:
        docs = documents([(i, "\n".join([prose(4, i), *(f"line {k}" for k in range(60))]), f"site {i}") for i in range(30)])
        assert line_dedup.remove_boilerplate(docs, removed_col="n").where("n = 60").count() == 30
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert len(files) == 2 and max(files) <= spark.sparkContext.defaultParallelism
