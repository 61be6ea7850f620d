import pytest

from loomspec.operators import drift, profile
from loomspec.functions import domains
from loomspec.sources import readers, sinks
from loomspec.spec import Column, Source, SpecError, TableDefinition


def spec(path, **options):
    return TableDefinition("t", (Column("row_id"), Column("note")), source=Source("delimited", str(path), options))


def test_plain_csv(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text("row_id|note\n1|x\n2|\n")
    assert rows(readers.read(spark, spec(tmp_path / "a.csv"))) == [("1", "x"), ("2", None)]


def test_quirks(spark, tmp_path, rows):
    (tmp_path / "a.txt").write_text("preamble||# comment||row_id~note||1~x||2~\\N||3~NULL||TRAILER 3||")
    got = readers.read(spark, spec(tmp_path / "a.txt", delimiter="~", line_terminator="||", skip_rows=1, footer_rows=1, comment="#", null_escape="NULL"))
    assert rows(got) == sorted([("1", "x"), ("2", None), ("3", None)], key=repr)
    (tmp_path / "empty.txt").write_text("")
    assert rows(readers.read(spark, spec(tmp_path / "empty.txt", skip_rows=1))) == []


def test_quirks_are_each_files_own(spark, tmp_path, rows):
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.txt").write_text(f'preamble {k}\n\n"row|id"|note\n' + "".join(f"{k}{i}|x\n" for i in range(4)) + "TRAILER\n")
    got = readers.read(spark, spec(folder, skip_rows=1, footer_rows=1))
    assert got.columns == ["row|id", "note"]
    assert rows(got) == sorted((f"{k}{i}", "x") for k in range(3) for i in range(4))
    headless = readers.read(spark, spec(folder, skip_rows=2, header=False))
    assert headless.count() == 15 and headless.columns == ["row_id", "note"]


def test_json_paths(spark, tmp_path, rows):
    (tmp_path / "a.json").write_text('{"id": 1, "who": {"name": {"first": "A"}}}\n')
    s = TableDefinition("t", (Column("id"),), source=Source("json", str(tmp_path / "a.json"), projection={"id": "id", "first": "who.name.first"}))
    assert rows(readers.read(spark, s)) == [(1, "A")]
    with pytest.raises(SpecError, match="who.name.first"):
        readers.project_paths(spark.read.json(str(tmp_path / "a.json")), {"x": "who.age"})


def test_jdbc_options():
    s = Source("jdbc", options={"url": "jdbc:x", "dbtable": "t", "user": "u", "password_secret": "p", "partition_column": "id", "lower_bound": 0, "upper_bound": 9, "num_partitions": 3})
    assert readers.jdbc_options(s, {"p": "hush"}.get)["password"] == "hush" and readers.jdbc_options(s, {"p": "hush"}.get)["numPartitions"] == "3"
    with pytest.raises(SpecError):
        readers.jdbc_options(s, {}.get)
    with pytest.raises(SpecError):
        readers.jdbc_options(Source("jdbc", options={"url": "x", "dbtable": "t", "partition_column": "id"}))


def test_headers_and_names(spark, rows):
    df = spark.createDataFrame([("1", "n")], ["  ROW_ID ", "Remark"])
    s = TableDefinition("t", (Column("row_id"), Column("note", aliases=("remark",))))
    assert readers.map_header(df, s).columns == ["row_id", "note"]
    assert readers.snake_case("HTTPServerName") == "http_server_name" and readers.quoted("a]b", "sqlserver") == "[a]]b]"
    assert set(readers.with_provenance(df).columns) >= {"_source_file", "_load_ts"}


def test_versions_and_history(spark, tmp_path, rows):
    t = sinks.VersionedTable(spark, f"file://{tmp_path}/v")
    assert t.read() is None
    t.write(spark.range(2))
    t.write(t.read().union(spark.range(2, 3)))
    assert rows(t.read()) == [(0,), (1,), (2,)]
    h = sinks.History(spark, f"file://{tmp_path}/h")
    for i, day in enumerate(("2024-01-01", "2024-01-02")):
        h.append(spark.sql(f"SELECT 'r{i}' AS run_id, timestamp'{day}' AS run_timestamp, 't' AS table_name, {i} AS n"))
    assert h.recent(1, table_name="t").first()["run_id"] == "r1" and h.latest(["table_name"]).first()["n"] == 1


def test_single_csv(spark, tmp_path):
    sinks.write_single_csv(spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), f"file://{tmp_path}/out.csv", footer=True)
    assert (tmp_path / "out.csv").read_text().split("\n")[:4] == ["k|v", "1|a", "2|", "TRAILER|2"]


def test_drift_functions(spark):
    a = spark.range(100).selectExpr("cast(id AS double) AS x")
    assert drift.ks(a, a, "x").first()[0] == 0 and drift.ks(a, a.selectExpr("x + 50 AS x"), "x").first()[0] == 0.5
    assert drift.rebinned([0, 2, 4], [10, 20], [0, 1, 4]) == [5.0, 25.0]
    assert abs(drift.chi_square_p_value(3.841459, 2) - 0.05) < 1e-6 and abs(drift.ks_p_value(0.5, 100, 100) - 0) < 1e-9
    assert drift.compare_column(a, a, "x")["psi"] == 0
    assert drift.row_count_change(0, 5)["percent"] == 100.0


def test_key_candidates(spark):
    df = spark.range(60).selectExpr("id % 6 AS a", "id % 10 AS b", "cast(id AS string) AS c", "CASE WHEN id > 0 THEN id END AS hole")
    got = {r["columns"]: r["unique"] for r in profile.key_candidates(df).collect()}
    assert got["c"] and not any(v for k, v in got.items() if "c" in k.split(",") and k != "c") and "hole" not in got
    assert profile.promoted_key([(("c",), 1.0), (("a", "b"), 0.8)]) == ("c",) and profile.promoted_key([(("a",), 0.5)]) is None


def test_key_candidates_count_exactly(spark):
    """Sets far from unique and larger than a sketch holds exactly."""
    df = spark.range(60000).selectExpr("id % 20000 AS a", "id % 30011 AS b", "CASE WHEN id % 3 > 0 THEN id END AS c")
    got = {r["columns"]: (r["distinct_count"], r["unique"]) for r in profile.key_candidates(df).collect()}
    assert got["a"] == (20000, False) and got["b"] == (30011, False)
    got = {r["columns"]: (r["distinct_count"], r["unique"]) for r in profile.key_candidates(df, sets=[("c",), ("a", "c"), ("a", "b"), ("a", "b", "c")]).collect()}
    assert got == {"c": (40000, False), "a,c": (60000, True), "a,b": (60000, True), "a,b,c": (60000, False)}


def test_domains(spark):
    df = spark.createDataFrame([("a@b.co",), ("x@y.org",), (None,)], "email_address string")
    assert domains.infer(df, "email_address")[0] == "email" and domains.infer(None, "zzz")[0] == "unmapped"


def test_appends_add_folders_and_commit_batches(spark, tmp_path, rows):
    table = sinks.VersionedTable(spark, f"file://{tmp_path}/t")
    assert table.read() is None and not table.has(0)
    one, two = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(2, "x")], "k int, v string")
    table.append(one, 0)
    first = table.current()[0]
    table.append(two, 1)
    assert table.current()[0][:1] == first and rows(table.read()) == sorted([(1, None), (2, "x")], key=repr)
    assert table.has(1) and table.has(0) and not table.has(2)
    table.write(two, 2)
    table.write(one, 3)
    left = {p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")}
    assert rows(table.read()) == [(1,)] and len(left) == 2 and not left & set(first)


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Far:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://far:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        sinks.shared_root(Far)
