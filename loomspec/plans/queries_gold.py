"""Derived tables: each query compiles a specification over the given tables, and has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspec.operators import relational as R
from loomspec.plans.compiler import compile_table
from loomspec.spec import Candidate, Column, Derivation, JoinVia, Metadata, Relationship, TableDefinition

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def col(name: str, type: str = "VARCHAR", *candidates: Candidate, strategy: str | None = None, default=None, **more) -> Column:
    return Column(name, type, derivation=Derivation(tuple(candidates), strategy, default) if candidates or strategy else None, default=None if candidates else default, **more)


def of(table: str, column: str | None = None, expression: str | None = None, **more) -> Candidate:
    return Candidate(table, column, expression, **more)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def spec_query(name: str, target: TableDefinition, names: tuple[str, ...], sql: str, prepare=None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = tables(spark, sf_dir, *names)
        return compile_table(spark, target, prepare(found) if prepare else found)

    QUERIES[name], ORACLE_SQL[name] = run, sql


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


ORDER_KEY = col("o_orderkey", "BIGINT", of("orders", "o_orderkey"))
ORDER_CUST = col("o_custkey", "BIGINT", of("orders", "o_custkey"))
TO_CUSTOMER = Relationship("customer", (("o_custkey", "c_custkey"),))

spec_query("gold_direct_join", TableDefinition("order_enriched", (ORDER_KEY, ORDER_CUST, col("c_name", "VARCHAR", of("customer", "c_name")), col("c_acctbal", "DOUBLE", of("customer", "c_acctbal"))), ("o_orderkey",), relationships=(TO_CUSTOMER,), metadata=Metadata("orders")), ("orders", "customer"),
    "SELECT o_orderkey, o_custkey, c_name, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey")

spec_query("gold_inner_join", TableDefinition("building_orders", (ORDER_KEY, col("c_name", "VARCHAR", of("customer", "c_name")), col("segment", "VARCHAR", of("customer", "c_mktsegment"))), ("o_orderkey",), relationships=(Relationship("customer", (("o_custkey", "c_custkey"),), how="inner", filter="c_mktsegment = 'BUILDING'"),), metadata=Metadata("orders")), ("orders", "customer"),
    "SELECT o_orderkey, c_name, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING'")

spec_query("gold_full_outer_join", TableDefinition("doc_labels", (col("doc_id", "BIGINT", of("documents", "doc_id")), col("label_doc", "BIGINT", of("labels", "doc_id")), col("quality", "INTEGER", of("labels", "quality"))), relationships=(Relationship("labels", (("doc_id", "doc_id * 2"),), how="full_outer"),), metadata=Metadata("documents")), ("documents", "labels"),
    "SELECT d.doc_id, l.doc_id AS label_doc, l.quality FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id * 2")

spec_query("gold_full_outer_filtered", TableDefinition("doc_labels", (col("doc_id", "BIGINT", of("documents", "doc_id")), col("label_doc", "BIGINT", of("labels", "doc_id")), col("quality", "INTEGER", of("labels", "quality"))), relationships=(Relationship("labels", (("doc_id", "doc_id"),), how="full_outer", filter="quality = 1"),), metadata=Metadata("documents")), ("documents", "labels"),
    "SELECT d.doc_id, l.doc_id AS label_doc, l.quality FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1")

spec_query("gold_filtered_join", TableDefinition("doc_quality", (col("doc_id", "BIGINT", of("documents", "doc_id")), col("quality", "INTEGER", of("labels", "quality"))), ("doc_id",), relationships=(Relationship("labels", (("doc_id", "doc_id"),), filter="toxic = 0 AND 'quality' <> ''"),), metadata=Metadata("documents")), ("documents", "labels"),
    "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.toxic = 0")

spec_query("gold_composite_key_join", TableDefinition("line_totals", (col("l_partkey", "BIGINT", of("lineitem", "l_partkey")), col("l_suppkey", "BIGINT", of("lineitem", "l_suppkey")), col("l_orderkey", "BIGINT", of("lineitem", "l_orderkey")), col("pair_lines", "BIGINT", of("pairs", "lines"))), relationships=(Relationship("pairs", (("l_partkey", "p"), ("l_suppkey", "s"))),), metadata=Metadata("lineitem")), ("lineitem",),
    "SELECT l_partkey, l_suppkey, l_orderkey, lines AS pair_lines FROM lineitem LEFT JOIN (SELECT l_partkey p, l_suppkey s, count(*) AS lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) x ON l_partkey = p AND l_suppkey = s",
    lambda t: t | {"pairs": t["lineitem"].where("l_returnflag = 'R'").groupBy(t["lineitem"]["l_partkey"].alias("p"), t["lineitem"]["l_suppkey"].alias("s")).count().withColumnRenamed("count", "lines")})

spec_query("gold_expression_key_join", TableDefinition("customer_nation", (col("c_custkey", "BIGINT", of("customer", "c_custkey")), col("n_name", "VARCHAR", of("nation", "n_name"))), relationships=(Relationship("nation", (("upper(trim(concat(' n', cast(c_nationkey AS string), ' ')))", "upper(concat('N', cast(n_nationkey AS string)))"),)),), metadata=Metadata("customer")), ("customer", "nation"),
    "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON upper(trim(concat(' n', c_nationkey, ' '))) = upper(concat('N', n_nationkey))")

spec_query("gold_multi_instance_join", TableDefinition("order_flags", (ORDER_KEY, col("returned", "BIGINT", of("flags", "lines", table_instance="r")), col("new", "BIGINT", of("flags", "lines", table_instance="n"))), ("o_orderkey",), relationships=(Relationship("flags", (("o_orderkey", "k"),), instance="r", filter="flag = 'R'"), Relationship("flags", (("o_orderkey", "k"),), instance="n", filter="flag = 'N'")), metadata=Metadata("orders")), ("orders", "lineitem"),
    "WITH f AS (SELECT l_orderkey k, l_returnflag flag, count(*) AS lines FROM lineitem GROUP BY 1, 2) SELECT o_orderkey, r.lines AS returned, n.lines AS new FROM orders LEFT JOIN f r ON o_orderkey = r.k AND r.flag = 'R' LEFT JOIN f n ON o_orderkey = n.k AND n.flag = 'N'",
    lambda t: t | {"flags": t["lineitem"].groupBy(t["lineitem"]["l_orderkey"].alias("k"), t["lineitem"]["l_returnflag"].alias("flag")).count().withColumnRenamed("count", "lines")})

spec_query("gold_bridge_join", TableDefinition("line_nation", (col("l_orderkey", "BIGINT", of("lineitem", "l_orderkey")), col("l_linenumber", "INTEGER", of("lineitem", "l_linenumber")), col("n_name", "VARCHAR", of("nation", "n_name"))), relationships=(Relationship("nation", (("l_suppkey", "s_suppkey"),), bridge="supplier", bridge_keys=(("s_nationkey", "n_nationkey"),)),), metadata=Metadata("lineitem")), ("lineitem", "supplier", "nation"),
    "SELECT l_orderkey, l_linenumber, n_name FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey")

spec_query("gold_alternative_paths", TableDefinition("customer_supplier", (col("c_custkey", "BIGINT", of("customer", "c_custkey")), col("s_suppkey", "BIGINT", of("supplier", "s_suppkey")), col("s_name", "VARCHAR", of("supplier", "s_name"))), relationships=(Relationship("supplier", paths=((("c_custkey", "s_suppkey"),), (("c_nationkey", "s_nationkey"),))),), metadata=Metadata("customer")), ("customer", "supplier"),
    """WITH hits AS (
  SELECT c_custkey, c_nationkey, s.*, 0 AS p FROM customer JOIN supplier s ON c_custkey = s_suppkey
  UNION ALL SELECT c_custkey, c_nationkey, s.*, 1 FROM customer JOIN supplier s ON c_nationkey = s_nationkey),
one AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY c_custkey, c_nationkey ORDER BY p, s_suppkey, s_name, s_nationkey, s_acctbal) = 1)
SELECT c.c_custkey, s_suppkey, s_name FROM customer c LEFT JOIN one o ON c.c_custkey IS NOT DISTINCT FROM o.c_custkey AND c.c_nationkey IS NOT DISTINCT FROM o.c_nationkey""")

spec_query("gold_first_record", TableDefinition("customer_first_order", (col("c_custkey", "BIGINT", of("customer", "c_custkey")), col("first_order", "BIGINT", of("orders", "o_orderkey")), col("first_date", "DATE", of("orders", None, "cast(o_orderdate AS date)"))), ("c_custkey",), relationships=(Relationship("orders", (("c_custkey", "o_custkey"),), cardinality="1:N", order_by=("o_orderdate asc", "o_orderkey asc")),), metadata=Metadata("customer")), ("customer", "orders"),
    """SELECT c_custkey, o_orderkey AS first_order, cast(o_orderdate AS date) AS first_date FROM customer LEFT JOIN
  (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) ON c_custkey = o_custkey""")

spec_query("gold_pivot", TableDefinition("customer_priorities", (col("c_custkey", "BIGINT", of("customer", "c_custkey")), *(col(f"priority_{i}", "VARCHAR", of("orders", "o_orderpriority")) for i in (1, 2, 3))), ("c_custkey",), relationships=(Relationship("orders", (("c_custkey", "o_custkey"),), cardinality="1:N", filter="o_orderstatus = 'F'"),), metadata=Metadata("customer")), ("customer", "orders"),
    """WITH r AS (SELECT o_custkey, o_orderpriority v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority ASC NULLS LAST, o_orderkey) rn FROM orders WHERE o_orderstatus = 'F')
SELECT c_custkey, max(CASE WHEN rn = 1 THEN v END) AS priority_1, max(CASE WHEN rn = 2 THEN v END) AS priority_2, max(CASE WHEN rn = 3 THEN v END) AS priority_3
FROM customer LEFT JOIN r ON c_custkey = o_custkey GROUP BY c_custkey""")

UNPIVOT = (col("l_orderkey", "BIGINT"), col("l_linenumber", "INTEGER"), col("l_partkey", "BIGINT"), col("source_column", "VARCHAR"), col("value", "DOUBLE"))


def _holes(t: dict) -> dict:
    from pyspark.sql import functions as F

    df = t["lineitem"]
    return {"lineitem": df.withColumn("l_discount", F.nullif("l_discount", F.lit(0.05)))}


spec_query("gold_unpivot", TableDefinition("line_measures", UNPIVOT, metadata=Metadata("lineitem", "unpivot", unpivot_columns=("l_quantity", "l_discount", "l_tax"))), ("lineitem",),
    """SELECT l_orderkey, l_linenumber, l_partkey, source_column, value FROM (SELECT * REPLACE (nullif(l_discount, 0.05) AS l_discount) FROM lineitem)
UNPIVOT (value FOR source_column IN (l_quantity, l_discount, l_tax))""", _holes)

spec_query("gold_unpivot_dedup_latest", TableDefinition("latest_line_measures", UNPIVOT[:1] + UNPIVOT[3:], ("l_orderkey",), metadata=Metadata("lineitem", "unpivot", unpivot_columns=("l_quantity", "l_discount", "l_tax"), unpivot_dedup=("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"), unpivot_key=("l_orderkey",))), ("lineitem",),
    """SELECT l_orderkey, source_column, value FROM (SELECT * REPLACE (nullif(l_discount, 0.05) AS l_discount) FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1)
UNPIVOT (value FOR source_column IN (l_quantity, l_discount, l_tax))""", _holes)

spec_query("gold_union_sources", TableDefinition("nation_universe", (col("nationkey", "INTEGER", strategy="primary_key"),), ("nationkey",), metadata=Metadata(None, "union_sources", union_sources=(("customer", "c_nationkey"), ("supplier", "nullif(s_nationkey, 3)")), union_key="nationkey")), ("customer", "supplier"),
    "SELECT c_nationkey AS nationkey FROM customer WHERE c_nationkey IS NOT NULL UNION SELECT nullif(s_nationkey, 3) FROM supplier WHERE nullif(s_nationkey, 3) IS NOT NULL")

BRANCH = (col("o_custkey", "BIGINT", of("old", "o_custkey"), of("new", "o_custkey")), col("o_orderkey", "BIGINT", of("old", "o_orderkey"), of("new", "o_orderkey")), col("total", "DOUBLE", of("old", "o_totalprice"), of("new", None, "o_totalprice * 2")), col("status", "VARCHAR", of("new", "o_orderstatus")), col("generation", "VARCHAR", Candidate("old", union_value="old"), Candidate("new", union_value="new")))
_SPLIT = "o_orderdate < TIMESTAMP '1998-06-01'"


def _split(t: dict) -> dict:
    return {"old": t["orders"].where(_SPLIT.replace("TIMESTAMP", "timestamp_ntz")), "new": t["orders"].where("NOT " + _SPLIT.replace("TIMESTAMP", "timestamp_ntz"))}


_OLD = f"SELECT o_custkey, o_orderkey, o_totalprice AS total, NULL::VARCHAR AS status, 'old' AS generation FROM orders WHERE {_SPLIT} AND o_orderstatus <> 'P'"
_NEW = f"SELECT o_custkey, o_orderkey, o_totalprice * 2 AS total, o_orderstatus AS status, 'new' AS generation FROM orders WHERE NOT {_SPLIT}"
_BRANCHES = dict(base_strategy="union_branches", branches=("old", "new"), branch_filters={"old": "o_orderstatus <> 'P'"})

spec_query("gold_union_branches", TableDefinition("order_lines", BRANCH, metadata=Metadata(None, **_BRANCHES)), ("orders",), f"{_OLD} UNION ALL {_NEW}", _split)
spec_query("gold_union_branches_dedup", TableDefinition("order_lines", BRANCH, ("o_custkey",), metadata=Metadata(None, **_BRANCHES, branch_dedup={"old": ("o_orderdate", "o_orderkey"), "new": ("o_orderdate", "o_orderkey")})), ("orders",),
    f"SELECT * EXCLUDE (o_orderdate) FROM ({_OLD.replace(' FROM', ', o_orderdate FROM')} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) UNION ALL SELECT * EXCLUDE (o_orderdate) FROM ({_NEW.replace(' FROM', ', o_orderdate FROM')} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)", _split)

_KEYED = TableDefinition("customer_totals", (col("k", "BIGINT", of("old", "k"), of("new", "k")), col("total", "DOUBLE", of("old", None, "CASE WHEN k % 2 = 0 THEN total END"), of("new", "total")), col("orders", "BIGINT", of("old", "n"), of("new", "n"))), ("k",), metadata=Metadata(None, "union_branches", branches=("old", "new"), overlap="exclude_base"))


def _totals(t: dict) -> dict:
    from pyspark.sql import functions as F

    each = _split(t)
    return {n: df.where("o_custkey % 5 <> " + ("1" if n == "old" else "2")).groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n")) for n, df in each.items()}


_A = f"SELECT o_custkey k, CASE WHEN o_custkey % 2 = 0 THEN round(sum(o_totalprice), 2) END total, count(*) orders FROM orders WHERE {_SPLIT} AND o_custkey % 5 <> 1 GROUP BY 1"
_B = f"SELECT o_custkey k, round(sum(o_totalprice), 2) total, count(*) orders FROM orders WHERE NOT {_SPLIT} AND o_custkey % 5 <> 2 GROUP BY 1"
spec_query("gold_union_exclude_base", _KEYED, ("orders",), f"WITH a AS ({_A}), b AS ({_B}) SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.k = b.k)", _totals)
spec_query("gold_union_coalesce_base", TableDefinition(**(_KEYED.__dict__ | {"metadata": Metadata(None, "union_branches", branches=("old", "new"), overlap="coalesce_base")})), ("orders",), f"WITH a AS ({_A}), b AS ({_B}) SELECT coalesce(a.k, b.k) AS k, coalesce(a.total, b.total) AS total, coalesce(a.orders, b.orders) AS orders FROM a FULL OUTER JOIN b ON a.k = b.k", _totals)

spec_query("gold_aggregate_source", TableDefinition("flag_totals", (col("flag", "VARCHAR", of("lineitem", "l_returnflag")), col("status", "VARCHAR", of("lineitem", "l_linestatus")), col("quantity", "DOUBLE", of("lineitem", None, "sum(l_quantity)")), col("lines", "BIGINT", of("lineitem", None, "count(*)")), col("suppliers", "BIGINT", of("lineitem", None, "count(DISTINCT l_suppkey)")), col("big_lines", "BIGINT", of("lineitem", None, "count(*) FILTER (WHERE l_quantity > 40)"))), metadata=Metadata("lineitem", "aggregate_source")), ("lineitem",),
    "SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS quantity, count(*) AS lines, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_quantity > 40) AS big_lines FROM lineitem GROUP BY 1, 2")

_TO_ORDERS = Relationship("orders", (("c_custkey", "o_custkey"),), cardinality="1:N")
spec_query("gold_preagg_group", TableDefinition("customer_stats", (col("c_custkey", "BIGINT", of("customer", "c_custkey")), col("n_orders", "BIGINT", of("orders", None, "count(*)")), col("biggest", "DOUBLE", of("orders", None, "max(o_totalprice)")), col("n_priorities", "BIGINT", of("orders", None, "count(DISTINCT o_orderpriority)")), col("n_open", "BIGINT", of("orders", None, "count(*)", row_filter="o_orderstatus = 'O'"), default=0)), ("c_custkey",), relationships=(_TO_ORDERS,), metadata=Metadata("customer")), ("customer", "orders"),
    """SELECT c_custkey, n_orders, biggest, n_priorities, coalesce(n_open, 0) AS n_open FROM customer LEFT JOIN
  (SELECT o_custkey, count(*) n_orders, max(o_totalprice) biggest, count(DISTINCT o_orderpriority) n_priorities FROM orders GROUP BY 1) a ON c_custkey = a.o_custkey LEFT JOIN
  (SELECT o_custkey, count(*) n_open FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON c_custkey = b.o_custkey""")

spec_query("gold_preagg_window", TableDefinition("customer_latest", (col("c_custkey", "BIGINT", of("customer", "c_custkey")), col("latest_status", "VARCHAR", of("orders", None, "MAX_BY(o_orderstatus, o_orderdate)", order_by=("o_orderdate desc", "o_orderkey desc"))), col("n_orders", "BIGINT", of("orders", None, "COUNT(*)"))), ("c_custkey",), relationships=(_TO_ORDERS,), metadata=Metadata("customer")), ("customer", "orders"),
    """SELECT c_custkey, latest_status, n_orders FROM customer LEFT JOIN
  (SELECT o_custkey, o_orderstatus AS latest_status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) a ON c_custkey = a.o_custkey LEFT JOIN
  (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) b ON c_custkey = b.o_custkey""")

spec_query("gold_preagg_via_lookup", TableDefinition("customer_lines", (col("c_custkey", "BIGINT", of("customer", "c_custkey")), col("n_lines", "BIGINT", of("lineitem", None, "count(*)", join_via=JoinVia("orders", "l_orderkey", "o_orderkey", "o_custkey"))), col("max_quantity", "DOUBLE", of("lineitem", None, "max(l_quantity)", join_via=JoinVia("orders", "l_orderkey", "o_orderkey", "o_custkey")))), ("c_custkey",), relationships=(Relationship("lineitem", (("c_custkey", "o_custkey"),), cardinality="1:N"),), metadata=Metadata("customer")), ("customer", "orders", "lineitem"),
    "SELECT c_custkey, n_lines, max_quantity FROM customer LEFT JOIN (SELECT o_custkey, count(*) n_lines, max(l_quantity) max_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) ON c_custkey = o_custkey")

_KEYS = Metadata(None, "union_sources", union_sources=(("customer", "c_custkey"), ("supplier", "s_suppkey")), union_key="k")
_TO_BOTH = (Relationship("customer", (("k", "c_custkey"),), filter="c_custkey % 3 <> 0"), Relationship("supplier", (("k", "s_suppkey"),)))
_UNIVERSE = "WITH u AS (SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier), j AS (SELECT u.k, c.*, s.* FROM u LEFT JOIN customer c ON u.k = c_custkey AND c_custkey % 3 <> 0 LEFT JOIN supplier s ON u.k = s_suppkey)"
spec_query("gold_survivorship_priority", TableDefinition("party", (col("k", "BIGINT", strategy="primary_key"), col("name", "VARCHAR", of("customer", None, "CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END", priority=1), of("supplier", "s_name", priority=2))), ("k",), relationships=_TO_BOTH, metadata=_KEYS), ("customer", "supplier"),
    f"{_UNIVERSE} SELECT k, coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END, ''), nullif(s_name, '')) AS name FROM j")
spec_query("gold_survivorship_max_across", TableDefinition("party", (col("k", "BIGINT", strategy="primary_key"), col("balance", "DOUBLE", of("customer", "c_acctbal"), of("supplier", "s_acctbal"), strategy="max_across_sources")), ("k",), relationships=_TO_BOTH, metadata=_KEYS), ("customer", "supplier"),
    f"{_UNIVERSE} SELECT k, greatest(c_acctbal, s_acctbal) AS balance FROM j")
spec_query("gold_survivorship_default", TableDefinition("party", (col("k", "BIGINT", strategy="primary_key"), col("balance", "DOUBLE", of("supplier", "s_acctbal"), default=-1.0), col("source", "VARCHAR", default="crm"), col("note", "VARCHAR")), ("k",), relationships=_TO_BOTH[1:], metadata=_KEYS), ("customer", "supplier"),
    "WITH u AS (SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier) SELECT k, coalesce(s_acctbal, -1.0) AS balance, 'crm' AS source, NULL::VARCHAR AS note FROM u LEFT JOIN supplier ON k = s_suppkey")

_EVENT = (col("user_id", "BIGINT", of("events", "user_id")), col("event_type", "VARCHAR", of("events", "event_type")))
spec_query("gold_final_filter", TableDefinition("big_events", (col("event_id", "BIGINT", of("events", "event_id")), *_EVENT, col("doubled", "DOUBLE", of("events", None, "value * {{factor}}"))), metadata=Metadata("events", final_filter="doubled > {{least}} AND event_type <> 'error'")), ("events",),
    "SELECT event_id, user_id, event_type, value * 2 AS doubled FROM events WHERE value * 2 > 150 AND event_type <> 'error'")
QUERIES["gold_final_filter"] = (lambda target: lambda spark, sf_dir: compile_table(spark, target, tables(spark, sf_dir, "events"), variables={"factor": "2", "least": "150"}))(TableDefinition("big_events", (col("event_id", "BIGINT", of("events", "event_id")), *_EVENT, col("doubled", "DOUBLE", of("events", None, "value * {{factor}}"))), metadata=Metadata("events", final_filter="doubled > {{least}} AND event_type <> 'error'")))
spec_query("gold_final_distinct", TableDefinition("user_types", _EVENT, metadata=Metadata("events", final_dedup="distinct")), ("events",), "SELECT DISTINCT user_id, event_type FROM events")
spec_query("gold_final_latest", TableDefinition("user_latest", (col("user_id", "BIGINT", of("events", None, "nullif(user_id, 7)")), col("event_id", "BIGINT", of("events", "event_id")), _EVENT[1]), ("user_id",), metadata=Metadata("events", final_dedup="latest", final_order=("event_id desc",))), ("events",),
    "SELECT nullif(user_id, 7) AS user_id, event_id, event_type FROM events QUALIFY nullif(user_id, 7) IS NULL OR row_number() OVER (PARTITION BY nullif(user_id, 7) ORDER BY event_id DESC) = 1")


@query("SELECT c_custkey, c_nationkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P')")
def gold_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "customer", "orders")
    late = t["orders"].where("o_orderstatus = 'P'")
    return t["customer"].join(late, t["customer"]["c_custkey"] == late["o_custkey"], "left_anti").select("c_custkey", "c_nationkey")


@query("SELECT a.k, a.n AS left_n, b.n AS right_n FROM (SELECT nullif(user_id, 5) k, count(*) n FROM events WHERE event_type = 'view' GROUP BY 1) a JOIN (SELECT nullif(user_id, 5) k, count(*) n FROM events WHERE event_type = 'error' GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k")
def gold_null_safe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    events = tables(spark, sf_dir, "events")["events"].withColumn("k", F.nullif("user_id", F.lit(5)))
    each = {t: events.where(F.col("event_type") == t).groupBy("k").agg(F.count("*").alias("n")) for t in ("view", "error")}
    return R.direct_join(each["view"], each["error"], "b", (("k", "k"),), "inner", null_safe=True).select("k", F.col("n").alias("left_n"), F.col("b__n").alias("right_n"))


@query("SELECT 'x' AS code, 42 AS answer, NULL::VARCHAR AS note")
def gold_synthetic_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_table(spark, TableDefinition("constants", (col("code", "VARCHAR", default="x", position=1), col("answer", "INTEGER", default=42, position=2), col("note", "VARCHAR", position=3))), {})


@query("SELECT o_orderkey AS k, o_custkey AS cust, NULL::VARCHAR AS name FROM orders UNION ALL SELECT c_custkey, NULL, c_name FROM customer")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    t = tables(spark, sf_dir, "orders", "customer")
    return R.union_branches([t["orders"].select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust")), t["customer"].select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))])


@query("""SELECT o_orderkey, o_custkey, upper(o_orderstatus) AS status, meta_load_dt FROM (SELECT *, DATE '2024-01-01' AS meta_load_dt FROM orders) WHERE o_totalprice > 100000""")
def gold_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computed source columns overlay physical ones, base filters apply, provenance columns pass through."""
    from pyspark.sql import functions as F

    t = {"orders": tables(spark, sf_dir, "orders")["orders"].withColumn("meta_load_dt", F.lit("2024-01-01").cast("date"))}
    source = TableDefinition("orders", (Column("o_orderstatus", source_expression="upper(o_orderstatus)"),))
    target = TableDefinition("dear", (ORDER_KEY, ORDER_CUST, col("status", "VARCHAR", of("orders", "o_orderstatus"))), metadata=Metadata("orders", base_filter="o_totalprice > 100000"))
    return compile_table(spark, target, t, {"orders": source})
