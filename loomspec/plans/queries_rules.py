"""One query for each rule, with its SQL: (rule, element_count, unexpected_count, success). Holes are put into clean tables first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspec.operators.rules import Context, orphans, verdicts
from loomspec.operators.suite import score_frame
from loomspec.plans.queries_gold import tables
from loomspec.spec import Rule

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: The tables that rules run on: columns as (name, expression), which Spark and DuckDB read alike.
FRAMES = {
    "lines": ("lineitem", {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "l_partkey": "l_partkey", "l_quantity": "l_quantity", "l_discount": "nullif(l_discount, 0.05)", "flag": "nullif(l_returnflag, 'A')", "status": "l_linestatus", "l_extendedprice": "l_extendedprice", "l_tax": "l_tax", "l_shipdate": "l_shipdate"}),
    "sales": ("orders", {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "status": "o_orderstatus", "o_totalprice": "o_totalprice", "priority": "o_orderpriority", "o_orderdate": "o_orderdate", "code": "concat(o_orderstatus, '-', cast(o_custkey AS string))", "amount": "CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE cast(o_custkey AS string) END", "day": "CASE WHEN o_orderkey % 7 = 0 THEN '13/45/2020' ELSE '02/28/2021' END"}),
    "clicks": ("events", {"event_id": "event_id", "user_id": "nullif(user_id, 9)", "event_type": "event_type", "value": "value", "props": "CASE WHEN event_id % 11 = 0 THEN 'broken {' ELSE props END", "ts": "ts"}),
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = FRAMES[name]
    return tables(spark, sf_dir, table)[table].select(*(F.expr(e).alias(n) for n, e in columns.items()))


def frame_sql(name: str) -> str:
    table, columns = FRAMES[name]
    listed = ", ".join(f"{e.replace('AS string', 'AS VARCHAR')} AS {n}" for n, e in columns.items())
    return f"(SELECT {listed} FROM {table})"


def row_rule(name: str, on: str, rule: Rule, population: str, unexpected: str) -> None:
    """A rule on rows: its SQL counts the population and what is unexpected in it."""
    least = float(rule.kwargs.get("mostly", 1.0))
    sql = f"""SELECT '{rule.id}' AS rule, n AS element_count, u AS unexpected_count, CASE WHEN n = 0 THEN true ELSE 1 - u::DOUBLE / n >= {least} END AS success
FROM (SELECT count(*) FILTER (WHERE {population}) AS n, count(*) FILTER (WHERE ({population}) AND coalesce({unexpected}, false)) AS u FROM {frame_sql(on)})"""
    _add(name, on, rule, sql)


def any_rule(name: str, on: str, rule: Rule, elements: str, unexpected: str, success: str | None = None, context=None) -> None:
    """Any other rule: SQL for its counts, each a scalar over the frame t."""
    least = float(rule.kwargs.get("mostly", 1.0))
    sql = f"""WITH t AS (SELECT * FROM {frame_sql(on)})
SELECT '{rule.id}' AS rule, n AS element_count, u AS unexpected_count, {success or f"CASE WHEN n = 0 THEN true ELSE 1 - u::DOUBLE / n >= {least} END"} AS success
FROM (SELECT ({elements})::BIGINT AS n, ({unexpected})::BIGINT AS u)"""
    _add(name, on, rule, sql, context)


def _add(name: str, on: str, rule: Rule, sql: str, context=None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        around = Context({n: tables(spark, sf_dir, n)[n] for n in context}) if context else None
        return verdicts(frame(spark, sf_dir, on), [rule], around).select("rule", "element_count", "unexpected_count", "success")

    QUERIES[name], ORACLE_SQL[name] = run, sql
    ROW_RULES.append((on, rule))


ROW_RULES: list[tuple[str, Rule]] = []

row_rule("rule_not_null", "lines", Rule("values_to_not_be_null", "l_discount", {"mostly": 0.8}), "true", "l_discount IS NULL")
row_rule("rule_not_null_conditional", "lines", Rule("values_to_not_be_null", "flag", row_condition="status = 'F'"), "status = 'F'", "flag IS NULL")
row_rule("rule_null", "lines", Rule("values_to_be_null", "flag"), "true", "flag IS NOT NULL")
row_rule("rule_in_set", "lines", Rule("values_to_be_in_set", "flag", {"value_set": ("N", "A"), "mostly": 0.5}), "flag IS NOT NULL", "flag NOT IN ('N', 'A')")
row_rule("rule_accepted_values", "sales", Rule("values_to_be_in_set", "status", {"value_set": ("O", "F", "P")}), "status IS NOT NULL", "status NOT IN ('O', 'F', 'P')")
row_rule("rule_not_in_set", "lines", Rule("values_to_not_be_in_set", "flag", {"value_set": ("R",)}), "flag IS NOT NULL", "flag IN ('R')")
row_rule("rule_between", "lines", Rule("values_to_be_between", "l_quantity", {"min_value": 5, "max_value": 45, "mostly": 0.75}), "l_quantity IS NOT NULL", "l_quantity < 5 OR l_quantity > 45")
row_rule("rule_between_strict", "lines", Rule("values_to_be_between", "l_quantity", {"min_value": 1, "max_value": 50, "strict_min": True, "strict_max": True}), "l_quantity IS NOT NULL", "l_quantity <= 1 OR l_quantity >= 50")
row_rule("rule_between_text", "sales", Rule("values_to_be_between", "amount", {"min_value": 0, "max_value": 500}), "amount IS NOT NULL", "try_cast(amount AS DOUBLE) > 500")
row_rule("rule_match_regex", "sales", Rule("values_to_match_regex", "code", {"regex": "^[OF]-[0-9]*7"}), "code IS NOT NULL", "NOT regexp_matches(code, '^[OF]-[0-9]*7')")
row_rule("rule_not_match_regex", "sales", Rule("values_to_not_match_regex", "code", {"regex": "77"}), "code IS NOT NULL", "regexp_matches(code, '77')")
row_rule("rule_match_regex_list", "sales", Rule("values_to_match_regex_list", "code", {"regex_list": ("^O", "9$"), "match_on": "any"}), "code IS NOT NULL", "NOT (regexp_matches(code, '^O') OR regexp_matches(code, '9$'))")
row_rule("rule_match_regex_all", "sales", Rule("values_to_match_regex_list", "code", {"regex_list": ("^O", "9$"), "match_on": "all"}), "code IS NOT NULL", "NOT (regexp_matches(code, '^O') AND regexp_matches(code, '9$'))")
row_rule("rule_not_match_regex_list", "sales", Rule("values_to_not_match_regex_list", "code", {"regex_list": ("^P", "00$")}), "code IS NOT NULL", "regexp_matches(code, '^P') OR regexp_matches(code, '00$')")
row_rule("rule_lengths_between", "sales", Rule("value_lengths_to_be_between", "code", {"min_value": 4, "max_value": 5}), "code IS NOT NULL", "length(code) < 4 OR length(code) > 5")
row_rule("rule_lengths_equal", "sales", Rule("value_lengths_to_equal", "code", {"value": 5, "mostly": 0.5}), "code IS NOT NULL", "length(code) <> 5")
row_rule("rule_strftime", "sales", Rule("values_to_match_strftime_format", "day", {"strftime_format": "%m/%d/%Y", "mostly": 0.8}), "day IS NOT NULL", "try_strptime(day, '%m/%d/%Y') IS NULL")
row_rule("rule_cast", "sales", Rule("values_to_cast_to_type", "amount", {"type": "INTEGER"}), "amount IS NOT NULL", "amount <> '' AND NOT regexp_full_match(amount, '[+-]?\\d+')")
row_rule("rule_cast_date", "sales", Rule("values_to_cast_to_type", "day", {"type": "DATE", "format": "MM/DD/YYYY"}), "day IS NOT NULL", "try_strptime(day, '%m/%d/%Y') IS NULL")
row_rule("rule_pair_greater", "lines", Rule("pair_values_a_to_be_greater_than_b", kwargs={"column_A": "l_discount", "column_B": "l_tax", "or_equal": True}), "l_discount IS NOT NULL AND l_tax IS NOT NULL", "NOT (l_discount >= l_tax)")
row_rule("rule_pair_equal", "lines", Rule("pair_values_to_be_equal", kwargs={"column_A": "flag", "column_B": "status", "ignore_row_if": "either_value_is_missing"}), "flag IS NOT NULL AND status IS NOT NULL", "flag IS DISTINCT FROM status")
row_rule("rule_current_year", "sales", Rule("date_to_be_in_current_year", "o_orderdate"), "o_orderdate IS NOT NULL", "year(o_orderdate) <> year(current_date)")
row_rule("rule_domain_type", "sales", Rule("values_to_match_domain_type", "code", {"regex": "[OFP]-[0-9]{1,3}$", "length": (3, 4)}), "code IS NOT NULL", "NOT regexp_full_match(code, '[OFP]-[0-9]{1,3}') OR length(code) < 3 OR length(code) > 4")
row_rule("rule_json_parseable", "clicks", Rule("values_to_be_json_parseable", "props", {"mostly": 0.9}), "props IS NOT NULL", "NOT json_valid(props)")
row_rule("rule_json_schema", "clicks", Rule("values_to_match_json_schema", "props", {"required": {"k": "bigint"}}), "props IS NOT NULL", "NOT json_valid(props) OR try_cast(json_extract_string(CASE WHEN json_valid(props) THEN props END, '$.k') AS BIGINT) IS NULL")
row_rule("rule_dateutil", "sales", Rule("values_to_be_dateutil_parseable", "day"), "day IS NOT NULL", "try_strptime(day, '%m/%d/%Y') IS NULL")
row_rule("rule_unique_within_record", "lines", Rule("select_column_values_to_be_unique_within_record", kwargs={"column_list": ("flag", "status"), "ignore_row_if": "any_value_is_missing"}), "flag IS NOT NULL AND status IS NOT NULL", "flag = status")
row_rule("rule_pending", "lines", Rule("validation_rule_pending_implementation"), "false", "false")

_DUP = "SELECT coalesce(sum({what}), 0) FROM (SELECT count(*) AS n FROM t WHERE {where} GROUP BY {by})"
for _n, _on, _rule, _by, _where in (
    ("rule_unique", "sales", Rule("values_to_be_unique", "o_custkey"), "o_custkey", "o_custkey IS NOT NULL"),
    ("rule_unique_key", "sales", Rule("values_to_be_unique", "o_orderkey"), "o_orderkey", "o_orderkey IS NOT NULL"),
    ("rule_compound_unique", "lines", Rule("compound_columns_to_be_unique", kwargs={"column_list": ("l_orderkey", "l_linenumber"), "mostly": 0.5}), "l_orderkey, l_linenumber", "true"),
    ("rule_compound_unique_ignoring", "clicks", Rule("compound_columns_to_be_unique", kwargs={"column_list": ("user_id", "event_type"), "ignore_row_if": "any_value_is_missing"}), "user_id, event_type", "user_id IS NOT NULL AND event_type IS NOT NULL"),
):
    any_rule(_n, _on, _rule, _DUP.format(what="n", where=_where, by=_by), _DUP.format(what="CASE WHEN n > 1 THEN n ELSE 0 END", where=_where, by=_by))

any_rule("rule_distinct_in_set", "lines", Rule("distinct_values_to_be_in_set", "flag", {"value_set": ("N", "R")}), "SELECT count(DISTINCT flag) FROM t", "SELECT count(DISTINCT flag) FILTER (WHERE flag NOT IN ('N', 'R')) FROM t", "u = 0")
any_rule("rule_distinct_contain", "lines", Rule("distinct_values_to_contain_set", "flag", {"value_set": ("N", "X")}), "2", "SELECT 2 - count(DISTINCT flag) FILTER (WHERE flag IN ('N', 'X')) FROM t", "u = 0")
any_rule("rule_most_common", "sales", Rule("most_common_value_to_be_in_set", "status", {"value_set": ("P",)}), "SELECT count(*) FROM (SELECT status FROM t WHERE status IS NOT NULL GROUP BY 1 HAVING count(*) = (SELECT max(c) FROM (SELECT count(*) c FROM t WHERE status IS NOT NULL GROUP BY status)))", "SELECT CASE WHEN bool_or(status = 'P') THEN 0 ELSE count(*) END FROM (SELECT status FROM t WHERE status IS NOT NULL GROUP BY 1 HAVING count(*) = (SELECT max(c) FROM (SELECT count(*) c FROM t WHERE status IS NOT NULL GROUP BY status)))", "u = 0")
any_rule("rule_increasing", "clicks", Rule("values_to_be_increasing", "value", {"order_by": ("event_id",)}), "SELECT count(*) FROM t WHERE value IS NOT NULL", "SELECT count(*) FILTER (WHERE value < p) FROM (SELECT value, lag(value) OVER (ORDER BY event_id) p FROM t WHERE value IS NOT NULL)")
any_rule("rule_increasing_key", "sales", Rule("values_to_be_increasing", "o_orderkey", {"order_by": ("o_orderkey",), "strictly": True}), "SELECT count(o_orderkey) FROM t", "SELECT 0")
any_rule("rule_decreasing", "clicks", Rule("values_to_be_decreasing", "value", {"order_by": ("event_id",), "partition_by": ("event_type",)}), "SELECT count(*) FROM t WHERE value IS NOT NULL", "SELECT count(*) FILTER (WHERE value > p) FROM (SELECT value, lag(value) OVER (PARTITION BY event_type ORDER BY event_id) p FROM t WHERE value IS NOT NULL)")
any_rule("rule_count_equals_other", "sales", Rule("table_row_count_to_equal_other_table", kwargs={"other_table_name": "customer"}), "1", "SELECT CASE WHEN (SELECT count(*) FROM t) = (SELECT count(*) FROM customer) THEN 0 ELSE 1 END", None, ("customer",))
any_rule("rule_complete_periods", "sales", Rule("date_column_to_have_complete_periods", "o_orderdate", {"unit": "month"}), "1", "SELECT CASE WHEN count(DISTINCT date_trunc('month', o_orderdate)) = date_diff('month', min(o_orderdate), max(o_orderdate)) + 1 THEN 0 ELSE 1 END FROM t", "u = 0")
any_rule("rule_foreign_key", "lines", Rule("foreign_key_to_exist", "l_orderkey", {"table": "orders", "parent_column": "o_orderkey"}), "SELECT count(l_orderkey) FROM t", "SELECT count(*) FROM t WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)", None, ("orders",))
any_rule("rule_column_count", "lines", Rule("table_column_count_to_equal", kwargs={"value": 10}), "1", "0")
any_rule("rule_columns_ordered", "clicks", Rule("table_columns_to_match_ordered_list", kwargs={"column_list": ("event_id", "user_id", "event_type", "value", "props", "ts")}), "1", "0")
any_rule("rule_columns_set", "clicks", Rule("table_columns_to_match_set", kwargs={"column_set": ("event_id", "missing"), "exact_match": False}), "1", "1")
any_rule("rule_of_type", "lines", Rule("values_to_be_of_type", "l_quantity", {"type_": "double"}), "1", "0")
any_rule("rule_in_type_list", "lines", Rule("values_to_be_in_type_list", "l_quantity", {"type_list": ("int", "string")}), "1", "1")
any_rule("rule_unknown_fails", "lines", Rule("no_such_rule"), "0", "0", "false")


def value_rule(name: str, on: str, rule: Rule, value: str) -> None:
    low, high = rule.kwargs.get("min_value"), rule.kwargs.get("max_value")
    ok = " AND ".join([*([f"v >= {low}"] if low is not None else []), *([f"v <= {high}"] if high is not None else [])])
    any_rule(name, on, rule, "1", f"SELECT CASE WHEN {ok} THEN 0 ELSE 1 END FROM (SELECT {value} AS v FROM t)", "u = 0")


value_rule("rule_row_count", "lines", Rule("table_row_count_to_be_between", kwargs={"min_value": 1, "max_value": 10**12}), "count(*)")
value_rule("rule_min", "lines", Rule("column_min_to_be_between", "l_quantity", {"min_value": 0, "max_value": 1}), "min(l_quantity)")
value_rule("rule_max", "lines", Rule("column_max_to_be_between", "l_quantity", {"min_value": 0, "max_value": 49}), "max(l_quantity)")
value_rule("rule_mean", "lines", Rule("column_mean_to_be_between", "l_quantity", {"min_value": 20, "max_value": 30}), "avg(l_quantity)")
value_rule("rule_median", "lines", Rule("column_median_to_be_between", "l_quantity", {"exact": True, "min_value": 20, "max_value": 30}), "quantile_cont(l_quantity, 0.5)")
value_rule("rule_stdev", "lines", Rule("column_stdev_to_be_between", "l_quantity", {"min_value": 0, "max_value": 1}), "stddev_samp(l_quantity)")
value_rule("rule_sum", "lines", Rule("column_sum_to_be_between", "l_quantity", {"min_value": 1}), "sum(l_quantity)")
value_rule("rule_non_null_share", "lines", Rule("column_proportion_of_non_null_values_to_be_between", "l_discount", {"min_value": 0.95}), "count(l_discount) / count(*)")
value_rule("rule_unique_count", "lines", Rule("column_unique_value_count_to_be_between", "flag", {"min_value": 2, "max_value": 2}), "count(DISTINCT flag)")
value_rule("rule_unique_share", "sales", Rule("column_proportion_of_unique_values_to_be_between", "o_custkey", {"min_value": 0.99}), "count(DISTINCT o_custkey) / count(o_custkey)")
value_rule("rule_quantile", "lines", Rule("column_quantile_values_to_be_between", "l_quantity", {"exact": True, "quantile": 0.9, "min_value": 40, "max_value": 50}), "quantile_cont(l_quantity, 0.9)")
value_rule("rule_skewness", "lines", Rule("column_skewness_to_be_between", "l_quantity", {"min_value": -1, "max_value": 1}), "skewness(l_quantity)")

_P = {"O": 0.4, "F": 0.4, "P": 0.2}
any_rule("rule_kl_divergence", "sales", Rule("kl_divergence_to_be_less_than", "status", {"partition": _P, "threshold": 0.05}), "1",
    "SELECT CASE WHEN sum(p * ln(p / q)) <= 0.05 THEN 0 ELSE 1 END FROM (SELECT status, count(*) / (SELECT count(*) FROM t) AS p FROM t GROUP BY 1) JOIN (VALUES ('O', 0.4), ('F', 0.4), ('P', 0.2)) v(status, q) USING (status)", "u = 0")


def embedding_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on arrays: length with finite elements, and the advisory on dimensions, over embeddings with holes."""
    df = tables(spark, sf_dir, "embeddings")["embeddings"]
    bad = F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 10)).when(F.col("vec_id") % 10 == 1, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float")))).when(F.col("vec_id") % 10 != 2, F.col("embedding"))
    rules = [Rule("value_lengths_to_equal", "embedding", {"value": 64}), Rule("value_lengths_to_be_between", "embedding", {"min_value": 16, "max_value": 64}), Rule("embedding_dimension_multiple_of_16_advisory", "embedding", severity="info")]
    return verdicts(df.withColumn("embedding", bad), rules).select("rule", "element_count", "unexpected_count", "success")


QUERIES["rule_embeddings"] = embedding_rules
ORACLE_SQL["rule_embeddings"] = """WITH c AS (SELECT count(*) FILTER (WHERE vec_id % 10 <> 2) n, count(*) FILTER (WHERE vec_id % 10 IN (0, 1)) a, count(*) FILTER (WHERE vec_id % 10 = 0) b FROM embeddings)
SELECT 'value_lengths_to_equal_embedding' AS rule, n AS element_count, a AS unexpected_count, a = 0 AS success FROM c
UNION ALL SELECT 'value_lengths_to_be_between_embedding', n, b, b = 0 FROM c
UNION ALL SELECT 'embedding_dimension_multiple_of_16_advisory_embedding', n, 0, true FROM c"""


def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "labels", "documents")
    return orphans(t["labels"], "doc_id", t["documents"].selectExpr("doc_id * 2 AS d"), "d").select("doc_id", "quality")


QUERIES["fk_orphans"] = fk_orphans
ORACLE_SQL["fk_orphans"] = "SELECT doc_id, quality FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id * 2 = l.doc_id)"

#: One suite of many row rules: a single aggregation over the lines.
SUITE = [r for on, r in ROW_RULES if on == "lines" and r.type in ("values_to_not_be_null", "values_to_be_null", "values_to_be_in_set", "values_to_not_be_in_set", "values_to_be_between", "pair_values_a_to_be_greater_than_b", "pair_values_to_be_equal")]
_SEVERITIES = ("critical", "error", "warning", "info")


def _suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    rules = [replace(r, severity=_SEVERITIES[i % 4], blocking=i % 3 == 0, name=f"{i}_{r.id}") for i, r in enumerate(SUITE)]
    return verdicts(frame(spark, sf_dir, "lines"), rules)


def suite_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suite(spark, sf_dir).select("rule", "severity", "blocking", "success", "element_count", "unexpected_count", "unexpected_percent")


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_frame(_suite(spark, sf_dir))


def _suite_sql() -> str:
    parts = []
    names = {id(r): n for n, r in ((n, r) for n, (on, r) in zip(QUERIES, ROW_RULES, strict=False))}
    for i, r in enumerate(SUITE):
        inner = ORACLE_SQL[names[id(r)]]
        parts.append(f"SELECT '{i}_{r.id}' AS rule, '{_SEVERITIES[i % 4]}' AS severity, {str(i % 3 == 0).lower()} AS blocking, success, element_count, unexpected_count, CASE WHEN element_count = 0 THEN 0 ELSE round(100.0::DOUBLE * (unexpected_count::DOUBLE / element_count), 6) END AS unexpected_percent FROM ({inner})")
    return "\nUNION ALL ".join(parts)


ORACLE_SQL["suite_verdicts"] = _suite_sql()
QUERIES["suite_verdicts"] = suite_verdicts
QUERIES["quality_score"] = quality_score
_RATE = "round(coalesce(count(*) FILTER (WHERE {0} AND success) / nullif(count(*) FILTER (WHERE {0}), 0), 1.0), 6)"
ORACLE_SQL["quality_score"] = f"""SELECT count(*) AS total, count(*) FILTER (WHERE success) AS passed, {_RATE.format("true")} AS success_rate, {_RATE.format("severity IN ('critical', 'error')")} AS critical_rate,
{_RATE.format("severity = 'warning'")} AS warning_rate, {_RATE.format("severity = 'info'")} AS info_rate, count(*) FILTER (WHERE blocking AND NOT success) AS blocking_failures FROM ({ORACLE_SQL["suite_verdicts"]})"""
