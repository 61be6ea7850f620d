"""Rules as expressions, and their evaluation in few jobs.

A row rule is a population and a test of each of its rows; all row rules of a suite become one aggregation, with two counts
each. Aggregate rules join the same aggregation as values with bounds. Rules on schemas need no job. Only rules on groups
(uniqueness, distinct values, order, other tables) run apart, by aggregations that combine in the map tasks. A rule that is
unknown or cannot be evaluated fails; it is never passed over.

Every verdict has element_count, unexpected_count and unexpected_percent; a rule holds if the share of expected elements is at
least `mostly` (1 by default). NULLs are no part of a population, but in rules on NULLs. An empty population holds.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspec.functions import casts, formats
from loomspec.spec import Column as ColumnSpec
from loomspec.spec import Rule, SpecError

SAMPLES = 10
#: Rules that need only raw text, rules that need typed values, and rules that a schema makes needless.
RAW_RULES = ("table_columns_to_match_set", "table_row_count_to_be_between", "value_lengths_to_be_between", "value_lengths_to_equal", "values_to_match_regex", "values_to_not_match_regex", "values_to_match_regex_list", "values_to_cast_to_type", "values_to_not_be_null", "values_to_be_null", "values_to_match_strftime_format", "values_to_be_in_set", "values_to_not_be_in_set", "distinct_values_to_be_in_set", "distinct_values_to_contain_set", "most_common_value_to_be_in_set", "values_to_be_unique", "compound_columns_to_be_unique", "select_column_values_to_be_unique_within_record")
TYPED_RULES = ("values_to_be_between", "embedding_dimension_multiple_of_16_advisory", "pair_values_a_to_be_greater_than_b", "pair_values_to_be_equal", "validation_rule_pending_implementation", "date_column_to_have_complete_periods", "row_count_change_within_percent", "column_distribution_stable", "record_changes_within_limits")
REDUNDANT = ("column_to_exist", "values_to_be_of_type")


@dataclass
class Context:
    """What rules may need beside the frame: other tables, a baseline, the order of rows."""

    tables: dict[str, DataFrame]
    baseline: dict[str, Any] | None = None


def _c(rule: Rule) -> Column:
    return F.col(f"`{rule.column}`")


def _between(x: Column, low, high, strict_low: bool = False, strict_high: bool = False) -> Column:
    """Whether x is outside the bounds; NULL is not."""
    out = F.lit(False)
    if low is not None:
        out = out | ((x <= low) if strict_low else (x < low))
    if high is not None:
        out = out | ((x >= high) if strict_high else (x > high))
    return F.coalesce(out, F.lit(False))


def _values_between(rule: Rule) -> Column:
    k = rule.kwargs
    low, high = k.get("min_value"), k.get("max_value")
    numeric = any(isinstance(v, int | float) and not isinstance(v, bool) for v in (low, high))
    x = _c(rule).try_cast("double") if numeric else _c(rule)
    bound = lambda v: None if v is None else F.lit(v)
    return _between(x, bound(low), bound(high), k.get("strict_min", False), k.get("strict_max", False))


def _length(df: DataFrame, rule: Rule) -> Column:
    return F.size(_c(rule)) if isinstance(df.schema[rule.column].dataType, T.ArrayType) else F.length(_c(rule).cast("string"))


def _length_equal(df: DataFrame, rule: Rule) -> Column:
    wrong = _length(df, rule) != rule.kwargs["value"]
    kind = df.schema[rule.column].dataType
    if isinstance(kind, T.ArrayType):
        number = isinstance(kind.elementType, T.FloatType | T.DoubleType)
        wrong = wrong | F.exists(_c(rule), lambda x: x.isNull() | F.isnan(x) if number else x.isNull())
    return wrong


def _casts_wrong(df: DataFrame, rule: Rule) -> Column:
    if not isinstance(df.schema[rule.column].dataType, T.StringType):
        return F.lit(False)
    k = rule.kwargs
    to = ColumnSpec(rule.column, k["type"], precision=k.get("precision"), scale=k.get("scale"), format=k.get("format"))
    blank = F.trim(_c(rule)) == ""
    return ~blank & casts.cast_column(_c(rule), to, fallbacks=tuple(k.get("fallback_formats", ()))).isNull()


def _pair(rule: Rule) -> tuple[Column, Column]:
    return F.col(rule.kwargs["column_A"]), F.col(rule.kwargs["column_B"])


def _ignored(columns: list[Column], how: str) -> Column:
    """Which rows count, by ignore_row_if."""
    missing = [c.isNull() for c in columns]
    any_, all_ = missing[0], missing[0]
    for m in missing[1:]:
        any_, all_ = any_ | m, all_ & m
    if how in ("any_value_is_missing", "either_value_is_missing"):
        return ~any_
    if how in ("all_values_are_missing", "both_values_are_missing"):
        return ~all_
    return F.lit(True)


def _domain(rule: Rule) -> Column:
    """Whether the value fails every form that its domain allows; patterns match from the start."""
    from loomspec.functions.domains import DOMAINS

    k = DOMAINS[rule.kwargs["domain_type"]] if "domain_type" in rule.kwargs else rule.kwargs
    x, wrong = _c(rule).cast("string"), F.lit(False)
    if k.get("regex"):
        wrong = wrong | ~x.rlike(f"^(?:{k['regex']})")
    if k.get("values"):
        wrong = wrong | ~x.isin(list(k["values"]))
    if k.get("length"):
        wrong = wrong | _between(F.length(x), *(F.lit(v) if v is not None else None for v in k["length"]))
    if k.get("range"):
        wrong = wrong | _between(x.try_cast("double"), *(F.lit(v) if v is not None else None for v in k["range"]))
    return wrong


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


_REGEXES = lambda r: [_c(r).cast("string").rlike(x) for x in r.kwargs["regex_list"]]
_PARSERS = lambda r: [casts.parsed(F.trim(_c(r)), p) for p in formats.COMMON_TIMESTAMPS + formats.DATE_PATTERNS]

#: rule type -> what makes a non-NULL value unexpected
ROW: dict[str, Callable[[DataFrame, Rule], Column]] = {
    "values_to_be_in_set": lambda df, r: ~_c(r).isin(list(r.kwargs["value_set"])),
    "values_to_not_be_in_set": lambda df, r: _c(r).isin(list(r.kwargs["value_set"])),
    "values_to_be_between": lambda df, r: _values_between(r),
    "values_to_match_regex": lambda df, r: ~_c(r).cast("string").rlike(r.kwargs["regex"]),
    "values_to_not_match_regex": lambda df, r: _c(r).cast("string").rlike(r.kwargs["regex"]),
    "values_to_match_regex_list": lambda df, r: ~(_any if r.kwargs.get("match_on", "any") == "any" else _all)(_REGEXES(r)),
    "values_to_not_match_regex_list": lambda df, r: _any(_REGEXES(r)),
    "value_lengths_to_be_between": lambda df, r: _between(_length(df, r), *(F.lit(r.kwargs[k]) if r.kwargs.get(k) is not None else None for k in ("min_value", "max_value"))),
    "value_lengths_to_equal": _length_equal,
    "values_to_match_strftime_format": lambda df, r: F.try_to_timestamp(_c(r).cast("string"), F.lit(formats.strftime_to_java(r.kwargs["strftime_format"]))).isNull(),
    "values_to_cast_to_type": _casts_wrong,
    "date_to_be_in_current_year": lambda df, r: F.year(_c(r)) != F.year(F.current_date()),
    "values_to_match_domain_type": lambda df, r: _domain(r),
    "values_to_be_json_parseable": lambda df, r: F.try_parse_json(_c(r)).isNull(),
    "values_to_match_json_schema": lambda df, r: F.try_parse_json(_c(r)).isNull() | _any([F.try_variant_get(F.try_parse_json(_c(r)), f"$.{p}", k).isNull() for p, k in r.kwargs["required"].items()]),
    "values_to_be_dateutil_parseable": lambda df, r: F.coalesce(*_PARSERS(r)).isNull(),
    "embedding_dimension_multiple_of_16_advisory": lambda df, r: F.lit(False),
}

#: rules on several columns: (columns, which rows count, what makes one unexpected)
RECORD: dict[str, Callable[[Rule], tuple[Column, Column]]] = {
    "pair_values_a_to_be_greater_than_b": lambda r: (_ignored(list(_pair(r)), "any_value_is_missing"), ~((_pair(r)[0] >= _pair(r)[1]) if r.kwargs.get("or_equal") else (_pair(r)[0] > _pair(r)[1]))),
    "pair_values_to_be_equal": lambda r: (_ignored(list(_pair(r)), r.kwargs.get("ignore_row_if", "neither")), ~_pair(r)[0].eqNullSafe(_pair(r)[1])),
    "select_column_values_to_be_unique_within_record": lambda r: (_ignored([F.col(c) for c in r.kwargs["column_list"]], r.kwargs.get("ignore_row_if", "never")), F.size(F.array_distinct(F.array(*(F.col(c).cast("string") for c in r.kwargs["column_list"])))) < len(r.kwargs["column_list"])),
    "values_to_not_be_null": lambda r: (F.lit(True), _c(r).isNull()),
    "values_to_be_null": lambda r: (F.lit(True), _c(r).isNotNull()),
}

#: rules on one aggregate with bounds min_value and max_value
def _quantile(rule: Rule, q: float) -> Column:
    """From a sketch of a bounded size; with exact, which holds a column's distinct values in memory, interpolated."""
    return F.percentile(_c(rule), F.lit(q)) if rule.kwargs.get("exact") else F.percentile_approx(_c(rule), F.lit(q), F.lit(10000))


VALUE: dict[str, Callable[[Rule], Column]] = {
    "table_row_count_to_be_between": lambda r: F.count("*"),
    "table_row_count_to_equal": lambda r: F.count("*"),
    "column_min_to_be_between": lambda r: F.min(_c(r)),
    "column_max_to_be_between": lambda r: F.max(_c(r)),
    "column_mean_to_be_between": lambda r: F.avg(_c(r)),
    "column_median_to_be_between": lambda r: _quantile(r, 0.5),
    "column_stdev_to_be_between": lambda r: F.stddev_samp(_c(r)),
    "column_sum_to_be_between": lambda r: F.sum(_c(r)),
    "column_proportion_of_non_null_values_to_be_between": lambda r: F.count(_c(r)) / F.greatest(F.count("*"), F.lit(1)),
    "column_unique_value_count_to_be_between": lambda r: F.count_distinct(_c(r)),
    "column_proportion_of_unique_values_to_be_between": lambda r: F.count_distinct(_c(r)) / F.greatest(F.count(_c(r)), F.lit(1)),
    "column_quantile_values_to_be_between": lambda r: _quantile(r, float(r.kwargs["quantile"])),
    "column_skewness_to_be_between": lambda r: F.skewness(_c(r)),
}

GROUPED = ("values_to_be_unique", "compound_columns_to_be_unique", "distinct_values_to_be_in_set", "distinct_values_to_contain_set", "most_common_value_to_be_in_set", "values_to_be_increasing", "values_to_be_decreasing", "table_row_count_to_equal_other_table", "kl_divergence_to_be_less_than", "date_column_to_have_complete_periods", "foreign_key_to_exist")
SCHEMA = ("table_column_count_to_equal", "table_columns_to_match_ordered_list", "table_columns_to_match_set", "values_to_be_of_type", "values_to_be_in_type_list")
BASELINE = ("row_count_change_within_percent", "column_distribution_stable", "record_changes_within_limits")
PENDING = "validation_rule_pending_implementation"

VERDICT = "rule string, type string, column string, severity string, blocking boolean, success boolean, element_count bigint, unexpected_count bigint, unexpected_percent double, observed string"


def known_rules() -> set[str]:
    return {*ROW, *RECORD, *VALUE, *GROUPED, *SCHEMA, *BASELINE, PENDING}


def short(rule: Rule) -> Rule:
    """The rule under the name used here: specifications may write expect_ or expect_column_ in front."""
    for prefix in ("expect_column_", "expect_"):
        if rule.type.startswith(prefix) and rule.type[len(prefix) :] in known_rules() | set(REDUNDANT):
            return replace(rule, type=rule.type[len(prefix) :])
    return rule


def stage(rule: Rule) -> str:
    """raw, ingested, redundant or unknown; the rule's own stage wins. Rules that either frame could serve run on the typed one."""
    rule = short(rule)
    if rule.stage:
        return rule.stage
    if rule.type in REDUNDANT:
        return "redundant"
    if rule.type in RAW_RULES:
        return "raw"
    return "ingested" if rule.type in known_rules() else "unknown"


def verdict(rule: Rule, elements: int, unexpected: int, observed: Any = None, success: bool | None = None) -> tuple:
    share = unexpected / elements if elements else 0.0
    if success is None:
        success = 1 - share >= float(rule.kwargs.get("mostly", 1.0))
    return (rule.id, rule.type, rule.column, rule.severity, rule.blocking, bool(success), int(elements), int(unexpected), round(100 * share, 6), None if observed is None else str(observed))


def row_test(df: DataFrame, rule: Rule) -> tuple[Column, Column] | None:
    """(population, unexpected) of a rule on rows, None for other rules."""
    rule = short(rule)
    if rule.type in ROW:
        population, wrong = _c(rule).isNotNull(), ROW[rule.type](df, rule)
    elif rule.type in RECORD:
        population, wrong = RECORD[rule.type](rule)
    else:
        return None
    if rule.row_condition:
        population = population & F.expr(rule.row_condition)
    population = F.coalesce(population, F.lit(False))
    return population, population & F.coalesce(wrong, F.lit(False))


def evaluate(df: DataFrame, rules: list[Rule], context: Context | None = None) -> list[tuple]:
    """Verdicts in the order of the rules. Counts of all row and aggregate rules come from one job."""
    context, rules = context or Context({}), [short(r) for r in rules]
    out: dict[int, tuple] = {}
    fused: dict[str, Column] = {}
    for i, rule in enumerate(rules):
        try:
            test = row_test(df, rule)
            if test is not None:
                df.limit(0).select(*test)  # what the analyzer rejects fails here, alone
                fused |= {f"n{i}": F.count_if(test[0]), f"u{i}": F.count_if(test[1])}
            elif rule.type in VALUE:
                value = VALUE[rule.type](rule)
                df.limit(0).agg(value)
                fused |= {f"v{i}": value}
            elif rule.type in SCHEMA:
                out[i] = _schema(df, rule)
            elif rule.type in GROUPED:
                out[i] = _grouped(df, rule, context)
            elif rule.type in BASELINE:
                out[i] = _against_baseline(df, rule, context)
            elif rule.type == PENDING:
                out[i] = verdict(rule, 0, 0, "pending", success=True)
            else:
                out[i] = verdict(rule, 0, 0, f"no such rule: {rule.type}", success=False)
        except Exception as e:  # noqa: BLE001  a rule that breaks is a failed rule, with its reason
            out[i] = verdict(rule, 0, 0, f"{type(e).__name__}: {str(e).splitlines()[0][:200]}", success=False)
    got = df.agg(*(c.alias(n) for n, c in fused.items())).first() if fused else {}
    for i, rule in enumerate(rules):
        if f"n{i}" in fused:
            out[i] = verdict(rule, got[f"n{i}"], got[f"u{i}"], got[f"u{i}"], success=True if rule.type.endswith("_advisory") else None)
        elif f"v{i}" in fused:
            out[i] = _bounded(rule, got[f"v{i}"])
    return [out[i] for i in range(len(rules))]


def verdicts(df: DataFrame, rules: list[Rule], context: Context | None = None) -> DataFrame:
    return df.sparkSession.createDataFrame(evaluate(df, rules, context), VERDICT)


def unexpected_rows(df: DataFrame, rule: Rule, limit: int | None = SAMPLES) -> DataFrame:
    """The rows that a rule on rows does not expect; a sample by default."""
    test = row_test(df, rule)
    if test is None:
        raise SpecError(f"{rule.type} is no rule on rows")
    out = df.where(test[1])
    return out if limit is None else out.limit(limit)


def _bounded(rule: Rule, value: Any) -> tuple:
    k = rule.kwargs
    low, high = (k["value"], k["value"]) if "value" in k else (k.get("min_value"), k.get("max_value"))
    ok = value is not None and (low is None or value >= low) and (high is None or value <= high)
    return verdict(rule, 1, 0 if ok else 1, value, success=ok)


def _schema(df: DataFrame, rule: Rule) -> tuple:
    k = rule.kwargs
    if rule.type == "table_column_count_to_equal":
        return verdict(rule, 1, int(len(df.columns) != k["value"]), len(df.columns))
    if rule.type == "table_columns_to_match_ordered_list":
        return verdict(rule, 1, int(df.columns != list(k["column_list"])), df.columns)
    if rule.type == "table_columns_to_match_set":
        extra = set(df.columns) - set(k["column_set"]) if k.get("exact_match", True) else set()
        missing = set(k["column_set"]) - set(df.columns)
        return verdict(rule, 1, int(bool(extra or missing)), sorted(extra | missing))
    kind = df.schema[rule.column].dataType
    names = {kind.simpleString().lower(), kind.typeName().lower(), type(kind).__name__.lower()}
    wanted = k["type_list"] if rule.type == "values_to_be_in_type_list" else [k["type_"]]
    return verdict(rule, 1, int(not names & {w.lower() for w in wanted}), kind.simpleString())


def duplicates(df: DataFrame, columns: list[str], ignore: str = "never") -> DataFrame:
    """One row: (elements, unexpected): all members of groups of more than one count as unexpected."""
    rows = df.where(_ignored([F.col(f"`{c}`") for c in columns], ignore))
    groups = rows.groupBy(*(F.col(f"`{c}`") for c in columns)).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("elements"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)), F.lit(0)).alias("unexpected"))


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows of child whose key no parent has; NULL keys are no orphans."""
    keys = parent.select(F.col(parent_column).alias("__parent")).distinct()
    return child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("__parent"), "left_anti")


def out_of_order(df: DataFrame, column: str, order_by: list[str], decreasing: bool = False, strictly: bool = False, partition_by: list[str] | None = None) -> DataFrame:
    """(elements, unexpected) against the value before, in an explicit order. Without partition_by the order is one of the whole
    table: values are compared within ranges of it, and the ranges' ends with each other, so no task gets all rows."""
    x = F.col(column)

    def wrong(before: Column) -> Column:
        ok = (x < before if strictly else x <= before) if decreasing else (x > before if strictly else x >= before)
        return F.coalesce(~ok, F.lit(False))

    rows = df.where(x.isNotNull())
    if partition_by:
        w = Window.partitionBy(*partition_by).orderBy(*order_by)
        return rows.select(wrong(F.lag(x).over(w)).alias("w")).agg(F.count("*").alias("elements"), F.count_if("w").alias("unexpected"))
    ranged = rows.repartitionByRange(*order_by).withColumn("__part", F.spark_partition_id())
    w = Window.partitionBy("__part").orderBy(*order_by)
    inner = ranged.select("__part", x, wrong(F.lag(x).over(w)).alias("w"))
    parts = ranged.groupBy("__part").agg(F.min_by(x, F.struct(*order_by)).alias("first"), F.max_by(x, F.struct(*order_by)).alias("last"))
    edges = parts.withColumn("before", F.lag("last").over(Window.orderBy("__part")))  # one row for each range
    x = F.col("first")
    return inner.agg(F.count("*").alias("elements"), F.count_if("w").alias("a")).crossJoin(edges.agg(F.count_if(wrong(F.col("before"))).alias("b"))).select("elements", (F.col("a") + F.col("b")).alias("unexpected"))


def periods(df: DataFrame, column: str, unit: str) -> DataFrame:
    """The periods (month, day, ...) from the first to the last that no row falls in."""
    cut = F.date_trunc(unit, F.col(column))
    there = df.select(cut.alias("period")).where("period IS NOT NULL").distinct()
    ends = there.agg(F.min("period").alias("a"), F.max("period").alias("b"))
    wanted = ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval 1 {unit}"))).alias("period"))
    return wanted.join(there, "period", "left_anti")


def _grouped(df: DataFrame, rule: Rule, context: Context) -> tuple:
    k = rule.kwargs
    if rule.type in ("values_to_be_unique", "compound_columns_to_be_unique"):
        columns = [rule.column] if rule.column else list(k["column_list"])
        got = duplicates(df, columns, "all_values_are_missing" if rule.column else k.get("ignore_row_if", "never")).first()
        return verdict(rule, got["elements"], got["unexpected"], got["unexpected"])
    if rule.type == "distinct_values_to_be_in_set":
        got = df.select(_c(rule).alias("v")).where("v IS NOT NULL").distinct().agg(F.count("*"), F.count_if(~F.col("v").isin(list(k["value_set"])))).first()
        return verdict(rule, got[0], got[1], got[1], success=got[1] == 0)
    if rule.type == "distinct_values_to_contain_set":
        there = df.where(_c(rule).isin(list(k["value_set"]))).agg(F.count_distinct(_c(rule))).first()[0]
        missing = len(set(k["value_set"])) - there
        return verdict(rule, len(set(k["value_set"])), missing, missing, success=missing == 0)
    if rule.type == "most_common_value_to_be_in_set":
        counts = df.where(_c(rule).isNotNull()).groupBy(_c(rule).alias("v")).count()
        most = counts.agg(F.max("count")).first()[0]
        if most is None:
            return verdict(rule, 0, 0, [], success=True)
        # all ties are counted, some of them are named
        tied = counts.where(F.col("count") == most)
        n, known = tied.agg(F.count("*"), F.count_if(F.col("v").isin(list(k["value_set"])))).first()
        ok = known == n if k.get("ties_okay") is False else known > 0
        return verdict(rule, n, 0 if ok else n, [str(x["v"]) for x in tied.orderBy("v").limit(1000).collect()], success=ok)
    if rule.type in ("values_to_be_increasing", "values_to_be_decreasing"):
        got = out_of_order(df, rule.column, list(k["order_by"]), rule.type.endswith("decreasing"), k.get("strictly", False), k.get("partition_by")).first()
        return verdict(rule, got["elements"], got["unexpected"], got["unexpected"])
    if rule.type == "table_row_count_to_equal_other_table":
        a, b = df.count(), context.tables[k["other_table_name"]].count()
        return verdict(rule, 1, int(a != b), f"{a}, {b}")
    if rule.type == "kl_divergence_to_be_less_than":
        from loomspec.operators.drift import kl_divergence

        value = kl_divergence(df, rule.column, dict(k["partition"])).first()[0]
        return verdict(rule, 1, int(value is None or value > k["threshold"]), value)
    if rule.type == "date_column_to_have_complete_periods":
        n = periods(df, rule.column, k.get("unit", "month")).count()
        return verdict(rule, 1, int(n > 0), n)
    n = orphans(df, rule.column, context.tables[k["table"]], k["parent_column"]).count()
    return verdict(rule, df.where(_c(rule).isNotNull()).count(), n, n)


def _against_baseline(df: DataFrame, rule: Rule, context: Context) -> tuple:
    """Against a stored baseline; the first run, without one, holds."""
    from loomspec.operators import drift

    k, base = rule.kwargs, context.baseline
    if not base:
        return verdict(rule, 0, 0, "no baseline", success=True)
    if rule.type == "row_count_change_within_percent":
        change = drift.row_count_change(base["row_count"], df.count())
        return verdict(rule, 1, int(abs(change["percent"]) > k.get("percent", 20.0)), json.dumps(change))
    if rule.type == "column_distribution_stable":
        value = drift.smoothed_js(base["frequencies"].where(F.col("column") == rule.column), drift.frequencies(df, [rule.column])).first()["js"]
        return verdict(rule, 1, int(value > k.get("threshold", 0.1)), value)
    got = {x["status"]: x["n"] for x in drift.record_changes(base["records"], drift.record_digests(df, list(k["primary_key"])), list(k["primary_key"])).collect()}
    total = max(1, sum(got.values()) - got.get("added", 0))
    over = [s for s in ("added", "removed", "modified") if 100 * got.get(s, 0) / total > k.get(f"max_{s}_percent", 100.0)]
    return verdict(rule, 1, int(bool(over)), json.dumps(got, sort_keys=True))
