from loomspec.operators import rules as Q
from loomspec.operators import suite as S
from loomspec.spec import Column, Rule, TableDefinition


def frame(spark):
    return spark.createDataFrame([(1, "a", 5.0), (2, None, 15.0), (2, "b", None), (None, "", 7.0)], "id int, s string, x double")


def test_counts_and_mostly(spark):
    found = Q.evaluate(frame(spark), [Rule("values_to_not_be_null", "s"), Rule("values_to_not_be_null", "s", {"mostly": 0.7}), Rule("values_to_be_between", "x", {"min_value": 6}), Rule("values_to_be_unique", "id"), Rule("expect_column_values_to_be_in_set", "s", {"value_set": ("a", "b")})])
    assert [(v[5], v[6], v[7]) for v in found] == [(False, 4, 1), (True, 4, 1), (False, 3, 1), (False, 3, 2), (False, 3, 1)]


def test_empty_population_holds(spark):
    found = Q.evaluate(frame(spark).limit(0), [Rule("values_to_match_regex", "s", {"regex": "z"}), Rule("values_to_be_unique", "id")])
    assert all(v[5] for v in found)


def test_unknown_and_broken_rules_fail(spark):
    found = Q.evaluate(frame(spark), [Rule("no_such"), Rule("values_to_not_be_null", "missing"), Rule("values_to_not_be_null", "id", row_condition="nope > 1")])
    assert not any(v[5] for v in found) and found[0][9] == "no such rule: no_such"


def test_row_rules_are_one_job(spark):
    tracker, group = spark.sparkContext.statusTracker(), "one-job"
    rules = [Rule("values_to_not_be_null", c, name=f"{c}{i}") for c in ("id", "s", "x") for i in range(5)]
    spark.sparkContext.setJobGroup(group, "rules")
    Q.evaluate(frame(spark), rules)
    spark.sparkContext._jsc.clearJobGroup()
    assert len(tracker.getJobIdsForGroup(group)) <= 2  # an aggregation and its single final stage


def test_stages():
    assert [Q.stage(Rule(t)) for t in ("values_to_match_regex", "values_to_be_between", "column_to_exist", "whatever", "column_mean_to_be_between")] == ["raw", "ingested", "redundant", "unknown", "ingested"]


def test_order_over_ranges(spark):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id IN (100, 500, 777) THEN 0 ELSE id END AS v")
    got = Q.out_of_order(df, "v", ["id"]).first()
    assert (got["elements"], got["unexpected"]) == (1000, 3)


def test_generated_suite_and_gate(spark):
    spec = TableDefinition("t", (Column("id", "INTEGER", nullable=False), Column("s", length=1), Column("start_day", "DATE"), Column("end_day", "DATE")), ("id",))
    kinds = [r.type for r in S.baseline_rules(spec)]
    assert "pair_values_a_to_be_greater_than_b" in kinds and "compound_columns_to_be_unique" in kinds and "value_lengths_to_be_between" in kinds
    assert "value_lengths_to_be_between" not in [r.type for r in S.baseline_rules(spec, typed_raw=True)]
    found = Q.evaluate(frame(spark), [Rule("values_to_not_be_null", "id", severity="critical", blocking=True), Rule("values_to_not_be_null", "x", severity="info")])
    assert S.gate(found) == ["blocking rule values_to_not_be_null_id failed"]
    assert S.quality_score(found).success_rate == 0 and S.gate(found, S.Thresholds(success_rate=0.5))[-1].startswith("success_rate")


def test_enforcement(spark, rows):
    good, bad = S.enforce(frame(spark), [Rule("values_to_not_be_null", "x", severity="error"), Rule("values_to_not_be_null", "s", severity="info")])
    assert len(rows(good)) == 3 and [r["broken_rules"] for r in bad.collect()] == [["values_to_not_be_null_x"]]


def test_rules_from_a_profile_hold_on_its_data(spark):
    from loomspec.operators.profile import profile

    df = spark.range(200).selectExpr("id", "concat('AB-', lpad(cast(id AS string), 3, '0')) AS code", "id * 1.5D AS x", "CASE WHEN id % 2 = 0 THEN 'e' ELSE 'o' END AS kind")
    found = Q.evaluate(df, S.rules_from_profile(profile(df)))
    assert len(found) > 8 and all(v[5] for v in found), [v for v in found if not v[5]]


def test_pattern_regex():
    import re

    assert re.fullmatch(S.pattern_regex("AA-NNN"), "AB-123") and re.fullmatch(S.pattern_regex("Aa+#N+"), "Customer#0001") and not re.fullmatch(S.pattern_regex("AA-NNN"), "ab-123")


def test_defaults():
    assert len(S.with_defaults([])) == 1 and not S.with_defaults([], ("skip_defaults",))
