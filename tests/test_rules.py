"""Business rules, locations and risks on small tables with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkassay.operators import locate as L
from sparkassay.operators import metrics as M
from sparkassay.operators import risks, rules as R
from sparkassay.plans.cells import Cells
from sparkassay.plans.rulebook import (
    Rule, combine_rules, field_roles, pack_id, pack_problems, regex_problems, rule_from_dict,
    rule_problems, suggest_rules,
)

REF = dt.date(2026, 7, 20)
RULES = [
    Rule("primary_key", ("record_id",)),
    Rule("required", ("name",)),
    Rule("update_freshness", ("updated_at",), {"frequency": "weekly", "max_age_days": 7}),
    Rule("allowed_values", ("status",), {"allowed_values": ["active", "inactive"]}),
    Rule("numeric_range", ("score",), {"minimum": 0, "maximum": 100}, "db31_010102"),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([
        ("1", "A", "2026-07-15", "active", "0", "a"), ("2", "", "bad", "inactive", "20", "b"),
        ("2", "C", "2026-07-30", "other-secret", "101", "c"), ("", "D", "2026-07-01", "", "", "d"),
    ], "record_id string, name string, updated_at string, status string, score string, notes string").coalesce(1)


def test_rule_values(spark, table):
    got = {r.metric_id: r for r in R.evaluate_rules(table, RULES, REF).collect()}
    short = {k.removeprefix("business_"): r.value for k, r in got.items()}
    assert short == {
        "primary_key_compliance": 0.25, "required_compliance": 0.75, "update_time_parseability": 0.75,
        "update_frequency_compliance": 0.0, "allowed_values_compliance": 0.666667,
        "numeric_range_compliance": 0.666667}
    assert '"update_lag_days":-10' in got["business_update_frequency_compliance"].evidence
    found = risks.business_risks(R.evaluate_rules(table, RULES, REF)).collect()
    assert len(found) == 6 and {r.level for r in found} == {"attention"}


def test_rule_locations(spark, table):
    got = sorted((r.issue_type, r.record_number, tuple(r.fields), tuple(r.related_record_numbers))
                 for r in R.rule_locations(table, RULES, REF).collect())
    assert got == [
        ("rule_allowed_value_violation", 3, ("status",), ()),
        ("rule_numeric_range_violation", 3, ("score",), ()),
        ("rule_primary_key_duplicate", 2, ("record_id",), (3,)),
        ("rule_primary_key_duplicate", 3, ("record_id",), (2,)),
        ("rule_primary_key_missing", 4, ("record_id",), ()),
        ("rule_required_missing", 2, ("name",), ()),
        ("rule_update_time_missing_or_invalid", 2, ("updated_at",), ()),
    ]


def test_more_rules(spark):
    df = spark.createDataFrame([
        ("active", "A", "2026-01-02", "2026-01-03", "123456"), ("inactive", "", "2026-01-04", "2026-01-03", "12345"),
        ("active", " ", "x", "2026-01-03", ""),
    ], "status string, name string, start_date string, end_date string, code string").coalesce(1)
    rules = [
        Rule("regex_format", ("code",), {"pattern": r"\d{6}"}),
        Rule("string_length", ("code",), {"minimum": 6, "maximum": 6}),
        Rule("conditional_required", ("status", "name"), {"condition_values": ["active"]}),
        Rule("field_comparison", ("start_date", "end_date"), {"operator": "lte", "comparison_type": "datetime"}),
    ]
    got = {r.metric_id: (r.value, r.checked_count) for r in R.evaluate_rules(df, rules, REF).collect()}
    assert got == {
        "business_regex_format_compliance": (0.5, 2), "business_string_length_compliance": (0.5, 2),
        "business_conditional_required_compliance": (0.5, 2),
        "business_field_comparison_compliance": (0.333333, 3)}
    kinds = sorted((r.issue_type, r.record_number) for r in R.rule_locations(df, rules[3:], REF).collect())
    assert kinds == [("rule_field_comparison_unparseable", 3), ("rule_field_comparison_violation", 2)]
    totals = R.dry_run_totals(R.dry_run(df, rules, REF)).first()
    assert (totals.checked, totals.issues, totals.issue_locations) == (9, 5, 5)
    with pytest.raises(ValueError):
        R.check_budget(R.dry_run(df, rules, REF), rules, 3, max_locations=4)
    with pytest.raises(ValueError):
        R.check_budget(R.dry_run(df, rules, REF), rules, 3, max_cells=17)
    R.check_budget(R.dry_run(df, rules, REF), rules, 3, 18, 5)
    with pytest.raises(ValueError):
        R.evaluate_rules(df, [*rules, Rule("field_comparison", ("name", "code"), {"operator": "eq"})], REF)


def test_hot_key_is_salted_and_whole(spark):
    rows = [(i, 7 if i % 3 else i) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, k long").repartition(4).sortWithinPartitions("id")
    df = spark.createDataFrame(df.collect(), df.schema)
    numbered = df.withColumn("record_number", F.col("id") + 1)
    rule = Rule("primary_key", ("k",))
    want = {r.record_number: r.related_record_numbers for r in
            R.primary_key_locations(df, rule, numbered).collect()}
    got = {r.record_number: r.related_record_numbers for r in
           R.primary_key_locations(df, rule, numbered, hot_rows=50).collect()}
    members = sorted(i + 1 for i, k in rows if k == 7)
    assert got == want and sorted(got) == members
    assert got[members[0]] == [members[1]] and got[members[-1]] == [members[0]]


def test_record_numbers_follow_the_scan(spark, data):
    df = spark.read.parquet(f"{data}/lineitem.parquet", f"{data}/lineitem.parquet").select("l_orderkey")
    rows = L.with_record_number(df).collect()
    want = [(r.l_orderkey, i) for i, r in enumerate(df.collect(), 1)]
    assert sorted((r.record_number, r.l_orderkey) for r in rows) == sorted((i, k) for k, i in want)


def test_metric_locations(spark):
    df = spark.createDataFrame([
        ("A", "d1", "https://a.cn"), ("A", "d1", "https://a.cn"), ("a!", "d1", "bad"), ("", "", ""), ("1", "d2", ""),
    ], "name string, department string, url string").coalesce(1)
    cells = Cells(df)
    probes = M.row_local_probes(cells, ["field_missing_rate", "blank_record_rate", "recognizable_format_anomaly_rate",
                                        "source_info_coverage"], REF)
    got = sorted((r.issue_type, r.record_number, tuple(r.fields)) for r in L.issue_locations(cells, probes).collect())
    assert ("blank_record", 4, ("name", "department", "url")) in got
    assert ("invalid_format", 3, ("url",)) in got and ("missing_source_info", 4, ("department", "url")) in got
    assert [g for g in got if g[0] == "missing_value"] == [
        ("missing_value", 4, ("department",)), ("missing_value", 4, ("name",)),
        ("missing_value", 4, ("url",)), ("missing_value", 5, ("url",))]
    exact = L.duplicate_locations(df).collect()
    assert [(r.record_number, r.related_record_numbers) for r in exact] == [(2, [1])]
    types = L.type_locations(Cells(df), M.metric_frame(df, M.field_type_consistency)).collect()
    assert [(r.record_number, r.fields) for r in types] == [(5, ["name"])]
    assert [r.record_number for r in L.first_n_locations(L.issue_locations(cells, probes), 2).collect()] == [3, 4]


@pytest.mark.parametrize("days, want", [
    (-1, ("future_update_date", "attention")), (0, None), (364, None), (365, ("long_update_lag", "attention")),
    (729, ("long_update_lag", "attention")), (730, ("long_update_lag", "warning"))])
def test_lag_risk(spark, days, want):
    df = spark.createDataFrame([(str(REF - dt.timedelta(days=days)),)], "update_time string")
    got = risks.generate_risks(M.calculate_metrics(df, REF, ["update_lag_days"])).collect()
    assert [(r.rule_id, r.level) for r in got] == ([want] if want else [])


def metric_values(spark, rows):
    return spark.createDataFrame(
        [(m, f, "evaluated", v, 0) for m, f, v in rows],
        "metric_id string, field string, status string, value double, issue_count long").withColumn(
        "metric_key", F.col("metric_id")).withColumn("name", F.col("metric_id"))


def test_threshold_edges(spark):
    cases = {
        ("field_missing_rate", "a", 0.10): None, ("field_missing_rate", "b", 0.11): "attention",
        ("field_missing_rate", "c", 0.5): "warning", ("field_type_consistency", "d", 0.95): None,
        ("field_type_consistency", "e", 0.94): "attention", ("field_type_consistency", "f", 0.8): "warning",
        ("time_info_availability", None, 0.9): None, ("source_info_coverage", None, 0.5): "warning",
        ("exact_duplicate_rate", None, 0.05): "attention", ("normalized_duplicate_rate", None, 0.05): None,
        ("blank_record_rate", None, 0.0): None,
    }
    got = {(r.metric_id, r.field): r.level for r in risks.generate_risks(metric_values(spark, list(cases))).collect()}
    assert got == {(m, f): v for (m, f, _), v in cases.items() if v}
    got = risks.generate_risks(metric_values(spark, [("normalized_duplicate_rate", None, 0.05)])).collect()
    assert [(r.level, r.observed_name) for r in got] == [("attention", "normalized_duplicate_rate")]


def test_rule_validation():
    types = {"a": "numeric", "b": "text", "update_time": "text", "id": "numeric"}
    good = [Rule("numeric_range", ("a",), {"minimum": 0}), Rule("required", ("b",), target="db31_020100"),
            Rule("update_freshness", ("update_time",), {"frequency": "daily", "max_age_days": 1})]
    assert pack_problems(good, types, ["db31_020100"]) == []
    bad = [
        Rule("nope", ("a",)), Rule("required", ("a", "b")), Rule("required", ("zz",)),
        Rule("numeric_range", ("b",), {"minimum": 1}), Rule("numeric_range", ("a",), {}),
        Rule("numeric_range", ("a",), {"minimum": 2, "maximum": 1}), Rule("required", ("a",), {"minimum": 1}),
        Rule("allowed_values", ("a",), {"allowed_values": [1, 1.0]}),
        Rule("allowed_values", ("a",), {"allowed_values": list(range(101))}),
        Rule("regex_format", ("b",), {"pattern": "(a+)+"}), Rule("field_comparison", ("a", "b"), {"operator": "~"}),
        Rule("update_freshness", ("b",), {"frequency": "daily", "max_age_days": 0}),
        Rule("string_length", ("b",), {"minimum": -1}), Rule("conditional_required", ("a",), {"condition_values": [1]}),
    ]
    assert all(rule_problems(r, types) for r in bad)
    assert rule_problems(Rule("allowed_values", ("a",), {"allowed_values": [1, True]}), types) == []
    assert pack_problems([good[0], good[0]], types, []) and pack_problems([Rule("required", ("b",), target="db31_010103")],
                                                                         types, ["db31_010103"])
    assert regex_problems(r"\d{6}") == [] and regex_problems(r"(?=a)") and regex_problems(r"(a)\1")
    assert regex_problems(r"[(?]+(ab)+\\1") == [] and regex_problems(r"(a+)*") and regex_problems(r"((a*)b)+") and regex_problems(r"(a")
    assert Rule("required", ("a",)).rule_id == Rule("required", ("a",)).rule_id != Rule("required", ("b",)).rule_id
    assert len(combine_rules([good, good])) == 3
    with pytest.raises(ValueError):
        combine_rules([[good[1]], [Rule("required", ("b",))]])
    assert field_roles(good)["update_time"] == ["update_time"]
    assert suggest_rules(types)["primary_key"] == ["id"]
    assert rule_from_dict({"rule_type": "required", "fields": ["a"], "parameters": "{}"}) == Rule("required", ("a",))
    assert pack_id(good) == pack_id(good) != pack_id(good[:1])


def test_links_of_risks_are_distinct_without_grouping_them(spark):
    from sparkassay.operators import report as RP

    risks = spark.createDataFrame([
        (1, ["a", "a", "no"], ["x"]), (1, [], ["x", "x", "y"]), (1, ["a"], []), (2, [], ["x", "none"]), (2, [], ["x"]), (None, ["a"], []), (None, [], ["x"]),
        (3, ["c"], ["x"])], "risk_id int, related_metric_keys array<string>, related_metrics array<string>")
    metrics = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("c", "y"), ("d", "z")], "metric_key string, metric_id string")
    links = RP.risk_metric_links(risks, metrics)
    assert sorted(map(tuple, links.collect()), key=repr) == sorted(
        [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (None, "a"), (None, "b"), (3, "c")], key=repr)
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union"), plan[:80]
