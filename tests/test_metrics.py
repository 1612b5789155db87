"""Metric answers on small tables with known results."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkassay.functions import names
from sparkassay.operators import locate as L
from sparkassay.operators import metrics as M
from sparkassay.operators.quantiles import order_statistics, quartiles
from sparkassay.plans import catalog

SERVICE = "record_id string, service_name string, department string, update_time string, " \
          "source_url string, version string, handling_days string"


def table(rows, df):
    return {(r.metric_id, r.field): r for r in df.collect()}


def service_table(spark):
    rows = [
        ("1", "A", "d1", "2026-06-01", "https://a.cn/1", "v1.0", "3"),
        ("2", "A", "d1", "2026-06-01", "https://a.cn/1", "v1.0", "3"),
        ("3", "B", "d2", "2026/06/07", "not a url", "v1.1", "many"),
        ("4", "C", "", "soon", "", "", "5"),
        ("5", "", " ", "", "", "", ""),
        ("6", "D", "d3", "2026-05-01", "https://a.cn/6", "v2.0", "-"),
    ]
    return spark.createDataFrame(rows, SERVICE)


def test_service_table(spark):
    got = table(None, M.calculate_metrics(service_table(spark), dt.date(2026, 7, 17)))
    value = lambda i, f=None: got[i, f].value
    assert value("field_missing_rate", "department") == 0.333333
    assert value("blank_record_rate") == 0.166667
    assert value("field_type_consistency", "update_time") == 0.8
    assert value("field_type_consistency", "handling_days") == 0.6
    assert value("recognizable_format_anomaly_rate", "update_time") == 0.2
    assert value("recognizable_format_anomaly_rate", "source_url") == 0.25
    assert value("recognizable_format_anomaly_rate", "handling_days") == 0.4
    assert value("exact_duplicate_rate") == 0.166667
    assert value("normalized_duplicate_rate") == 0.166667
    assert value("time_info_availability") == 0.666667
    assert value("update_lag_days") == 40
    assert value("source_info_coverage") == 0.666667
    assert value("version_info_coverage") == 0.833333
    assert got["statistical_outlier_rate", None].status == "not_assessable"
    assert value("dataset_scale") == 6 and value("file_parse_rate") == 1
    assert json.loads(got["field_type_consistency", "update_time"].evidence)["dominant_type"] == "datetime"


@pytest.mark.parametrize("rows, exact, normalized", [
    (["政务 Service", " 政务service ", "其他事项"], 0, 1 / 3),
    (["事项A", " 事项A "], 0, 0.5),
    (["", " "], 0, 0.5),
])
def test_duplicates(spark, rows, exact, normalized):
    df = spark.createDataFrame([(r,) for r in rows], "name string")
    got = table(None, M.duplicate_metrics(df, ["exact_duplicate_rate", "normalized_duplicate_rate"]))
    assert got["exact_duplicate_rate", None].value == pytest.approx(exact, abs=1e-6)
    assert got["normalized_duplicate_rate", None].value == pytest.approx(normalized, abs=1e-6)


@pytest.mark.parametrize("column, rows", [
    ("version", ["v1.0", "v10"]), ("url", ["a-b", "ab"]), ("code", ["ABC-12", "ABC12"]), ("x", ["1.5", "15"])])
def test_structured_text_is_not_normalized(spark, column, rows):
    df = spark.createDataFrame([(r,) for r in rows], f"{column} string")
    assert M.duplicate_summary(df, True).first().issue_count == 0


def test_standard_scores(spark):
    rows = list(zip("AABCDE", "甲甲乙丙丁戊"))
    df = spark.createDataFrame(rows, "name string, department string")
    got = table(None, M.calculate_metrics(df, dt.date(2026, 1, 1), ["db31_030300", "db31_030400", "db31_010100"]))
    assert got["db31_030300", None].value == got["db31_030400", None].value == 0.833333
    assert got["db31_010100", None].status == "not_assessable"


def test_infinite_amount(spark):
    df = spark.createDataFrame([("1",), ("2",), ("3",), ("4",), ("inf",)], "amount string")
    got = table(None, M.calculate_metrics(
        df, dt.date(2026, 1, 1), ["recognizable_format_anomaly_rate", "statistical_outlier_rate"]))
    assert got["recognizable_format_anomaly_rate", "amount"].value == 0.2
    row = got["statistical_outlier_rate", "amount"]
    assert row.value == 0.2 and json.loads(row.evidence)["non_finite_count"] == 1


def test_outlier_edges(spark):
    df = spark.createDataFrame([(1e308,), (1e308,), (-1e308,), (-1e308,)], "amount double")
    assert table(None, M.metric_frame(df, M.outlier_probes))["statistical_outlier_rate", "amount"].status \
        == "not_assessable"
    df = spark.createDataFrame([(float(v),) for v in (10, 11, 12, 13, 100)], "amount double")
    assert table(None, M.metric_frame(df, M.outlier_probes))["statistical_outlier_rate", "amount"].value == 0.2


def test_order_statistics_match_sorting(spark):
    rng = random.Random(5)
    data = {
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(3000)],
        "ints": [float(rng.randint(-3, 40)) for _ in range(3000)],
        "hot": [7.0] * 2000 + [rng.random() for _ in range(1000)],
        "close": [1 + rng.random() * 1e-12 for _ in range(3000)],
    }
    df = spark.createDataFrame([(f, x) for f, xs in data.items() for x in xs], "field string, x double")
    ranks = {f: {0, 1, 749, 750, 2249, 2250, 2999} for f in data}
    got = order_statistics(df, ranks)
    for f, xs in data.items():
        ordered = sorted(xs)
        assert {r: got[f, r] for r in ranks[f]} == {r: ordered[r] for r in ranks[f]}


def test_quartiles_match_percentile(spark, data):
    df = spark.read.parquet(f"{data}/lineitem.parquet").select("l_extendedprice", "l_quantity")
    for q in quartiles(df, df.columns):
        want = df.select(F.percentile(q.field, F.array(F.lit(0.25), F.lit(0.75)))).first()[0]
        assert math.isclose(q.q1, want[0]) and math.isclose(q.q3, want[1])


def test_lag_and_offsets(spark):
    df = spark.createDataFrame([("2026-06-01",), ("2026-06-07",), ("待更新",)], "update_time string")
    assert table(None, M.metric_frame(df, M.update_lag_days, dt.date(2026, 7, 16)))[
        "update_lag_days", None].value == 39
    df = spark.createDataFrame([("2026-01-01",), ("2026-01-02T00:00:00+08:00",)], "update_time string")
    got = table(None, M.calculate_metrics(df, dt.date(2026, 1, 10), ["time_info_availability", "update_lag_days"]))
    assert got["time_info_availability", None].value == 1.0 and got["update_lag_days", None].value == 8


def test_empty_table(spark):
    got = table(None, M.calculate_metrics(spark.createDataFrame([], SERVICE), dt.date(2026, 1, 1), catalog.ALL_IDS))
    assert got["dataset_scale", None].value == 0
    assert got["exact_duplicate_rate", None].status == "not_assessable"
    assert got["db31_030300", None].status == "not_assessable"
    assert all(r.status == "not_assessable" for (i, _), r in got.items() if i not in ("dataset_scale", "file_parse_rate"))


def test_wide_table_is_split(spark):
    df = spark.range(10).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(120)])
    got = M.calculate_metrics(df, dt.date(2026, 1, 1), ["field_missing_rate", "dataset_scale"]).collect()
    assert len(got) == 121 and sum(r.value or 0 for r in got) == 10


def test_roles():
    roles = names.semantic_fields([
        "message", "coverage", "image", "usage", "update_time", "sourceUrl", "emailUpdated", "page"])
    assert roles["date"] == ["update_time"] and roles["url"] == ["sourceUrl"]
    assert roles["source"] == ["sourceUrl"] and roles["numeric"] == []
    assert names.content_columns(["id", "user_id", "name"]) == ["name"]
    assert names.content_columns(["id"]) == ["id"]
    assert names.header_problems(["a", "b", "a"]) == ["a"]


def test_selection_errors():
    assert catalog.select_metrics(None) == catalog.BASE_IDS and len(catalog.ALL_IDS) == 43
    assert catalog.select_metrics(["dataset_scale", "file_parse_rate", "dataset_scale"]) == (
        "file_parse_rate", "dataset_scale")
    for bad in ([], ["nope"], "dataset_scale", [1]):
        with pytest.raises(ValueError):
            catalog.select_metrics(bad)


def test_failed_input(spark):
    got = M.failed_metrics(spark, "bad encoding").collect()
    assert [r.value for r in got if r.metric_id == "file_parse_rate"] == [0.0]
    assert sum(r.status == "not_assessable" for r in got) == 12


def test_duplicate_locations_compute_each_key_once(spark):
    df = spark.createDataFrame([(i, f"Name {i % 5}", i % 2) for i in range(40)], "record_number bigint, name string, size int").coalesce(1)
    for normalized in (False, True):
        found = L.duplicate_locations(df.drop("record_number"), normalized, df)
        assert "sha2" not in found._jdf.queryExecution().optimizedPlan().toString()  # the keys are read, not computed again
        got = {(r.record_number, r.related_record_numbers[0]) for r in found.collect()}
        assert got == {(i, i % 10) for i in range(10, 40)}


def test_quartile_passes_read_numbers_parsed_once(spark, monkeypatch):
    from sparkassay.operators import quantiles

    plans = []

    def passes(values, ranks):
        plans.append(values._jdf.queryExecution().optimizedPlan().toString())
        return order_statistics(values, ranks)

    monkeypatch.setattr(quantiles, "order_statistics", passes)
    q = quartiles(spark.createDataFrame([(f" {i}.0 ",) for i in range(1, 10)], "amount string"), ["amount"])[0]
    assert (q.q1, q.q3) == (3.0, 7.0)
    assert len(plans) == 1 and "transform" not in plans[0]
