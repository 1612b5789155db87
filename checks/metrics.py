"""AGG, STD and RSK rows: metrics of the orders table with faults, and their risks."""

import datetime as dt

from pyspark.sql import functions as F

from sparkassay.operators import locate as L
from sparkassay.operators import metrics as M
from sparkassay.operators import risks as R
from sparkassay.operators.assess import assess, settle
from sparkassay.operators.profile import infer_types, profile
from sparkassay.plans import catalog
from sparkassay.plans.cells import Cells

from .registry import (
    DIRTY_COLUMNS, DIRTY_ORDERS, DIRTY_PARTS, REFERENCE_DATE, check, d_date, d_email, d_finite,
    d_kind, d_metric, d_missing, d_number, d_ratio, d_url, dirty_orders, dirty_parts, joined, load,
    shown, union,
)
from .values import d_normal

REF = dt.date.fromisoformat(REFERENCE_DATE)
D = f"WITH d AS MATERIALIZED ({DIRTY_ORDERS}) "
P = f"WITH p AS MATERIALIZED ({DIRTY_PARTS}) "
ALL = ("record_id", *DIRTY_COLUMNS)


def text(c):
    return f"CAST({c} AS VARCHAR)"


# ------------------------------------------------------------------ SQL of the metric rows
def s_scale():
    return d_metric("dataset_scale", "", "count(*)", "-1", "-1") + " FROM d"


def s_missing():
    return union(d_metric("field_missing_rate", c, d_ratio(f"count(*) FILTER ({d_missing(text(c))})", "count(*)"),
                          "count(*)", f"count(*) FILTER ({d_missing(text(c))})") + " FROM d" for c in ALL)


def s_blank():
    blank = " AND ".join(d_missing(c) for c in DIRTY_COLUMNS)
    return d_metric("blank_record_rate", "", d_ratio(f"count(*) FILTER ({blank})", "count(*)"), "count(*)",
                    f"count(*) FILTER ({blank})") + " FROM d"


def s_types():
    parts = []
    for c in ALL:
        kind = "'numeric'" if c == "record_id" else d_kind(c)
        counts = f"(SELECT k, count(*) AS n FROM (SELECT {kind} AS k FROM d) WHERE k IS NOT NULL GROUP BY k)"
        parts.append(d_metric("field_type_consistency", c, d_ratio("max(n)", "sum(n)"), "sum(n)", "sum(n) - max(n)")
                     + f" FROM {counts}")
    return union(parts)


FORMATS = {"total_amount": d_finite, "source_url": d_url, "contact_email": d_email,
           "update_time": lambda c: f"(({d_date(c)}) IS NOT NULL)"}


def s_formats():
    parts = []
    for c, valid in FORMATS.items():
        n = f"count(*) FILTER (NOT {d_missing(c)})"
        bad = f"count(*) FILTER (NOT {d_missing(c)} AND NOT {valid(c)})"
        parts.append(d_metric("recognizable_format_anomaly_rate", c, d_ratio(bad, n), n, bad) + " FROM d")
    return union(parts)


def s_duplicates(metric="exact_duplicate_rate", normal=False, source="p", columns=("title", "kind", "size_class")):
    keys = ", ".join(d_normal(c) if normal and c != "size_class" else c for c in columns)
    return d_metric(metric, "", d_ratio("sum(n - 1)", "sum(n)") if not metric.startswith("db31")
                    else d_ratio("sum(n) - sum(n - 1)", "sum(n)"), "sum(n)", "sum(n - 1)") + \
        f" FROM (SELECT count(*) AS n FROM {source} GROUP BY {keys})"


def s_time():
    ok = f"count(*) FILTER (({d_date('update_time')}) IS NOT NULL)"
    return d_metric("time_info_availability", "", d_ratio(ok, "count(*)"), "count(*)", f"count(*) - {ok}") + " FROM d"


def s_lag():
    return d_metric("update_lag_days", "", f"date_diff('day', CAST(max({d_date('update_time')}) AS DATE), DATE '{REFERENCE_DATE}')",
                    "-1", "-1") + " FROM d"


def s_coverage(metric, columns):
    ok = "count(*) FILTER (" + " OR ".join(f"NOT {d_missing(c)}" for c in columns) + ")"
    return d_metric(metric, "", d_ratio(ok, "count(*)"), "count(*)", f"count(*) - {ok}") + " FROM d"


def s_outliers(fields, source):
    """fields: name -> (number expression, missing expression)."""
    parts = []
    for c, x in fields.items():
        parts.append(
            d_metric("statistical_outlier_rate", c, d_ratio("count(*) FILTER (x < lo OR x > hi)", "count(*)"),
                     "count(*)", "count(*) FILTER (x < lo OR x > hi)")
            + f" FROM (SELECT x, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT {x} AS x FROM {source}), "
              f"(SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM (SELECT {x} AS x FROM {source}) WHERE isfinite(x)) "
              f"WHERE x IS NOT NULL)")
    return union(parts)


SOURCE_FIELDS, VERSION_FIELDS = ("department", "source_url"), ("version", "update_time")
BASE_SQL = union([
    d_metric("file_parse_rate", "", "1", "-1", "-1"), s_scale(), s_missing(), s_blank(), s_types(), s_formats(),
    s_duplicates("exact_duplicate_rate", False, "d", DIRTY_COLUMNS),
    s_duplicates("normalized_duplicate_rate", False, "(SELECT " + ", ".join(
        (f"CASE WHEN NOT {d_missing(c)} THEN {c} END AS {c}" if c in ("source_url", "contact_email", "version")
         else f"{d_normal(c)} AS {c}") for c in DIRTY_COLUMNS) + " FROM d)", DIRTY_COLUMNS),
    s_time(), s_lag(), s_coverage("source_info_coverage", SOURCE_FIELDS),
    s_coverage("version_info_coverage", VERSION_FIELDS),
    s_outliers({"total_amount": d_number("total_amount")}, "d"),
])


def metric_query(build, *args):
    return lambda spark, sf: shown(M.metric_frame(dirty_orders(spark, sf), build, *args))


for _name, _sql, _query in (
    ("agg3_dataset_scale", s_scale(), metric_query(M.dataset_scale)),
    ("agg4_field_missing_rate", s_missing(), metric_query(M.field_missing_rate)),
    ("agg5_blank_record_rate", s_blank(), metric_query(M.blank_record_rate)),
    ("agg6_field_type_consistency", s_types(), metric_query(M.field_type_consistency)),
    ("agg7_recognizable_format_anomaly_rate", s_formats(), metric_query(M.recognizable_format_anomaly_rate)),
    ("agg10_time_info_availability", s_time(), metric_query(M.time_info_availability)),
    ("agg11_update_lag_days", s_lag(), metric_query(M.update_lag_days, REF)),
    ("agg12_source_info_coverage", s_coverage("source_info_coverage", SOURCE_FIELDS), metric_query(M.source_info_coverage)),
    ("agg13_version_info_coverage", s_coverage("version_info_coverage", VERSION_FIELDS), metric_query(M.version_info_coverage)),
):
    check(_name, D + _sql)(_query)


def _profile_sql(kinds_only=False):
    parts = []
    for c in ALL:
        kind = "'numeric'" if c == "record_id" else d_kind(c)
        inferred = ("CASE WHEN count(k) = 0 THEN 'unknown' WHEN bool_and(k = 'boolean') THEN 'boolean' "
                    "WHEN bool_and(k = 'numeric') THEN 'numeric' WHEN bool_and(k = 'datetime') THEN 'datetime' ELSE 'text' END")
        counts = "" if kinds_only else ("CAST(count(*) - count(k) AS BIGINT) AS missing_count, CAST(count(k) AS BIGINT) AS non_missing_count, "
                                        f"{d_ratio('count(*) - count(k)', 'count(*)')} AS missing_rate, ")
        parts.append(f"SELECT '{c}' AS name, {counts}{inferred} AS inferred_type FROM (SELECT {kind} AS k FROM d)")
    return D + union(parts)


@check("agg1_profile", _profile_sql())
def agg1(spark, sf):
    return profile(dirty_orders(spark, sf)).select("name", "missing_count", "non_missing_count", "missing_rate", "inferred_type")


@check("agg2_infer_column_type", _profile_sql(True))
def agg2(spark, sf):
    return infer_types(dirty_orders(spark, sf)).select("name", "inferred_type")


@check("agg8_exact_duplicate_rate", P + s_duplicates())
def agg8(spark, sf):
    return shown(M.duplicate_metrics(dirty_parts(spark, sf), ["exact_duplicate_rate"]))


@check("agg8_exact_duplicate_rate_text", d_metric("exact_duplicate_rate", "", d_ratio("sum(n - 1)", "sum(n)"), "sum(n)", "sum(n - 1)")
       + " FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)")
def agg8_text(spark, sf):
    return shown(M.duplicate_metrics(load(spark, sf, "documents").select("text", "lang"), ["exact_duplicate_rate"]))


@check("agg9_normalized_duplicate_rate", P + s_duplicates("normalized_duplicate_rate", True))
def agg9(spark, sf):
    return shown(M.duplicate_metrics(dirty_parts(spark, sf), ["normalized_duplicate_rate"]))


@check("agg9_normalized_duplicate_rate_text", d_metric("normalized_duplicate_rate", "", d_ratio("sum(n - 1)", "sum(n)"), "sum(n)", "sum(n - 1)")
       + f" FROM (SELECT count(*) AS n FROM documents GROUP BY {d_normal('text')}, {d_normal('lang')})")
def agg9_text(spark, sf):
    return shown(M.duplicate_metrics(load(spark, sf, "documents").select("text", "lang"), ["normalized_duplicate_rate"]))


@check("agg14_statistical_outlier_rate", s_outliers({"value": "value"}, "events"))
def agg14(spark, sf):
    return shown(M.metric_frame(load(spark, sf, "events").select("event_id", "value"), M.outlier_probes))


@check("agg14_statistical_outlier_rate_wide", s_outliers(
    {c: c for c in ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")}, "lineitem"))
def agg14_wide(spark, sf):
    return shown(M.metric_frame(load(spark, sf, "lineitem").select(
        "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"), M.outlier_probes))


@check("agg14_statistical_outlier_rate_text", D + s_outliers({"total_amount": d_number("total_amount")}, "d"))
def agg14_text(spark, sf):
    return shown(M.metric_frame(dirty_orders(spark, sf), M.outlier_probes, ["total_amount"]))


@check("agg15_file_parse_rate", """SELECT 'file_parse_rate' AS metric_id, '' AS field, 'evaluated' AS status,
  round_even(CAST(count(*) FILTER (ok) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) AS value, CAST(-1 AS BIGINT) AS checked_count, CAST(-1 AS BIGINT) AS issue_count
  FROM (SELECT user_id, bool_and(value <= 40) AS ok FROM events GROUP BY 1)""")
def agg15(spark, sf):
    from sparkassay.sources.files import parse_rate
    lines = load(spark, sf, "events").select(F.col("user_id").alias("path"), F.when(
        F.col("value") > 40, F.expr("left(props, 5)")).otherwise(F.col("props")).alias("value"))
    return shown(parse_rate(lines))


@check("agg17_calculate_all_metrics", D + BASE_SQL)
def agg17(spark, sf):
    return shown(M.calculate_metrics(dirty_orders(spark, sf), REF))


def _standard_sql():
    copies = "(SELECT sum(n) AS rows_, sum(n - 1) AS copies FROM (SELECT count(*) AS n FROM p GROUP BY title, kind, size_class))"
    parts = []
    for i in catalog.STANDARD_IDS:
        if i in ("db31_030300", "db31_030400"):
            parts.append(d_metric(i, "", d_ratio("rows_ - copies", "rows_"), "rows_", "copies") + f" FROM {copies}")
        else:
            parts.append(d_metric(i, "", "NULL", "-1", "-1", "'not_assessable'"))
    return P + union(parts)


@check("std1_data_duplication_score", P + s_duplicates("db31_030300"))
def std1(spark, sf):
    return shown(M.calculate_metrics(dirty_parts(spark, sf), REF, ["db31_030300"]))


@check("std2_data_uniqueness", P + s_duplicates("db31_030400"))
def std2(spark, sf):
    return shown(M.calculate_metrics(dirty_parts(spark, sf), REF, ["db31_030400"]))


@check("std3_standard_catalog", _standard_sql())
def std3(spark, sf):
    return shown(M.calculate_metrics(dirty_parts(spark, sf), REF, catalog.STANDARD_IDS))


# ------------------------------------------------------------------ locations
@check("l1_with_record_number", """
SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(row_number() OVER () AS BIGINT) AS record_number FROM lineitem""")
def l1(spark, sf):
    return L.with_record_number(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"))


def numbered(df):
    """Orders are stored by key, so the key is the record number."""
    return df.withColumn("record_number", F.col("record_id") + 1)


def _s_location(metric, kind, fields, where, source="d", key="record_id + 1"):
    return (f"SELECT '{metric}' AS metric_key, {key} AS record_number, '{fields}' AS fields, '{kind}' AS issue_type, '' AS related "
            f"FROM {source} WHERE {where}")


@check("l2_issue_locations", D + union(
    [_s_location(f"metric:field_missing_rate:field:{c}", "missing_value", c, d_missing(text(c))) for c in ALL]
    + [_s_location("metric:blank_record_rate:dataset", "blank_record", ",".join(DIRTY_COLUMNS),
                   " AND ".join(d_missing(c) for c in DIRTY_COLUMNS))]
    + [_s_location(f"metric:recognizable_format_anomaly_rate:field:{c}", "invalid_format", c,
                   f"NOT {d_missing(c)} AND NOT {ok(c)}") for c, ok in FORMATS.items()]
    + [_s_location("metric:time_info_availability:dataset", "missing_or_invalid_time", "update_time",
                   f"({d_date('update_time')}) IS NULL")]
    + [_s_location("metric:source_info_coverage:dataset", "missing_source_info", "department,source_url",
                   " AND ".join(d_missing(c) for c in SOURCE_FIELDS))]
    + [_s_location("metric:version_info_coverage:dataset", "missing_version_info", "update_time,version",
                   " AND ".join(d_missing(c) for c in VERSION_FIELDS))]))
def l2(spark, sf):
    df = dirty_orders(spark, sf)
    cells = Cells(df)
    return joined(L.issue_locations(cells, M.row_local_probes(cells, [
        "field_missing_rate", "blank_record_rate", "recognizable_format_anomaly_rate", "time_info_availability",
        "source_info_coverage", "version_info_coverage"], REF), numbered(df)))


def _s_copies(kind, keys):
    return (f"SELECT 'metric:{kind}_rate:dataset' AS metric_key, record_number, 'title,kind,size_class' AS fields, "
            f"'{kind}_record' AS issue_type, CAST(first_record AS VARCHAR) AS related FROM (SELECT part_id + 1 AS record_number, "
            f"min(part_id + 1) OVER (PARTITION BY {keys}) AS first_record FROM p) WHERE record_number > first_record")


@check("l2_duplicate_locations", P + union([
    _s_copies("exact_duplicate", "title, kind, size_class"),
    _s_copies("normalized_duplicate", f"{d_normal('title')}, {d_normal('kind')}, size_class")]))
def l2_duplicates(spark, sf):
    df = dirty_parts(spark, sf)
    rows = df.withColumn("record_number", F.col("part_id") + 1)
    return joined(L.duplicate_locations(df, False, rows).unionByName(L.duplicate_locations(df, True, rows)))


@check("l2_type_locations", D + union(
    f"SELECT 'metric:field_type_consistency:field:{c}' AS metric_key, record_id + 1 AS record_number, '{c}' AS fields, "
    f"'inconsistent_type' AS issue_type, '' AS related FROM d WHERE {d_kind(c)} <> (SELECT k FROM (SELECT {d_kind(c)} AS k FROM d) "
    f"WHERE k IS NOT NULL GROUP BY k ORDER BY count(*) DESC, k LIMIT 1)" for c in DIRTY_COLUMNS))
def l2_types(spark, sf):
    df = dirty_orders(spark, sf)
    return joined(L.type_locations(Cells(df), M.metric_frame(df, M.field_type_consistency), numbered(df)))


@check("l3_first_n_locations", D + f"""SELECT record_id + 1 AS record_number, 'missing_source_info' AS issue_type FROM d
WHERE {' AND '.join(d_missing(c) for c in SOURCE_FIELDS)} ORDER BY record_id LIMIT 20""")
def l3(spark, sf):
    df = dirty_orders(spark, sf)
    cells = Cells(df)
    found = L.issue_locations(cells, M.source_info_coverage(cells), numbered(df))
    return L.first_n_locations(found, 20).select("record_number", "issue_type")


# ------------------------------------------------------------------ risks
M_SQL = f"{D}, m AS MATERIALIZED ({BASE_SQL}), "
COLUMNS = "risk_id, level, metric_id, observed_value, threshold"
SUFFIX = "|| CASE WHEN field <> '' THEN ':' || field ELSE '' END AS risk_id"


def s_threshold(metric, rule, direction, attention, warning, value="value"):
    w, a = (f"{value} >= {warning}", f"{value} > {attention}") if direction == "high" else (f"{value} <= {warning}", f"{value} < {attention}")
    return (f"SELECT '{rule}' {SUFFIX}, CASE WHEN {w} THEN 'warning' ELSE 'attention' END AS level, metric_id, "
            f"CAST({value} AS DOUBLE) AS observed_value, CAST(CASE WHEN {w} THEN {warning} ELSE {attention} END AS DOUBLE) AS threshold "
            f"FROM m WHERE metric_id = '{metric}' AND status = 'evaluated' AND ({w} OR {a})")


def s_special(metric, rule, level, condition, threshold, value="value"):
    return (f"SELECT '{rule}' {SUFFIX}, '{level}' AS level, metric_id, CAST({value} AS DOUBLE) AS observed_value, "
            f"CAST({threshold} AS DOUBLE) AS threshold FROM m WHERE metric_id = '{metric}' AND status = 'evaluated' AND {condition}")


ADDITIONAL = "greatest(0.0, value - (SELECT value FROM m WHERE metric_id = 'exact_duplicate_rate'))"
RISK_SQL = {
    "rsk1_file_parse_failed": s_special("file_parse_rate", "file_parse_failed", "warning", "value < 1", 1),
    "rsk2_empty_dataset": s_special("dataset_scale", "empty_dataset", "warning", "value = 0", 0),
    **{f"rsk{n}_{rule}": s_threshold(metric, rule, d, a, w, ADDITIONAL if metric == "normalized_duplicate_rate" else "value")
       for n, (metric, rule, d, a, w, _) in zip((3, 4, 5, 6, 7, 8, 9, 11, "11b"), R.THRESHOLDS)},
    "rsk10_update_lag": union([
        s_special("update_lag_days", "future_update_date", "attention", "value < 0", 0),
        s_special("update_lag_days", "long_update_lag", "warning", "value >= 730", 730),
        s_special("update_lag_days", "long_update_lag", "attention", "value >= 365 AND value < 730", 365)]),
    "rsk12_statistical_outliers_detected": s_special(
        "statistical_outlier_rate", "statistical_outliers_detected", "info", "issue_count > 0", 0, "issue_count"),
}
RULES_OF = {
    "rsk10_update_lag": ("future_update_date", "long_update_lag"),
    **{k: (k.split("_", 1)[1],) for k in RISK_SQL if k != "rsk10_update_lag"},
}
NEEDS = {
    "file_parse_failed": ["file_parse_rate"], "empty_dataset": ["dataset_scale"],
    "future_update_date": ["update_lag_days"], "statistical_outliers_detected": ["statistical_outlier_rate"],
    "normalized_duplicates_detected": ["exact_duplicate_rate", "normalized_duplicate_rate"],
    **{rule: [metric] for metric, rule, *_ in R.THRESHOLDS if metric != "normalized_duplicate_rate"},
}


def shown_risks(risks):
    return risks.select("risk_id", "level", "metric_id", "observed_value", "threshold")


def risk_query(name):
    rules = RULES_OF[name]

    def query(spark, sf):
        metrics = settle(M.calculate_metrics(dirty_orders(spark, sf), REF, NEEDS[rules[0]]))
        return shown_risks(R.generate_risks(metrics).where(F.col("rule_id").isin(*rules)))
    return query


ELSEWHERE = ("rsk1_file_parse_failed", "rsk2_empty_dataset", "rsk8_normalized_duplicates_detected",
             "rsk11_low_source_coverage", "rsk11b_low_version_coverage")
for _name, _sql in RISK_SQL.items():
    if _name not in ELSEWHERE:
        check(_name, f"{M_SQL.rstrip(', ')} {_sql}")(risk_query(_name))


@check("rsk1_file_parse_failed", """SELECT 'file_parse_failed' AS risk_id, 'warning' AS level, 'file_parse_rate' AS metric_id,
  round_even(CAST(count(*) FILTER (ok) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) AS observed_value, CAST(1 AS DOUBLE) AS threshold
  FROM (SELECT event_type, bool_and(event_type <> 'error') AS ok FROM events GROUP BY 1)""")
def rsk1(spark, sf):
    from sparkassay.sources.files import parse_rate
    lines = load(spark, sf, "events").select(F.col("event_type").alias("path"), F.when(
        F.col("event_type") == "error", F.expr("left(props, 5)")).otherwise(F.col("props")).alias("value"))
    return shown_risks(R.generate_risks(parse_rate(lines)))


@check("rsk2_empty_dataset", """SELECT 'empty_dataset' AS risk_id, 'warning' AS level, 'dataset_scale' AS metric_id,
  CAST(0 AS DOUBLE) AS observed_value, CAST(0 AS DOUBLE) AS threshold FROM (SELECT count(*) AS n FROM orders WHERE o_totalprice < 0) WHERE n = 0""")
def rsk2(spark, sf):
    none = load(spark, sf, "orders").where("o_totalprice < 0")
    return shown_risks(R.generate_risks(M.calculate_metrics(none, REF, ["dataset_scale"])))


@check("rsk8_normalized_duplicates_detected", f"{P}, m AS MATERIALIZED (" + union([
    s_duplicates(), s_duplicates("normalized_duplicate_rate", True)]) + ") " + RISK_SQL["rsk8_normalized_duplicates_detected"])
def rsk8(spark, sf):
    metrics = M.calculate_metrics(dirty_parts(spark, sf), REF, ["exact_duplicate_rate", "normalized_duplicate_rate"])
    return shown_risks(R.generate_risks(metrics).where("rule_id = 'normalized_duplicates_detected'"))


@check("rsk11_low_coverage", f"{D}, m AS MATERIALIZED (" + union([
    s_coverage("source_info_coverage", ("department",)), s_coverage("version_info_coverage", ("version",))]) + ") " + union([
        RISK_SQL["rsk11_low_source_coverage"], RISK_SQL["rsk11b_low_version_coverage"]]))
def rsk11(spark, sf):
    df = dirty_orders(spark, sf).select("record_id", "department", "version")
    return shown_risks(R.generate_risks(M.calculate_metrics(df, REF, ["source_info_coverage", "version_info_coverage"])))


@check("rsk_all_risks", f"{M_SQL.rstrip(', ')} " + union(RISK_SQL.values()))
def rsk_all(spark, sf):
    return shown_risks(assess(dirty_orders(spark, sf), REF).risks)
