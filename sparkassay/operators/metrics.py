"""The 13 base metrics and the standard-catalog metrics."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions import values as V
from ..plans import catalog
from ..plans.cells import Cells, flat_columns
from ..plans.probes import (
    GROUP_COLUMNS, Probe, Violation, evidence_json, literal_empty, literal_metrics, metric_row,
    ratio, run_probes, union_all,
)
from ..plans.skew import count_groups, with_record_key
from .quantiles import quartiles

NO_ROWS = "数据集不包含记录，无法计算。"
KINDS = ("boolean", "datetime", "numeric", "text")


def _rows():
    return F.count(F.lit(1))


# ------------------------------------------------------------------ single-pass metrics
def dataset_scale(cells: Cells) -> list[Probe]:
    n = F.col("scale_rows")
    return [Probe({"scale_rows": _rows()}, metric_row(
        "dataset_scale", value=n,
        evidence=evidence_json(file_count=1, row_count=n, column_count=len(cells.columns))))]


def field_missing_rate(cells: Cells, columns: list[str] | None = None) -> list[Probe]:
    probes = []
    for c in cells.columns if columns is None else columns:
        i = cells.columns.index(c)
        n, m = f"miss_rows_{i}", f"miss_issues_{i}"
        probes.append(Probe(
            {n: _rows(), m: F.count_if(cells.missing(c))},
            metric_row("field_missing_rate", scope="field", field_name=c,
                       value=ratio(F.col(m), F.col(n)), checked=F.col(n), issues=F.col(m),
                       evidence=evidence_json(checked_count=F.col(n), issue_count=F.col(m)),
                       blockers=[(F.col(n) == 0, "数据集不包含记录，无法计算字段缺失率。")]),
            [Violation(names.metric_key("field_missing_rate", c), "missing_value", [c], cells.missing(c))],
        ))
    return probes


def blank_record_rate(cells: Cells) -> list[Probe]:
    content = names.content_columns(cells.columns)
    blank = V.all_of([cells.missing(c) for c in content])
    n, m = F.col("blank_rows"), F.col("blank_issues")
    return [Probe(
        {"blank_rows": _rows(), "blank_issues": F.count_if(blank)},
        metric_row("blank_record_rate", value=ratio(m, n), checked=n, issues=m,
                   evidence=evidence_json(checked_count=n, issue_count=m,
                                          method="inferred_content_fields_blank", content_fields=content),
                   blockers=[(n == 0, "数据集不包含记录，无法计算空白记录率。")]),
        [Violation(names.metric_key("blank_record_rate"), "blank_record", content, blank)],
    )]


def _dominant(counts: dict[str, F.Column]):
    """Most frequent type; equal counts go to the alphabetically first type."""
    top = F.greatest(*counts.values())
    label = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        label = F.when(counts[kind] == top, F.lit(kind)).otherwise(label)
    return top, label


def field_type_consistency(cells: Cells, columns: list[str] | None = None) -> list[Probe]:
    """Share of the dominant type.  Locations need that type: see ``type_violations``."""
    probes = []
    for c in cells.columns if columns is None else columns:
        i, kind = cells.columns.index(c), cells.kind(c)
        agg = {f"kind_{i}_{k}": F.count_if(kind == k) for k in KINDS}
        agg[f"kind_{i}_n"] = F.count(kind)
        n = F.col(f"kind_{i}_n")
        counts = {k: F.col(f"kind_{i}_{k}") for k in KINDS}
        top, label = _dominant(counts)
        type_counts = F.to_json(F.map_filter(
            F.create_map(*[x for k in KINDS for x in (F.lit(k), counts[k])]), lambda _, v: v > 0))
        probes.append(Probe(agg, metric_row(
            "field_type_consistency", scope="field", field_name=c, value=ratio(top, n),
            checked=n, issues=n - top,
            evidence=evidence_json(checked_count=n, issue_count=n - top, dominant_type=label,
                                   type_counts=type_counts),
            blockers=[(n == 0, "字段没有非空值，无法推断主要数据类型。")])))
    return probes


def recognizable_format_anomaly_rate(cells: Cells) -> list[Probe]:
    probes = []
    for i, c in enumerate(cells.columns):
        expected = names.expected_format(c)
        if expected is None:
            continue
        bad = ~cells.missing(c) & ~cells.valid(c, expected)
        n, m = f"format_rows_{i}", f"format_issues_{i}"
        probes.append(Probe(
            {n: F.count_if(~cells.missing(c)), m: F.count_if(bad)},
            metric_row("recognizable_format_anomaly_rate", scope="field", field_name=c,
                       value=ratio(F.col(m), F.col(n)), checked=F.col(n), issues=F.col(m),
                       evidence=evidence_json(expected_format=expected, checked_count=F.col(n),
                                              issue_count=F.col(m)),
                       blockers=[(F.col(n) == 0, "字段没有非空值，无法检查格式。")]),
            [Violation(names.metric_key("recognizable_format_anomaly_rate", c), "invalid_format", [c], bad)],
        ))
    return probes or [_blocked("recognizable_format_anomaly_rate",
                               "未识别到可检查的日期、数值、URL 或邮箱字段。")]


def _blocked(metric_id: str, reason: str, basis=None) -> Probe:
    return Probe({}, metric_row(metric_id, value=F.lit(None), blockers=[(F.lit(True), reason)], basis=basis))


def _date_text(c):
    return F.date_format(c, "yyyy-MM-dd")


def _extreme(fn, pick, dates):
    return fn(pick(*dates) if len(dates) > 1 else dates[0])


def time_info_availability(cells: Cells) -> list[Probe]:
    fields = sorted(names.temporal_columns(cells.columns, "date", "update"))
    if not fields:
        return [_blocked("time_info_availability", "未识别到日期或时间字段。")]
    dates = [cells.date(c) for c in fields]
    found = V.any_of([d.isNotNull() for d in dates])
    n, ok = F.col("time_rows"), F.col("time_found")
    return [Probe(
        {"time_rows": _rows(), "time_found": F.count_if(found),
         "time_first": _extreme(F.min, F.least, dates), "time_last": _extreme(F.max, F.greatest, dates)},
        metric_row("time_info_availability", value=ratio(ok, n), checked=n, issues=n - ok,
                   evidence=evidence_json(identified_fields=fields, checked_count=n, available_count=ok,
                                          issue_count=n - ok, earliest_date=_date_text(F.col("time_first")),
                                          latest_date=_date_text(F.col("time_last"))),
                   blockers=[(n == 0, "数据集不包含记录，无法计算时间信息可用率。")]),
        [Violation(names.metric_key("time_info_availability"), "missing_or_invalid_time", fields, ~found)],
    )]


def update_lag_days(cells: Cells, reference_date: dt.date) -> list[Probe]:
    fields = names.temporal_columns(cells.columns, "update")
    if not fields:
        return [_blocked("update_lag_days", "未识别到更新时间字段。")]
    latest = F.col("lag_latest")
    return [Probe(
        {"lag_latest": _extreme(F.max, F.greatest, [cells.date(c) for c in fields])},
        metric_row("update_lag_days", value=F.datediff(F.lit(reference_date), latest.cast("date")),
                   evidence=evidence_json(identified_fields=fields, latest_update_date=_date_text(latest),
                                          reference_date=reference_date.isoformat()),
                   blockers=[(latest.isNull(), "未找到可解析的更新时间值。")]),
    )]


def _coverage(cells: Cells, metric_id: str, fields: list[str], issue_type: str, reason: str) -> list[Probe]:
    if not fields:
        return [_blocked(metric_id, reason)]
    covered = V.any_of([~cells.missing(c) for c in fields])
    n, k = F.col(f"{metric_id}_rows"), F.col(f"{metric_id}_covered")
    return [Probe(
        {f"{metric_id}_rows": _rows(), f"{metric_id}_covered": F.count_if(covered)},
        metric_row(metric_id, value=ratio(k, n), checked=n, issues=n - k,
                   evidence=evidence_json(identified_fields=fields, checked_count=n, covered_count=k,
                                          issue_count=n - k),
                   blockers=[(n == 0, "数据集不包含记录，无法计算覆盖率。")]),
        [Violation(names.metric_key(metric_id), issue_type, fields, ~covered)],
    )]


def source_info_coverage(cells: Cells) -> list[Probe]:
    return _coverage(cells, "source_info_coverage",
                     sorted(names.columns_with(cells.columns, "source", "url", "source_id")),
                     "missing_source_info", "未识别到来源部门、来源链接或原始标识字段。")


def version_info_coverage(cells: Cells) -> list[Probe]:
    fields = set(names.columns_with(cells.columns, "version"))
    fields |= set(names.temporal_columns(cells.columns, "update"))
    return _coverage(cells, "version_info_coverage", sorted(fields),
                     "missing_version_info", "未识别到版本号、更新时间或处理记录字段。")


# ------------------------------------------------------------------ duplicates
def duplicate_summary(df: DataFrame, normalized: bool = False) -> DataFrame:
    """One row: records, later copies, groups with copies."""
    content = names.content_columns(flat_columns(df))
    keyed = with_record_key(df, content, normalized)
    return count_groups(keyed, "key").agg(
        F.coalesce(F.sum("group_size"), F.lit(0)).alias("checked_count"),
        F.coalesce(F.sum(F.col("group_size") - 1), F.lit(0)).alias("issue_count"),
        F.count_if(F.col("group_size") > 1).alias("duplicate_group_count"),
    )


def _duplicate_row(metric_id: str, fields: list[str], normalized: bool):
    n, m = F.col("checked_count"), F.col("issue_count")
    return metric_row(
        metric_id, value=ratio(m, n), checked=n, issues=m,
        evidence=evidence_json(checked_count=n, issue_count=m,
                               duplicate_group_count=F.col("duplicate_group_count"),
                               compared_fields=fields, normalization=normalized),
        blockers=[(n == 0, "数据集不包含记录，无法检查重复。")])


def _standard_duplicate_row(metric_id: str, fields: list[str]):
    """1 - copies / records and records without copies / records are the same quotient."""
    m = catalog.METRICS[metric_id]
    n, copies = F.col("checked_count"), F.col("issue_count")
    return metric_row(
        metric_id, value=ratio(n - copies, n), checked=n, issues=copies,
        evidence=evidence_json(
            standard_code=m.standard_code, formula=m.formula, method="exact_content_record_comparison",
            checked_count=n, conforming_count=n - copies, issue_count=copies,
            duplicate_group_count=F.col("duplicate_group_count"), compared_fields=fields,
            source_metric_id="exact_duplicate_rate"),
        blockers=[(n == 0, f"数据集不包含记录，DB31/T 1523-2024 公式的分母 B 为 0，无法计算“{m.name}”。")])


def duplicate_metrics(df: DataFrame, metric_ids: Iterable[str]) -> DataFrame:
    """Every selected metric that needs exact or normalized groups; one pass per kind of key."""
    ids, frames = set(metric_ids), []
    fields = names.content_columns(flat_columns(df))
    exact = [i for i in ("exact_duplicate_rate", "db31_030300", "db31_030400") if i in ids]
    if exact:
        rows = [_duplicate_row(i, fields, False) if i == "exact_duplicate_rate"
                else _standard_duplicate_row(i, fields) for i in exact]
        frames.append(duplicate_summary(df).select(F.explode(F.array(*rows)).alias("m")).select("m.*"))
    if "normalized_duplicate_rate" in ids:
        row = _duplicate_row("normalized_duplicate_rate", fields, True)
        frames.append(duplicate_summary(df, True).select(row.alias("m")).select("m.*"))
    return union_all(frames)


# ------------------------------------------------------------------ outliers
def outlier_probes(cells: Cells, columns: list[str] | None = None) -> list[Probe]:
    """IQR outliers.  The driver reads one row of counts and the quartiles, never the data."""
    fields = names.content_columns(cells.columns) if columns is None else columns
    fields = [c for c in fields if V.is_number(cells.types[c]) or V.is_text(cells.types[c])
              or V.is_variant(cells.types[c])]
    probes = []
    for q in quartiles(cells.df, fields):
        i = cells.columns.index(q.field)
        if q.problem:
            probes.append(Probe({}, metric_row(
                "statistical_outlier_rate", scope="field", field_name=q.field, value=F.lit(None),
                blockers=[(F.lit(True), q.problem)])))
            continue
        x = cells.number(q.field)
        bad = x.isNotNull() & ~x.between(q.lower, q.upper)
        n, m, k = f"iqr_rows_{i}", f"iqr_issues_{i}", f"iqr_infinite_{i}"
        probes.append(Probe(
            {n: F.count(x), m: F.count_if(bad), k: F.count_if(x.isNotNull() & ~V.is_finite(x))},
            metric_row("statistical_outlier_rate", scope="field", field_name=q.field,
                       value=ratio(F.col(m), F.col(n)), checked=F.col(n), issues=F.col(m),
                       evidence=evidence_json(checked_count=F.col(n), issue_count=F.col(m),
                                              non_finite_count=F.col(k), q1=q.q1, q3=q.q3,
                                              iqr=q.q3 - q.q1, lower_bound=q.lower, upper_bound=q.upper)),
            [Violation(names.metric_key("statistical_outlier_rate", q.field), "statistical_outlier",
                       [q.field], bad)],
        ))
    return probes or [_blocked("statistical_outlier_rate", "未识别到至少含 4 个可用数值的非标识字段。")]


# ------------------------------------------------------------------ literals
def file_parse_rate(attempted: int = 1, successful: int = 1) -> Probe:
    return Probe({}, metric_row(
        "file_parse_rate", value=F.lit(successful / attempted),
        evidence=evidence_json(attempted_file_count=attempted, successful_file_count=successful,
                               failed_file_count=attempted - successful)))


def missing_basis(metric_id: str) -> Probe:
    """A standard metric that one table alone cannot answer, with what is missing and which metrics come near."""
    m = catalog.METRICS[metric_id]
    none = F.expr("array()").cast("array<string>")
    proxies = F.array(*map(F.lit, m.proxies)) if m.proxies else none
    return _blocked(metric_id, catalog.not_assessable_reason(m), evidence_json(
        standard="DB31/T 1523-2024", standard_code=m.standard_code, standard_level=m.level, parent_metric_id=m.parent_id,
        formula=m.formula, score_direction=m.direction, available_proxy_metric_ids=proxies,
        proxy=F.struct(proxies.alias("metric_ids"), F.lit(False).alias("standard_equivalent")),
        reason_code=m.reason_code, required_inputs=list(m.required_inputs), method="not_assessable_without_required_context"))


def failed_metrics(spark, reason: str, ids: Iterable[str] | None = None) -> DataFrame:
    """Metric rows for an input that could not be read."""
    rows = []
    for i in catalog.select_metrics(ids):
        probe = file_parse_rate(1, 0) if i == "file_parse_rate" else _blocked(
            i, f"文件未成功解析，无法计算：{reason}")
        rows.append(probe.row)
    return literal_metrics(spark, rows)


# ------------------------------------------------------------------ dispatch
_SINGLE = {
    "dataset_scale": dataset_scale,
    "blank_record_rate": blank_record_rate,
    "recognizable_format_anomaly_rate": recognizable_format_anomaly_rate,
    "time_info_availability": time_info_availability,
    "source_info_coverage": source_info_coverage,
    "version_info_coverage": version_info_coverage,
}
_PER_COLUMN = {
    "field_missing_rate": (field_missing_rate, "数据集不包含字段，无法计算字段缺失率。"),
    "field_type_consistency": (field_type_consistency, "数据集不包含字段，无法计算字段类型一致率。"),
}
_GROUPED = ("exact_duplicate_rate", "normalized_duplicate_rate", "db31_030300", "db31_030400")


def row_local_probes(cells: Cells, ids: Iterable[str], reference_date: dt.date) -> list[Probe]:
    probes: list[Probe] = []
    for i in ids:
        if i in _SINGLE:
            probes += _SINGLE[i](cells)
        elif i in _PER_COLUMN:
            build, reason = _PER_COLUMN[i]
            probes += build(cells) if cells.columns else [_blocked(i, reason)]
        elif i == "update_lag_days":
            probes += update_lag_days(cells, reference_date)
        elif i == "statistical_outlier_rate":
            probes += outlier_probes(cells)
        elif i == "file_parse_rate":
            probes.append(file_parse_rate())
        elif i in catalog.STANDARD_IDS and i not in _GROUPED:
            probes.append(missing_basis(i))
    return probes


def calculate_metrics(
    df: DataFrame, reference_date: dt.date, ids: Iterable[str] | None = None,
) -> DataFrame:
    """All selected metrics of one table.

    Row-local metrics share one aggregate (one per 50 columns on wide tables); exact duplicates
    serve three metrics from one grouped pass; normalized duplicates take one more.
    """
    wanted = catalog.select_metrics(ids)
    cells = Cells(df)
    grouped = [i for i in wanted if i in _GROUPED]
    single = [i for i in wanted if i not in _GROUPED]
    frames = []
    if len(cells.columns) <= GROUP_COLUMNS:
        frames.append(run_probes(cells, row_local_probes(cells, single, reference_date)))
    else:
        wide = [i for i in single if i in _PER_COLUMN]
        frames.append(run_probes(cells, row_local_probes(
            cells, [i for i in single if i not in wide], reference_date)))
        for start in range(0, len(cells.columns), GROUP_COLUMNS):
            part = Cells(df)
            block = part.columns[start:start + GROUP_COLUMNS]
            frames.append(run_probes(part, [p for i in wide for p in _PER_COLUMN[i][0](part, block)]))
    if grouped:
        frames.append(duplicate_metrics(df, grouped))
    return union_all(frames) if frames else literal_empty(df.sparkSession)


def metric_frame(df: DataFrame, build, *args) -> DataFrame:
    """Result rows of one single-pass metric."""
    cells = Cells(df)
    return run_probes(cells, build(cells, *args))


def file_parse_metric(files: DataFrame) -> DataFrame:
    """Parse rate from one row per file with a ``readable`` flag."""
    n, ok = F.col("files"), F.col("ok")
    row = metric_row("file_parse_rate", value=ratio(ok, n), evidence=evidence_json(
        attempted_file_count=n, successful_file_count=ok, failed_file_count=n - ok),
        blockers=[(n == 0, "未提供文件。")])
    one = files.agg(F.count(F.lit(1)).alias("files"), F.count_if("readable").alias("ok"))
    return one.select(row.alias("m")).select("m.*")
