"""Sinks: report tables, issue locations and summary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.report import metric_rows, risk_level_counts, rule_diff, whole_report_fingerprint

# --- fixed values: display names of issue types --------------------------------------------
ISSUE_LABELS = {
    "missing_value": "字段值缺失",
    "blank_record": "空白记录",
    "inconsistent_type": "字段类型不一致",
    "invalid_format": "格式异常",
    "exact_duplicate_record": "完全重复记录",
    "normalized_duplicate_record": "规范化后重复记录",
    "missing_or_invalid_time": "时间信息缺失或不可解析",
    "missing_source_info": "来源信息缺失",
    "missing_version_info": "版本信息缺失",
    "statistical_outlier": "统计异常值",
    "rule_primary_key_missing": "主键缺失",
    "rule_primary_key_duplicate": "主键重复",
    "rule_required_missing": "必填字段缺失",
    "rule_update_time_missing_or_invalid": "更新时间缺失或不可解析",
    "rule_allowed_value_violation": "不在允许值范围",
    "rule_numeric_range_violation": "超出数值范围",
}


def _duplicate_note(kind: str, how: str):
    return F.when((F.col("issue_type") == kind) & (F.col("related") != ""), F.format_string(
        f"第 %s 条记录与第 %s 条记录{how}；关联记录序号 %s 表示这组重复数据中首次出现的记录。",
        F.col("record_number").cast("string"), F.col("related"), F.col("related")))


def issue_location_rows(locations: DataFrame, metrics: DataFrame) -> DataFrame:
    """Locations as spreadsheet-safe text; record numbers below 1 are dropped."""
    label = F.col("issue_type")
    for kind, shown in ISSUE_LABELS.items():
        label = F.when(F.col("issue_type") == kind, F.lit(shown)).otherwise(label)
    related = F.array_join(F.transform(F.filter("related_record_numbers", lambda n: n > 0), lambda n: n.cast("string")), "、")
    # The metric table has a few rows per column of the assessed table.
    keyed = metrics.select("metric_key", F.col("name").alias("metric_name"), F.col("field").alias("metric_field"))
    rows = (
        locations.where("record_number >= 1").withColumn("related", related)
        .join(F.broadcast(keyed.dropDuplicates(["metric_key"])), "metric_key"))
    fields = F.when(F.size("fields") > 0, F.array_join("fields", "、")).otherwise(
        F.coalesce("metric_field", F.lit("整条记录")))
    note = F.coalesce(
        _duplicate_note("exact_duplicate_record", "内容完全相同"),
        _duplicate_note("normalized_duplicate_record", "在忽略自然文本中的大小写、空白和标点差异后相同"), F.lit(""))
    return rows.select(
        X.spreadsheet_safe(label).alias("issue_type"), X.spreadsheet_safe(F.col("metric_name")).alias("metric_name"),
        X.spreadsheet_safe(fields).alias("fields"), "record_number",
        F.when(F.col("related") == "", "—").otherwise(F.col("related")).alias("related_records"), note.alias("note"))


def write_issue_locations(locations: DataFrame, metrics: DataFrame, path: str) -> None:
    """CSV parts, one per task; nothing is gathered."""
    issue_location_rows(locations, metrics).write.mode("errorifexists").option("header", True).csv(path)


def rule_issue_location_rows(locations: DataFrame, base_metrics: DataFrame, enhanced: DataFrame) -> DataFrame:
    """Locations of the metrics that a rule run added."""
    added = rule_diff(base_metrics, enhanced)
    own = locations.join(F.broadcast(added.select("metric_key").distinct()), "metric_key", "left_semi")
    return issue_location_rows(own, added)


def write_rule_issue_locations(locations, base_metrics, enhanced, path: str) -> None:
    rule_issue_location_rows(locations, base_metrics, enhanced).write.mode("errorifexists").option("header", True).csv(path)


def write_report(tables: dict[str, DataFrame], path: str, file_format: str = "json") -> None:
    """One folder per result table plus a hash over all of them.

    Numbers that JSON cannot hold never reach the files: metric values are finite or null.
    """
    if "metrics" not in tables:
        raise ValueError("a report needs its metrics table")
    for name, df in tables.items():
        df.write.mode("errorifexists").format(file_format).save(f"{path}/{name}")
    whole_report_fingerprint(tables).write.mode("errorifexists").json(f"{path}/fingerprint")


def summary_tables(metrics: DataFrame, profile: DataFrame, risks: DataFrame) -> dict[str, DataFrame]:
    return {
        "metrics": metric_rows(metrics),
        "profile": profile.select("name", "inferred_type", "missing_count", "non_missing_count", "missing_rate"),
        "risk_levels": risk_level_counts(risks),
    }
