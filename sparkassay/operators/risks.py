"""Risk levels from metric rows and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import RULE_METRICS

# --- fixed values: risk rules (metric, rule id, direction, attention, warning, title) --------
# direction "high": attention above the limit, warning from the limit on; "low" the mirror image.
THRESHOLDS = (
    ("field_missing_rate", "high_field_missing_rate", "high", 0.10, 0.50, "字段缺失较多"),
    ("blank_record_rate", "blank_records_detected", "high", 0.01, 0.10, "发现空白记录"),
    ("field_type_consistency", "low_type_consistency", "low", 0.95, 0.80, "字段类型存在混杂"),
    ("recognizable_format_anomaly_rate", "format_anomalies_detected", "high", 0.00, 0.20, "发现可识别格式异常"),
    ("exact_duplicate_rate", "exact_duplicates_detected", "high", 0.00, 0.10, "发现完全重复记录"),
    ("normalized_duplicate_rate", "normalized_duplicates_detected", "high", 0.00, 0.10, "发现规范化重复记录"),
    ("time_info_availability", "low_time_availability", "low", 0.90, 0.50, "时间信息覆盖不足"),
    ("source_info_coverage", "low_source_coverage", "low", 0.90, 0.50, "来源信息覆盖不足"),
    ("version_info_coverage", "low_version_coverage", "low", 0.90, 0.50, "版本信息覆盖不足"),
)
LAG_ATTENTION_DAYS = 365
LAG_WARNING_DAYS = 730
RULE_VERSION = "0.3"
BUSINESS_METRICS = (*RULE_METRICS.values(), "business_update_time_parseability")

RISK_COLUMNS = (
    "risk_id", "rule_id", "level", "title", "metric_id", "metric_key", "field",
    "observed_name", "observed_value", "operator", "threshold",
)


def _result(df: DataFrame) -> DataFrame:
    suffix = F.when(F.col("field").isNotNull(), F.concat(F.lit(":"), "field")).otherwise(F.lit(""))
    return df.where(F.col("level").isNotNull()).withColumn(
        "risk_id", F.concat("rule_id", suffix)).select(*RISK_COLUMNS)


def threshold_risks(metrics: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """All two-level threshold rules as one broadcast join with a small threshold table."""
    spark = metrics.sparkSession
    limits = spark.createDataFrame(
        list(thresholds),
        "metric_id string, rule_id string, direction string, attention double, warning double, title string")
    exact = metrics.where(
        (F.col("metric_id") == "exact_duplicate_rate") & (F.col("status") == "evaluated")
    ).select(F.lit("normalized_duplicate_rate").alias("metric_id"), F.col("value").alias("exact_value"))
    v = F.col("observed_value")
    high = F.col("direction") == "high"
    at_warning = F.when(high, v >= F.col("warning")).otherwise(v <= F.col("warning"))
    at_attention = F.when(high, v > F.col("attention")).otherwise(v < F.col("attention"))
    graded = (
        _evaluated(metrics).join(F.broadcast(limits), "metric_id")
        # The normalized rate is judged by what it finds beyond the exact copies.
        .join(F.broadcast(exact), "metric_id", "left")
        .withColumn("observed_value", F.when(
            F.col("exact_value").isNotNull(), F.greatest(F.lit(0.0), F.col("value") - F.col("exact_value"))
        ).otherwise(F.col("value")))
        .withColumn("observed_name", F.when(
            F.col("exact_value").isNotNull(), F.lit("additional_duplicate_rate")).otherwise(F.col("metric_id")))
        .withColumn("title", F.when(
            F.col("exact_value").isNotNull(), F.lit("发现额外的规范化重复")).otherwise(F.col("title")))
        .withColumn("level", F.when(at_warning, F.lit("warning")).when(at_attention, F.lit("attention")))
        .withColumn("operator", F.when(
            F.col("level") == "warning", F.when(high, F.lit(">=")).otherwise(F.lit("<="))
        ).otherwise(F.when(high, F.lit(">")).otherwise(F.lit("<"))))
        .withColumn("threshold", F.when(F.col("level") == "warning", F.col("warning")).otherwise(F.col("attention")))
    )
    return _result(graded)


def _evaluated(metrics: DataFrame) -> DataFrame:
    return metrics.where((F.col("status") == "evaluated") & F.col("value").isNotNull())


def special_risks(metrics: DataFrame) -> DataFrame:
    """Rules that are not a pair of thresholds: parsing, empty input, update lag, outliers."""
    m, v = F.col("metric_id"), F.col("value")
    decide = lambda *pairs: F.coalesce(*[F.when(c, F.lit(x)) for c, x in pairs])
    parse = (m == "file_parse_rate") & (v < 1)
    empty = (m == "dataset_scale") & (v == 0)
    future = (m == "update_lag_days") & (v < 0)
    very_late = (m == "update_lag_days") & (v >= LAG_WARNING_DAYS)
    late = (m == "update_lag_days") & v.between(LAG_ATTENTION_DAYS, LAG_WARNING_DAYS - 1)
    outlier = (m == "statistical_outlier_rate") & (F.col("issue_count") > 0)
    cases = (parse, empty, future, very_late, late, outlier)

    def pick(*values):
        return decide(*zip(cases, values))

    graded = _evaluated(metrics).where(parse | empty | future | very_late | late | outlier)
    return _result(
        graded
        .withColumn("rule_id", pick("file_parse_failed", "empty_dataset", "future_update_date",
                                    "long_update_lag", "long_update_lag", "statistical_outliers_detected"))
        .withColumn("level", pick("warning", "warning", "attention", "warning", "attention", "info"))
        .withColumn("title", pick("文件未成功解析", "数据集不包含记录", "最近更新日期晚于评估日期",
                                  "距最近更新时间较长", "距最近更新时间较长", "数值字段存在统计异常值"))
        .withColumn("operator", pick("<", "==", "<", ">=", ">=", ">"))
        .withColumn("threshold", pick(1.0, 0.0, 0.0, float(LAG_WARNING_DAYS), float(LAG_ATTENTION_DAYS), 0.0))
        .withColumn("observed_name", F.when(outlier, F.lit("issue_count")).otherwise(m))
        .withColumn("observed_value", F.when(outlier, F.col("issue_count").cast("double")).otherwise(v)))


def generate_risks(metrics: DataFrame) -> DataFrame:
    return threshold_risks(metrics).unionByName(special_risks(metrics))


def business_risks(business_metrics: DataFrame) -> DataFrame:
    """A risk for every business rule that is not fully met; rows carry their ``rule_id``."""
    bad = _evaluated(business_metrics).where(F.col("value") < 1.0)
    return bad.select(
        F.concat(F.lit("business_rule_violation:"), "rule_id", F.lit(":"), "metric_id").alias("risk_id"),
        "rule_id", F.lit("attention").alias("level"), F.col("name").alias("title"),
        "metric_id", "metric_key", "field", F.col("metric_id").alias("observed_name"),
        F.col("value").alias("observed_value"), F.lit("<").alias("operator"),
        F.lit(1.0).alias("threshold"))
