"""Checks that statements cite existing evidence and quote its numbers correctly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from ..functions import values as V
from ..plans.skew import HOT_ROWS, SALTS, lookup_join
from ..session import written

# --- fixed values: words that may name a number -----------------------------------------
METRIC_LABELS = {
    "file_parse_rate": ("文件可解析率", "解析率"),
    "dataset_scale": ("数据规模", "记录数"),
    "field_missing_rate": ("字段缺失率", "缺失率"),
    "blank_record_rate": ("空白记录率", "空白记录", "为空"),
    "field_type_consistency": ("字段类型一致率", "类型一致率", "主要类型一致率"),
    "recognizable_format_anomaly_rate": ("可识别格式异常率", "格式异常率"),
    "exact_duplicate_rate": ("完全重复率", "完全重复", "重复率"),
    "normalized_duplicate_rate": ("规范化重复率", "规范化重复", "重复率"),
    "time_info_availability": ("时间信息可用率", "可解析时间", "时间信息"),
    "update_lag_days": ("更新滞后天数", "更新滞后", "最近更新"),
    "source_info_coverage": ("来源信息覆盖率", "来源覆盖率", "来源信息"),
    "version_info_coverage": ("版本信息覆盖率", "版本覆盖率", "版本信息"),
    "statistical_outlier_rate": ("统计异常值比例", "统计异常率", "统计异常值"),
}
EVIDENCE_LABELS = {
    "attempted_file_count": ("尝试文件数",), "successful_file_count": ("成功文件数",),
    "failed_file_count": ("失败文件数",), "available_count": ("可用数", "可用数量"),
    "file_count": ("文件数",), "row_count": ("记录数", "数据行数"), "column_count": ("字段数", "列数"),
    "checked_count": ("检查数", "已检查", "检查记录数"),
    "issue_count": ("问题数", "异常数", "报告统计", "统计异常"),
    "non_finite_count": ("非有限数值数", "非有限数值"), "covered_count": ("覆盖数", "已覆盖"),
    "duplicate_group_count": ("重复组数", "重复组"), "q1": ("Q1", "下四分位数"), "q3": ("Q3", "上四分位数"),
    "iqr": ("IQR", "四分位距"), "lower_bound": ("下界",), "upper_bound": ("上界",),
    "additional_duplicate_rate": ("额外重复率", "额外", "规范化重复"),
    "absolute_lag_days": ("晚于", "晚", "相差天数"),
}
SUMMARY_LABELS = {
    "row_count": ("记录数", "数据行数"), "column_count": ("字段数", "列数"),
    "metric_definition_count": ("类指标", "指标种类", "指标定义"),
    "evaluated_metric_definition_count": ("已评估指标种类",),
    "metric_result_count": ("指标结果", "指标结果数"),
    "evaluated_metric_result_count": ("已评估指标结果",),
    "risk_count": ("风险数", "风险提示", "风险"), "warning_count": ("警告数", "警告"),
    "attention_count": ("关注数", "关注"), "info_count": ("提示数", "提示"),
    "not_assessable_count": ("无法评估数", "无法评估"),
}
SUMMARY_CITATION = "report:summary"


def _labels(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


# ------------------------------------------------------------------ claims
def metric_claims(metrics: DataFrame) -> DataFrame:
    """(citation_id, value, labels) for every number a metric row supports."""
    own = F.lit(None).cast("array<string>")
    for metric_id, words in METRIC_LABELS.items():
        own = F.when(F.col("metric_id") == metric_id, _labels(words)).otherwise(own)
    evidence = F.try_parse_json("evidence")

    def number(path: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(evidence, path, "variant"))
        plain = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        return F.when(plain, F.try_variant_get(evidence, path, "double"))

    claims = [F.struct(F.col("value").alias("value"), F.array_distinct(F.array_compact(F.concat(
        F.array("name"), F.coalesce(own, F.expr("cast(array() as array<string>)"))))).alias("labels"))]
    for key, words in EVIDENCE_LABELS.items():
        claims.append(F.struct(number(f"$.{key}").alias("value"), _labels(words).alias("labels")))
    counts = F.from_json(F.coalesce(
        F.try_variant_get(evidence, "$.type_counts", "string"), F.lit("{}")), "map<string,bigint>")
    typed = F.transform(F.map_entries(counts), lambda e: F.struct(
        e["value"].cast("double").alias("value"),
        F.array(F.concat(e["key"], F.lit(" 类型数")), F.concat(e["key"], F.lit(" 数量"))).alias("labels")))
    every = F.concat(F.array(*claims), F.coalesce(typed, F.expr("cast(array() as array<struct<value:double,labels:array<string>>>)")))
    return metrics.select(
        F.concat(F.lit("metric:"), "metric_key").alias("citation_id"), F.explode(every).alias("c"),
    ).select("citation_id", "c.value", "c.labels").where(V.is_finite(F.col("value")))


def risk_claims(risks: DataFrame) -> DataFrame:
    """Observed value and threshold of each risk decision."""
    observed = F.lit(None).cast("array<string>")
    for name, words in {**EVIDENCE_LABELS, **METRIC_LABELS}.items():
        observed = F.when(F.col("observed_name") == name, _labels(words)).otherwise(observed)
    pairs = F.array(
        F.struct(F.col("observed_value").alias("value"), observed.alias("labels")),
        F.struct(F.col("threshold").cast("double").alias("value"), _labels(("阈值", "门槛")).alias("labels")))
    return risks.select(F.concat(F.lit("risk:"), "risk_id").alias("citation_id"), F.explode(pairs).alias("c")).select(
        "citation_id", "c.value", "c.labels").where(V.is_finite(F.col("value")) & F.col("labels").isNotNull())


def summary_claims(summary: DataFrame) -> DataFrame:
    pairs = F.array(*[
        F.struct(F.col(k).cast("double").alias("value"), _labels(words).alias("labels"))
        for k, words in SUMMARY_LABELS.items() if k in summary.columns])
    return summary.select(F.lit(SUMMARY_CITATION).alias("citation_id"), F.explode(pairs).alias("c")).select(
        "citation_id", "c.value", "c.labels").where(F.col("value").isNotNull())


# ------------------------------------------------------------------ numbers
def mention_rows(statements: DataFrame, reach: Column) -> DataFrame:
    """(statement_id, citation_ids, numbers): of each number its place, value and tolerance, and ``reach`` characters of
    the case-folded text on either side of it.  No later step needs the text itself."""
    # One pass of the pattern marks the numbers, so that pieces are gaps and numbers by turns.  The mark is no character.
    free = F.translate("text", "\uffff", "\ufffe")
    pieces = F.split(F.regexp_replace(free, X.MENTION, "\uffff$0\uffff"), "\uffff", -1)
    marked = statements.select("statement_id", "citation_ids", V.casefold(F.col("text")).alias("folded"),
                               F.coalesce(pieces, F.array()).alias("pieces"), reach.alias("reach"))
    # A number starts after all pieces before it; one walk adds them up.
    none = F.expr("cast(array() as array<struct<start: int, text: string>>)")
    empty = F.struct(F.lit(False).alias("number"), F.lit(0).alias("at"), none.alias("found"))
    found = F.aggregate("pieces", empty, lambda s, t: F.struct(
        (~s["number"]).alias("number"), (s["at"] + F.char_length(t)).alias("at"),
        F.when(s["number"], F.concat(s["found"], F.array(F.struct(s["at"].alias("start"), t.alias("text"))))).otherwise(
            s["found"]).alias("found")), lambda s: s["found"])

    def near(m: Column, place: Column) -> Column:
        end = m["start"] + F.char_length(m["text"])
        first = F.greatest(m["start"] - F.col("reach"), F.lit(0))
        parsed = X.mention(m["text"])
        return F.struct(
            place.alias("place"), F.substring("folded", first + 1, m["start"] - first).alias("left"),
            F.substring("folded", m["start"] + 1, end - m["start"]).alias("inside"),
            F.substring("folded", end + 1, F.col("reach")).alias("right"),
            parsed["value"].alias("value"), parsed["tolerance"].alias("tolerance"))

    return marked.select("statement_id", "citation_ids", "folded", "reach", found.alias("found")).select(
        "statement_id", "citation_ids", F.transform("found", near).alias("numbers"))


def label_distance(left: Column, inside: Column, right: Column, label: Column, backwards: Column) -> Column:
    """Characters between a number and the nearest occurrence of a label in the text near it; 0 if they overlap, null if
    there is none.  ``backwards`` is the label read from its end."""
    n = F.char_length(label)
    around = F.concat(F.right(left, n - 1), inside, F.substring(right, F.lit(1), n - 1))
    before = F.nullif(F.instr(F.reverse(left), backwards), F.lit(0)) - 1
    after = F.nullif(F.instr(right, label), F.lit(0)) - 1
    return F.when(F.instr(around, label) > 0, F.lit(0)).otherwise(F.least(before, after))


def grounded_numbers(
    statements: DataFrame, claims: DataFrame, hot_rows: int = HOT_ROWS, salts: int = SALTS,
) -> DataFrame:
    """(statement_id, mentions, grounded): every number must equal, at its written precision, a
    claim of a cited source whose label is the nearest one and within twelve characters.

    ``statements`` has (statement_id, text, citation_ids).  A label further away than that decides nothing, so
    a number takes along only the text near it, as far as the longest label and the distance reach.  Statements are
    searched for numbers once and staged.  A source cited by very many statements is spread over ``salts`` tasks; only
    numbers with a label in reach leave the join.  A null text has no numbers.
    """
    limit = fixed.MAX_LABEL_DISTANCE
    # Folding turns a character into three at most.
    longest = claims.select(F.max(F.array_max(F.transform("labels", F.char_length))).alias("n")).scalar()
    mentions = written(mention_rows(statements, F.coalesce(longest, F.lit(0)) * 3 + limit), "numbers")
    # One row per label: expressions over plain columns are compiled, lambdas over arrays are not.
    claimed = claims.select("citation_id", F.col("value").alias("claim"), F.explode(F.array_distinct("labels")).alias("label"))
    claimed = claimed.select("citation_id", "claim", V.casefold(F.col("label")).alias("label")).where("label <> ''")
    claimed = claimed.withColumn("backwards", F.reverse("label"))
    cited = mentions.select("statement_id", F.explode(F.array_distinct("citation_ids")).alias("citation_id"), "numbers")
    numbers = lookup_join(cited, claimed, "citation_id", hot_rows=hot_rows, salts=salts).select(
        "statement_id", "claim", "label", "backwards", F.explode("numbers").alias("m")).select(
        "statement_id", "claim", "label", "backwards", "m.*")
    distance = label_distance(*[F.col(c) for c in ("left", "inside", "right", "label", "backwards")])
    wrong = F.abs(F.col("value") - F.col("claim")) > F.col("tolerance")
    nearest = (
        numbers.select("statement_id", "place", distance.alias("distance"), wrong.alias("wrong"))
        .where(F.col("distance") <= limit).groupBy("statement_id", "place")
        .agg(F.min(F.struct("distance", "wrong")).alias("best"))
    )
    supported = nearest.groupBy("statement_id").agg(F.count_if(~F.col("best.wrong")).alias("supported"))
    total = mentions.select("statement_id", F.size("numbers").cast("bigint").alias("mentions"))
    return total.join(supported, "statement_id", "left").select(
        "statement_id", "mentions", (F.coalesce("supported", F.lit(0)) == F.col("mentions")).alias("grounded"))


# ------------------------------------------------------------------ citations
def invalid_citations(statements: DataFrame, citations: DataFrame) -> DataFrame:
    """(statement_id, citation_id) of citations that do not exist."""
    cited = statements.select("statement_id", F.explode(F.array_distinct("citation_ids")).alias("citation_id"))
    known = citations.select("citation_id").distinct().withColumn("known", F.lit(True))
    return lookup_join(cited, known, "citation_id", "left").where("known is null").select("statement_id", "citation_id")


def normalize_citations(statements: DataFrame, citations: DataFrame, fallback: str = SUMMARY_CITATION) -> DataFrame:
    """Drop unknown citations; a statement left without any cites the summary."""
    cited = statements.select("statement_id", F.posexplode("citation_ids").alias("place", "citation_id"))
    known = citations.select("citation_id").distinct()
    kept = (
        lookup_join(cited, known, "citation_id")
        .groupBy("statement_id").agg(F.array_sort(F.collect_list(F.struct("place", "citation_id"))).alias("kept")))
    ids = F.array_distinct(F.transform("kept", lambda k: k["citation_id"]))
    return statements.drop("citation_ids").join(kept, "statement_id", "left").withColumn(
        "citation_ids", F.coalesce(ids, F.array(F.lit(fallback)))).drop("kept")
