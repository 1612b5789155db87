"""Operators over result tables: differences, projection, summaries, safe copies, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..plans.catalog import RULE_METRICS
from ..plans.cells import flat_columns, ref, schema_types
from ..plans.probes import METRIC_SCHEMA
from ..plans.skew import digest, lookup_join

LEVELS = ("warning", "attention", "info")
_METRIC_COLUMNS = [f.name for f in METRIC_SCHEMA]


def level_rank(level: Column) -> Column:
    return F.when(level == "warning", 0).when(level == "attention", 1).when(level == "info", 2).otherwise(99)


# ------------------------------------------------------------------ not assessable, differences
def not_assessable(metrics: DataFrame) -> DataFrame:
    has_field = F.col("field").isNotNull()
    return metrics.where("status = 'not_assessable'").select(
        F.when(has_field, F.concat_ws(":", "metric_id", "field")).otherwise(F.col("metric_id")).alias("id"),
        F.when(has_field, F.concat("name", F.lit("（"), "field", F.lit("）"))).otherwise(F.col("name")).alias("name"),
        F.coalesce("reason", F.lit("当前无法计算。")).alias("reason"), "metric_key")


def rule_diff(base: DataFrame, enhanced: DataFrame, key: str = "metric_key") -> DataFrame:
    """Rows of the enhanced table whose key the base table does not have."""
    return enhanced.join(base.select(key).distinct(), key, "left_anti")


def rule_diff_counts(base_metrics, enhanced_metrics, base_risks, enhanced_risks, locations) -> DataFrame:
    """One row of counts of what a rule run added."""
    added = rule_diff(base_metrics, enhanced_metrics)
    located = locations.join(added.select("metric_key"), "metric_key", "left_semi")

    def tagged(df, label, condition=None):
        part = df if condition is None else df.where(condition)
        return part.select(F.lit(label).alias("kind"))

    rows = (
        tagged(added, "added_metrics")
        .unionAll(tagged(added, "added_evaluated_metrics", "status = 'evaluated'"))
        .unionAll(tagged(added, "added_not_assessable", "status = 'not_assessable'"))
        .unionAll(tagged(rule_diff(base_risks, enhanced_risks, "risk_id"), "added_risks"))
        .unionAll(tagged(located, "added_issue_locations"))
    )
    kinds = ("added_metrics", "added_evaluated_metrics", "added_not_assessable", "added_risks", "added_issue_locations")
    return rows.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def project_to_catalog(metrics: DataFrame, business: DataFrame) -> DataFrame:
    """Let bound rule results fill their catalog metrics; identity and order stay."""
    result_metric = F.lit(None).cast("string")
    for rule_type, metric_id in RULE_METRICS.items():
        result_metric = F.when(F.col("rule_type") == rule_type, F.lit(metric_id)).otherwise(result_metric)
    bound = business.where(F.col("target").isNotNull() & (F.col("metric_id") == result_metric)).select(
        F.col("target").alias("metric_id"), F.lit(True).alias("__bound"),
        *[F.col(c).alias(f"__{c}") for c in ("status", "value", "unit", "checked_count", "issue_count", "evidence", "reason")])
    joined = metrics.join(F.broadcast(bound), "metric_id", "left")  # at most 100 rules
    return joined.select(*[
        F.when(F.col("__bound"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if f"__{c}" in joined.columns else F.col(c)
        for c in _METRIC_COLUMNS])


def enhanced_metrics(metrics: DataFrame, business: DataFrame) -> DataFrame:
    return project_to_catalog(metrics, business).unionByName(business.select(*_METRIC_COLUMNS))


def baseline_changes(base: DataFrame, enhanced: DataFrame, targets: list[str]) -> DataFrame:
    """Base rows that a rule run altered although no rule was bound to them (must be empty)."""
    unbound = ~F.col("metric_id").isin(targets) if targets else F.lit(True)
    return base.where(unbound).exceptAll(enhanced.where(unbound).select(*base.columns))


# ------------------------------------------------------------------ summaries, top-k
def report_summary(metrics: DataFrame, risks: DataFrame, column_count: int) -> DataFrame:
    """One row: sizes, distinct metric ids, result and risk counts (levels without risks are 0)."""
    evaluated = F.col("status") == "evaluated"
    m = metrics.agg(
        F.max(F.when(F.col("metric_id") == "dataset_scale", F.col("value"))).cast("bigint").alias("row_count"),
        F.lit(column_count).cast("bigint").alias("column_count"),
        F.count_distinct("metric_id").alias("metric_definition_count"),
        F.count_distinct(F.when(evaluated, F.col("metric_id"))).alias("evaluated_metric_definition_count"),
        F.count(F.lit(1)).alias("metric_result_count"), F.count_if(evaluated).alias("evaluated_metric_result_count"),
        F.count_if(~evaluated).alias("not_assessable_count"))
    r = risks.agg(F.count(F.lit(1)).alias("risk_count"), *[
        F.count_if(F.col("level") == level).alias(f"{level}_count") for level in LEVELS])
    return m.withColumn("__one", F.lit(1)).join(r.withColumn("__one", F.lit(1)), "__one").drop("__one")


def risk_level_counts(risks: DataFrame) -> DataFrame:
    """Number of risks per level, zeros kept."""
    levels = risks.sparkSession.createDataFrame([(x, i) for i, x in enumerate(LEVELS)], "level string, rank int")
    return (
        levels.join(risks.groupBy("level").agg(F.count(F.lit(1)).alias("n")), "level", "left")
        .select("level", "rank", F.coalesce("n", F.lit(0)).alias("risk_count")))


def metric_rows(metrics: DataFrame) -> DataFrame:
    """Metric table for readers."""
    return metrics.select(
        "position", "name", F.coalesce("field", F.lit("—")).alias("field"), "category", "scope", "status",
        X.format_metric_value(F.col("value"), F.col("unit"), F.col("status")).alias("result"),
        F.coalesce("reason", F.lit("—")).alias("reason"))


def priority_risks(risks: DataFrame, limit: int = 5) -> DataFrame:
    """The most severe risks (a top-k report)."""
    if not 1 <= limit <= 10:
        raise ValueError("limit must be 1 to 10")
    return risks.orderBy(level_rank(F.col("level")), "risk_id").limit(limit)


def top_not_assessable(items: DataFrame, limit: int = 10) -> DataFrame:
    if not 1 <= limit <= 20:
        raise ValueError("limit must be 1 to 20")
    return items.orderBy("metric_key").limit(limit)


def lookup(table: DataFrame, key: str, value: str) -> DataFrame:
    """The row of one metric (``metric_key``) or risk (``risk_id``); an error if there is none."""
    found = table.where(F.col(key) == value)
    if found.isEmpty():
        raise KeyError(value)
    return found


def risk_metric_links(risks: DataFrame, metrics: DataFrame) -> DataFrame:
    """(risk_id, metric_key) for risks that name keys, else for all metrics with a named id.

    ``risks`` has array columns ``related_metric_keys`` and ``related_metrics``; unknown keys are
    dropped and each link occurs once.

    What risks name is made distinct before it meets the metrics, so that links, which are many more, need no grouping.
    Only a risk with rows of both kinds can yield a link twice; its named keys are taken out of the other kind.
    """
    keys = metrics.select("metric_key", "metric_id").dropDuplicates(["metric_key"])
    named = F.size("related_metric_keys") > 0
    by_key = risks.where(named).select("risk_id", F.explode("related_metric_keys").alias("metric_key"))
    by_id = risks.where(~named).select("risk_id", F.explode("related_metrics").alias("metric_id"))
    both = (risks.groupBy(F.col("risk_id").alias("__risk")).agg(F.bool_or(named).alias("__named"), F.bool_or(~named).alias("__open"))
            .where("__named AND __open").select("__risk"))
    again = (by_key.join(both, F.col("risk_id").eqNullSafe(F.col("__risk")), "left_semi")
             .select(F.col("risk_id").alias("__risk"), F.col("metric_key").alias("__key")))
    of_ids = lookup_join(by_id.distinct(), keys, "metric_id").select("risk_id", "metric_key")
    return (
        lookup_join(by_key.distinct(), keys.select("metric_key"), "metric_key").select("risk_id", "metric_key")
        .unionByName(of_ids.join(again, F.col("risk_id").eqNullSafe(F.col("__risk")) & (F.col("metric_key") == F.col("__key")), "left_anti")))


def action_plan(risks: DataFrame, items: DataFrame) -> DataFrame:
    """Up to four actions: the three most severe risks, then the first metric without a basis."""
    priority = F.when(F.col("level") == "warning", "high").when(F.col("level") == "attention", "medium").otherwise("low")
    from_risks = priority_risks(risks, 3).select(
        priority.alias("priority"), F.concat(F.lit("复核“"), "title", F.lit("”")).alias("title"),
        F.concat(F.lit("risk:"), "risk_id").alias("citation_id"))
    from_items = top_not_assessable(items, 1).select(
        F.lit("medium").alias("priority"), F.concat(F.lit("补充“"), "name", F.lit("”所需依据")).alias("title"),
        F.concat(F.lit("not_assessable:"), "metric_key").alias("citation_id"))
    return from_risks.unionByName(from_items)


# ------------------------------------------------------------------ safe copies
def safe_metrics(metrics: DataFrame, terms: list[str]) -> DataFrame:
    """Metrics with whitelisted evidence and protected terms hidden; one row per key."""
    hidden = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    hide = lambda c, n: X.redact_terms(F.col(c), hidden, n)
    status = F.when(F.col("status") == "evaluated", "evaluated").otherwise("not_assessable")
    first = metrics.groupBy("metric_key").agg(F.min_by(F.struct(*metrics.columns), "position").alias("m")).select("m.*")
    return first.select(
        F.concat(F.lit("metric:"), "metric_key").alias("citation_id"), "metric_key",
        hide("metric_id", 150).alias("metric_id"), hide("name", 200).alias("name"), hide("category", 100).alias("category"),
        status.alias("status"), "scope", hide("field", 200).alias("field"),
        F.when(V.is_finite(F.col("value")), F.col("value")).alias("value"), hide("unit", 50).alias("unit"),
        F.when(status == "not_assessable", X.safe_reason(hide("reason", 500))).alias("reason"),
        X.whitelist_evidence(F.col("evidence")).alias("evidence"))


# ------------------------------------------------------------------ fingerprints
def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive fingerprint of a table: row count, XOR and sum of the record hashes.

    Both halves of a SHA-256 record digest are combined, so equal fingerprints of different
    tables are not to be expected.
    """
    types = schema_types(df)
    key = digest([V.exact_key(F.col(ref(c)), types[c]) for c in flat_columns(df)])
    high = F.conv(F.substring(F.hex(key), 1, 15), 16, 10).cast("bigint")
    low = F.conv(F.substring(F.hex(key), 16, 15), 16, 10).cast("bigint")
    return df.select(high.alias("h"), low.alias("l")).agg(
        F.count(F.lit(1)).alias("row_count"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("xor_high"),
        F.coalesce(F.bit_xor("l"), F.lit(0)).alias("xor_low"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("sum_high"))


def file_fingerprints(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(
        "path", "length", F.sha2("content", 256).alias("sha256"))


def report_fingerprint(metrics: DataFrame) -> DataFrame:
    """SHA-256 over the metric rows (a few per column) in their canonical order."""
    rows = metrics.select(F.struct(
        F.col("position"), F.coalesce("field", F.lit("")).alias("field"),
        F.to_json(F.struct(*[c for c in _METRIC_COLUMNS]), {"ignoreNullFields": "false"}).alias("row")).alias("r"))
    return rows.agg(F.sha2(F.array_join(F.transform(
        F.array_sort(F.collect_list("r")), lambda r: r["row"]), "\n"), 256).alias("report_sha256"))


def rows_fingerprint(df: DataFrame) -> DataFrame:
    """One row: a hash of the multiset of rows, in any order, summed map-side."""
    row = F.sha2(F.to_json(F.struct(*[F.col(ref(c)) for c in df.columns]), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("string")
    return df.select(part(1).alias("h"), part(16).alias("l")).agg(
        F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), total("h"), total("l")), 256).alias("sha256"))


def whole_report_fingerprint(tables: dict[str, DataFrame]) -> DataFrame:
    """SHA-256 that changes with any row of any table of the report, risks and open items included."""
    parts = report_fingerprint(tables["metrics"]).select(F.lit("metrics").alias("name"), F.col("report_sha256").alias("sha256"))
    for name in sorted(set(tables) - {"metrics"}):
        parts = parts.unionByName(rows_fingerprint(tables[name]).select(F.lit(name).alias("name"), "sha256"))
    lines = F.array_sort(F.collect_list(F.concat_ws("=", "name", "sha256")))
    return parts.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("report_sha256"))
