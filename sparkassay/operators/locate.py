"""Record numbers and the location of every violating record."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import names
from ..plans.cells import Cells, flat_columns, ref
from ..plans.probes import Probe, Violation
from ..plans.skew import HOT_ROWS, join_back, with_record_key
from ..session import written

RN = "record_number"
LOCATION_COLUMNS = ("metric_key", RN, "fields", "issue_type", "related_record_numbers")


def with_record_number(df: DataFrame, name: str = RN) -> DataFrame:
    """1-based position of every record of a scan: files in the order of their paths, records as they stand.

    Spark's row id counts inside each input split.  A split holds blocks of files, each in one
    piece, so a record's place in its block is its row id less the block's smallest.  Adding the
    rows of earlier blocks (by path and block start) needs one narrow count and a list of one entry
    per block, and no shuffle of the data; the numbers do not depend on how files were dealt into
    splits.  Use it directly on a scan, before any shuffle or filter.  Frames that are no file scan
    are numbered split by split.
    """
    row_id = F.monotonically_increasing_id()
    try:
        df.select("_metadata.file_path").schema  # noqa: B018
        block = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                         F.spark_partition_id().alias("part"))  # a path may be given twice
    except AnalysisException:
        block = F.struct(F.lit("").alias("path"), F.lit(0).cast("bigint").alias("start"), F.spark_partition_id().alias("part"))
    marked = df.withColumn("__block", block).withColumn("__row_id", row_id)
    sizes = marked.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__row_id").alias("__first"))
    before = F.sum("__n").over(W.orderBy("__at").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.withColumnRenamed("__block", "__at").select("__at", "__first", F.coalesce(before, F.lit(0)).alias("__offset"))
    return (
        marked.join(F.broadcast(offsets), F.col("__block") == F.col("__at"))
        .select(*[F.col(ref(c)) for c in df.columns], (F.col("__offset") + F.col("__row_id") - F.col("__first") + 1).alias(name))
    )


def _fields(fields: list[str] | Column) -> Column:
    return fields if isinstance(fields, Column) else F.array(*[F.lit(f) for f in fields])


def locate(cells: Cells, violations: list[Violation], numbered: DataFrame) -> DataFrame:
    """One row per violating record and violation, all from one pass over the table."""
    hits = []
    for v in violations:
        kind = v.issue_type if isinstance(v.issue_type, Column) else F.lit(v.issue_type)
        hits.append(F.when(F.coalesce(v.predicate, F.lit(False)), F.struct(
            F.lit(v.metric_key).alias("metric_key"), _fields(v.fields).alias("fields"),
            kind.alias("issue_type"))))
    # array_compact drops the records' passed checks before anything is exploded.
    found = cells.project(numbered).select(RN, F.explode(F.array_compact(F.array(*hits))).alias("hit"))
    return found.select(
        "hit.metric_key", RN, "hit.fields", "hit.issue_type",
        F.expr("cast(array() as array<bigint>)").alias("related_record_numbers"))


def issue_locations(cells: Cells, probes: list[Probe], numbered: DataFrame | None = None) -> DataFrame:
    numbered = with_record_number(cells.df) if numbered is None else numbered
    return locate(cells, [v for p in probes for v in p.violations], numbered)


def duplicate_locations(
    df: DataFrame, normalized: bool = False, numbered: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every later copy of a record, related to the first one.

    Records are dealt over all tasks before their keys are computed, however few splits the scan has, and the
    (number, key) pairs are written once, so that no key is computed again for the groups or the hot ones.
    """
    content = names.content_columns(flat_columns(df))
    numbered = with_record_number(df) if numbered is None else numbered
    dealt = numbered.select(RN, *[F.col(ref(c)) for c in content]).repartition(RN)
    rows = written(with_record_key(dealt, content, normalized).select(RN, "key"), "record-keys")
    groups = (
        rows.groupBy("key").agg(F.count(F.lit(1)).alias("group_size"), F.min(RN).alias("first_record"))
        .where("group_size > 1")
    )
    kind = "normalized_duplicate" if normalized else "exact_duplicate"
    members = join_back(rows, groups, "key", hot_rows=hot_rows)
    return members.where(F.col(RN) > F.col("first_record")).select(
        F.lit(names.metric_key(f"{kind}_rate")).alias("metric_key"), RN,
        F.array(*[F.lit(c) for c in content]).alias("fields"),
        F.lit(f"{kind}_record").alias("issue_type"),
        F.array("first_record").alias("related_record_numbers"))


def type_locations(cells: Cells, metrics: DataFrame, numbered: DataFrame | None = None) -> DataFrame:
    """Cells whose type is not the dominant one of their column.

    The dominant types are read from the metric rows (one per column); the table is then passed
    once, and only violating cells are emitted.
    """
    rows = metrics.where("metric_id = 'field_type_consistency' and status = 'evaluated'").select(
        "field", "metric_key", F.get_json_object("evidence", "$.dominant_type").alias("dominant")).collect()
    violations = [
        Violation(r.metric_key, "inconsistent_type", [r.field], cells.kind(r.field) != r.dominant) for r in rows]
    return locate(cells, violations, with_record_number(cells.df) if numbered is None else numbered)


def first_n_locations(locations: DataFrame, n: int = 20) -> DataFrame:
    """The first records of a report (a top-k, not a sample)."""
    return locations.orderBy(RN, "metric_key").limit(n)
