"""Profile of a table: counts, inferred types and roles of its columns, and size checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, names
from ..functions import values as V
from ..plans.cells import Cells, flat_columns, ref, schema_types
from ..plans.probes import GROUP_COLUMNS, ratio, union_all

_SCHEMA = "name string, row_count bigint, missing_count bigint, non_missing_count bigint, inferred_type string"


def _inferred(counts: dict, present):
    """The type all non-missing cells share; text when they do not share one."""
    label = F.lit("text")
    for kind in ("datetime", "numeric", "boolean"):
        label = F.when(counts[kind] == present, F.lit(kind)).otherwise(label)
    return F.when(present == 0, F.lit("unknown")).otherwise(label)


def _column_counts(df: DataFrame, block: list[str]) -> DataFrame:
    cells = Cells(df)
    measures, rows = [F.count(F.lit(1)).alias("n")], []
    for i, c in enumerate(block):
        kind = cells.kind(c)
        measures.append(F.count(kind).alias(f"p{i}"))
        measures += [F.count_if(kind == k).alias(f"{k}{i}") for k in ("boolean", "numeric", "datetime")]
        present = F.col(f"p{i}")
        rows.append(F.struct(
            F.lit(c).alias("name"), F.col("n").alias("row_count"),
            (F.col("n") - present).alias("missing_count"), present.alias("non_missing_count"),
            _inferred({k: F.col(f"{k}{i}") for k in ("boolean", "numeric", "datetime")}, present).alias("inferred_type")))
    one = cells.project().agg(*measures)
    return one.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def infer_types(df: DataFrame) -> DataFrame:
    """Inferred type per column, all columns of a block in one aggregate."""
    columns = flat_columns(df)
    blocks = [columns[i:i + GROUP_COLUMNS] for i in range(0, len(columns), GROUP_COLUMNS)]
    if not blocks:
        return df.sparkSession.createDataFrame([], _SCHEMA)
    return union_all([_column_counts(df, b) for b in blocks])


def profile(df: DataFrame) -> DataFrame:
    """One row per column: counts, missing rate, inferred type, and roles from name and type."""
    roles = names.semantic_fields(flat_columns(df))
    by_name = {c: [r for r, cs in roles.items() if c in cs] for c in flat_columns(df)}
    named = F.lit(None).cast("array<string>")
    for c, rs in by_name.items():
        if rs:
            named = F.when(F.col("name") == c, F.array(*[F.lit(r) for r in rs])).otherwise(named)
    by_type = F.when(F.col("inferred_type") == "datetime", F.array(F.lit("date"))).when(
        F.col("inferred_type") == "numeric", F.array(F.lit("numeric")))
    none = F.expr("cast(array() as array<string>)")
    return infer_types(df).select(
        "*", ratio(F.col("missing_count"), F.col("row_count")).alias("missing_rate"),
        F.array_union(F.coalesce(named, none), F.coalesce(by_type, none)).alias("roles"))


def inferred_type_map(df: DataFrame) -> dict[str, str]:
    """Column -> inferred type on the driver (one short row per column)."""
    return {r["name"]: r["inferred_type"] for r in infer_types(df).collect()}


def warnings(df: DataFrame) -> list[str]:
    found = []
    if df.isEmpty():
        found.append("数据集不包含记录，无法对字段值进行进一步画像。")
    if not df.columns:
        found.append("数据集不包含字段。")
    return found


def size_limits(
    df: DataFrame, max_rows: int = fixed.MAX_DATASET_ROWS, max_columns: int = fixed.MAX_DATASET_COLUMNS,
    max_cells: int = fixed.MAX_DATASET_CELLS, max_cell_bytes: int = fixed.MAX_TEXT_CELL_BYTES,
) -> DataFrame:
    """Size of a table against limits: one row per limit with the observed number."""
    types = schema_types(df)
    columns = flat_columns(df)
    large = [F.count_if(F.octet_length(F.col(ref(c))) > max_cell_bytes) for c in columns if V.is_text(types[c])]
    total = F.lit(0).cast("bigint")
    one = df.agg(F.count(F.lit(1)).alias("n"), *[m.alias(f"large_{i}") for i, m in enumerate(large)])
    for i in range(len(large)):
        total = total + F.col(f"large_{i}")
    n, width = F.col("n"), F.lit(len(columns)).cast("bigint")
    rows = [("rows", n, max_rows), ("columns", width, max_columns), ("cells", n * width, max_cells),
            ("large_text_cells", total, 0)]
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(label).alias("limit_name"), seen.alias("observed"),
                 F.lit(limit).cast("bigint").alias("allowed"), (seen > limit).alias("exceeded"))
        for label, seen, limit in rows])).alias("r")).select("r.*")
