"""Exact quartiles of very large columns.

``percentile`` keeps every distinct value of a column in one task, so it does not scale.  Here
each pass counts values per bucket (a few thousand groups, merged map-side) and keeps only the
bucket that holds the wanted rank: first logarithmic buckets, then equal-width buckets inside
the one found, until it holds a single value.  Typical columns need two or three narrow scans,
and no pass shuffles more than the bucket counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import values as V
from ..plans.cells import Cells
from ..session import written

PER_OCTAVE = 8
BUCKETS = 4096


@dataclass(frozen=True)
class Quartiles:
    field: str
    q1: float = math.nan
    q3: float = math.nan
    lower: float = math.nan
    upper: float = math.nan
    problem: str | None = None


def _positions(n: int, q: float) -> tuple[int, int, float]:
    at = (n - 1) * q
    low = math.floor(at)
    return low, min(low + 1, n - 1), at - low


def _between(a: float, b: float, share: float) -> float:
    gap = b - a
    return a + gap * share if share < 0.5 else b - gap * (1 - share)


def _select_bucket(counts: DataFrame) -> DataFrame:
    """Per target: the bucket whose cumulative count passes the wanted rank."""
    w = W.partitionBy("field", "rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    return (
        counts.withColumn("upto", F.col("base") + F.sum("n").over(w))
        .where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        .select("field", "rank", "lo", "hi", (F.col("upto") - F.col("n")).alias("base"))
    )


def order_statistics(values: DataFrame, ranks: dict[str, set[int]]) -> dict[tuple[str, int], float]:
    """Exact values at 0-based ranks; ``values`` has columns (field, x) with finite doubles."""
    spark = values.sparkSession
    targets = spark.createDataFrame(
        [(f, r) for f, rs in ranks.items() for r in sorted(rs)], "field string, rank long")
    x = F.col("x")
    octave = F.when(x == 0, 0).otherwise(
        F.signum(x).cast("long") * (F.floor(F.log2(F.abs(x)) * PER_OCTAVE) + 1080 * PER_OCTAVE))
    first = (
        values.groupBy("field", octave.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        .join(F.broadcast(targets), "field").withColumn("base", F.lit(0).cast("long"))
    )
    found: dict[tuple[str, int], float] = {}
    open_ = _select_bucket(first).collect()
    while open_:
        found.update({(r.field, r.rank): r.lo for r in open_ if r.lo == r.hi})
        rest = [tuple(r) for r in open_ if r.lo != r.hi]
        if not rest:
            break
        state = spark.createDataFrame(
            rest, "field string, rank long, from_ double, to_ double, base long")
        width = (x - F.col("from_")) / (F.col("to_") - F.col("from_"))
        counts = (
            values.join(F.broadcast(state), "field")
            .where(x.between(F.col("from_"), F.col("to_")))
            .groupBy("field", "rank", "base",
                     F.least(F.floor(width * BUCKETS), F.lit(BUCKETS - 1)).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        )
        open_ = _select_bucket(counts).collect()
    return found


def quartiles(df: DataFrame, fields: list[str]) -> list[Quartiles]:
    """Quartiles and 1.5-IQR bounds of every field that is numeric enough (four finite numbers,
    80 % of the non-missing cells)."""
    if not fields:
        return []
    cells = Cells(df)
    stats_columns, numbers = [], [cells.number(c) for c in fields]
    for i, (c, x) in enumerate(zip(fields, numbers)):
        stats_columns += [
            F.count_if(~cells.missing(c)).alias(f"present_{i}"),
            F.count(x).alias(f"numeric_{i}"), F.count_if(V.is_finite(x)).alias(f"finite_{i}")]
    stats = cells.project().agg(*stats_columns).first()
    chosen = {
        c: stats[f"finite_{i}"] for i, c in enumerate(fields)
        if stats[f"finite_{i}"] >= 4 and stats[f"numeric_{i}"] >= 0.8 * stats[f"present_{i}"]
    }
    if not chosen:
        return []
    cells = Cells(df)  # the following scans read and parse the chosen columns only
    pairs = F.array(*[
        F.struct(F.lit(c).alias("field"), cells.number(c).alias("x")) for c in chosen])
    # Written once: no later pass parses the cells again.
    values = written(
        cells.project().select(F.explode(pairs).alias("p")).select("p.field", "p.x").where(V.is_finite(F.col("x"))), "numbers")
    wanted = {c: {p for q in (0.25, 0.75) for p in _positions(n, q)[:2]} for c, n in chosen.items()}
    at = order_statistics(values, wanted)
    results = []
    for c, n in chosen.items():
        q1, q3 = (
            _between(at[c, lo], at[c, hi], share)
            for lo, hi, share in (_positions(n, 0.25), _positions(n, 0.75)))
        iqr = q3 - q1
        lower, upper = q1 - 1.5 * iqr, q3 + 1.5 * iqr
        problem = None
        if not (math.isfinite(q1) and math.isfinite(q3)):
            problem = "数值范围过大，IQR 四分位数无法表示为有限数值。"
        elif not math.isfinite(iqr):
            problem = "数值范围过大，IQR 差值无法表示为有限数值。"
        elif not (math.isfinite(lower) and math.isfinite(upper)):
            problem = "数值范围过大，IQR 异常边界无法表示为有限数值。"
        results.append(Quartiles(c, q1, q3, lower, upper, problem))
    return results
