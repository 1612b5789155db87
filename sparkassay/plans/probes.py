"""Merging many metrics into as few aggregates as possible."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..functions import values as V
from .catalog import METRICS
from .cells import Cells

# Columns per aggregate: keeps generated code below the JVM's method limits.  Each group of
# columns is its own scan that reads only those columns.
GROUP_COLUMNS = 50

METRIC_SCHEMA = T.StructType([
    T.StructField("metric_id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("unit", T.StringType()),
    T.StructField("scope", T.StringType()), T.StructField("field", T.StringType()),
    T.StructField("metric_key", T.StringType()),
    T.StructField("checked_count", T.LongType()), T.StructField("issue_count", T.LongType()),
    T.StructField("evidence", T.StringType()), T.StructField("reason", T.StringType()),
    T.StructField("position", T.LongType()),
])


@dataclass(frozen=True)
class Violation:
    """Records where a row-local predicate holds; ``fields`` may depend on the record."""
    metric_key: str
    issue_type: str | Column
    fields: list[str] | Column
    predicate: Column


@dataclass
class Probe:
    """Aggregates one metric needs, the result row built on them, and its violations."""
    aggregates: dict[str, Column]
    row: Column
    violations: list[Violation] = field(default_factory=list)


def evidence_json(**items) -> Column:
    parts = []
    for name, item in items.items():
        if isinstance(item, (list, tuple)):
            item = F.array(*[F.lit(x) for x in item]) if item else F.expr("array()").cast("array<string>")
        elif not isinstance(item, Column):
            item = F.lit(item)
        parts.append(item.alias(name))
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def metric_row(
    metric_id: str, *, value: Column, scope: str = "dataset", field_name: str | None = None,
    checked: Column | None = None, issues: Column | None = None, evidence: Column | None = None,
    blockers: list[tuple[Column, str]] = (), name: str | None = None, category: str | None = None,
    unit: str | None = None, position: int | None = None, key: str | None = None, basis: Column | None = None,
) -> Column:
    """One metric as a struct.  ``blockers`` are (condition, reason) pairs checked in order; ``basis`` is the
    evidence of a metric that cannot be assessed."""
    known = METRICS.get(metric_id)
    open_, reason = None, _constant("reason", None)
    if blockers:
        text = F.lit(None)
        for condition, why in reversed(list(blockers)):
            text = F.when(condition, F.lit(why)).otherwise(text)
        reason = text.cast("string").alias("reason")
        open_ = text.isNull()

    def if_open(column: Column | None, name: str, kind: str) -> Column:
        if column is None:
            return _constant(name, None, kind)
        return (column if open_ is None else F.when(open_, column)).cast(kind).alias(name)

    status = _constant("status", "evaluated") if open_ is None else F.when(
        open_, F.lit("evaluated")).otherwise(F.lit("not_assessable")).alias("status")
    return F.struct(
        _constant("metric_id", metric_id), _constant("name", name or known.name),
        _constant("category", category or (known.category if known else "业务规则")), status,
        if_open(value, "value", "double"), if_open(_constant("unit", unit or (known.unit if known else "ratio")), "unit", "string"),
        _constant("scope", scope), _constant("field", field_name),
        _constant("metric_key", key or names.metric_key(metric_id, field_name if scope == "field" else None)),
        if_open(checked, "checked_count", "bigint"), if_open(issues, "issue_count", "bigint"),
        if_open(evidence, "evidence", "string") if basis is None else basis.cast("string").alias("evidence"), reason,
        _constant("position", known.position if position is None else position, "bigint"))


def _constant(name: str, value, kind: str = "string") -> Column:
    """A typed literal; one call to the JVM instead of three."""
    if value is None:
        return F.expr(f"cast(null as {kind}) as {name}")
    if isinstance(value, str):
        quoted = value.replace("\\", "\\\\").replace("'", "\\'")
        return F.expr(f"'{quoted}' as {name}")
    return F.expr(f"cast({value} as {kind}) as {name}")


def literal_metrics(spark, rows: list[Column]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*rows)).alias("m")).select("m.*")


def run_probes(cells: Cells, probes: list[Probe]) -> DataFrame:
    """One aggregate over one scan for all probes; a metric row each."""
    if not probes:
        return literal_empty(cells.df.sparkSession)
    columns = {n: c for p in probes for n, c in p.aggregates.items()}
    if not columns:
        return literal_metrics(cells.df.sparkSession, [p.row for p in probes])
    one = cells.project().agg(*[c.alias(n) for n, c in columns.items()])
    return one.select(F.explode(F.array(*[p.row for p in probes])).alias("m")).select("m.*")


def literal_empty(spark) -> DataFrame:
    return spark.createDataFrame([], METRIC_SCHEMA)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def ratio(part: Column, whole: Column) -> Column:
    return V.round_value(F.try_divide(part.cast("double"), whole.cast("double")))
