"""Query registration, table loading and SQL fragments shared by the checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkassay.functions import fixed
from sparkassay.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the equivalent for DuckDB, where one exists."""
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return register


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf.rstrip('/')}/{table}.parquet")


# ------------------------------------------------------------------ views with injected faults
# The given tables hold no missing or malformed cells.  These views cover every row of a table
# and damage some cells by fixed rules; the same text runs in Spark and in DuckDB.
def _cell(expression: str) -> str:
    return f"CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE ({expression}) END"


DIRTY_ORDERS = f"""
SELECT o_orderkey AS record_id,
  {_cell("CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_custkey % 11 = 0 THEN '  ' ELSE o_orderpriority END")} AS department,
  {_cell("CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 101 = 0 THEN 'inf' ELSE CAST(o_totalprice AS STRING) END")} AS total_amount,
  {_cell("CASE WHEN o_orderkey % 19 = 0 THEN 'soon' WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', '/') WHEN o_orderkey % 4 = 1 THEN substr(CAST(o_orderdate AS STRING), 1, 19) ELSE concat(' ', substr(CAST(o_orderdate AS STRING), 1, 10)) END")} AS update_time,
  {_cell("CASE WHEN o_orderkey % 9 = 0 THEN 'no address' WHEN o_orderkey % 10 = 3 THEN NULL WHEN o_orderkey % 33 = 0 THEN 'http://[::1' ELSE concat('https://data.example.org/orders/', CAST(o_orderkey AS STRING)) END")} AS source_url,
  {_cell("CASE WHEN o_orderkey % 8 = 0 THEN 'nobody' WHEN o_orderkey % 15 = 0 THEN ' ' ELSE concat('user', CAST(o_custkey AS STRING), '@example.org') END")} AS contact_email,
  {_cell("CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'draft' ELSE concat('v1.', CAST(o_custkey % 10 AS STRING)) END")} AS version,
  {_cell("CASE WHEN o_orderkey % 6 = 0 THEN '是' WHEN o_orderkey % 6 = 1 THEN 'YES' WHEN o_orderkey % 6 = 2 THEN '12' WHEN o_orderkey % 6 = 3 THEN 'maybe' WHEN o_orderkey % 6 = 4 THEN '2024-02-30' ELSE 'no' END")} AS flag
FROM orders
""".strip()

DIRTY_PARTS = """
SELECT p_partkey AS part_id,
  CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 5 = 0 THEN concat(' ', replace(p_name, ' ', '-'), '! ')
       WHEN p_partkey % 31 = 0 THEN '' WHEN p_partkey % 37 = 0 THEN ' ' ELSE p_name END AS title,
  CASE WHEN p_partkey % 4 = 0 THEN lower(p_type) ELSE p_type END AS kind,
  p_size % 5 AS size_class
FROM part
""".strip()

DIRTY_COLUMNS = ("department", "total_amount", "update_time", "source_url", "contact_email", "version", "flag")
REFERENCE_DATE = "2026-07-17"


def dirty_orders(spark, sf):
    return spark.sql(DIRTY_ORDERS.replace("FROM orders", "FROM {orders}"), orders=load(spark, sf, "orders"))


def dirty_parts(spark, sf):
    return spark.sql(DIRTY_PARTS.replace("FROM part", "FROM {part}"), part=load(spark, sf, "part"))


# ------------------------------------------------------------------ DuckDB fragments
SPACES = " || ".join(f"chr({ord(c)})" for c in fixed.SPACE_CHARS)


def d_strip(c):
    return f"trim({c}, {SPACES})"


def d_missing(c):
    return f"({c} IS NULL OR {d_strip(c)} = '')"


def d_number(c):
    s = d_strip(c)
    return (
        f"CASE WHEN regexp_matches({s}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') "
        f"THEN TRY_CAST({s} AS DOUBLE) "
        f"WHEN regexp_matches(lower({s}), '^[+]?(inf|infinity)$') THEN CAST('inf' AS DOUBLE) "
        f"WHEN regexp_matches(lower({s}), '^-(inf|infinity)$') THEN CAST('-inf' AS DOUBLE) END"
    )


def d_finite(c):
    return f"coalesce(isfinite({d_number(c)}), false)"


def d_date(c):
    s = d_strip(c)
    return (
        f"CASE WHEN regexp_matches({s}, '^[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}([ T][0-9:]+)?$') "
        f"THEN TRY_CAST(replace({s}, '/', '-') AS TIMESTAMP) END"
    )


def d_url(c):
    s = d_strip(c)
    host = f"regexp_extract({s}, '(?i)^https?://([^/?#]*)', 1)"
    return f"coalesce({host} <> '' AND contains({host}, '[') = contains({host}, ']'), false)"


def d_email(c):
    return f"coalesce(regexp_matches({d_strip(c)}, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$'), false)"


def d_kind(c):
    s = d_strip(c)
    return (
        f"CASE WHEN {d_missing(c)} THEN NULL WHEN lower({s}) IN ('true','false','yes','no','是','否') THEN 'boolean' "
        f"WHEN ({d_number(c)}) IS NOT NULL THEN 'numeric' WHEN ({d_date(c)}) IS NOT NULL THEN 'datetime' ELSE 'text' END"
    )


def d_ratio(part, whole):
    return f"round_even(CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE), 6)"


def d_casefold(c):
    return f"replace(lower({c}), 'ß', 'ss')"


def shown(metrics: DataFrame) -> DataFrame:
    """The comparable part of metric rows."""
    return metrics.select(
        "metric_id", F.coalesce("field", F.lit("")).alias("field"), "status", "value",
        F.coalesce("checked_count", F.lit(-1)).cast("long").alias("checked_count"),
        F.coalesce("issue_count", F.lit(-1)).cast("long").alias("issue_count"))


def d_metric(metric, field, value, checked, issues, status="'evaluated'"):
    return (f"SELECT '{metric}' AS metric_id, '{field}' AS field, {status} AS status, "
            f"CAST({value} AS DOUBLE) AS value, CAST({checked} AS BIGINT) AS checked_count, "
            f"CAST({issues} AS BIGINT) AS issue_count")


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def joined(locations: DataFrame) -> DataFrame:
    """Locations with lists as text."""
    return locations.select(
        "metric_key", "record_number", F.concat_ws(",", "fields").alias("fields"), "issue_type",
        F.concat_ws(",", F.transform("related_record_numbers", lambda x: x.cast("string"))).alias("related"))
