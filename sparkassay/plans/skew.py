"""Key grouping and join-back that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.names import field_matches
from .cells import Cells, ref

# A group of this many rows or more is salted.  At most rows / HOT_ROWS groups can be hot, so
# the broadcast list of hot keys stays small: one million entries for 5 * 10^12 rows.
HOT_ROWS = 5_000_000
SALTS = 64


def with_record_key(
    df: DataFrame, columns: list[str], normalized: bool = False, name: str = "key",
) -> DataFrame:
    """Add one key per record over ``columns``.

    A single fixed-width column is its own key.  Otherwise the key is the SHA-256 digest of the
    length-prefixed cell texts, so that 32 bytes per record are shuffled however wide the record.
    """
    cells = Cells(df)
    if len(columns) == 1 and cells.text(columns[0]) is None:
        return df.withColumn(name, F.struct(V.exact_key(*cells.raw(columns[0]))))
    if not normalized:
        return df.withColumn(name, digest([V.exact_key(*cells.raw(c)) for c in columns]))
    parts = []
    for c in columns:
        named, s = field_matches("structured", c), cells.text(c)
        kind = None if named or s is None else cells.kind(c)
        parts.append(V.normalized_key(*cells.raw(c), named, s, kind))
    return cells.project().withColumn(name, digest(parts))


def digest(parts: list[Column]) -> Column:
    cells = []
    for p in parts:
        text = p.cast("string")
        cells.append(F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("~")))
    return F.unhex(F.sha2(F.concat_ws("|", *cells), 256))


def count_groups(keyed: DataFrame, key: str) -> DataFrame:
    """Rows per key.  Partial aggregation merges a hot key inside each input task."""
    return keyed.groupBy(key).agg(F.count(F.lit(1)).alias("group_size"))


def join_back(
    rows: DataFrame, groups: DataFrame, key: str, size: str = "group_size",
    hot_rows: int = HOT_ROWS, salts: int = SALTS,
) -> DataFrame:
    """Inner join of rows with their group; rows of a hot group are spread over ``salts`` tasks."""
    is_hot = F.col(size) >= hot_rows
    hot = groups.where(is_hot).select(F.col(key).alias("__hot_key"))
    spread = F.pmod(F.xxhash64(*[F.col(ref(c)) for c in rows.columns if c != key]), F.lit(salts)).cast("int")
    marked = (
        rows.join(F.broadcast(hot), F.col(key) == F.col("__hot_key"), "left")
        .withColumn("__salt", F.when(F.col("__hot_key").isNotNull(), spread).otherwise(0))
        .drop("__hot_key")
    )
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return marked.join(groups.withColumn("__salt", F.explode(copies)), [key, "__salt"]).drop("__salt")


def lookup_join(
    rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", hot_rows: int = HOT_ROWS, salts: int = SALTS,
) -> DataFrame:
    """Join many rows with the few entries of each key when a key may be hot among ``rows``.

    One narrow pass counts the rows of each key.  Only keys of ``hot_rows`` rows or more are dealt over ``salts``
    tasks, and only their entries are copied; at most rows / ``hot_rows`` keys are broadcast.
    """
    hot = rows.groupBy(F.col(key).alias("__hot_key")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= hot_rows).select("__hot_key")
    dealt = F.pmod(F.xxhash64(*[F.col(ref(c)) for c in rows.columns if c != key]), F.lit(salts)).cast("int")
    is_hot = F.col("__hot_key").isNotNull()
    marked = (rows.join(F.broadcast(hot), F.col(key) == F.col("__hot_key"), "left")
              .withColumn("__salt", F.when(is_hot, dealt).otherwise(0)).drop("__hot_key"))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    entries = (lookup.join(F.broadcast(hot), F.col(key) == F.col("__hot_key"), "left")
               .withColumn("__salt", F.explode(copies)).drop("__hot_key"))
    return marked.join(entries, [key, "__salt"], how).drop("__salt")
