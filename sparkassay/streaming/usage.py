"""Streaming variants of the log operators (Structured Streaming)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.logs import RATE_LIMIT, RATE_WINDOW_SECONDS, usage_measures
from ..session import scratch_path


def usage_stream(calls: DataFrame) -> DataFrame:
    """Running usage per provider and model (output mode complete or update)."""
    return calls.groupBy(
        X.safe_identity(F.col("provider")).alias("provider"), X.safe_identity(F.col("model")).alias("model"),
    ).agg(*usage_measures())


def rate_stream(
    calls: DataFrame, key: str, ts: str, limit: int = RATE_LIMIT, late: str = "5 minutes",
    width: str = "60 seconds", slide: str = "60 seconds",
) -> DataFrame:
    """Calls per key and time window, flagged over the limit; state is dropped after the watermark."""
    counted = calls.withWatermark(ts, late).groupBy(F.window(ts, width, slide), key).agg(
        F.count(F.lit(1)).alias("calls"))
    return counted.select(
        F.col("window.start").alias("window_start"), key, "calls", (F.col("calls") > limit).alias("over_limit"))


_STATE = "pending binary, recent array<bigint>"
_AT, _END, _SLOT, _OWN = "__at", "__end", "__slot", "__own"
#: A key's calls are dealt by slots of this length (at least the window).
SLOT_SECONDS = 3_600


def trailing_rate_stream(
    calls: DataFrame, key: str, ts: str, limit: int = RATE_LIMIT, seconds: int = RATE_WINDOW_SECONDS, late: str = "5 minutes",
) -> DataFrame:
    """The calls of a stream with calls_in_window and over_limit as ``trailing_rate`` has them, in output mode append.

    The state of a key and slot of time holds its calls above the watermark and the times of those in the window below it.  A
    call whose window reaches into the next slot is sent there too, to be counted but not answered, so no state grows with ``late``.  A call is
    answered once the watermark has passed it, when no earlier call can follow, by the slot's next batch or its timer.
    A column ``__end`` marks rows that only move the watermark.  Calls without a time have no answers; calls that are
    later than ``late`` are dropped, as with any watermark.
    """
    width = seconds * 1_000_000
    if _END not in calls.columns:
        calls = calls.withColumn(_END, F.lit(False))
    slot_width = max(SLOT_SECONDS * 1_000_000, width)
    slot = F.floor(F.col(_AT) / F.lit(slot_width)).cast("bigint")
    reaches = F.col(_AT) > (slot + 1) * F.lit(slot_width) - F.lit(width)
    place = lambda at, own: F.struct(at.alias(_SLOT), F.lit(own).alias(_OWN))
    fed = calls.withColumn(_AT, F.unix_micros(ts)).withWatermark(ts, late)
    fed = fed.select("*", F.explode(F.array_compact(F.array(place(slot, True), F.when(reaches, place(slot + 1, False))))).alias("__place")).select(
        *fed.columns, f"__place.{_SLOT}", f"__place.{_OWN}")
    names = [c for c in calls.columns if c != _END]
    out = T.StructType([*calls.select(*names).schema.fields, T.StructField("calls_in_window", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def step(_, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        below = state.getCurrentWatermarkMs() * 1000
        held, recent = None, np.zeros(0, np.int64)
        if state.exists:
            packed, kept = state.get
            recent = np.array(kept, np.int64)
            held = pa.ipc.open_stream(packed).read_pandas() if packed else None
        parts = [] if held is None else [held]
        if not state.hasTimedOut:
            parts += [b[~b[_END]] for b in batches]
        rows = pd.concat(parts, ignore_index=True) if parts else None
        if rows is not None and len(rows):
            timeless = rows[_AT].isna()
            ready = rows[~timeless & (rows[_AT] < below)]
            if timeless.any():
                yield rows.loc[timeless, names].assign(calls_in_window=pd.array([None] * int(timeless.sum()), "Int64"), over_limit=None)
            if len(ready):
                at = ready[_AT].to_numpy(np.int64)
                times = np.sort(np.concatenate((recent, at)))
                recent, mine = times, ready[ready[_OWN]]
                if len(mine):
                    at = mine[_AT].to_numpy(np.int64)
                    n = np.searchsorted(times, at, "right") - np.searchsorted(times, at - width, "right")
                    yield mine[names].assign(calls_in_window=n, over_limit=n > limit)
            rows = rows[~timeless & (rows[_AT] >= below)]
        recent = recent[recent > below - width]
        waiting = rows is not None and len(rows) > 0
        if not waiting and not len(recent):
            if state.exists:
                state.remove()
            return
        packed = b""
        if waiting:
            sink = pa.BufferOutputStream()
            table = pa.Table.from_pandas(rows, preserve_index=False)
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            packed = sink.getvalue().to_pybytes()
        state.update((packed, recent.tolist()))
        # The next call that waits, or the time from which the last one below the watermark is out of every window.
        due = int(rows[_AT].min()) if waiting else int(recent.max()) + width
        state.setTimeoutTimestamp(max(due // 1000 + 1, below // 1000 + 1))

    return fed.groupBy(key, _SLOT).applyInPandasWithState(step, out, _STATE, "append", "EventTimeTimeout")


def trailing_rate_table(
    spark: SparkSession, calls: DataFrame, key: str, ts: str, limit: int = RATE_LIMIT,
    seconds: int = RATE_WINDOW_SECONDS, late: str = "5 minutes",
) -> DataFrame:
    """The answers to all calls of a stream that has an end.

    What stands above the watermark when the input ends is answered as well: a second run on the same state reads one
    row from the far future, which moves the watermark past all calls.
    """
    ends = scratch_path(spark, "stream-end")
    spark.createDataFrame([], calls.schema).withColumn(_END, F.lit(True)).write.parquet(ends)
    schema = spark.read.parquet(ends).schema
    marked = calls.withColumn(_END, F.lit(False)).unionByName(spark.readStream.schema(schema).parquet(ends))
    answers = trailing_rate_stream(marked, key, ts, limit, seconds, late)
    target, state = scratch_path(spark, "rate"), scratch_path(spark, "rate-state")

    def run() -> None:
        answers.writeStream.outputMode("append").format("parquet").option("path", target).option(
            "checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    run()
    far = {ts: F.lit("2262-01-01").cast("timestamp"), _END: F.lit(True)}
    spark.range(1).select(*[far.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]).write.mode("append").parquet(ends)
    run()
    return spark.read.schema(answers.schema).parquet(target)


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Process everything available and return the result.

    The sink is a set of files below the shared folder; in complete mode each batch replaces the
    one before, so a restarted query ends with the same rows.
    """
    target, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id if mode == 'append' else 0}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", state).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(target).drop("batch")
