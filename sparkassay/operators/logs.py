"""Audits over logs: usage, request rate, state transitions, bounded conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..functions import values as V
from ..plans import skew
from ..session import written

# --- fixed values ------------------------------------------------------------------------
RATE_LIMIT = 120
RATE_WINDOW_SECONDS = 60
MAX_TURNS = 20
MAX_TURN_CHARS = 4000
MAX_USER_CHARS = 4000
RETRY_REASON = "retry_same_request"


def usage_measures() -> list:
    """Aggregates over calls (outcome, input_tokens, output_tokens, latency_ms); batch and stream."""
    outcome = F.col("outcome")
    total = lambda c: F.sum(X.bounded_int(F.col(c)))
    return [
        F.count_if(outcome != "rejected").alias("attempts"), F.count_if(outcome == "success").alias("successes"),
        F.count_if(outcome == "failure").alias("failures"), F.count_if(outcome == "rejected").alias("rejected"),
        total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"),
        total("latency_ms").alias("latency_ms")]


def usage_rollup(calls: DataFrame) -> DataFrame:
    return calls.groupBy(
        X.safe_identity(F.col("provider")).alias("provider"), X.safe_identity(F.col("model")).alias("model"),
    ).agg(*usage_measures())


def trailing_rate(
    calls: DataFrame, key: str, ts: str, limit: int = RATE_LIMIT, seconds: int = RATE_WINDOW_SECONDS,
) -> DataFrame:
    """Calls with the number of calls of their key in the last ``seconds``, and whether that
    exceeds the limit.  Calls without a time are in no window: both answers are null.

    The count is a difference of running totals.  Time is cut into slots as long as the window; the window of a call
    at t is its slot up to t, and the slot before after t minus the window, which is the same place there.  Running totals are nested: over
    the moments of a millisecond, the milliseconds of a second, and the seconds of a slot, of sums that every task has made
    beforehand.  So no task holds more than a thousand rows of a key together, however many calls the key has.
    """
    width = seconds * 1_000_000
    stamp = F.unix_micros(F.to_timestamp(F.col(ts).cast("timestamp_ntz")))
    calls = calls.withColumn("__key", F.struct(key)).withColumn("__at", stamp)  # a null key is a key of its own
    moments = calls.where("__at is not null").groupBy("__key", "__at").agg(F.count(F.lit(1)).alias("n"))
    # Both ends of every window, the earlier ones without calls of their own.
    ends = moments.unionByName(moments.select("__key", (F.col("__at") - width).alias("__at"), F.lit(0).cast("bigint").alias("n")))
    ends = ends.groupBy("__key", "__at").agg(F.sum("n").alias("n"))
    levels = {"__milli": F.floor(F.col("__at") / 1000), "__second": F.floor(F.col("__at") / 1_000_000), "__slot": F.floor(F.col("__at") / width)}
    ends = written(ends.withColumns(levels), "moments")

    def up_to(part: str, order: str, last: int) -> Column:
        window = W.partitionBy("__key", part).orderBy(order).rowsBetween(W.unboundedPreceding, last)
        return F.coalesce(F.sum("n").over(window), F.lit(0))

    millis = ends.groupBy("__key", "__milli", "__second", "__slot").agg(F.sum("n").alias("n"))
    secs = millis.groupBy("__key", "__second", "__slot").agg(F.sum("n").alias("n"))
    slots = secs.groupBy("__key", "__slot").agg(F.sum("n").alias("total"))
    before_milli = millis.select("__key", "__milli", up_to("__second", "__milli", -1).alias("before_milli"))
    before_second = secs.select("__key", "__second", up_to("__slot", "__second", -1).alias("before_second"))
    running = ends.withColumn("within", up_to("__milli", "__at", 0)).join(before_milli, ["__key", "__milli"]).join(
        before_second, ["__key", "__second"])
    running = written(running.select("__key", "__at", "__slot", (F.col("within") + F.col("before_milli") + F.col("before_second")).alias("so_far")), "running")
    start = running.select("__key", (F.col("__at") + width).alias("__at"), F.col("so_far").alias("earlier"))
    previous = slots.select("__key", (F.col("__slot") + 1).alias("__slot"), "total")
    counted = running.join(start, ["__key", "__at"]).join(previous, ["__key", "__slot"], "left").join(moments, ["__key", "__at"]).select(
        F.struct("__key", "__at").alias("__moment"), F.col("n").alias("group_size"),
        (F.col("so_far") + F.coalesce("total", F.lit(0)) - F.col("earlier")).alias("calls_in_window"))
    timed = calls.where("__at is not null").withColumn("__moment", F.struct("__key", "__at"))
    answered = skew.join_back(timed, counted, "__moment").drop("__moment", "group_size")
    untimed = calls.where("__at is null").withColumn("calls_in_window", F.lit(None).cast("bigint"))
    both = answered.unionByName(untimed).drop("__key", "__at")
    return both.withColumn("over_limit", F.col("calls_in_window") > limit)


def transition_audit(log: DataFrame, allowed: DataFrame, start: str, current: DataFrame) -> DataFrame:
    """(id, problem) for every break in a state log.

    ``log``: id, seq, from_state, to_state, at, reason; ``allowed``: from_state, to_state;
    ``current``: id, state, retries.  Each entry is joined with its predecessor by (id, seq), so a
    log of any length is spread over all tasks.  A retry is an entry whose reason says so.  A state
    other than ``start`` needs a log, and a log needs a state.  Of entries with one number the
    smallest counts; the repeat itself is a problem.
    """
    entry = F.struct("from_state", "to_state", "at")
    numbered = log.groupBy("id", "seq").agg(
        F.min(entry).alias("e"), F.count(F.lit(1)).alias("copies"),
        F.count_if(F.col("reason") == RETRY_REASON).alias("retries_here")).select("id", "seq", "copies", "retries_here", "e.*")
    before = numbered.select(
        "id", (F.col("seq") + 1).alias("seq"), F.col("to_state").alias("prev_state"), F.col("at").alias("prev_at"),
        F.lit(True).alias("has_prev"))
    pairs = allowed.select("from_state", "to_state", F.lit(True).alias("is_allowed")).distinct()
    entries = numbered.join(before, ["id", "seq"], "left").join(F.broadcast(pairs), ["from_state", "to_state"], "left")
    first = F.col("seq") == 1
    checks = {
        "gap in sequence": ~first & F.col("has_prev").isNull(),
        "repeated sequence number": F.col("copies") > 1,
        "wrong first state": first & (F.col("from_state") != start),
        "broken chain": ~first & F.col("has_prev").isNotNull() & (F.col("from_state") != F.col("prev_state")),
        "transition not allowed": F.col("is_allowed").isNull(),
        "time goes back": F.col("at") < F.col("prev_at"),
    }
    found = entries.select("id", F.explode(F.array_compact(F.array(*[
        F.when(F.coalesce(c, F.lit(False)), F.lit(p)) for p, c in checks.items()]))).alias("problem"))
    ends = numbered.groupBy("id").agg(
        F.max_by("to_state", "seq").alias("last_state"), F.sum("retries_here").alias("retried"), F.lit(True).alias("logged"))
    known = current.select("id", "state", "retries", F.lit(True).alias("known"))
    ended = ends.join(known, "id", "full")
    logged, known_state = F.col("logged").isNotNull(), F.col("known").isNotNull()
    end_checks = {
        "no log": ~logged & ~F.col("state").eqNullSafe(F.lit(start)),
        "no current state": ~known_state,
        "last state differs": logged & known_state & ~F.col("last_state").eqNullSafe(F.col("state")),
        "retry count differs": known_state & ~F.coalesce("retried", F.lit(0)).eqNullSafe(F.col("retries").cast("bigint")),
    }
    late = ended.select("id", F.explode(F.array_compact(F.array(*[
        F.when(c, F.lit(p)) for p, c in end_checks.items()]))).alias("problem"))
    return found.unionByName(late)


def bounded_turns(conversations: DataFrame) -> DataFrame:
    """Recent valid turns of each conversation within the character budget.

    Turns whose optional ``kind`` is ``attachment`` are kept without being charged to the budget.
    Only the newest twenty valid turns of a conversation reach its group; going back in time, a
    user turn that does not fit is skipped while older, shorter ones may still fit.
    """
    body = V.strip(F.col("text"))
    valid = (
        F.col("role").isin("user", "assistant") & (F.char_length(body) > 0)
        & (F.char_length(body) <= MAX_TURN_CHARS) & ~X.has_unsafe(body))
    charged = F.col("role") == "user"
    if "kind" in conversations.columns:
        charged = charged & ~F.col("kind").eqNullSafe(F.lit("attachment"))
    newest = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = (
        conversations.where(valid).select("conv_id", "turn", "role", body.alias("text"), charged.alias("charged"))
        .withColumn("age", F.row_number().over(newest)).where(F.col("age") <= MAX_TURNS))
    grouped = recent.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "age", "turn", F.col("charged").alias("user"), F.char_length("text").alias("n")))).alias("turns"))

    def step(state, t):
        cost = t["n"] + F.when(state["used"] > 0, 1).otherwise(0)
        keep = ~t["user"] | (state["used"] + cost <= MAX_USER_CHARS)
        return F.struct(
            (state["used"] + F.when(t["user"] & keep, cost).otherwise(0)).alias("used"),
            F.when(keep, F.array_append(state["kept"], t["turn"])).otherwise(state["kept"]).alias("kept"))

    start = F.struct(F.lit(0).alias("used"), F.expr("cast(array() as array<bigint>)").alias("kept"))
    kept = grouped.select("conv_id", F.explode(F.aggregate("turns", start, step, lambda s: s["kept"])).alias("turn"))
    return recent.drop("age", "charged").join(kept, ["conv_id", "turn"], "left_semi")
