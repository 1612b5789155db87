"""Logs, scorecards, rule text, grounding and streaming on small inputs."""

import datetime as dt
import random
import re

import numpy as np
from pyspark.sql import functions as F

from sparkassay.operators import grounding as G
from sparkassay.operators import logs as L
from sparkassay.operators import report as RP
from sparkassay.operators import scorecard as S
from sparkassay.plans.skew import lookup_join
from sparkassay.sources import rule_text as T
from sparkassay.streaming import usage as U


def test_trailing_rate_matches_brute_force(spark):
    rng, base = random.Random(4), dt.datetime(2026, 1, 1)
    rows = [(i, "hot" if i % 3 else f"k{i % 5}", base + dt.timedelta(milliseconds=rng.randint(0, 400_000))) for i in range(500)]
    rows += [(900, "e", base), (901, "e", base + dt.timedelta(seconds=60)), (902, "e", base + dt.timedelta(seconds=59, microseconds=999999))]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp")
    got = {r.id: (r.calls_in_window, r.over_limit) for r in L.trailing_rate(df, "k", "ts", 30).collect()}
    for i, k, t in rows:
        n = sum(1 for _, k2, t2 in rows if k2 == k and t - dt.timedelta(seconds=60) < t2 <= t)
        assert got[i] == (n, n > 30)


def test_trailing_rate_of_a_hot_key_gathers_no_minute(spark):
    base = dt.datetime(2026, 1, 1, 0, 0, 30)
    df = spark.range(100_000).select(
        "id", F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 == 0, "cold").alias("k"),
        (F.lit(base).cast("timestamp") + F.make_dt_interval(secs=F.col("id") % 77 + (F.col("id") * 7919 % 1_000_000) / 1e6)).alias("ts"))
    got = L.trailing_rate(df, "k", "ts", 5)
    assert got.columns == ["id", "k", "ts", "calls_in_window", "over_limit"]
    rows = df.select("id", "k", F.unix_micros("ts").alias("t")).toPandas()
    found = got.toPandas().set_index("id")
    for _, part in rows.fillna("null").groupby("k"):
        times = np.sort(part.t.to_numpy())
        want = np.searchsorted(times, part.t, "right") - np.searchsorted(times, part.t - 60_000_000, "right")
        assert (found.loc[part.id].calls_in_window.to_numpy() == want).all()
    # No window function gets a key's minute: every window is over a part of a second, or over sums.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "rangeframe" not in plan.lower()


def brute_turns(turns):
    valid = [(t, r, x.strip()) for t, r, x in turns if r in ("user", "assistant") and 0 < len(x.strip()) <= 4000]
    kept, used = [], 0
    for t, r, x in reversed(valid[-20:]):
        cost = len(x) + (1 if used else 0)
        if r == "user" and used + cost > 4000:
            continue
        kept.append(t)
        used += cost if r == "user" else 0
    return sorted(kept)


def test_bounded_turns(spark):
    rng = random.Random(2)
    convs = {c: [(t, rng.choice(["user", "assistant", "system"]), "x" * rng.choice([0, 10, 900, 2500, 4000, 4001]))
                 for t in range(rng.randint(1, 40))] for c in range(30)}
    df = spark.createDataFrame([(c, *t) for c, ts in convs.items() for t in ts], "conv_id long, turn long, role string, text string")
    got = {}
    for r in L.bounded_turns(df).collect():
        got.setdefault(r.conv_id, []).append(r.turn)
    assert {c: sorted(v) for c, v in got.items()} == {c: b for c, t in convs.items() if (b := brute_turns(t))}


def test_transition_audit(spark):
    t = lambda s: dt.datetime(2026, 1, 1, 0, 0, s)
    log = spark.createDataFrame([
        ("ok", 1, "new", "draft", t(1), None), ("ok", 2, "draft", "done", t(2), "retry_same_request"),
        ("gap", 1, "new", "draft", t(1), "x"), ("gap", 3, "draft", "done", t(2), "x"),
        ("chain", 1, "draft", "done", t(5), "x"), ("chain", 2, "draft", "nowhere", t(4), "x"),
        ("twice", 1, "new", "draft", t(1), "x"), ("twice", 1, "new", "draft", t(1), "x"), ("twice", 2, "draft", "done", t(2), "x"),
        ("lost", 1, "new", "draft", t(1), "x"),
    ], "id string, seq int, from_state string, to_state string, at timestamp, reason string")
    allowed = spark.createDataFrame([("new", "draft"), ("draft", "done")], "from_state string, to_state string")
    current = spark.createDataFrame([("ok", "done", 1), ("gap", "done", 1), ("chain", "x", 0), ("twice", "done", 0), ("fresh", "new", 0), ("bare", "done", 0)], "id string, state string, retries int")
    got = sorted(tuple(r) for r in L.transition_audit(log, allowed, "new", current).collect())
    assert got == [("bare", "no log"), ("chain", "broken chain"), ("chain", "last state differs"), ("chain", "time goes back"),
                   ("chain", "transition not allowed"), ("chain", "wrong first state"),
                   ("gap", "gap in sequence"), ("gap", "retry count differs"), ("lost", "no current state"), ("twice", "repeated sequence number")]


def test_calls_without_time_and_attachments(spark):
    calls = spark.createDataFrame([(1, "k", None), (2, "k", None), (3, "k", dt.datetime(2026, 1, 1))], "id int, k string, ts timestamp")
    assert {r.id: (r.calls_in_window, r.over_limit) for r in L.trailing_rate(calls, "k", "ts", 0).collect()} == {1: (None, None), 2: (None, None), 3: (1, True)}
    turns = spark.createDataFrame([(1, 1, "user", "x" * 3000, None), (1, 2, "user", "y" * 3500, "attachment"), (1, 3, "user", "z" * 900, None)],
                                  "conv_id int, turn bigint, role string, text string, kind string")
    assert sorted(r.turn for r in L.bounded_turns(turns).collect()) == [1, 2, 3]
    assert sorted(r.turn for r in L.bounded_turns(turns.drop("kind")).collect()) == [1, 3]


def test_scorecard(spark):
    goldens = spark.createDataFrame([(1, "draft", ["a"], "{}"), (2, "refused", None, None), (3, "draft", ["b"], "{}")],
                                    "case_id int, expected_status string, expected_fields array<string>, expected_parameters string")
    results = spark.createDataFrame([(1, "m", True, "draft", ["a"], "{}", True, True), (2, "m", True, "refused", None, None, None, False)],
                                    "case_id int, label string, schema_valid boolean, status string, fields array<string>, "
                                    "parameters string, execution_consistent boolean, replay_consistent boolean")
    row = S.scorecard(results, goldens).first()
    assert (row.outcome_accuracy, row.field_accuracy, row.replay_rate) == (2 / 3, 0.5, 1 / 3)
    empty = S.scorecard(results, goldens.limit(0)).first()
    assert empty.outcome_accuracy == empty.field_accuracy == 1.0
    compared = S.compare_runs(results, goldens).first()
    assert (compared.case_count, compared.outcome_accuracy, compared.field_accuracy) == (3, 2 / 3, 0.5)
    assert {r.case_id: r.consistent for r in S.replay_consistency(results, results.limit(1), ["status"]).collect()} == {1: True, 2: False}


def test_rule_text(spark):
    df = spark.createDataFrame([(1, "- 规则1：名称必填\n\n名称必填\n2. 编号唯一")], "id int, text string")
    assert sorted((r.line_number, r.rule) for r in T.dialog_rules(df, "id", "text").collect()) == [(1, "名称必填"), (4, "编号唯一")]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(["# t", "* a", "```", "b", "```", "a", "c"], 1)],
                                  "path string, line_number int, line string")
    assert sorted((r.description, r.copies) for r in T.rule_lines(lines).collect()) == [("a", 1), ("c", 0)]
    table = spark.createDataFrame([(1, "x", "m"), (2, "x", "m"), (3, "x", None)], "n int, Rule string, metric string")
    assert sorted((r.metric or "", r.copies) for r in T.rule_table(table, "n").collect()) == [("", 0), ("m", 1)]


def test_grounding(spark):
    claims = spark.createDataFrame([("c1", 0.125, ["缺失率"]), ("c1", 8.0, ["问题数", "异常数"]), ("c2", 64.0, ["检查数"])],
                                   "citation_id string, value double, labels array<string>")
    statements = spark.createDataFrame([
        ("a", "缺失率为 12.5%。以下共有：问题数 8。", ["c1"]), ("a2", "缺失率为 12.5%，问题数 8。", ["c1"]), ("b", "缺失率为 12.6%。", ["c1"]), ("c", "检查数 64", ["c1"]),
        ("d", "检查数 64", ["c1", "c2"]), ("e", "没有数字", ["c1"]), ("f", "8 条，很远很远很远很远很远很远的异常数", ["c1"]),
        ("g", "缺失率 12%", ["c1"]), ("h", "缺失率 13%", ["c1"])], "statement_id string, text string, citation_ids array<string>")
    got = {r.statement_id: r.grounded for r in G.grounded_numbers(statements, claims).collect()}
    assert got == {"a": True, "a2": False, "b": False, "c": False, "d": True, "e": True, "f": False, "g": True, "h": True}
    bad = statements.limit(1).withColumn("citation_ids", F.array(F.lit("c2"), F.lit("zz"), F.lit("c1"), F.lit("c2")))
    assert [r.citation_id for r in G.invalid_citations(bad, claims).collect()] == ["zz"]
    assert G.normalize_citations(bad, claims).first().citation_ids == ["c2", "c1"]
    assert G.normalize_citations(bad, claims.limit(0)).first().citation_ids == ["report:summary"]


def plain_grounded(text, claims):
    """Every number by nested loops over all claims, labels and their places in the folded text."""
    folded, limit = text.casefold(), 12
    for number in re.finditer(r"(?<![\w.])[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?", text):
        bare, scale = number.group().replace(",", "").replace("%", ""), 100 if number.group().endswith("%") else 1
        value, tolerance = float(bare) / scale, max(1e-12, 0.5 * 10.0 ** -len(bare.partition(".")[2]) / scale + 1e-12)
        found = []
        for claim, labels in claims:
            for label in (x.casefold() for x in labels):
                for at in range(len(folded)) if label else ():
                    if folded.startswith(label, at):
                        gap = max(number.start() - at - len(label), at - number.end(), 0)
                        found.append((gap, abs(value - claim) > tolerance))
        if not found or min(found)[0] > limit or min(found)[1]:
            return False
    return True


def test_grounding_equals_nested_loops(spark):
    rng = random.Random(11)
    words = ["Aa", "aaa", "rate", "Straße", "rate of", "1x", "数量", "x", " ", "  ", ", ", "￿", "𝒳 ", "."]
    sources = {f"s{i}": [(float(rng.choice([5, 12, 0.5, 1000])), rng.sample(["aa", "RATE", "strasse", "rate of", "数", "", "5", "of 1"], rng.randint(0, 3)))
                         for _ in range(rng.randint(1, 4))] for i in range(6)}
    claims = [(c, v, labels) for c, pairs in sources.items() for v, labels in pairs] + [("s0", 1.0, None)]
    statements = []
    for i in range(300):
        text = "".join(rng.choice(words + ["5", "12%", "1,000", "0.5", "-5", "50%"]) for _ in range(rng.randint(0, 14)))
        statements.append((i, text, [rng.choice(["s0", "s0", *sources, "gone"]) for _ in range(rng.randint(0, 3))]))
    statements += [(900, "far " * 60_000 + "rate 5", ["s0"]), (901, None, ["s0"]), (902, "5", None)]
    df = spark.createDataFrame(statements, "statement_id int, text string, citation_ids array<string>")
    table = spark.createDataFrame(claims, "citation_id string, value double, labels array<string>")
    want = {i: plain_grounded(text or "", [c for s in set(cited or []) for c in sources.get(s, [])]) for i, text, cited in statements}
    for hot_rows in (1, 50, 1_000_000):
        rows = G.grounded_numbers(df, table, hot_rows=hot_rows, salts=4).collect()
        assert {r.statement_id: r.grounded for r in rows} == want
    assert 20 < sum(want.values()) < 280 and len(rows) == len(statements)
    assert not any(r.grounded for r in G.grounded_numbers(df, table.limit(0)).collect() if r.mentions)
    assert G.grounded_numbers(df.limit(0), table).count() == 0


def test_lookup_join_equals_a_plain_join(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(90)] + [("cold", 0), ("gone", 1), (None, 2)], "k string, n int")
    lookup = spark.createDataFrame([("hot", 1), ("hot", 2), ("cold", 3), ("none", 4)], "k string, v int")
    for how in ("inner", "left"):
        order = lambda df: sorted(map(str, df.select("k", "n", "v").collect()))
        assert order(lookup_join(rows, lookup, "k", how, hot_rows=50, salts=8)) == order(rows.join(lookup, "k", how))


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).select("id", (F.col("id") * 2).cast("string").alias("s"))
    a, b = (RP.table_fingerprint(x).first() for x in (df, df.orderBy(F.desc("id")).repartition(5)))
    assert a == b != RP.table_fingerprint(df.where("id <> 5")).first()


def test_streams(spark, data):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(data)
    calls = events.select(F.col("event_type").alias("provider"), F.lit("m").alias("model"), F.lit("success").alias("outcome"),
                          *[F.col("value").cast("int").alias(c) for c in ("input_tokens", "output_tokens", "latency_ms")])
    got = U.run_to_table(spark, U.usage_stream(calls), "usage", "complete")
    assert got.agg(F.sum("successes")).first()[0] == spark.read.parquet(f"{data}/events.parquet").count()


def test_stream_flags_equal_the_batch(spark, tmp_path):
    rng, base = random.Random(8), dt.datetime(2026, 1, 1)
    rows = [(i, rng.choice(["hot", "hot", "cold", None]), base + dt.timedelta(milliseconds=rng.randint(0, 300_000))) for i in range(400)] + [(900, "hot", None)]
    calls = spark.createDataFrame(rows, "id long, k string, ts timestamp")
    # Several batches in the order of time, so that the watermark passes calls while the stream still runs.
    for part in range(4):
        low, high = base + dt.timedelta(seconds=75 * part), base + dt.timedelta(seconds=75 * (part + 1))
        inside = (F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high))
        calls.where(inside | (F.col("ts").isNull() if part == 0 else F.lit(False)) | ((F.col("ts") >= F.lit(high)) if part == 3 else F.lit(False))).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = U.trailing_rate_table(spark, stream, "k", "ts", 30, late="10 seconds")
    want = L.trailing_rate(calls, "k", "ts", 30)
    order = lambda df: sorted(map(tuple, df.select("id", "k", "ts", "calls_in_window", "over_limit").collect()))
    assert order(got) == order(want)


def test_stream_state_is_held_by_slot(spark, tmp_path, monkeypatch):
    """Windows that reach over a slot's edge count the calls on both sides."""
    monkeypatch.setattr(U, "SLOT_SECONDS", 60)
    rng, base = random.Random(3), dt.datetime(2026, 1, 1)
    rows = [(i, rng.choice(["hot", None]), base + dt.timedelta(milliseconds=rng.randint(0, 200_000))) for i in range(200)] + [(900, "hot", None)]
    calls = spark.createDataFrame(rows, "id long, k string, ts timestamp")
    early = F.coalesce(F.col("ts") < F.lit(base + dt.timedelta(seconds=90)), F.lit(True))
    calls.where(early).coalesce(1).write.parquet(str(tmp_path / "in/0"))
    calls.where(~early).coalesce(1).write.parquet(str(tmp_path / "in/1"))
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    answers = U.trailing_rate_stream(stream, "k", "ts", 30, late="10 seconds")
    assert "__slot" in answers._jdf.queryExecution().analyzed().toString()
    order = lambda df: sorted(map(str, df.select("id", "k", "ts", "calls_in_window", "over_limit").collect()))
    assert order(U.trailing_rate_table(spark, stream, "k", "ts", 30, late="10 seconds")) == order(L.trailing_rate(calls, "k", "ts", 30))


def test_reordered_copy_has_no_fixed_number_of_tasks(spark, data):
    from checks import registry, rules  # noqa: F401
    made = registry.QUERIES["rpt11_fingerprints"](spark, data)
    plan = made._jdf.queryExecution().analyzed().toString()
    assert "RebalancePartitions" in plan and "RepartitionByExpression" not in plan
    assert made.first().same_when_reordered
