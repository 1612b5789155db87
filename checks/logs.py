"""EVL and LOG rows, batch and streaming."""

from pyspark.sql import functions as F

from sparkassay.operators import logs as L
from sparkassay.operators import scorecard as S
from sparkassay.operators.rules import dry_run
from sparkassay.sources import rule_text as T
from sparkassay.streaming import usage as U

from .metrics import REF
from .registry import check, dirty_orders, load
from .rules import ROW_RULES

# Golden answers and results of a run, derived from the labelled documents: the run fails on
# some documents and lacks others.
GOLD = """SELECT doc_id AS case_id, CASE WHEN quality = 1 THEN 'draft' ELSE 'refused' END AS expected_status, toxic FROM labels"""
RUN = """SELECT doc_id AS case_id, lang AS label, doc_id % 5 <> 0 AS schema_valid, CASE WHEN doc_id % 3 = 0 THEN 'refused' ELSE 'draft' END AS status,
  n_chars % 2 = 0 AS even, doc_id % 4 <> 0 AS replay FROM documents"""
J = f"""SELECT g.*, r.label, coalesce(schema_valid, false) AS s, coalesce(status = expected_status, false) AS o, coalesce(even, false) AS f,
  coalesce(toxic = 0, false) AND r.case_id IS NOT NULL AS p, coalesce(replay, false) AS y FROM ({GOLD}) g LEFT JOIN ({RUN}) r USING (case_id)"""
# Every label is judged on every golden case, whether it answered it or not.
EACH = J.replace("g.*, r.label", "g.*, l.label").replace(f"({GOLD}) g", f"({GOLD}) g CROSS JOIN (SELECT DISTINCT label FROM ({RUN})) l").replace(
    "USING (case_id)", "ON r.case_id = g.case_id AND r.label = l.label")
CARD = """count(*) AS case_count, coalesce(avg(CAST(s AS INT)), 1.0) AS schema_valid_rate, coalesce(avg(CAST(o AS INT)), 1.0) AS outcome_accuracy,
  coalesce(avg(CAST(f AS INT)) FILTER (expected_status = 'draft'), 1.0) AS field_accuracy, coalesce(avg(CAST(p AS INT)) FILTER (expected_status = 'draft'), 1.0) AS parameter_accuracy,
  coalesce(avg(CAST(y AS INT)) FILTER (expected_status = 'draft'), 1.0) AS execution_consistency, coalesce(avg(CAST(y AS INT)), 1.0) AS replay_rate"""


def goldens(spark, sf):
    return load(spark, sf, "labels").select(
        F.col("doc_id").alias("case_id"), F.when(F.col("quality") == 1, "draft").otherwise("refused").alias("expected_status"),
        F.array(F.lit("f0")).alias("expected_fields"), F.when(F.col("toxic") == 0, "{}").otherwise('{"x":1}').alias("expected_parameters"))


def run(spark, sf):
    d = load(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("case_id"), F.col("lang").alias("label"), (F.col("doc_id") % 5 != 0).alias("schema_valid"),
        F.when(F.col("doc_id") % 3 == 0, "refused").otherwise("draft").alias("status"),
        F.array(F.concat(F.lit("f"), (F.col("n_chars") % 2).cast("string"))).alias("fields"), F.lit("{}").alias("parameters"),
        (F.col("doc_id") % 4 != 0).alias("execution_consistent"), (F.col("doc_id") % 4 != 0).alias("replay_consistent"))


@check("evl1_scorecard", f"SELECT {CARD} FROM ({J})")
def evl1(spark, sf):
    return S.scorecard(run(spark, sf), goldens(spark, sf))


@check("evl2_replay_consistency", "SELECT doc_id AS case_id, doc_id % 6 <> 0 AS consistent FROM documents")
def evl2(spark, sf):
    first = load(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), "text", "lang")
    second = first.withColumn("lang", F.when(F.col("case_id") % 6 == 0, F.concat("lang", F.lit("?"))).otherwise(F.col("lang")))
    return S.replay_consistency(first, second, ["text", "lang"])


@check("evl3_dry_run_matches", "SELECT count(*) AS metrics, count(*) FILTER (i <> 0) AS matching FROM range(9) t(i), (SELECT count(*) AS n FROM orders) WHERE n > 0")
def evl3(spark, sf):
    summary = dry_run(dirty_orders(spark, sf), ROW_RULES, REF)
    final = dry_run(dirty_orders(spark, sf), ROW_RULES, REF).withColumn("issue_count", F.when(
        F.col("metric_id") == "business_required_compliance", F.col("issue_count") + 1).otherwise(F.col("issue_count")))
    return S.dry_run_matches(summary, final).agg(F.count(F.lit(1)).alias("metrics"), F.count_if("matches").alias("matching"))


@check("evl4_compare_runs", f"SELECT label, {CARD} FROM ({EACH}) GROUP BY label")
def evl4(spark, sf):
    return S.compare_runs(run(spark, sf), goldens(spark, sf))


@check("evl5_retrieval_scorecard", """SELECT count(*) AS case_count, avg(CAST(status = 'ok' AS INT)) AS status_accuracy, avg(CAST(n >= 2 AS INT)) AS minimum_results_rate,
  avg(CAST(coalesce(version = 'v1', false) AS INT)) AS version_accuracy, avg(CAST(coalesce(contains(text, 'e'), false) AS INT)) AS text_accuracy,
  coalesce(avg(CAST(cited AS INT)) FILTER (n > 0), 1.0) AS citation_validity FROM (SELECT conv_id, count(*) AS n, CASE WHEN count(*) > 3 THEN 'ok' ELSE 'no_results' END AS status,
  arg_min('v' || (turn % 2 + 1), turn) AS version, arg_min(text, turn) AS text, bool_and(turn <> 4) AS cited FROM conversations GROUP BY 1)""")
def evl5(spark, sf):
    c = load(spark, sf, "conversations")
    results = c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.concat(F.lit("v"), (F.col("turn") % 2 + 1).cast("string")).alias("version"),
                       "text", F.lit("c").alias("chunk_id"), F.when(F.col("turn") != 4, "d").alias("document_id"))
    responses = c.groupBy(F.col("conv_id").alias("query_id")).agg(F.count(F.lit(1)).alias("result_count")).withColumn(
        "status", F.when(F.col("result_count") > 3, "ok").otherwise("no_results"))
    golden = responses.select("query_id", F.lit("ok").alias("expected_status"), F.lit(2).alias("minimum_results"),
                              F.lit("v1").alias("expected_version"), F.lit("e").alias("expected_text"))
    return S.retrieval_scorecard(responses, results, golden)


@check("evl6_ungrounded_claims", "SELECT l_orderkey AS case_id, l_partkey AS chunk_id FROM lineitem WHERE (l_orderkey, l_partkey) NOT IN (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def evl6(spark, sf):
    lines = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("chunk_id"), "l_returnflag")
    return S.ungrounded_claims(lines.drop("l_returnflag"), lines.where("l_returnflag = 'R'"))


@check("evl6_unapproved_executions", "SELECT o_orderkey AS case_id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 1")
def evl6_unapproved(spark, sf):
    approval = F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 1, "a1")
    return S.unapproved_executions(load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"), (F.col("o_orderstatus") == "F").alias("executed"), approval.alias("approval_id"))).select("case_id")


# ------------------------------------------------------------------ logs
def calls(events):
    """Events as calls: the type is the provider, every tenth user's call is rejected."""
    return events.select(
        F.col("event_type").alias("provider"), F.concat(F.lit("model  "), (F.col("user_id") % 3).cast("string")).alias("model"),
        F.when(F.col("user_id") % 10 == 0, "rejected").when(F.col("value") > 20, "failure").otherwise("success").alias("outcome"),
        F.get_json_object("props", "$.k").alias("input_tokens"), F.col("event_type").alias("output_tokens"),
        F.col("value").cast("int").alias("latency_ms"))


USAGE = """SELECT event_type AS provider, 'model ' || (user_id % 3) AS model, count(*) FILTER (user_id % 10 <> 0) AS attempts,
  count(*) FILTER (user_id % 10 <> 0 AND value <= 20) AS successes, count(*) FILTER (user_id % 10 <> 0 AND value > 20) AS failures,
  count(*) FILTER (user_id % 10 = 0) AS rejected, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS input_tokens,
  CAST(0 AS BIGINT) AS output_tokens, CAST(sum(greatest(trunc(value), 0)) AS BIGINT) AS latency_ms FROM events GROUP BY ALL"""


@check("log1_usage_rollup", USAGE)
def log1(spark, sf):
    return L.usage_rollup(calls(load(spark, sf, "events")))


def event_stream(spark, sf):
    schema = load(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@check("log1_usage_stream", USAGE)
def log1_stream(spark, sf):
    return U.run_to_table(spark, U.usage_stream(calls(event_stream(spark, sf))), "usage", "complete")


@check("log2_trailing_rate", """SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS calls_in_window,
  count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW) > 2 AS over_limit FROM events""")
def log2(spark, sf):
    return L.trailing_rate(load(spark, sf, "events"), "event_type", "ts", 2).select("event_id", "calls_in_window", "over_limit")


@check("log2_trailing_stream", """SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS calls_in_window,
  count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW) > 2 AS over_limit FROM events""")
def log2_trailing_stream(spark, sf):
    """The stream's flags are those of the batch, row by row, up to the newest call."""
    stream = event_stream(spark, sf).withColumn("at", F.col("ts").cast("timestamp")).select("event_id", "event_type", "at")
    found = U.trailing_rate_table(spark, stream, "event_type", "at", 2, late="400 days")
    return found.select("event_id", "calls_in_window", "over_limit")


@check("log2_rate_stream", """SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS calls, count(*) > 3 AS over_limit FROM events GROUP BY 1, 2""")
def log2_stream(spark, sf):
    stream = event_stream(spark, sf).withColumn("at", F.col("ts").cast("timestamp"))
    rates = U.rate_stream(stream, "event_type", "at", 3, width="1 hour", slide="1 hour")
    found = U.run_to_table(spark, rates, "rate", "complete")
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "calls", "over_limit")


# Every order is a small workflow of three steps with faults in some.
@check("log3_transition_audit", """SELECT o_orderkey AS id, p AS problem FROM orders, LATERAL (SELECT unnest(list_filter([
  CASE WHEN o_orderkey % 7 = 0 THEN 'gap in sequence' END, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0 THEN 'time goes back' END,
  CASE WHEN o_orderkey % 13 = 0 THEN 'transition not allowed' END, CASE WHEN o_orderkey % 17 = 0 THEN 'last state differs' END], lambda x: x IS NOT NULL)) AS p)""")
def log3(spark, sf):
    k = F.col("o_orderkey")
    steps = F.array(
        F.struct(F.lit(1).alias("seq"), F.lit("new").alias("from_state"), F.when(k % 13 == 0, "odd").otherwise("draft").alias("to_state")),
        F.struct(F.when(k % 7 == 0, 4).otherwise(2).alias("seq"), F.when(k % 13 == 0, "odd").otherwise("draft").alias("from_state"), F.lit("done").alias("to_state")))
    base = load(spark, sf, "orders")
    log = base.select(k.alias("id"), "o_orderdate", F.explode(steps).alias("s")).select(
        "id", "s.seq", "s.from_state", "s.to_state", F.lit("step").alias("reason"), (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=F.when(
            (F.col("id") % 11 == 0), -F.col("s.seq")).otherwise(F.col("s.seq")))).alias("at"))
    allowed = spark.createDataFrame([("new", "draft"), ("draft", "done"), ("odd", "done")], "from_state string, to_state string")
    current = base.select(k.alias("id"), F.when(k % 17 == 0, "draft").otherwise("done").alias("state"), F.lit(0).alias("retries"))
    return L.transition_audit(log, allowed, "new", current)


@check("log4_bounded_turns", """WITH RECURSIVE v AS (SELECT conv_id, turn, role, trim(text, chr(10) || ' ' || chr(9)) AS text FROM conversations
  WHERE role IN ('user', 'assistant') AND length(trim(text, chr(10) || ' ' || chr(9))) BETWEEN 1 AND 4000 AND NOT regexp_matches(text, '[\\x{061c}\\x{200e}\\x{200f}\\x{202a}-\\x{202e}\\x{2066}-\\x{2069}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]')),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM v),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS age, CAST(-1 AS BIGINT) AS turn, CAST(0 AS BIGINT) AS used, false AS keep FROM n GROUP BY conv_id
  UNION ALL SELECT n.conv_id, n.age, n.turn, w.used + CASE WHEN n.role = 'user' AND w.used + length(n.text) + (w.used > 0)::INT <= 4000 THEN length(n.text) + (w.used > 0)::INT ELSE 0 END,
    n.role <> 'user' OR w.used + length(n.text) + (w.used > 0)::INT <= 4000 FROM w JOIN n ON n.conv_id = w.conv_id AND n.age = w.age + 1 AND n.age <= 20)
SELECT conv_id, turn, role, md5(text) AS text FROM w JOIN n USING (conv_id, turn) WHERE keep""")
def log4(spark, sf):
    return L.bounded_turns(load(spark, sf, "conversations")).withColumn("text", F.md5("text"))


@check("src13_chat_rules", "SELECT conv_id, count(*) AS turns, CASE WHEN sum(length(trim(text, chr(10) || ' ' || chr(9))) + 1) - 1 <= 4000 THEN md5(string_agg(trim(text, chr(10) || ' ' || chr(9)), chr(10) ORDER BY turn)) END AS request, CASE WHEN sum(length(trim(text, chr(10) || ' ' || chr(9))) + 1) - 1 > 4000 THEN 'the request is longer than 4000 characters' END AS problem FROM conversations WHERE role = 'user' AND trim(text, chr(10) || ' ' || chr(9)) <> '' GROUP BY 1")
def src13_chat(spark, sf):
    return T.chat_rules(load(spark, sf, "conversations")).withColumn("request", F.md5("request"))


SPACE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
LINES = "string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"


@check("src13_dialog_rules", rf"""SELECT doc_id, md5(rule) AS rule, CAST(min(n) AS INTEGER) AS line_number FROM (SELECT doc_id, n,
  trim(regexp_replace(regexp_replace(trim({LINES}[n], {SPACE}), '^\s*(?:[-*+]\s+|[0-9]{{1,3}}[.)、]\s*)', ''), '^\s*(?:规则|要求)\s*[0-9]*\s*[:：]\s*', ''), {SPACE}) AS rule
  FROM (SELECT doc_id, text, unnest(range(1, len({LINES}) + 1)) AS n FROM documents)) WHERE rule <> '' GROUP BY doc_id, rule""")
def src13_dialog(spark, sf):
    return T.dialog_rules(load(spark, sf, "documents"), "doc_id", "text").withColumn("rule", F.md5("rule"))
