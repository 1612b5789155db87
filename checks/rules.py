"""RUL, RSK13, RPT and SNK rows: business rules and the report tables built on them."""

import datetime as dt

from pyspark.sql import functions as F

from sparkassay.operators import grounding as G
from sparkassay.operators import locate as L
from sparkassay.operators import metrics as M
from sparkassay.operators import report as RP
from sparkassay.operators.profile import profile
from sparkassay.operators import risks as R
from sparkassay.operators import rules as U
from sparkassay.operators.assess import assess, settle
from sparkassay.plans.rulebook import Rule
from sparkassay.session import scratch_path
from sparkassay.sources import files as S
from sparkassay.sources import sinks as K

from .metrics import (
    D, DIRTY_COLUMNS, M_SQL, P, REF, RISK_SQL, numbered, s_missing, s_time, shown_risks,
)
from .sources import csv_of
from .registry import (
    check, d_date, d_finite, d_metric, d_missing, d_number, d_ratio, dirty_orders, dirty_parts,
    joined, load, shown, union,
)

PK = Rule("primary_key", ("l_orderkey", "l_linenumber"))
DIRTY_PK = Rule("primary_key", ("department", "version"))
REQUIRED = Rule("required", ("version",), target="db31_020100")
FRESH = Rule("update_freshness", ("update_time",), {"frequency": "custom", "max_age_days": 3660}, "db31_050200")
ALLOWED = Rule("allowed_values", ("department",), {"allowed_values": ["1-URGENT", "2-HIGH", "5-LOW"]})
RANGE = Rule("numeric_range", ("total_amount",), {"minimum": 1000, "maximum": 400000}, "db31_030200")
REGEX = Rule("regex_format", ("version",), {"pattern": r"v1\.[0-6]"})
LENGTH = Rule("string_length", ("source_url",), {"minimum": 12, "maximum": 36})
CONDITIONAL = Rule("conditional_required", ("flag", "contact_email"), {"condition_values": ["是", "YES"]})
COMPARISON = Rule("field_comparison", ("total_amount", "flag"), {"operator": "gte", "comparison_type": "auto"})
ROW_RULES = [REQUIRED, FRESH, ALLOWED, RANGE, REGEX, LENGTH, CONDITIONAL, COMPARISON]
RULES = [DIRTY_PK, *ROW_RULES]

PRESENT = {c: f"NOT {d_missing(c)}" for c in DIRTY_COLUMNS}
V_REQUIRED = d_missing("version")
V_TIME = f"({d_date('update_time')}) IS NULL"
V_ALLOWED = f"({PRESENT['department']} AND department NOT IN ('1-URGENT','2-HIGH','5-LOW'))"
V_RANGE = (f"({PRESENT['total_amount']} AND NOT coalesce({d_finite('total_amount')} AND "
           f"{d_number('total_amount')} BETWEEN 1000 AND 400000, false))")
V_REGEX = f"({PRESENT['version']} AND NOT regexp_full_match(version, 'v1\\.[0-6]'))"
V_LENGTH = f"({PRESENT['source_url']} AND NOT length(source_url) BETWEEN 12 AND 36)"
ACTIVE = "coalesce(flag IN ('是','YES'), false)"
V_CONDITIONAL = f"({ACTIVE} AND {d_missing('contact_email')})"
NUM_A, NUM_F = d_number("total_amount"), d_number("flag")
OUTCOME = (f"CASE WHEN {d_missing('total_amount')} OR {d_missing('flag')} THEN NULL "
           f"WHEN {d_finite('total_amount')} AND {d_finite('flag')} THEN {NUM_A} >= {NUM_F} "
           f"WHEN {d_finite('total_amount')} OR {d_finite('flag')} THEN false ELSE encode(total_amount) >= encode(flag) END")
V_COMPARISON = f"NOT coalesce({OUTCOME}, false)"


def s_rule(metric, field, violation, applicable="true"):
    n, bad = f"count(*) FILTER ({applicable})", f"count(*) FILTER ({violation})"
    return d_metric(metric, field, d_ratio(f"{n} - {bad}", n), n, bad) + " FROM d"


FREQUENCY_OK = f"(date_diff('day', CAST(max({d_date('update_time')}) AS DATE), DATE '{REF}') BETWEEN 0 AND 3660)"
RULE_SQL = {
    "business_required_compliance": s_rule("business_required_compliance", "version", V_REQUIRED),
    "business_update_time_parseability": s_rule("business_update_time_parseability", "update_time", V_TIME),
    "business_update_frequency_compliance": d_metric(
        "business_update_frequency_compliance", "update_time", f"CASE WHEN {FREQUENCY_OK} THEN 1 ELSE 0 END",
        f"count(*) FILTER (NOT {V_TIME})", f"CASE WHEN {FREQUENCY_OK} THEN 0 ELSE 1 END") + " FROM d",
    "business_allowed_values_compliance": s_rule("business_allowed_values_compliance", "department", V_ALLOWED, PRESENT["department"]),
    "business_numeric_range_compliance": s_rule("business_numeric_range_compliance", "total_amount", V_RANGE, PRESENT["total_amount"]),
    "business_regex_format_compliance": s_rule("business_regex_format_compliance", "version", V_REGEX, PRESENT["version"]),
    "business_string_length_compliance": s_rule("business_string_length_compliance", "source_url", V_LENGTH, PRESENT["source_url"]),
    "business_conditional_required_compliance": s_rule(
        "business_conditional_required_compliance", "contact_email", V_CONDITIONAL, ACTIVE),
    "business_field_comparison_compliance": s_rule("business_field_comparison_compliance", "", V_COMPARISON),
}


def s_pk(source, keys, complete="true"):
    return (d_metric("business_primary_key_compliance", "", d_ratio("sum(n) - sum(CASE WHEN n > 1 OR NOT ok THEN n ELSE 0 END)", "sum(n)"),
                     "sum(n)", "sum(CASE WHEN n > 1 OR NOT ok THEN n ELSE 0 END)")
            + f" FROM (SELECT {complete} AS ok, count(*) AS n FROM {source} GROUP BY {complete}, {keys})")


DIRTY_COMPLETE = f"({PRESENT['department']} AND {PRESENT['version']})"
PK_SQL = s_pk("d", "department, version", DIRTY_COMPLETE)
ALL_RULES_SQL = union([PK_SQL, *RULE_SQL.values()])


def rule_query(rule, metric):
    return lambda spark, sf: shown(U.evaluate_rules(dirty_orders(spark, sf), [rule], REF).where(F.col("metric_id") == metric))


for _name, _rule, _metric in (
    ("rul2_required", REQUIRED, "business_required_compliance"),
    ("rul3_update_time_parseability", FRESH, "business_update_time_parseability"),
    ("rul4_update_frequency", FRESH, "business_update_frequency_compliance"),
    ("rul5_allowed_values", ALLOWED, "business_allowed_values_compliance"),
    ("rul6_numeric_range", RANGE, "business_numeric_range_compliance"),
    ("rul7_regex_format", REGEX, "business_regex_format_compliance"),
    ("rul8_string_length", LENGTH, "business_string_length_compliance"),
    ("rul9_conditional_required", CONDITIONAL, "business_conditional_required_compliance"),
    ("rul10_field_comparison", COMPARISON, "business_field_comparison_compliance"),
):
    check(_name, D + RULE_SQL[_metric])(rule_query(_rule, _metric))


@check("rul1_primary_key", s_pk("lineitem", "l_orderkey, l_linenumber"))
def rul1(spark, sf):
    return shown(U.evaluate_rules(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), [PK], REF))


# The same numbers in several notations, read back from CSV with typed columns.
NOTATIONS = """n AS (SELECT l_orderkey AS line, l_linenumber % 3 AS kind, l_linenumber % 2 AS size,
  CAST(CASE WHEN l_linenumber = 2 THEN 9007199254740992 ELSE 9007199254740993 END AS BIGINT) AS wide FROM lineitem)"""


def notations(spark, sf):
    line = F.col("l_linenumber")

    def mixed(c, tail=".0"):
        text = c.cast("string")
        return F.when(line % 3 == 0, F.concat(F.lit("0"), text)).when(line % 3 == 1, F.concat(text, F.lit(tail))).otherwise(text)

    wide = F.when(line == 2, F.lit(9007199254740992)).otherwise(F.lit(9007199254740993))
    df = load(spark, sf, "lineitem").select(mixed(F.col("l_orderkey")).alias("line"), mixed(line % 3, "").alias("kind"), mixed(line % 2).alias("size"),
                                            mixed(wide).alias("wide"))
    return S.read_csv(spark, csv_of(spark, df, "notations"), typed=True).checked()


SIZE_ALLOWED = Rule("allowed_values", ("size",), {"allowed_values": [1]})
SIZE_NEEDS = Rule("conditional_required", ("kind", "line"), {"condition_values": [2]})
for _name, _rule, _metric, _sql in (
    ("rul1_typed_csv", Rule("primary_key", ("line", "wide")), "business_primary_key_compliance", s_pk("n", "line, wide")),
    ("rul5_typed_csv", SIZE_ALLOWED, "business_allowed_values_compliance", s_rule("business_allowed_values_compliance", "size", "size <> 1").replace("FROM d", "FROM n")),
    ("rul9_typed_csv", SIZE_NEEDS, "business_conditional_required_compliance",
     s_rule("business_conditional_required_compliance", "line", "false", "kind = 2").replace("FROM d", "FROM n")),
):
    check(_name, f"WITH {NOTATIONS} {_sql}")(
        lambda spark, sf, rule=_rule, metric=_metric: shown(U.evaluate_rules(notations(spark, sf), [rule], REF).where(F.col("metric_id") == metric)))

for _name, _metric in (("agg8_typed_csv", "exact_duplicate_rate"), ("agg9_typed_csv", "normalized_duplicate_rate"),
                       ("std1_typed_csv", "db31_030300"), ("std2_typed_csv", "db31_030400")):
    check(_name, f"WITH {NOTATIONS} " + d_metric(_metric, "", d_ratio("count(*)" if _metric.startswith("db31") else "sum(n - 1)", "sum(n)"), "sum(n)", "sum(n - 1)") + " FROM (SELECT count(*) AS n FROM n GROUP BY line, kind, size, wide)")(
        lambda spark, sf, metric=_metric: shown(M.calculate_metrics(notations(spark, sf), REF, [metric])))


@check("rul1_primary_key_locations", """
WITH n AS (SELECT l_orderkey, l_linenumber, CAST(row_number() OVER () AS BIGINT) AS rn FROM lineitem),
g AS (SELECT *, count(*) OVER k AS c, first_value(rn) OVER k AS a, nth_value(rn, 2) OVER k AS b FROM n
  WINDOW k AS (PARTITION BY l_orderkey, l_linenumber ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT 'metric:business_primary_key_compliance:dataset' AS metric_key, rn AS record_number, 'l_orderkey,l_linenumber' AS fields,
  'rule_primary_key_duplicate' AS issue_type, CAST(CASE WHEN rn = a THEN b ELSE a END AS VARCHAR) AS related FROM g WHERE c > 1""")
def rul1_locations(spark, sf):
    df = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return joined(U.primary_key_locations(df, PK, L.with_record_number(df)))


@check("rul10_ship_after_order", """
SELECT 'business_field_comparison_compliance' AS metric_id, '' AS field, 'evaluated' AS status,
  round_even(CAST(count(*) FILTER (l_shipdate >= o_orderdate) AS DOUBLE) / count(*), 6) AS value, count(*) AS checked_count,
  count(*) FILTER (NOT l_shipdate >= o_orderdate) AS issue_count
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def rul10_dates(spark, sf):
    table = load(spark, sf, "lineitem").join(load(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_shipdate", "o_orderdate")
    return shown(U.evaluate_rules(table, [Rule("field_comparison", ("l_shipdate", "o_orderdate"),
                                               {"operator": "gte", "comparison_type": "datetime"})], REF))


@check("rul11_evaluate_rules", D + ALL_RULES_SQL)
def rul11(spark, sf):
    return shown(U.evaluate_rules(dirty_orders(spark, sf), RULES, REF))


def _s_hit(metric, kind, fields, where):
    return (f"SELECT 'metric:{metric}' AS metric_key, record_id + 1 AS record_number, '{fields}' AS fields, {kind} AS issue_type, "
            f"'' AS related FROM d WHERE {where}")


LOCATION_SQL = D + union([
    _s_hit("business_required_compliance:field:version", "'rule_required_missing'", "version", V_REQUIRED),
    _s_hit("business_update_time_parseability:field:update_time", "'rule_update_time_missing_or_invalid'", "update_time", V_TIME),
    _s_hit("business_allowed_values_compliance:field:department", "'rule_allowed_value_violation'", "department", V_ALLOWED),
    _s_hit("business_numeric_range_compliance:field:total_amount", "'rule_numeric_range_violation'", "total_amount", V_RANGE),
    _s_hit("business_regex_format_compliance:field:version", "'rule_regex_format_violation'", "version", V_REGEX),
    _s_hit("business_string_length_compliance:field:source_url", "'rule_string_length_violation'", "source_url", V_LENGTH),
    _s_hit("business_conditional_required_compliance:field:contact_email", "'rule_conditional_required_missing'",
           "flag,contact_email", V_CONDITIONAL),
    _s_hit("business_field_comparison_compliance:dataset",
           f"CASE WHEN ({OUTCOME}) IS NULL THEN 'rule_field_comparison_unparseable' ELSE 'rule_field_comparison_violation' END",
           "total_amount,flag", V_COMPARISON)])


@check("rul11_rule_locations", LOCATION_SQL)
def rul11_locations(spark, sf):
    df = dirty_orders(spark, sf)
    return joined(U.rule_locations(df, ROW_RULES, REF, numbered(df)))


@check("rul12_dry_run", f"{D} SELECT metric_id, status, value, checked_count, CASE metric_id WHEN 'business_update_time_parseability' THEN -1 "
       f"WHEN 'business_update_frequency_compliance' THEN 1 - issue_count ELSE checked_count - issue_count END AS compliant_count, issue_count, "
       f"CASE metric_id WHEN 'business_update_frequency_compliance' THEN 0 ELSE issue_count END AS location_count FROM ({ALL_RULES_SQL})")
def rul12(spark, sf):
    return U.dry_run(dirty_orders(spark, sf), RULES, REF).select(
        "metric_id", "status", "value", "checked_count", F.coalesce("compliant_count", F.lit(-1)).cast("bigint").alias("compliant_count"),
        "issue_count", "location_count")


@check("rsk13_business_rule_violation", f"{D} SELECT metric_id, field, value AS observed_value, 'attention' AS level FROM ({ALL_RULES_SQL}) WHERE value < 1")
def rsk13(spark, sf):
    return R.business_risks(U.evaluate_rules(dirty_orders(spark, sf), RULES, REF)).select(
        "metric_id", F.coalesce("field", F.lit("")).alias("field"), "observed_value", "level")


# ------------------------------------------------------------------ report tables
IDS = ("field_missing_rate", "time_info_availability", "db31_020100", "db31_030200", "db31_050200", "db31_010100")
STANDARD_SQL = [d_metric(i, "", "NULL", "-1", "-1", "'not_assessable'") for i in IDS if i.startswith("db31")]


def base_metrics(spark, sf):
    return settle(M.calculate_metrics(dirty_orders(spark, sf), REF, IDS))


TABLE_SQL = union([s_missing(), s_time(), *STANDARD_SQL])


@check("rpt1_not_assessable", f"{D} SELECT metric_id AS id, 'metric:' || metric_id || ':dataset' AS metric_key FROM ({TABLE_SQL}) "
       "WHERE status = 'not_assessable'")
def rpt1(spark, sf):
    return RP.not_assessable(base_metrics(spark, sf)).select("id", "metric_key")


@check("rpt2_rule_diff", f"{D} SELECT metric_id, field, status, value, checked_count, issue_count FROM ({ALL_RULES_SQL})")
def rpt2(spark, sf):
    base = base_metrics(spark, sf)
    return shown(RP.rule_diff(base, RP.enhanced_metrics(base, U.evaluate_rules(dirty_orders(spark, sf), RULES, REF))))


@check("rpt2_rule_diff_counts", f"{D}, b AS ({ALL_RULES_SQL}), l AS ({LOCATION_SQL[len(D):]}) SELECT (SELECT count(*) FROM b) AS added_metrics, "
       "(SELECT count(*) FROM b) AS added_evaluated_metrics, CAST(0 AS BIGINT) AS added_not_assessable, "
       "(SELECT count(*) FROM b WHERE value < 1) AS added_risks, (SELECT count(*) FROM l) AS added_issue_locations")
def rpt2_counts(spark, sf):
    df = dirty_orders(spark, sf)
    base, business = base_metrics(spark, sf), settle(U.evaluate_rules(df, RULES, REF))
    old = R.generate_risks(base)
    new = old.unionByName(R.business_risks(business))
    return RP.rule_diff_counts(base, RP.enhanced_metrics(base, business), old, new, U.rule_locations(df, ROW_RULES, REF, numbered(df)))


BOUND = {"db31_020100": "business_required_compliance", "db31_030200": "business_numeric_range_compliance",
         "db31_050200": "business_update_frequency_compliance"}


@check("rpt3_project_to_catalog", f"{D}, t AS ({TABLE_SQL}), b AS ({ALL_RULES_SQL}) SELECT t.metric_id, t.field, coalesce(b.status, t.status) AS status, "
       "CASE WHEN b.metric_id IS NULL THEN t.value ELSE b.value END AS value, coalesce(b.checked_count, t.checked_count) AS checked_count, "
       "coalesce(b.issue_count, t.issue_count) AS issue_count FROM t LEFT JOIN b ON b.metric_id = CASE t.metric_id "
       + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BOUND.items()) + " END")
def rpt3(spark, sf):
    return shown(RP.project_to_catalog(base_metrics(spark, sf), U.evaluate_rules(dirty_orders(spark, sf), RULES, REF)))


@check("rpt4_baseline_unchanged", f"{D} SELECT CAST(0 AS BIGINT) AS changed_rows, count(*) AS enhanced_rows FROM ({TABLE_SQL} UNION ALL {ALL_RULES_SQL})")
def rpt4(spark, sf):
    base = base_metrics(spark, sf)
    enhanced = RP.enhanced_metrics(base, settle(U.evaluate_rules(dirty_orders(spark, sf), RULES, REF)))
    changed = RP.baseline_changes(base, enhanced, list(BOUND)).select(F.lit("changed").alias("kind"))
    return changed.unionAll(enhanced.select(F.lit("row").alias("kind"))).agg(
        F.count_if(F.col("kind") == "changed").alias("changed_rows"), F.count_if(F.col("kind") == "row").alias("enhanced_rows"))


ALL_RISKS_SQL = union(RISK_SQL.values())


@check("rpt5_report_summary", f"{M_SQL.rstrip(', ')}, r AS ({ALL_RISKS_SQL}) SELECT (SELECT count(*) FROM d) AS row_count, CAST({len(DIRTY_COLUMNS) + 1} AS BIGINT) AS column_count, "
       "count(DISTINCT metric_id) AS metric_definition_count, count(DISTINCT metric_id) FILTER (status = 'evaluated') AS evaluated_metric_definition_count, "
       "count(*) AS metric_result_count, count(*) FILTER (status = 'evaluated') AS evaluated_metric_result_count, "
       "count(*) FILTER (status <> 'evaluated') AS not_assessable_count, (SELECT count(*) FROM r) AS risk_count, "
       + ", ".join(f"(SELECT count(*) FROM r WHERE level = '{x}') AS {x}_count" for x in RP.LEVELS) + " FROM m")
def rpt5(spark, sf):
    metrics = settle(M.calculate_metrics(dirty_orders(spark, sf), REF))
    return RP.report_summary(metrics, R.generate_risks(metrics), len(DIRTY_COLUMNS) + 1)


@check("rpt6_priority_risks", f"{M_SQL.rstrip(', ')} SELECT * FROM ({ALL_RISKS_SQL}) ORDER BY CASE level WHEN 'warning' THEN 0 WHEN 'attention' THEN 1 ELSE 2 END, "
       "risk_id LIMIT 5")
def rpt6(spark, sf):
    return shown_risks(RP.priority_risks(assess(dirty_orders(spark, sf), REF).risks, 5))


@check("rpt7_top_not_assessable", f"{D} SELECT metric_id AS id, 'metric:' || metric_id || ':dataset' AS metric_key FROM ({TABLE_SQL}) "
       "WHERE status = 'not_assessable' ORDER BY metric_key LIMIT 2")
def rpt7(spark, sf):
    return RP.top_not_assessable(RP.not_assessable(base_metrics(spark, sf)), 2).select("id", "metric_key")


# Risks over orders: each order names its own line keys, or (every third) only its part ids.
@check("rpt8_risk_metric_links", """
SELECT DISTINCT o_orderkey AS risk_id, l_partkey * 10 + l_linenumber AS metric_key FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 3 <> 0
UNION SELECT o_orderkey, m.k FROM orders JOIN lineitem l ON l.l_orderkey = o_orderkey
JOIN (SELECT DISTINCT l_partkey, l_partkey * 10 + l_linenumber AS k FROM lineitem) m USING (l_partkey) WHERE o_orderkey % 3 = 0""")
def rpt8(spark, sf):
    items = load(spark, sf, "lineitem").select(
        "l_orderkey", (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("metric_key"), F.col("l_partkey").alias("metric_id"))
    named = F.col("l_orderkey") % 3 != 0
    risks = items.groupBy(F.col("l_orderkey").alias("risk_id")).agg(
        F.collect_list(F.when(named, F.col("metric_key"))).alias("related_metric_keys"),
        F.collect_list(F.col("metric_id")).alias("related_metrics")).join(
            load(spark, sf, "orders").select(F.col("o_orderkey").alias("risk_id")), "risk_id", "left_semi")
    unknown = F.array_append("related_metric_keys", F.when(F.size("related_metric_keys") > 0, F.lit(-1).cast("bigint")))
    return RP.risk_metric_links(risks.withColumn("related_metric_keys", F.array_compact(unknown)), items)


@check("rpt10_safe_snapshot", f"{D} SELECT metric_id, field, status, value, CAST(checked_count AS VARCHAR) AS checked, "
       "CASE WHEN metric_id = 'time_info_availability' THEN 5 ELSE CASE WHEN status = 'evaluated' THEN 2 ELSE 0 END END AS evidence_size, "
       f"CASE WHEN status = 'evaluated' THEN '' ELSE '当前报告未提供可安全披露的可评估依据。' END AS reason FROM ({TABLE_SQL})")
def rpt10(spark, sf):
    safe = RP.safe_metrics(base_metrics(spark, sf), ["orders.parquet"])
    return safe.select(
        "metric_id", F.coalesce("field", F.lit("")).alias("field"), "status", "value",
        F.coalesce(F.try_element_at("evidence", F.lit("checked_count")), F.lit("-1")).alias("checked"),
        F.size(F.coalesce("evidence", F.expr("cast(map() as map<string,string>)"))).alias("evidence_size"),
        F.coalesce("reason", F.lit("")).alias("reason"))


@check("rpt11_fingerprints", "SELECT count(*) AS row_count, true AS same_when_reordered, true AS other_when_changed FROM lineitem")
def rpt11(spark, sf):
    df = load(spark, sf, "lineitem")
    a, b = RP.table_fingerprint(df), RP.table_fingerprint(df.hint("rebalance", "l_partkey"))
    c = RP.table_fingerprint(df.withColumn("l_tax", F.col("l_tax") + 0.01)).withColumnsRenamed({"xor_high": "changed"})
    return a.join(b, ["row_count", "xor_high", "xor_low", "sum_high"]).join(c.select("row_count", "changed"), "row_count").select(
        "row_count", F.lit(True).alias("same_when_reordered"), (F.col("changed") != F.col("xor_high")).alias("other_when_changed"))


# Statements over orders quote the price and the customer; every seventh misquotes the price, every
# eleventh cites another order, every thirteenth puts the label out of reach.
STATEMENTS = """
SELECT o_orderkey AS statement_id,
  concat('price ', CASE WHEN o_orderkey % 7 = 0 THEN '1.5' ELSE CAST(o_totalprice AS STRING) END,
         CASE WHEN o_orderkey % 13 = 0 THEN ' and then at some distance ' ELSE '; ' END, CAST(o_custkey AS STRING), ' is the customer') AS text,
  concat('order:', CAST(CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey + 1 WHEN o_orderkey % 17 = 0 THEN -1 - o_orderkey ELSE o_orderkey END AS STRING)) AS cited
FROM orders"""


def statements(spark, sf):
    df = spark.sql(STATEMENTS.replace("FROM orders", "FROM {orders}"), orders=load(spark, sf, "orders"))
    return df.select("statement_id", "text", F.array("cited").alias("citation_ids"))


def order_claims(spark, sf):
    pairs = F.array(
        F.struct(F.col("o_totalprice").alias("value"), F.array(F.lit("price")).alias("labels")),
        F.struct(F.col("o_custkey").cast("double").alias("value"), F.array(F.lit("Customer"), F.lit("client")).alias("labels")))
    return load(spark, sf, "orders").select(
        F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("citation_id"), F.explode(pairs).alias("c")).select(
            "citation_id", "c.value", "c.labels")


# With '; ' between them, the number of the customer is two characters from neither label: its own
# label ' is the customer' starts eight characters later, and 'price' lies further away.
@check("rpt13_numbers_grounded", """
WITH s AS (SELECT o_orderkey AS k, o_custkey, o_totalprice, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey + 1 WHEN o_orderkey % 17 = 0 THEN -1 - o_orderkey ELSE o_orderkey END AS cited,
  CASE WHEN o_orderkey % 7 = 0 THEN '1.5' ELSE CAST(o_totalprice AS VARCHAR) END AS price,
  CASE WHEN o_orderkey % 13 = 0 THEN ' and then at some distance ' ELSE '; ' END AS gap FROM orders),
j AS (SELECT s.*, c.o_totalprice AS claim_price, c.o_custkey AS claim_customer, c.o_orderkey IS NOT NULL AS known,
  CASE WHEN contains(price, '.') THEN length(price) - position('.' IN price) ELSE 0 END AS digits FROM s LEFT JOIN orders c ON c.o_orderkey = s.cited)
SELECT k AS statement_id, CAST(2 AS BIGINT) AS mentions,
  coalesce(known AND abs(CAST(price AS DOUBLE) - claim_price) <= 0.5 / pow(10, digits) + 1e-12
  AND CASE WHEN length(price) + length(gap) + 1 < 8 THEN abs(o_custkey - claim_price) <= 0.5 ELSE abs(o_custkey - claim_customer) <= 0.5 END, false) AS grounded FROM j""")
def rpt13(spark, sf):
    return G.grounded_numbers(statements(spark, sf), order_claims(spark, sf))


@check("rpt14_citations_valid", f"SELECT statement_id, cited AS citation_id FROM ({STATEMENTS}) WHERE CAST(replace(cited, 'order:', '') AS BIGINT) NOT IN (SELECT o_orderkey FROM orders)")
def rpt14(spark, sf):
    return G.invalid_citations(statements(spark, sf), order_claims(spark, sf))


@check("rpt14_normalized_citations", f"SELECT statement_id, CASE WHEN CAST(replace(cited, 'order:', '') AS BIGINT) IN (SELECT o_orderkey FROM orders) THEN cited ELSE 'report:summary' END AS cited FROM ({STATEMENTS})")
def rpt14_normalized(spark, sf):
    return G.normalize_citations(statements(spark, sf), order_claims(spark, sf)).select(
        "statement_id", F.array_join("citation_ids", ",").alias("cited"))


@check("rpt15_metric_claims", f"{D}, t AS ({TABLE_SQL}) SELECT metric_id, field, value AS claim, '缺失率' AS label FROM t WHERE metric_id = 'field_missing_rate' "
       "UNION ALL SELECT metric_id, field, CAST(checked_count AS DOUBLE), '已检查' FROM t WHERE metric_id = 'field_missing_rate' "
       "UNION ALL SELECT metric_id, field, CAST(issue_count AS DOUBLE), '问题数' FROM t WHERE metric_id = 'field_missing_rate'")
def rpt15(spark, sf):
    claims = G.metric_claims(M.calculate_metrics(dirty_orders(spark, sf), REF, ["field_missing_rate"]))
    parts = F.split("citation_id", ":")
    wanted = F.filter("labels", lambda x: x.isin("缺失率", "已检查", "问题数"))
    return claims.select(parts[2].alias("metric_id"), parts[4].alias("field"), F.col("value").alias("claim"), F.explode(wanted).alias("label"))


# ------------------------------------------------------------------ sinks
@check("snk1_write_report", f"{D}, m AS ({TABLE_SQL}) SELECT metric_id, field, status, value, checked_count, issue_count FROM m")
def snk1(spark, sf):
    path = scratch_path(spark, "report")
    metrics = base_metrics(spark, sf)
    K.write_report({"metrics": metrics, "risks": R.generate_risks(metrics)}, path, "parquet")
    return shown(spark.read.parquet(f"{path}/metrics"))


@check("snk2_write_issue_locations", P + """, g AS (SELECT part_id + 1 AS rn, min(part_id + 1) OVER (PARTITION BY title, kind, size_class) AS a FROM p)
SELECT '完全重复记录' AS issue_type, '完全重复率' AS metric_name, 'title、kind、size_class' AS fields, CAST(rn AS VARCHAR) AS record_number,
  CAST(a AS VARCHAR) AS related_records, '第 ' || rn || ' 条记录与第 ' || a || ' 条记录内容完全相同；关联记录序号 ' || a || ' 表示这组重复数据中首次出现的记录。' AS note
FROM g WHERE rn > a""")
def snk2(spark, sf):
    df = dirty_parts(spark, sf)
    locations = L.duplicate_locations(df, False, df.withColumn("record_number", F.col("part_id") + 1))
    path = scratch_path(spark, "locations")
    K.write_issue_locations(locations, M.duplicate_metrics(df, ["exact_duplicate_rate"]), path)
    return spark.read.option("header", True).csv(path)


@check("snk3_write_rule_issue_locations", f"{D}, l AS ({LOCATION_SQL[len(D):]}) SELECT record_number, replace(fields, ',', '、') AS fields, "
       "'—' AS related_records FROM l")
def snk3(spark, sf):
    df = dirty_orders(spark, sf)
    base, business = base_metrics(spark, sf), settle(U.evaluate_rules(df, ROW_RULES, REF))
    rows = K.rule_issue_location_rows(U.rule_locations(df, ROW_RULES, REF, numbered(df)), base, RP.enhanced_metrics(base, business))
    return rows.select("record_number", "fields", "related_records")


@check("snk4_summary_tables", f"{M_SQL.rstrip(', ')}, r AS ({ALL_RISKS_SQL}) SELECT x AS level, (SELECT count(*) FROM r WHERE level = x) AS risk_count "
       "FROM (VALUES ('warning'), ('attention'), ('info')) v(x)")
def snk4(spark, sf):
    metrics = settle(M.calculate_metrics(dirty_orders(spark, sf), REF))
    return K.summary_tables(metrics, profile(dirty_orders(spark, sf)), R.generate_risks(metrics))["risk_levels"].select(
        "level", "risk_count")
