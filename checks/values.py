"""V1-V16: cell values."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkassay.functions import values as V

from sparkassay.plans.cells import Cells

from .registry import (
    DIRTY_ORDERS, DIRTY_PARTS, check, d_casefold, d_date, d_email, d_finite, d_kind, d_missing,
    d_number, d_strip, d_url, dirty_orders, dirty_parts, load,
)

O = f"WITH d AS ({DIRTY_ORDERS}) SELECT record_id, "
TEXT = T.StringType()


@check("v1_is_missing", O + ", ".join(f"{d_missing(c)} AS {c}" for c in ("department", "contact_email", "flag")) + " FROM d")
def v1(spark, sf):
    return dirty_orders(spark, sf).select(
        "record_id", *[V.is_missing(F.col(c)).alias(c) for c in ("department", "contact_email", "flag")])


@check("v2_value_type", O + ", ".join(f"{d_kind(c)} AS {c}" for c in ("total_amount", "update_time", "flag")) + " FROM d")
def v2(spark, sf):
    cells = Cells(dirty_orders(spark, sf))
    kinds = [cells.kind(c).alias(c) for c in ("total_amount", "update_time", "flag")]
    return cells.project().select("record_id", *kinds)


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@check("v3_parse_datetime", O + f"strftime({d_date('update_time')}, '%Y-%m-%d %H:%M:%S') AS parsed FROM d")
def v3(spark, sf):
    return dirty_orders(spark, sf).select("record_id", _stamp(V.parse_datetime(F.col("update_time"))).alias("parsed"))


@check("v4_parse_datetime_strict", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS from_stamp, CAST(NULL AS VARCHAR) AS from_number FROM orders""")
def v4(spark, sf):
    df = load(spark, sf, "orders")
    types = {f.name: f.dataType for f in df.schema}
    return df.select(
        "o_orderkey", _stamp(V.parse_datetime_strict(F.col("o_orderdate"), types["o_orderdate"])).alias("from_stamp"),
        _stamp(V.parse_datetime_strict(F.col("o_orderkey"), types["o_orderkey"])).alias("from_number"))


@check("v5_try_number", O + f"""
  CASE WHEN isinf({d_number('total_amount')}) THEN 'infinite' WHEN {d_finite('total_amount')} THEN 'finite' ELSE 'none' END AS outcome,
  CASE WHEN {d_finite('total_amount')} THEN {d_number('total_amount')} END AS number FROM d""")
def v5(spark, sf):
    x = V.to_double(F.col("total_amount"))
    return dirty_orders(spark, sf).select(
        "record_id", F.when(x.isNull(), "none").when(V.is_finite(x), "finite").otherwise("infinite").alias("outcome"),
        F.when(V.is_finite(x), x).alias("number"))


@check("v6_is_valid_url", O + f"{d_url('source_url')} AS valid FROM d UNION ALL SELECT -1 - page_id, {d_url('url')} FROM pages")
def v6(spark, sf):
    return dirty_orders(spark, sf).select("record_id", V.is_valid_url(F.col("source_url")).alias("valid")).unionByName(
        load(spark, sf, "pages").select((-1 - F.col("page_id")).alias("record_id"), V.is_valid_url(F.col("url")).alias("valid")))


@check("v7_is_valid_email", O + f"{d_email('contact_email')} AS valid FROM d")
def v7(spark, sf):
    return dirty_orders(spark, sf).select("record_id", V.is_valid_email(F.col("contact_email")).alias("valid"))


def d_structured(c):
    s = d_strip(c)
    return (f"coalesce({d_url(c)} OR {d_email(c)} OR regexp_matches({s}, '^[vV]?[0-9]+([._-][0-9]+)+[A-Za-z0-9._-]*$') OR "
            f"(regexp_matches({s}, '^[A-Za-z0-9]+([._-][A-Za-z0-9]+)+$') AND regexp_matches({s}, '[A-Za-z]') AND regexp_matches({s}, '[0-9]')), false)")


@check("v8_looks_structured", O + ", ".join(f"{d_structured(c)} AS {c}" for c in ("version", "source_url", "department")) + " FROM d")
def v8(spark, sf):
    return dirty_orders(spark, sf).select("record_id", *[
        V.looks_structured(F.col(c)).alias(c) for c in ("version", "source_url", "department")])


@check("v9_exact_key", f"WITH d AS ({DIRTY_PARTS}) SELECT coalesce(title, '~') AS title, count(*) AS n FROM d GROUP BY 1")
def v9(spark, sf):
    return dirty_parts(spark, sf).groupBy(V.exact_key(F.col("title"), TEXT).alias("k")).agg(F.count(F.lit(1)).alias("n")).select(
        F.coalesce("k", F.lit("~")).alias("title"), "n")


def d_normal(c):
    return (f"CASE WHEN {d_missing(c)} THEN NULL WHEN {d_structured(c)} OR {d_kind(c)} <> 'text' THEN '=' || {c} "
            f"ELSE '~' || regexp_replace({d_casefold(d_strip(c))}, '[^\\p{{L}}\\p{{N}}]+', '', 'g') END")


@check("v10_normalized_key", f"WITH d AS ({DIRTY_PARTS}) SELECT part_id, {d_normal('title')} AS k FROM d "
       f"UNION ALL SELECT -1 - doc_id, md5({d_normal('text')}) FROM documents")
def v10(spark, sf):
    return dirty_parts(spark, sf).select("part_id", V.normalized_key(F.col("title"), TEXT).alias("k")).unionByName(
        load(spark, sf, "documents").select(
            (-1 - F.col("doc_id")).alias("part_id"), F.md5(V.normalized_key(F.col("text"), TEXT)).alias("k")))


@check("v11_comparison_key", """
SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT l_quantity) AS quantities, min('text:' || l_returnflag) AS flag_key
FROM lineitem GROUP BY ALL""")
def v11(spark, sf):
    df = load(spark, sf, "lineitem")
    t = {f.name: f.dataType for f in df.schema}
    key = lambda c: V.comparison_key(F.col(c), t[c])
    keyed = df.select("l_orderkey", "l_linenumber", key("l_orderkey").alias("a"), key("l_linenumber").alias("b"),
                      key("l_quantity").alias("q"), key("l_returnflag").alias("f"))
    return keyed.groupBy("a", "b").agg(
        F.first("l_orderkey").alias("l_orderkey"), F.first("l_linenumber").alias("l_linenumber"),
        F.count(F.lit(1)).alias("n"), F.count_distinct("q").alias("quantities"), F.min("f").alias("flag_key")).drop("a", "b")


@check("v12_parse_decimal", O + f"""CASE WHEN {d_finite('total_amount')}
  THEN CAST(CAST(CAST({d_strip('total_amount')} AS DECIMAL(38,2)) * 100 AS BIGINT) AS BIGINT) END AS cents FROM d""")
def v12(spark, sf):
    number = V.parse_decimal(F.col("total_amount"))["exact"]
    return dirty_orders(spark, sf).select("record_id", (number * 100).cast("bigint").alias("cents"))


@check("v13_compare", O + f"""CASE WHEN {d_missing('total_amount')} OR {d_missing('flag')} THEN NULL
  WHEN {d_finite('total_amount')} AND {d_finite('flag')} THEN {d_number('total_amount')} > {d_number('flag')}
  WHEN {d_finite('total_amount')} OR {d_finite('flag')} THEN false
  ELSE encode(total_amount) > encode(flag) END AS satisfied FROM d""")
def v13(spark, sf):
    cells = Cells(dirty_orders(spark, sf))
    outcome = cells.compared("total_amount", "flag", "gt")
    return cells.project().select("record_id", outcome.alias("satisfied"))


@check("v14_regex_fullmatch", O + """CASE WHEN version IS NOT NULL THEN length(version) <= 10000 AND
  regexp_full_match(version, 'v[0-9]\\.[0-5]') END AS matched FROM d""")
def v14(spark, sf):
    return dirty_orders(spark, sf).select(
        "record_id", V.regex_fullmatch(F.col("version"), r"v\d\.[0-5]").alias("matched"))


@check("v16_code_point_length", "SELECT doc_id, CAST(length(text) AS BIGINT) AS code_points FROM documents")
def v16(spark, sf):
    return load(spark, sf, "documents").select(
        "doc_id", V.code_point_length(F.col("text")).cast("bigint").alias("code_points"))
