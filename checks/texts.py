"""V17-V36: free text, redaction, identifiers and JSON text over whole documents and tables."""

from pyspark.sql import functions as F

from sparkassay.functions import text as X


from .registry import check, d_casefold, d_strip, load

DOCS = "SELECT doc_id, "


def docs(spark, sf):
    return load(spark, sf, "documents")


UNSAFE = r"[\x{061c}\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"


@check("v17_unsafe_unicode", DOCS + f"regexp_matches(text, '{UNSAFE}') AS unsafe, md5(regexp_replace(text, '{UNSAFE}', '�', 'g')) AS replaced FROM documents")
def v17(spark, sf):
    return docs(spark, sf).select("doc_id", X.has_unsafe(F.col("text")).alias("unsafe"), F.md5(X.replace_unsafe(F.col("text"))).alias("replaced"))


@check("v18_normalize_display_text", DOCS + "md5(text) AS shown, false AS changed FROM documents "
       "UNION ALL SELECT -1 - doc_id, md5('�' || text), true FROM documents")
def v18(spark, sf):
    d = docs(spark, sf)
    broken = F.concat(F.expr("X'FF'"), F.col("text").cast("binary"))
    shown = lambda c: X.normalize_display(c)
    return d.select("doc_id", F.md5(shown(F.col("text").cast("binary"))["text"]).alias("shown"), shown(F.col("text").cast("binary"))["changed"].alias("changed")).unionByName(
        d.select((-1 - F.col("doc_id")).alias("doc_id"), F.md5(shown(broken)["text"]).alias("shown"), shown(broken)["changed"].alias("changed")))


@check("v19_spreadsheet_safe", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN concat('''', t) ELSE t END AS safe FROM
(SELECT o_orderkey, concat(CASE o_orderkey % 10 WHEN 0 THEN '=' WHEN 5 THEN '  -' ELSE '' END, o_orderpriority) AS t FROM orders)""")
def v19(spark, sf):
    start = F.when(F.col("o_orderkey") % 10 == 0, "=").when(F.col("o_orderkey") % 10 == 5, "  -").otherwise("")
    return load(spark, sf, "orders").select("o_orderkey", X.spreadsheet_safe(F.concat(start, F.col("o_orderpriority"))).alias("safe"))


SECRETS = (r"regexp_replace(regexp_replace(regexp_replace(text, '\b(api[_ -]?key|token|secret|password)\b\s*[:=]\s*[^\s,;]+', '\1=[REDACTED]', 'gi'), "
           r"'\bbearer\s+\S+', 'Bearer [REDACTED]', 'gi'), '\bsk-[A-Za-z0-9_-]{8,}\b', '[REDACTED]', 'g')")


@check("v20_redact_secrets", DOCS + f"md5(left({SECRETS}, 1000)) AS redacted FROM documents")
def v20(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.redact_secrets(F.col("text"))).alias("redacted"))


@check("v21_redact_terms", DOCS + "md5(left(replace(replace(replace(text, 'license', '[已隐藏]'), 'the', '[已隐藏]'), source, '[已隐藏]'), 500)) AS redacted "
       "FROM (SELECT doc_id, text, CASE WHEN length(source) >= 2 THEN source ELSE chr(1) END AS source FROM documents)")
def v21(spark, sf):
    # Terms never overlap each other in these texts, so the order of equal lengths does not show.
    terms = F.array(F.lit("license"), F.lit("the"), F.col("source"), F.lit("x"))
    return docs(spark, sf).select("doc_id", F.md5(X.redact_terms(F.col("text"), terms)).alias("redacted"))


@check("v22_whitelist_evidence", """SELECT event_id, json_extract_string(props, '$.k') AS issue_count, CAST(1 AS INTEGER) + CASE WHEN value > 20 THEN 1 ELSE 0 END
  AS kept FROM events""")
def v22(spark, sf):
    raw = F.concat(F.lit('{"issue_count": '), F.get_json_object("props", "$.k"), F.lit(', "secret": "x", "row_indices": [1], "decision": {'),
                   F.when(F.col("value") > 20, F.lit('"threshold": 0.5, ')).otherwise(F.lit("")), F.lit('"raw_value": 3}}'))
    kept = X.whitelist_evidence(raw)
    return load(spark, sf, "events").select("event_id", kept["issue_count"].alias("issue_count"), F.size(kept).alias("kept"))


@check("v23_safe_reason", """SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN '当前报告未提供可评估依据。' WHEN turn % 4 = 1 THEN left('数据集不包含记录：' || text, 500)
  ELSE '当前报告未提供可安全披露的可评估依据。' END AS shown FROM conversations""")
def v23(spark, sf):
    given = F.when(F.col("turn") % 4 == 0, "").when(F.col("turn") % 4 == 1, F.concat(F.lit("数据集不包含记录："), "text")).otherwise(F.col("text"))
    return load(spark, sf, "conversations").select("conv_id", "turn", X.safe_reason(given).alias("shown"))


@check("v24_mask_arguments", """SELECT conv_id, turn, 'text:' || length(text) || ':' || sha256(text) AS query, CAST(turn AS VARCHAR) AS lim, 'object:role,turn' AS filters, 'array:2' AS ids FROM conversations""")
def v24(spark, sf):
    arguments = F.to_json(F.struct(F.col("text").alias("query"), F.col("turn").alias("limit"),
                                   F.struct("turn", "role").alias("filters"), F.array("turn", "conv_id").alias("ids")))
    masked = X.mask_arguments(arguments)
    return load(spark, sf, "conversations").select(
        "conv_id", "turn", masked["query"].alias("query"), masked["limit"].alias("lim"), masked["filters"].alias("filters"), masked["ids"].alias("ids"))


@check("v25_content_id", """SELECT o_orderkey, 'order-' || left(sha256('[' || o_orderkey || ',"' || o_orderpriority || '",null]'), 12) AS id FROM orders""")
def v25(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", X.content_id(
        "order", [F.col("o_orderkey").cast("string"), X.json_text(F.col("o_orderpriority")), F.lit(None).cast("string")], 12).alias("id"))


D_TOKENS = "list_distinct(list_filter(regexp_extract_all({c}, '[A-Za-z0-9_./:-]+'), lambda x: length(x) >= 2))"


@check("v26_tokens", f"SELECT doc_id, md5(array_to_string(list_sort({D_TOKENS.format(c=d_casefold('text'))}), ' ')) AS terms FROM documents")
def v26(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(F.array_join(F.array_sort(X.tokens(F.col("text"))), " ")).alias("terms"))


@check("v27_normalize_filter", """SELECT p_partkey, lower(replace(p_name, ' ', '')) AS filter, upper(replace(p_name, ' ', '')) || '-1' AS standard FROM part""")
def v27(spark, sf):
    return load(spark, sf, "part").select(
        "p_partkey", X.normalize_filter(F.concat(F.lit("　"), "p_name")).alias("filter"),
        X.normalize_standard_number(F.concat("p_name", F.lit("－1"))).alias("standard"))


@check("v28_metric_codes", r"""SELECT doc_id, coalesce((SELECT string_agg('db31_' || c, ',' ORDER BY c) FROM (SELECT DISTINCT unnest(list_filter(
  regexp_extract_all(text || ' ' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || ' ' || (1000000 + doc_id), '[0-9]+'), lambda x: length(x) = 6)) AS c)), '') AS codes FROM documents""")
def v28(spark, sf):
    text = F.concat("text", F.lit(" "), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(" "), (F.col("doc_id") + 1000000).cast("string"))
    return docs(spark, sf).select("doc_id", F.array_join(X.metric_codes(text), ",").alias("codes"))


@check("v29_document_metadata", """SELECT doc_id, 'Notes on ' || source AS title, 'GB/T ' || (1000 + doc_id) AS standard_number, 'v' || (doc_id % 7) AS version,
  '2024-0' || (1 + doc_id % 9) || '-11' AS published_at FROM documents""")
def v29(spark, sf):
    head = F.format_string("preface\n## Notes on %s \nGB/T %d 版本：v%d 发布日期: 2024/0%d/11\n", F.col("source"), F.col("doc_id") + 1000,
                           F.col("doc_id") % 7, F.col("doc_id") % 9 + 1)
    return docs(spark, sf).select("doc_id", X.document_metadata(F.concat(head, "text")).alias("m")).select("doc_id", "m.*")


@check("v30_number_mentions", """SELECT o_orderkey, o_totalprice AS first_value, CAST(o_custkey AS DOUBLE) / 100.0 AS second_value, CAST(2 AS INTEGER) AS mentions FROM orders""")
def v30(spark, sf):
    text = F.concat(F.lit("total "), F.format_number("o_totalprice", 2), F.lit("; share "), F.col("o_custkey").cast("string"), F.lit("%, x1 v1.2"))
    found = X.number_mentions(text)
    return load(spark, sf, "orders").select("o_orderkey", F.get(found, F.lit(0))["value"].alias("first_value"),
                                            F.get(found, F.lit(1))["value"].alias("second_value"), F.size(found).alias("mentions"))


@check("v33_feature_id_check", "SELECT event_id, event_id % 4 < 2 AS ok FROM events")
def v33(spark, sf):
    from sparkassay.sources.files import feature_id_ok
    k, m = F.col("event_id").cast("string"), F.col("event_id") % 4
    raw = F.when(m == 0, k).when(m == 1, F.concat(F.lit('"e'), k, F.lit('"'))).when(m == 2, F.lit("true")).otherwise(F.concat(F.lit("["), k, F.lit("]")))
    return load(spark, sf, "events").select("event_id", feature_id_ok(F.try_parse_json(raw)).alias("ok"))


@check("v34_json_object_from_text", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events")
def v34(spark, sf):
    m = F.col("event_id") % 4
    text = F.when(m == 0, F.col("props")).when(m == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(
        m == 2, F.concat(F.lit("Here it is: "), "props", F.lit(" as asked."))).otherwise(F.lit("no object"))
    return load(spark, sf, "events").select("event_id", F.try_variant_get(X.json_object_from_text(text), "$.k", "int").alias("k"))


@check("v35_bounded_int", """SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN least(trunc(o_totalprice * 1000), 10000000) WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE trunc(o_totalprice) END AS BIGINT) AS n FROM orders""")
def v35(spark, sf):
    m, price = F.col("o_orderkey") % 4, F.col("o_totalprice").cast("decimal(20,2)")
    raw = F.when(m == 0, (price * 1000).cast("string")).when(m == 1, F.lit("n/a")).when(m == 2, F.concat(F.lit("-"), price.cast("string"))).otherwise(price.cast("string"))
    return load(spark, sf, "orders").select("o_orderkey", X.bounded_int(raw).alias("n"))


@check("v36_safe_identity", f"""SELECT doc_id, CASE WHEN t = '' THEN 'unknown' WHEN regexp_matches(t, '(?i)(api[_ -]?key|authorization|access[_ -]?token|bearer|\\bsk-[a-z0-9_-]{{6,}})')
  THEN '[redacted]' ELSE t END AS identity FROM (SELECT doc_id, left({d_strip("regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')")}, 100) AS t FROM documents)""")
def v36(spark, sf):
    return docs(spark, sf).select("doc_id", X.safe_identity(F.col("text")).alias("identity"))
