"""SRC rows: tables written by Spark as files of each format and read back."""


from pyspark.sql import functions as F

from sparkassay.operators.profile import size_limits
from sparkassay.session import scratch_path
from sparkassay.sources import files as S

from .registry import check, load


def written(spark, df, label, fmt="text", **options):
    path = scratch_path(spark, label)
    df.write.options(**options).format(fmt).save(path)
    return path


@check("src1_read_csv", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority || chr(10) || ' \"q\", ' AS note, '' AS empty FROM orders")
def src1(spark, sf):
    df = load(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.concat("o_orderpriority", F.lit('\n "q", ')).alias("note"), F.lit("").alias("empty"))
    path = written(spark, df, "csv", "csv", header=True, quote='"', escape='"', emptyValue="", ignoreTrailingWhiteSpace=False, ignoreLeadingWhiteSpace=False)
    return S.read_csv(spark, path).checked()


TYPED_CSV = """SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_custkey + 0.5 END AS DOUBLE) AS amount,
  CAST(9007199254740993 + o_orderkey AS DECIMAL(16,0)) AS wide, o_orderkey % 3 = 0 AS flag, CAST(18446744073709551615 - o_orderkey AS DECIMAL(20,0)) AS top,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS gaps FROM orders"""


def odd_notations(spark, sf):
    """Numbers with leading zeros, blanks, signs and needless decimals, written as CSV."""
    key, half = F.col("o_orderkey"), F.col("o_orderkey") % 2 == 0
    text = lambda c: c.cast("string")
    return load(spark, sf, "orders").select(
        F.when(key % 3 == 0, F.concat(F.lit("0"), text(key))).when(key % 3 == 1, F.concat(F.lit(" +"), text(key))).otherwise(text(key)).alias("id"),
        F.when(half, text(F.col("o_custkey"))).otherwise(F.concat(text(F.col("o_custkey")), F.lit(".50"))).alias("amount"),
        F.concat(text(F.lit(9007199254740993) + key), F.when(half, F.lit(".0")).otherwise(F.lit(""))).alias("wide"),
        F.when(key % 3 == 0, F.when(half, "True").otherwise("TRUE")).otherwise("false").alias("flag"),
        text(F.lit("18446744073709551615").cast("decimal(20,0)") - key).alias("top"),
        F.when(key % 5 == 0, F.lit("")).otherwise(text(key)).alias("gaps"))


def csv_of(spark, df, label):
    return written(spark, df, label, "csv", header=True, quote='"', escape='"', emptyValue="", ignoreTrailingWhiteSpace=False, ignoreLeadingWhiteSpace=False)


@check("src1_typed_csv", TYPED_CSV)
def src1_typed(spark, sf):
    df = S.read_csv(spark, csv_of(spark, odd_notations(spark, sf), "typed"), typed=True).checked()
    assert [t for _, t in df.dtypes] == ["bigint", "double", "decimal(16,0)", "boolean", "decimal(20,0)", "string"], df.dtypes
    return df


@check("src1_mixed_headers", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS note, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS state FROM orders")
def src1_mixed(spark, sf):
    """Three kinds of files in one folder: two orders of the columns, and one more column."""
    df = load(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("note"),
                                          F.col("o_orderstatus").alias("state"))
    path = scratch_path(spark, "mixed")
    for part, columns in enumerate((["note", "id", "state"], ["id", "note"], ["note", "id"])):
        df.where(F.col("id").cast("bigint") % 3 == part).select(*columns).write.mode("append").options(header=True).csv(path)
    return S.read_csv(spark, path).checked().select("id", "note", "state")


def rec():
    return F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                              F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("nation")))


CUSTOMERS = "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_nationkey <> 3 THEN CAST(c_nationkey AS BIGINT) END AS nation FROM customer"


def customer_groups(spark, sf):
    """A JSON array text per nation."""
    return load(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_join(F.collect_list(rec()), ",").alias("items"))


def per_file(spark, df, label):
    """One file per row: array documents are whole files."""
    path = scratch_path(spark, label)
    keyed = df.select(F.monotonically_increasing_id().alias("part"), "value")
    keyed.write.partitionBy("part").text(path)
    return path


@check("src2_read_json_records", CUSTOMERS)
def src2(spark, sf):
    docs = customer_groups(spark, sf).select(F.concat(F.lit("["), "items", F.lit("]")).alias("value"))
    return S.read_json_records(spark, per_file(spark, docs, "records")).checked()


@check("src3_read_json_wrapper", CUSTOMERS)
def src3(spark, sf):
    docs = customer_groups(spark, sf).select(
        F.concat(F.lit('{"code": 0, "result": {"total": 1, "list": ['), "items", F.lit("]}}")).alias("value"))
    return S.read_json_wrapper(spark, per_file(spark, docs, "wrapped")).checked()


@check("src4_read_json_matrix", "SELECT s_suppkey AS key, s_name AS name, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_nationkey AS BIGINT) END AS nation FROM supplier")
def src4(spark, sf):
    row = F.concat(F.lit("["), F.col("s_suppkey").cast("string"), F.lit(',"'), "s_name", F.lit('"'), F.when(
        F.col("s_suppkey") % 4 != 0, F.concat(F.lit(","), F.col("s_nationkey").cast("string"))).otherwise(F.lit("")), F.lit("]"))
    docs = load(spark, sf, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(row), ",").alias("rows")).select(
        F.concat(F.lit('[["key","name","nation"],'), "rows", F.lit("]")).alias("value"))
    return S.read_json_matrix(spark, per_file(spark, docs, "matrix")).checked()


@check("src5_read_json_lines", CUSTOMERS)
def src5(spark, sf):
    return S.read_json_lines(spark, written(spark, load(spark, sf, "customer").select(rec().alias("value")), "lines")).checked()


def point(x, y):
    return F.concat(F.lit('{"type":"Point","coordinates":['), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]}"))


@check("src6_read_geojson", "SELECT c_name AS name, CAST(c_custkey AS VARCHAR) AS id, 'Point' AS kind, CAST(c_nationkey AS DOUBLE) AS min_x, c_acctbal AS max_y FROM customer")
def src6(spark, sf):
    feature = F.concat(F.lit('{"type":"Feature","id":'), F.col("c_custkey").cast("string"), F.lit(',"properties":{"name":"'), "c_name",
                       F.lit('"},"geometry":'), point(F.col("c_nationkey"), F.col("c_acctbal").cast("decimal(20,2)")), F.lit("}"))
    docs = load(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_join(F.collect_list(feature), ",").alias("f")).select(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}")).alias("value"))
    df = S.read_geojson(spark, per_file(spark, docs, "geo")).checked()
    return df.select("name", F.col("__geojson_feature_id").alias("id"), F.col("__geojson_geometry_type").alias("kind"),
                     F.col("__geojson_min_x").alias("min_x"), F.col("__geojson_max_y").alias("max_y"))


@check("src7_geometry_summary", """SELECT l_orderkey, count(*) AS coordinate_count, CAST(min(l_linenumber) AS DOUBLE) AS min_x, min(l_quantity) AS min_y,
  CAST(max(l_linenumber) AS DOUBLE) AS max_x, max(l_quantity) AS max_y, count(*) >= 2 AS valid FROM lineitem GROUP BY 1""")
def src7(spark, sf):
    position = F.concat(F.lit("["), F.col("l_linenumber").cast("string"), F.lit(","), F.col("l_quantity").cast("string"), F.lit("]"))
    lines = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(position), ",").alias("p")).select(
        "l_orderkey", F.try_parse_json(F.concat(F.lit('{"type":"LineString","coordinates":['), "p", F.lit("]}"))).alias("g"))
    return lines.select("l_orderkey", S.geometry_summary("g").alias("s")).select(
        "l_orderkey", "s.coordinate_count", "s.min_x", "s.min_y", "s.max_x", "s.max_y", "s.valid")


@check("src8_strict_json_checks", """SELECT * FROM (SELECT 'duplicate key' AS reason, count(*) FILTER (event_id % 7 = 0) AS records FROM events UNION ALL
  SELECT 'NaN or Infinity', count(*) FILTER (event_id % 7 = 1) FROM events UNION ALL SELECT 'invalid JSON', count(*) FILTER (event_id % 7 = 2) FROM events UNION ALL
  SELECT 'nested cell', count(*) FILTER (event_id % 7 = 3) FROM events UNION ALL SELECT 'not an object', count(*) FILTER (event_id % 7 = 4) FROM events UNION ALL
  SELECT 'number out of range', count(*) FILTER (event_id % 7 = 5) FROM events UNION ALL SELECT 'unpaired surrogate', CAST(0 AS BIGINT))""")
def src8(spark, sf):
    k = F.get_json_object("props", "$.k")
    made = {0: ('{"k": ', ', "k": 1}'), 1: ('{"a": ', ', "b": NaN}'), 2: ('{"a": ', ""), 3: ('{"a": [', "]}"), 4: ("[", "]"), 5: ('{"a": ', ', "b": 1e999}')}
    line = F.col("props")
    for m, (head, tail) in made.items():
        line = F.when(F.col("event_id") % 7 == m, F.concat(F.lit(head), k, F.lit(tail))).otherwise(line)
    return S.strict_json_checks(load(spark, sf, "events").select(line.alias("value")))


@check("src10_file_parse_rate", "SELECT round_even(CAST(count(*) FILTER (t <> 'error') AS DOUBLE) / count(*), 6) AS value, count(*) AS files FROM (SELECT DISTINCT event_type AS t FROM events)")
def src10(spark, sf):
    line = F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), F.expr("left(props, 4)")).otherwise(F.col("props"))
    path = scratch_path(spark, "parsed")
    lines = load(spark, sf, "events").select(F.col("event_type").alias("kind"), line.alias("value"))
    lines.repartition("kind").write.partitionBy("kind").text(path)
    rate = S.file_parse_rate(spark, path)
    return rate.select("value", F.get_json_object("evidence", "$.attempted_file_count").cast("bigint").alias("files"))


@check("src11_size_limits", """SELECT * FROM (SELECT 'rows' AS limit_name, count(*) AS observed, count(*) > 500 AS exceeded FROM documents UNION ALL SELECT 'columns', CAST(5 AS BIGINT), false UNION ALL
  SELECT 'cells', count(*) * 5, false FROM documents UNION ALL SELECT 'large_text_cells', count(*) FILTER (octet_length(encode(text)) > 20000), count(*) FILTER (octet_length(encode(text)) > 20000) > 0 FROM documents)""")
def src11(spark, sf):
    return size_limits(load(spark, sf, "documents"), max_rows=500, max_cell_bytes=20000).select("limit_name", "observed", "exceeded")


