"""Cell-level expressions against exact expected answers."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkassay.functions import values as V
from sparkassay.plans.cells import Cells


def evaluate(spark, rows, build, dtype="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {dtype}")
    return [r.v for r in df.select("i", build(F.col("c")).alias("v")).orderBy("i").collect()]


def test_missing(spark):
    got = evaluate(spark, [None, "", "  ", " 　\x1f", "x", " 0 "], V.is_missing)
    assert got == [True, True, True, True, False, False]
    got = evaluate(spark, [None, float("nan"), 0.0], lambda c: V.is_missing(c, T.DoubleType()), "double")
    assert got == [True, True, False]


def test_value_type(spark):
    cases = {
        " yes ": "boolean", "是": "boolean", "12": "numeric", "-1.5e3": "numeric", "inf": "numeric",
        ".5": "numeric", "5.": "numeric", "1,000": "text", "1_000": "text", "1d": "text", "1f": "text",
        "1e400": "text", "nan": "text", "2026-06-01": "datetime", "2026/6/1 10:00": "datetime",
        "2026-13-01": "text", "2026-06-01T00:00:00+08:00": "datetime", "2026年6月1日": "text",
        "06/03/2026": "text", "abc": "text", "20260601": "numeric", None: None, " ": None,
    }
    assert evaluate(spark, list(cases), V.value_type) == list(cases.values())


def test_datetime(spark):
    cases = {
        "2026-06-01": (2026, 6, 1), " 2026/6/3 ": (2026, 6, 3), "2026.06.01": (2026, 6, 1),
        "20260601": (2026, 6, 1), "2026-06": (2026, 6, 1), "2026": (2026, 1, 1),
        "06/03/2026": (2026, 6, 3), "31/12/2026": (2026, 12, 31), "Jun 1 2026": (2026, 6, 1),
        "1 Jun 2026": (2026, 6, 1), "June 1, 2026": (2026, 6, 1),
        "2026-01-02T00:00:00+08:00": (2026, 1, 2), "2026-06-01 10:30": (2026, 6, 1, 10, 30),
        "2026-06-01T10:30:15.25Z": (2026, 6, 1, 10, 30, 15, 250000),
        "today": None, "12:30": None, "2026年6月1日": None, "1500-01-01": None, "2300-01-01": None,
        "2026-02-30": None, "待更新": None, "": None, "99999999": None, "mayor": None,
    }
    want = [dt.datetime(*v) if v else None for v in cases.values()]
    assert evaluate(spark, list(cases), V.parse_datetime) == want
    assert evaluate(spark, [20260601], lambda c: V.parse_datetime(c, T.LongType()), "long") == [
        dt.datetime(2026, 6, 1)]
    assert evaluate(spark, [20260601], lambda c: V.parse_datetime_strict(c, T.LongType()), "long") == [None]


def test_formats(spark):
    cases = {
        "http://a.b/c d": True, "HTTPS://x": True, "http://[::1": False, "http://[::1]/x": True,
        "ftp://x": False, "http:///x": False, "x": False, None: False,
    }
    assert evaluate(spark, list(cases), V.is_valid_url) == list(cases.values())
    cases = {"a@b.c": True, "a@b": False, "a b@c.d": False, "a@b@c.d": False, " a@b.c ": True}
    assert evaluate(spark, list(cases), V.is_valid_email) == list(cases.values())
    cases = {"v1.2": True, "1.0-beta": True, "ABC-12": True, "a-b": False, "text": False, "a@b.c": True}
    assert evaluate(spark, list(cases), V.looks_structured) == list(cases.values())


def test_normalized_key(spark):
    key = lambda c: V.normalized_key(c, T.StringType())
    a, b, c, d, e, f, g, h = evaluate(
        spark, ["政务 Service", " 政务service ", "其他", "", " ", "STRASSE", "straße!", "v1.0"], key)
    assert a == b != c and d is None and e is None and f == g and h == "=v1.0"


def test_casefold_is_complete(spark):
    text = "".join(chr(p) for p in range(0x21, 0x3000) if not 0xD800 <= p <= 0xDFFF)
    words = [ch for ch in text if ch.casefold() != ch]
    got = evaluate(spark, words, V.casefold)
    wrong = [(w, g, w.casefold()) for w, g in zip(words, got) if g != w.casefold()]
    assert len(wrong) <= 3, wrong  # letters newer than the JVM's Unicode tables


def test_compare(spark):
    df = spark.createDataFrame(
        [("1.0", "1"), ("2", "10"), ("b", "a"), ("2026-01-02", "2026/1/3"), ("1", "x"), ("", "x"),
         ("1e30", "2e30"), ("1_0", "9")], "l string, r string")
    cells = Cells(df)
    cols = [cells.compared("l", "r", op, k).alias(f"{op}_{k}")
            for op, k in (("eq", "auto"), ("lt", "auto"), ("lt", "numeric"), ("lt", "text"), ("neq", "auto"))]
    got = [tuple(r) for r in cells.project().select(*cols).collect()]
    assert got == [
        (True, False, False, False, False), (False, True, True, False, True),
        (False, False, None, False, True), (False, True, None, True, True),
        (False, False, None, True, False), (None, None, None, None, None),
        (False, True, True, True, True), (False, False, False, True, True)]


def test_allowed_values_keep_classes_apart(spark):
    got = evaluate(spark, [1.0, None], lambda c: V.matches_any(c, T.DoubleType(), [1]), "double")
    assert got == [True, False]
    got = evaluate(spark, [True, False], lambda c: V.matches_any(c, T.BooleanType(), [1]), "boolean")
    assert got == [False, False]


def test_fullmatch(spark):
    got = evaluate(spark, ["12", "12\n", "a12", "x" * 10_001, None], lambda c: V.regex_fullmatch(c, r"\d+|x+"))
    assert got == [True, False, False, False, None]


def test_numbers_that_decimals_cannot_hold(spark):
    from pyspark.sql import types as T

    row = spark.createDataFrame([("1e-20", "2e-20")], "a string, b string").select(
        V.parse_decimal(F.col("a")).alias("a"), V.parse_decimal(F.col("b")).alias("b")).first()
    assert row.a.exact is None and row.b.exact is None and row.a.wide != row.b.wide
    big = spark.sql("SELECT parse_json(x) AS v FROM VALUES ('9007199254740993'), ('9007199254740992'), ('1.50'), ('1.5') AS t(x)")
    assert big.select(V.comparison_key(F.col("v"), T.VariantType()).alias("k")).distinct().count() == 3
    wide = spark.sql("SELECT CAST('99999999999999999999999999999999999999' AS decimal(38,0)) AS w, CAST(1.5 AS decimal(20,14)) AS s")
    assert tuple(wide.select(*[V.comparison_key(F.col(c), wide.schema[c].dataType) for c in "ws"]).first()) == ("number:" + "9" * 38, "number:1.5")
