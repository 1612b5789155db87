"""File sources on small files with known contents."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkassay.sources import files as S


def rows(df):
    return [tuple(r) for r in df.collect()]


def put(tmp_path, name, content, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode(encoding))
    return str(path)


def test_csv(spark, tmp_path):
    path = put(tmp_path, "a.csv", "id,name,note\n01,NA,\"two\nlines\"\n\n2,\"say \"\"x\"\"\",\n3,short\n,,\n")
    assert S.has_quoted_newlines(spark, path)
    source = S.read_csv(spark, path)
    assert rows(source.checked()) == [("01", "NA", "two\nlines"), ("2", 'say "x"', ""), ("3", "short", None), ("", "", "")]
    plain = put(tmp_path, "b.csv", "﻿id,name\n1,a\n2,b\n")
    assert not S.has_quoted_newlines(spark, plain)
    assert S.read_csv(spark, plain).checked().columns == ["id", "name"]
    wide = S.read_csv(spark, put(tmp_path, "c.csv", "id,name\n1,a\n2,b,c\n"))
    with pytest.raises(S.SourceError):
        wide.checked()
    with pytest.raises(S.SourceError):
        S.read_csv(spark, put(tmp_path, "d.csv", "id,id\n1,2\n"))
    gbk = put(tmp_path, "e.csv", "名称,值\n政务,1\n", "gbk")
    assert S.detect_encoding(spark, gbk) == "GBK"
    assert rows(S.read_csv(spark, gbk).checked()) == [("政务", "1")]


TYPED = {
    "bigint": (["1", "01", " 2 ", "+3", "-9223372036854775808"], [1, 1, 2, 3, -(1 << 63)]),
    "decimal(20,0)": (["9223372036854775808", "1"], [Decimal(1 << 63), Decimal(1)]),
    "double": (["1", "1.0", "1e3", ".5", "-Inf"], [1.0, 1.0, 1000.0, 0.5, float("-inf")]),
    "decimal(17,1)": (["9007199254740993", "9007199254740992.0", "1.5"], [Decimal("9007199254740993.0"), Decimal("9007199254740992.0"), Decimal("1.5")]),
    "boolean": (["True", "false", "TRUE"], [True, False, True]),
}
UNTYPED = [["1", ""], ["nan", "1"], ["9223372036854775808", "-1"], ["99999999999999999999", "1"], ["1_000"], ["0x10"], ["1e400", "2"],
           ["1 2"], ["--1"], ["true", "1"], ["1d"], [" ", "1"], ["NA", "2"], ["1,5"], ["9" * 40, "1"], ["١"]]


def test_csv_types(spark, tmp_path):
    for i, (kind, (cells, values)) in enumerate(TYPED.items()):
        path = put(tmp_path, f"t{i}.csv", "n,s\n" + "".join(f"{c},x\n" for c in cells))
        df = S.read_csv(spark, path, typed=True).checked()
        assert df.schema["n"].dataType.simpleString() == kind and df.schema["s"].dataType.simpleString() == "string"
        assert [r.n for r in df.collect()] == values
    wide = spark.createDataFrame([tuple((c * 9)[i] for c in UNTYPED) for i in range(2)], [f"c{i}" for i in range(len(UNTYPED))])
    cells = [[r[i] for r in wide.collect()] for i in range(len(UNTYPED))]
    df = S.type_columns(wide)
    assert {t for _, t in df.dtypes} == {"string"} and [[r[i] for r in df.collect()] for i in range(len(UNTYPED))] == cells
    assert S.type_columns(wide.limit(0)).dtypes == wide.dtypes
    many = spark.range(50).select(*[(F.col("id") + i).cast("string").alias(f"c{i}") for i in range(400)])
    assert {t for _, t in S.type_columns(many).dtypes} == {"bigint"}


def test_csv_folder_of_different_files(spark, tmp_path):
    put(tmp_path, "a.csv", "id,name,note\n1,a,x\n2,b,y\n")
    put(tmp_path, "b.csv", "\n  \nname,id,note\nc,3,z\n")
    put(tmp_path, "c 1.csv", "name,id,extra\n政务,4,e\n", "gbk")
    put(tmp_path, "d.csv", 'id,name,note\n5,"two\nlines",w\n')
    source = S.read_csv(spark, str(tmp_path))
    assert sorted(map(tuple, source.checked().select("id", "name", "note", "extra").collect())) == [
        ("1", "a", "x", None), ("2", "b", "y", None), ("3", "c", "z", None), ("4", "政务", None, "e"), ("5", "two\nlines", "w", None)]
    assert "1 files read as GBK" in source.notes and "column extra is missing in some files" in source.notes
    put(tmp_path, "e.csv", "id,name,note\n6,é,q\n", "latin-1")
    source = S.read_csv(spark, str(tmp_path))
    assert source.frame.count() == 5
    with pytest.raises(S.SourceError, match="neither UTF-8 nor GBK: 1"):
        source.checked()
    assert S.detect_encoding(spark, str(tmp_path / "e.csv")) is None
    with pytest.raises(S.SourceError, match="neither"):
        S.read_csv(spark, str(tmp_path / "e.csv"))


def test_lines_are_not_sorted_to_find_headers(spark, tmp_path):
    put(tmp_path, "a.csv", "\n \t\nid,name\n1,a\n0,b\n")
    put(tmp_path, "b.csv", "id,名称\n1,政务\n", "gbk")
    put(tmp_path, "c.csv", "id\n\"two\nlines\"\n".encode() + b"\xff\xff\n")
    put(tmp_path, "d.csv", "\n\n")
    classes = S.file_classes(spark, str(tmp_path))
    assert sorted((r.file[-5:], r.encoding, r.multi_line) for r in classes.collect()) == [
        ("a.csv", "UTF-8", False), ("b.csv", "GBK", False), ("c.csv", None, True), ("d.csv", "UTF-8", False)]
    assert {r.file[-5:]: r.header for r in classes.collect() if r.file[-5:] != "b.csv"} == {"a.csv": "id,name", "c.csv": "id", "d.csv": None}
    plan = classes._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "SortAggregate" not in plan


def test_typed_cells_reach_rules_and_metrics(spark, tmp_path):
    import datetime as dt

    from sparkassay.operators import metrics as M
    from sparkassay.operators import rules as U
    from sparkassay.plans.rulebook import Rule

    path = put(tmp_path, "n.csv", "id,size,other\n1,10,9007199254740993\n01,10.0,9007199254740992\n+2,7,9007199254740993\n")
    day = dt.date(2026, 7, 17)

    def issues(typed, rule, metric):
        df = S.read_csv(spark, path, typed=typed).checked()
        return U.evaluate_rules(df, [rule], day).where(F.col("metric_id") == metric).first().issue_count

    key, wide = Rule("primary_key", ("id",)), Rule("primary_key", ("other",))
    allowed = Rule("allowed_values", ("size",), {"allowed_values": [10]})
    needed = Rule("conditional_required", ("size", "id"), {"condition_values": [10]})
    assert issues(True, key, "business_primary_key_compliance") == 2 and issues(False, key, "business_primary_key_compliance") == 0
    assert issues(True, wide, "business_primary_key_compliance") == 2  # 2^53 + 1 is not 2^53
    assert issues(True, allowed, "business_allowed_values_compliance") == 1 and issues(False, allowed, "business_allowed_values_compliance") == 3
    typed = S.read_csv(spark, path, typed=True).checked()
    row = U.evaluate_rules(typed, [needed], day).first()
    assert (row.checked_count, row.issue_count) == (2, 0)
    pairs = put(tmp_path, "p.csv", "a,b\n1,x\n01,x\n1.0,x\n2,x\n")
    for metric in ("exact_duplicate_rate", "normalized_duplicate_rate"):
        for kind, n in ((True, 2), (False, 0)):
            found = M.calculate_metrics(S.read_csv(spark, pairs, typed=kind).checked(), day, [metric]).first()
            assert found.issue_count == n, (metric, kind)


def test_json_records(spark, tmp_path):
    path = put(tmp_path, "a.json", '[{"b": 1, "a": "x", "n": 12345678901234567890}, {"a": null, "z": 1.5, "b": true}]')
    df = S.read_json_records(spark, path).checked()
    assert df.columns == ["b", "a", "n", "z"] and isinstance(df.schema["b"].dataType, T.VariantType)
    assert str(df.select("n").first().n) == "12345678901234567890"
    one = S.read_json_records(spark, put(tmp_path, "b.json", '{"id": 1, "name": "x"}')).checked()
    assert rows(one) == [(1, "x")]
    with pytest.raises(S.SourceError):
        S.read_json_records(spark, put(tmp_path, "c.json", '[{"a": {"b": 1}}]')).checked()
    with pytest.raises(S.SourceError):
        S.read_json_records(spark, put(tmp_path, "d.json", '[{"a": 1, "a": 2}]')).checked()


def test_json_lines(spark, tmp_path):
    path = put(tmp_path, "a.jsonl", '{"id": 1, "s": "x"}\n\n  \n{"id": 2, "s": "y"}\r\n{"id": 3}\n')
    assert sorted(rows(S.read_json_lines(spark, path).checked())) == [(1, "x"), (2, "y"), (3, None)]


def test_strict_checks(spark):
    lines = ['{"a":1}', '{"a":1,"a":2}', '{"a":NaN}', '{"a":1e999}', '{"a":[1]}', '{"a":"\\ud800"}', "[1]", "{oops",
             '{"a":"\\ud83d\\ude00"}', '{"a":"[NaN"}', ""]
    got = {r.reason: r.records for r in S.strict_json_checks(
        spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {"duplicate key": 1, "NaN or Infinity": 1, "invalid JSON": 1, "not an object": 1,
                   "nested cell": 1, "number out of range": 1, "unpaired surrogate": 1}


def test_wrapper_and_matrix(spark, tmp_path):
    wrapped = put(tmp_path, "w.json", json.dumps({"code": 0, "data": {"x": [], "list": [{"a": 1}, {"a": 2}]}}))
    source = S.read_json_wrapper(spark, wrapped)
    assert rows(source.checked()) == [(1,), (2,)] and source.notes == ["table read from $.data.list"]
    both = put(tmp_path, "x.json", json.dumps({"data": [{"a": 1}], "rows": [{"a": 1}]}))
    with pytest.raises(S.SourceError):
        S.read_json_wrapper(spark, both)
    matrix = put(tmp_path, "m.json", '{"code":200,"msg":"ok","data":[["所属","主键"],["a",1],["b"]]}')
    assert rows(S.read_json_wrapper(spark, matrix).checked()) == [("a", 1), ("b", None)]
    plain = put(tmp_path, "p.json", '[["编号","状态"],[1,"x"],[2]]')
    assert rows(S.read_json_matrix(spark, plain).checked()) == [(1, "x"), (2, None)]
    with pytest.raises(S.SourceError):
        S.read_json_matrix(spark, put(tmp_path, "q.json", '[["a"],[1,2]]')).checked()
    with pytest.raises(S.SourceError):
        S.read_json_matrix(spark, put(tmp_path, "r.json", '[["a","a"],[1,2]]'))


GEOMETRIES = {
    '{"type":"Point","coordinates":[1,2]}': ("Point", 1, 2, 1.0, 2.0, 1.0, 2.0, True),
    '{"type":"Point","coordinates":[1,2,3.5]}': ("Point", 1, 3, 1.0, 2.0, 1.0, 2.0, True),
    '{"type":"LineString","coordinates":[[0,0],[2,-1]]}': ("LineString", 2, 2, 0.0, -1.0, 2.0, 0.0, True),
    '{"type":"LineString","coordinates":[[0,0]]}': False,
    '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}': ("Polygon", 4, 2, 0.0, 0.0, 1.0, 1.0, True),
    '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1]]]}': False,
    '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[]]}': False,
    '{"type":"MultiPoint","coordinates":[[0,0],[5,6]]}': ("MultiPoint", 2, 2, 0.0, 0.0, 5.0, 6.0, True),
    '{"type":"Point","coordinates":["1",2]}': False, '{"type":"Point","coordinates":[1]}': False,
    '{"type":"Circle","coordinates":[1,2]}': False, '{"type":"Point"}': False,
    '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]},{"type":"GeometryCollection","geometries":'
    '[{"type":"Point","coordinates":[3,4]}]}]}': ("GeometryCollection", 2, 2, 1.0, 2.0, 3.0, 4.0, True),
}


def test_geometry_summary(spark):
    df = spark.createDataFrame([(g,) for g in GEOMETRIES], "t string").select(F.try_parse_json("t").alias("g"))
    got = [r.s for r in df.select(S.geometry_summary("g").alias("s")).collect()]
    for want, have in zip(GEOMETRIES.values(), got):
        assert (tuple(have) == want) if want else not have.valid


def test_geojson(spark, tmp_path):
    def feature(i, geometry, **props):
        return {"type": "Feature", "id": i, "properties": props, "geometry": geometry}

    point = {"type": "Point", "coordinates": [1, 2]}
    good = {"type": "FeatureCollection", "features": [feature("a", point, 名称="x", n=1), feature(2, None, n=2)]}
    df = S.read_geojson(spark, put(tmp_path, "g.geojson", json.dumps(good))).checked()
    assert df.columns[:3] == ["名称", "n", "__geojson_feature_id"]
    assert [(r["n"], r["__geojson_geometry_type"], r["__geojson_feature_id"]) for r in df.collect()] == [
        (1, "Point", "a"), (2, None, "2")]
    lines = put(tmp_path, "l.geojsonl", "\n".join(json.dumps(f) for f in good["features"]))
    assert S.read_geojson(spark, lines, lines=True).checked().count() == 2
    for bad in ({"type": "FeatureCollection", "features": [feature(True, point)]},
                {"type": "FeatureCollection", "features": [feature(1, {"type": "Point", "coordinates": [1]})]},
                {"type": "FeatureCollection", "features": [feature(1, point, __geojson_x=1)]},
                {"type": "FeatureCollection", "features": [feature(1, point, x=[1])]}, {"type": "Feature"}):
        with pytest.raises(S.SourceError):
            S.read_geojson(spark, put(tmp_path, "b.geojson", json.dumps(bad))).checked()


def test_parse_rate(spark, tmp_path):
    put(tmp_path, "ok.jsonl", '{"a":1}\n{"a":2}\n')
    put(tmp_path, "bad.jsonl", '{"a":1}\n{"a"\n')
    row = S.file_parse_rate(spark, str(tmp_path)).first()
    assert row.value == 0.5 and '"failed_file_count":1' in row.evidence


def test_record_numbers_follow_path_order(spark, tmp_path):
    from sparkassay.operators.locate import with_record_number

    sizes = {"a": 2, "b": 5000, "c": 1, "d": 700}
    start = 0
    for name, n in sizes.items():
        (tmp_path / f"{name}.csv").write_text("id\n" + "".join(f"{start + i}\n" for i in range(n)))
        start += n
    numbered = with_record_number(spark.read.csv(str(tmp_path), header=True, schema="id long"))
    assert numbered.where("record_number <> id + 1").count() == 0 and numbered.count() == start
    assert sorted(r.record_number for r in with_record_number(spark.range(20).repartition(3)).collect()) == list(range(1, 21))


def test_report_hash_covers_all_tables(spark):
    from sparkassay.operators.report import rows_fingerprint

    df = spark.createDataFrame([(1, ["a"], None), (2, [], 1.5)], "i int, a array<string>, d double")
    base = rows_fingerprint(df).first()
    assert base == rows_fingerprint(df.repartition(2)).first() != rows_fingerprint(df.where("i = 1")).first()
    assert base != rows_fingerprint(df.union(df.limit(1))).first()


def test_a_geometry_is_taken_apart_once(spark):
    plan = spark.range(1).select(F.parse_json(F.lit('{"type":"Point","coordinates":[1,2]}')).alias("g")).select(S.geometry_summary("g").alias("s"))
    text = plan._jdf.queryExecution().analyzed().toString()
    assert text.count("$.geometries") == 4  # one for each level of nesting
    row = plan.first().s
    assert (row.coordinate_count, row.min_x, row.max_y, row.valid) == (1, 1.0, 2.0, True)
