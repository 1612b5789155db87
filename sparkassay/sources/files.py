"""File sources: CSV and the JSON family, read by Spark's own readers.

CSV and line-delimited files are split across tasks.  A JSON array, envelope or FeatureCollection
is one value, so Spark can only parallelise over files there; large data belongs in JSON Lines.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..plans.cells import ref

# --- fixed values ------------------------------------------------------------------------
WRAPPER_KEYS = ("data", "rows", "records", "items", "list", "result")
GEO_PREFIX = "__geojson_"
GEO_DEPTH = {
    "Point": 1, "MultiPoint": 2, "LineString": 2, "MultiLineString": 3, "Polygon": 3, "MultiPolygon": 4,
}
GEO_SUMMARY = ("geometry_type", "coordinate_count", "coordinate_dimension", "min_x", "min_y", "max_x", "max_y")
MAX_ENVELOPE_DEPTH = 32

_CORRUPT = "__corrupt_record"


class SourceError(ValueError):
    """The input is not one readable table."""


@dataclass
class Source:
    """A table with what was noticed while reading; ``problems`` has columns (reason, records)."""
    frame: DataFrame
    problems: DataFrame | None = None
    notes: list[str] = field(default_factory=list)

    def checked(self) -> DataFrame:
        """The table, or an error if any record was rejected (one aggregate over the input)."""
        if self.problems is not None:
            found = [f"{r.reason}: {r.records}" for r in self.problems.where("records > 0").collect()]
            if found:
                raise SourceError("; ".join(found))
        return self.frame


# ------------------------------------------------------------------ CSV
def file_classes(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, encoding, multi_line) of each text file: its first line that is not blank, the first of UTF-8
    and GBK in which all its bytes are valid (else null), and whether records may span lines.

    One scan of the raw lines; what each task has seen of a file is merged. GBK is judged by the ranges of its bytes.
    A task holds one entry for each of its files: next to collect_set Spark keeps entries as objects, where min_by over
    text alone would sort all lines of the task by file.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"), "value")
    utf8 = F.is_valid_utf8("value")
    # Bytes as characters of one byte each; what is left without all valid pairs is not GBK.
    rest = F.regexp_replace(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), r"[\x00-\x7f]|[\x81-\xfe][\x40-\x7e\x80-\xfe]", "")
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    text = F.when(F.length(F.btrim("value", F.lit(" \t\r\n"))) > 0, F.col("value"))
    # A record with an odd number of quotes in its first line goes on in the next one.
    found = raw.groupBy("file").agg(
        F.min_by(text, F.when(text.isNotNull(), F.struct("block", "n"))).alias("header"),
        F.collect_set(F.when(utf8, "UTF-8").when(rest == "", "GBK").otherwise("")).alias("needs"),
        F.some(quotes % 2 == 1).alias("multi_line"))
    needs = lambda encoding: F.array_contains("needs", encoding)
    return found.select("file", "header", F.when(~needs(""), F.when(needs("GBK"), "GBK").otherwise("UTF-8")).alias("encoding"), "multi_line")


def detect_encoding(spark: SparkSession, path: str) -> str | None:
    """UTF-8 if all lines are valid, else GBK if they are valid there."""
    found = {r.encoding for r in file_classes(spark, path).select("encoding").distinct().collect()}
    return found.pop() if len(found) == 1 else (None if None in found else "GBK")


def has_quoted_newlines(spark: SparkSession, path: str) -> bool:
    """Whether records may span lines: such a record opens with an odd number of quotes."""
    return not file_classes(spark, path).where("multi_line").isEmpty()


def read_csv(
    spark: SparkSession, path: str, delimiter: str = ",", encoding: str | None = None,
    multi_line: bool | None = None, typed: bool = False,
) -> Source:
    """CSV with headers; short records are padded, wide ones are problems.

    The files of a folder need not agree: those of one header, encoding and kind are read together, the tables are
    joined by column name, and a column that a file lacks is null there.  Files that are neither UTF-8 nor GBK are problems.
    Files without quoted newlines are read splittably.  Cells stay text unless ``typed``, see ``type_columns``.
    """
    classes = file_classes(spark, path)
    if encoding is not None:
        classes = classes.withColumn("encoding", F.lit(encoding))
    if multi_line is not None:
        classes = classes.withColumn("multi_line", F.lit(multi_line))
    # As many rows as there are kinds of files, with the paths that the driver lists for the scan anyway.
    groups = classes.groupBy("header", "encoding", "multi_line").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    broken = [f for g in groups if g.encoding is None for f in g.files]
    readable = sorted((g for g in groups if g.encoding is not None and g.header is not None), key=lambda g: g.files[0])
    if not readable:
        raise SourceError("the files are neither UTF-8 nor GBK" if broken else "the file has no header")
    whole = len(groups) == 1
    sources = [_read_class(spark, path if whole else [unquote(f) for f in g.files], delimiter, g.encoding, g.multi_line) for g in readable]
    frame, problems = sources[0].frame, sources[0].problems
    for s in sources[1:]:
        frame, problems = frame.unionByName(s.frame, allowMissingColumns=True), problems.unionByName(s.problems)
    if len(sources) > 1:
        problems = problems.groupBy("reason").agg(F.sum("records").alias("records"))
    if broken:
        problems = problems.unionByName(spark.createDataFrame(
            [("files that are neither UTF-8 nor GBK", len(broken))], "reason string, records bigint"))
    notes = [f"{sum(len(g.files) for g in readable if g.encoding == e)} files read as {e}" for e in sorted({g.encoding for g in readable} - {"UTF-8"})]
    lacking = {c for s in sources for c in frame.columns if c not in s.frame.columns}
    notes += [f"column {c} is missing in some files" for c in frame.columns if c in lacking]
    return Source(type_columns(frame) if typed else frame, problems, notes)


def _read_class(spark: SparkSession, path: str | list[str], delimiter: str, encoding: str, multi_line: bool) -> Source:
    """Files that share a header; ``problems`` counts wide records and those with NUL characters."""
    if encoding.upper() in ("GBK", "GB18030", "GB2312"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # without it Spark refuses these encodings
    options = dict(sep=delimiter, encoding=encoding, multiLine=multi_line, quote='"', escape='"',
                   emptyValue="", maxCharsPerColumn=-1)
    first = spark.read.options(header=False, **options).csv(path).limit(1).collect()
    if not first:
        raise SourceError("the file has no header")
    header = [("" if v is None else v).lstrip("\ufeff") for v in first[0]]
    repeated = names.header_problems(header)
    if repeated:
        raise SourceError(f"duplicate column names: {', '.join(repeated)}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*header, _CORRUPT]])
    raw = (
        spark.read.schema(schema)
        .options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT, enforceSchema=True, **options)
        .csv(path)
    )
    # The reader cannot tell an empty cell from an absent one, and reports short and wide records
    # alike; for those few records the separators outside quotes are counted.
    bare = F.regexp_replace(F.col(_CORRUPT), r'"(?:[^"]|"")*"', "")
    cells = F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1
    odd = F.col(_CORRUPT).isNotNull()
    wide = odd & (cells > len(header))
    nul = F.lit(False)
    for n in header:
        nul = nul | F.coalesce(F.contains(F.col(ref(n)), F.lit("\x00")), F.lit(False))
    problems = _problem_counts(raw, {"more cells than header columns": wide, "NUL character": nul})
    frame = raw.select(*[
        F.coalesce(F.col(ref(n)), F.when(~odd | (cells > i), F.lit(""))).alias(n) for i, n in enumerate(header)])
    return Source(frame, problems)


#: How numbers and truth values are written.
WHOLE = r"^[+-]?[0-9]+$"
NUMBER = r"(?i)^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"
ENDLESS = r"(?i)^[+-]?inf(inity)?$"
TRUTH = r"(?i)^(true|false)$"
BLANKS = " \t\n\x0b\f\r"
LONG_RANGE = (-(1 << 63), (1 << 63) - 1)
UNSIGNED_LONG = (1 << 64) - 1
DOUBLE_DIGITS, DECIMAL_DIGITS = 15, 38


def column_kinds(frame: DataFrame) -> DataFrame:
    """What the cells of each text column are, one row per column: (place, cells, empty, truth, whole, exact, numbers,
    smallest, largest, digits, scale, plain).

    Cells are taken apart into (column number, cell) and merged in each task, so the plan stays small however
    wide the table is. Two such rows merge into one by sums, minima and maxima.
    """
    columns = [i for i, f in enumerate(frame.schema) if isinstance(f.dataType, T.StringType)]
    if not columns:
        columns_array = F.expr("cast(array() as array<struct<place: int, cell: string>>)")
    else:
        columns_array = F.array(*[F.struct(F.lit(i).alias("place"), F.col(ref(frame.columns[i])).alias("cell")) for i in columns])
    cell = F.coalesce("c.cell", F.lit(""))
    cells = frame.select(F.explode(columns_array).alias("c")).select("c.place", cell.alias("cell"), F.btrim(cell, F.lit(BLANKS)).alias("t"))
    wide = F.col("t").try_cast("double")
    written = F.col("t").rlike(NUMBER) & (F.abs(wide) < F.lit(float("inf")))
    whole = F.col("t").rlike(WHOLE)
    exact = F.when(whole, F.col("t").try_cast("decimal(38,0)"))
    whole_digits = F.length(F.regexp_extract("t", r"^[+-]?0*([0-9]*)", 1))
    scale = F.length(F.regexp_extract("t", r"\.([0-9]*?)0*$", 1))
    return cells.groupBy("place").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("cell") == "").alias("empty"),
        F.count_if(F.col("cell").rlike(TRUTH)).alias("truth"), F.count_if(whole).alias("whole"), F.count(exact).alias("exact"),
        F.count_if(written | F.col("t").rlike(ENDLESS)).alias("numbers"),
        F.min(exact).alias("smallest"), F.max(exact).alias("largest"),
        F.max(F.when(written, whole_digits)).alias("digits"), F.max(F.when(written, scale)).alias("scale"),
        F.every(F.col("t").rlike(r"^[+-]?[0-9.]+$")).alias("plain"))


def _kind_of(k) -> str | None:
    """The type that holds all cells of a column without loss, None for text."""
    if not k.cells or k.empty:
        return None
    if k.truth == k.cells:
        return "boolean"
    if k.whole == k.cells:
        if k.exact < k.cells:
            return None
        if LONG_RANGE[0] <= k.smallest and k.largest <= LONG_RANGE[1]:
            return "bigint"
        return "decimal(20,0)" if k.smallest >= 0 and k.largest <= UNSIGNED_LONG else None
    if k.numbers != k.cells:
        return None
    if k.plain and DOUBLE_DIGITS < k.digits + k.scale <= DECIMAL_DIGITS:
        return f"decimal({k.digits + k.scale},{k.scale})"
    return "double"


def type_columns(frame: DataFrame) -> DataFrame:
    """Text columns whose every cell is written as a number or truth value get that type; one pass over the cells.

    Whole numbers become bigint, or decimal(20,0) above its range up to 2^64; other numbers double, or a decimal where plain
    digits would be lost in a double. A column with an empty or absent cell, or with any other cell, stays text.
    """
    kinds = {k.place: _kind_of(k) for k in column_kinds(frame).collect()}  # one row per column
    return frame.select(*[
        F.btrim(F.col(ref(c)), F.lit(BLANKS)).cast(kinds[i]).alias(c) if kinds.get(i) else F.col(ref(c))
        for i, c in enumerate(frame.columns)])


def _problem_counts(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    one = df.agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(flags.values())])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(reason).alias("reason"), F.col(f"n{i}").alias("records"))
        for i, reason in enumerate(flags)])).alias("p")).select("p.*")


# ------------------------------------------------------------------ JSON records
def strict_json_flags(text: Column) -> dict[str, Column]:
    """Per-record reasons for which strict JSON reading rejects one object."""
    value = F.try_parse_json(text)
    cells = F.map_values(F.try_variant_get(value, "$", "map<string,variant>"))
    keys = F.json_object_keys(text)
    repeated = F.coalesce(F.size(F.array_distinct(keys)) < F.size(keys), F.lit(False))
    constant = text.rlike(r"[:,\[]\s*-?(NaN|Infinity)\b")
    kinds = F.transform(cells, lambda v: F.schema_of_variant(v))
    infinite = F.exists(cells, lambda v: (F.schema_of_variant(v) == "DOUBLE") & F.try_variant_get(
        v, "$", "string").isin("Infinity", "-Infinity"))
    lone = (r"(?<!\\)(?:\\\\)*(?:\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])|"
            r"(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u[dD][c-fC-F][0-9a-fA-F]{2})")
    flags = {
        "duplicate key": repeated,
        "NaN or Infinity": constant & value.isNull() & ~repeated,
        "invalid JSON": value.isNull() & ~constant & ~repeated,
        "not an object": value.isNotNull() & ~F.schema_of_variant(value).startswith("OBJECT"),
        "nested cell": F.exists(kinds, lambda k: k.rlike("^(OBJECT|ARRAY)")),
        "number out of range": infinite,
        "unpaired surrogate": text.rlike(lone),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}


def strict_json_checks(lines: DataFrame, column: str = "value") -> DataFrame:
    """Counts of rejected records by reason; one pass."""
    present = lines.where(F.length(F.btrim(F.col(column), F.lit(" \t\r\n"))) > 0)
    return _problem_counts(present, strict_json_flags(F.col(column)))


def _column_order(records: DataFrame) -> list[str]:
    """Field names in first-seen order (as many rows on the driver as there are columns)."""
    seen = records.select("record", F.posexplode(F.json_object_keys("text")).alias("place", "key"))
    first = seen.groupBy("key").agg(F.min(F.struct("record", "place")).alias("first"))
    return [r.key for r in first.orderBy("first").select("key").collect()]


def _path(key: str) -> str:
    return "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _typed(values: DataFrame, columns: list[str]) -> DataFrame:
    """Native types where a column has one scalar type, VARIANT where types are mixed."""
    if not columns:
        return values.select()
    kinds = values.agg(*[F.schema_of_variant_agg(F.col(ref(c))).alias(ref(c)[1:-1]) for c in columns]).first()
    nested = [c for c, k in zip(columns, kinds) if k and k.startswith(("OBJECT", "ARRAY"))]
    if nested:
        raise SourceError(f"nested cells in: {', '.join(nested[:10])}")
    out = []
    for c, kind in zip(columns, kinds):
        col = F.col(ref(c))
        if kind in (None, "VOID"):
            out.append(F.try_variant_get(col, "$", "string").alias(c))
        elif kind == "VARIANT":
            out.append(col.alias(c))
        else:
            out.append(F.try_variant_get(col, "$", kind.lower()).alias(c))
    return values.select(*out)


def _records_table(records: DataFrame) -> Source:
    """Table from raw object texts; ``records`` has columns (record, text)."""
    columns = _column_order(records)
    flags = strict_json_flags(F.col("text"))
    parsed = records.select("record", F.try_parse_json("text").alias("__value"))
    values = parsed.select(*[F.try_variant_get("__value", _path(c), "variant").alias(c) for c in columns])
    return Source(_typed(values, columns), _problem_counts(records, flags))


def _documents(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """One row per file: (path, text)."""
    if encoding.upper() == "UTF-8":
        df = spark.read.option("wholetext", True).text(path)
        text = F.col("value")
    else:
        df = spark.read.format("binaryFile").load(path)
        text = F.decode(F.col("content"), encoding)
    return df.select(F.col("_metadata.file_path").alias("path"), F.ltrim(text, F.lit("\ufeff")).alias("text"))


def _array_elements(documents: DataFrame, array_text: Column) -> DataFrame:
    elements = documents.select("path", F.posexplode(F.from_json(array_text, "array<string>")).alias("place", "text"))
    return elements.select(F.struct("path", "place").alias("record"), "text")


def read_json_records(spark: SparkSession, path: str, encoding: str = "UTF-8") -> Source:
    """A JSON array of flat objects, or one flat object per file."""
    docs = _documents(spark, path, encoding)
    text = F.when(F.ltrim("text", F.lit(" \t\r\n")).startswith("{"), F.concat(F.lit("["), "text", F.lit("]"))).otherwise(F.col("text"))
    return _records_table(_array_elements(docs, text))


def read_json_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> Source:
    """One flat object per non-blank line; splittable."""
    lines = spark.read.option("encoding", encoding).text(path)
    text = F.btrim("value", F.lit(" \t\r\n\ufeff"))
    records = lines.select(
        F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id().alias("line")).alias("record"),
        text.alias("text")).where("text <> ''")
    source = _records_table(records)
    source.notes.append("JSON Lines: one record per non-blank line")
    return source


def _classify(kind: str | None, inner: list[str]) -> str | None:
    """What a JSON value is as a table, from its own and its elements' types."""
    if kind is None:
        return None
    if kind.startswith("OBJECT"):
        return None if any(k.startswith(("OBJECT", "ARRAY")) for k in inner) else "record"
    if kind.startswith("ARRAY"):
        if not inner:
            return "empty"
        if all(k.startswith("OBJECT") for k in inner):
            return "records"
        if all(k.startswith("ARRAY") for k in inner):
            return "matrix"
    return None


def _inspect(value: Column) -> Column:
    """(type of a value, distinct types of its members) without moving the value itself."""
    members = F.coalesce(
        F.try_variant_get(value, "$", "array<variant>"),
        F.map_values(F.try_variant_get(value, "$", "map<string,variant>")))
    kinds = F.array_distinct(F.transform(members, lambda v: F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)))
    return F.struct(F.schema_of_variant(value).alias("kind"), F.coalesce(kinds, F.expr("cast(array() as array<string>)")).alias("inner"))


def find_table_path(documents: DataFrame) -> tuple[str, str]:
    """(path, kind) of the only table below the known envelope keys; short strings per level."""
    docs = documents.select(F.try_parse_json("text").alias("v"))
    if docs.where("v is null").limit(1).count():
        raise SourceError("invalid JSON")
    top = docs.select(_inspect(F.col("v")).alias("i")).distinct().collect()
    kinds = {_classify(r.i.kind, r.i.inner) for r in top}
    if kinds and None not in kinds:
        if len(kinds) > 1:
            raise SourceError("the files hold different kinds of tables")
        return "$", kinds.pop()
    found: list[tuple[str, str]] = []
    frontier = ["$"]
    for _ in range(MAX_ENVELOPE_DEPTH):
        paths = [f"{p}.{k}" for p in frontier for k in WRAPPER_KEYS]
        rows = docs.select(F.explode(F.array(*[
            F.struct(F.lit(p).alias("path"), _inspect(F.try_variant_get("v", p, "variant")).alias("i")) for p in paths
        ])).alias("r")).select("r.path", "r.i.kind", "r.i.inner").where("kind is not null").distinct().collect()
        frontier = []
        for r in rows:
            kind = _classify(r.kind, r.inner)
            if kind is not None:
                found.append((r.path, kind))
            elif r.kind.startswith("OBJECT"):
                frontier.append(r.path)
        if not frontier:
            break
    found = sorted(set(found))
    if len(found) > 1:
        raise SourceError(f"several tables: {', '.join(p for p, _ in found[:2])}")
    if not found:
        raise SourceError("no table in the known envelope paths")
    return found[0]


def read_json_wrapper(spark: SparkSession, path: str, encoding: str = "UTF-8") -> Source:
    """An envelope such as ``{"code": 0, "data": [...]}``; the table's path becomes a note."""
    docs = _documents(spark, path, encoding)
    at, kind = find_table_path(docs)
    inner = docs.select("path", (F.col("text") if at == "$" else F.get_json_object("text", at)).alias("text"))
    if kind == "matrix":
        source = _matrix_table(inner)
    elif kind == "record":
        source = _records_table(_array_elements(inner, F.concat(F.lit("["), "text", F.lit("]"))))
    else:
        source = _records_table(_array_elements(inner, F.col("text")))
    if at != "$":
        source.notes.append(f"table read from {at}")
    return source


def _matrix_table(documents: DataFrame) -> Source:
    rows = documents.select("path", F.posexplode(F.from_json("text", "array<string>")).alias("place", "text"))
    head = rows.where("place = 0").select(
        F.transform(F.try_variant_get(F.try_parse_json("text"), "$", "array<variant>"),
                    lambda v: F.try_variant_get(v, "$", "string")).alias("header")).distinct().collect()
    if not head:
        return Source(documents.sparkSession.createDataFrame([], T.StructType([])))
    if len(head) > 1:
        raise SourceError("the files have different headers")
    header = ["" if h is None else h for h in head[0].header]
    repeated = names.header_problems(header)
    if repeated:
        raise SourceError(f"duplicate column names: {', '.join(repeated)}")
    body = rows.where("place > 0").select(
        F.try_variant_get(F.try_parse_json("text"), "$", "array<variant>").alias("cells"))
    nested = F.exists("cells", lambda v: F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"))
    problems = _problem_counts(body, {
        "more cells than header columns": F.size("cells") > len(header),
        "nested cell": F.coalesce(nested, F.lit(False)),
        "not an array": F.col("cells").isNull()})
    values = body.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(header)])
    return Source(_typed(values, header), problems, ["two-dimensional array with a header row"])


def read_json_matrix(spark: SparkSession, path: str, encoding: str = "UTF-8") -> Source:
    """A list of lists whose first row is the header; short rows are padded with null."""
    return _matrix_table(_documents(spark, path, encoding))


# ------------------------------------------------------------------ GeoJSON
def geometry_summary(geometry: str, nesting: int = 4) -> Column:
    """Type, position count, dimension and bounds of a GeoJSON geometry (a VARIANT column name).

    ``valid`` is false for anything the format forbids: unknown types, wrong depth, positions that
    are not two or three finite numbers, lines under two positions, rings that are short or open.
    Collections are opened ``nesting`` levels deep; deeper ones are reported as not valid.
    """
    kind = "try_variant_get({g}, '$.type', 'string')"
    leaves = f"array({geometry})"
    for _ in range(nesting):
        leaves = (f"flatten(transform({leaves}, g -> if(coalesce({kind.format(g='g')} = 'GeometryCollection', false), "
                  f"coalesce(try_variant_get(g, '$.geometries', 'array<variant>'), array(cast(null as variant))), array(g))))")
    coordinates = "try_variant_get(g, '$.coordinates', '{t}')"

    def nest(depth: int) -> str:
        return "array<" * depth + "double" + ">" * depth

    lines = (
        f"case when {kind.format(g='g')} = 'Point' then array(array({coordinates.format(t=nest(1))})) "
        f"when {kind.format(g='g')} in ('MultiPoint', 'LineString') then array({coordinates.format(t=nest(2))}) "
        f"when {kind.format(g='g')} in ('MultiLineString', 'Polygon') then {coordinates.format(t=nest(3))} "
        f"when {kind.format(g='g')} = 'MultiPolygon' then flatten({coordinates.format(t=nest(4))}) end"
    )
    shape = " ".join(
        f"when '{t}' then schema_of_variant({coordinates.format(t='variant')}) rlike "
        f"'^(ARRAY<){{{d}}}(BIGINT|DOUBLE|FLOAT|DECIMAL\\\\(\\\\d+,\\\\d+\\\\))>{{{d}}}$'"
        for t, d in GEO_DEPTH.items())
    shaped = f"coalesce(case {kind.format(g='g')} {shape} end, false)"
    holes = f"not exists(coalesce({coordinates.format(t='array<variant>')}, array()), p -> schema_of_variant(p) = 'ARRAY<VOID>')"
    parts = (f"transform({leaves}, g -> named_struct('kind', {kind.format(g='g')}, 'shaped', {shaped} and {holes}, "
             f"'lines', coalesce({lines}, array())))")
    position = "size(p) between 2 and 3 and forall(p, x -> x is not null and abs(x) < double('infinity'))"
    whole = (
        "q.shaped and size(q.lines) > 0 and forall(q.lines, l -> forall(l, p -> " + position + ") and "
        "case when q.kind like '%LineString' then size(l) >= 2 "
        "when q.kind like '%Polygon' then size(l) >= 4 and element_at(l, 1) = element_at(l, -1) else size(l) >= 1 end)"
    )
    outline = (
        f"named_struct('geometry_type', {kind.format(g=geometry)}, 'coordinate_count', cast(size(positions) as bigint), "
        "'coordinate_dimension', array_max(transform(positions, p -> size(p))), "
        + ", ".join(f"'{fn}_{axis}', array_{fn}(transform(positions, p -> get(p, {i})))"
                    for fn in ("min", "max") for i, axis in enumerate("xy"))
        + f", 'valid', forall(parts, q -> coalesce({whole}, false)))"
    )
    # Names for values that are used several times, so that a geometry is taken apart once.
    inner = f"get(transform(array(flatten(transform(parts, q -> flatten(q.lines)))), positions -> {outline}), 0)"
    summary = f"get(transform(array({parts}), parts -> {inner}), 0)"
    return F.expr(f"if({geometry} is null or is_variant_null({geometry}), null, {summary})")


def feature_id_ok(feature_id: Column) -> Column:
    """A feature id must be text or a finite number."""
    kind = F.schema_of_variant(feature_id)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    finite = F.abs(F.try_variant_get(feature_id, "$", "double")) < F.lit(float("inf"))
    return F.coalesce((kind == "STRING") | (number & finite), F.lit(False))


def read_geojson(spark: SparkSession, path: str, lines: bool = False, encoding: str = "UTF-8") -> Source:
    """One row per Feature: flat properties, the feature id, and a summary of the geometry.

    ``lines`` reads one Feature per line, which is splittable; a FeatureCollection is one value.
    """
    if lines:
        rows = spark.read.text(path).where("trim(value) <> ''")
        features = rows.select(F.struct(
            F.col("_metadata.file_path"), F.monotonically_increasing_id().alias("line")).alias("record"),
            F.col("value").alias("feature"))
    else:
        docs = _documents(spark, path, encoding)
        body = F.from_json("text", "type string, features array<string>")
        wrong = docs.where(F.coalesce((body["type"] != "FeatureCollection") | body["features"].isNull(), F.lit(True)))
        if wrong.limit(1).count():
            raise SourceError("the top level must be a FeatureCollection with features")
        features = docs.select("path", F.posexplode(body["features"]).alias("place", "feature")).select(
            F.struct("path", "place").alias("record"), "feature")
    value = F.try_parse_json("feature")
    parts = features.select(
        "record", "feature", F.get_json_object("feature", "$.properties").alias("text"),
        F.try_variant_get(value, "$.id", "variant").alias("__id"),
        F.try_variant_get(value, "$.type", "string").alias("__type"),
        F.try_variant_get(value, "$.geometry", "variant").alias("__geometry"),
        F.json_object_keys("feature").alias("__keys"))
    parts = parts.withColumn("__summary", geometry_summary("__geometry"))
    properties = parts.select("record", F.coalesce("text", F.lit("{}")).alias("text"))
    columns = _column_order(properties)
    reserved = [c for c in columns if c.startswith(GEO_PREFIX)]
    if reserved:
        raise SourceError(f"reserved property name {reserved[0][:160]}")
    has_id = F.array_contains("__keys", "id")
    has_geometry = ~F.is_variant_null("__geometry")
    flags = {
        "not a Feature": F.coalesce(F.col("__type") != "Feature", F.lit(True)),
        "geometry or properties missing": ~F.coalesce(
            F.array_contains("__keys", "geometry") & F.array_contains("__keys", "properties"), F.lit(False)),
        "feature id": F.coalesce(has_id & ~feature_id_ok(F.col("__id")), F.lit(False)),
        "geometry": F.coalesce(has_geometry & ~F.col("__summary.valid"), F.lit(False)),
        "nested property": strict_json_flags(F.coalesce("text", F.lit("{}")))["nested cell"],
    }
    cells = F.try_parse_json(F.coalesce("text", F.lit("{}")))
    values = parts.select(
        *[F.try_variant_get(cells, _path(c), "variant").alias(c) for c in columns],
        F.try_variant_get("__id", "$", "string").alias(f"{GEO_PREFIX}feature_id"),
        *[F.col(f"__summary.{s}").alias(f"{GEO_PREFIX}{s}") for s in GEO_SUMMARY])
    typed = _typed(values.select(*[ref(c) for c in columns]), columns) if columns else None
    kinds = {f.name: f.dataType for f in typed.schema} if typed is not None else {}
    frame = values.select(
        *[F.try_variant_get(F.col(ref(c)), "$", kinds[c].simpleString()).alias(c)
          if not isinstance(kinds[c], T.VariantType) else F.col(ref(c)) for c in columns],
        *[ref(c) for c in values.columns if c.startswith(GEO_PREFIX)])
    return Source(frame, _problem_counts(parts, flags), ["one row per Feature; coordinates are summarised"])


# ------------------------------------------------------------------ parse rate
def parse_rate(lines: DataFrame, file: str = "path", line: str = "value") -> DataFrame:
    """Share of readable files as a metric row: a file fails if any of its JSON lines does.

    Aggregated per file after a partial aggregation in each task, so a file may span any number
    of tasks.
    """
    from ..operators import metrics  # metric rows are built where all metrics are
    return metrics.file_parse_metric(
        lines.groupBy(file).agg(F.bool_and(F.try_parse_json(F.col(line)).isNotNull()).alias("readable")))


def file_parse_rate(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").where("trim(value) <> ''")
    return parse_rate(lines)
