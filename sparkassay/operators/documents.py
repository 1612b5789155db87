"""Documents to clause-aware chunks.

A document is bounded (20 MiB, one million characters; larger ones are reported, not cut), so a
window over its lines never gathers more than one document in a task.  Lines are shuffled once by
document; all windows and the grouping of lines into blocks reuse that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed
from ..functions import text as X
from ..functions import values as V

_SPACE = f"[{fixed.SPACE_CLASS}]"


def _unicode_space(pattern: str) -> str:
    """White space in a pattern as Unicode white space."""
    return pattern.replace(r":\s]", f":{fixed.SPACE_CLASS}]").replace(r"\s", _SPACE)


HEADING, CLAUSE = _unicode_space(fixed.HEADING), _unicode_space(fixed.CLAUSE_START)


def ingest(
    documents: DataFrame, text: str = "text", source_name: str = "source_name", *,
    title: Column | None = None, standard_number: Column | None = None, version: Column | None = None,
    published_at: Column | None = None, effective_status: Column | str = "active",
    source_namespace: Column | str = "standards", approved: Column | bool = False,
) -> DataFrame:
    """Document rows with inferred metadata, ids and hashes; ``problem`` tells why one is refused."""
    found = X.document_metadata(F.col(text))
    none = F.lit(None).cast("string")
    given = lambda c: F.nullif(V.strip(none if c is None else c), F.lit(""))
    stem = F.regexp_replace(F.regexp_replace(F.col(source_name), r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    status = F.lower(effective_status if isinstance(effective_status, Column) else F.lit(effective_status))
    namespace = source_namespace if isinstance(source_namespace, Column) else F.lit(source_namespace)
    rows = documents.select(
        "*", F.coalesce(given(title), found["title"], stem).alias("__title"),
        F.coalesce(given(standard_number), found["standard_number"]).alias("__standard"),
        F.coalesce(given(version), found["version"]).alias("__version"),
        F.coalesce(given(published_at), found["published_at"]).alias("__published"),
        F.sha2(F.col(text), 256).alias("content_sha256"))
    document_id = X.content_id("doc", [X.json_text(F.col(c)) for c in (
        source_name, "__title", "__standard", "__version", "content_sha256")])
    problem = (
        F.when(F.octet_length(text) > fixed.MAX_DOCUMENT_BYTES, "too many bytes")
        .when(F.char_length(text) > fixed.MAX_DOCUMENT_CHARS, "too many characters")
        .when(V.is_missing(F.col(text)), "no text")
        .when(~status.isin(list(fixed.DOCUMENT_STATUSES)), "unknown status")
        .when(~namespace.isin(list(fixed.NAMESPACES)), "unknown namespace"))
    return rows.select(
        document_id.alias("document_id"), F.col("__title").alias("title"),
        X.normalize_standard_number(F.col("__standard")).alias("standard_number"),
        F.col("__version").alias("version"), F.col("__published").alias("published_at"),
        status.alias("effective_status"), namespace.alias("source_namespace"),
        F.col(source_name).alias("source_name"), "content_sha256",
        (approved if isinstance(approved, Column) else F.lit(approved)).alias("approved"),
        problem.alias("problem"), F.col(text).alias("text"))


def lines(documents: DataFrame) -> DataFrame:
    """(document_id, line_number, line); all line endings count alike."""
    unified = F.regexp_replace("text", r"\r\n?", "\n")
    return documents.select("document_id", F.posexplode(F.split(unified, "\n", -1)).alias("i", "line")).select(
        "document_id", (F.col("i") + 1).alias("line_number"), "line")


def _is_table(line: Column) -> Column:
    return F.ltrim(line, F.lit(fixed.SPACE_CHARS)).startswith("|")


def line_blocks(line_rows: DataFrame) -> DataFrame:
    """Non-blank lines with block number, section and clause.

    A block starts at a heading, at a clause, after a blank line, where table lines begin or
    end, and after every eighth table line.
    """
    tidy = F.rtrim("line", F.lit(fixed.SPACE_CHARS))
    heading = F.nullif(V.strip(F.regexp_extract(tidy, HEADING, 1)), F.lit(""))
    clause = F.nullif(V.strip(F.regexp_extract(tidy, CLAUSE, 1)), F.lit(""))
    order = W.partitionBy("document_id").orderBy("line_number")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    marked = line_rows.select(
        "document_id", "line_number", F.col("line").alias("raw"), tidy.alias("tidy"), heading.alias("heading"),
        F.when(heading.isNull(), clause).alias("own_clause"), (tidy == "").alias("blank"), _is_table(tidy).alias("table"))
    marked = marked.withColumn("opens", F.col("heading").isNotNull() | F.col("own_clause").isNotNull())
    after_blank = F.lag("blank", 1, True).over(order)
    switched = F.lag("table").over(order) != F.col("table")
    marked = marked.withColumn(
        "starts", ~F.col("blank") & (F.col("opens") | after_blank | switched)
    ).select(
        "*", F.sum(F.col("starts").cast("int")).over(upto).alias("run"),
        F.last("heading", ignorenulls=True).over(upto).alias("section"),
        F.count("heading").over(upto).alias("heading_no"))
    in_heading = W.partitionBy("document_id", "heading_no").orderBy("line_number").rowsBetween(W.unboundedPreceding, 0)
    in_run = W.partitionBy("document_id", "run").orderBy("line_number")
    return (
        marked.withColumn("clause", F.last("own_clause", ignorenulls=True).over(in_heading))
        .where(~F.col("blank"))
        .withColumn("part", F.when(F.col("table"), F.floor((F.row_number().over(in_run) - 1) / fixed.MAX_TABLE_LINES)).otherwise(0))
        .select("document_id", "line_number", "run", "part", "section", "clause", "table",
                F.when(F.col("opens"), F.col("raw")).otherwise(F.col("tidy")).alias("line")))


def _pack_ranges(lengths: Column, table: Column, limit: int = fixed.MAX_CHUNK_CHARS) -> Column:
    """Greedy packing of line lengths into ranges (first, n) of at most ``limit`` characters, with one line of overlap
    outside tables: a fold over the lengths."""
    one = lambda first, end: F.array(F.struct((first + 1).alias("first"), (end - first).alias("n")))
    zero = F.lit(0)
    start = F.struct(zero.alias("i"), zero.alias("first"), zero.alias("used"), zero.alias("before"),
                     F.expr("cast(array() as array<struct<first: int, n: int>>)").alias("ranges"))

    def step(s: Column, n: Column) -> Column:
        inner = s["i"] > s["first"]
        need = n + F.when(inner, 1).otherwise(0)
        full = inner & (s["used"] + need > limit)
        return F.struct(
            (s["i"] + 1).alias("i"),
            F.when(full, F.when(table, s["i"]).otherwise(s["i"] - 1)).otherwise(s["first"]).alias("first"),
            (F.when(full, F.when(table, 0).otherwise(s["before"] + 1)).otherwise(s["used"]) + need).alias("used"),
            n.alias("before"),
            F.when(full, F.concat(s["ranges"], one(s["first"], s["i"]))).otherwise(s["ranges"]).alias("ranges"))

    return F.aggregate(lengths, start, step, lambda s: F.concat(s["ranges"], one(s["first"], s["i"])))


def chunks(line_rows: DataFrame) -> DataFrame:
    """Chunks of every document, numbered in reading order."""
    blocks = line_blocks(line_rows).groupBy("document_id", "run", "part").agg(
        F.array_sort(F.collect_list(F.struct("line_number", "line"))).alias("lines"),
        F.first("section").alias("section"), F.first("clause").alias("clause"), F.first("table").alias("table"))
    sizes = F.transform("lines", lambda x: F.char_length(x["line"]))
    total = F.aggregate(sizes, F.lit(-1), lambda a, n: a + n + 1)
    whole = F.array(F.struct(F.lit(1).alias("first"), F.size("lines").cast("int").alias("n")))
    ranges = F.when(total > fixed.MAX_CHUNK_CHARS, _pack_ranges(sizes, F.col("table"))).otherwise(whole)
    pieces = blocks.select("*", F.posexplode(ranges).alias("piece", "range")).select(
        "document_id", "run", "part", "piece", "section", "clause", "table",
        F.slice("lines", F.col("range.first"), F.col("range.n")).alias("lines"))
    body = V.strip(F.array_join(F.transform("lines", lambda x: V.strip(x["line"])), "\n"))
    order = W.partitionBy("document_id").orderBy("run", "part", "piece")
    numbered = pieces.withColumn("text", body).where("text <> ''").withColumn("ordinal", F.row_number().over(order) - 1)
    chunk_id = X.content_id("chunk", [
        X.json_text(F.col("document_id")), F.col("ordinal").cast("string"), *[X.json_text(F.col(c)) for c in ("text", "section", "clause")]])
    return numbered.select(
        chunk_id.alias("chunk_id"), "document_id", "ordinal", "text", "section", "clause",
        F.lit(None).cast("int").alias("page"), F.element_at("lines", 1)["line_number"].alias("line_start"),
        F.element_at("lines", -1)["line_number"].alias("line_end"), F.col("table").alias("table_row"),
        X.metric_codes(F.col("text")).alias("metric_ids"))


def build(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document rows, chunk rows) of all accepted documents."""
    accepted = documents.where("problem is null")
    return accepted.drop("text", "problem"), chunks(lines(accepted))


def oversized_documents(chunk_rows: DataFrame) -> DataFrame:
    """Documents with more chunks than the limit."""
    return chunk_rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count")).where(
        F.col("chunk_count") > fixed.MAX_DOCUMENT_CHUNKS)


def upsert(rows: DataFrame, new_rows: DataFrame, new_documents: DataFrame) -> DataFrame:
    """Replace everything of the new documents' ids; works for document and for chunk tables."""
    return remove(rows, new_documents).unionByName(new_rows)


def remove(rows: DataFrame, documents: DataFrame) -> DataFrame:
    return rows.join(documents.select("document_id").distinct(), "document_id", "left_anti")


def summary(documents: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """One row per namespace with document, approved and chunk counts."""
    counted = chunk_rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    return documents.join(counted, "document_id", "left").groupBy("source_namespace").agg(
        F.count(F.lit(1)).alias("document_count"), F.count_if("approved").alias("approved_document_count"),
        F.sum(F.coalesce("n", F.lit(0))).alias("chunk_count"))


