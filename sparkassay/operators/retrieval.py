"""Deterministic lexical search of many queries over many chunks.

Scores count substring matches.  A search term has no gaps, so it lies within one run of word
characters of a text: chunks are indexed by their runs, a gram index over the distinct runs tells
which of them contain a term, and joins lead from terms to runs to chunks.  Chunks and queries then
meet in groups of many, where NumPy adds up the points and only pairs that can be among the best
leave a task.  One plan serves one query and a million.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed
from ..functions import text as X
from ..functions import values as V
from ..plans import skew
from ..session import written


# ------------------------------------------------------------------ filters
def filter_documents(
    documents: DataFrame, standard_number: str | None = None, version: str | None = None,
    source_namespace: str | None = None,
) -> DataFrame:
    """Approved, active documents that pass the given filters; applied before any scoring."""
    keep = F.col("approved") & (F.col("effective_status") == "active")
    if source_namespace is not None:
        if source_namespace not in fixed.NAMESPACES:
            raise ValueError(f"unknown namespace {source_namespace}")
        keep = keep & (F.col("source_namespace") == source_namespace)
    for column, wanted in (("standard_number", standard_number), ("version", version)):
        if wanted:
            keep = keep & (X.normalize_filter(F.col(column)) == X.normalize_filter(F.lit(wanted)))
    return documents.where(keep)


def filter_chunks(chunks: DataFrame, documents: DataFrame, metric_id: str | None = None) -> DataFrame:
    """Candidate chunks with the document columns that scoring and ranking need."""
    wanted = documents.select("document_id", "title", "standard_number", "version", "source_namespace",
                              "source_name", "effective_status", "approved")
    if metric_id:
        code = X.normalize_filter(F.lit(metric_id))
        chunks = chunks.where(F.exists("metric_ids", lambda m: V.casefold(m) == code))
    return chunks.join(wanted, "document_id")


# ------------------------------------------------------------------ postings
IN_TEXT, IN_TITLE, IN_PLACE, OF_TABLE = 1, 2, 4, 8
HALF_POINTS = {IN_TEXT: 2, IN_TITLE: 4, IN_PLACE: 3}
PHRASE_POINTS, TABLE_POINTS = 4.0, 0.15
# A longer run of word characters is indexed in windows.  They overlap by more bytes than a folded query has,
# and both numbers are multiples of three, the bytes of a CJK character.
WINDOW, STEP = 24_576, 18_432
# Scoring holds this many postings and queries at once, and the cells of so many terms.
POSTINGS_AT_ONCE, QUERIES_AT_ONCE, TERMS_AT_ONCE = 500_000, 512, 8_192


def _folded(c: str) -> Column:
    return V.casefold(F.coalesce(F.col(c), F.lit("")))


def _bytes_of(c: Column, start: Column, length: Column | int) -> Column:
    """A part of a run by byte positions, which are found without walking over its characters."""
    return F.substring(c.cast("binary"), start, length if isinstance(length, Column) else F.lit(length)).cast("string")


def _windows(run: Column) -> Column:
    last = ((F.octet_length(run) - 1) / STEP).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: _bytes_of(run, i * STEP + 1, WINDOW))


@dataclass
class Index:
    """Candidates prepared for any number of searches, written once.

    ``chunks`` (no, document_id, ordinal, chunk_id, table_row) numbers them in the order of document and ordinal;
    ``postings`` (no, field, word) has the distinct runs of word characters and of CJK characters in a chunk's text,
    title, section and clause, field being IN_TEXT, IN_TITLE or IN_PLACE, plus OF_TABLE for a table row; ``grams`` (gram, word, n) the runs of two and three characters (one and two of CJK) of each
    distinct word with the number of its postings.  Every search term lies within one word.
    """
    candidates: DataFrame
    chunks: DataFrame
    postings: DataFrame
    grams: DataFrame


def index(candidates: DataFrame) -> Index:
    order = ["document_id", "ordinal", "chunk_id"]
    chunks = written(candidates.select(*order, "table_row").orderBy(*order).select(
        F.monotonically_increasing_id().alias("no"), *order, "table_row"), "search-chunks")
    place = F.concat_ws("\n", "section", "clause")
    fields = {"text": (F.col("text"), IN_TEXT), "title": (F.col("title"), IN_TITLE), "place": (place, IN_PLACE)}
    runs = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"([a-z0-9_./:-]{2,}|[㐀-鿿]+)"), F.lit(1)))
    # Step by step, so that nothing is computed twice.
    kind = F.when(F.col("table_row"), OF_TABLE).otherwise(0).alias("kind")
    rows = candidates.select("chunk_id", kind, *[F.coalesce(c, F.lit("")).alias(n) for n, (c, _) in fields.items()])
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Whole texts are fewer bytes than their words, so they are dealt before they are taken apart.
    rows = rows.join(chunks.select("chunk_id", "no"), "chunk_id").drop("chunk_id").repartition(parts, "no")
    rows = rows.select("no", "kind", *[V.casefold(F.col(n)).alias(n) for n in fields])
    rows = rows.select("no", "kind", *[runs(F.col(n)).alias(n) for n in fields])
    long = lambda r: F.octet_length(r) > WINDOW
    cut = lambda c: F.flatten(F.transform(c, lambda r: F.when(long(r), _windows(r)).otherwise(F.array(r))))
    each = F.array(*[F.struct((F.col("kind") + f).alias("field"), F.when(F.exists(n, long), cut(F.col(n))).otherwise(F.col(n)).alias("words"))
                     for n, (_, f) in fields.items()])
    found = rows.select("no", F.explode(each).alias("e")).select("no", "e.field", F.explode("e.words").alias("word"))
    postings = written(found, "search-postings")
    words = postings.groupBy("word").agg(F.count(F.lit(1)).alias("n")).repartition(parts, "word")
    longest = _longest_gram(F.col("word"))
    grams = _grams(words, "word", F.array(longest - 1, longest)).select("gram", "word", "n")
    return Index(candidates, chunks, postings, written(grams.sortWithinPartitions("gram"), "search-grams"))


def _grams(words: DataFrame, word: str, sizes: Column) -> DataFrame:
    """words with a row for every run (gram) of so many characters of a word of one kind of characters."""
    width = (F.octet_length(word) / F.char_length(word)).cast("int")
    at = words.select("*", F.explode(sizes).alias("__k"), width.alias("__width")).where(F.char_length(word) >= F.col("__k"))
    at = at.select("*", F.explode(F.sequence(F.lit(0), F.char_length(word) - F.col("__k"))).alias("__i"))
    gram = _bytes_of(F.col(word), F.col("__i") * F.col("__width") + 1, F.col("__k") * F.col("__width"))
    return at.withColumn("gram", gram).drop("__k", "__width", "__i")


def _longest_gram(word: Column) -> Column:
    """Three word characters; two CJK characters, which is as long as a CJK term gets."""
    return F.when(F.octet_length(word) == F.char_length(word), 3).otherwise(2)


def lookup(terms: DataFrame, grams: DataFrame) -> DataFrame:
    """(word, n, terms): numbers (tid) of the distinct terms (tid, term) that each word of an index contains; words without
    any are left out.  Every term meets the words that hold its rarest gram.
    """
    wanted = _grams(terms, "term", F.array(F.least(F.char_length("term"), _longest_gram(F.col("term")))))
    counted = grams.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("rows"))
    # Written, so that Spark knows how small it is when it plans the join.
    rarest = written(wanted.join(counted, "gram", "left").groupBy("tid", "term").agg(
        F.min_by("gram", F.struct(F.coalesce("rows", F.lit(0)), "gram")).alias("gram")), "rarest-grams")
    return grams.join(rarest, "gram").where(F.contains("word", "term")).groupBy("word", "n").agg(F.collect_set("tid").alias("terms"))


# ------------------------------------------------------------------ scoring
def prepare_queries(queries: DataFrame, text: str = "query") -> DataFrame:
    """(query_id, query, terms, phrase, problem); ``search`` answers queries with a problem by it."""
    cleaned = V.strip(F.coalesce(F.col(text), F.lit("")))
    problem = F.when(cleaned == "", "the query is empty").when(
        F.char_length(cleaned) > fixed.MAX_QUERY_CHARS, f"the query is longer than {fixed.MAX_QUERY_CHARS} characters")
    return queries.select(
        F.col("query_id").cast("long"), cleaned.alias("query"), F.when(problem.isNull(), X.tokens(cleaned)).alias("terms"),
        V.strip(V.casefold(cleaned)).alias("phrase"), problem.alias("problem"))


def _group_scores(limit: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Points of all pairs of a group of chunks (no, field, terms) and a group of queries (query_id, tids, parts, whole).

    Kept are each query's best ``limit`` chunks of this group, and those that can pass the last of them if their text holds the phrase (unsure).
    """
    def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        array = column.combine_chunks()
        return array.value_lengths().to_numpy(zero_copy_only=False), array.flatten().to_numpy(zero_copy_only=False)

    def compute(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(chunks) and len(queries):
            numbers, row = np.unique(chunks["no"].to_numpy(), return_inverse=True)
            field = chunks["field"].to_numpy()
            table = np.zeros(len(numbers), dtype=bool)
            table[row[field & OF_TABLE != 0]] = True
            size, hits = lists(chunks["terms"])
            row, field = np.repeat(row, size), np.repeat(field, size)
            (asked, tids), (held, parts) = lists(queries["tids"]), lists(queries["parts"])
            ids, whole = queries["query_id"].to_numpy(), queries["whole"].to_numpy(zero_copy_only=False)
            ends, part_ends = np.cumsum(asked), np.cumsum(held)
            first = 0
            while first < len(ids):
                before = ends[first] - asked[first]
                last = max(int(np.searchsorted(ends, before + TERMS_AT_ONCE, "right")), first + 1)
                known = np.unique(tids[before:ends[last - 1]])
                at = np.minimum(np.searchsorted(known, hits), len(known) - 1)
                of = known[at] == hits
                inside = {f: np.zeros((len(known), len(numbers)), dtype=bool) for f in HALF_POINTS}
                for f, cells in inside.items():
                    here = of & (field & f != 0)
                    cells[at[here], row[here]] = True
                points = sum(cells * np.uint8(HALF_POINTS[f]) for f, cells in inside.items())
                for i in range(first, last):
                    mine = np.searchsorted(known, tids[ends[i] - asked[i]:ends[i]])
                    phrase = inside[IN_TEXT][np.searchsorted(known, parts[part_ends[i] - held[i]:part_ends[i]])].all(axis=0)
                    total = points[mine].sum(axis=0, dtype=np.int64)
                    some = np.flatnonzero(total)
                    phrase, total = phrase[some] & bool(held[i]), total[some]
                    if whole[i]:
                        total, phrase = total + phrase * int(2 * PHRASE_POINTS), np.zeros(len(some), dtype=bool)
                    # In units of a twentieth, so that equal scores are equal.
                    key = total * 10 + table[some] * int(20 * TABLE_POINTS)
                    if len(some) > limit:
                        least = np.partition(key, -limit)[-limit]
                        sure = np.flatnonzero((key >= least) & ~phrase)
                        sure = sure[np.lexsort((numbers[some[sure]], -key[sure]))[:limit]]
                        kept = np.concatenate([sure, np.flatnonzero(phrase & (key + int(20 * PHRASE_POINTS) >= least))])
                        some, total, phrase = some[kept], total[kept], phrase[kept]
                    out.append((np.full(len(some), ids[i]), numbers[some], total / 2, table[some], phrase))
                first = last
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.bool_()), strict=True)],
                        names=["query_id", "no", "points", "table_row", "unsure"])

    return compute


def score(prepared: DataFrame, index: Index, limit: int) -> DataFrame:
    """(query_id, no, score) of the pairs of a query and a chunk with a term in common that can be among the query's best ``limit``.

    Whether a term occurs in a chunk is found once for all queries that ask for it.  Groups of chunks and of queries have bounded
    sizes; a chunk's postings are copied once for each group of queries.
    """
    prepared = written(prepared.select("query_id", "phrase", "terms"), "queries")
    asked = prepared.select("query_id", "phrase", F.explode("terms").alias("term"))
    terms = written(asked.select("term").distinct().select(F.monotonically_increasing_id().alias("tid"), "term"), "terms")
    words = written(lookup(terms, index.grams), "term-words")
    # A text that holds the phrase holds all terms that are parts of the phrase.
    part, whole = F.contains("phrase", "term"), F.col("phrase") == F.col("term")
    grouped = written(asked.join(terms, "term").groupBy("query_id").agg(
        F.collect_list("tid").alias("tids"), F.collect_list(F.when(part, F.col("tid"))).alias("parts"), F.some(whole).alias("whole")), "asked")
    groups = max(1, -(-index.postings.count() // POSTINGS_AT_ONCE))
    blocks = max(1, -(-grouped.count() // QUERIES_AT_ONCE))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    hits = skew.join_back(index.postings, words, "word", size="n").select(
        "no", "field", "terms", dealt("no", groups).alias("group"), every(blocks).alias("block"))
    wanted = grouped.select("*", dealt("query_id", blocks).alias("block"), every(groups).alias("group"))
    scored = written(hits.groupBy("group", "block").cogroup(wanted.groupBy("group", "block")).applyInArrow(
        _group_scores(limit), "query_id bigint, no bigint, points double, table_row boolean, unsure boolean"), "scored")
    led = written(scored.where("unsure").join(prepared.select("query_id", "phrase"), "query_id").join(
        index.chunks.select("no", "chunk_id"), "no").select("query_id", "no", "chunk_id", "phrase"), "led-chunks")
    phrases = led.join(index.candidates.select("chunk_id", "text"), "chunk_id").where(_folded("text").contains(F.col("phrase"))).select(
        "query_id", "no", F.lit(PHRASE_POINTS).alias("phrase"))
    bonus = F.when(F.col("table_row"), F.lit(TABLE_POINTS)).otherwise(F.lit(0.0))
    return scored.join(phrases, ["query_id", "no"], "left").select(
        "query_id", "no", (F.col("points") + F.coalesce("phrase", F.lit(0.0)) + bonus).alias("score"))


def rank(prepared: DataFrame, candidates: DataFrame | Index, limit: int = 5) -> DataFrame:
    """The best ``limit`` chunks per query: score descending, then document id, then ordinal.

    Each group of chunks hands on its best, and Spark applies the limit per query again before it shuffles for the window.
    """
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    found = candidates if isinstance(candidates, Index) else index(candidates)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "no")
    best = score(prepared, found, limit).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return best.join(found.chunks, "no").drop("no")


def text_budget(
    ranked: DataFrame, each: int = fixed.MAX_RESULT_CHARS, total: int = fixed.MAX_TOTAL_CHARS,
) -> DataFrame:
    """Cut each result to ``each`` characters and each answer to ``total``, in rank order; ``cut`` tells which were."""
    size = F.least(F.char_length("text"), F.lit(each))
    before = F.coalesce(F.sum(size).over(
        W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = ranked.withColumn("__room", F.least(F.lit(each), F.lit(total) - before)).where("__room > 0")
    return kept.withColumn("cut", F.char_length("text") > F.col("__room")).withColumn(
        "text", F.left("text", F.col("__room"))).drop("__room")


def conflicts(results: DataFrame) -> DataFrame:
    """Queries whose strong results disagree on version or namespace.

    (query_id, reason) and, in the order of their ids, the documents of the strong results: document_ids,
    document_labels, versions, standard_numbers.  An answer holds at most ``limit`` results.
    """
    strong = results.withColumn("top", F.max("score").over(W.partitionBy("query_id"))).where("score >= top * 0.55")
    filled = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    version = filled("version", F.lit("未标注版本"))
    per_standard = strong.groupBy("query_id", filled("standard_number", F.col("document_id")).alias("standard")).agg(
        F.count_distinct(version).alias("versions"),
        F.collect_set(F.struct("document_id", "title", version.alias("version"), filled(
            "standard_number", F.lit("未标注标准号")).alias("standard"))).alias("documents"),
        F.collect_set("source_namespace").alias("namespaces"))
    per_query = per_standard.groupBy("query_id").agg(
        F.max("versions").alias("versions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("documents")))).alias("documents"),
        F.size(F.array_distinct(F.flatten(F.collect_list("namespaces")))).alias("namespaces"))
    disagree = per_query.where((F.size("documents") >= 2) & ((F.col("versions") > 1) | (F.col("namespaces") > 1)))
    return disagree.select(
        "query_id", F.when(F.col("versions") > 1, "同一标准或适用范围命中了多个版本，请先确认适用版本。").otherwise(
            "检索结果来自多个已批准来源命名空间，请确认适用来源。").alias("reason"),
        F.col("documents.document_id").alias("document_ids"), F.col("documents.title").alias("document_labels"),
        F.col("documents.version").alias("versions"), F.col("documents.standard").alias("standard_numbers"))


def matched_terms(results: DataFrame, candidates: DataFrame, prepared: DataFrame) -> DataFrame:
    """Adds the sorted terms of its query that occur in a result's whole chunk."""
    whole = F.concat_ws("\n", *[_folded(c) for c in ("text", "title", "section", "clause")])
    inside = candidates.select("chunk_id", whole.alias("__whole"))
    found = results.select("query_id", "chunk_id").join(inside, "chunk_id").join(prepared.select("query_id", "terms"), "query_id").select(
        "query_id", "chunk_id", F.array_sort(F.filter("terms", lambda t: F.col("__whole").contains(t))).alias("matched_terms"))
    return results.join(found, ["query_id", "chunk_id"])


def search(
    queries: DataFrame, documents: DataFrame, chunks: DataFrame, *, metric_id: str | None = None,
    standard_number: str | None = None, version: str | None = None, source_namespace: str | None = None,
    limit: int = 5, result_chars: int = fixed.MAX_RESULT_CHARS, total_chars: int = fixed.MAX_TOTAL_CHARS,
) -> tuple[DataFrame, DataFrame]:
    """(responses, results) for all queries (columns query_id, query) with common filters.

    The status of a response is ok, conflict, no_results, or refused for a blank or overlong query.
    """
    prepared = prepare_queries(queries)
    kept = filter_documents(documents, standard_number, version, source_namespace)
    candidates = filter_chunks(chunks, kept, metric_id)
    best = written(rank(prepared, candidates, limit).select("query_id", "rank", "score", "chunk_id"), "ranked")
    # At most limit rows per query, each of at most result_chars characters.
    results = written(text_budget(candidates.join(best, "chunk_id"), result_chars, total_chars), "results")
    counts = kept.agg(F.count(F.lit(1)).alias("filtered_document_count")).withColumn("__one", F.lit(1)).join(
        candidates.agg(F.count(F.lit(1)).alias("total_candidate_count")).withColumn("__one", F.lit(1)), "__one")
    found = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("result_count"), F.count_if("cut").alias("cut_count"))
    disagreeing = conflicts(results).select("query_id", "reason")
    responses = (
        prepared.select("query_id", "query", "problem").join(found, "query_id", "left").join(disagreeing, "query_id", "left")
        .withColumn("__one", F.lit(1)).join(F.broadcast(counts), "__one")
        .select("query_id", "query", F.when(F.col("problem").isNotNull(), "refused").when(
            F.col("reason").isNotNull(), "conflict").when(F.col("result_count") > 0, "ok").otherwise("no_results").alias("status"),
            F.coalesce("result_count", F.lit(0)).alias("result_count"), F.coalesce("cut_count", F.lit(0)).alias("cut_count"),
            "filtered_document_count", "total_candidate_count", F.coalesce("problem", "reason").alias("reason")))
    return responses, results


# ------------------------------------------------------------------ evidence
def source_type(namespace: Column) -> Column:
    return F.when(namespace == "standards", "standard_clause").when(
        namespace == "data_dictionary", "data_dictionary").otherwise("user_statement")


def source_summary(results: DataFrame) -> DataFrame:
    """Display columns of results."""
    return results.select(
        "query_id", "rank", "chunk_id", F.col("title").alias("document_name"), "version", "standard_number",
        "section", "clause", "page", _location().alias("location"))


def _location() -> Column:
    return F.concat_ws(
        " / ", F.coalesce("section", F.when(F.col("clause").isNull(), F.lit("正文"))), "clause",
        F.when(F.col("page").isNotNull(), F.format_string("第%d页", F.col("page"))),
        F.when(F.col("line_start").isNotNull() & F.col("line_end").isNotNull(),
               F.format_string("行 %d-%d", F.col("line_start"), F.col("line_end"))),
        F.concat(F.lit("chunk:"), "chunk_id"))


def bind_evidence(results: DataFrame, responses: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Evidence rows for chosen (query_id, chunk_id), or for all results; none for conflicts."""
    usable = results.join(responses.where("status = 'ok'").select("query_id"), "query_id", "left_semi")
    if chosen is not None:
        usable = usable.join(chosen.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_semi")
    authoritative = F.col("approved") & (F.col("effective_status") == "active") & (
        F.col("source_namespace") != "user_specification")
    return usable.select(
        "query_id", source_type(F.col("source_namespace")).alias("type"), F.col("text").alias("excerpt"),
        F.col("chunk_id").alias("source_id"), F.col("title").alias("source_label"), _location().alias("location"),
        authoritative.alias("authoritative"), "document_id", F.col("title").alias("document_name"),
        F.col("version").alias("document_version"),
        F.coalesce("section", F.when(F.col("clause").isNull(), F.lit("正文"))).alias("section"), "clause", "chunk_id", "page")


def missing_choices(chosen: DataFrame, results: DataFrame) -> DataFrame:
    """Chosen chunks that the search did not return."""
    return chosen.select("query_id", "chunk_id").distinct().join(
        results.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")


def evidence_problems(evidence: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, evidence_id, problem) for retrieved evidence that does not match its result."""
    cited = evidence.where(F.col("type").isin("standard_clause", "data_dictionary")).withColumn(
        "__chunk", F.coalesce("chunk_id", "source_id"))
    known = results.select(
        "query_id", F.col("chunk_id").alias("__chunk"), F.col("document_id").alias("r_document"),
        F.col("title").alias("r_title"), F.col("version").alias("r_version"), F.lit(True).alias("__known"))
    joined = cited.join(known, ["query_id", "__chunk"], "left").withColumn(
        "copy", F.row_number().over(W.partitionBy("query_id", "__chunk").orderBy("evidence_id")))
    found = F.col("__known").isNotNull()
    checks = {
        "not among the results": ~found,
        "cited twice": found & (F.col("copy") > 1),
        "other document id": found & ~F.col("document_id").eqNullSafe(F.col("r_document")),
        "other document name": found & ~F.col("document_name").eqNullSafe(F.col("r_title")),
        "other document version": found & ~F.col("document_version").eqNullSafe(F.col("r_version")),
        "other chunk id": found & ~F.col("chunk_id").eqNullSafe(F.col("__chunk")),
    }
    return joined.select("query_id", "evidence_id", F.explode(F.array_compact(F.array(*[
        F.when(c, F.lit(p)) for p, c in checks.items()]))).alias("problem"))
