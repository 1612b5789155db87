"""DOC and RET rows: documents, chunks and search."""

from pyspark.sql import functions as F

from sparkassay.operators import documents as D
from sparkassay.operators import retrieval as R


from .registry import check, d_casefold, load
from .texts import D_TOKENS

# The given texts have no headings; every document gets a title, one heading with a clause, and a
# table, around its whole text.
FRAME = """
SELECT doc_id, concat('docs/', CAST(doc_id AS STRING), '.md') AS source_name, lang, source,
  concat('# Collection ', lang, chr(10), '版本：v', CAST(doc_id % 3 AS STRING), chr(10), chr(10), '## Part ', source, chr(10),
         '1.', CAST(doc_id % 5 AS STRING), ' Clause', chr(10), text, chr(10), chr(10), '| a | b |', chr(10), '| ', CAST(doc_id AS STRING), ' | 030300 |') AS text
FROM documents"""


def framed(spark, sf):
    return spark.sql(FRAME.replace("FROM documents", "FROM {documents}"), documents=load(spark, sf, "documents"))


def ingested(spark, sf):
    namespace = F.when(F.col("doc_id") % 10 == 0, "user_specification").otherwise("standards")
    status = F.when(F.col("doc_id") % 9 == 0, "expired").otherwise("active")
    return D.ingest(framed(spark, sf), approved=F.col("doc_id") % 8 != 0, source_namespace=namespace, effective_status=status)


@check("doc1_ingest", f"SELECT source_name, 'Collection ' || lang AS title, 'v' || (doc_id % 3) AS version, sha256(text) AS content_sha256, "
       "'doc-' || left(sha256('[\"' || source_name || '\",\"Collection ' || lang || '\",null,\"v' || (doc_id % 3) || '\",\"' || sha256(text) || '\"]'), 20) AS document_id, "
       "CASE WHEN doc_id % 9 = 0 THEN 'expired' ELSE 'active' END AS effective_status, doc_id % 8 <> 0 AS approved "
       f"FROM ({FRAME}) f WHERE NOT regexp_matches(text, '(?i)\\b(DB\\s*[0-9]{{1,4}}\\s*/\\s*T|GB\\s*/\\s*T|GB|ISO|HJ|CJJ|T/)[\\s-]*[A-Z0-9][A-Z0-9./_-]{{1,40}}\\b')")
def doc1(spark, sf):
    rows = ingested(spark, sf).where("standard_number is null")
    return rows.select("source_name", "title", "version", "content_sha256", "document_id", "effective_status", "approved")


D_LINES = "string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"


@check("doc2_lines", f"SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(i AS INTEGER) AS line_number, md5({D_LINES}[i]) AS line "
       f"FROM (SELECT doc_id, text, unnest(range(1, len({D_LINES}) + 1)) AS i FROM documents)")
def doc2(spark, sf):
    rows = load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    return D.lines(rows).select("document_id", "line_number", F.md5("line").alias("line"))


def line_rows(spark, sf):
    return D.lines(framed(spark, sf).select(F.col("doc_id").cast("string").alias("document_id"), "text"))


D_SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
BLOCKS = rf"""WITH f AS MATERIALIZED ({FRAME}), l AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, i AS n, {D_LINES}[i] AS raw
  FROM (SELECT doc_id, text, unnest(range(1, len({D_LINES}) + 1)) AS i FROM f)),
t AS (SELECT *, rtrim(raw, {D_SPACES}) AS tidy FROM l),
h AS (SELECT *, nullif(regexp_extract(tidy, '^\s*#{{1,6}}\s+(.+?)\s*$', 1), '') AS heading, tidy = '' AS blank, starts_with(ltrim(tidy, {D_SPACES}), '|') AS tab,
  nullif(trim(regexp_extract(tidy, '(?i)^\s*(第\s*[0-9一二三四五六七八九十百]+\s*[章节条款项]?|[0-9]+(?:\.[0-9]+){{0,6}}|表\s*[0-9]+|附录\s*[A-Z])(?:[、.．：:\s]|$)', 1)), '') AS found FROM t),
c AS (SELECT *, CASE WHEN heading IS NULL THEN found END AS own FROM h),
o AS (SELECT *, heading IS NOT NULL OR own IS NOT NULL AS opens, lag(blank, 1, true) OVER d AS after_blank, lag(tab) OVER d AS tab_before FROM c WINDOW d AS (PARTITION BY document_id ORDER BY n)),
r AS (SELECT *, sum(CASE WHEN NOT blank AND (opens OR after_blank OR coalesce(tab_before <> tab, false)) THEN 1 ELSE 0 END) OVER d AS run,
  last_value(heading IGNORE NULLS) OVER d AS section, count(heading) OVER d AS part_no FROM o WINDOW d AS (PARTITION BY document_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY document_id, part_no ORDER BY n ROWS UNBOUNDED PRECEDING) AS clause FROM r)
SELECT document_id, CAST(n AS INTEGER) AS line_number, CAST(run AS BIGINT) AS run, section, clause, tab AS "table",
  CAST(CASE WHEN tab THEN floor((row_number() OVER (PARTITION BY document_id, run ORDER BY n) - 1) / 8) ELSE 0 END AS BIGINT) AS part,
  md5(CASE WHEN opens THEN raw ELSE tidy END) AS line FROM g WHERE NOT blank"""


@check("doc3_blocks", BLOCKS)
def doc3(spark, sf):
    return D.line_blocks(line_rows(spark, sf)).withColumn("line", F.md5("line"))


# Oversized blocks line by line: each line goes on in its piece or opens the next one, which outside tables begins with the line before.
PIECES = BLOCKS.replace("WITH f AS", "WITH RECURSIVE f AS").replace("SELECT document_id, CAST(n AS INTEGER) AS line_number, CAST(run", ", b AS MATERIALIZED (SELECT document_id, CAST(n AS INTEGER) AS line_number, CAST(run", 1).replace(
    "AS part,\n  md5(CASE WHEN opens THEN raw ELSE tidy END) AS line FROM g WHERE NOT blank",
    "AS part,\n  CASE WHEN opens THEN raw ELSE tidy END AS line FROM g WHERE NOT blank)") + """,
k AS MATERIALIZED (SELECT *, row_number() OVER e AS i, sum(length(line) + 1) OVER (PARTITION BY document_id, run, part) - 1 AS total,
  lag(length(line)) OVER e AS before FROM b WINDOW e AS (PARTITION BY document_id, run, part ORDER BY line_number)),
walk AS (SELECT document_id, run, part, i, CAST(0 AS BIGINT) AS piece, i AS first, CAST(length(line) AS BIGINT) AS used FROM k WHERE i = 1 AND total > 3500
  UNION ALL SELECT k.document_id, k.run, k.part, k.i, w.piece + CASE WHEN w.used + length(k.line) + 1 > 3500 THEN 1 ELSE 0 END,
    CASE WHEN w.used + length(k.line) + 1 <= 3500 THEN w.first WHEN k."table" THEN k.i ELSE k.i - 1 END,
    CAST(CASE WHEN w.used + length(k.line) + 1 <= 3500 THEN w.used WHEN k."table" THEN 0 ELSE k.before + 1 END + length(k.line) + 1 AS BIGINT)
  FROM walk w JOIN k ON k.document_id = w.document_id AND k.run = w.run AND k.part = w.part AND k.i = w.i + 1),
p AS (SELECT document_id, run, part, piece, min(first) AS first, max(i) AS last FROM walk GROUP BY ALL
  UNION ALL SELECT document_id, run, part, 0, 1, max(i) FROM k WHERE total <= 3500 GROUP BY ALL),
x AS (SELECT p.document_id, p.run, p.part, p.piece, any_value(section) AS section, any_value(clause) AS clause, any_value("table") AS table_row,
  min(line_number) AS line_start, max(line_number) AS line_end, trim(string_agg(trim(line, SPACES), chr(10) ORDER BY line_number), SPACES) AS text
  FROM p JOIN k ON k.document_id = p.document_id AND k.run = p.run AND k.part = p.part AND i BETWEEN first AND last GROUP BY ALL),
y AS (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY run, part, piece) - 1 AS INTEGER) AS ordinal FROM x WHERE text <> '')
""".replace("SPACES", D_SPACES)


@check("doc4_split_oversized", PIECES + "SELECT document_id, section, clause, table_row, count(*) AS pieces, CAST(max(length(text)) AS INTEGER) AS longest FROM y GROUP BY ALL HAVING count(*) > 1")
def doc4(spark, sf):
    """Chunks of blocks that exceed the size limit."""
    sizes = D.chunks(line_rows(spark, sf)).groupBy("document_id", "section", "clause", "table_row")
    return sizes.agg(F.count(F.lit(1)).alias("pieces"), F.max(F.char_length("text")).alias("longest")).where("pieces > 1")


CODES = "list_sort(list_distinct(list_transform(regexp_extract_all(' ' || regexp_replace(text, '([^0-9])', '\\1\\1', 'g') || ' ', '[^0-9]([0-9]{6})[^0-9]', 1), lambda d: 'db31_' || d)))"


@check("doc5_chunks", PIECES + f"""SELECT document_id, ordinal, text, section, clause, CAST(NULL AS INTEGER) AS page, line_start, line_end, table_row, array_to_string({CODES}, ',') AS metric_ids,
  'chunk-' || left(sha256('[' || to_json(document_id) || ',' || ordinal || ',' || to_json(text) || ',' || coalesce(to_json(section), 'null') || ',' || coalesce(to_json(clause), 'null') || ']'), 20) AS chunk_id FROM y""")
def doc5(spark, sf):
    return D.chunks(line_rows(spark, sf)).withColumn("metric_ids", F.array_join("metric_ids", ","))


# Knowledge base for the SQL checks: each document is one chunk of its whole text.
def whole_documents(spark, sf):
    d = load(spark, sf, "documents")
    documents = d.select(
        F.format_string("%09d", "doc_id").alias("document_id"), F.concat(F.lit("Notes from "), "source").alias("title"),
        F.concat(F.lit("N "), (F.col("doc_id") % 50).cast("string")).alias("standard_number"),
        F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string")).alias("version"),
        F.when(F.col("doc_id") % 10 == 0, "user_specification").otherwise("standards").alias("source_namespace"),
        F.col("source").alias("source_name"), F.when(F.col("doc_id") % 9 == 0, "expired").otherwise("active").alias("effective_status"),
        (F.col("doc_id") % 8 != 0).alias("approved"))
    chunks = d.select(
        F.format_string("c%09d", "doc_id").alias("chunk_id"), F.format_string("%09d", "doc_id").alias("document_id"),
        F.lit(0).alias("ordinal"), "text", F.col("lang").alias("section"), F.lit(None).cast("string").alias("clause"),
        F.lit(None).cast("int").alias("page"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"),
        (F.col("doc_id") % 4 == 0).alias("table_row"),
        F.array(F.format_string("db31_%06d", F.col("doc_id") % 2)).alias("metric_ids"))
    return documents, chunks


KB = """WITH k AS MATERIALIZED (SELECT printf('%09d', doc_id) AS document_id, printf('c%09d', doc_id) AS chunk_id, doc_id, text, lang AS section,
  'Notes from ' || source AS title, 'N ' || (doc_id % 50) AS standard_number, 'v' || (doc_id % 3) AS version,
  CASE WHEN doc_id % 10 = 0 THEN 'user_specification' ELSE 'standards' END AS source_namespace, doc_id % 4 = 0 AS table_row,
  doc_id % 8 <> 0 AND doc_id % 9 <> 0 AS usable FROM documents)"""


def queries(spark, sf):
    return load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@check("doc6_upsert_documents", "SELECT document_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE 'old' END AS state FROM (SELECT printf('%09d', doc_id) AS document_id, doc_id FROM documents)")
def doc6(spark, sf):
    documents, _ = whole_documents(spark, sf)
    new = documents.where(F.col("document_id").cast("bigint") % 5 == 0)
    return D.upsert(documents.withColumn("state", F.lit("old")), new.withColumn("state", F.lit("new")), new).select("document_id", "state")


@check("doc6_remove_document", "SELECT printf('c%09d', doc_id) AS chunk_id FROM documents WHERE doc_id % 5 <> 0")
def doc6_remove(spark, sf):
    documents, chunks = whole_documents(spark, sf)
    return D.remove(chunks, documents.where(F.col("document_id").cast("bigint") % 5 == 0)).select("chunk_id")


@check("ret1_filter_documents", f"{KB} SELECT document_id FROM k WHERE usable AND source_namespace = 'standards' AND version = 'v1'")
def ret1(spark, sf):
    return R.filter_documents(whole_documents(spark, sf)[0], version=" V1", source_namespace="standards").select("document_id")


@check("ret2_filter_chunks_by_metric", f"{KB} SELECT chunk_id, title FROM k WHERE usable AND doc_id % 2 = 1")
def ret2(spark, sf):
    documents, chunks = whole_documents(spark, sf)
    return R.filter_chunks(chunks, R.filter_documents(documents), "DB31_000001").select("chunk_id", "title")


def d_score():
    """Scores of all queries by plain substring tests, then the ranking."""
    t, x = d_casefold("b.text"), d_casefold("k.text")
    return f"""{KB}, f AS MATERIALIZED (SELECT k.*, {x} AS ftext, {d_casefold('title')} AS ftitle, {d_casefold('section')} AS fsection FROM k WHERE usable),
q AS MATERIALIZED (SELECT item_id AS query_id, {d_casefold('text')} AS phrase, {D_TOKENS.format(c=d_casefold('text'))} AS terms FROM benchmark),
u AS (SELECT query_id, unnest(terms) AS term FROM q),
s AS MATERIALIZED (SELECT query_id, chunk_id, sum(CASE WHEN contains(ftext, term) THEN 1.0 ELSE 0.0 END + CASE WHEN contains(ftitle, term) THEN 2.0 ELSE 0.0 END
    + CASE WHEN contains(fsection, term) THEN 1.5 ELSE 0.0 END) AS points FROM u, f GROUP BY ALL),
p AS (SELECT s.query_id, f.*, (CAST(points AS DOUBLE) + CASE WHEN contains(ftext, phrase) THEN 4.0 ELSE 0.0 END) + CASE WHEN table_row THEN CAST(0.15 AS DOUBLE) ELSE 0.0 END AS score
  FROM s JOIN f USING (chunk_id) JOIN q USING (query_id) WHERE points > 0),
r AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM p) WHERE rank <= 20),
w AS MATERIALIZED (SELECT *, 12000 - coalesce(sum(least(length(text), 2400)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM r),
res AS MATERIALIZED (SELECT * EXCLUDE (text), left(text, CAST(least(2400, room) AS BIGINT)) AS text FROM w WHERE room > 0),
strong AS (SELECT * FROM res r1 WHERE score >= 0.55 * (SELECT max(score) FROM res r2 WHERE r2.query_id = r1.query_id)),
con AS MATERIALIZED (SELECT query_id FROM (SELECT query_id, standard_number, count(DISTINCT version) AS v FROM strong GROUP BY ALL) g
  JOIN (SELECT query_id, count(DISTINCT document_id) AS d, count(DISTINCT source_namespace) AS n FROM strong GROUP BY 1) h USING (query_id)
  GROUP BY query_id HAVING max(d) >= 2 AND (max(v) > 1 OR max(n) > 1))"""


@check("ret3_score", f"{d_score()} SELECT query_id, chunk_id, score FROM r")
def ret3(spark, sf):
    documents, chunks = whole_documents(spark, sf)
    candidates = R.filter_chunks(chunks, R.filter_documents(documents))
    return R.rank(R.prepare_queries(queries(spark, sf)), candidates, 20).select("query_id", "chunk_id", "score")


@check("ret4_rank", f"{d_score()} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def ret4(spark, sf):
    documents, chunks = whole_documents(spark, sf)
    candidates = R.filter_chunks(chunks, R.filter_documents(documents))
    return R.rank(R.prepare_queries(queries(spark, sf)), candidates, 5).select("query_id", "chunk_id", "rank")


def searched(spark, sf):
    documents, chunks = whole_documents(spark, sf)
    return R.search(queries(spark, sf), documents, chunks, limit=20)


@check("ret5_text_budget", f"{d_score()} SELECT query_id, CAST(rank AS INTEGER) AS rank, md5(text) AS text FROM res")
def ret5(spark, sf):
    return searched(spark, sf)[1].select("query_id", "rank", F.md5("text").alias("text"))


@check("ret6_conflict", f"{d_score()} SELECT query_id FROM con")
def ret6(spark, sf):
    return R.conflicts(searched(spark, sf)[1]).select("query_id")


@check("ret7_search", f"{d_score()} SELECT item_id AS query_id, CASE WHEN item_id IN (SELECT query_id FROM con) THEN 'conflict' WHEN n > 0 THEN 'ok' ELSE 'no_results' END AS status, "
       "coalesce(n, 0) AS result_count, (SELECT count(*) FROM k WHERE usable) AS filtered_document_count, (SELECT count(*) FROM k WHERE usable) AS total_candidate_count "
       "FROM benchmark LEFT JOIN (SELECT query_id, count(*) AS n FROM res GROUP BY 1) ON query_id = item_id")
def ret7(spark, sf):
    return searched(spark, sf)[0].select("query_id", "status", "result_count", "filtered_document_count", "total_candidate_count")


@check("ret8_kb_summary", f"{KB} SELECT source_namespace, count(*) AS document_count, count(*) FILTER (doc_id % 8 <> 0) AS approved_document_count, count(*) AS chunk_count FROM k GROUP BY 1")
def ret8(spark, sf):
    documents, chunks = whole_documents(spark, sf)
    return D.summary(documents, chunks)


@check("ret9_bind_evidence", f"{d_score()} SELECT query_id, chunk_id, CASE WHEN source_namespace = 'standards' THEN 'standard_clause' ELSE 'user_statement' END AS type, "
       "source_namespace = 'standards' AS authoritative, section || ' / 行 1-1 / chunk:' || chunk_id AS location FROM res WHERE query_id NOT IN (SELECT query_id FROM con)")
def ret9(spark, sf):
    responses, results = searched(spark, sf)
    return R.bind_evidence(results, responses).select("query_id", "chunk_id", "type", "authoritative", "location")


@check("ret10_validate_evidence", f"{d_score()} SELECT query_id, chunk_id AS evidence_id, 'other document version' AS problem FROM res WHERE source_namespace = 'standards' AND rank % 3 = 0 "
       "UNION ALL SELECT query_id, chunk_id, 'not among the results' FROM (SELECT query_id, chunk_id || '-x' AS chunk_id FROM res WHERE source_namespace = 'standards' AND rank % 3 = 1)")
def ret10(spark, sf):
    _, results = searched(spark, sf)
    changed = F.when(F.col("rank") % 3 == 1, F.concat("chunk_id", F.lit("-x"))).otherwise(F.col("chunk_id"))
    evidence = results.select(
        "query_id", changed.alias("evidence_id"), R.source_type(F.col("source_namespace")).alias("type"), changed.alias("chunk_id"),
        changed.alias("source_id"), "document_id", F.col("title").alias("document_name"),
        F.when(F.col("rank") % 3 == 0, "other").otherwise(F.col("version")).alias("document_version"))
    return R.evidence_problems(evidence, results)


@check("ret11_source_summary", f"{d_score()} SELECT query_id, chunk_id, title AS document_name, version, section || ' / 行 1-1 / chunk:' || chunk_id AS location FROM res")
def ret11(spark, sf):
    return R.source_summary(searched(spark, sf)[1]).select("query_id", "chunk_id", "document_name", "version", "location")


