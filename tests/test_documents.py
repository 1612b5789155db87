"""Chunking and search against plain Python brute force on small documents."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkassay.functions import fixed
from sparkassay.operators import documents as D
from sparkassay.operators import retrieval as R
from sparkassay.session import written

V1 = """# DB31/T 9999-2026 数据字段要求
版本：v1
发布日期：2026-01-01

## 2 完整性

### 2.1 服务名称
指标代码 020100。service_name 必须填写。
1.2 条款 第一行
续行

| a | b |
""" + "\n".join(f"| {i} | x |" for i in range(10)) + "\n结束"


def kb(spark, rows, **kw):
    df = spark.createDataFrame(rows, "source_name string, text string")
    return D.build(D.ingest(df, approved=True, **kw))


def test_ingest(spark):
    docs = D.ingest(spark.createDataFrame([("std/v1.md", V1), ("plain.txt", "hello"), ("e.md", "  ")],
                                          "source_name string, text string")).collect()
    a, b, c = docs
    assert (a.title, a.standard_number, a.version, a.published_at) == (
        "DB31/T 9999-2026 数据字段要求", "DB31/T9999-2026", "v1", "2026-01-01")
    assert b.title == "plain" and b.problem is None and c.problem == "no text"
    assert a.document_id.startswith("doc-") and len(a.document_id) == 24


def test_blocks_and_chunks(spark):
    _, chunks = kb(spark, [("v1.md", V1)])
    got = [(r.ordinal, r.section, r.clause, r.line_start, r.line_end, r.table_row) for r in chunks.orderBy("ordinal").collect()]
    title = "DB31/T 9999-2026 数据字段要求"
    assert got == [
        (0, title, None, 1, 3, False), (1, "2 完整性", None, 5, 5, False), (2, "2.1 服务名称", None, 7, 8, False),
        (3, "2.1 服务名称", "1.2", 9, 10, False), (4, "2.1 服务名称", "1.2", 12, 19, True),
        (5, "2.1 服务名称", "1.2", 20, 22, True), (6, "2.1 服务名称", "1.2", 23, 23, False)]
    assert chunks.where("ordinal = 2").first().metric_ids == ["db31_020100"]
    assert chunks.where("ordinal = 2").first().text == "### 2.1 服务名称\n指标代码 020100。service_name 必须填写。"


def plain_pack(lines):
    """The packing rule, line by line."""
    out, current, length = [], [], 0
    for n, t in lines:
        extra = len(t) + (1 if current else 0)
        if current and length + extra > fixed.MAX_CHUNK_CHARS:
            out.append(current)
            current = current[-1:]
            length = sum(len(x) + 1 for _, x in current)
        current = [*current, (n, t)]
        length += extra
    return [*out, current]


def test_oversized_block(spark):
    rng = random.Random(3)
    text = "\n".join("w" * rng.randint(1, 900) for _ in range(60)) + "\n" + "y" * 9000
    _, chunks = kb(spark, [("big.txt", text)])
    got = [(r.line_start, r.line_end, r.text) for r in chunks.orderBy("ordinal").collect()]
    want = [(p[0][0], p[-1][0], "\n".join(t for _, t in p)) for p in plain_pack(list(enumerate(text.split("\n"), 1)))]
    assert got == want and len(got) > 5


def test_upsert(spark):
    docs, chunks = kb(spark, [("a.md", "one\n\ntwo"), ("b.md", "three")])
    one = docs.where("source_name = 'a.md'")
    again = D.upsert(chunks, chunks.where("text = 'one'"), one)
    assert sorted(r.text for r in again.collect()) == ["one", "three"]
    assert D.remove(docs, one).count() == 1
    total = D.summary(docs, chunks).first()
    assert (total.document_count, total.approved_document_count, total.chunk_count) == (2, 2, 3)


def brute_score(query, chunk):
    folded = query.strip().casefold()
    parts = re.findall(r"[A-Za-z0-9_./:-]+|[㐀-鿿]", folded)
    terms = {t for t in parts if len(t) >= 2 or "㐀" <= t <= "鿿"}
    cjk = "".join(ch for ch in folded if "㐀" <= ch <= "鿿")
    terms |= {cjk[i:i + 2] for i in range(len(cjk) - 1)}
    text, title = chunk.text.casefold(), chunk.title.casefold()
    section, clause = (chunk.section or "").casefold(), (chunk.clause or "").casefold()
    score, hit = 0.0, False
    for t in terms:
        inside = (t in text, t in title, t in section or t in clause)
        hit = hit or any(inside)
        score += inside[0] + 2.0 * inside[1] + 1.5 * inside[2]
    if not terms:
        return 0.0
    score += 4.0 if folded in text else 0.0
    return score + (0.15 if hit and chunk.table_row else 0.0)


def test_search_matches_brute_force(spark):
    rng = random.Random(9)
    words = ["name", "字段", "必填", "code", "a1", "服务", "Rule", "cab", "ab", "Straße", "db31/t"]
    texts = [(f"d{i}.md", "# " + " ".join(rng.choices(words, k=3)) + "\n" + " ".join(rng.choices(words, k=20))
              + "\n\n| " + " | ".join(rng.choices(words, k=5))) for i in range(40)]
    docs, chunks = (written(x, "kb") for x in kb(spark, texts))
    queries = spark.createDataFrame(
        [(i, " ".join(rng.choices(words, k=k))) for i, k in enumerate([1, 2, 3, 4, 5, 2])] + [(9, "zzzz"), (10, "x")],
        "query_id long, query string")
    candidates = R.filter_chunks(chunks, R.filter_documents(docs)).collect()
    for limit in (1, 7, 20):
        responses, results = R.search(queries, docs, chunks, limit=limit)
        got = {}
        for r in results.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((round(r.score, 6), r.chunk_id))
        for q in queries.collect():
            scored = [(brute_score(q.query, c), c) for c in candidates]
            want = sorted(((s, c) for s, c in scored if s > 0), key=lambda x: (-x[0], x[1].document_id, x[1].ordinal))
            assert got.get(q.query_id, []) == [(round(s, 6), c.chunk_id) for s, c in want[:limit]]
    status = {r.query_id: r.status for r in responses.collect()}
    assert status[9] == status[10] == "no_results" and status[0] in ("ok", "conflict")


def test_one_plan_for_any_number_of_queries(spark):
    docs, chunks = kb(spark, [("a.md", "alpha beta"), ("b.md", "beta gamma")])
    texts = ["alpha", "beta", "gamma", "beta gamma"]
    many = spark.createDataFrame([(i, texts[i % 4]) for i in range(1000)], "query_id long, query string")
    few = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    found = lambda q: {(r.query_id, r["rank"], r.chunk_id) for r in R.search(q, docs, chunks)[1].collect()}
    want = found(few)
    assert found(many) == {(4 * k + i, n, c) for i, n, c in want for k in range(250)}


def test_limit_is_applied_before_the_shuffle(spark):
    docs, chunks = (written(x, "kb") for x in kb(spark, [(f"{i}.md", f"word{i} common text") for i in range(300)]))
    ranked = R.rank(R.prepare_queries(one(spark, "common text")), R.filter_chunks(chunks, docs), 3)
    rows = ranked.collect()
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    limits = re.findall(r"WindowGroupLimit \[query_id.*?\], row_number\(\), 3, (\w+)", plan)
    assert "Partial" in limits and "Final" in limits and len(rows) == 3
    assert not re.search("MapInPandas|MapInArrow|PythonUDF|EvalPython", plan)


def test_only_the_best_pairs_leave_a_group(spark, monkeypatch):
    """Common words match every chunk; of these pairs a group hands on ``limit`` and those whose text may hold the phrase."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "common"]
    docs, chunks = (written(x, "kb") for x in kb(spark, [(f"{i}.md", "common " + " ".join(rng.choices(words, k=6))) for i in range(300)]))
    queries = spark.createDataFrame([(1, "common"), (2, "alpha gamma"), (3, "common beta delta"), (4, "mma del"), (5, "nowhere")], "query_id long, query string")
    candidates = R.filter_chunks(chunks, R.filter_documents(docs))
    prepared, found = R.prepare_queries(queries), R.index(candidates)
    assert R.score(prepared, found, 3).where("query_id = 1").count() == 3
    scores = {}
    for c in candidates.collect():
        for q in queries.collect():
            if s := brute_score(q.query, c):
                scores.setdefault(q.query_id, []).append((-round(s, 6), c.document_id, c.ordinal, c.chunk_id))
    want = {(q, i + 1, r[3]) for q, rows in scores.items() for i, r in enumerate(sorted(rows)[:4])}
    assert len(scores[1]) >= 300 and 5 not in scores
    monkeypatch.setattr(R, "POSTINGS_AT_ONCE", 700)
    monkeypatch.setattr(R, "QUERIES_AT_ONCE", 2)
    assert {(r.query_id, r["rank"], r.chunk_id) for r in R.rank(prepared, found, 4).collect()} == want


def test_long_runs_and_grams(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh./-") for _ in range(60_000))
    cjk = "".join(chr(0x4E00 + rng.randrange(300)) for _ in range(30_000))
    docs, chunks = kb(spark, [("a.md", "short ab")])
    chunks = chunks.limit(1).select(*[F.lit(long + " " + cjk).alias(c) if c == "text" else F.col(c) for c in chunks.columns])
    places = [0, 18_400, 18_432, 24_570, 36_860, 59_980]
    asked = [long[p:p + n] for p in places for n in (2, 3, 20, 1999)] + [cjk[p // 3:p // 3 + 2] for p in places] + ["zz9", "\u9fff"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    found = {r.query_id: r.score for r in R.rank(R.prepare_queries(queries), R.filter_chunks(chunks, docs)).collect()}
    row = R.filter_chunks(chunks, docs).first()
    for i, q in enumerate(asked):
        assert found.get(i, 0.0) == pytest.approx(brute_score(q, row)), q


def test_conflict_documents_and_matched_terms(spark):
    docs, chunks = kb(spark, [("v1.md", V1), ("v2.md", V1.replace("版本：v1", "版本：v2"))])
    query = one(spark, "service_name 必须填写 nowhere")
    responses, results = R.search(query, docs, chunks, result_chars=5)
    conflict = R.conflicts(results).first()
    assert conflict.document_ids == sorted(conflict.document_ids) and len(conflict.document_ids) == 2
    assert sorted(conflict.versions) == ["v1", "v2"] and len(conflict.document_labels) == len(conflict.standard_numbers) == 2
    assert responses.first().cut_count == responses.first().result_count > 0
    assert all(r.cut and len(r.text) == 5 for r in results.collect())
    prepared, candidates = R.prepare_queries(query), R.filter_chunks(chunks, docs)
    for r in R.matched_terms(results, candidates, prepared).collect():
        whole = candidates.where(F.col("chunk_id") == r.chunk_id).first()
        inside = [t for t in prepared.first().terms if any(t in (x or "").casefold() for x in (whole.text, whole.title, whole.section, whole.clause))]
        assert r.matched_terms == sorted(inside) and "nowhere" not in inside


def one(spark, text):
    return spark.createDataFrame([(1, text)], "query_id long, query string")


def test_retrieval_goldens(spark):
    v2 = V1.replace("版本：v1", "版本：v2")
    docs, chunks = kb(spark, [("v1.md", V1), ("v2.md", v2)])
    status = lambda q, d=docs, **kw: R.search(one(spark, q), d, chunks, **kw)[0].first().status
    assert status("service_name 必须填写") == "conflict"
    assert status("service_name 必须填写", version="V1") == "ok"
    assert status("qqqq") == "no_results" and status("service_name", version="v9") == "no_results"
    assert status("service_name", docs.withColumn("approved", F.lit(False))) == "no_results"
    assert status("service_name", docs.withColumn("effective_status", F.lit("expired"))) == "no_results"
    responses, results = R.search(one(spark, "service_name"), docs, chunks, metric_id="DB31_020100", version="v1")
    assert results.count() == 1 and responses.first().total_candidate_count == 1
    evidence = R.bind_evidence(results, responses)
    row = evidence.first()
    assert row.type == "standard_clause" and row.authoritative and row.location.startswith("2.1 服务名称 / 行 7-8 / chunk:")
    tagged = evidence.withColumn("evidence_id", F.lit("e1"))
    assert R.evidence_problems(tagged, results).count() == 0
    twisted = tagged.withColumn("document_version", F.lit("v7"))
    assert [r.problem for r in R.evidence_problems(twisted, results).collect()] == ["other document version"]
    chosen = spark.createDataFrame([(1, "chunk-x")], "query_id long, chunk_id string")
    assert R.missing_choices(chosen, results).count() == 1
    mixed = spark.createDataFrame([(1, " "), (2, "x" * 2001), (3, None), (4, "service_name")], "query_id long, query string")
    responses = {r.query_id: r for r in R.search(mixed, docs, chunks, version="v1")[0].collect()}
    assert [responses[i].status for i in (1, 2, 3, 4)] == ["refused", "refused", "refused", "ok"]
    assert "empty" in responses[1].reason and "longer" in responses[2].reason and responses[4].reason is None


def test_text_budget(spark):
    df = spark.createDataFrame([(1, r, "x" * n) for r, n in enumerate([3000, 2400, 2000, 2400, 2400, 900, 50], 1)],
                               "query_id long, rank int, text string")
    assert [len(r.text) for r in R.text_budget(df).orderBy("rank").collect()] == [2400, 2400, 2000, 2400, 2400, 400]
