"""The operators against plain versions on small inputs, with nulls, empty and long texts, ties, repeated rows and empty tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import PATTERN
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F

from sparkassay.llm import (
    bpe, components, decontaminate, license_scan, line_rules, lsh_forest, page_template, quality, queries, token_files, toxicity,
    url_cascade,
)
from sparkassay.llm.isotonic import calibrate
from sparkassay.llm.storage import new_path, staged

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, judgement string, node string"


def _documents(spark, texts):
    rows = [(i, t, None, "s", None, 1.0, "own", "x") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def _words(seed, n):
    rng = random.Random(seed)
    return [rng.choice("the of and river stone light under over field house".split()) + rng.choice("abcdefgh") for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty texts, repeated rows, ties in doc_id, a very long text, clashing columns."""
    long = " ".join(_words(1, 60000))
    return _documents(spark, [(1, "Some plain words stand here, and more of them follow."), (1, "another text with the same id"),
                              (2, None), (3, ""), (4, " \n\t "), (None, "no id"), (5, long), (5, long), (6, "x" * 300000), (7, "ß漢🙂 \x85\xa0é")])


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---------------------------------------------------------------- 1
def test_quality_learns_and_keeps_columns(spark):
    good = [(i, " ".join(_words(i, 80)) + ".") for i in range(120)]
    bad = [(1000 + i, " ".join(w + "###" for w in _words(i, 80))) for i in range(60)]
    docs = _documents(spark, good + bad + [(5000, None), (5001, "")])
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in good + bad] + [(None, 1), (9999, 0)], "doc_id bigint, quality int")
    out = {r["doc_id"]: r for r in quality.score_documents(docs, labels).collect()}
    assert len(out) == 182
    for i, _ in good + bad:
        assert out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert out[i]["predicted"] == int(i < 1000)
        assert 0 <= out[i]["score"] <= 1
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {i for i, _ in good} <= {r["doc_id"] for r in kept.collect()}


def test_quality_without_labels_or_rows(spark, odd):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r["score"] for r in quality.score_documents(odd, labels).collect()} == {0.5}
    assert quality.score_documents(odd.limit(0), labels).count() == 0


def test_isotonic_is_rising_and_pools():
    c = calibrate([(0.0, 0, 10), (0.5, 8, 10), (0.6, 2, 10), (1.0, 10, 10)], prior_weight=0)
    assert list(c.values) == [0, 0.5, 1]
    assert (np.diff(c(np.linspace(-1, 2, 50))) >= 0).all()
    assert calibrate([])(np.array([3.0]))[0] == 0.5


# ---------------------------------------------------------------- 2
def _plain_rules(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    chars = sum(map(len, words))
    symbols = sum(c in "#*$%&|<>" for c in t)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), chars, symbols, len(lines) - len(set(lines)), len(covered), failed


def test_rules_equal_a_plain_version(spark, odd):
    texts = [(i, " ".join(_words(i % 5, 10)) + "\n" + " ".join(_words(i, 30))) for i in range(20)]
    texts += [(30, "a b c d e f g h " * 9), (31, "one\none\n\none"), (32, "a " * 9), (33, "\x0b x \f y\r\nz")]
    docs = odd.union(_documents(spark, texts))
    got = _rows(line_rules.measure(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert got == sorted(((r["doc_id"], *_plain_rules(r["text"])) for r in docs.collect()), key=repr)


def test_line_rules_remove_lines_and_keep_columns(spark):
    body = " ".join(_words(3, 40)) + "."
    docs = _documents(spark, [(1, f"Home | News | Shop | About\n{body}\nAll rights reserved"), (2, "\n".join([body[:30]] + ["A | b | c | d | e | f"] * 3 + [f"x{i} | y | z | w | v" for i in range(9)])), (3, None)])
    out = line_rules.cleaned(docs)
    assert out.columns == docs.columns
    assert [(r["doc_id"], r["text"], r["judgement"]) for r in out.collect()] == [(1, body, "own")]
    assert line_rules.keep_good(docs).first()["text"].startswith("Home")


# ---------------------------------------------------------------- 3
@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(tokenizer_path("byte_bpe_50k.tiktoken")), special_tokens={})


PARTS = ["a", "the ", " ", "  ", "\n", "\t", "é", "ñ", "\xa0", "\x1c", "1", "23", "'s", "'ll", "!", "###", "aaaa", "　", "漢", "🙂", " in", "tion",
         "\r\n", "ß", "<|endoftext|>", ", ", ". "]


def test_bpe_equals_the_library(tiktoken_encoding):
    rng = random.Random(5)
    own = bpe.Encoder(bpe.load_ranks(tokenizer_path("byte_bpe_50k.tiktoken")), PATTERN)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 60))) for _ in range(1500)]
    texts += ["", "ab" * 30000, " " * 3000, "x" * 200 + " y" * 70000, "\n \n" * 3000, "é" * 5000, "1234567890" * 500]
    for text in texts:
        ids = np.frombuffer(own.packed(text), "<u4").tolist()
        assert ids == tiktoken_encoding.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_bpe_digest(spark, odd, tiktoken_encoding):
    got = _rows(bpe.digest(odd, tokenizer_path("byte_bpe_50k.tiktoken"), PATTERN))
    want = []
    for r in odd.collect():
        text = r["text"] or ""
        ids = np.array(tiktoken_encoding.encode_ordinary(text), "<u4")
        want.append((r["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    ids = odd.select("text", bpe.token_ids(odd["text"], tokenizer_path("byte_bpe_50k.tiktoken"), PATTERN).alias("ids"))
    back = ids.select("text", bpe.decoded(ids["ids"], tokenizer_path("byte_bpe_50k.tiktoken"), PATTERN).alias("back"))
    assert all(bytes(r["back"]).decode() == (r["text"] or "") for r in back.collect())


# ---------------------------------------------------------------- 4
def test_token_files_round_trip(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(6)
    docs = odd.union(_documents(spark, [(100 + i, "".join(rng.choices(PARTS, k=40))) for i in range(300)]))
    path = new_path(spark, "test")
    token_files.write(docs, path, tokenizer_path("byte_bpe_50k.json"))
    rows = token_files.read(spark, path).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(library.encode(r["text"] or "", add_special_tokens=False).ids + [2])
    assert len(rows) == docs.count()
    for r in rows:
        assert r["ids"] in texts[r["doc_id"]] and r["n_tokens"] == len(r["ids"])
    rows.sort(key=lambda r: r["start"])
    assert [r["start"] for r in rows] == [0, *itertools.accumulate(r["n_tokens"] for r in rows)][:-1]
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert ids == sorted(ids)
    assert token_files.lookup(spark, path, 100) == texts[100]
    assert token_files.lookup(spark, path, -5) == []
    crc = {(r["doc_id"], r["ids_crc32"]) for r in token_files.read(spark, path, "crc").collect()}
    assert crc == {(i, zlib.crc32(np.array(x, "<u4").tobytes())) for i, lists in texts.items() for x in lists}


def test_token_files_of_nothing(spark, odd):
    path = new_path(spark, "test")
    token_files.write(odd.limit(0), path, tokenizer_path("byte_bpe_50k.json"))
    assert token_files.read(spark, path).count() == 0


class _Spied:
    """A library that notes what it is asked for."""

    def __init__(self, library):
        self.library, self.seen = library, []

    def encode_batch_fast(self, texts, **options):
        self.seen.extend(texts)
        return self.library.encode_batch_fast(texts, **options)


def test_token_files_ask_for_common_chunks_once(monkeypatch):
    """Rare chunks, however many come between, neither empty the memo nor change an id."""
    monkeypatch.setattr(token_files, "MEMO", 100)
    own, rng = token_files._Tokenizer(tokenizer_path("byte_bpe_50k.json")), random.Random(8)
    library = own._library
    own._library = spied = _Spied(library)
    for _ in range(60):
        texts = [" ".join(["First", "usual,", "1st", *("".join(rng.choices("abcdeßé", k=8)) for _ in range(10)), "over-again", "end.\nNew"])
                 for _ in range(2)]
        for text, packed in zip(texts, own.each(pa.array(texts)), strict=True):
            assert np.frombuffer(packed, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    asked = " ".join(spied.seen).replace("\n", " \n").split(" ")
    assert [asked.count(c) for c in ("usual,", "1st", "over-again", "\nNew")] == [1, 1, 1, 1]


@pytest.mark.parametrize(("memo", "together"), [(600_000, 8 << 20), (40, 200), (5, 1)])
def test_token_ids_equal_the_library(monkeypatch, memo, together):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "MEMO", memo)
    monkeypatch.setattr(token_files, "TOGETHER", together)
    monkeypatch.setattr(token_files, "CHUNKS", 7)
    library, rng = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), random.Random(memo)
    own = token_files._Tokenizer(tokenizer_path("byte_bpe_50k.json"))
    spaced = [*PARTS, "\x00", "\x00\n", "x\n", "Word. ", "\x85", "foo\nbar", "x" * 70 + " "]
    single = [p for p in spaced if not p.endswith(" ")] + [" w", " x,", " y.\nZ", " <|endoftext|>", "\n\n"] * 3
    texts = [None, "", " ", "  ", "\n", " \nfoo", "\nfoo", "a b ", "x" * 70 + " " + "y" * 70 + ".", "ab" * 30000]
    texts += ["".join(rng.choices(parts, k=rng.randint(0, 40))) for parts in (spaced, single) for _ in range(1500)]
    for text, packed in zip(texts, own.each(pa.array(texts)), strict=True):
        assert np.frombuffer(packed, "<u2").tolist() == library.encode(text or "", add_special_tokens=False).ids, text
    assert list(own.each(pa.array([], pa.string()))) == []


# ---------------------------------------------------------------- 5
def test_cascade_is_exact_and_rules_win(spark):
    universe = spark.range(3000).selectExpr("concat('host', id) AS key", "id % 7 = 0 AS listed")
    cascade = url_cascade.Cascade(staged(universe, "test"))
    assert len(cascade.levels) >= 2
    assert universe.where(cascade.contains(universe["key"]) != universe["listed"]).count() == 0
    joined = url_cascade.listed_by_join(universe.select("key"), universe.where("listed"), "key")
    assert joined.where("listed").count() == universe.where("listed").count()


def test_urls_equal_sql(spark):
    urls = [None, "", "x", "http://A.NET", "http://a.net/", "https://sub.Example.net/en/1?x=/de/", "http://example.net/english", "//example.net/en/",
            "ftp://EXAMPLE.com:80/de/", "http://example.com/de/", "http://notexample.com/de/x", "http://a.org/fr/#/x", "http://org/fr/", "http://bad-casino.com/de",
            "http://winter.com/", "http://a://b/c", "http:///p", "http://win.shop.com?x", "http://casino.org/fr/x"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls * 2)], "page_id bigint, url string")
    got = _rows(url_cascade.judge(pages))
    with duckdb.connect() as db:
        db.register("pages", pages.toPandas())
        assert got == sorted(db.sql(url_cascade.SQL).fetchall(), key=repr)
    assert url_cascade.judge(pages.limit(0)).count() == 0


def test_lists_too_large_to_send_are_joined(spark, monkeypatch):
    urls = [None, "", "http://casino.org/fr/x", *(f"http://{w}{i}.example/" for i in range(40) for w in ("win.", "plain"))]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls * 2)], "page_id bigint, url string")
    want = _rows(url_cascade.judge(pages))
    monkeypatch.setattr(url_cascade, "MAX_BYTES", 8)
    assert _rows(url_cascade.judge(pages)) == want


# ---------------------------------------------------------------- 6
def _plain_classes(texts):
    sets = {}
    for text in {t or "" for _, t in texts}:
        words = re.findall(r"[^ \t\n\v\f\r]+", text)
        sets[text] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    names = list(sets)
    root = {t: t for t in names}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    links = dict.fromkeys(names, 0)
    for a, b in itertools.combinations(names, 2):
        if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = {}
    for i, t in texts:
        if i is not None:
            least[find(t or "")] = min(i, least.get(find(t or ""), i))
    return sorted(((i, least.get(find(t or "")) if sets[t or ""] else i, links[t or ""]) for i, t in texts), key=repr)


def test_classes_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "BLOCK", 16)  # groups of several blocks
    rng = random.Random(8)
    texts, n = [], 0
    for group in range(12):
        base = _words(group, 120)
        for _ in range(60 if group == 0 else 6):
            copy = base[:]
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"w{rng.random()}"
            texts.append(((n := n + 1), " ".join(copy)))
    texts += [(900, texts[5][1]), (901, texts[5][1]), (901, texts[5][1]), (902, None), (903, ""), (904, " \n"), (905, "one two"), (906, "one  two"), (907, "one"), (None, "one two")]
    docs = _documents(spark, texts)
    assert _rows(lsh_forest.join_classes(docs)) == _plain_classes(texts)
    kept = lsh_forest.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {i for i, c, _ in _plain_classes(texts) if i == c}
    assert sorted(ids, key=repr) == sorted(want, key=repr)


def test_pairs_at_the_threshold_share_a_bucket(spark):
    """94 words, the last ten of them other ones: 80 shingles of 100 in common."""
    rng = random.Random(18)
    pairs = []
    for _ in range(5000):
        words = [f"w{rng.randrange(10**9)}" for _ in range(104)]
        pairs.append((" ".join(words[:94]), " ".join(words[:84] + words[94:])))
    table = spark.createDataFrame(pairs, "a string, b string").repartition(8)
    met = table.where(F.arrays_overlap(lsh_forest.sketch(F.col("a")), lsh_forest.sketch(F.col("b")))).count()
    assert met >= 0.998 * len(pairs)
    assert lsh_forest.recall(lsh_forest.depth()) >= lsh_forest.TARGET > lsh_forest.recall(lsh_forest.depth() + 1)


def test_classes_of_nothing(spark, odd):
    assert lsh_forest.join_classes(odd.limit(0)).count() == 0
    assert lsh_forest.join_classes(odd).count() == odd.count()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (7, 7)], "u bigint, v bigint")
    assert {tuple(r) for r in components.components(edges).collect()} == {(i, 0) for i in range(41)} | {(99, 99), (100, 99)}


# ---------------------------------------------------------------- 7
def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _step(row, i, x, b)
    return row[-1]


def _step(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_leaks_with_edits_are_found(spark):
    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randint(14, 60)))) for i in range(40)] + [(90, None), (91, "")]
    texts, want = [], set()
    for n, (item, text) in enumerate(items[:40]):
        words = text.split()
        for _ in range(decontaminate.max_edits(len(words)) if n % 2 else 0):
            words[rng.randrange(len(words))] = f"e{rng.random()}".replace(".", "")
        texts.append((n, " ".join(_words(n, 30)) + " " + " ".join(words).upper() + ", " + " ".join(_words(n + 1, 30))))
        want.add((n, item))
    texts += [(500, " ".join(_words(77, 500))), (501, None), (502, ""), (503, " ".join(items[0][1].split()[:6]))]
    docs = _documents(spark, texts)
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, table).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and {w for w in want if w[0] % 2 == 0} <= got
    kept = decontaminate.keep_clean(docs, table)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in texts} - {i for i, _ in got}
    assert decontaminate.contaminated(docs, table.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), table).count() == 0


def test_fewest_edits_is_exact():
    rng = random.Random(10)
    for _ in range(200):
        item = [rng.randrange(4) for _ in range(rng.randint(1, 7))]
        text = [rng.randrange(4) for _ in range(rng.randint(0, 12))]
        want = min(_distance(item, text[a:b]) for a in range(len(text) + 1) for b in range(a, len(text) + 1))
        assert decontaminate.fewest_edits(np.array(item, np.uint64), np.array(text, np.uint64))[0] == want


def test_long_items_among_short_ones_are_found(spark):
    rng = random.Random(19)
    sizes = [14] * 401 + [400] * 7
    items = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))) for i, n in enumerate(sizes)]
    texts = []
    for n, (i, text) in enumerate(items[401:] * 6):
        words = text.split()
        for at in rng.sample(range(400), decontaminate.max_edits(400)):
            words[at] = f"e{rng.randrange(10**6)}"
        texts.append((n, " ".join(words)))
    got = decontaminate.contaminated(_documents(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(n, 401 + n % 7) for n in range(42)]


def test_lengths_beyond_the_repetitions_are_verified_exactly(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "LONGEST_TRIED", 20)
    rng = random.Random(20)
    words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    edited = [w if i % 10 else "e" + w for i, w in enumerate(words)]
    docs = _documents(spark, [(1, "a b c " + " ".join(edited) + " d"), (2, " ".join(words[:80]))])
    items = spark.createDataFrame([(5, " ".join(words)), (6, " ".join(_words(6, 100)))], "item_id bigint, text string")
    assert _rows(decontaminate.contaminated(docs, items).select("doc_id", "item_id", "edits")) == [(1, 5, 10)]


def test_items_that_share_an_id_are_verified_each(spark):
    rng = random.Random(21)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(40)] for _ in range(6)]
    items, texts = [], []
    for n, own in enumerate(words):
        item = None if n % 2 else 7
        items += [(item, " ".join(own[:28] + [f"d{n}x{i}x{j}" for j in range(12)])) for i in range(12)]  # meet the document, beyond the edits
        items += [(item, " ".join(own)), (item, " ".join(own[:20] + [f"s{n}x{j}" for j in range(10)]))]
        texts.append((n, " ".join(own)))
    docs, table = _documents(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contaminated(docs, table)
    assert _rows(got) == sorted(((n, None if n % 2 else 7, 0, 0) for n in range(6)), key=repr)
    assert decontaminate.keep_clean(docs, table).count() == 0


# ---------------------------------------------------------------- 8
def test_license_scan(spark, odd):
    mit = license_scan.TEMPLATES[0][1]
    changed = mit.replace("free of charge, to any person", "free of any charge and cost, to a person")
    docs = odd.union(_documents(spark, [(20, f"Intro words. {mit} More."), (21, changed), (22, "The MIT-License and mit license, CC BY 4"), (23, "mit"), (24, " ".join(mit.split()[:9]))]))
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert license_scan.scan(docs).count() == docs.count()
    assert (got[20]["n_base"], got[20]["base_labels"], got[20]["labels"], got[20]["score"]) == (0, "", "mit", 1.0)
    assert got[21]["labels"] == "mit" and 0.6 <= got[21]["score"] < 1
    assert (got[22]["n_base"], got[22]["first_word"], got[22]["last_word"], got[22]["base_labels"]) == (3, 1, 6, "cc-by,mit")
    assert (got[23]["labels"], got[23]["score"], got[24]["labels"], got[2]["n_words"]) == ("", 0.0, "", 0)


# ---------------------------------------------------------------- 9
def _page(article, extra=""):
    return (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/'>Menu</a></ul></nav>"
            f"<div class='ad'>Buy</div><article><h1>Head &amp; line</h1>{article}</article>{extra}<footer>&copy; foot</footer></body></html>")


def test_pages(spark):
    cases = {
        1: (_page("<p>One  <b>two</b>\n three.<p>Four<br>five &lt;x&gt;"), "Head & line\nOne two three.\nFour five <x>"),
        2: (_page("<p>A</p><div class='sidebar'>no</div><p>B</p>", "<section class='comments'><p>Nice!</p></section>"), "Head & line\nA\nB"),
        3: (_page("<p>long text here</p>")[:-40], "Head & line\nlong text here"),
        4: (None, ""), 5: ("", ""), 6: ("plain <i>text</i><!-- no", "plain text"),
    }
    rows = [(i, "http://h.example/x", page) for i, (page, _) in cases.items()] + [(7, None, _page("<p>Z</p>")), (1, "http://h.example/x", cases[1][0])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = page_template.extract(pages).collect()
    assert len(out) == len(rows)
    for r in out:
        want = "Head & line\nZ" if r["page_id"] == 7 else cases[r["page_id"]][1]
        assert (r["text"], r["n_chars"]) == (want, len(want))
    assert {tuple(r) for r in page_template.templates(pages.where("page_id <> 6")).collect()} == {("h.example", "/html/body/article"), ("", "/html/body/article")}
    assert page_template.extract(pages.limit(0)).count() == 0


def test_odd_pages_and_numbered_ids_do_not_spoil_a_template(spark):
    def page(open_tag, words, close_tag, rest="<div class='teaser'>Read this too</div>"):
        return f"<html><body><nav>Menu</nav>{open_tag}<p>{words}</p>{close_tag}{rest}</body></html>"

    long = " ".join(_words(3, 30))
    rows = [(i, "http://a.example/", page(f"<article id='post-{i}'>", long, "</article>"), long) for i in range(20)]
    rows += [(20, "http://a.example/", "<html><body><nav>Menu</nav><p>Not found</p></body></html>", "Not found"),
             (21, "http://a.example/", page("<article id='post-21'>", long, f"</article><article id='post-22'><p>{long}</p></article>"), f"{long}\n{long}")]
    rows += [(30 + i, "http://b.example/", page(f"<article id='{w}'>", long, "</article>"), long) for i, w in enumerate(("one", "two", "three", "four"))]
    rows += [(40 + i, "http://b.example/", page("<main>", long, "</main>"), long) for i in range(2)]  # another layout of the host
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, html string")
    assert {r["page_id"]: r["text"] for r in page_template.extract(pages).collect()} == {r[0]: r[3] for r in rows}


def _article(words, inside="", around=("<article>", "</article>")):
    return f"<html><body><nav>Menu</nav>{around[0]}<p>{words}</p>{inside}{around[1]}<footer>foot</footer></body></html>"


def test_words_of_a_template_and_names_of_furniture(spark):
    own = [" ".join(random.Random(i).choices([f"w{n}" for n in range(500)], k=30)) for i in range(20)]
    notice = "<div class='x'>We have changed our terms of use</div>"
    rows = [(i, "http://notice.example/", _article(own[i], notice), own[i]) for i in range(20)]
    rows += [(100 + i, "http://few.example/", _article(own[i], notice if i < 3 else ""), own[i] + ("\nWe have changed our terms of use" if i < 3 else "")) for i in range(20)]
    rows += [(200 + i, "http://copies.example/", _article(own[0], notice), f"{own[0]}\nWe have changed our terms of use") for i in range(20)]
    rows += [(300 + i, "http://form.example/", _article(own[i], around=("<form method='post'><div>", "</div></form>")), own[i]) for i in range(6)]
    rows += [(400 + i, "http://plain-form.example/", _article(own[i], "<form><p>Your name</p></form>"), own[i]) for i in range(6)]
    rows += [(500 + i, "http://head.example/", _article(own[i], f"<header><h1>Title {i}</h1><span>by me {i}</span></header>"), f"{own[i]}\nTitle {i}") for i in range(6)]
    rows += [(600 + i, "http://names.example/", _article(own[i], f"<div class='social-policy'>Policy {i}</div><div id='comment-list-{i}'>Nice {i}</div>"), f"{own[i]}\nPolicy {i}")
             for i in range(6)]
    rows += [(700, "http://sign.example/", _article("<i title='a > b' class=c>Yes</i> <b title='x>y</b>No"), "Yes yNo")]
    # An article nested in a wrapper that all pages have; another layout has a section there.
    rows += [(800 + i, "http://nested.example/", _article(own[i], f"</{t}><p>Read on {i}</p>", (f"<main><{t}>", "</main>")), own[i])
             for i in range(20) for t in (("article", "section")[i % 2],)]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in page_template.extract(pages).collect()}
    assert {i: t for i, t in got.items() if t != {r[0]: r[3] for r in rows}[i]} == {}


def test_classes_agree_with_whole_occurrence_vectors(spark):
    def page(i):
        layout = "<article><div><p>{}</p></div></article>" if i % 3 else "<section><p>{}</p></section>"
        odd = "" if i != 7 else "<main></main>"
        return f"<html><body><main>{layout.format(' '.join(_words(i, 20)))}</main>{odd}</body></html>"

    html = [page(i) for i in range(40)]
    pages = spark.createDataFrame([(i, "http://h.example/", p) for i, p in enumerate(html)], "page_id bigint, url string, html string")
    got = page_template.host_slots(pages).collect()[0]["slots"]
    on = {s["path"]: {i for i, p in enumerate(html) if s["path"] in page_template.occurrences(p)[0]} for s in got}
    assert {"/html/body/main", "/html/body/main/article", "/html/body/main/article/div", "/html/body/main/section"} <= set(on)
    for a in got:
        for b in got:
            alike = len(on[a["path"]] & on[b["path"]]) * 10 >= len(on[a["path"]] | on[b["path"]]) * 9
            assert (a["nth"] == b["nth"]) == alike, (a["path"], b["path"])


# ---------------------------------------------------------------- 10
def test_toxicity_learns_words_and_sees_through_disguise(spark):
    rng = random.Random(12)
    plain = [" ".join(_words(i, 60)) for i in range(300)]
    rude = [" ".join(_words(1000 + i, 30)) + f" {rng.choice(['blockhead', 'nitwit'])} " + " ".join(_words(i, 30)) for i in range(150)]
    texts = list(enumerate(plain + rude)) + [(900, None), (901, ""), (902, "what a bl0ckh3ad you are"), (903, "you n i t w i t"), (904, "nitwiiiiit"), (905, "a n.i.t.w.i.t indeed")]
    docs = _documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in range(450)] + [(7777, 1), (None, 1)], "doc_id bigint, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    assert len(out) == len(texts)
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(450))
    assert all(out[i]["predicted"] == int(i >= 300) for i in range(450))
    assert [out[i]["predicted"] for i in (900, 901, 902, 903, 904, 905)] == [0, 0, 1, 1, 1, 1]
    empty = toxicity.score_documents(docs, labels.limit(0))
    assert {r["score"] for r in empty.collect()} == {toxicity.BASE}
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_disguises_of_all_shapes_are_restored():
    counts = np.ones((28, 28, 28))
    for word in ("idiot", "loser", "asshole", "ass", "clown", "trash", "nitwit"):
        at = [0, 0, *(ord(c) - 96 for c in word), 0]
        for a, b, c in zip(at, at[1:], at[2:]):
            counts[a, b, c] += 1000
    model = np.log(counts / counts.sum(2, keepdims=True))
    cases = {"1d10t": "idiot", "l053r": "loser", "4$$h0l3": "asshole", "1d!0t": "idiot", "i-d-1-0-t": "idiot", "i" * 50 + "diot": "idiot",
             "(lown": "clown", "((lown!)": "clown", "a$s": "ass", "1 d 1 0 t": "idiot", "n  i --  t * w...i\tt": "nitwit", "tr@$h.": "trash", "a $ s": "ass",
             "http://" + "long.example/" * 9 + "1d10t/x?y=1": "idiot", "'4$$h0l3'!": "asshole", "a$$": "ass"}
    for text, word in cases.items():
        assert word in toxicity.restored_words(f"so {text} there", model), text
    assert toxicity.restored_words("Plain words, and (more) of them; \"none\" disguised.", model).count("idiot") == 0
    assert len(toxicity.decode("a1" * 100_000, model)) == 200_000
    assert toxicity.restored_words(" ".join("*" * 5000) + " " + "-*" * 5000, model) is not None


# ---------------------------------------------------------------- all
def test_registered_sql_equals_queries(spark, data):
    with duckdb.connect() as db:
        for table in ("documents", "pages"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
        for name, sql in queries.ORACLES.items():
            got = queries.QUERIES[name](spark, data)
            want = db.sql(sql)
            assert sorted(got.columns) == sorted(want.columns)
            assert _rows(got.select(*want.columns)) == sorted(want.fetchall(), key=repr)


def test_pipeline_stages_keep_the_rows_of_plain_versions(spark, data):
    import corpus_pipeline

    docs, items = (spark.read.parquet(f"{data}/{name}.parquet") for name in ("documents", "benchmark"))
    stages = dict(corpus_pipeline.STAGES)
    rows = docs.select("doc_id", "text").collect()

    def kept(name):
        return sorted(r["doc_id"] for r in stages[name](spark, docs, data).select("doc_id").collect())

    assert kept("n-gram Jaccard join") == sorted({i for i, c, _ in _plain_classes([tuple(r) for r in rows]) if i == c})
    known = [decontaminate._item_words(r["text"]) for r in items.collect()]
    texts = {r["doc_id"]: decontaminate._item_words(r["text"]) for r in rows}
    clean = [i for i, text in texts.items() if not any(
        decontaminate.fewest_edits(item, text)[0] <= decontaminate.max_edits(len(item)) for item in known
        if len(np.intersect1d(item, text)) >= len(np.unique(item)) - decontaminate.max_edits(len(item)) - 1)]
    assert kept("benchmark decontamination") == sorted(clean)


def test_pipeline_stages_keep_columns(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, count = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = new_path(spark, "stage")
        stage(spark, docs, data).write.parquet(path)
        docs = spark.read.parquet(path)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert 0 < docs.count() <= count
            count = docs.count()
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and docs.count() == count


def test_pipeline_stages_bound_the_batches_of_python(spark):
    import corpus_pipeline

    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, docs = spark.conf.get(conf), spark.range(4000).repartition(1)
    sizes = F.arrow_udf(lambda ids: pa.array([len(ids)] * len(ids)), "bigint")
    stage = corpus_pipeline.small_batches(lambda spark, docs, sf_dir: docs.select(sizes("id").alias("n")))
    try:
        for given, most in (("10000", corpus_pipeline.BATCH), ("0", corpus_pipeline.BATCH), ("300", 300)):
            spark.conf.set(conf, given)
            assert stage(spark, docs, "").agg(F.max("n"), F.count("n")).first() == (most, 4000)
    finally:
        spark.conf.set(conf, before)


# ---------------------------------------------------------------- columns of any name
def test_filters_keep_columns_of_any_name(spark):
    text = " ".join(_words(3, 60)) + "."
    names = ["__node", "node", "__kept", "__judged_words", "judgement", "verdict", "row", "gone_id", "gone_node", "__gone", "a.b"]
    docs = _documents(spark, [(1, text), (1, text), (2, text + " more"), (3, None), (None, "short"), (4, " ".join(_words(9, 80)))])
    docs = docs.select("doc_id", "text", *(F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in names))
    items = spark.createDataFrame([(1, " ".join(_words(9, 80)))], "item_id bigint, text string")
    for kept, ids in ((lsh_forest.keep_one(docs), [None, 1, 3, 4]), (decontaminate.keep_clean(docs, items), [None, 1, 1, 2, 3]),
                      (line_rules.keep_good(docs), [1, 1, 2, 4])):
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i)) == ids
        assert all(r[n] == (None if r.doc_id is None else f"{n} {r.doc_id}") for r in rows for n in names)
    assert line_rules.cleaned(docs).columns == docs.columns
