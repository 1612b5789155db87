"""Packing, fill-in-middle and spelling variants against plain versions, libraries and SQL."""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkassay.llm import best_fit, fill_middle, fm_spelling, queries
from sparkassay.llm.storage import staged

WORD_BPE = tokenizer_path("word_bpe_49k.json")
# Columns that the operators make themselves stand beside the text under the same names.
SCHEMA = "doc_id bigint, text string, n bigint, form string, word string, length string, shard int, unit string, ids string"


def _documents(spark, texts):
    return spark.createDataFrame([(i, t, 1, "own", "w", "x", 0, "u", "i") for i, t in texts], SCHEMA)


def _words(seed, n):
    rng = random.Random(seed)
    return [rng.choice("the of and river stone light under over field house".split()) + rng.choice("abcdefgh") for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty texts, repeated rows, ties in doc_id, long texts and words, marks, clashing columns."""
    return _documents(spark, [
        (1, "Some plain words stand here, and more follow."), (1, "another text with the same id"), (2, None), (3, ""), (4, " \n\t "),
        (None, "no id, no cry"), (None, None), (5, " ".join(_words(1, 60000))), (5, " ".join(_words(1, 60000))), (6, "x" * 300000),
        (7, "ß漢🙂 \x85\xa0é ä <|endoftext|> don't\x00it's \x00"), (8, "with <P> a mark"), (9, "half <S"), (10, "!" * 70000),
        (11, "1a" * 40000)])


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---------------------------------------------------------------- 11
def _plain_best_fit(lengths, size):
    """One piece after the other into the tightest open sequence; how many sequences end with each load."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if size - sum(b) >= n]
        if fits:
            min(fits, key=lambda b: size - sum(b)).append(n)
        else:
            bins.append([n])
    return Counter(map(sum, bins))


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([1, 7, 20, 64, 100])
    lengths = [rng.choice([rng.randint(1, size), rng.randint(1, max(1, size // 5)), size // 2 or 1]) for _ in range(rng.randint(0, 150))]
    plan = best_fit.plan(Counter(lengths), size)
    bins, at = defaultdict(list), 0
    for row, n in enumerate(plan):
        first, sequence, each, offset, length = n.tolist()
        assert first == at
        at = plan[row + 1][0] if row + 1 < len(plan) else len(lengths)
        for k in range(at - first):
            bins[sequence + k // each].append((offset + k % each * length, length))
    for placed in bins.values():
        placed.sort()
        assert [o for o, _ in placed] == np.cumsum([0, *(n for _, n in placed)])[:-1].tolist()
    assert Counter(sum(n for _, n in b) for b in bins.values()) == _plain_best_fit(lengths, size)
    assert sorted(bins) == list(range(len(bins)))


def test_capacities_find_the_tightest():
    tree, rng, held = best_fit.Capacities(50), random.Random(3), []
    for _ in range(2000):
        if rng.random() < 0.5:
            held.append(rng.randint(1, 50))
            tree.put(held[-1], 0, 1)
        else:
            least = rng.randint(1, 50)
            fits = [r for r in held if r >= least]
            found = tree.take(least)
            assert (found and found[0]) == (min(fits) if fits else None)
            if found:
                held.remove(found[0])


@functools.lru_cache
def _library():
    return Tokenizer.from_file(WORD_BPE)


def _ids(text):
    return _library().encode(text or "", add_special_tokens=False).ids + [0]


def test_packing(spark, odd):
    packed = best_fit.pack(odd, WORD_BPE)
    rows = packed.collect()
    expected = Counter()
    for doc, text in odd.select("doc_id", "text").collect():
        ids = _ids(text)
        expected.update((doc, p, at, zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes()), len(ids[at : at + 2048]))
                        for p, at in enumerate(range(0, len(ids), 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32, r.length) for r in rows) == expected
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length, best_fit.wide(bytes(r.ids)).tolist()))
    for parts in by_sequence.values():
        parts.sort()
        ends = np.cumsum([n for _, n, _ in parts])
        assert [o for o, _, _ in parts] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(by_sequence) == sum(_plain_best_fit([r.length for r in rows], 2048).values())
    joined = {r.sequence_id: r.ids for r in best_fit.sequences(packed).collect()}
    assert joined == {s: [i for _, _, ids in p for i in ids] for s, p in by_sequence.items()}


def test_packing_of_nothing_and_of_small_sequences(spark, odd):
    assert best_fit.pack(odd.limit(0), WORD_BPE).count() == 0
    small = best_fit.pack(odd.where("doc_id < 5"), WORD_BPE, size=4, end=49407).select("length", "ids").collect()
    assert max(r.length for r in small) == 4 and 49407 in {i for r in small for i in best_fit.wide(bytes(r.ids)).tolist()}


def test_tokens_beyond_the_memo(monkeypatch):
    monkeypatch.setattr(best_fit, "MEMO", 40)
    monkeypatch.setattr(best_fit, "BLOCK", 50)
    own = best_fit.WordTokenizer(WORD_BPE)
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["Word", "word,", "it's", " ", "  ", "\n", "é", "́", "!?", "...", "12", "\x00", "\t", "x" * 70, "<|endoftext|>"])
                       for _ in range(rng.randint(0, 60)))
        assert np.frombuffer(own.packed(text) + b"\0\0\0\0", "<u4").tolist() == _ids(text), text


def test_common_chunks_outlive_a_full_memo(monkeypatch):
    """Chunks of every text are encoded once, however many others come between; all ids stay those of the library."""
    monkeypatch.setattr(best_fit, "MEMO", 30)
    rng = random.Random(8)
    own, asked = best_fit.WordTokenizer(WORD_BPE), []
    learn = own._learn

    def spied(unknown):
        before = set(own._memo) | set(own._older)
        out = learn(unknown)
        asked.extend(set(own._memo) - before)
        return out

    own._learn = spied
    for _ in range(60):
        text = " ".join(["Common", "usual,", "1st", *("".join(rng.choices("abcdeßé", k=8)) for _ in range(10)), "over-again"])
        assert np.frombuffer(own.packed(text) + b"\0\0\0\0", "<u4").tolist() == _ids(text)
    assert [asked.count(c) for c in ("usual,", "1st", "over-again")] == [1, 1, 1]


# ---------------------------------------------------------------- 12
@pytest.mark.parametrize("text", [
    "", "a", "-", "abc de1f\n\ng", "x" * 200000, "-" * 200000, "1a" * 100000, "a" * 65536 + "b", "a" * 65535 + "-b", "ab " * 50000 + "-" * 90000,
    "é漢a🙂bB" * 30000, "a" * 65536 + "-" + "z" * 65535])
def test_boundaries_select(text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    ends = np.concatenate(([0], np.cumsum([len(u) for u in units]))).astype(int)
    own = fill_middle.Boundaries(text)
    assert len(own) == len(units)
    for k in {0, 1, len(units) // 3, len(units) // 2, len(units) - 1, len(units)} | set(random.Random(1).choices(range(len(units) + 1), k=200)):
        if 0 <= k <= len(units):
            assert own.after(k) == ends[k]


def test_all_kinds_of_containers():
    rng = np.random.default_rng(0)
    for share, kind in ((0.01, fill_middle._Array), (0.5, fill_middle._Bitmap), (1.0, fill_middle._Runs)):
        members = rng.random(65536) < share
        own = fill_middle.container(members)
        assert type(own) is kind
        assert [own.select(k) for k in range(int(members.sum()))] == np.flatnonzero(members).tolist()


def _plain_middle(doc, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, h = len(units), hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(spark, odd):
    many = odd.unionByName(_documents(spark, [(100 + i, " ".join(_words(i, 30)) + ("<S" if i % 3 else ">")) for i in range(150)]))
    texts = Counter((d, t) for d, t in many.select("doc_id", "text").collect())
    out = fill_middle.transform(many).withColumn("back", fill_middle.restored(F.col("form"), F.col("output"))).collect()
    assert {r.form for r in out} == {"plain", "spm", "psm"}
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out)
    assert got == Counter({(d, *_plain_middle(d, t), t or ""): k for (d, t), k in
                           Counter({(d, t or ""): sum(v for (x, y), v in texts.items() if x == d and (y or "") == (t or ""))
                                    for d, t in texts}).items()})
    assert fill_middle.transform(many.limit(0)).count() == 0


def test_fill_in_middle_equals_its_sql(spark, odd):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r.doc_id for r in odd.collect()], "text": [r.text for r in odd.collect()]}))
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    expected = con.sql(f"SELECT {', '.join(names)} FROM ({fill_middle.SQL})").fetchall()
    assert _rows(fill_middle.digest(odd).select(*names)) == sorted(expected, key=repr)


# ---------------------------------------------------------------- 13
def _plain_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def _one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    i = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a[i:] == b[i + 1 :]


def _plain_variants(counts):
    near = {w: [v for v in counts if _one_edit(w, v)] for w in counts}
    best = {w: min(v, key=lambda x: (-counts[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if counts[b] >= 5 * counts[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items())


def _edited(rng, word, letters):
    i, c = rng.randrange(len(word) + 1), rng.choice(letters)
    return rng.choice([word[:i] + c + word[i:], word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :]])


@pytest.fixture(scope="module")
def vocabulary():
    rng, letters = random.Random(11), "abcéß"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(6, 9))): rng.choice([5, 6, 40, 300, 5000]) for _ in range(250)}
    for w in list(words):
        for _ in range(3):
            words.setdefault(_edited(rng, w, letters), rng.choice([5, 7, 30]))
    runs = {"a" * k: 5 ** (1 + k % 5) for k in range(6, 14)} | {"ab" * k: 6 for k in range(3, 7)} | {"ab" * k + "a": 40 for k in range(3, 7)}
    long = {"q" * 400: 5, "q" * 401: 30, "q" * 200 + "r" + "q" * 199: 200}
    return {w: n for w, n in (words | runs | long).items() if len(w) >= 6}


@pytest.mark.parametrize("symbols", [1_000_000, 300])
def test_near_words_in_small_and_large_blocks(spark, vocabulary, symbols):
    words = staged(spark.createDataFrame(list(vocabulary.items()), "word string, n bigint"), "vocabulary-test")
    got = {r.word: (r.n_near, r.form, r.form_n) for r in fm_spelling.near_words(words, symbols).collect()}
    assert set(got) == set(vocabulary)
    for w in vocabulary:
        near = [v for v in vocabulary if _one_edit(w, v)]
        best = min(near, key=lambda x: (-vocabulary[x], x)) if near else None
        assert got[w] == (len(near), best, vocabulary.get(best)), w


def test_intervals_wider_than_the_alphabet(spark):
    words = {"".join(w): 5 + sum(c == "a" for c in w) for k in (6, 7) for w in itertools.product("ab", repeat=k)}
    table = staged(spark.createDataFrame(list(words.items()), "word string, n bigint"), "vocabulary-test")
    for r in fm_spelling.near_words(table).collect():
        near = [v for v in words if _one_edit(r.word, v)]
        assert (r.n_near, r.form) == (len(near), min(near, key=lambda x: (-words[x], x))), r.word


def test_variants_of_texts(spark, odd, vocabulary):
    rng = random.Random(2)
    stock = [w for w, n in vocabulary.items() for _ in range(min(n, 60)) if len(w) < 100]
    rng.shuffle(stock)
    texts = [(i, " ".join(w.upper() if w.isascii() and i % 7 == 0 else w for w in stock[i::400])) for i in range(400)] + [(None, "Ärgere÷× " * 9)]
    docs = odd.unionByName(_documents(spark, texts))
    counts = _plain_words([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert _rows(fm_spelling.variants(docs)) == sorted(_plain_variants(counts), key=repr)


def test_variants_chain_and_nothing(spark, odd):
    chain = {"abcdefg": 5, "abcdefgh": 25, "abcdefghi": 125, "abcdefghij": 700, "abcdefghijk": 4000}
    docs = _documents(spark, [(0, " ".join(" ".join([w] * n) for w, n in chain.items()))])
    counts = _plain_words([(0, docs.first().text)])
    assert _rows(fm_spelling.variants(docs)) == sorted(_plain_variants(counts), key=repr)
    assert {r.root for r in fm_spelling.variants(docs).collect()} == {"abcdefghijk"} or len(counts) != 5
    assert fm_spelling.variants(odd.limit(0)).count() == 0


def test_registered_queries_equal_plain_versions(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    packed = queries.QUERIES["op11_best_fit_packing"](spark, data).collect()
    assert Counter((r.doc_id, r.start) for r in packed) == Counter((d, at) for d, t in docs for at in range(0, len(_ids(t)), 2048))
    assert len({r.sequence_id for r in packed}) == sum(_plain_best_fit([r.length for r in packed], 2048).values())
    made = {r.doc_id: r for r in queries.QUERIES["op12_fill_in_middle"](spark, data).collect()}
    for d, t in docs:
        n, form, a, b, output = _plain_middle(d, t)
        assert (made[d].n, made[d].form, made[d].prefix_chars, made[d].middle_chars) == (n, form, a, b)
        assert made[d].output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert made[d].restored_sha256 == hashlib.sha256(t.encode()).hexdigest()
    got = queries.QUERIES["op13_spelling_variants"](spark, data).select("word", "form", "root", "n", "n_near", "form_n")
    assert _rows(got) == sorted(_plain_variants(_plain_words(docs)), key=repr)
