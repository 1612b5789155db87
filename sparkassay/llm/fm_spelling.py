"""Spelling variants of a corpus: words one edit apart, found by search schemes over FM-indexes.

Two words one edit apart agree in the first half of the one or in its second half. So each word is searched twice: its first half is matched exactly
from the word's beginning and the search extends to the right with one error; its second half is matched from the end and extends to the left.
The index of a set of words is the pair of FM-indexes of their text, a delimiter before and after every word, in both directions; a search
narrows an interval of suffix ranks symbol by symbol and ends at a delimiter, so what is left are whole words. An extension with an error takes
the symbols that stand in the interval, never the alphabet as such unless the interval is wider.

Words are dealt by their halves: a word is searched for where the words with its half are, and stored under the halves that words up to one
character longer or shorter would ask for. Halves that many words share are dealt in blocks, and searches for them visit all blocks. The number
of indexes follows the vocabulary, each holds about SYMBOLS symbols. Both halves' finds are summed, not paired: a find from the right counts
only where the one from the left cannot make it.

The vocabulary counts every run of letters of every text, gathered inside tasks before it is shuffled. Chains of forms are followed by pointer
doubling; counts grow fivefold along a chain, so their length and the rounds are known from the largest count.

Null and empty texts have no words; a null doc_id counts as an empty number. Repeated rows count as often as they stand there. Of near words with equal
counts the first in code-point order is the form. An empty table has no words. Texts are read in blocks, however long they or their words
are. Other columns of docs, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.storage import staged

LEAST_LENGTH = 6
LEAST_COUNT = 5
TIMES = 5  # a form is so many times as frequent
DELETED_OF = 199
SYMBOLS = 1_000_000  # of an index, about
PATTERNS = 8192  # searched at once
HELD = 200_000  # distinct words that a task counts before it passes them on
HELD_SYMBOLS = 16_000_000
RUNS = 100_000  # runs of a text looked at together
#: Letters of a word after A to Z are lower-cased.
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)


# ---------------------------------------------------------------- vocabulary
def _runs(text: str) -> Iterator[Counter]:
    """The runs of a lower-cased text, at most RUNS together in a long one."""
    if len(text) <= RUNS * LEAST_LENGTH:
        yield Counter(_RUN.findall(text))
        return
    runs = (m.group() for m in _RUN.finditer(text))
    while part := Counter(islice(runs, RUNS)):
        yield part


def count_words(docs: DataFrame) -> DataFrame:
    """word and n for the words of all texts, altered as the deletion draw says, that are long and frequent enough."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        symbols = 0

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            pa.default_memory_pool().release_unused()  # what earlier batches left in the worker
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py()
                if not text:
                    continue
                start = zlib.crc32(b"%s:" % (b"" if doc is None else b"%d" % doc))
                for part in _runs(text.encode().lower().decode()):  # bytes: A to Z only
                    for word, n in part.items():
                        draw = zlib.crc32(word.encode(), start)
                        if draw % DELETED_OF == 0:
                            at = draw % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < LEAST_LENGTH:
                                continue
                        if word in held:
                            held[word] += n
                        else:
                            held[word] = n
                            symbols += len(word)
                    if len(held) > HELD or symbols > HELD_SYMBOLS:
                        yield passed()
                        held, symbols = {}, 0
        if held:
            yield passed()

    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---------------------------------------------------------------- index
class FMIndex:
    """Intervals of suffix ranks over a cyclic text in which symbol 0 delimits words; no word is longer than longest."""

    def __init__(self, text: np.ndarray, longest: int, symbols: int):
        n = len(text)
        self.n, self.symbols = n, symbols
        rank, width = text.astype(np.int64), 1
        bits = max(1, int(symbols).bit_length())
        while width < longest + 2 and 2 * width * bits <= 60:  # several symbols as one number
            rank = (rank << (width * bits)) | np.roll(rank, -width)
            width *= 2
        order = np.argsort(rank, kind="stable")
        while True:
            found = rank[order]
            named = np.concatenate(([0], np.cumsum(found[1:] != found[:-1])))
            rank = np.empty(n, np.int64)
            rank[order] = named
            if width >= longest + 2 or named[-1] == n - 1:
                break
            rank = rank * n + np.roll(rank, -width)
            width *= 2
            order = np.argsort(rank, kind="stable")
        self.places = order  # where the suffix of a rank begins
        self.before = text[order - 1].astype(np.int64)  # the symbol in front of it
        by_symbol = np.argsort(self.before, kind="stable")
        self._keys = self.before[by_symbol] * n + by_symbol

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals with a symbol put in front."""
        at = symbol * self.n
        return np.searchsorted(self._keys, at + low), np.searchsorted(self._keys, at + high)


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every rank of all intervals, and which interval it is of."""
    sizes = high - low
    owner = np.repeat(np.arange(len(low)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[owner], owner


def search(index: FMIndex, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (pattern, place of the delimiter before a word) of patterns and the indexed words one edit away beyond the patterns' halves.

    Pattern p is text[starts[p] :][: lengths[p]]; its first halves[p] symbols match exactly. The index's words are read from their last
    symbol, so that a symbol put in front of a suffix is the word's next one.
    """
    who = np.arange(len(starts))
    low, high = index.extend(np.zeros(len(who), np.int64), np.zeros(len(who), np.int64), np.full(len(who), index.n))
    for i in range(int(halves.max(initial=0))):
        on = np.flatnonzero(halves[who] > i)
        low[on], high[on] = index.extend(text[starts[who[on]] + i], low[on], high[on])
        if not (alive := high > low).all():
            who, low, high = who[alive], low[alive], high[alive]
    exact = (who, halves[who], low, high)
    pool = tuple(np.zeros(0, np.int64) for _ in range(4))  # one error made: pattern, symbols matched, interval
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(exact[0]) or len(pool[0]):
        states = [pool, *_with_error(index, text, starts, lengths, *exact)]
        exact = _matched(index, text, starts, lengths, *exact)
        who, i, low, high = (np.concatenate(parts) for parts in zip(*states, strict=True))
        ended = i == lengths[who]
        zero = np.zeros(int(ended.sum()), np.int64)
        a, b = index.extend(zero, low[ended], high[ended])
        ranks, owner = _spread(a, b)
        found.append((who[ended][owner], index.places[ranks]))
        pool = _matched(index, text, starts, lengths, *(x[~ended] for x in (who, i, low, high)))
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True)) if found else (who, who)


def _matched(index, text, starts, lengths, who, i, low, high):
    """The states after one more symbol of their patterns; those that end are left out."""
    on = i < lengths[who]
    who, i = who[on], i[on]
    low, high = index.extend(text[starts[who] + i], low[on], high[on])
    alive = high > low
    return who[alive], i[alive] + 1, low[alive], high[alive]


def _with_error(index, text, starts, lengths, who, i, low, high):
    """The states after one edit here. Edits that give the same word inside a run of one symbol are made at its end only."""
    inside = i < lengths[who]
    symbol = np.where(inside, text[np.minimum(starts[who] + i, len(text) - 1)], 0)
    after = np.where(i + 1 < lengths[who], text[np.minimum(starts[who] + i + 1, len(text) - 1)], 0)
    drop = inside & (symbol != after)
    yield who[drop], i[drop] + 1, low[drop], high[drop]
    wide = high - low > index.symbols
    ranks, owner = _spread(low[~wide], high[~wide])
    owner = np.flatnonzero(~wide)[owner]
    other = np.unique(owner * (index.symbols + 1) + index.before[ranks])
    all_of = np.flatnonzero(wide)
    other = np.concatenate((other, (all_of[:, None] * (index.symbols + 1) + np.arange(1, index.symbols + 1)).ravel()))
    owner, other = other // (index.symbols + 1), other % (index.symbols + 1)
    put = (other != 0) & (other != symbol[owner])
    owner, other = owner[put], other[put]
    a, b = index.extend(other, low[owner], high[owner])
    alive = b > a
    owner, a, b = owner[alive], a[alive], b[alive]
    yield who[owner], i[owner], a, b  # the indexed word has one symbol more
    changed = inside[owner]
    yield who[owner][changed], i[owner][changed] + 1, a[changed], b[changed]


# ---------------------------------------------------------------- near words
def _codes(strings: list[str]) -> np.ndarray:
    """Code points, a zero before every string and one at the end."""
    return np.frombuffer(("\0" + "\0".join(strings) + "\0").encode("utf-32-le"), "<u4").astype(np.int64)


def near_in(entries: pa.Table) -> pa.Table:
    """For each searched word of one index: near words among the stored ones, and the best of them."""
    words, sides, symbols = entries["word"].to_pylist(), entries["side"].to_numpy(), entries["symbols"].to_pylist()
    counts, units, query = entries["n"].to_numpy(), entries["unit"].to_numpy(), entries["query"].to_numpy(zero_copy_only=False)
    found_p, found_q = [], []
    for side in (0, 1):
        stored, asked = np.flatnonzero((sides == side) & ~query), np.flatnonzero((sides == side) & query)
        if not len(stored) or not len(asked):
            continue
        stored_codes, asked_codes = _codes([symbols[e] for e in stored]), _codes([symbols[e] for e in asked])
        letters, text = np.unique(np.concatenate((stored_codes, asked_codes)), return_inverse=True)
        # Without the last delimiter the stored text is cyclic; read backwards.
        own, asked_text = text[: len(stored_codes) - 1][::-1], text[len(stored_codes) :].astype(np.int64)
        longest = max(len(symbols[e]) for e in stored)
        index = FMIndex(np.roll(own, 1), longest, len(letters) - 1)
        # The delimiter at a place is followed, in reading order of the text, by the word stored just there.
        ordinal = len(stored) - np.cumsum(np.roll(own, 1) == 0)
        lengths = np.array([len(symbols[e]) for e in asked])
        starts = np.cumsum(lengths + 1) - lengths
        halves = lengths // 2 if side == 0 else lengths - lengths // 2
        for at in range(0, len(asked), PATTERNS):
            part = slice(at, at + PATTERNS)
            p, place = search(index, asked_text, starts[part], lengths[part], halves[part])
            p, q = asked[p + at], stored[ordinal[place]]
            same = units[p] == units[q]
            p, q = p[same], q[same]
            if side == 1:  # the other side finds words that share the first half
                apart = np.fromiter((words[b][: (h := len(words[a]) // 2)] != words[a][:h] for a, b in zip(p, q, strict=True)), bool, len(p))
                p, q = p[apart], q[apart]
            found_p.append(p)
            found_q.append(q)
    asked = np.flatnonzero(query)
    near, best = np.zeros(len(words), np.int64), np.full(len(words), -1)
    if found_p:
        p, q = np.concatenate(found_p), np.concatenate(found_q)
        near = np.bincount(p, minlength=len(words))
        alphabetic = np.empty(len(words), np.int64)
        alphabetic[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((alphabetic[q], -counts[q], p))
        p, q = p[order], q[order]
        first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1]))) if len(p) else p
        best[p[first]] = q[first]
    form = [words[b] if b >= 0 else None for b in best[asked].tolist()]
    return pa.table({"word": pa.array([words[e] for e in asked], pa.string()), "n": pa.array(counts[asked]),
                     "n_near": pa.array(near[asked]), "form": pa.array(form, pa.string()),
                     "form_n": pa.array([int(counts[b]) if b >= 0 else None for b in best[asked].tolist()], pa.int64())})


def near_words(vocabulary: DataFrame, symbols_each: int = SYMBOLS) -> DataFrame:
    """word, n, n_near and, of the most frequent near word, form and form_n, for a written vocabulary (word, n)."""
    spark = vocabulary.sparkSession
    length = F.length("word")

    def halves(side: int, of: Column) -> Column:
        return (of / 2).cast("int") if side == 0 else (of - (of / 2).cast("int")).cast("int")

    def rows(side: int) -> DataFrame:
        read = F.col("word") if side == 0 else F.reverse("word")
        sizes = F.array_distinct(F.transform(F.sequence(F.greatest(length - 1, F.lit(LEAST_LENGTH)), length + 1), lambda x: halves(side, x)))
        stored = F.transform(sizes, lambda h: F.struct(h.alias("half"), F.lit(False).alias("query")))
        entry = F.concat(stored, F.array(F.struct(halves(side, length).alias("half"), F.lit(True).alias("query"))))
        each = vocabulary.select(F.lit(side).alias("side"), "word", read.alias("symbols"), "n", F.explode(entry).alias("e"))
        return each.select("side", "word", "symbols", "n", "e.query",
                           F.xxhash64(F.lit(side), F.expr("left(symbols, e.half)")).alias("unit"))

    entries = rows(0).unionByName(rows(1))
    stored = entries.where(~F.col("query")).groupBy("unit").agg(F.sum(F.length("word") + 1).alias("symbols"))
    total = stored.agg(F.sum("symbols")).first()[0] or 0
    # At most total / symbols_each units, one for each index: as many numbers as there are indexes.
    hot = stored.where(F.col("symbols") > symbols_each).select("unit", F.ceil(F.col("symbols") / symbols_each).cast("int").alias("blocks"))
    indexes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / symbols_each))
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.array(F.pmod(F.xxhash64("word"), blocks).cast("int"))
    dealt = entries.join(F.broadcast(hot), "unit", "left").withColumn(
        "block", F.explode(F.when(F.col("query"), F.sequence(F.lit(0), blocks - 1)).otherwise(own)))
    dealt = dealt.withColumn("index", F.pmod(F.xxhash64("unit", "block"), F.lit(indexes)))
    # A half of several blocks may have two in one index; there, the search asks once.
    asked = dealt.select("index", "side", "word", "symbols", "n", "query", "unit")
    found = asked.groupBy("index").applyInArrow(_once(near_in), "word string, n bigint, n_near bigint, form string, form_n bigint")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("w"))))
    merged = found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return merged.select("word", "n", "n_near", F.col("best.w").alias("form"), (-F.col("best.m")).alias("form_n"))


def _once(find):
    """Each entry of an index once."""
    def call(entries: pa.Table) -> pa.Table:
        seen = entries.group_by(["side", "word", "unit", "query"]).aggregate([("symbols", "min"), ("n", "min")])
        return find(seen.rename_columns({"symbols_min": "symbols", "n_min": "n"}))

    return call


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n for every word of docs (doc_id, text)."""
    vocabulary = staged(count_words(docs), "vocabulary")
    counted = Column.__ge__(F.col("form_n"), TIMES * F.col("n"))
    near = staged(near_words(vocabulary).select(
        "word", "n", "n_near", F.when(counted, F.col("form")).alias("form"), F.when(counted, F.col("form_n")).alias("form_n")), "near-words")
    links = near.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    most = near.agg(F.max("form_n")).first()[0] or 0
    longest = max(1, math.floor(math.log(max(most, 1) / LEAST_COUNT, TIMES) + 1e-9))  # links of a chain
    for _ in range(math.ceil(math.log2(longest))):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        links = staged(links.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")
    return near.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
