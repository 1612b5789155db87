"""Benchmark decontamination: CGK embedding and bit-sampling LSH over item-sized windows, then exact edit distance.

Words are runs of digits, ASCII letters (folded) and characters beyond ASCII. A document holds an item of n words if some
stretch of it can be turned into the item by at most `max_edits(n)` insertions, deletions and replacements of words.

Windows: any such stretch shares at least n - 2 - 3 k three-word runs with the item (k edits spoil three each), on diagonals that lie
within k of each other. So only windows on diagonals with two shared runs nearby need be looked at (one, if n is too
small to promise two); this loses nothing. A window has as many words as the item, with k more on both sides for the verification.
LSH: the CGK walk copies a window to 3n places, moving on by a random bit that depends on place and word; k edits become
few Hamming differences. Each repetition samples SAMPLES places as a key, and windows meet the items of equal key in a Spark join. Each item
length has its own number of repetitions: it is doubled until the windows of all TRIALS texts that hold an item of that length with k random edits
meet it (by chance in less than 5 % of cases, were the probability below TARGET). Where MOST_REPETITIONS miss one, and beyond
LONGEST_TRIED words, all windows of the length meet all items of it. Every pair that meets is verified exactly.

Items are dealt in blocks of BLOCK_WORDS, each one pass over the documents, so what is sent to tasks is bounded
and any number of items is covered. Items and documents without words (null, empty) never match. Items shorter than three words
must occur as they are. Items may share an item_id or have none: each row is looked for by itself. Repeated rows and ties in doc_id: one row per (doc_id, item_id), with the fewest edits, then the first place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkassay.llm.lsh_forest import among
from sparkassay.llm.storage import free_name, staged, text_name
from sparkassay.llm.words import LETTERS, LOWER, grams, hashed, mix, whole

GRAM = 3
EDITS = 10  # per cent of an item's words
SAMPLES = 4
TARGET = 0.99
TRIALS = 300  # TARGET ** TRIALS < 0.05
LONGEST_TRIED = 1000
LEAST_REPETITIONS = 8
MOST_REPETITIONS = 256
BLOCK_WORDS = 500_000
SEED = 11
_PAD = np.uint64(0)


def max_edits(n: int) -> int:
    """At most EDITS per cent, at least one from ten words on, and few enough that a three-word run stays."""
    return min(max(n * EDITS // 100, int(n >= 10)), max(0, (n - GRAM) // (GRAM + 1)))


def _item_words(text: str | None) -> np.ndarray:
    return np.concatenate([w.hashes for w in hashed(pa.array([text], pa.string()), LOWER, LETTERS)] or [np.zeros(0, np.uint64)])


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(item_id, word hashes), in blocks of bounded size."""
    block, size = [], 0
    for row in items.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        words = _item_words(row["text"])
        if len(words):
            block.append((row["item_id"], words))
            size += len(words)
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def keys(windows: np.ndarray, repetitions: int, first: int = 0) -> np.ndarray:
    """The sampled keys of windows of equal length: one row each, one column per repetition from the first on."""
    count, n = windows.shape
    rng = np.random.default_rng([SEED, n])
    steps = 3 * n
    seeds = rng.integers(0, 1 << 63, (steps, MOST_REPETITIONS)).astype(np.uint64)[:, first:repetitions]
    sampled = np.zeros((steps, MOST_REPETITIONS), bool)
    for r in range(MOST_REPETITIONS):
        sampled[rng.choice(steps, min(SAMPLES, steps), replace=False), r] = True
    sampled = sampled[:, first:repetitions]
    padded = np.hstack([windows, np.full((count, 1), _PAD)])
    at = np.zeros((count, repetitions - first), np.int64)
    out = np.tile(np.arange(first, repetitions, dtype=np.uint64) * np.uint64(1000003) + np.uint64(n), (count, 1))
    line = np.arange(count)[:, None]
    for j in range(int(np.flatnonzero(sampled.any(axis=1))[-1]) + 1):
        word = padded[line, np.minimum(at, n)]
        columns = sampled[j]
        if columns.any():
            out[:, columns] = mix(out[:, columns] ^ word[:, columns])
        at += ((word ^ seeds[j]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(63)).astype(np.int64)
    return mix(out)


def _edited(words: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    out = words.tolist()
    for _ in range(k):
        kind, at = rng.integers(3), int(rng.integers(len(out)))
        if kind == 0:
            out[at] = int(rng.integers(1 << 62))
        elif kind == 1:
            out.insert(at, int(rng.integers(1 << 62)))
        elif len(out) > 1:
            del out[at]
    return np.array(out, np.uint64)


def _trial(item: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The windows that windows_of makes, for this item, of a text that holds it with the most edits allowed."""
    n = len(item)
    around = rng.integers(1 << 62, size=2 * n).astype(np.uint64)
    text = np.concatenate([around[:n], _edited(item, max_edits(n), rng), around[n:]])
    size = min(GRAM, n)
    at, offset = np.nonzero(grams(text, size)[:, None] == grams(item, size)[None, :])
    starts, times = np.unique(at - offset, return_counts=True)
    starts = starts[_seeded(np.stack([np.zeros_like(starts), np.full_like(starts, n), starts], 1), times)]
    padded = np.concatenate([np.zeros(n, np.uint64), text, np.zeros(n, np.uint64)])
    return np.stack([padded[n + s : 2 * n + s] for s in starts])


def needed(items: list[np.ndarray]) -> int:
    """Repetitions that find all trials with these items of equal length; 0 if MOST_REPETITIONS do not."""
    n = len(items[0])
    if not max_edits(n):
        return LEAST_REPETITIONS  # equal windows have equal keys
    if n > LONGEST_TRIED:
        return 0
    rng = np.random.default_rng([SEED, n])
    left = [(i % len(items), _trial(items[i % len(items)], rng)) for i in range(TRIALS)]
    first, r = 0, LEAST_REPETITIONS
    while r <= MOST_REPETITIONS:
        known, missed = keys(np.stack(items), r, first), []
        for at in range(0, len(left), max(1, 50_000 // (n * (r - first)))):  # bounded memory
            part = left[at : at + max(1, 50_000 // (n * (r - first)))]
            own = keys(np.concatenate([w for _, w in part]), r, first)
            same = (own == np.repeat(known[[i for i, _ in part]], [len(w) for _, w in part], axis=0)).any(axis=1)
            met = np.logical_or.reduceat(same, np.cumsum([0] + [len(w) for _, w in part[:-1]]))
            missed += [trial for trial, found in zip(part, met, strict=True) if not found]
        if not missed:
            return r
        left, first, r = missed, r, r * 2
    return 0


def repetitions(spark: SparkSession, block: list[tuple[int, np.ndarray]]) -> dict[int, int]:
    """For each length of the items the repetitions that it needs (0: all windows are to be verified). Lengths are tried in tasks."""
    lengths: dict[int, list[bytes]] = {}
    for _, words in block:
        lengths.setdefault(len(words), []).append(words.tobytes())

    def compute(items: pa.Array) -> pa.Array:
        return pa.array([needed([np.frombuffer(i, np.uint64) for i in own]) for own in items.to_pylist()], pa.int32())

    table = spark.createDataFrame([(n, [bytearray(i) for i in own[:TRIALS]]) for n, own in lengths.items()], "n int, items array<binary>")
    return {row["n"]: row["r"] for row in table.select("n", F.arrow_udf(compute, "int")("items").alias("r")).collect()}


def item_keys(words: np.ndarray, count: int) -> list[int]:
    return keys(words[None, :], count)[0].view(np.int64).tolist() if count else [0]


def windows_of(text: Column, block: list[tuple[int, np.ndarray]]) -> Column:
    """Windows that may hold an item: array of (start, n, words), words with the margin, as 64-bit hashes."""
    gram_parts, length_parts, offset_parts = [], [], []
    for _, words in block:
        size = min(GRAM, len(words))
        own = grams(words, size) ^ np.uint64(size)
        gram_parts.append(own)
        length_parts.append(np.full(len(own), len(words)))
        offset_parts.append(np.arange(len(own)))
    entries = np.unique(np.stack([np.concatenate(gram_parts).view(np.int64), np.concatenate(length_parts), np.concatenate(offset_parts)], 1), axis=0)
    known = entries[:, 0].view(np.uint64) if len(entries) else np.zeros(0, np.uint64)
    order = np.argsort(known, kind="stable")
    known, lengths, offsets = known[order], entries[order, 1], entries[order, 2]
    sizes = sorted({min(GRAM, len(w)) for _, w in block})
    bits = np.zeros(1 << 22, bool)
    bits[(known >> np.uint64(42)).astype(np.int64)] = True

    def compute(texts: pa.Array) -> pa.Array:
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        for words in hashed(texts, LOWER, LETTERS):
            starts, found = [], []
            for size in sizes:
                at = whole(words.bounds, size)
                if not len(at):
                    continue
                own = grams(words.hashes, size)[at] ^ np.uint64(size)
                maybe = np.flatnonzero(bits[(own >> np.uint64(42)).astype(np.int64)])
                low = np.searchsorted(known, own[maybe], "left")
                high = np.searchsorted(known, own[maybe], "right")
                times = high - low
                starts.append(np.repeat(at[maybe], times))
                first = np.repeat(low - np.concatenate(([0], np.cumsum(times)[:-1])), times)
                found.append(np.arange(int(times.sum())) + first)
            if not starts or not sum(map(len, starts)):
                continue
            at, entry = np.concatenate(starts), np.concatenate(found)
            text_of = np.searchsorted(words.bounds, at, "right") - 1
            hits = np.stack([text_of, lengths[entry], at - offsets[entry] - words.bounds[text_of]], 1)
            hits, times = np.unique(hits, axis=0, return_counts=True)
            for i, n, start in hits[_seeded(hits, times)].tolist():
                k = max_edits(n)
                begin, end = words.bounds[i], words.bounds[i + 1]
                a, b = begin + start - k, begin + start + n + k
                own = words.hashes[max(begin, a) : min(end, b)]
                padded = np.concatenate([np.zeros(max(0, begin - a), np.uint64), own, np.zeros(max(0, b - end), np.uint64)])
                out[words.first + i].append({"start": start, "n": n, "words": padded.tobytes()})
        return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int32()), ("words", pa.binary())])))

    return F.arrow_udf(compute, "array<struct<start:bigint,n:int,words:binary>>")(text)


def _near(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (text, n, start), sorted: the range of rows of the same text and n with starts at most k apart."""
    group = hits[:, 0] * (1 << 20) + hits[:, 1]
    ids = np.cumsum(np.concatenate(([0], (np.diff(group) != 0).astype(np.int64))))
    span = 1 << 40
    place = ids * span + hits[:, 2] + (1 << 32)
    k = np.array([max_edits(int(n)) for n in hits[:, 1]])
    return np.searchsorted(place, place - k, "left"), np.searchsorted(place, place + k, "right")


def _seeded(hits: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Which windows (text, n, start), sorted, have enough shared runs nearby; times: shared runs on each one's own diagonal."""
    total = np.concatenate(([0], np.cumsum(times)))
    left, right = _near(hits)
    n = hits[:, 1]
    k = np.array([max_edits(int(size)) for size in n], np.int64)
    return (total[right] - total[left] >= np.minimum(2, n - GRAM + 1 - GRAM * k)) | (n <= GRAM)


def window_keys(words: Column, n: Column, counts: dict[int, int]) -> Column:
    """The keys of each window (its margin left out); counts: repetitions of each length, 0 for one key that all share."""
    def compute(words: pa.Array, lengths: pa.Array) -> pa.Array:
        sizes = np.asarray(lengths)
        out: list = [None] * len(words)
        for n in np.unique(sizes):
            rows, k, count = np.flatnonzero(sizes == n), max_edits(int(n)), counts[int(n)]
            if not count:
                for i in rows:
                    out[i] = [0]
                continue
            windows = np.stack([np.frombuffer(words[int(i)].as_py(), np.uint64)[k : k + n] for i in rows])
            for i, row in zip(rows, keys(windows, count).view(np.int64), strict=True):
                out[i] = row
        return pa.array(out, pa.list_(pa.int64()))

    return F.arrow_udf(compute, "array<bigint>")(words, n)


def fewest_edits(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Edits between the item and the stretch of text nearest to it, and that stretch's end."""
    row = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for i, word in enumerate(item, 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(best - steps) + steps  # deletions from the text, left to right
    end = int(row.argmin())
    return int(row[end]), end


def _edits(words: Column, item: Column) -> Column:
    def compute(words: pa.Array, items: pa.Array) -> pa.Array:
        return pa.array([fewest_edits(np.frombuffer(i.as_py(), np.uint64), np.frombuffer(w.as_py(), np.uint64))[0]
                         for w, i in zip(words, items, strict=True)], pa.int32())

    return F.arrow_udf(compute, "int")(words, item)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, node, item_id, edits, start) for each place where a document holds an item; node is a hash of the text, start counts words."""
    spark = docs.sparkSession
    parts = []
    for block in item_blocks(items):
        counts = repetitions(spark, block)
        table = [(row, item, bytearray(words.tobytes()), len(words), max_edits(len(words)), item_keys(words, counts[len(words)]))
                 for row, (item, words) in enumerate(block)]
        known = spark.createDataFrame(table, "row int, item_id bigint, item binary, n int, most int, item_keys array<bigint>")
        entries = known.select("row", "n", F.explode("item_keys").alias("key"))
        windows = docs.select("doc_id", text_name(F.col("text")).alias("node"), F.explode(windows_of(F.col("text"), block)).alias("w"))
        windows = windows.select("doc_id", "node", "w.start", "w.n", "w.words")
        keyed = windows.withColumn("key", F.explode(window_keys(F.col("words"), F.col("n"), counts)))
        # A block has at most BLOCK_WORDS words, and an item's repetitions grow slower than its words: keys (20 bytes each) and words
        # (8 bytes each) may be sent to every task. The words go once an item, after the keys have met.
        # Rows of items have own numbers: other texts under the same item_id, or none, are verified each.
        met = keyed.join(F.broadcast(entries), ["n", "key"])
        met = met.dropDuplicates(["doc_id", "node", "start", "n", "row"]).join(F.broadcast(known.select("row", "item_id", "item", "most")), "row")
        parts.append(met.withColumn("edits", _edits(F.col("words"), F.col("item"))).where("edits <= most")
                     .select("doc_id", "node", "item_id", "edits", "start"))
    if not parts:
        return spark.createDataFrame([], "doc_id bigint, node binary, item_id bigint, edits int, start bigint")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, edits and start (in words)."""
    best = leaks(docs, items).groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "start")).alias("best"))
    return best.select("doc_id", "item_id", "best.edits", "best.start")


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, all columns as they were."""
    gone = staged(leaks(docs, items).select(F.col("node").alias("key")).distinct(), "leaks")
    name, gone_node = free_name(docs, "node"), free_name(docs, "gone_node")
    named = docs.withColumn(name, text_name(F.col("text")))
    maybe = among(gone, F.col(name), "leak-bits")  # spares the others the join
    left = named.where(maybe).join(gone.select(F.col("key").alias(gone_node)), F.col(name) == F.col(gone_node), "left_anti")
    return named.where(~maybe).union(left).drop(name)
