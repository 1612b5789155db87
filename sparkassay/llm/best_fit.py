"""Best-fit decreasing packing of token pieces, by a segment tree over remaining capacities.

A document's ids, with the end id, are one piece; only documents longer than a sequence are cut, into full sequences and a rest.
Best fit places pieces from the longest to the shortest, each into the open sequence with the least sufficient room. Pieces of one length are
alike, and a sequence that has just been used stays the tightest one as long as it has room for another; so all pieces of a length are placed by
a walk over capacities, and what the driver needs is a count for each length: at most as many numbers as a sequence has tokens, whatever the
corpus holds. Its plan tells for ranges of pieces of a length which sequences they go to; every piece then finds its place by its rank among
the pieces of its length. The number of sequences is that of a walk over single pieces.

Ranks come from the tasks that tokenize: a task numbers its pieces of each length, and a running sum over tasks gives the rest. No piece meets
another in a task.

Null and empty texts are one piece with the end id alone. Rows with equal or null doc_id are documents of their own, repeated rows too. An empty
table gives no pieces. Texts are tokenized whole, in blocks cut at white space. Other columns of docs, whatever their names, are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from string import ascii_letters

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkassay.llm.storage import staged

SIZE = 2048
END = 0
BLOCK = 1 << 18  # characters that are cut into chunks at once
MEMO = 500_000  # chunks of a generation; a worker remembers two, the older one as far as it was not asked for again
LONG = 64  # characters; longer chunks are not remembered
ROWS = 4096  # pieces of an output batch, and fewer where their ids take
BYTES = 8 << 20
CLOSING = ",.;:!?"
_MARK = "\x00"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("shard", pa.int32()), ("nth", pa.int64()), ("ids", pa.binary())])
_PIECE_TYPES = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, shard int, nth bigint, ids binary")


# ---------------------------------------------------------------- tokens
class WordTokenizer:
    """A tokenizer whose matches never hold white space, behind a memo of what stands between blanks.

    Unknown chunks go to the library as one text with a mark between them; the mark is a match of its own. Words of ASCII letters
    are one match, so they go straight to its model, if that gives the ids of whole texts (looked at once).
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work; one thread a task
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._memo: dict[str, bytes] = {"": b""}
        self._older: dict[str, bytes] = {}
        self._model = self._library.model
        self._lower = self._library.normalizer is not None and self._library.normalizer.normalize_str("A") == "a"
        self._straight = not any(t.content.isalpha() for t in self._library.get_added_tokens_decoder().values()) and all(
            self._word(w) == self._ids(w).tobytes() for w in (*ascii_letters, ascii_letters, "It", "straightforwardness", "XyzzY"))
        self._mark = self._ids(_MARK)
        self._signs = {c: self._ids(c).tobytes() for c in CLOSING}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _word(self, word: str) -> bytes:
        ids = [t.id for t in self._model.tokenize(word.lower() if self._lower else word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _recall(self, chunks: set[str]) -> set[str]:
        """Takes over what the older generation knows; the others."""
        if not self._older:
            return chunks
        known = chunks & self._older.keys()
        self._memo.update((c, self._older[c]) for c in known)
        return chunks - known

    def _learn(self, unknown: set[str]) -> dict[str, bytes]:
        """The ids of chunks; those too long to remember are in the answer only."""
        unknown = self._recall(unknown)
        memo, once = self._memo, {}
        closed = [c for c in unknown if c[-1] in CLOSING and c[:-1].isalpha()]  # a word, then a match of one sign
        plain = self._recall(unknown.difference(closed).union(c[:-1] for c in closed).difference(memo))
        alone = [c for c in plain if _MARK in c or len(c) > LONG] if len(self._mark) == 1 else list(plain)
        once.update((c, self._ids(c).tobytes()) for c in alone)
        words = [c for c in plain if len(c) <= LONG and c.isascii() and c.isalpha()] if self._straight else []
        memo.update((c, self._word(c)) for c in words)
        if together := list(plain.difference(alone, words)):
            ids = self._ids(f" {_MARK} ".join(together))
            data, ends = ids.tobytes(), (np.flatnonzero(ids == self._mark[0]) * 4).tolist()
            memo.update(zip(together, (data[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(data)], strict=True)),
                            strict=True))
        for c in closed:
            word = memo.get(c[:-1])
            (once if word is None else memo)[c] = (once[c[:-1]] if word is None else word) + self._signs[c[-1]]
        return once

    def packed(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if len(text) <= BLOCK:
            return self._block(text)
        parts, at = [], 0
        while at < len(text):
            stop = at + BLOCK
            if stop < len(text):
                cut = max(text.rfind(" ", at, stop), text.rfind("\n", at, stop))
                if cut < at:  # one chunk fills the block
                    cut = min((x for x in (text.find(" ", stop), text.find("\n", stop)) if x >= 0), default=len(text))
                stop = cut + 1
            parts.append(self._block(text[at:stop]))
            at = stop
        return b"".join(parts)

    def _block(self, text: str) -> bytes:
        chunks = text.replace("\n", " ").split(" ")
        found = list(map(self._memo.get, chunks))
        if None in found:
            if len(self._memo) > MEMO:
                self._older, self._memo = self._memo, {"": b""}
                found = list(map(self._memo.get, chunks))
            once = self._learn({c for c, f in zip(chunks, found, strict=True) if f is None})
            known = self._memo
            found = [known[c] if f is None and c in known else once[c] if f is None else f
                     for c, f in zip(chunks, found, strict=True)]
        return b"".join(found)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process and vocabulary, kept between batches."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """All pieces with their ids (little-endian unsigned 16-bit integers where they all fit, else 32-bit), written once.

    shard is the task that made a piece, nth its number there among the pieces of its length.
    """
    last = end.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, counts = tokenizer(path), TaskContext.get().partitionId(), [0] * (size + 1)
        columns: list[list] = [[] for _ in _PIECES]
        room = BYTES

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)

        for texts in batches:
            pa.default_memory_pool().release_unused()  # what earlier batches left in the worker
            for doc, text in zip(texts.column(0).to_pylist(), texts.column(1), strict=True):
                packed = own.packed(text.as_py() or "") + last
                for piece, at in enumerate(range(0, len(packed), 4 * size)):
                    ids = packed[at : at + 4 * size]
                    n = len(ids) // 4
                    row = (doc, piece, at // 4, n, zlib.crc32(ids), shard, counts[n], _narrow(ids))
                    counts[n] += 1
                    room -= len(row[-1])
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    if room < 0 or len(columns[0]) >= ROWS:
                        yield batch()
                        columns, room = [[] for _ in _PIECES], BYTES
        if columns[0]:
            yield batch()

    return staged(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(cut, _PIECE_TYPES), "pieces")


def _narrow(ids: bytes) -> bytes:
    """Two bytes an id with a zero byte in front, or four with a one, for ids beyond 65535."""
    wide = np.frombuffer(ids, "<u4")
    return b"\x00" + wide.astype("<u2").tobytes() if not (wide >> 16).any() else b"\x01" + ids


def wide(ids: bytes) -> np.ndarray:
    """The ids of a stored piece."""
    return np.frombuffer(ids, "<u4" if ids[:1] == b"\x01" else "<u2", offset=1).astype("<u4")


# ---------------------------------------------------------------- packing
class Capacities:
    """Open sequences by remaining capacity: a segment tree whose nodes tell whether any capacity below them is in use."""

    def __init__(self, size: int):
        self._width = 1 << size.bit_length()
        self._used = bytearray(2 * self._width)
        self._open: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # first sequence and how many

    def put(self, room: int, first: int, count: int) -> None:
        self._open[room].append((first, count))
        node = room + self._width
        while node and not self._used[node]:
            self._used[node] = 1
            node //= 2

    def take(self, least: int) -> tuple[int, int, int] | None:
        """The tightest capacity of at least least, with sequences that have it; they are no longer open."""
        node = least + self._width
        while not self._used[node]:
            while node & 1:  # a right child: what is greater stands further up
                node //= 2
            if node == 0:
                return None
            node += 1
        while node < self._width:
            node = 2 * node if self._used[2 * node] else 2 * node + 1
        room = node - self._width
        first, count = self._open[room].pop()
        if not self._open[room]:
            while node and not (node < self._width and (self._used[2 * node] or self._used[2 * node + 1])):
                self._used[node] = 0
                node //= 2
        return room, first, count


def plan(counts: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Best-fit decreasing for counts of pieces by length.

    Rows (at, sequence, each, offset, length): pieces from position at on, in the order of falling length and then of rank, go to
    sequences from that number on, each of them side by side from that offset. A length meets a group of like sequences at most once and every
    length splits at most one group, so the rows are bounded by the lengths alone.
    """
    open_, rows, at, fresh = Capacities(size), [], 0, 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            found = open_.take(length)
            room, first, count = found or (size, fresh, -(-left // (size // length)))
            each = room // length
            full = min(count, left // each)
            rest = left - full * each if full < count else 0  # fewer than each
            for sequence, n, pieces_each in ((first, full, each), (first + full, min(rest, 1), rest)):
                if n:
                    rows.append((at, sequence, pieces_each, size - room, length))
                    open_.put(room - pieces_each * length, sequence, n)
                    at, left = at + n * pieces_each, left - n * pieces_each
            used = full + min(rest, 1)
            if found is None:
                fresh += used
            elif used < count:
                open_.put(room, first + used, count - used)
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """Every piece of docs (doc_id, text) with its ids, sequence_id and offset there."""
    rows = pieces(docs, path, size, end)
    shards = rows.groupBy("shard", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = shards.select("shard", "length", (F.coalesce(F.sum("n").over(
        W.partitionBy("length").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("earlier"))
    counts = {r["length"]: r["n"] for r in shards.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    places = plan(counts, size)
    base, total = np.zeros(size + 1, np.int64), 0
    for length in sorted(counts, reverse=True):
        base[length], total = total, total + counts[length]

    def find(length: pa.Array, rank: pa.Array) -> pa.Array:
        position = base[length.to_numpy()] + rank.to_numpy()
        row = places[np.searchsorted(places[:, 0], position, "right") - 1]
        nth = position - row[:, 0]
        return pa.StructArray.from_arrays([pa.array(row[:, 1] + nth // row[:, 2]), pa.array(row[:, 3] + nth % row[:, 2] * row[:, 4])],
                                          ["sequence_id", "offset"])

    place = F.arrow_udf(find, "sequence_id bigint, offset bigint")("length", F.col("nth") + F.col("earlier"))
    return rows.join(earlier, ["shard", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "ids", place.alias("place")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "place.*", "ids")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids (array<int>): the pieces of each sequence one after the other."""
    def joined(parts: pa.Array) -> pa.Array:
        return pa.array([np.concatenate([wide(x["ids"]) for x in p]).astype(np.int32) for p in parts.to_pylist()], pa.list_(pa.int32()))

    ordered = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return ordered.select("sequence_id", F.arrow_udf(joined, "array<int>")("parts").alias("ids"))
