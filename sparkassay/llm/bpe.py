"""Byte-level BPE as a tree reduction over a monoid of encodings.

A text's encoding is the join of its halves' encodings. Two kinds of joins occur:
* Between a character that is not white space and one that is, every match of the split pattern ends, so
  the encodings of both sides are simply put together.
* Inside one match, the last tokens on the left and the first on the right are encoded anew as one window. A sequence of
  tokens is the encoding of its bytes exactly if each neighbouring pair is the encoding of its own bytes; so once the
  window's outer tokens fit the tokens next to them, nothing further out can change. Otherwise the window doubles.

Decoding puts the tokens' bytes together. Null and empty texts have no tokens. Each text is encoded inside one row, in
blocks of bounded size; equal rows give equal results and only the text is looked at.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 16  # characters that are split into matches at once
MEMO = 150_000  # entries of each memo of a worker; a full one starts anew
LEAF = 5  # bytes that are merged directly
SHORT = 6  # bytes whose encoding is remembered; whole words are remembered as chunks
#: The characters that the pattern's white space class matches.
_SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_CUT = regex.compile(r"(?<=\S)(?=\s)")
_BEFORE_SPACE = tuple(c + " " for c in _SPACES)
_ASCII_BEFORE_SPACE = tuple(c + " " for c in "\t\n\x0b\f\r ")


def chunks(text: str) -> list[str] | None:
    """The text cut before every blank, the blanks left out; None if some blank follows white space.

    Each such cut is the end of a match, so chunk by chunk (the blank in front of all but the first)
    gives the encoding of the whole.
    """
    if any(x in text for x in (_ASCII_BEFORE_SPACE if text.isascii() else _BEFORE_SPACE)):
        return None
    return text.split(" ")


def halves(text: str) -> tuple[str, str] | None:
    """The text cut at an end of a match: the first after its middle, else the last before it."""
    middle = len(text) // 2
    found = _CUT.search(text, middle)
    if found is None:
        for found in _CUT.finditer(text, 0, middle):
            pass
    return (text[: found.start()], text[found.start() :]) if found else None


class Encoder:
    """Ranks of a vocabulary file with what this worker has found out so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        self.pattern = regex.compile(pattern)
        self._windows: dict[tuple[int, int], tuple[int, ...]] = {}
        self._short: dict[bytes, tuple[int, ...]] = {}
        self._packed: dict[str, bytes] = {}

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Merges of the lowest rank first, the leftmost of equal ones: the definition, for leaves and windows."""
        if len(data) > 64:
            return self._merge_long(data)
        get, none, n = self.ranks.get, 1 << 40, len(data)
        starts, order = list(range(n + 1)), [get(data[i : i + 2], none) for i in range(n - 1)]
        while order and (lowest := min(order)) < none:
            i = order.index(lowest)
            del starts[i + 1], order[i]
            if i < len(order):
                order[i] = get(data[starts[i] : starts[i + 2]], none)
            if i:
                order[i - 1] = get(data[starts[i - 1] : starts[i + 1]], none)
        return tuple(self.ranks[data[a:b]] for a, b in itertools.pairwise(starts))

    def _merge_long(self, data: bytes) -> tuple[int, ...]:
        ranks, n = self.ranks, len(data)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at an index
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = ends[i]
            if middle == 0 or middle >= n or ends[middle] != end:
                continue  # one of the two parts has changed since
            ends[i], ends[middle] = end, 0
            if end < n:
                before[end] = i
                if (r := ranks.get(data[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if (left := before[i]) >= 0 and (r := ranks.get(data[left:end])) is not None:
                heapq.heappush(heap, (r, left, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : ends[i]]])
            i = ends[i]
        return tuple(out)

    def _window(self, left: int, right: int) -> tuple[int, ...]:
        """Two tokens' bytes encoded anew; the two themselves if they fit."""
        found = self._windows.get((left, right))
        if found is None:
            if len(self._windows) >= MEMO:
                self._windows.clear()
            found = self._windows[left, right] = self.merge(self.bytes_of[left] + self.bytes_of[right])
        return found

    def _fit(self, left: int, right: int) -> bool:
        return self._window(left, right) == (left, right)

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of left and right together."""
        if not left or not right:
            return left + right
        a, b = 1, 1
        window = self._window(left[-1], right[0])
        while True:
            left_stable = a >= len(left) or self._fit(left[-a - 1], window[0])
            right_stable = b >= len(right) or self._fit(window[-1], right[b])
            if left_stable and right_stable:
                return left[: max(0, len(left) - a)] + window + right[b:]
            a, b = (a if left_stable else 2 * a), (b if right_stable else 2 * b)
            window = self.merge(self.decode(left[-a:]) + self.decode(right[:b]))

    def _tree(self, data: bytes) -> tuple[int, ...]:
        found = self._short.get(data)
        if found is None:
            if len(data) <= LEAF:
                found = self.merge(data)
            else:
                middle = len(data) // 2
                found = self.join(self._tree(data[:middle]), self._tree(data[middle:]))
            if len(data) <= SHORT:
                if len(self._short) >= MEMO:
                    self._short.clear()
                self._short[data] = found
        return found

    def match(self, data: bytes) -> tuple[int, ...]:
        """One match of the pattern; a match that is itself a token is that token."""
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else self._tree(data)

    def _matches(self, text: str) -> bytes:
        ids = itertools.chain.from_iterable(self.match(m.encode()) for m in self.pattern.findall(text))
        return np.fromiter(ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """A chunk with the blank in front of it."""
        if chunk.isalpha():  # one match
            found = struct.pack(f"<{len(ids := self.match(b" " + chunk.encode()))}I", *ids)
        elif chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":  # two
            found = (self._packed.get(chunk[:-1]) or self._chunk(chunk[:-1])) + self._matches(chunk[-1])
        else:
            found = self._matches(" " + chunk)
        if len(chunk) <= 64:
            if len(self._packed) >= MEMO:
                self._packed.clear()
            self._packed[chunk] = found
        return found

    def packed(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if len(text) > BLOCK and (parts := halves(text)):
            return self.packed(parts[0]) + self.packed(parts[1])
        if (cut := chunks(text)) is None:
            return self._matches(text)
        known = self._packed.get
        rest = [known(c) or self._chunk(c) for c in cut[1:]]
        return b"".join([self._matches(cut[0]), *rest])

    def decode(self, ids: Iterator[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process and vocabulary, kept between batches."""
    return Encoder(load_ranks(path), pattern)


def token_ids(text: Column, path: str, pattern: str) -> Column:
    """The ids of each text as binary: little-endian unsigned 32-bit integers."""
    def encode(texts: pa.Array) -> pa.Array:
        own = encoder(path, pattern)
        return pa.array([own.packed(t.as_py() or "") for t in texts], pa.binary())

    return F.arrow_udf(encode, "binary")(text)


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """The bytes of each document's ids (null: none)."""
    def decode(packed: pa.Array) -> pa.Array:
        own = encoder(path, pattern)
        return pa.array([own.decode(np.frombuffer(p.as_py() or b"", "<u4").tolist()) for p in packed], pa.binary())

    return F.arrow_udf(decode, "binary")(ids)


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the hashes of the ids and of the decoded bytes, for every row of docs."""
    def both(texts: pa.Array) -> pa.Array:
        own = encoder(path, pattern)
        pa.default_memory_pool().release_unused()  # what earlier batches left in the worker
        counts, ids, back = [], [], []
        for text in texts:
            packed = own.packed(text.as_py() or "")
            counts.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            back.append(hashlib.sha256(own.decode(np.frombuffer(packed, "<u4").tolist())).hexdigest())
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
            ["n_tokens", "ids_sha256", "decoded_sha256"])

    kind = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", F.arrow_udf(both, kind)("text").alias("d")).select("doc_id", "d.*")
