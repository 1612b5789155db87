"""Words of many texts at once: hashes of byte runs over an Arrow batch's own buffer.

A word's hash depends on its bytes alone, so a long text is hashed in pieces cut between words and needs
memory for one piece, plus eight bytes for each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 18  # bytes hashed at once
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def byte_class(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(members, np.uint8)] = True
    return table


#: Words between white space.
NOT_SPACE = ~byte_class(b" \t\n\v\f\r")
#: Runs of digits, Latin letters and all bytes of characters beyond ASCII; for texts folded by LOWER.
LETTERS = byte_class(bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
AS_IS = np.arange(256, dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over the word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    ones = np.ones(2 * PIECE + 1, np.uint64)
    ones[1:] = _BASE
    up = np.cumprod(ones)
    ones[1:] = _INVERSE
    return up, np.cumprod(ones)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts (null: empty) and each text's first byte, with the end at last."""
    pa.default_memory_pool().release_unused()  # what earlier batches left in the worker
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of the texts first..last-1 of a batch; those of text i are bounds[i] to bounds[i + 1]."""

    first: int
    last: int
    hashes: np.ndarray
    starts: np.ndarray  # first byte of a word, counted in the batch
    ends: np.ndarray
    bounds: np.ndarray

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def runs(data: np.ndarray, inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of word bytes; a run ends where a text does."""
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def hasher(data: np.ndarray):
    """A function of starts and ends of byte spans of data (2 * PIECE bytes at most) to their hashes."""
    up, down = _powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return lambda starts, ends: mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return hasher(data)(starts, ends)


def _long_run_hash(data: np.ndarray) -> np.uint64:
    """Of one word that does not fit a piece."""
    total, factor = 0, 1
    up, _ = _powers()
    step = pow(int(_BASE), PIECE, 1 << 64)
    for at in range(0, len(data), PIECE):
        piece = data[at : at + PIECE].astype(np.uint64) + np.uint64(1)
        total += factor * int((piece * up[: len(piece)]).sum(dtype=np.uint64))
        factor = factor * step % (1 << 64)
    return mix(np.array([(total + len(data)) % (1 << 64)], np.uint64))[0]


def hashed(texts: pa.Array, fold: np.ndarray, members: np.ndarray) -> Iterator[Words]:
    """The words of all texts, some texts at a time."""
    data, offsets = buffers(texts)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1)
        begin, end = int(offsets[first]), int(offsets[last])
        hashes, starts, ends = [], [], []
        at = begin
        while at < end:
            stop = min(end, at + PIECE)
            part = fold[data[at:stop]]
            inside = members[part]
            if stop < end:  # cut after the last byte between words
                gaps = np.flatnonzero(~inside)
                if len(gaps):
                    stop = at + int(gaps[-1]) + 1
                else:  # one word fills the piece
                    while stop < end and members[fold[data[stop]]]:
                        rest = members[fold[data[stop : stop + PIECE]]]
                        stop += int(np.argmin(rest)) if not rest.all() else len(rest)
                    stop = min(stop, end)
                    hashes.append(np.array([_long_run_hash(fold[data[at:stop]])], np.uint64))
                    starts.append(np.array([at]))
                    ends.append(np.array([stop]))
                    at = stop
                    continue
                part, inside = part[: stop - at], inside[: stop - at]
            cuts = offsets[first:last] - at
            s, e = runs(part, inside, cuts[(cuts >= 0) & (cuts < stop - at)])
            hashes.append(span_hashes(part, s, e))
            starts.append(s + at)
            ends.append(e + at)
            at = stop
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        begins = join(starts, np.int64)
        yield Words(first, last, join(hashes, np.uint64), begins, join(ends, np.int64),
                    np.searchsorted(begins, offsets[first : last + 1]))
        first = last


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words in a row, one for each start."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = hashes[:n].copy()
    for j in range(1, k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + hashes[j : n + j]
    return mix(h)


def whole(bounds: np.ndarray, k: int) -> np.ndarray:
    """Starts of all k-word windows that lie in one text."""
    counts = np.maximum(np.diff(bounds) - k + 1, 0)
    total = int(counts.sum())
    shift = np.repeat(bounds[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(total) + shift
