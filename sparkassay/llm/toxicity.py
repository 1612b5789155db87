"""Toxicity: a noisy-channel decoder undoes disguises, then a learned word list scores the restored text.

Language model: counts of character triples (letters a to z, other letters, word edge) over all documents, summed by Spark.
Decoder: words with digits or signs, words that repeat a letter three times or more, and words spelled out in single letters or leet signs become
a lattice of readings (leet signs as letters, filler signs left out, runs shortened); Viterbi picks the reading with the best
product of channel and language model. They are read whatever their length and share of letters, with their outer signs, without punctuation
and without any, and also in parts between separators. Other words have one reading, themselves. Words under three characters have no feature.
Word list: features are words and their beginnings of 4 to 8 bytes, so that inflected forms count together. A feature's weight is the
share of toxic documents among the training documents that have it, drawn to the overall share by PRIOR documents. Near copies
(documents with an equal smallest five-word shingle) share one vote. A document's raw score is its largest weight, of words as they
stand or as restored; isotonic regression on the training documents makes it the share of toxic documents at that score.

Labels: at most MAX_LABELLED labelled documents are learned from (chosen by a hash of doc_id beyond that); every feature whose
weight can reach the threshold is weighed. Scores, the language model and all counts cover whole texts. Null and empty texts score
like any text without a listed feature; without labels of both kinds every score is BASE. Repeated rows score alike; of labels that repeat a
doc_id the largest counts. A run of letters longer than a piece (words.PIECE bytes) is no word.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.isotonic import Calibration, calibrate
from sparkassay.llm.quality import held_out
from sparkassay.llm.storage import staged
from sparkassay.llm.words import AS_IS, LETTERS, LOWER, NOT_SPACE, PIECE, buffers, grams, hashed, hasher, runs

PREFIXES = (4, 5, 6, 7, 8)
PRIOR = 30.0
BINS = 1000  # of raw scores, for the calibration
BASE = 0.02
LEAST = 0.1  # weights below are not kept
THRESHOLD = 0.3
MAX_LABELLED = 1_000_000
MEMO = 100_000
LONGEST_MEMO = 64  # characters; longer tokens are decoded each time
#: Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
    "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "*": "aeiou", "#": "aeiou",
}
FILLERS = ".-_*~'`^,/\\"
SYMBOLS = 28  # 0: edge, 1 to 26: letters, 27: other letters
KEEP, SUBSTITUTE, DROP, SHORTEN = math.log(0.9), math.log(0.05), math.log(0.05), math.log(0.3)

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[0x61:0x7B] = np.arange(1, 27)
_SYMBOL[0x41:0x5B] = np.arange(1, 27)
_SYMBOL[0x80:] = 27
_LEET = re.escape("".join(c for c in LEET if c not in FILLERS))
_OPEN = "\"'()[]{}<>,;:.?&%"  # punctuation that may surround a word
_PLAIN = _OPEN.replace("(", "").replace("<", "") + "-_~`^/\\=\u201c\u201d\u201e\u2018\u2019\u00ab\u00bb\u2026\u2013\u2014\u00bf\u00a1"  # stand for no letter
#: Three or more single letters or leet signs with any run of white space or fillers between them; the two kinds have no sign in common.
_SPELLED = re.compile(rf"(?<![^\W_])(?:(?:[^\W\d_]|[{_LEET}])[\s{re.escape(FILLERS)}]+){{2,}}(?:[^\W\d_]|[{_LEET}])(?![^\W_])")
_GAPS = re.compile(rf"[\s{re.escape(FILLERS)}]+")
_PARTS = (re.compile(r"[/\\,:;?&=\[\]{}>\"]+"), re.compile(rf"(?:[^\w{_LEET}]|_)+"))
_WORD = re.compile(r"\S+")
_TRIPLE = re.compile(r"([^\W\d_])\1\1", re.IGNORECASE)


# ---------------------------------------------------------------- language model
def language_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of a symbol after two others, from all documents; SYMBOLS cubed, whatever the input."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            data, _ = buffers(batch.column(0))
            for at in range(0, len(data), PIECE):  # two bytes of overlap
                s = _SYMBOL[data[at : at + PIECE + 2]]
                total += np.bincount(s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cells, pa.int32()), "n": pa.array(total[cells])})

    cells = (docs.select("text").mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))).toPandas()
    table = np.zeros(SYMBOLS**3)
    table[cells["cell"].to_numpy(int)] = cells["n"].to_numpy(float)
    table = table.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    pairs = table.sum(0) + 1
    after = pairs / pairs.sum(1, keepdims=True)
    return np.log((table + 5 * after[None]) / (table.sum(2, keepdims=True) + 5))


# ---------------------------------------------------------------- decoder
def readings(token: str) -> list[list[tuple[str, float]]]:
    """The lattice of a folded token: for each place its possible letters (or none) with channel log probabilities."""
    out: list[list[tuple[str, float]]] = []
    for char, run in itertools.groupby(token):
        n = len(list(run))
        if char.isalpha():
            if n <= 2:
                out += [[(char, KEEP)]] * n
            else:
                out += [[(char, SHORTEN)], [(char, SHORTEN), ("", SHORTEN)]]
            continue
        options = [(letter, SUBSTITUTE) for letter in LEET.get(char, "")]
        if char in FILLERS or not options:
            options.append(("", DROP))
        out += [options] if char in FILLERS or n > 2 else [options] * n
    return out


def _symbol(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 27


def decode(token: str, model: np.ndarray) -> str:
    """The most likely reading of the token (folded): Viterbi over the last two symbols."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # texts as (text before, letter)
    for options in readings(token):
        following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, text) in best.items():
            for letter, channel in options:
                if letter:
                    c = _symbol(letter)
                    state, value = (b, c), score + channel + float(model[a, b, c])
                else:
                    state, value = (a, b), score + channel
                if state not in following or value > following[state][0]:
                    following[state] = (value, (text, letter) if letter else text)
        best = following
    text = max(((score + float(model[a, b, 0]), text) for (a, b), (score, text) in best.items()), key=lambda found: found[0])[1]
    letters = []
    while text:
        text, letter = text
        letters.append(letter)
    return "".join(reversed(letters))


def _bare(token: str) -> tuple[int, int]:
    """The token without any sign at its ends."""
    first, last = 0, len(token)
    while first < last and not token[first].isalnum():
        first += 1
    while last > first and not token[last - 1].isalnum():
        last -= 1
    return first, last


def variants(token: str) -> tuple[str, ...]:
    """What the token may be a disguise of, folded: all of it and its parts, each with its outer signs, with the innermost one or without them."""
    found: dict[str, None] = {}
    for part in dict.fromkeys([token, *_PARTS[0].split(token), *_PARTS[1].split(token)]):
        own = part.strip(_PLAIN)
        first, last = _bare(own)
        ends = {len(own), len(own.rstrip(_OPEN)), len(own.rstrip(_OPEN + "!"))} | ({last, min(last + 1, len(own))} if first < last else set())
        for begin in sorted({0, len(own) - len(own.lstrip(_OPEN))} | ({first, max(first - 1, 0)} if first < last else set())):
            for end in sorted(ends):
                word = own[begin:end]
                if len(word) >= 3 and (not word.isalpha() or _TRIPLE.search(word)):
                    found[word.lower()] = None
    return tuple(found)


def suspects(text: str) -> Iterator[str]:
    """Tokens of a text that may be disguised, without outer signs that stand for no letter."""
    tripled = _TRIPLE.search(text) is not None
    for found in _WORD.finditer(text):
        token = found[0]
        if not token.isalpha():
            token = token.strip(_PLAIN)
        if len(token) >= 3 and (not token.isalpha() or tripled and _TRIPLE.search(token)):
            yield token


# ---------------------------------------------------------------- features
def _folded(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals (two bytes in UTF-8) as small letters."""
    out = LOWER[data]
    latin = np.flatnonzero((out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97) & (out[:-1] == 0xC3)) + 1
    out[latin] += 0x20
    return out


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Some texts at a time: first, last, and for each occurrence the text (counted from first) and the feature."""
    data, offsets = buffers(texts)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1)
        at, end = int(offsets[first]), int(offsets[last])
        owners, values = [], []
        while at < end:
            stop = min(end, at + PIECE)
            part = _folded(data[at:stop])
            inside = LETTERS[part]
            if stop < end and len(gaps := np.flatnonzero(~inside)):
                stop = at + int(gaps[-1]) + 1
                part, inside = part[: stop - at], inside[: stop - at]
            cuts = offsets[first:last] - at
            s, e = runs(part, inside, cuts[(cuts >= 0) & (cuts < stop - at)])
            long = e - s >= 3
            s, e = s[long], e[long]
            hash_of, owner = hasher(part), np.searchsorted(offsets, s + at, "right") - 1 - first
            owners.append(owner)
            values.append(hash_of(s, e))
            for k in PREFIXES:
                longer = e - s > k
                owners.append(owner[longer])
                values.append(hash_of(s[longer], s[longer] + k) ^ np.uint64(k))
            at = stop
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        yield first, last, join(owners, np.int64), join(values, np.uint64)
        first = last


def _counts(texts: pa.Array, votes: np.ndarray, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Votes of the documents that have each feature (of the known ones, sorted)."""
    all_values, all_votes = [], []
    for first, _, owners, values in features(texts):
        if known is not None:
            owners, values = _only(known, owners, values)
        if len(values):
            pairs = np.unique(np.stack([values, owners.astype(np.uint64)], 1), axis=0) if known is not None else _distinct(values, owners)
            all_values.append(pairs[:, 0])
            all_votes.append(votes[first + pairs[:, 1].astype(np.int64)])
    if not all_values:
        return np.zeros(0, np.uint64), np.zeros(0)
    values, inverse = np.unique(np.concatenate(all_values), return_inverse=True)
    return values, np.bincount(inverse, np.concatenate(all_votes))


def _distinct(values: np.ndarray, owners: np.ndarray) -> np.ndarray:
    order = np.lexsort((owners, values))
    v, o = values[order], owners[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.stack([v[new], o[new].astype(np.uint64)], 1)


@lru_cache(maxsize=2)
def _bits(known: bytes) -> np.ndarray:
    out = np.zeros(1 << 24, bool)
    out[(np.frombuffer(known, np.uint64) >> np.uint64(40)).astype(np.int64)] = True
    return out


def _only(known: np.ndarray, owners: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return owners[:0], values[:0]
    maybe = _bits(known.tobytes())[(values >> np.uint64(40)).astype(np.int64)]
    owners, values = owners[maybe], values[maybe]
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    found = known[at] == values
    return owners[found], values[found]


# ---------------------------------------------------------------- training
@dataclass(frozen=True)
class ToxicityModel:
    listed: np.ndarray  # features, sorted
    weights: np.ndarray
    language: np.ndarray
    calibration: Calibration | None = None

    def score(self, text: Column) -> Column:
        def compute(texts: pa.Array) -> pa.Array:
            raw = _scores(self, texts)
            return pa.array(raw if self.calibration is None else self.calibration(raw))

        return F.arrow_udf(compute, "double")(text)


_restored: dict[str, tuple[str, ...]] = {}


def _restore(token: str, language: np.ndarray) -> tuple[str, ...]:
    found = _restored.get(token)
    if found is None:
        found = tuple(word for word in dict.fromkeys(decode(v, language) for v in variants(token)) if len(word) >= 3)
        if len(token) <= LONGEST_MEMO:
            if len(_restored) >= MEMO:
                _restored.clear()
            _restored[token] = found
    return found


def restored_words(text: str, language: np.ndarray) -> list[str]:
    """Readings of the text's disguised words."""
    spelled = [_GAPS.sub("", found[0]).lower() for found in _SPELLED.finditer(text)]
    out = [decode(word, language) for word in spelled]
    for token in suspects(text):
        out += _restore(token, language)
    return [word for word in out if word]


def _scores(model: ToxicityModel, texts: pa.Array) -> np.ndarray:
    out = np.full(len(texts), BASE)

    def raise_to(rows: pa.Array, owner_of) -> None:
        for first, _, owners, values in features(rows):
            owners, values = _only(model.listed, owners, values)
            if len(values):
                np.maximum.at(out, owner_of(first + owners), model.weights[np.searchsorted(model.listed, values)])

    raise_to(texts, lambda i: i)
    owners, words = [], []
    for i, text in enumerate(texts):
        if found := restored_words(text.as_py() or "", model.language):
            owners.append(i)
            words.append(" ".join(found))
    if words:
        at = np.array(owners)
        raise_to(pa.array(words, pa.string()), lambda i: at[i])
    return out


def _first_shingle(text: Column) -> Column:
    """The smallest five-word shingle's hash: near copies mostly share it."""
    def compute(texts: pa.Array) -> pa.Array:
        out = []
        for words in hashed(texts, AS_IS, NOT_SPACE):
            for i in range(words.last - words.first):
                own = words.hashes[words.bounds[i] : words.bounds[i + 1]]
                out.append(int(grams(own, min(5, len(own))).view(np.int64).min()) if len(own) else 0)
        return pa.array(out, pa.int64())

    return F.arrow_udf(compute, "bigint")(text)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, test_fold: int = 2) -> ToxicityModel:
    language = language_model(docs)
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
             .where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) != test_fold))
    total = known.count()
    if total > MAX_LABELLED:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(total)) < MAX_LABELLED)
    # At most about MAX_LABELLED narrow rows, so they may go to every task.
    rows = docs.select("doc_id", "text").join(F.broadcast(staged(known, "toxic-labels")), "doc_id")
    keyed = staged(rows.select("doc_id", "y", _first_shingle(F.col("text")).alias("key")), "toxic-copies")
    groups = keyed.groupBy("key", "y").agg((1.0 / F.count("*")).alias("vote"))
    votes = staged(keyed.join(groups, ["key", "y"]).groupBy("doc_id").agg(F.max("y").alias("y"), F.max("vote").alias("vote")), "toxic-votes")
    sums = {r["y"]: r["votes"] for r in votes.groupBy("y").agg(F.sum("vote").alias("votes")).collect()}
    toxic, clean = float(sums.get(1) or 0), float(sums.get(0) or 0)
    nothing = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), language)
    if not toxic or not clean:
        return nothing
    train = docs.select("doc_id", "text").join(F.broadcast(votes), "doc_id")

    def counted(known_features: np.ndarray | None):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values, sums = _counts(batch.column(0), np.asarray(batch.column(1)), known_features)
                yield pa.RecordBatch.from_pydict({"feature": pa.array(values.view(np.int64)), "votes": pa.array(sums)})
        return count

    def tally(side: int, known_features: np.ndarray | None) -> DataFrame:
        return (train.where(F.col("y") == side).select("text", "vote").mapInArrow(counted(known_features), "feature bigint, votes double")
                .groupBy("feature").agg(F.sum("votes").alias("votes")))

    share = toxic / (toxic + clean)
    threshold = max(LEAST, 1.5 * share)
    # The weight (p + PRIOR share) / (p + n + PRIOR) of p toxic and n other votes is largest without others; it stays below the
    # threshold if p is less than this.
    least = PRIOR * (threshold - share) / (1 - threshold)
    # As many features as the labelled rows, MAX_LABELLED at most, hold with so many votes.
    seen = tally(1, None).where(F.col("votes") >= least).toArrow()
    values = seen.column("feature").to_numpy().view(np.uint64)
    order = np.argsort(values)
    values, positive = values[order], seen.column("votes").to_numpy()[order]
    other = tally(0, values).toArrow()
    negative = np.zeros(len(values))
    negative[np.searchsorted(values, other.column("feature").to_numpy().view(np.uint64))] = other.column("votes").to_numpy()
    weights = (positive + PRIOR * share) / (positive + negative + PRIOR)
    keep = weights >= threshold
    model = ToxicityModel(values[keep], weights[keep], language)
    bins = (train.select("y", "vote", F.floor(model.score(F.col("text")) * BINS).alias("bin")).groupBy("bin")
            .agg(F.sum(F.col("y") * F.col("vote")).alias("toxic"), F.sum("vote").alias("votes")).collect())
    points = [((b["bin"] + 0.5) / BINS, float(b["toxic"]), float(b["votes"])) for b in bins]
    return replace(model, calibration=calibrate(points))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    model = fit(docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
