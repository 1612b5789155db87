"""Quality classifier: ridge regression on random Fourier features of document statistics.

The features z(x) = sqrt(2/D) cos(Wx + b) of the standardised statistics x approximate a Gaussian kernel.
Each partition sums z z' and z y over its labelled rows; Spark adds the sums up, so the driver receives one
small matrix per fold, however many rows there are. Scores are calibrated by isotonic regression on
predictions of models that have not seen the row's fold.

Only the text is an input of a score. Null and empty texts have statistics of zero and are scored like others.
Rows of labels that repeat a doc_id count once with their mean; null labels and labels without a document are ignored.
Without usable labels every score is 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.isotonic import Calibration, calibrate
from sparkassay.llm.storage import staged
from sparkassay.llm.words import AS_IS, NOT_SPACE, buffers, byte_class, grams, hashed

FEATURES = 96
SEED = 20240501
RIDGE = 1e-3  # times the number of rows
BINS = 4000  # of raw scores from -1 to 2
THRESHOLD = 0.3

_CLASSES = np.stack([byte_class(c) for c in (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", bytes(range(0x80, 0x100)), b"0123456789",
    b" \t\v\f\r", b"\n", b".,;:", b"!?", b"#*$%&<>", b"|", b"\"'()[]{}", b"-_/\\@=+~^`")], axis=1).astype(np.float64)
STATISTICS = _CLASSES.shape[1] + 13


def _rows(texts: pa.Array) -> Iterator[np.ndarray]:
    data, offsets = buffers(texts)
    raw = texts.cast(pa.large_string()).fill_null("")
    for words in hashed(texts, AS_IS, NOT_SPACE):
        lengths = words.ends - words.starts
        first = data[words.starts] if len(lengths) else np.zeros(0, np.uint8)
        last = data[words.ends - 1] if len(lengths) else first
        upper = (first >= 0x41) & (first <= 0x5A)
        closing = np.isin(last, np.frombuffer(b".!?,;:", np.uint8))
        for i in range(words.last - words.first):
            text = data[offsets[words.first + i] : offsets[words.first + i + 1]]
            counts = np.bincount(text, minlength=256)
            a, b = words.bounds[i], words.bounds[i + 1]
            n, size = b - a, max(len(text), 1)
            row = np.zeros(STATISTICS)
            row[: _CLASSES.shape[1]] = np.sqrt(counts @ _CLASSES / size)
            k = _CLASSES.shape[1]
            row[k] = np.log1p(len(text))
            if n:
                _, times = np.unique(words.hashes[a:b], return_counts=True)
                pairs = grams(words.hashes[a:b], 2)
                row[k + 1] = np.log1p(n)
                row[k + 2] = np.log(size / n)
                row[k + 3] = lengths[a:b].std() / 10
                row[k + 4] = len(times) / n
                row[k + 5] = times.max() / n
                row[k + 6] = (words.hashes[a + 1 : b] == words.hashes[a : b - 1]).mean() if n > 1 else 0
                row[k + 7] = len(np.unique(pairs)) / len(pairs) if len(pairs) else 1
                row[k + 8] = upper[a:b].mean()
                row[k + 9] = closing[a:b].mean()
                lines = raw[words.first + i].as_py().split("\n")
                row[k + 10] = np.log1p(len(lines))
                row[k + 11] = len(set(lines)) / len(lines)
                share = counts[counts > 0] / size
                row[k + 12] = -(share * np.log(share)).sum()
            yield row


def statistics(text: Column) -> Column:
    """The statistics of each whole text, as array<double>."""
    def compute(texts: pa.Array) -> pa.Array:
        rows = list(_rows(texts))
        flat = np.concatenate(rows) if rows else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * STATISTICS, pa.int32()), pa.array(flat))

    return F.arrow_udf(compute, "array<double>")(text)


def matrix(arrays: pa.Array) -> np.ndarray:
    arrays = arrays.combine_chunks() if isinstance(arrays, pa.ChunkedArray) else arrays
    return np.asarray(arrays.flatten(), dtype=np.float64).reshape(len(arrays), -1)


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the features, then the constant
    calibration: Calibration

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w = rng.normal(size=(STATISTICS, FEATURES)) / np.sqrt(STATISTICS)
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        out = np.sqrt(2 / FEATURES) * np.cos(z @ w + b)
        return np.hstack([out, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, values: Column) -> Column:
        """The calibrated score of a column of statistics."""
        def compute(arrays: pa.Array) -> pa.Array:
            x = matrix(arrays) if len(arrays) else np.zeros((0, STATISTICS))
            return pa.array(self.calibration(self.raw(x)))

        return F.arrow_udf(compute, "double")(values)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold, F.lit(False))


def labelled(table: DataFrame, labels: DataFrame, label: str, folds: int, test_fold: int) -> DataFrame:
    """Rows of table (with doc_id) that may be learned from, with y and fold."""
    y = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
         .agg(F.avg(F.col(label)).alias("y")))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)).cast("int")
    return table.join(y, "doc_id").withColumn("fold", fold).where(F.col("fold") != test_fold)


def fit(rows: DataFrame) -> QualityModel:
    """From the columns x (statistics), y and fold. The driver receives sums whose size depends on FEATURES only."""
    columns = [F.col("x")[i] for i in range(STATISTICS)]
    moments = rows.select(*(F.avg(c) for c in columns), *(F.stddev_pop(c) for c in columns), F.count("*")).first()
    blank = QualityModel(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros(FEATURES + 1), Calibration((), ()))
    if not moments[-1]:
        return blank
    mean = np.array(moments[:STATISTICS], float)
    scale = np.maximum(np.array(moments[STATISTICS : 2 * STATISTICS], float), 1e-6)
    model = QualityModel(mean, scale, np.zeros(FEATURES + 1), Calibration((), ()))
    width = FEATURES + 2
    upper = np.triu_indices(width)

    def partition_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z = np.hstack([model.features(matrix(batch.column("x"))), np.asarray(batch.column("y"))[:, None]])
            folds = np.asarray(batch.column("fold"))
            for fold in np.unique(folds):
                part = z[folds == fold]
                sums[int(fold)] = sums.get(int(fold), 0) + part.T @ part
        for fold, total in sums.items():
            yield pa.RecordBatch.from_pydict({
                "fold": pa.array(np.full(len(upper[0]), fold), pa.int32()),
                "cell": pa.array(np.arange(len(upper[0])), pa.int32()), "value": pa.array(total[upper])})

    cells = (rows.select("x", "y", "fold").mapInArrow(partition_sums, "fold int, cell int, value double")
             .groupBy("fold", "cell").agg(F.sum("value").alias("value")).toArrow())
    folds, cell, value = (cells.column(c).to_numpy() for c in ("fold", "cell", "value"))
    by_fold = {}
    for fold in np.unique(folds):
        own = folds == fold
        total = np.zeros((width, width))
        total[upper[0][cell[own]], upper[1][cell[own]]] = value[own]
        by_fold[int(fold)] = total + np.triu(total, 1).T
    everything = sum(by_fold.values())

    def solve(total: np.ndarray) -> np.ndarray:
        gram = total[:-1, :-1] + RIDGE * total[-2, -2] * np.diag([1.0] * FEATURES + [0.0]) + 1e-9 * np.eye(FEATURES + 1)
        return np.linalg.solve(gram, total[:-1, -1])

    full = solve(everything)
    # Predictions for the calibration come from the sums without the row's own fold.
    unseen = {fold: solve(everything - own) if len(by_fold) > 1 else full for fold, own in by_fold.items()}

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z, folds = model.features(matrix(batch.column("x"))), np.asarray(batch.column("fold"))
            raw = np.zeros(len(z))
            for fold in np.unique(folds):
                raw[folds == fold] = z[folds == fold] @ unseen[int(fold)]
            bins = np.floor((np.clip(raw, -1, 2) + 1) / 3 * BINS)
            yield pa.RecordBatch.from_pydict({"bin": pa.array(bins, pa.int32(), safe=False), "y": batch.column("y")})

    points = (rows.select("x", "y", "fold").mapInArrow(binned, "bin int, y double").groupBy("bin")
              .agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect())
    calibration = calibrate([((p["bin"] + 0.5) / BINS * 3 - 1, p["y"], p["n"]) for p in points])
    return QualityModel(mean, scale, full, calibration)


def fit_on(docs: DataFrame, labels: DataFrame, folds: int = 5, test_fold: int = 0) -> tuple[QualityModel, DataFrame]:
    """The model, and the staged statistics (doc_id, x) of every document."""
    table = staged(docs.select("doc_id", statistics(F.col("text")).alias("x")), "quality-statistics")
    rows = staged(labelled(table, labels, "quality", folds, test_fold).select("x", "y", "fold"), "quality-rows")
    return fit(rows), table


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs; a repeated row is scored each time."""
    model, table = fit_on(docs, labels)
    scored = table.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), model.score(F.col("x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score reaches the threshold, all columns as they were."""
    model, _ = fit_on(docs, labels)
    return docs.where(model.score(statistics(F.col("text"))) >= THRESHOLD)
