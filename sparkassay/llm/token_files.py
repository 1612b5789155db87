"""Token ids in a file format of their own: frames compressed one by one with a shared zstandard dictionary.

A folder holds two Parquet tables, so that any store that Spark reaches will do:
* dictionary: one row with the dictionary, its SHA-256 and the width of an id in bytes;
* blobs: rows of about BLOB bytes. data is a run of frames, one per document; doc_ids, offsets (one more than documents),
  n_tokens and starts (ids before the document in its shard) index them; first_id and last_id let a reader skip
  blobs. Every blob names the hash of its dictionary, and reading with another one is an error.

Shards are ranges of doc_id in ascending order; inside a shard documents ascend. Rows with equal doc_id stand next to each other,
in any order; null ids come first. Null and empty texts have the end id alone. The tokenizer sees whole texts.

The dictionary is trained on a bounded sample (SAMPLE documents chosen by a hash of doc_id, at most SAMPLE_BYTES of each);
everything else covers every row. Without enough sample rows the dictionary is empty and frames stand alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = 2000
SAMPLE_BYTES = 8192
DICTIONARY_BYTES = 65536
LEVEL = 3
BLOB = 4 << 20
END = 2
MEMO = 600_000  # chunks that a worker remembers; beyond, it starts anew
LONG = 64  # bytes; longer chunks are not remembered
TOGETHER = 8 << 20  # bytes of texts, or one text
CHUNKS = 20_000  # that go to the library as one text
BLANK, LINE_END = "\u0120", "\u010a"  # how the tokenizer's file writes them
LINE = "\x00\n"  # no other chunk begins so: a line end behind \x00 is a cut
#: The characters that the pattern's white space class matches.
_SPACES = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_LINE_CUT = f"([^{_SPACES}])\n"
_BEFORE_BLANK = f"[{_SPACES}] "
_SPACE_LAST = rf"(^|[{_SPACES}])\z"

_BLOB_FIELDS = pa.schema([
    ("shard", pa.int32()), ("blob", pa.int32()), ("dictionary", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())),
    ("starts", pa.list_(pa.int64())), ("data", pa.binary())])
_BLOB_TYPES = ("shard int, blob int, dictionary string, first_id bigint, last_id bigint, doc_ids array<bigint>, "
               "offsets array<bigint>, n_tokens array<bigint>, starts array<bigint>, data binary")


def _joined(chunks: pa.Array, separator: str) -> str:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks), pa.scalar(separator, pa.large_string()))[0].as_py()


class _Tokenizer:
    """The tokenizers library behind a memo of chunks, for many texts at once.

    Texts are cut before every blank, and before every line end after a character that is not white space. Where no blank follows white
    space, each cut is the end of a match, so the ids of the chunks are those of the text; other texts are encoded whole. Blanks at
    cuts are left out of the chunks; one that begins with a line end has LINE in front. Arrow cuts the texts, numbers the different chunks,
    looks them up in the memo and puts their ids together.

    Unknown chunks go to the library as one text, lines as another. No chunk has a blank inside, so the tokens that begin with one
    are the first of their chunks; so are those that begin with a line end, where lines have no other. The memo keeps what stands
    twice in the texts of one call; the rest seldom comes again.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work; one thread a task
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self.width = 2 if self._library.get_vocab_size() <= 1 << 16 else 4
        vocabulary = self._library.get_vocab()
        self._begins = {first: np.zeros(max(vocabulary.values(), default=-1) + 1, bool) for first in (BLANK, LINE_END)}
        for first, begins in self._begins.items():
            begins[[i for token, i in vocabulary.items() if token.startswith(first)]] = True
        self._forget()

    def _forget(self) -> None:
        self._chunks, self._known = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def _arrays(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, f"<u{self.width}") for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, texts: list[str]) -> pa.Array:
        return pa.array([ids.tobytes() for ids in self._arrays(texts)], pa.large_binary())

    def _together(self, chunks: pa.Array, first: str) -> pa.Array:
        """The ids of chunks whose tokens begin with first, and none else."""
        parts = [pa.array([], pa.large_binary())]
        for at in range(0, len(chunks), CHUNKS):
            some = chunks.slice(at, CHUNKS)
            text = " " + _joined(some, " ") if first == BLANK else _joined(some, "").replace(LINE, "\n")
            ids = self._arrays([text])[0]
            offsets = (np.append(np.flatnonzero(self._begins[first][ids]), len(ids)) * self.width).astype("<i8")
            buffers = [None, pa.py_buffer(offsets), pa.py_buffer(ids)]
            if len(offsets) != len(some) + 1:
                raise ValueError("the tokenizer's tokens do not begin with their chunks")
            parts.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), buffers))
        return pa.concat_arrays(parts)

    def _learned(self, unknown: pa.Array) -> pa.Array:
        line = pc.starts_with(unknown, LINE)
        alone = pc.or_(pc.match_substring_regex(unknown, _SPACE_LAST), pc.and_(line, pc.greater(pc.count_substring(unknown, "\n"), 1)))
        kinds = np.select([alone, line], [0, 1], 2)
        at = [np.flatnonzero(kinds == k) for k in range(3)]
        each, lines, others = (unknown.take(pa.array(a)) for a in at)
        parts = [self._ids([c[1:] if c.startswith(LINE) else " " + c for c in each.to_pylist()]),
                 self._together(lines, LINE_END), self._together(others, BLANK)]
        return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(at))))

    def packed(self, texts: pa.Array) -> list[bytes]:
        """The ids of whole texts (null: empty), each of width bytes."""
        if not len(texts):
            return []
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if pc.any(odd := pc.match_substring_regex(texts, _BEFORE_BLANK)).as_py():
            whole = iter(self._ids(texts.filter(odd).to_pylist()).to_pylist())
            others = iter(self.packed(texts.filter(pc.invert(odd))))
            return [next(whole if o else others) for o in odd.to_pylist()]
        cut = pc.split_pattern(pc.replace_substring_regex(texts, _LINE_CUT, f"\\1 {LINE}"), " ")
        coded = cut.flatten().dictionary_encode()
        chunks, numbers = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        offsets = np.append(0, np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False), dtype=np.int64))
        first = offsets[:-1]
        heads = self._ids(chunks.take(pa.array(numbers[first])).to_pylist())  # what stands before the first cut
        times = np.bincount(numbers, minlength=len(chunks)) - np.bincount(numbers[first], minlength=len(chunks))
        place = pc.fill_null(pc.index_in(chunks, self._chunks), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero((place < 0) & (times > 0))
        place[new] = len(self._known) + np.arange(len(new))
        unknown = chunks.take(pa.array(new))
        learned = self._learned(unknown)
        places = place[numbers]
        places[first] = len(self._known) + len(new) + np.arange(len(heads))
        ids = pa.concat_arrays([self._known, learned, heads]).take(pa.array(places))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids)
        out = pc.binary_join(lists, pa.scalar(b"", pa.large_binary())).to_pylist()
        kept = pc.and_(pa.array(times[new] > 1), pc.less_equal(pc.binary_length(unknown), LONG))
        self._chunks = pa.concat_arrays([self._chunks, unknown.filter(kept)])
        self._known = pa.concat_arrays([self._known, learned.filter(kept)])
        if len(self._chunks) > MEMO:
            self._forget()
        return out

    def each(self, texts: pa.Array) -> Iterator[bytes]:
        """Some texts at a time."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TOGETHER, "right")))
            yield from self.packed(texts.slice(at, stop - at))
            at = stop


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> _Tokenizer:
    return _Tokenizer(path)


def train_dictionary(docs: DataFrame, tokenizer: str, sample: int = SAMPLE) -> tuple[bytes, int]:
    """The dictionary and the id width. Only the sample's first SAMPLE_BYTES of ids come to the driver."""
    width = _tokenizer(tokenizer).width
    rows = docs.count()
    share = min(1.0, sample / max(rows, 1))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(round(share * 1_000_000))).limit(2 * sample)

    def ids(batch: pa.Array) -> pa.Array:
        own = _tokenizer(tokenizer)
        return pa.array([ids[:SAMPLE_BYTES] for ids in own.each(batch)], pa.binary())

    samples = [bytes(r[0]) for r in chosen.select(F.arrow_udf(ids, "binary")("text")).collect()]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 10), samples).as_bytes(), width
    except (zstandard.ZstdError, ValueError):  # too few or too short samples
        return b"", width


def _data(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Encodes every row of docs (doc_id, text) and writes the folder path."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    spark = docs.sparkSession
    dictionary, width = train_dictionary(docs, tokenizer)
    name = hashlib.sha256(dictionary).hexdigest()

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = _tokenizer(tokenizer), TaskContext.get().partitionId()
        data = _data(dictionary)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=data) if data else zstandard.ZstdCompressor(level=LEVEL)
        last = end.to_bytes(width, "little")
        blob, before, ids, sizes, starts, parts = 0, 0, [], [], [], []

        def done() -> pa.RecordBatch:
            known = [i for i in ids if i is not None]
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "blob": blob, "dictionary": name, "first_id": min(known, default=None),
                "last_id": max(known, default=None), "doc_ids": ids, "n_tokens": sizes, "starts": starts,
                "offsets": np.concatenate(([0], np.cumsum([len(p) for p in parts]))).tolist(), "data": b"".join(parts),
            }], schema=_BLOB_FIELDS)

        size = 0
        for batch in batches:
            pa.default_memory_pool().release_unused()  # what earlier batches left in the worker
            for doc, packed in zip(batch.column(0).to_pylist(), own.each(batch.column(1)), strict=True):
                packed += last
                ids.append(doc)
                starts.append(before)
                sizes.append(len(packed) // width)
                parts.append(pack.compress(packed))
                before += sizes[-1]
                size += len(parts[-1])
                if size >= BLOB:
                    yield done()
                    blob, size, ids, sizes, starts, parts = blob + 1, 0, [], [], [], []
        if ids:
            yield done()

    spark.createDataFrame([(bytearray(dictionary), name, width)], "dictionary binary, sha256 string, width int").coalesce(1) \
        .write.parquet(f"{path}/dictionary")
    (docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(frames, _BLOB_TYPES)
     .write.option("compression", "none").parquet(f"{path}/blobs"))


def _opened(spark: SparkSession, path: str) -> tuple[bytes, str, int]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(row["dictionary"] or b"")
    if hashlib.sha256(dictionary).hexdigest() != row["sha256"]:
        raise ValueError(f"the dictionary in {path} is damaged")
    return dictionary, row["sha256"], row["width"]


def _unpack(dictionary: bytes) -> zstandard.ZstdDecompressor:
    data = _data(dictionary)
    return zstandard.ZstdDecompressor(dict_data=data) if data else zstandard.ZstdDecompressor()


def read(spark: SparkSession, path: str, columns: str = "ids") -> DataFrame:
    """doc_id, start, n_tokens and ids (array<int>), or with columns="crc" ids_crc32 of the ids as unsigned 32 bits."""
    dictionary, name, width = _opened(spark, path)
    blobs = spark.read.schema(_BLOB_TYPES).parquet(f"{path}/blobs")
    # One number per shard: the ids that it holds.
    totals = {r["shard"]: r["n"] for r in blobs.groupBy("shard").agg(
        F.sum(F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n")).collect()}
    base, total = {}, 0
    for shard in sorted(totals):
        base[shard], total = total, total + totals[shard]
    kind = pa.list_(pa.int32()) if columns == "ids" else pa.int64()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _unpack(dictionary)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != name:
                    raise ValueError(f"a blob in {path} was written with another dictionary")
                out, view = [], memoryview(row["data"])
                for a, b in zip(row["offsets"], row["offsets"][1:], strict=False):
                    ids = np.frombuffer(unpack.decompress(view[a:b]), f"<u{width}").astype("<u4")
                    out.append(ids.astype(np.int32) if columns == "ids" else zlib.crc32(ids.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([base[row["shard"]] + s for s in row["starts"]], pa.int64()),
                     pa.array(row["n_tokens"], pa.int64()), pa.array(out, kind)], ["doc_id", "start", "n_tokens", "value"])

    value = "array<int>" if columns == "ids" else "bigint"
    out = blobs.select("shard", "dictionary", "doc_ids", "offsets", "n_tokens", "starts", "data").mapInArrow(
        rows, f"doc_id bigint, start bigint, n_tokens bigint, value {value}")
    return out.withColumnRenamed("value", "ids" if columns == "ids" else "ids_crc32")


def lookup(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents with this doc_id: only blobs around it are opened, and only its frames unpacked."""
    dictionary, name, width = _opened(spark, path)
    blobs = (spark.read.schema(_BLOB_TYPES).parquet(f"{path}/blobs")
             .where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)))
    at = blobs.select("dictionary", "data", F.explode(F.arrays_zip("doc_ids", F.slice("offsets", F.lit(1), F.size("doc_ids")).alias("a"),
                      F.slice("offsets", F.lit(2), F.size("doc_ids")).alias("b"))).alias("x")).where(F.col("x.doc_ids") == doc_id)
    frames = at.select("dictionary", F.expr("substring(data, int(x.a + 1), int(x.b - x.a))").alias("frame")).collect()
    if any(f["dictionary"] != name for f in frames):
        raise ValueError(f"a blob in {path} was written with another dictionary")
    unpack = _unpack(dictionary)
    return [np.frombuffer(unpack.decompress(bytes(f["frame"])), f"<u{width}").tolist() for f in frames]
