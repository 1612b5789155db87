"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

Shingles are SHINGLE words (runs without white space) in a row, as a set; a text of fewer words is one shingle; a text without words has
none and is alone in its class. Two different texts are linked if the Jaccard similarity of their sets is at least THRESHOLD.
Classes are the connected components of links and equal texts.

Forest: in each of TREES tries a text has a label, a sequence of MAX_DEPTH MinHash values drawn from one pool. Texts match in a
trie if they share a prefix of their labels. The level of the join is the longest prefix by which a pair at the threshold is found in some trie
with probability TARGET; that is computed with the pool that all tries share, so it follows from the constants and not from the data.
A shared prefix contains all longer ones, so the pairs of that level are all pairs that a walk from full depth up to it
would find: only this level is read, as buckets, and the tries are not built. Texts in one bucket are tied to the bucket's smallest text, and
connected texts form a candidate group.
Verification: all pairs of texts inside a group are compared exactly, so links found beside the tries' own are kept as well. Groups of more
than BLOCK texts are dealt out as pairs of blocks; a task holds two blocks at most and returns one row per text (its links
and the smallest text that it reaches there), never the pairs.

Equal texts are one vertex, so copies cost no more than their rows. A vertex is named by a 64-bit hash of the text. The work of a
group of n different texts is n squared over tasks; its rows travel n / BLOCK times.
Null and empty texts: no words. Repeated rows are copies. Other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.components import components
from sparkassay.llm.storage import free_name, staged
from sparkassay.llm.url_cascade import bit_words, passes
from sparkassay.llm.words import AS_IS, NOT_SPACE, grams, hashed, whole

SHINGLE = 5
THRESHOLD = 0.8
TREES = 40
MAX_DEPTH = 12
POOL = 128
TARGET = 0.999
BLOCK = 384
FILTER_BITS = 1 << 24  # at most two MB, however many keys: it only spares shuffles, joins decide
BITS_EACH = 12  # of a key, in a smaller filter
SEED = 7


def recall(depth: int, trees: int = TREES, threshold: float = THRESHOLD, pool: int = POOL) -> float:
    """The probability that a pair at the threshold shares a prefix of this depth in some trie, over draws of the pool and of the labels.

    Tries draw from one pool, so they are independent only given the number of functions on which the pair agrees.
    """
    missed = 0.0
    for agreed in range(pool + 1):
        chance = math.comb(pool, agreed) * threshold**agreed * (1 - threshold) ** (pool - agreed)
        missed += chance * (1 - math.comb(agreed, depth) / math.comb(pool, depth)) ** trees
    return 1 - missed


def depth(trees: int = TREES, threshold: float = THRESHOLD, target: float = TARGET) -> int:
    """The longest prefix that finds a pair at the threshold with the target probability."""
    for d in range(MAX_DEPTH, 1, -1):
        if recall(d, trees, threshold) >= target:
            return d
    return 1


def _sets(texts: pa.Array):
    """The sorted distinct shingle hashes of each text."""
    for words in hashed(texts, AS_IS, NOT_SPACE):
        for i in range(words.last - words.first):
            own = words.hashes[words.bounds[i] : words.bounds[i + 1]]
            yield np.unique(grams(own, min(SHINGLE, len(own)))) if len(own) else own


def sketch(text: Column) -> Column:
    """The text's bucket in each trie (array<bigint>); null without words."""
    level = depth()

    def compute(texts: pa.Array) -> pa.Array:
        rng = np.random.default_rng(SEED)
        factors = rng.integers(0, 1 << 32, POOL, np.uint64).astype(np.uint32) | np.uint32(1)
        masks = rng.integers(0, 1 << 32, POOL, np.uint64).astype(np.uint32)
        picks = np.stack([rng.permutation(POOL)[:MAX_DEPTH] for _ in range(TREES)])[:, :level]
        out = []
        for shingles in _sets(texts):
            if not len(shingles):
                out.append(None)
                continue
            low = (shingles >> np.uint64(32)).astype(np.uint32)
            # All hash functions at once, some shingles at a time.
            signature = np.min([((low[None, at : at + 4096] ^ masks[:, None]) * factors[:, None]).min(axis=1)
                                for at in range(0, len(low), 4096)], axis=0).astype(np.uint64)
            labels = signature[picks]
            bucket = np.arange(TREES, dtype=np.uint64)
            for column in range(level):
                bucket = (bucket ^ labels[:, column]) * np.uint64(0x9E3779B97F4A7C15)
                bucket ^= bucket >> np.uint64(29)
            out.append(bucket.view(np.int64))
        return pa.array(out, pa.list_(pa.int64()))

    return F.arrow_udf(compute, "array<bigint>")(text)


def shingle_set(text: Column) -> Column:
    return F.arrow_udf(lambda texts: pa.array([s.tobytes() for s in _sets(texts)], pa.binary()), "binary")(text)


def _verified(key: tuple, table: pa.Table) -> pa.Table:
    """Links among the texts of one block, or between those of two."""
    _, first, second = (k.as_py() for k in key)
    nodes = np.asarray(table.column("node"))
    sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
    blocks = np.asarray(table.column("block"))
    n, sizes = len(sets), np.array([len(s) for s in sets])
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(n), sizes)
    shared = counts[ids] > 1  # others are in no intersection
    rows, (_, ids) = rows[shared], np.unique(ids[shared], return_inverse=True)
    common = np.zeros((n, n), np.float32)
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    width = 2048
    for at in range(0, int(ids[-1]) + 1 if len(ids) else 0, width):
        a, b = np.searchsorted(ids, (at, at + width))
        part = np.zeros((n, width), np.float32)
        part[rows[a:b], ids[a:b] - at] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = common * 5 >= union * 4 if THRESHOLD == 0.8 else common >= THRESHOLD * union
    np.fill_diagonal(linked, False)
    if first != second:
        linked &= blocks[:, None] != blocks[None, :]
    root = nodes.copy()
    while True:  # smallest name within reach
        nearest = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (nearest == root).all():
            break
        root = nearest
    links = linked.sum(axis=1)
    found = links > 0
    return pa.table({"node": nodes[found], "root": root[found], "links": links[found].astype(np.int64)})


def _node(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def among(keys: DataFrame, key: Column, name: str) -> Column:
    """A condition that holds for all keys (a written table with a column key) and for few others. The bits are written and sent once."""
    bits = min(FILTER_BITS, max(64, -(-keys.count() * BITS_EACH // 64) * 64))
    words = staged(bit_words(keys, 0, bits), name).scalar()
    return passes(key, 0, bits, words)


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, class_id, n_links) of every row of docs, staged; and (node, copies) of each text.

    class_id is the smallest doc_id of the class; n_links counts the different texts linked with the row's text.
    """
    text = F.col("text")
    rows = staged(docs.select("doc_id", _node(text).alias("node"), sketch(text).alias("buckets")), "sketches")
    texts = rows.where("buckets IS NOT NULL").select("node", "buckets").dropDuplicates(["node"])
    places = texts.select("node", F.explode("buckets").alias("bucket"))
    hubs = places.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("other")).where("hub <> other")
    ties = places.join(hubs.select("bucket", "hub"), "bucket").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    groups = components(ties.distinct())
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"))
    dealt = groups.join(sizes, "root").select("node", "root", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = staged(dealt, "candidates")
    first = rows.groupBy("node").agg(F.min("doc_id").alias("first"))
    chosen = dealt.join(first, "node")
    sets = (docs.select("doc_id", "text", _node(text).alias("node"))
            .where(among(dealt.select(F.col("node").alias("key")), F.col("node"), "candidate-bits"))
            .join(chosen, "node").where(F.col("doc_id").eqNullSafe(F.col("first")))
            .dropDuplicates(["node"]).select("node", "root", "blocks", shingle_set(text).alias("shingles")))
    block = F.pmod(F.xxhash64("node"), F.col("blocks").cast("bigint")).cast("int")
    pairs = (sets.withColumn("block", block)
             .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("node", "block", "shingles", "root", F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b")))
    links = staged(pairs.groupBy("root", "a", "b").applyInArrow(_verified, "node bigint, root bigint, links bigint"), "links")
    roots = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counted = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    named = counted.join(roots, "node", "left").select("node", "n_links", F.coalesce("root", "node").alias("root"))
    alone = F.col("buckets").isNull()
    table = rows.select("doc_id", "node", alone.alias("alone")).join(named, "node", "left")
    table = table.withColumn("root", F.when(~F.col("alone"), F.coalesce("root", "node")))
    least = table.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    result = table.join(least, "root", "left").select(
        "doc_id", "node", F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("least")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "alone")
    return staged(result, "classes"), rows


def join_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and n_links of every row of docs."""
    return classes(docs)[0].select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id, one of repeated rows. Rows without words all stay;
    of a class without any doc_id one row of each text stays. Columns of any name stay as they are."""
    judged, _ = classes(docs)
    name, gone_id, gone_node = (free_name(docs, n) for n in ("node", "gone_id", "gone_node"))
    gone = judged.where(~F.col("alone") & ~F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", "node")
    repeated = (judged.where("NOT alone").groupBy("doc_id", "node").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "node"))
    touched = staged(gone.select(F.col("node").alias("key")).union(repeated.select(F.col("node").alias("key"))).distinct(), "touched")
    named = docs.withColumn(name, _node(F.col("text")))
    maybe = among(touched, F.col(name), "touched-bits") & F.coalesce(F.btrim("text", F.lit(" \t\n\x0b\f\r")) != "", F.lit(False))
    out = gone.select(F.col("doc_id").alias(gone_id), F.col("node").alias(gone_node)).distinct()
    left = (named.where(maybe).join(out, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(name) == F.col(gone_node)), "left_anti")
            .dropDuplicates(["doc_id", name]))
    return named.where(~maybe).union(left).drop(name)
