"""URL filters: longest-prefix rules, then exact membership of the host in a list by a cascade of Bloom filters.

Level 1 encodes the listed keys; level 2 those other keys of the universe that level 1 lets through; level 3 the listed keys
that level 2 lets through, and so on until a level lets nothing wrong through. Over the universe from which it was built, the
level at which a key first falls out says exactly whether it is listed. The universe is every key of the corpus.

A level is an array<bigint> of 64-bit words in a one-row table, read as a scalar subquery: no join, no Python, and no key reaches the driver.
BITS per key bound its size. If a level is beyond MAX_BYTES, judge looks the list up by a join instead (`listed_by_join`), also exact.

Null urls and urls without "://" have an empty host and path and match no rule. An empty host is never listed. Repeated
rows are judged alike; only the url is looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.storage import staged

BITS = 12  # per key of a level
HASHES = 4
MAX_BYTES = 64 << 20  # of one level
#: The rules, verdict by host and path.
RULES = (
    ("net/", "net", "/", "block"), ("example.net/en/", "example.net", "/en/", "allow"),
    ("example.com/de/", "example.com", "/de/", "block"), ("org/fr/", "org", "/fr/", "allow"),
)
#: Words whose appearance as a part of a host name puts the host on the query's list.
LISTED_WORDS = ("adult", "bet", "casino", "dating", "jackpot", "pills", "poker", "porn", "replica", "slots", "win", "xxx")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, on, prefix, verdict in sorted(rules, key=lambda r: len(r[0])):
        fits = ((host == on) | F.endswith(host, F.lit("." + on))) & F.startswith(path, F.lit(prefix))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits).cast("bigint")) for i in range(HASHES)]


def bit_words(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One row: the level's bits as an array of 64-bit words. Bits of equal words meet map-side first."""
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("bit"))
    set_bits = at.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col("bit"), F.lit(64)).cast("int"))).alias("value"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"))
    filled = every.join(set_bits, "word", "left").select("word", F.coalesce("value", F.lit(0)).alias("value"))
    in_order = F.array_sort(F.collect_list(F.struct("word", "value")))
    return filled.agg(F.transform(in_order, lambda x: x["value"]).alias("words"))


def passes(key: Column, level: int, bits: int, words: Column) -> Column:
    hit = F.lit(True)
    for bit in _positions(key, level, bits):
        word = F.get(words, F.floor(bit / 64).cast("int"))
        hit = hit & (F.call_function("shiftrightunsigned", word, F.pmod(bit, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return hit


class Cascade:
    """Levels built from a universe of distinct keys with a boolean column listed."""

    def __init__(self, universe: DataFrame):
        self.levels: list[tuple[int, DataFrame]] = []
        left = {True: universe.where("listed").select("key"), False: universe.where("NOT listed").select("key")}
        encoded = True  # which side the next level holds
        while n := left[encoded].count():
            bits = max(64, -(-n * BITS // 64) * 64)
            if bits // 8 > MAX_BYTES:
                raise OverflowError(f"level {len(self.levels) + 1} needs {bits // 8} bytes; use listed_by_join")
            words = staged(bit_words(left[encoded], len(self.levels), bits), "bloom-level")
            self.levels.append((bits, words))
            # Of the other side, those that come through are the next level.
            other = left[not encoded]
            left[not encoded] = staged(
                other.where(passes(F.col("key"), len(self.levels) - 1, bits, words.scalar())), "bloom-through")
            encoded = not encoded

    def contains(self, key: Column) -> Column:
        """True exactly for the listed keys, if key is of the universe."""
        # Through all levels: the last holds the listed side if their number is odd.
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            bits, words = self.levels[level]
            answer = F.when(passes(key, level, bits, words.scalar()), answer).otherwise(F.lit(level % 2 == 1))
        return answer


def listed_by_join(table: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """table with the column listed, for lists whose filters would be too large to send."""
    marks = listed.select(F.col("key").alias(key)).distinct().withColumn("__listed", F.lit(True))
    return table.join(marks, key, "left").withColumn("listed", F.coalesce("__listed", F.lit(False))).drop("__listed")


def host_universe(pages: DataFrame) -> DataFrame:
    """Each host of pages once, with listed: a part of its name (between dots and hyphens) is one of LISTED_WORDS."""
    hosts = pages.select(host_and_path(F.col("url"))[0].alias("key")).where("key <> ''").distinct()
    parts = F.split("key", "[.-]")
    return hosts.select("key", F.arrays_overlap(parts, F.array(*map(F.lit, LISTED_WORDS))).alias("listed"))


def judge(pages: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages; universe (key, listed) must hold its hosts."""
    host, path = host_and_path(F.col("url"))
    hosts = staged(host_universe(pages) if universe is None else universe, "hosts")
    table = pages.select("page_id", host.alias("host"), path.alias("path"))
    try:
        listed = Cascade(hosts).contains(F.col("host"))
    except OverflowError:  # a level is too large to send
        table, listed = listed_by_join(table, hosts.where("listed"), "host"), F.col("listed")
    table = table.withColumn("found", longest_rule(F.col("host"), F.col("path")))
    by_list = F.when(listed, "block").otherwise("allow")
    return table.select("page_id", "host", "path", F.col("found.rule").alias("rule"),
                        F.coalesce(F.col("found.verdict"), by_list).alias("verdict"))


SQL = rf"""
WITH p AS (SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (SELECT * FROM (VALUES {", ".join(map(repr, RULES))}) AS v(rule, on_host, prefix, verdict)),
f AS (SELECT p.*, (SELECT arg_max(struct_pack(rule := rule, verdict := verdict), length(rule)) FROM r
        WHERE (host = on_host OR ends_with(host, '.' || on_host)) AND starts_with(path, prefix)) AS found FROM p)
SELECT page_id, host, path, found.rule AS rule, coalesce(found.verdict,
    CASE WHEN list_has_any(regexp_split_to_array(host, '[.-]'), {list(LISTED_WORDS)!r}) THEN 'block' ELSE 'allow' END) AS verdict FROM f
""".strip()
