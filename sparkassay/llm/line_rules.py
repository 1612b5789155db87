"""Line-first cleaning in built-in expressions: lines are judged first, then the document by what is left.

A line is removed if one of these holds; its words are runs without white space:
* punctuation: marks (# * $ % & | < > !) are at least 3 for every 10 words,
* navigation: at least two separators (| » · ›), and one for every 5 words or more,
* boilerplate: it has at most 30 words and one of PHRASES, or equals an earlier line of the text.
A document is kept if its base rules hold (20 words or more; at most 30 % of its words in eight-word windows that occur
twice) and its remaining lines hold at least half of its words.

Null and empty texts have no words: all counts 0, base_failed, not kept. Each row is judged alone, so repeated rows get equal
rows; other columns are not looked at. All work is inside the row: no shuffle, whatever the number of copies.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.storage import quoted

SPACE = " \t\n\x0b\f\r"
MIN_WORDS = 20
MAX_REPEATED = 30  # per cent
WINDOW = 8
MIN_LEFT = 50  # per cent of the words
#: Phrases of page furniture, lower case.
PHRASES = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies",
    "click here", "read more", "sign up", "log in", "subscribe to our newsletter", "share this", "back to top",
    "skip to content", "javascript is disabled", "powered by",
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "words_left", "clean")
_WORDS = r"[^\x20\x09-\x0D]+"


def _count(text: Column, characters: str) -> Column:
    """How many characters of text are among the given ones."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _measured(line: Column) -> Column:
    """Each figure once: a lambda's parts are evaluated as often as they are written."""
    return F.struct(
        line.alias("line"), F.regexp_count(line, F.lit(_WORDS)).alias("words"),
        _count(line, "#*$%&|<>!").alias("marks"), _count(line, "|»·›").alias("separators"))


def _line_fails(x: Column) -> Column:
    folded = F.lower(x["line"])
    phrase = functools.reduce(operator.or_, (F.contains(folded, F.lit(p)) for p in PHRASES))
    return (
        (x["marks"] * 10 >= x["words"] * 3)
        | ((x["separators"] >= 2) & (x["separators"] * 5 >= x["words"]))
        | ((x["words"] <= 30) & phrase))


def judged(docs: DataFrame) -> DataFrame:
    """docs with the struct column judgement: the base counts, clean (lines left), words_left, base_failed, kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    j = "__judged_"
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    words = F.when(trimmed != "", F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+")).otherwise(F.array().cast("array<string>"))
    windows = F.when(
        F.size(j + "words") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size(j + "words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(j + "words", i, WINDOW))))
    # Only texts with a repeated window pay for the sort; positions with equal hashes are then neighbours.
    repeats = F.when(
        F.size(F.array_distinct(j + "windows")) < F.size(j + "windows"),
        F.sort_array(F.transform(j + "windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))

    def seen_twice(x: Column, k: Column) -> Column:
        other = lambda at: F.coalesce(F.get(j + "repeats", at)["h"] == x["h"], F.lit(False))
        return other(k - 1) | other(k + 1)

    places = F.sort_array(F.transform(F.filter(j + "repeats", seen_twice), lambda x: x["i"]))
    # Windows that overlap the next repeated one count only the words before it.
    covered = F.aggregate(
        F.transform(j + "places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(j + "places", k + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda total, x: total + x)
    steps = [
        {"words": words, "lines": lines},
        {"windows": windows, "unique": F.array_distinct(j + "lines")},
        {"repeats": repeats, "measured": F.transform(j + "unique", _measured)},
        {"places": places, "clean": F.filter(j + "measured", lambda x: ~_line_fails(x))},
    ]
    for step in steps:
        docs = docs.withColumns({j + name: value for name, value in step.items()})
    long = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    docs = docs.withColumn(j + "counts", F.struct(
        long(F.size(j + "words")).alias("n_words"),
        (F.length(text) - _count(text, SPACE)).cast("long").alias("word_chars"),
        _count(text, "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size(j + "lines") - F.size(j + "unique")).cast("long").alias("n_dup_lines"),
        long(covered).alias("n_repeat_words"),
        long(F.aggregate(j + "clean", F.lit(0), lambda total, x: total + x["words"])).alias("words_left"),
        F.col(j + "clean")["line"].alias("clean")))
    c = F.col(j + "counts")
    failed = (c["n_words"] < MIN_WORDS) | (c["n_repeat_words"] * 100 > c["n_words"] * MAX_REPEATED)
    kept = ~failed & (c["words_left"] * 100 >= c["n_words"] * MIN_LEFT)
    temporary = [j + name for step in steps for name in step] + [j + "counts"]
    return docs.withColumn("judgement", F.struct(*(c[name].alias(name) for name in COUNTS), failed.alias("base_failed"), kept.alias("kept"))).drop(*temporary)


def measure(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, the base counts, base_failed, kept, words_left."""
    judgement = judged(docs.select("doc_id", "text"))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left")
    return judgement.select("doc_id", *(F.col("judgement")[c].alias(c) for c in columns))


def _kept(docs: DataFrame) -> DataFrame:
    """The kept rows of docs as a struct column row, so that no name of theirs can clash, with their judgement.

    The verdict goes through a one-element array: a filter on a generated column stays where it is, while one on the
    expression itself would be pushed below the steps and compute all of them again for each mention.
    """
    rows = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), "text")
    return judged(rows).withColumn("verdict", F.explode(F.array(F.col("judgement")["kept"]))).where("verdict")


def cleaned(docs: DataFrame) -> DataFrame:
    """The kept rows with their clean lines as text (joined by one line break); other columns as they were."""
    text = F.array_join(F.col("judgement")["clean"], "\n")
    return _kept(docs).select(*((text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns))


def keep_good(docs: DataFrame) -> DataFrame:
    """The kept rows, all columns as they were."""
    return _kept(docs).select(*(F.col("row")[c].alias(c) for c in docs.columns))


_MARKS = "length(regexp_replace(l, '[^#*$%&|<>!]', '', 'g'))"
_SEPARATORS = "length(regexp_replace(l, '[^|»·›]', '', 'g'))"
_LINE_WORDS = r"len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ') AS gram
      FROM w, unnest(range(1, len(words) - {WINDOW - 2})) AS u(i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, sum(least({WINDOW}, coalesce(next - i, {WINDOW}))) AS covered
      FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS next FROM r) GROUP BY rid),
m AS (SELECT w.rid, doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(covered, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(list_sum(list_transform(list_filter(list_distinct(lines), lambda l: NOT (
            {_MARKS} * 10 >= {_LINE_WORDS} * 3
            OR ({_SEPARATORS} >= 2 AND {_SEPARATORS} * 5 >= {_LINE_WORDS})
            OR ({_LINE_WORDS} <= 30 AND regexp_matches(lower(l), '{"|".join(PHRASES)}')))), lambda l: {_LINE_WORDS})), 0) AS BIGINT) AS words_left
      FROM w LEFT JOIN c USING (rid)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND words_left * 100 >= n_words * {MIN_LEFT} AS kept, words_left FROM f
""".strip()
