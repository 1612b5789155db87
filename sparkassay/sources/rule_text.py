"""Rule descriptions from tables, text files and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..functions import values as V
from ..plans.cells import ref

# --- fixed values: accepted column names --------------------------------------------------
RULE_COLUMNS = ("规则描述", "规则", "评判规则", "评价规则", "要求", "description", "rule", "user_intent")
METRIC_COLUMNS = ("指标id", "指标名称", "metric_id", "metric")
MAX_REQUEST_CHARS = 4000


def _column(df: DataFrame, names: tuple[str, ...]) -> str | None:
    known = {c.strip().casefold(): c for c in df.columns}
    return next((known[n] for n in names if n in known), None)


def _distinct_rules(rows: DataFrame) -> DataFrame:
    """First occurrence of each (description, metric); ``copies`` tells of dropped repeats."""
    return rows.where("description <> ''").groupBy("description", "metric").agg(
        F.min("place").alias("place"), (F.count(F.lit(1)) - 1).alias("copies"))


def rule_table(df: DataFrame, place: str) -> DataFrame:
    """Rules of a table with a description column and, optionally, a metric column."""
    rule, metric = _column(df, RULE_COLUMNS), _column(df, METRIC_COLUMNS)
    if rule is None:
        raise ValueError("no rule description column")
    return _distinct_rules(df.select(
        F.col(place).alias("place"), X.clean_rule_line(F.coalesce(F.col(ref(rule)).cast("string"), F.lit(""))).alias("description"),
        (F.nullif(V.strip(F.col(ref(metric)).cast("string")), F.lit("")) if metric else F.lit(None).cast("string")).alias("metric")))


def rule_lines(lines: DataFrame) -> DataFrame:
    """Rules of text files given as (path, line_number, line); fenced code and # lines are skipped.

    A rule file is small (2 MiB at most), which bounds the window over its lines.
    """
    fence = V.strip(F.col("line")).startswith("```")
    upto = W.partitionBy("path").orderBy("line_number").rowsBetween(W.unboundedPreceding, 0)
    marked = lines.select("*", fence.alias("fence"), F.sum(fence.cast("int")).over(upto).alias("fences"))
    body = marked.where(~F.col("fence") & (F.col("fences") % 2 == 0) & ~V.strip(F.col("line")).startswith("#"))
    return _distinct_rules(body.select(
        F.struct("path", "line_number").alias("place"), X.clean_rule_line(F.col("line")).alias("description"),
        F.lit(None).cast("string").alias("metric")))


def dialog_rules(texts: DataFrame, key: str, text: str) -> DataFrame:
    """One rule per distinct non-empty line of each text: (key, line_number, rule)."""
    rows = texts.select(F.col(key), F.posexplode(F.split(F.col(text), r"\r\n|\r|\n", -1)).alias("i", "line"))
    cleaned = rows.select(key, (F.col("i") + 1).alias("line_number"), X.clean_rule_line(F.col("line")).alias("rule"))
    return cleaned.where("rule <> ''").groupBy(key, "rule").agg(F.min("line_number").alias("line_number"))


def chat_rules(conversations: DataFrame, max_chars: int = MAX_REQUEST_CHARS) -> DataFrame:
    """All user turns of a conversation as one request: (conv_id, turns, request, problem).

    Lengths are summed first, so the text of a conversation longer than ``max_chars`` is never brought
    together; its request is null and the problem says so.
    """
    said = conversations.where(F.col("role") == "user")
    if "kind" in conversations.columns:
        said = said.where(F.coalesce("kind", F.lit("")) != "attachment")
    said = said.select("conv_id", "turn", V.strip(F.col("text")).alias("text")).where("text <> ''")
    sizes = said.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), (F.sum(F.char_length("text") + 1) - 1).alias("chars"))
    short = sizes.where(F.col("chars") <= max_chars).select("conv_id")
    parts = said.join(short, "conv_id", "left_semi").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("parts"))
    return sizes.join(parts, "conv_id", "left").select(
        "conv_id", "turns", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("request"),
        F.when(F.col("chars") > max_chars, f"the request is longer than {max_chars} characters").alias("problem"))
