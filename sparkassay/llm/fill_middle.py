"""Fill-in-middle texts, cut at unit boundaries that a compressed set of positions selects.

Units are runs of Latin letters and single other characters. The set holds the last character's position of each unit. Like a Roaring set it
keeps one container for every 65,536 positions, of the kind that takes least room: an array of positions, a bitmap, or runs of neighbours.
Cumulative cardinalities lead from a unit's number to its container by bisection; the container then selects within itself. A text is read in
stretches of one container, so beside the text little memory is used however long it is.

The output holds the parts behind marks; a text that holds a mark itself stays as it is, so that the parts can always be told apart again.

Null texts count as empty and stay so: no units, form plain, output empty. A null doc_id is drawn by the text ``1:`` alone. Equal rows get equal
results; an empty table gives none. Other columns of docs, whatever their names, are not looked at.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPAN = 1 << 16  # positions of a container
PLAIN_FROM = 90  # of 100 draws, those from here on stay plain
SPM_BELOW = 20  # of 100 draws, those below begin with the suffix
#: The same rows in DuckDB SQL.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT doc_id, text, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle,
  array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256 FROM p
"""
_CUTS = "n bigint, first bigint, second bigint"


class _Array:
    """Positions in ascending order."""

    def __init__(self, members: np.ndarray):
        self._positions = np.flatnonzero(members).astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self._positions[k])


class _Bitmap:
    """One bit for each position, with the members before each word of 64."""

    def __init__(self, members: np.ndarray):
        bits = np.zeros(SPAN // 8, np.uint8)
        packed = np.packbits(members, bitorder="little")
        bits[: len(packed)] = packed
        self._words = bits.view("<u8")
        self._before = np.concatenate(([0], np.cumsum(np.bitwise_count(self._words), dtype=np.int64)))

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self._before, k, "right")) - 1
        bits = int(self._words[word])
        for _ in range(k - int(self._before[word])):
            bits &= bits - 1  # without its lowest member
        return 64 * word + (bits & -bits).bit_length() - 1


class _Runs:
    """Starts of runs of neighbours, with the members before each."""

    def __init__(self, members: np.ndarray):
        edges = np.flatnonzero(np.diff(members.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
        self._starts = edges[:, 0].astype(np.uint16)
        self._before = np.concatenate(([0], np.cumsum(edges[:, 1] - edges[:, 0])))

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self._before, k, "right")) - 1
        return int(self._starts[run]) + k - int(self._before[run])


def container(members: np.ndarray) -> _Array | _Bitmap | _Runs:
    """The smallest of the three for at most SPAN positions."""
    count = int(np.count_nonzero(members))
    runs = int(members[0]) + int(np.count_nonzero(members[1:] & ~members[:-1]))
    sizes = {_Array: 2 * count, _Bitmap: SPAN // 8, _Runs: 4 * runs}
    return min(sizes, key=sizes.get)(members)


class Boundaries:
    """The positions of units' last characters in a text."""

    def __init__(self, text: str):
        self._containers, self._before = [], [0]
        for at in range(0, len(text), SPAN):
            codes = np.frombuffer(text[at : at + SPAN + 1].encode("utf-32-le"), "<u4")
            letter = ((codes | 32) - np.uint32(97)) < 26
            length = min(SPAN, len(text) - at)
            ends = np.ones(length, bool)
            within = min(length, len(letter) - 1)
            ends[:within] = ~(letter[:within] & letter[1 : within + 1])
            self._containers.append(container(ends))
            self._before.append(self._before[-1] + int(np.count_nonzero(ends)))

    def __len__(self) -> int:
        return self._before[-1]

    def after(self, units: int) -> int:
        """Characters of the first so many units."""
        if units == 0:
            return 0
        k = units - 1
        at = bisect_right(self._before, k) - 1
        return SPAN * at + self._containers[at].select(k - self._before[at]) + 1


def _cuts(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    out = []
    for text, a, b in zip(texts, one.to_pylist(), two.to_pylist(), strict=True):
        ends = Boundaries(text.as_py())
        n = len(ends)
        first, second = sorted((a % (n + 1), b % (n + 1)))
        out.append((n, ends.after(first), ends.after(second)))
    table = np.array(out, np.int64).reshape(-1, 3)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(table[:, i])) for i in range(3)], ["n", "first", "second"])


def transform(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the output text of every row of docs (doc_id, text)."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *draws)
    rows = rows.select("doc_id", "text", "h3", "h4", F.arrow_udf(_cuts, _CUTS)("text", "h1", "h2").alias("cut"))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= PLAIN_FROM), "plain").when(
        F.col("h4") % 100 < SPM_BELOW, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", form.alias("form"), "cut.*")
    whole, first, second = F.col("text"), F.col("first").cast("int"), F.col("second").cast("int")
    prefix = F.substring(whole, F.lit(1), first)
    middle = F.substring(whole, first + 1, second - first)
    suffix = F.substring(whole, second + 1, F.length(whole))
    output = F.when(F.col("form") == "plain", whole).when(
        F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(
        F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    cut = F.col("form") != "plain"
    return rows.select("doc_id", "n", "form", F.when(cut, F.col("first")).alias("prefix_chars"),
                       F.when(cut, F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output"))


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of. No mark overlaps itself, so the first one found is the one that was put there."""
    step = len(PREFIX)
    second = F.when(form == "spm", F.locate(PREFIX, output, step + 1)).otherwise(F.locate(SUFFIX, output, step + 1))
    one = F.substring(output, F.lit(step + 1), second - step - 1)
    rest = F.substring(output, second + step, F.length(output))
    third = F.locate(MIDDLE, rest)
    two, middle = F.substring(rest, F.lit(1), third - 1), F.substring(rest, third + step, F.length(rest))
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))


def digest(docs: DataFrame) -> DataFrame:
    """As transform, with hashes of the output and of the text rebuilt from it instead of the output."""
    made = transform(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))
