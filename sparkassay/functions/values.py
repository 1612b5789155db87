"""Column builders for single cell values.

Every builder takes a ``Column`` and, where cells of different types behave differently, the
Spark data type of the column.  Builders of text take ``s``, the stripped text of the cell, where
the caller has it in a column already.  All expressions are built-ins, so they stay in generated
code.
"""

from __future__ import annotations

from functools import cache, reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed

TEXT = T.StringType()


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_flat(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def is_variant(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.VariantType)


# ------------------------------------------------------------------ text basics
def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` alone removes ASCII space only).

    Text that starts and ends with a printable ASCII character, by far the most common case, is
    returned as it is.
    """
    plain = F.left(c, F.lit(1)).between("!", "~") & F.right(c, F.lit(1)).between("!", "~")
    return F.when(plain, c).otherwise(F.btrim(c, F.lit(fixed.SPACE_CHARS)))


@cache
def _fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Where case folding differs from lower-casing, derived from the Unicode data of Python."""
    singles, multiples = [], []
    for point in range(0x80, 0x1FFFF):
        ch = chr(point)
        if 0xD800 <= point <= 0xDFFF:
            continue
        low, folded = ch.lower(), ch.casefold()
        if low == folded or low != ch:
            continue
        if len(folded) == 1:
            singles.append((ch, folded))
        else:
            multiples.append((ch, folded))
    return (
        "".join(a for a, _ in singles), "".join(b for _, b in singles), tuple(multiples),
    )


@cache
def _perhaps_special() -> str:
    """A class of characters with all those whose folding is not their lower case, in few ranges."""
    source, _, multiples = _fold_tables()
    points = sorted({ord(x) for x in source} | {ord(a) for a, _ in multiples if a != "ß"})
    starts = [points[0]] + [b for a, b in zip(points, points[1:]) if b - a > 0x80]
    ends = [a for a, b in zip(points, points[1:]) if b - a > 0x80] + [points[-1]]
    # Named by the ranges between them, the most common one first: a match ends at the first that fits.
    safe = zip([0] + [e + 1 for e in ends], [x - 1 for x in starts] + [0x10FFFF])
    return "[^" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in safe) + "]"


def casefold(c: Column) -> Column:
    """Full Unicode case folding: ``lower`` plus the characters where folding goes further."""
    source, target, multiples = _fold_tables()
    # The one expanding letter in wide use is replaced directly.  The other ones are first
    # turned into a mark by the same single pass that folds plain letters, and only text with
    # a mark is expanded letter by letter.
    low = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    rare = [(a, b) for a, b in multiples if a != "ß"]
    marked = F.translate(low, source + "".join(a for a, _ in rare), target + "\uffff" * len(rare))
    pairs = F.expr("array(" + ", ".join(f"named_struct('a', '{a}', 'b', '{b}')" for a, b in rare) + ")")
    expanded = F.aggregate(pairs, F.translate(low, source, target), lambda t, p: F.replace(t, p["a"], p["b"]))
    ascii_only = F.octet_length(c) == F.char_length(c)
    # Most text holds none of these letters; finding that out is far cheaper than translating it.
    special = low.rlike(_perhaps_special())
    return F.when(ascii_only, F.lower(c)).when(~special, low).when(marked.contains("\uffff"), expanded).otherwise(marked)


def as_text(c: Column, dtype: T.DataType) -> Column:
    """Cell as text; wall clock is kept for time stamps."""
    if is_text(dtype):
        return c
    if is_variant(dtype):
        return F.try_variant_get(c, "$", "string")
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    return c.cast("string")


# ------------------------------------------------------------------ missing values
def stripped(c: Column, dtype: T.DataType, s: Column | None = None) -> Column:
    return strip(as_text(c, dtype)) if s is None else s


def is_missing(c: Column, dtype: T.DataType = TEXT, s: Column | None = None) -> Column:
    if is_text(dtype):
        return c.isNull() | (stripped(c, dtype, s) == "")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    if is_variant(dtype):
        return F.coalesce(stripped(c, dtype, s) == "", F.lit(True))
    return c.isNull()


# ------------------------------------------------------------------ numbers
def _starts_like_number(s: Column) -> Column:
    # One byte decides for most text cells, before any regular expression runs.
    return F.left(s, F.lit(1)).isin(list("+-.0123456789iI"))


def to_double(c: Column, dtype: T.DataType = TEXT, s: Column | None = None) -> Column:
    """Number in a cell as double, +-Infinity included; null when the cell is not a number."""
    if isinstance(dtype, T.BooleanType) or is_temporal(dtype):
        return F.lit(None).cast("double")
    if is_number(dtype):
        d = c.cast("double")
        return F.when(~F.isnan(d), d)
    s = stripped(c, dtype, s)
    number = s.try_cast("double")
    return F.when(
        _starts_like_number(s),
        F.when(s.rlike(fixed.NUMBER_TEXT), F.when(F.abs(number) < F.lit(float("inf")), number))
        .when(F.lower(s).rlike(fixed.INFINITY_TEXT),
              F.when(s.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))),
    )


def is_finite(d: Column) -> Column:
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))


def is_finite_number(c: Column, dtype: T.DataType = TEXT) -> Column:
    return is_finite(to_double(c, dtype))


def _lossless(text: Column) -> Column:
    """Number text as decimal(38,18); null where that rounds.

    Rounding shows in the significant digits: without exponent, sign, point and outer zeros they are
    those of the text only if nothing was cut.
    """
    value = text.try_cast("decimal(38,18)")
    plain = F.regexp_replace(F.regexp_replace(text, "[eE].*$", ""), "[^0-9]", "")
    digits = lambda t: F.regexp_replace(F.regexp_replace(t, "^0+", ""), "0+$", "")
    kept = F.regexp_replace(value.cast("string"), "[eE].*$", "")
    return F.when(digits(plain) == digits(F.regexp_replace(kept, "[^0-9]", "")), value)


def parse_decimal(c: Column, dtype: T.DataType = TEXT, s: Column | None = None) -> Column:
    """Exact number as ``struct(exact decimal(38,18), wide double)``; null if not a finite number.

    ``wide`` is filled for every number, ``exact`` only where the decimal type holds it without
    rounding: one more place would be zero, and the double is not lost beside it.
    """
    if isinstance(dtype, T.BooleanType) or is_temporal(dtype):
        exact, wide = F.lit(None).cast("decimal(38,18)"), F.lit(None).cast("double")
    elif is_number(dtype):
        text = c.cast("string")
        exact, wide = _lossless(text), c.cast("double")
    else:
        s = F.replace(stripped(c, dtype, s), F.lit("_"), F.lit(""))
        ok = _starts_like_number(s) & s.rlike(fixed.NUMBER_TEXT)
        exact = F.when(ok, _lossless(s))
        wide = F.when(ok, s.try_cast("double"))
    return F.when(is_finite(wide), F.struct(exact.alias("exact"), wide.alias("wide")))


def _number_order(left: Column, right: Column) -> tuple[Column, Column]:
    """(left < right, left = right): exact where both fit the decimal type, else as doubles."""
    both = left["exact"].isNotNull() & right["exact"].isNotNull()
    lt = F.when(both, left["exact"] < right["exact"]).otherwise(left["wide"] < right["wide"])
    eq = F.when(both, left["exact"] == right["exact"]).otherwise(left["wide"] == right["wide"])
    return lt, eq


# ------------------------------------------------------------------ dates
# Accepted notations are rewritten to ``y-m-d`` by one linear chain of replacements, so that the
# generated code stays small; a clock and an offset may follow a full date.  Years are limited
# to those a nanosecond time stamp covers.
_YEAR = r"(?:16(?:7[89]|[89]\d)|1[7-9]\d\d|2[01]\d\d|22[0-5]\d|226[01])"
_DATE = rf"{_YEAR}(?:-\d{{1,2}}(?:-\d{{1,2}}(?:[ T]\d{{1,2}}:\d{{2}}(?::\d{{2}}(?:\.\d{{1,9}})?)?)?)?)?"
_ISO_TEXT = rf"^{_DATE}$"
_DATE_TEXT = rf"^({_DATE})\s*(?:(?<=:\d{{2}}(?:\.\d{{1,9}})?)\s*(?:Z|UTC|[+-]\d{{2}}:?\d{{2}}))?$"
_OTHER_TEXT = r"^(?:\d{8}|\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}/\d{1,2}/\d{4})(?:$|[ T])"
_REWRITES = (
    (r"^(\d{4})(\d{2})(\d{2})(?=$|[ T])", "$1-$2-$3"),
    (r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})(?=$|[ T])", "$1-$2-$3"),
    (r"^(0?[1-9]|1[0-2])/(\d{1,2})/(\d{4})(?=$|[ T])", "$3-$1-$2"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})(?=$|[ T])", "$3-$2-$1"),
)
_NAMED = r"(?i)^(?:(\d{1,2}) )?([a-z]{3})[a-z]*\.?,? (?:(\d{1,2}),? )?(\d{4})(?=$|[ T])"


def _parse_date_text(s: Column) -> Column:
    text = s
    for pattern, replacement in _REWRITES:
        text = F.regexp_replace(text, pattern, replacement)
    rewritten = F.regexp_extract(text, _DATE_TEXT, 1).try_cast("timestamp_ntz")
    month = F.instr(F.lit("".join(fixed.MONTH_NAMES)), F.lower(F.regexp_extract(s, _NAMED, 2)))
    named = F.concat(
        F.regexp_extract(s, _NAMED, 4), F.lit("-"),
        F.when(month % 3 == 1, ((month + 2) / 3).cast("int").cast("string")), F.lit("-"),
        F.regexp_extract(s, _NAMED, 1), F.regexp_extract(s, _NAMED, 3), F.regexp_replace(s, _NAMED, ""))
    named = F.regexp_extract(named, _DATE_TEXT, 1).try_cast("timestamp_ntz")
    # The first bytes keep ordinary text away from the regular expressions.
    digit = F.left(s, F.lit(1)).between("0", "9")
    word = F.lower(F.left(s, F.lit(3))).isin(list(fixed.MONTH_NAMES))
    return (
        F.when(digit & s.rlike(_ISO_TEXT), s.try_cast("timestamp_ntz"))
        .when(digit & s.rlike(_OTHER_TEXT), rewritten)
        .when((digit | word) & s.rlike(_NAMED), named))


def parse_datetime(c: Column, dtype: T.DataType = TEXT, s: Column | None = None) -> Column:
    """Date and time as ``timestamp_ntz`` (offsets dropped, wall clock kept), else null."""
    if is_temporal(dtype):
        return c.cast("timestamp_ntz")
    if isinstance(dtype, T.BooleanType):
        return F.lit(None).cast("timestamp_ntz")
    return _parse_date_text(stripped(c, dtype, s))


def parse_datetime_strict(c: Column, dtype: T.DataType = TEXT, s: Column | None = None) -> Column:
    """As :func:`parse_datetime`, but numbers and booleans are never dates."""
    if is_number(dtype):
        return F.lit(None).cast("timestamp_ntz")
    if is_variant(dtype):
        return F.when(F.schema_of_variant(c) == "STRING", parse_datetime(c, dtype, s))
    return parse_datetime(c, dtype, s)


# ------------------------------------------------------------------ logical types
def value_type(
    c: Column, dtype: T.DataType = TEXT, s: Column | None = None, number: Column | None = None,
) -> Column:
    """Logical type of one cell: boolean, datetime, numeric or text; null when missing."""
    missing = is_missing(c, dtype, s)
    if isinstance(dtype, T.BooleanType):
        return F.when(~missing, F.lit("boolean"))
    if is_number(dtype):
        return F.when(~missing, F.lit("numeric"))
    if is_temporal(dtype):
        return F.when(~missing, F.lit("datetime"))
    s = stripped(c, dtype, s)
    number = to_double(s, TEXT, s) if number is None else number
    kind = (
        F.when((F.octet_length(s) <= 8) & F.lower(s).isin(list(fixed.BOOLEAN_WORDS)), F.lit("boolean"))
        .when(number.isNotNull(), F.lit("numeric"))
        .when(F.left(s, F.lit(1)).between("0", "9") & s.rlike(fixed.DATE_SHAPE)
              & _parse_date_text(s).isNotNull(), F.lit("datetime"))
        .otherwise(F.lit("text"))
    )
    if is_variant(dtype):
        tag = F.schema_of_variant(c)
        kind = (
            F.when(tag == "BOOLEAN", F.lit("boolean"))
            .when(tag.isin("BIGINT", "DOUBLE", "FLOAT") | tag.startswith("DECIMAL"), F.lit("numeric"))
            .otherwise(kind)
        )
    return F.when(~missing, kind)


# ------------------------------------------------------------------ formats
def is_valid_url(c: Column, dtype: T.DataType = TEXT, s: Column | None = None) -> Column:
    s = stripped(c, dtype, s)
    authority = F.regexp_extract(s, r"(?i)^https?://([^/?#]*)", 1)
    opened, closed = authority.contains("["), authority.contains("]")
    return F.coalesce((authority != "") & (opened == closed), F.lit(False))


def is_valid_email(c: Column, dtype: T.DataType = TEXT, s: Column | None = None) -> Column:
    s = stripped(c, dtype, s)
    return F.coalesce(s.contains("@") & s.rlike(fixed.EMAIL_TEXT), F.lit(False))


def looks_structured(c: Column, s: Column | None = None) -> Column:
    """Text whose punctuation carries meaning: address, version or code."""
    s = strip(c) if s is None else s
    return F.coalesce(
        is_valid_url(s, TEXT, s) | is_valid_email(s, TEXT, s)
        | s.rlike(f"{fixed.VERSION_TEXT}|{fixed.CODE_TEXT}"),
        F.lit(False),
    )


def regex_fullmatch(c: Column, pattern: str, dtype: T.DataType = TEXT) -> Column:
    s = as_text(c, dtype)
    return (F.char_length(s) <= fixed.MAX_REGEX_INPUT) & s.rlike(rf"(?U)\A(?:{pattern})\z")


def code_point_length(c: Column, dtype: T.DataType = TEXT) -> Column:
    return F.char_length(as_text(c, dtype))


# ------------------------------------------------------------------ comparison keys
def exact_key(c: Column, dtype: T.DataType = TEXT) -> Column:
    """Type and value of a cell; NaN joins null as the one missing kind."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c + F.lit(0.0))
    if is_variant(dtype):
        text = F.try_variant_get(c, "$", "string")
        return F.when(text.isNotNull(), F.concat(F.schema_of_variant(c), F.lit(":"), text))
    return c


def normalized_key(
    c: Column, dtype: T.DataType, structured_name: bool = False,
    s: Column | None = None, kind: Column | None = None,
) -> Column:
    """Key that ignores case, white space and punctuation of natural text only."""
    if not (is_text(dtype) or is_variant(dtype)):
        return exact_key(c, dtype)
    s = stripped(c, dtype, s)
    exact = F.concat(F.lit("="), exact_key(c, dtype).cast("string"))
    if structured_name:
        return F.when(~is_missing(c, dtype, s), exact)
    natural = F.concat(F.lit("~"), F.regexp_replace(casefold(s), r"[^\p{L}\p{N}]+", ""))
    kind = value_type(c, dtype, s) if kind is None else kind
    return F.when(kind.isNotNull(), F.when((kind != "text") | looks_structured(s, s), exact).otherwise(natural))


def _shortest(text: Column) -> Column:
    """Decimal text without trailing zeros behind the point."""
    return F.when(F.contains(text, F.lit(".")) & ~F.lower(text).contains("e"),
                  F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")).otherwise(text)


def _decimal_text(c: Column, dtype: T.DataType) -> Column:
    """Exact text of a whole or decimal number, of its own scale: no narrowing cast."""
    if isinstance(dtype, T.DecimalType) and dtype.scale > 0:
        return F.regexp_replace(c.cast("string"), r"\.?0+$", "")
    return c.cast("string")


def comparison_key(c: Column, dtype: T.DataType = TEXT) -> Column:
    """Text key in which equal numbers agree, and cells of different classes never do."""
    if isinstance(dtype, T.BooleanType):
        return F.concat(F.lit("boolean:"), c.cast("string"))
    if is_number(dtype):
        return F.concat(F.lit("number:"), (c.cast("double") + F.lit(0.0)).cast("string")) if isinstance(
            dtype, (T.FloatType, T.DoubleType)) else F.concat(F.lit("number:"), _decimal_text(c, dtype))
    if is_temporal(dtype):
        return F.concat(F.lit("datetime:"), c.cast("timestamp_ntz").cast("string"))
    if is_variant(dtype):
        tag = F.schema_of_variant(c)
        return (
            F.when(tag == "BOOLEAN", F.concat(F.lit("boolean:"), F.try_variant_get(c, "$", "string")))
            .when(tag == "STRING", F.concat(F.lit("text:"), F.try_variant_get(c, "$", "string")))
            # Whole numbers keep all digits: as doubles those above 2^53 would meet.
            .when(F.startswith(tag, F.lit("BIGINT")) | F.startswith(tag, F.lit("DECIMAL")),
                  F.concat(F.lit("number:"), _shortest(F.try_variant_get(c, "$", "string"))))
            .when(tag != "VOID", F.concat(F.lit("number:"), _shortest((
                F.try_variant_get(c, "$", "double") + F.lit(0.0)).cast("string"))))
        )
    return F.concat(F.lit("text:"), c)


def matches_any(c: Column, dtype: T.DataType, values: list) -> Column:
    """Cell equals one of the given Python values of the same class (true never equals 1)."""
    flags = [v for v in values if isinstance(v, bool)]
    numbers = [v for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
    texts = [v for v in values if isinstance(v, str)]
    if isinstance(dtype, T.BooleanType):
        hit = c.isin(flags) if flags else F.lit(False)
    elif is_number(dtype):
        hit = c.isin(numbers) if numbers else F.lit(False)
    elif is_variant(dtype):
        tag, parts = F.schema_of_variant(c), []
        if flags:
            parts.append((tag == "BOOLEAN") & F.try_variant_get(c, "$", "boolean").isin(flags))
        if texts:
            parts.append((tag == "STRING") & F.try_variant_get(c, "$", "string").isin(texts))
        if numbers:
            parts.append(~tag.isin("BOOLEAN", "STRING", "VOID")
                         & F.try_variant_get(c, "$", "double").isin([float(n) for n in numbers]))
        hit = reduce(or_, parts, F.lit(False))
    elif is_text(dtype):
        hit = c.isin(texts) if texts else F.lit(False)
    else:
        hit = F.lit(False)
    return F.coalesce(hit, F.lit(False))


def compare_parsed(
    operator: str, kind: str, present: Column, numbers: tuple[Column, Column],
    dates: tuple[Column, Column], texts: tuple[Column, Column],
) -> Column:
    """Typed comparison of two parsed cells; null when a side cannot be read as the wanted kind.

    ``auto`` reads each side as number, else date, else text; sides of different classes do
    not satisfy any operator.
    """
    def outcome(lt: Column, eq: Column) -> Column:
        return {
            "lt": lt, "lte": lt | eq, "gt": ~(lt | eq), "gte": ~lt, "eq": eq, "neq": ~eq,
        }[operator]

    (ln, rn), (ld, rd), (lt, rt) = numbers, dates, texts
    if kind == "numeric":
        return F.when(present & ln.isNotNull() & rn.isNotNull(), outcome(*_number_order(ln, rn)))
    if kind == "datetime":
        return F.when(present & ld.isNotNull() & rd.isNotNull(), outcome(ld < rd, ld == rd))
    if kind == "text":
        return F.when(present, outcome(lt < rt, lt == rt))
    return F.when(
        present,
        F.when(ln.isNotNull() & rn.isNotNull(), outcome(*_number_order(ln, rn)))
        .when(ln.isNotNull() | rn.isNotNull(), F.lit(False))
        .when(ld.isNotNull() & rd.isNotNull(), outcome(ld < rd, ld == rd))
        .when(ld.isNotNull() | rd.isNotNull(), F.lit(False))
        .otherwise(outcome(lt < rt, lt == rt)),
    )


def all_of(parts: list[Column]) -> Column:
    return reduce(and_, parts, F.lit(True))


def any_of(parts: list[Column]) -> Column:
    return reduce(or_, parts, F.lit(False))


def round_value(c: Column) -> Column:
    """Six places, half to even: the precision of every reported metric."""
    return F.bround(c, 6)
