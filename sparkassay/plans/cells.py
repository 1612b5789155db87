"""Row-local features of a table, each computed once per row and shared by all metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V


def ref(name: str) -> str:
    """A column reference that is safe for any column name."""
    return "`" + name.replace("`", "``") + "`"


def schema_types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def flat_columns(df: DataFrame) -> list[str]:
    """Columns the engine assesses; nested and binary columns are left out."""
    return [f.name for f in df.schema.fields if V.is_flat(f.dataType)]


class Cells:
    """Registry of derived cell columns for one table.

    Metrics and rules ask for features ("is this cell missing", "its date") and get a column
    back.  :meth:`project` adds all of them below the aggregate in a few projections, each
    building on the one before (stripped text, then numbers and dates, then types), so a feature
    that several metrics or later features use is evaluated once per row.

    A feature of text columns is one ``transform`` over an array of the cells that need it: the
    generated code has the same size for five columns and for fifty, and stays compilable.
    """

    _STAGES = (("text",), ("number", "decimal", "date", "date_strict", "url", "email"), ("kind",))
    _BUILD = {
        "text": lambda s: V.strip(s),
        "number": lambda s: V.to_double(s, V.TEXT, s),
        "decimal": lambda s: V.parse_decimal(s, V.TEXT, s),
        "date": lambda s: V.parse_datetime(s, V.TEXT, s),
        "date_strict": lambda s: V.parse_datetime(s, V.TEXT, s),
        "url": lambda s: V.is_valid_url(s, V.TEXT, s),
        "email": lambda s: V.is_valid_email(s, V.TEXT, s),
        "kind": lambda s, n: V.value_type(s, V.TEXT, s, n),
    }
    _PLAIN = {
        "number": V.to_double, "decimal": V.parse_decimal, "date": V.parse_datetime,
        "date_strict": V.parse_datetime_strict, "url": V.is_valid_url, "email": V.is_valid_email,
        "kind": V.value_type,
    }

    def __init__(self, df: DataFrame):
        self.df = df
        self.columns = flat_columns(df)
        self.types = schema_types(df)
        self._batches: dict[str, list[str]] = {}

    def raw(self, column: str) -> tuple[Column, T.DataType]:
        return F.col(ref(column)), self.types[column]

    def _feature(self, feature: str, column: str) -> Column:
        c, dtype = self.raw(column)
        if not V.is_text(dtype):
            return self._PLAIN[feature](c, dtype)
        if feature != "text":
            self.text(column)
        if feature == "kind":
            self.number(column)
        members = self._batches.setdefault(feature, [])
        if column not in members:
            members.append(column)
        return F.get(F.col(f"__cells_{feature}"), F.lit(members.index(column)))

    def text(self, column: str) -> Column | None:
        """Stripped text of a cell; None for columns that hold no text."""
        c, dtype = self.raw(column)
        if V.is_variant(dtype):
            return V.stripped(c, dtype)
        return self._feature("text", column) if V.is_text(dtype) else None

    def missing(self, column: str) -> Column:
        c, dtype = self.raw(column)
        return V.is_missing(c, dtype, self.text(column))

    def number(self, column: str) -> Column:
        return self._feature("number", column)

    def decimal(self, column: str) -> Column:
        return self._feature("decimal", column)

    def date(self, column: str) -> Column:
        return self._feature("date", column)

    def date_strict(self, column: str) -> Column:
        return self._feature("date_strict", column)

    def kind(self, column: str) -> Column:
        return self._feature("kind", column)

    def valid(self, column: str, expected: str) -> Column:
        if expected == "datetime":
            return self.date(column).isNotNull()
        if expected == "numeric":
            return V.is_finite(self.number(column))
        return self._feature(expected, column)

    def compared(self, left: str, right: str, operator: str, kind: str = "auto") -> Column:
        """Outcome of comparing two columns, built on their parsed values."""
        (lc, lt), (rc, rt) = self.raw(left), self.raw(right)
        none = (F.lit(None), F.lit(None))
        return V.compare_parsed(
            operator, kind, ~self.missing(left) & ~self.missing(right),
            (self.decimal(left), self.decimal(right)) if kind in ("auto", "numeric") else none,
            (self.date_strict(left), self.date_strict(right)) if kind in ("auto", "datetime") else none,
            (V.as_text(lc, lt), V.as_text(rc, rt)))

    def _batch(self, feature: str) -> Column:
        members, build = self._batches[feature], self._BUILD[feature]
        if feature == "text":
            return F.transform(F.array(*[F.col(ref(c)) for c in members]), build)
        texts = F.array(*[self.text(c) for c in members])
        if feature == "kind":
            return F.zip_with(texts, F.array(*[self.number(c) for c in members]), build)
        return F.transform(texts, build)

    def project(self, df: DataFrame | None = None) -> DataFrame:
        out = self.df if df is None else df
        for stage in self._STAGES:
            wanted = [f for f in stage if f in self._batches]
            if wanted:
                out = out.select("*", *[self._batch(f).alias(f"__cells_{f}") for f in wanted])
        return out
