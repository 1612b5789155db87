"""Column roles, decided from column names on the driver (no Spark job)."""

from __future__ import annotations

import re
from collections.abc import Iterable
from urllib.parse import quote

from . import fixed

_ROLES = {name: re.compile(text, re.IGNORECASE) for name, text in fixed.ROLE_PATTERNS.items()}
_IDENTIFIER = re.compile(fixed.IDENTIFIER_NAME, re.IGNORECASE)
_BOUNDARY = re.compile(fixed.CAMEL_BOUNDARY)


def normalize_field_name(name: object) -> str:
    return _BOUNDARY.sub(" ", str(name).strip())


def field_matches(role: str, name: object) -> bool:
    return _ROLES[role].search(normalize_field_name(name)) is not None


def columns_with(columns: Iterable[str], *roles: str, without: tuple[str, ...] = ()) -> list[str]:
    """Columns having any of ``roles`` and none of ``without``, in input order."""
    return [
        c for c in dict.fromkeys(columns)
        if any(field_matches(r, c) for r in roles)
        and not any(field_matches(r, c) for r in without)
    ]


def semantic_fields(columns: Iterable[str]) -> dict[str, list[str]]:
    cols = list(columns)
    return {
        "date": columns_with(cols, "date", "update", without=("url", "email")),
        "numeric": columns_with(cols, "numeric"),
        "url": columns_with(cols, "url"),
        "source": columns_with(cols, "source", "url", "source_id"),
        "version": columns_with(cols, "version", "update"),
    }


def content_columns(columns: Iterable[str]) -> list[str]:
    """Columns that carry content; identifier-looking names are left out."""
    cols = list(columns)
    return [c for c in cols if not _IDENTIFIER.match(c.strip())] or cols


def temporal_columns(columns: Iterable[str], *roles: str) -> list[str]:
    return columns_with(columns, *roles, without=("url", "email"))


def expected_format(name: str) -> str | None:
    """Format a column's name promises; the first matching role decides."""
    for label, roles in (
        ("url", ("url",)), ("email", ("email",)),
        ("datetime", ("date", "update")), ("numeric", ("numeric",)),
    ):
        if any(field_matches(r, name) for r in roles):
            return label
    return None


def metric_key(metric_id: str, field: str | None = None) -> str:
    if field is None:
        return f"metric:{metric_id}:dataset"
    return f"metric:{metric_id}:field:{quote(field, safe='')}"


def header_problems(columns: Iterable[object], max_chars: int = 160, max_names: int = 10) -> list[str]:
    """Duplicate header names, bounded in number and length for messages."""
    seen: set[str] = set()
    repeated: dict[str, None] = {}
    for name in map(str, columns):
        if name in seen:
            repeated[name] = None
        seen.add(name)
    return [n[:max_chars] for n in list(repeated)[:max_names]]
