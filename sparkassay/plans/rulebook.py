"""Business rules as data: building, checking and combining them (driver side, at most 100 rules)."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation

from ..functions import names
from .catalog import RULE_TYPES, fillable_by

# --- fixed values: limits and accepted words ---------------------------------------------
MAX_RULES = 100
MAX_KEY_FIELDS = 5
MAX_LIST_VALUES = 100
MAX_VALUE_CHARS = 500
MAX_PATTERN_CHARS = 200
MAX_LENGTH = 10_000
MAX_AGE_DAYS = 3660
FREQUENCIES = ("daily", "weekly", "monthly", "quarterly", "yearly", "custom")
OPERATORS = ("lt", "lte", "gt", "gte", "eq", "neq")
COMPARISONS = ("auto", "numeric", "datetime", "text")
PARAMETERS = {
    "primary_key": (),
    "required": (),
    "update_freshness": ("frequency", "max_age_days"),
    "allowed_values": ("allowed_values",),
    "numeric_range": ("minimum", "maximum"),
    "regex_format": ("pattern",),
    "string_length": ("minimum", "maximum"),
    "conditional_required": ("condition_values",),
    "field_comparison": ("operator", "comparison_type"),
}
FIELD_COUNTS = {"primary_key": (1, MAX_KEY_FIELDS), "conditional_required": (2, 2), "field_comparison": (2, 2)}


def canonical_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def content_id(prefix: str, value, length: int = 20) -> str:
    return f"{prefix}-{hashlib.sha256(canonical_json(value).encode()).hexdigest()[:length]}"


@dataclass(frozen=True)
class Rule:
    type: str
    fields: tuple[str, ...]
    parameters: Mapping = field(default_factory=dict)
    target: str | None = None  # catalog metric this rule may fill

    @property
    def rule_id(self) -> str:
        """Content hash: equal rules have equal ids."""
        return content_id(
            self.type,
            {"rule_type": self.type, "fields": list(self.fields), "parameters": dict(self.parameters)}, 12)

    def get(self, name: str, default=None):
        return self.parameters.get(name, default)


def rule_from_dict(payload: Mapping) -> Rule:
    """A rule from one row or JSON object with ``rule_type``, ``fields`` and ``parameters``."""
    fields, parameters = payload["fields"], payload.get("parameters") or {}
    if isinstance(parameters, str):
        parameters = json.loads(parameters)
    if isinstance(fields, str) or not all(isinstance(f, str) for f in fields):
        raise ValueError("fields must be a list of column names")
    return Rule(str(payload["rule_type"]), tuple(fields), dict(parameters), payload.get("target"))


def pack_id(rules: Iterable[Rule], **context) -> str:
    body = [{"type": r.type, "fields": list(r.fields), "parameters": dict(r.parameters), "target": r.target}
            for r in rules]
    return content_id("rulepack", {"rules": body, **context})


# ------------------------------------------------------------------ validation
def _constructs(pattern: str) -> set[str]:
    """What one walk over the pattern meets: "special" groups or references, "nested" open-ended repeats."""
    met: set[str] = set()
    groups: list[bool] = []  # of the open groups: does it hold an open-ended repeat
    repeated_before = in_class = False  # the item just read is a group with such a repeat
    at = 0
    while at < len(pattern):
        char, following = pattern[at], pattern[at + 1 : at + 2]
        closed = False
        if char == "\\":
            if not in_class and (following in set("123456789") or pattern[at + 1 : at + 3] in ("g<", "k<")):
                met.add("special")
            at += 1
        elif in_class:
            in_class = char != "]"
        elif char == "[":
            in_class = True
        elif char == "(":
            if following == "?":
                met.add("special")
            groups.append(False)
        elif char == ")" and groups:
            closed = groups.pop()
            if groups and closed:
                groups[-1] = True
        elif char in "+*":
            if repeated_before:
                met.add("nested")
            if groups:
                groups[-1] = True
        repeated_before = closed
        at += 1
    return met


def regex_problems(pattern) -> list[str]:
    """Only classes, groups and plain quantifiers are accepted."""
    if not isinstance(pattern, str) or not pattern:
        return ["pattern must be a non-empty string"]
    met = _constructs(pattern)
    found = {
        f"pattern exceeds {MAX_PATTERN_CHARS} characters": len(pattern) > MAX_PATTERN_CHARS,
        "look-around, special groups and back references are not supported": "special" in met,
        "nested quantifiers are not supported": "nested" in met,
    }
    problems = [text for text, is_so in found.items() if is_so]
    try:
        re.compile(pattern)
    except re.error as error:
        problems.append(f"pattern does not compile: {error}")
    return problems


def _number(value) -> Decimal | None:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    try:
        number = Decimal(str(value))
    except InvalidOperation:
        return None
    return number if number.is_finite() else None


def _comparable(value) -> tuple | None:
    """How a listed value compares with cells: as a truth value, a number whatever its notation, or text."""
    if isinstance(value, (bool, str)):
        return type(value).__name__, value
    number = _number(value)
    return None if number is None else ("number", number)


def _list_problems(label: str, items) -> list[str]:
    items = list(items or ())
    classes = [_comparable(v) for v in items]
    known = [c for c in classes if c is not None]
    texts = [v for v in items if isinstance(v, str)] if label == "allowed_values" else []
    found = {
        f"{label} must hold 1 to {MAX_LIST_VALUES} values": not 1 <= len(items) <= MAX_LIST_VALUES,
        f"text values must have 1 to {MAX_VALUE_CHARS} characters": any(not t.strip() or len(t) > MAX_VALUE_CHARS for t in texts),
        "values must be finite numbers, text or booleans": None in classes,
        f"{label} repeats a value": len(set(known)) < len(known),
    }
    return [problem for problem, there in found.items() if there]


def _bounds_problems(rule: Rule) -> list[str]:
    low, high = rule.get("minimum"), rule.get("maximum")
    if low is None and high is None:
        return ["at least one bound is needed"]
    problems = []
    if rule.type == "string_length":
        for v in (low, high):
            if v is not None and (isinstance(v, bool) or not isinstance(v, int) or not 0 <= v <= MAX_LENGTH):
                problems.append(f"length bounds must be integers from 0 to {MAX_LENGTH}")
    else:
        problems += ["bounds must be finite numbers" for v in (low, high) if v is not None and _number(v) is None]
    if not problems and low is not None and high is not None and _number(low) > _number(high):
        problems.append("minimum exceeds maximum")
    return problems


def rule_problems(rule: Rule, types: Mapping[str, str]) -> list[str]:
    """Everything wrong with one rule; ``types`` maps columns to inferred logical types."""
    if rule.type not in RULE_TYPES:
        return [f"unknown rule type {rule.type}"]
    problems = []
    low, high = FIELD_COUNTS.get(rule.type, (1, 1))
    if not low <= len(rule.fields) <= high:
        problems.append(f"{rule.type} needs {low} to {high} fields")
    if len(set(rule.fields)) != len(rule.fields):
        problems.append("a field is named twice")
    problems += [f"unknown field {f}" for f in rule.fields if f not in types]
    problems += [f"parameter {p} does not belong to {rule.type}"
                 for p in rule.parameters if p not in PARAMETERS[rule.type]]

    def wants(kind: str):
        return [f"field {f} is not {kind}" for f in rule.fields if f in types and types[f] != kind]

    if rule.type == "update_freshness":
        days = rule.get("max_age_days")
        if rule.get("frequency") not in FREQUENCIES:
            problems.append("unknown frequency")
        if isinstance(days, bool) or not isinstance(days, int) or not 1 <= days <= MAX_AGE_DAYS:
            problems.append(f"max_age_days must be 1 to {MAX_AGE_DAYS}")
        if wants("datetime") and not names.temporal_columns(rule.fields, "date", "update"):
            problems += wants("datetime")
    elif rule.type == "allowed_values":
        problems += _list_problems("allowed_values", rule.get("allowed_values"))
    elif rule.type == "conditional_required":
        problems += _list_problems("condition_values", rule.get("condition_values"))
    elif rule.type == "numeric_range":
        problems += _bounds_problems(rule) + wants("numeric")
    elif rule.type == "string_length":
        problems += _bounds_problems(rule)
    elif rule.type == "regex_format":
        problems += regex_problems(rule.get("pattern"))
    elif rule.type == "field_comparison":
        kind = rule.get("comparison_type", "auto")
        if rule.get("operator") not in OPERATORS:
            problems.append("unknown operator")
        if kind not in COMPARISONS:
            problems.append("unknown comparison type")
        if kind in ("numeric", "datetime"):
            problems += wants(kind)
    return problems


def pack_problems(rules: list[Rule], types: Mapping[str, str], open_targets: Iterable[str]) -> list[str]:
    """Checks across a set of rules; ``open_targets`` are catalog metrics still without a value."""
    problems = [f"{r.rule_id}: {p}" for r in rules for p in rule_problems(r, types)]
    if not 1 <= len(rules) <= MAX_RULES:
        problems.append(f"a pack holds 1 to {MAX_RULES} rules")
    ids = [r.rule_id for r in rules]
    problems += [f"rule {i} occurs twice" for i in sorted({i for i in ids if ids.count(i) > 1})]
    for kind in ("primary_key", "update_freshness"):
        if sum(r.type == kind for r in rules) > 1:
            problems.append(f"more than one {kind} rule")
    shapes = [(r.type, r.fields) for r in rules]
    problems += [f"{t} on {', '.join(f)} occurs twice"
                 for t, f in sorted({s for s in shapes if shapes.count(s) > 1})]
    filled = [r.target for r in rules if r.target]
    problems += [f"metric {t} is filled twice" for t in sorted({t for t in filled if filled.count(t) > 1})]
    for r in rules:
        if r.target and r.type not in fillable_by(r.target):
            problems.append(f"{r.type} cannot fill {r.target}")
        if r.target and r.target not in set(open_targets):
            problems.append(f"{r.target} is not selected or already has a value")
    return problems


def combine_rules(batches: Iterable[Iterable[Rule]]) -> list[Rule]:
    """Union of rule sets, equal rules once.  All or nothing: conflicting targets are an error."""
    merged: dict[str, Rule] = {}
    for rule in (r for batch in batches for r in batch):
        known = merged.setdefault(rule.rule_id, rule)
        if known.target != rule.target:
            raise ValueError(f"rule {rule.rule_id} is bound to different metrics")
    if not 1 <= len(merged) <= MAX_RULES:
        raise ValueError(f"a pack holds 1 to {MAX_RULES} rules")
    return list(merged.values())


def field_roles(rules: Iterable[Rule]) -> dict[str, list[str]]:
    """Which columns the rules treat as key, required, categorical, and so on."""
    label = {
        "primary_key": "key", "required": "required", "update_freshness": "update_time",
        "allowed_values": "categorical", "numeric_range": "numeric", "regex_format": "formatted",
        "string_length": "length_checked", "conditional_required": "conditionally_required",
        "field_comparison": "compared",
    }
    roles: dict[str, dict[str, None]] = {v: {} for v in label.values()}
    for r in rules:
        used = r.fields[1:] if r.type == "conditional_required" else r.fields
        roles[label[r.type]].update(dict.fromkeys(used))
    return {k: list(v) for k, v in roles.items()}


def suggest_rules(types: Mapping[str, str]) -> dict[str, list[str]]:
    """Candidate columns per rule type, from names and inferred types."""
    columns = list(types)
    dates = names.semantic_fields(columns)["date"]
    return {
        "primary_key": [c for c in columns if c not in names.content_columns([*columns, " "])],
        "required": columns,
        "update_freshness": list(dict.fromkeys([*dates, *(c for c in columns if types[c] == "datetime")])),
        "numeric_range": [c for c in columns if types[c] == "numeric"],
    }
