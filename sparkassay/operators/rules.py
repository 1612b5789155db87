"""Business rules compiled to Spark expressions.

Every row-local rule becomes a pair (applicable, violation); all of them run in one aggregate.
Only the primary key needs a grouped pass.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions import values as V
from ..plans.catalog import RULE_METRICS
from ..plans.cells import Cells, ref, schema_types
from ..plans.probes import (
    Probe, Violation, evidence_json, literal_empty, metric_row, ratio, run_probes, union_all,
)
from ..plans.rulebook import Rule
from ..plans.skew import HOT_ROWS, digest, join_back
from .locate import RN, locate, with_record_number

PARSEABILITY = "business_update_time_parseability"

# --- fixed values: names of the rule metrics ------------------------------------------------
METRIC_NAMES = {
    "business_primary_key_compliance": "主键完整且唯一符合率",
    "business_required_compliance": "必填符合率",
    PARSEABILITY: "指定更新时间可解析率",
    "business_update_frequency_compliance": "更新频率符合性",
    "business_allowed_values_compliance": "允许值符合率",
    "business_numeric_range_compliance": "数值范围符合率",
    "business_regex_format_compliance": "格式符合率",
    "business_string_length_compliance": "字符长度符合率",
    "business_conditional_required_compliance": "条件必填符合率",
    "business_field_comparison_compliance": "跨字段比较符合率",
}
NO_ROWS = "数据集不包含记录，无法评估业务规则。"
NO_VALUES = "字段没有非缺失值，无法评估业务规则。"
NO_ACTIVE = "没有记录满足条件必填规则的触发条件，无法评估。"
NO_DATES = "指定更新时间字段没有可解析值，无法计算更新滞后与频率符合性。"

DATASET_SCOPE = ("primary_key", "field_comparison")


def rule_metric_key(rule: Rule, metric_id: str | None = None) -> str:
    metric_id = metric_id or RULE_METRICS[rule.type]
    if rule.type in DATASET_SCOPE:
        return names.metric_key(metric_id)
    return names.metric_key(metric_id, rule.fields[-1])


def rule_metric_keys(rules: list[Rule]) -> list[tuple[str, str, str, str | None]]:
    """(metric_key, rule_id, rule_type, target) of every metric the rules produce."""
    rows = []
    for r in rules:
        rows.append((rule_metric_key(r), r.rule_id, r.type, r.target))
        if r.type == "update_freshness":
            rows.append((rule_metric_key(r, PARSEABILITY), r.rule_id, r.type, None))
    return rows


def _row(rule: Rule, position: int, metric_id: str | None = None, **kw) -> Column:
    metric_id = metric_id or RULE_METRICS[rule.type]
    scope = "dataset" if rule.type in DATASET_SCOPE else "field"
    return metric_row(
        metric_id, name=METRIC_NAMES[metric_id], category="业务规则", unit="ratio", scope=scope,
        field_name=None if scope == "dataset" else rule.fields[-1], position=1000 + position,
        key=rule_metric_key(rule, metric_id), **kw)


def _compliance(
    rule: Rule, i: int, applicable: Column | None, violation: Column, issue_type: str | Column,
    blockers, fields: list[str] | None = None, **evidence,
) -> Probe:
    total, n, m = f"rule_{i}_rows", f"rule_{i}_checked", f"rule_{i}_issues"
    hit = violation if applicable is None else applicable & violation
    agg = {total: F.count(F.lit(1)), m: F.count_if(hit)}
    if applicable is not None:
        agg[n] = F.count_if(applicable)
    rows, issues = F.col(total), F.col(m)
    checked = rows if applicable is None else F.col(n)
    return Probe(agg, _row(
        rule, i, value=ratio(checked - issues, checked), checked=checked, issues=issues,
        evidence=evidence_json(rule_id=rule.rule_id, rule_type=rule.type, checked_count=checked,
                               compliant_count=checked - issues, issue_count=issues, **evidence),
        blockers=[(condition(rows, checked), text) for condition, text in blockers]),
        [Violation(rule_metric_key(rule), issue_type, fields or list(rule.fields), hit)])


_EMPTY = (lambda rows, checked: rows == 0, NO_ROWS)
_NONE_PRESENT = (lambda rows, checked: checked == 0, NO_VALUES)


def _required(cells: Cells, rule: Rule, i: int, ref_date: dt.date) -> list[Probe]:
    return [_compliance(rule, i, None, cells.missing(rule.fields[0]), "rule_required_missing", [_EMPTY])]


def _freshness(cells: Cells, rule: Rule, i: int, ref_date: dt.date) -> list[Probe]:
    stamp = cells.date_strict(rule.fields[0])
    rows, ok, latest = f"rule_{i}_rows", f"rule_{i}_parsed", f"rule_{i}_latest"
    n, parsed = F.col(rows), F.col(ok)
    lag = F.datediff(F.lit(ref_date), F.col(latest).cast("date"))
    fresh = lag.between(0, rule.get("max_age_days"))
    agg = {rows: F.count(F.lit(1)), ok: F.count(stamp), latest: F.max(stamp)}
    key = rule_metric_key(rule, PARSEABILITY)
    parseability = Probe(agg, _row(
        rule, i, PARSEABILITY, value=ratio(parsed, n), checked=n, issues=n - parsed,
        evidence=evidence_json(rule_id=rule.rule_id, rule_type=rule.type, checked_count=n,
                               parseable_count=parsed, issue_count=n - parsed),
        blockers=[(n == 0, NO_ROWS)]),
        [Violation(key, "rule_update_time_missing_or_invalid", list(rule.fields), stamp.isNull())])
    frequency = Probe({}, _row(
        rule, i, value=fresh.cast("double"), checked=parsed, issues=1 - fresh.cast("long"),
        evidence=evidence_json(rule_id=rule.rule_id, rule_type=rule.type, checked_count=parsed,
                               frequency=rule.get("frequency"), max_age_days=rule.get("max_age_days"),
                               latest_update_date=F.date_format(F.col(latest), "yyyy-MM-dd"),
                               reference_date=ref_date.isoformat(), update_lag_days=lag,
                               future_date=lag < 0, compliant_count=fresh.cast("int")),
        blockers=[(n == 0, NO_ROWS), (parsed == 0, NO_DATES)]))
    return [parseability, frequency]


def _allowed(cells: Cells, rule: Rule, i: int, ref_date: dt.date) -> list[Probe]:
    c, dtype = cells.raw(rule.fields[0])
    allowed = list(rule.get("allowed_values"))
    return [_compliance(
        rule, i, ~cells.missing(rule.fields[0]), ~V.matches_any(c, dtype, allowed),
        "rule_allowed_value_violation", [_EMPTY, _NONE_PRESENT], allowed_value_count=len(allowed))]


def _range(cells: Cells, rule: Rule, i: int, ref_date: dt.date) -> list[Probe]:
    number = cells.decimal(rule.fields[0])
    low, high = rule.get("minimum"), rule.get("maximum")

    def beyond(bound, below: bool) -> Column:
        exact = F.lit(str(bound)).try_cast("decimal(38,18)")
        wide = F.lit(float(bound))
        if below:
            return F.when(number["exact"].isNotNull() & exact.isNotNull(), number["exact"] < exact).otherwise(
                number["wide"] < wide)
        return F.when(number["exact"].isNotNull() & exact.isNotNull(), number["exact"] > exact).otherwise(
            number["wide"] > wide)

    outside = number.isNull()
    if low is not None:
        outside = outside | beyond(low, True)
    if high is not None:
        outside = outside | beyond(high, False)
    return [_compliance(rule, i, ~cells.missing(rule.fields[0]), F.coalesce(outside, F.lit(True)),
                        "rule_numeric_range_violation", [_EMPTY, _NONE_PRESENT],
                        minimum=low, maximum=high)]


def _regex(cells: Cells, rule: Rule, i: int, ref_date: dt.date) -> list[Probe]:
    c, dtype = cells.raw(rule.fields[0])
    bad = ~F.coalesce(V.regex_fullmatch(c, rule.get("pattern"), dtype), F.lit(False))
    return [_compliance(rule, i, ~cells.missing(rule.fields[0]), bad, "rule_regex_format_violation",
                        [_EMPTY, _NONE_PRESENT], pattern=rule.get("pattern"))]


def _length(cells: Cells, rule: Rule, i: int, ref_date: dt.date) -> list[Probe]:
    c, dtype = cells.raw(rule.fields[0])
    size = V.code_point_length(c, dtype)
    low, high = rule.get("minimum"), rule.get("maximum")
    bad = V.any_of(([] if low is None else [size < low]) + ([] if high is None else [size > high]))
    return [_compliance(rule, i, ~cells.missing(rule.fields[0]), bad, "rule_string_length_violation",
                        [_EMPTY, _NONE_PRESENT], minimum=low, maximum=high,
                        length_unit="unicode_code_points")]


def _conditional(cells: Cells, rule: Rule, i: int, ref_date: dt.date) -> list[Probe]:
    condition, needed = rule.fields
    c, dtype = cells.raw(condition)
    active = ~cells.missing(condition) & V.matches_any(c, dtype, list(rule.get("condition_values")))
    return [_compliance(rule, i, active, cells.missing(needed), "rule_conditional_required_missing",
                        [(lambda rows, checked: checked == 0, NO_ACTIVE)], condition_field=condition)]


def _comparison(cells: Cells, rule: Rule, i: int, ref_date: dt.date) -> list[Probe]:
    left, right = rule.fields
    kind = rule.get("comparison_type", "auto")
    outcome = cells.compared(left, right, rule.get("operator"), kind)
    issue = F.when(outcome.isNull(), F.lit("rule_field_comparison_unparseable")).otherwise(
        F.lit("rule_field_comparison_violation"))
    probe = _compliance(rule, i, None, ~F.coalesce(outcome, F.lit(False)), issue, [_EMPTY],
                        operator=rule.get("operator"), comparison_type=kind,
                        unparseable_count=F.col(f"rule_{i}_unparseable"))
    probe.aggregates[f"rule_{i}_unparseable"] = F.count_if(outcome.isNull())
    return [probe]


_BUILDERS = {
    "required": _required, "update_freshness": _freshness, "allowed_values": _allowed,
    "numeric_range": _range, "regex_format": _regex, "string_length": _length,
    "conditional_required": _conditional, "field_comparison": _comparison,
}


def rule_probes(cells: Cells, rules: list[Rule], reference_date: dt.date) -> list[Probe]:
    """Probes of every row-local rule."""
    return [p for i, r in enumerate(rules) if r.type in _BUILDERS
            for p in _BUILDERS[r.type](cells, r, i, reference_date)]


# ------------------------------------------------------------------ primary key
def _key_columns(df: DataFrame, fields: tuple[str, ...]) -> tuple[Column, Column]:
    """(key of complete records else null, array of the missing key fields)."""
    types = schema_types(df)
    missing = [V.is_missing(F.col(ref(f)), types[f]) for f in fields]
    plain = all(not V.is_text(types[f]) and not V.is_variant(types[f]) for f in fields)
    if plain:  # fixed-width key columns are compared as they are
        key = F.struct(*[V.exact_key(F.col(ref(f)), types[f]).alias(f"k{i}") for i, f in enumerate(fields)])
    else:
        key = digest([V.comparison_key(F.col(ref(f)), types[f]) for f in fields])
    names_ = F.array_compact(F.array(*[F.when(m, F.lit(f)) for m, f in zip(missing, fields)]))
    return F.when(~V.any_of(missing), key), names_


def primary_key_metric(df: DataFrame, rule: Rule, position: int = 0) -> DataFrame:
    key, _ = _key_columns(df, rule.fields)
    size = F.col("group_size")
    repeated = F.col("key").isNotNull() & (size > 1)
    summary = (
        df.select(key.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("group_size"))
        .agg(F.coalesce(F.sum(size), F.lit(0)).alias("pk_rows"),
             F.coalesce(F.sum(F.when(F.col("key").isNull(), size)), F.lit(0)).alias("pk_missing"),
             F.coalesce(F.sum(F.when(repeated, size)), F.lit(0)).alias("pk_repeated"),
             F.count_if(repeated).alias("pk_groups"))
    )
    n, issues = F.col("pk_rows"), F.col("pk_missing") + F.col("pk_repeated")
    row = _row(rule, position, value=ratio(n - issues, n), checked=n, issues=issues,
               evidence=evidence_json(
                   rule_id=rule.rule_id, rule_type=rule.type, fields=list(rule.fields), checked_count=n,
                   compliant_count=n - issues, issue_count=issues, missing_record_count=F.col("pk_missing"),
                   duplicate_record_count=F.col("pk_repeated"), duplicate_group_count=F.col("pk_groups")),
               blockers=[(n == 0, NO_ROWS)])
    return summary.select(row.alias("m")).select("m.*")


def primary_key_locations(
    df: DataFrame, rule: Rule, numbered: DataFrame | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Incomplete keys, and every member of a repeated key (the first one relates to the second)."""
    numbered = with_record_number(df) if numbered is None else numbered
    key, missing = _key_columns(df, rule.fields)
    rows = numbered.select(RN, key.alias("key"), missing.alias("missing_fields"))
    groups = (
        rows.where(F.col("key").isNotNull()).groupBy("key")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(RN).alias("first_record"))
        .where("group_size > 1")
    )
    members = join_back(rows.where(F.col("key").isNotNull()).select(RN, "key"), groups, "key", hot_rows=hot_rows)
    later = members.where(F.col(RN) > F.col("first_record"))
    firsts = later.groupBy("key").agg(F.first("first_record").alias(RN), F.min(RN).alias("second_record"))
    fields = F.array(*[F.lit(f) for f in rule.fields])
    repeated = later.select(RN, F.array("first_record").alias("related")).unionByName(
        firsts.select(RN, F.array("second_record").alias("related")))
    metric = F.lit(rule_metric_key(rule)).alias("metric_key")
    return repeated.select(
        metric, RN, fields.alias("fields"), F.lit("rule_primary_key_duplicate").alias("issue_type"),
        F.col("related").alias("related_record_numbers"),
    ).unionByName(rows.where(F.col("key").isNull()).select(
        metric, RN, F.col("missing_fields").alias("fields"),
        F.lit("rule_primary_key_missing").alias("issue_type"),
        F.expr("cast(array() as array<bigint>)").alias("related_record_numbers")))


# ------------------------------------------------------------------ entry points
def _distinct_keys(rules: list[Rule]) -> None:
    keys = [k for k, *_ in rule_metric_keys(rules)]
    if len(keys) != len(set(keys)):
        raise ValueError("two rules produce the same metric")


def evaluate_rules(df: DataFrame, rules: list[Rule], reference_date: dt.date) -> DataFrame:
    """Metric rows of all rules plus ``rule_id``, ``rule_type`` and ``target``."""
    _distinct_keys(rules)
    cells = Cells(df)
    frames = [primary_key_metric(df, r, i) for i, r in enumerate(rules) if r.type == "primary_key"]
    probes = rule_probes(cells, rules, reference_date)
    if probes:
        frames.append(run_probes(cells, probes))
    metrics = union_all(frames) if frames else literal_empty(df.sparkSession)
    keys = df.sparkSession.createDataFrame(
        rule_metric_keys(rules), "metric_key string, rule_id string, rule_type string, target string")
    return metrics.join(F.broadcast(keys), "metric_key")


def rule_locations(
    df: DataFrame, rules: list[Rule], reference_date: dt.date, numbered: DataFrame | None = None,
) -> DataFrame:
    numbered = with_record_number(df) if numbered is None else numbered
    cells = Cells(df)
    violations = [v for p in rule_probes(cells, rules, reference_date) for v in p.violations]
    frames = [primary_key_locations(df, r, numbered) for r in rules if r.type == "primary_key"]
    if violations:
        frames.append(locate(cells, violations, numbered))
    return union_all(frames)


def dry_run(df: DataFrame, rules: list[Rule], reference_date: dt.date) -> DataFrame:
    """What the rules would find, as counts only."""
    located = F.when(F.col("metric_id") == RULE_METRICS["update_freshness"], 0).otherwise(F.col("issue_count"))
    return evaluate_rules(df, rules, reference_date).select(
        "rule_id", "metric_id", "metric_key", "field", "status", "value", "checked_count",
        F.get_json_object("evidence", "$.compliant_count").cast("long").alias("compliant_count"),
        "issue_count", F.coalesce(located, F.lit(0)).cast("long").alias("location_count"))


def dry_run_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.sum("checked_count").alias("checked"), F.sum("compliant_count").alias("compliant"),
        F.sum("issue_count").alias("issues"),
        F.count_if(F.col("status") == "not_assessable").alias("not_assessable"),
        F.sum("location_count").alias("issue_locations"))


def check_budget(
    summary: DataFrame, rules: list[Rule], rows: int,
    max_cells: int | None = None, max_locations: int | None = None,
) -> None:
    """Refuse a whole run whose inspected cells or locations exceed the given budgets; decided
    from counts, before any location is produced."""
    cells = rows * sum(len(r.fields) for r in rules)
    if max_cells is not None and cells > max_cells:
        raise ValueError(f"{cells} cells exceed the budget of {max_cells}")
    if max_locations is not None:
        located = dry_run_totals(summary).first().issue_locations or 0
        if located > max_locations:
            raise ValueError(f"{located} locations exceed the budget of {max_locations}")
