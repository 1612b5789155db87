"""Whole assessments: metrics, risks and open items of a table, without and with business rules."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..plans.rulebook import Rule
from . import metrics as M
from . import report as RP
from . import risks as R
from . import rules as U


def settle(result: DataFrame) -> DataFrame:
    """Compute a result table once and keep its rows.

    Metric tables hold a few rows per column of the assessed table, whatever its size; everything
    derived from them (risks, summaries, differences) then costs no further scan.
    """
    return result.sparkSession.createDataFrame(result.collect(), result.schema)


@dataclass
class Assessment:
    metrics: DataFrame
    risks: DataFrame
    not_assessable: DataFrame


def assess(df: DataFrame, reference_date: dt.date, ids: Iterable[str] | None = None) -> Assessment:
    metrics = settle(M.calculate_metrics(df, reference_date, ids))
    return Assessment(metrics, R.generate_risks(metrics), RP.not_assessable(metrics))


def assess_with_rules(
    df: DataFrame, rules: list[Rule], reference_date: dt.date, ids: Iterable[str] | None = None,
) -> tuple[Assessment, Assessment]:
    """(baseline, enhanced): rule results join the report and fill the metrics they are bound to."""
    base = assess(df, reference_date, ids)
    business = settle(U.evaluate_rules(df, rules, reference_date))
    metrics = RP.enhanced_metrics(base.metrics, business)
    targets = [r.target for r in rules if r.target]
    if not RP.baseline_changes(base.metrics, metrics, targets).isEmpty():
        raise ValueError("a rule run changed metrics it is not bound to")
    risks = base.risks.unionByName(R.business_risks(business))
    return base, Assessment(metrics, risks, RP.not_assessable(metrics))
