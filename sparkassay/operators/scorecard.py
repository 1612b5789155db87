"""Scores of runs against expected answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rate(passed: Column, where: Column | None = None) -> Column:
    """Share of true flags; 1.0 where nothing was to be judged."""
    flag = F.coalesce(passed, F.lit(False)).cast("double")
    return F.coalesce(F.avg(flag if where is None else F.when(where, flag)), F.lit(1.0))


def judged(results: DataFrame, goldens: DataFrame) -> DataFrame:
    """Flags per case.

    ``results``: case_id, schema_valid, status, fields, parameters (canonical JSON),
    execution_consistent, replay_consistent; ``goldens``: case_id, expected_status,
    expected_fields, expected_parameters.  A golden case without a result fails.
    """
    joined = goldens.join(results, "case_id", "left")
    draft = F.col("expected_status") == "draft"
    return joined.select(
        *[c for c in ("case_id", "label") if c in joined.columns], draft.alias("is_draft"),
        F.coalesce("schema_valid", F.lit(False)).alias("schema_valid"),
        F.col("status").eqNullSafe(F.col("expected_status")).alias("outcome_ok"),
        F.col("fields").eqNullSafe(F.col("expected_fields")).alias("fields_ok"),
        F.col("parameters").eqNullSafe(F.col("expected_parameters")).alias("parameters_ok"),
        F.coalesce("execution_consistent", F.lit(False)).alias("execution_ok"),
        F.coalesce("replay_consistent", F.lit(False)).alias("replay_ok"))


def _card(prefix: tuple[str, ...] = ()) -> list[Column]:
    draft = F.col("is_draft")
    return [
        F.count(F.lit(1)).alias("case_count"),
        _rate(F.col("schema_valid")).alias("schema_valid_rate"), _rate(F.col("outcome_ok")).alias("outcome_accuracy"),
        _rate(F.col("fields_ok"), draft).alias("field_accuracy"),
        _rate(F.col("parameters_ok"), draft).alias("parameter_accuracy"),
        _rate(F.col("execution_ok"), draft).alias("execution_consistency"),
        _rate(F.col("replay_ok")).alias("replay_rate")]


def scorecard(results: DataFrame, goldens: DataFrame) -> DataFrame:
    return judged(results, goldens).agg(*_card())


def compare_runs(results: DataFrame, goldens: DataFrame) -> DataFrame:
    """One scorecard per ``label`` of the results, over all golden cases.

    A case that a label did not answer fails every check.  So the rates are the label's passed
    checks over the number of golden cases (or of drafts among them): no case is paired with
    each label.
    """
    of = {"schema_valid_rate": ("schema_valid", False), "outcome_accuracy": ("outcome_ok", False), "field_accuracy": ("fields_ok", True),
          "parameter_accuracy": ("parameters_ok", True), "execution_consistency": ("execution_ok", True), "replay_rate": ("replay_ok", False)}
    answered = judged(results.where(F.col("label").isNotNull()), goldens).where(F.col("label").isNotNull())
    passed = answered.groupBy("label").agg(*[
        F.count_if(F.col(flag) & F.col("is_draft") if drafts else F.col(flag)).alias(name) for name, (flag, drafts) in of.items()])
    totals = goldens.agg(F.count(F.lit(1)).alias("case_count"), F.count_if(F.col("expected_status") == "draft").alias("__drafts"))
    per_label = results.where(F.col("label").isNotNull()).select("label").distinct().join(passed, "label", "left")
    both = per_label.crossJoin(F.broadcast(totals))  # one row

    def rate(name: str, drafts: bool) -> Column:
        total = F.col("__drafts" if drafts else "case_count")
        return F.when(total == 0, 1.0).otherwise(F.coalesce(name, F.lit(0)) / total).alias(name)

    return both.select("label", "case_count", *[rate(name, drafts) for name, (_, drafts) in of.items()])


def replay_consistency(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """(case_id, consistent): equal digests of the named columns in both runs."""
    def digests(df: DataFrame, name: str) -> DataFrame:
        body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        return df.select("case_id", F.sha2(body, 256).alias(name))
    return digests(first, "a").join(digests(second, "b"), "case_id", "full").select(
        "case_id", (F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") == F.col("b"))).alias("consistent"))


def dry_run_matches(preview: DataFrame, final: DataFrame) -> DataFrame:
    """(metric_key, matches): six columns agree; a metric the final run lacks does not match."""
    compared = ("status", "value", "field", "checked_count", "compliant_count", "issue_count")
    other = final.select("metric_key", F.lit(True).alias("__found"), *[F.col(c).alias(f"__{c}") for c in compared])
    same = F.col("__found").isNotNull()
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return preview.join(other, "metric_key", "left").select("metric_key", same.alias("matches"))


def retrieval_scorecard(responses: DataFrame, results: DataFrame, goldens: DataFrame) -> DataFrame:
    """Rates over golden queries (query_id, expected_status, minimum_results, expected_version,
    expected_text); a null expectation is not checked."""
    per_query = results.groupBy("query_id").agg(
        F.max(F.struct(-F.col("rank"), "version", "text")).alias("top"),
        F.bool_and(F.col("chunk_id").isNotNull() & F.col("document_id").isNotNull()).alias("cited"))
    joined = goldens.join(responses.select("query_id", "status", "result_count"), "query_id", "left").join(
        per_query, "query_id", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("case_count"),
        _rate(F.col("status") == F.col("expected_status")).alias("status_accuracy"),
        _rate(F.col("result_count") >= F.col("minimum_results"), F.col("minimum_results").isNotNull()).alias("minimum_results_rate"),
        _rate(F.col("top.version") == F.col("expected_version"), F.col("expected_version").isNotNull()).alias("version_accuracy"),
        _rate(F.contains(F.col("top.text"), F.col("expected_text")), F.col("expected_text").isNotNull()).alias("text_accuracy"),
        _rate(F.col("cited"), F.col("result_count") > 0).alias("citation_validity"))


def ungrounded_claims(evidence: DataFrame, allowed: DataFrame) -> DataFrame:
    """Evidence rows whose chunk is not among the allowed ones of the case."""
    return evidence.join(allowed.select("case_id", "chunk_id").distinct(), ["case_id", "chunk_id"], "left_anti")


def unapproved_executions(executions: DataFrame) -> DataFrame:
    return executions.where("executed and (approval_id is null or approval_id = '')")
