"""Human review state, folded from an append-only table of actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift import rules
from rolesift.functions.pyformat import quoted, quoted_list
from rolesift.functions.text import or_empty, text_array


def quality_errors() -> list[Column]:
    allowed = "[1, 2, 3, 4, 5]"
    return [
        F.when(F.col(name).isNotNull() & ~F.col(name).between(1, 5), F.concat(
            F.lit(f"{name} must be null or one of {allowed} (1=unacceptable..5=excellent), got "),
            F.col(name).cast("string")))
        for name in rules.QUALITY_FIELDS
    ]


def validate_review() -> Column:
    """array of errors of a review record; empty means valid."""
    status = F.col("review_status")
    known = quoted_list(text_array(sorted(rules.REVIEW_STATUSES)))
    return F.array_compact(F.array(
        F.when(or_empty("job_id") == "", F.lit("job_id is required")),
        F.when(~F.coalesce(status.isin(rules.REVIEW_STATUSES), F.lit(False)), F.concat(
            F.lit("review_status must be one of "), known, F.lit(", got "), quoted(status))),
        *quality_errors(),
    ))


def validate_action() -> Column:
    """array of errors of one action; an invalid action changes nothing."""
    known = F.coalesce(F.col("action").isin([*rules.REVIEW_ACTIONS, "save"]), F.lit(False))
    return F.array_compact(F.array(
        F.when(~known, F.concat(
            F.lit("Unknown review action "), quoted("action"),
            F.lit("; must be one of approve/needs_changes/reject/save"))),
        F.when(or_empty("job_id") == "", F.lit("job_id is required")),
        *quality_errors(),
    ))


def split_valid(rows: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows to quarantine with their errors)."""
    checked = rows.withColumn("errors", errors)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def _latest(value: Column, seq: str = "seq") -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.col(seq)))


def review_fold(actions: DataFrame) -> DataFrame:
    """Current review per candidate and job.

    Starts from a blank PENDING record; 'save' keeps the status, and each field
    takes its last given value. ``max_by`` combines on the map side, so a job
    with a very long history is no problem.
    """
    valid, _ = split_valid(actions, validate_action())
    status = F.create_map(*[F.lit(x) for pair in rules.REVIEW_ACTIONS.items() for x in pair])
    new_status = F.try_element_at(status, F.col("action"))
    return valid.groupBy("candidate_id", "job_id").agg(
        F.coalesce(_latest(new_status), F.lit("PENDING")).alias("review_status"),
        *[_latest(F.col(q)).alias(q) for q in rules.QUALITY_FIELDS],
        F.coalesce(_latest(F.col("issues")), text_array([])).alias("issues"),
        F.coalesce(_latest(F.col("needs_regeneration")), F.lit(False)).alias("needs_regeneration"),
        F.coalesce(_latest(F.col("review_notes")), F.lit("")).alias("review_notes"),
        F.max_by("acted_at", "seq").alias("reviewed_at"),
    )


def display_status(status: Column) -> Column:
    """State for readers: a posting without a record was never reviewed."""
    return F.coalesce(status, F.lit("NOT_REVIEWED"))
