"""Reading side: views, filters, sorting, counts, facets and status columns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolesift import rules
from rolesift.functions.text import blank_to_null, col, or_empty, or_no_items


def is_today(today: date) -> Column:
    """Seen or first discovered today; missing dates never match."""
    return F.coalesce(F.col("last_seen_at") == F.lit(today), F.lit(False)) | F.coalesce(
        F.col("discovered_at") == F.lit(today), F.lit(False))


def search_text() -> Column:
    """Title, company, description and both skill lists as one lower-case text."""
    skills = F.concat(or_no_items("required_skills"), or_no_items("preferred_skills"))
    return F.lower(F.concat_ws(
        " ", or_empty("title"), or_empty("company"), or_empty("description"), F.array_join(skills, " ")))


def matches_filters(
    decision: str | None = None, role_family: str | None = None, location: str | None = None,
    source: str | None = None, min_score: float | None = None, search: str | None = None,
) -> Column:
    """Conjunction of the filters that are set; 'All' and '' do not filter."""
    test = F.lit(True)
    if decision and decision != "All":
        test = test & (F.col("application_decision") == decision)
    if role_family and role_family != "All":
        test = test & (F.col("role_family") == role_family)
    if location:
        test = test & F.contains(F.lower(or_empty("location")), F.lit(location.lower()))
    if source:
        test = test & F.contains(F.lower(or_empty("source")), F.lit(source.lower()))
    if min_score is not None:
        test = test & (F.col("score") >= min_score)
    if search:
        test = test & F.contains(search_text(), F.lit(search.lower()))
    return test


def sort_order(key: str = "score") -> list[Column]:
    """Sort columns; the ordinal keeps equal rows in file order."""
    orders = {
        "score": [F.coalesce(F.col("score"), F.lit(-1)).desc()],
        "newest": [F.col(c).desc_nulls_last() for c in ("last_seen_at", "discovered_at", "first_seen_at")],
        "company": [F.lower(or_empty("company")).asc()],
        "title": [F.lower(or_empty("title")).asc()],
    }
    return [*orders.get(key, orders["score"]), F.col("ordinal").asc()]


def sort_postings(postings: DataFrame, key: str = "score") -> DataFrame:
    return postings.orderBy(*sort_order(key))


def filter_and_sort(
    postings: DataFrame, today: date, view: str = "all", sort: str = "score", **filters,
) -> DataFrame:
    """Today view, then filters, then a stable sort; all columns pass through."""
    if view == "today":
        postings = postings.filter(is_today(today))
    return sort_postings(postings.filter(matches_filters(**filters)), sort)


def decision_counts(postings: DataFrame, today: date) -> DataFrame:
    """One row of counts over the unfiltered postings."""
    decided = lambda d: F.count_if(F.col("application_decision") == d)
    return postings.agg(
        F.count_if(is_today(today)).alias("today"), F.count(F.lit(1)).alias("all"),
        *[decided(d).alias(d) for d in ("AUTO_APPLY", "REVIEW", "SKIP")])


def facets(postings: DataFrame) -> DataFrame:
    """(facet, value): distinct non-blank families and sources, sorted."""
    values = F.explode(F.array(*[
        F.struct(F.lit(c).alias("facet"), blank_to_null(c).alias("value")) for c in ("role_family", "source")]))
    return (
        postings.select(values.alias("f")).select("f.facet", "f.value")
        .filter(F.col("value").isNotNull()).distinct().orderBy("facet", "value")
    )


def intelligence_status() -> Column:
    """State of a posting's package columns, most advanced state first."""
    chain = (
        F.when(F.col("readiness").isNull(), "NOT_PROCESSED")
        .when(F.col("ready_for_browser_automation"), "READY_FOR_AUTOMATION")
        .when(F.col("requires_human_review"), "READY_FOR_REVIEW")
    )
    for artifact in ("analysis_status", "resume_status", "cover_letter_status"):
        chain = chain.when(F.col(artifact) == "FAILED", "VALIDATION_FAILED")
        chain = chain.when(F.col(artifact) == "NEEDS_REVIEW", "NEEDS_USER_INPUT")
    return chain.otherwise("PROCESSING")


PACKAGE_COLUMNS = [
    "readiness", "ready_for_browser_automation", "requires_human_review", "analysis_status",
    "resume_status", "cover_letter_status",
]


def annotate_status(postings: DataFrame, packages: DataFrame, reviews: DataFrame) -> DataFrame:
    """Postings with package and review state of their own candidate; two joins instead of file reads."""
    packages = packages.select("candidate_id", col("job_id").alias("id"), *PACKAGE_COLUMNS)
    reviews = reviews.select(
        "candidate_id", col("job_id").alias("id"), "review_status", col("overall_quality").alias("review_overall_quality"),
        col("needs_regeneration").alias("review_needs_regeneration"))
    return (
        postings.join(packages, ["candidate_id", "id"], "left").join(reviews, ["candidate_id", "id"], "left")
        .withColumns({
            "intelligence_status": intelligence_status(),
            "review_status": F.coalesce("review_status", F.lit("NOT_REVIEWED")),
            "review_needs_regeneration": F.coalesce("review_needs_regeneration", F.lit(False)),
        })
        .drop(*PACKAGE_COLUMNS)
    )


def build_payload(
    postings: DataFrame, packages: DataFrame, reviews: DataFrame, today: date, **choices,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, facets, postings): counts and facets ignore the filters.

    The sort comes last because a join does not keep an order.
    """
    sort = choices.pop("sort", "score")
    view = choices.pop("view", "all")
    chosen = postings.filter(is_today(today)) if view == "today" else postings
    chosen = annotate_status(chosen.filter(matches_filters(**choices)), packages, reviews)
    return decision_counts(postings, today), facets(postings), sort_postings(chosen, sort)


def select_jobs(
    postings: DataFrame, job_id: str | None = None, max_jobs: int | None = None, candidate_id: str | None = None,
) -> DataFrame:
    """Actionable postings in file order, or one id whatever its decision; of one candidate if named."""
    if candidate_id:
        postings = postings.filter(F.col("candidate_id") == candidate_id)
    if job_id:
        return postings.filter(F.col("id") == job_id)
    chosen = postings.filter(F.col("application_decision").isin(rules.ACTIONABLE_DECISIONS))
    return chosen.orderBy("ordinal").limit(max_jobs) if max_jobs else chosen


def find_job(postings: DataFrame, job_id: str, candidate_id: str | None = None) -> DataFrame:
    """First posting with the id, of one candidate if named; empty when there is none."""
    if candidate_id:
        postings = postings.filter(F.col("candidate_id") == candidate_id)
    return postings.filter(F.col("id") == job_id).orderBy("ordinal").limit(1)


def top_matches(matches: DataFrame, k: int, ordinal: str = "job_id") -> DataFrame:
    """Best k postings per candidate, ties in posting order.

    Spark cuts each partition to k rows per candidate before the shuffle, so a
    candidate with very many matches costs no more than any other.
    """
    best = Window.partitionBy("candidate_id").orderBy(F.col("score").desc(), F.col(ordinal).asc())
    return matches.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def list_pending_review(postings: DataFrame, packages: DataFrame, reviews: DataFrame) -> DataFrame:
    """Actionable postings that have a package, with their review state."""
    chosen = postings.filter(F.col("application_decision").isin(rules.ACTIONABLE_DECISIONS))
    return (
        chosen.select("candidate_id", col("id").alias("job_id"), "company", "title", "score", "application_decision")
        .join(packages.select("candidate_id", "job_id", "readiness"), ["candidate_id", "job_id"])
        .join(reviews.select("candidate_id", "job_id", "review_status"), ["candidate_id", "job_id"], "left")
        .withColumn("review_status", F.coalesce("review_status", F.lit("PENDING")))
    )
