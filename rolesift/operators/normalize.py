"""Connector payloads to the common posting schema.

Every connector is one projection. Input rows hold the parsed payload as struct
``raw`` plus ``source_key``; run_date is a parameter, never the clock.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift import rules, schemas
from rolesift.functions.text import (
    blank_to_null, bullets, col, epoch_millis_to_date, is_experience_line, iso_date10,
    labelled_field, make_id, or_empty, parse_experience, parse_salary, strip, strip_html,
    text_array, work_mode,
)

CARRIED = ["candidate_id", "connector", "source_key", "source_no", "query_no", "page_no", "pos", "ordinal"]


def _posting(rows: DataFrame, run_date: date, **fields: Column) -> DataFrame:
    """Select the common schema; fields a connector does not know stay NULL."""
    fields.setdefault("date_discovered", F.lit(run_date))
    fields.setdefault("discovered_at", F.lit(run_date))
    columns = [
        fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.POSTINGS.fields
    ]
    return rows.select(*[c for c in CARRIED if c in rows.columns], *columns)


def normalize_greenhouse(rows: DataFrame, run_date: date) -> DataFrame:
    board, title, place = col("source_key"), or_empty("raw.title"), or_empty("raw.location.name")
    rows = rows.withColumn("body", strip_html("raw.content")).withColumn("years", parse_experience("body"))
    body = F.col("body")
    changed = F.coalesce(blank_to_null("raw.updated_at"), col("raw.first_published"))
    return _posting(
        rows, run_date,
        id=make_id(F.lit("greenhouse"), board, title, or_empty("raw.id")),
        company=board, title=title, location=place,
        work_mode=F.coalesce(work_mode(body), work_mode(place)),
        min_experience_years=F.col("years.min"), max_experience_years=F.col("years.max"),
        required_skills=text_array([]), preferred_skills=text_array([]),
        description=body, application_url=col("raw.absolute_url"), source_url=col("raw.absolute_url"),
        source_job_id=blank_to_null(col("raw.id")), posted_date=iso_date10(changed),
        source=F.concat(F.lit("greenhouse:"), board),
    )


def lever_list_text(lists: Column, labels: list[str]) -> Column:
    """Plain text of the first list whose label contains one of ``labels``."""
    def wanted(entry: Column) -> Column:
        label = F.lower(or_empty(entry["text"]))
        return F.exists(text_array(labels), lambda k: F.contains(label, k))

    first = F.get(F.filter(lists, wanted), F.lit(0))
    return F.when(first.isNotNull(), strip_html(first["content"]))


def normalize_lever(rows: DataFrame, run_date: date) -> DataFrame:
    slug, title, place = col("source_key"), or_empty("raw.text"), or_empty("raw.categories.location")
    lists = F.coalesce(col("raw.lists"), F.array().cast("array<struct<text:string,content:string>>"))
    text = F.coalesce(blank_to_null("raw.descriptionPlain"), col("raw.description"))
    rows = rows.withColumns({
        "body": strip_html(text),
        "skills_text": lever_list_text(lists, rules.LEVER_SKILL_LABELS),
        "needs_text": lever_list_text(lists, rules.LEVER_REQUIREMENT_LABELS),
    }).withColumns({
        "years": parse_experience(F.concat_ws(
            " ", blank_to_null("body"), blank_to_null("skills_text"), blank_to_null("needs_text"))),
        "skill_lines": F.filter(
            F.concat(bullets("skills_text"), bullets("needs_text")),
            lambda b: ~(is_experience_line(b) | b.rlike("(?iu)^(?:education|pedigree)"))),
    })
    optional = lambda b: b.rlike(r"(?iU)\bplus\b|nice to have|preferred")
    return _posting(
        rows, run_date,
        id=make_id(F.lit("lever"), slug, title, or_empty("raw.id")),
        company=slug, title=title, location=place,
        work_mode=F.coalesce(work_mode("body"), work_mode(place)),
        min_experience_years=F.col("years.min"), max_experience_years=F.col("years.max"),
        required_skills=F.filter("skill_lines", lambda b: ~optional(b)),
        preferred_skills=F.filter("skill_lines", optional),
        description=F.col("body"),
        application_url=F.coalesce(blank_to_null("raw.hostedUrl"), col("raw.applyUrl")),
        source_url=col("raw.hostedUrl"), source_job_id=col("raw.id"),
        posted_date=epoch_millis_to_date("raw.createdAt"), source=F.concat(F.lit("lever:"), slug),
    )


def normalize_ashby(rows: DataFrame, run_date: date) -> DataFrame:
    board, title, stated = col("source_key"), or_empty("raw.title"), or_empty("raw.location")
    mark = F.coalesce(col("raw.isRemote"), F.lit(False)) & ~F.contains(F.lower(stated), F.lit("remote"))
    place = (
        F.when(mark & (stated == ""), "Remote")
        .when(mark, strip(F.concat(stated, F.lit(" (Remote)")))).otherwise(stated)
    )
    text = F.coalesce(blank_to_null("raw.descriptionHtml"), col("raw.descriptionPlain"))
    rows = rows.withColumns({
        "body": strip_html(text), "place": place,
        "pay": parse_salary("raw.compensation.scrapeableCompensationSalarySummary"),
    }).withColumn("years", parse_experience("body"))
    return _posting(
        rows, run_date,
        id=make_id(F.lit("ashby"), board, title, or_empty("raw.id")),
        company=board, title=title, location=F.col("place"),
        work_mode=F.coalesce(work_mode("raw.workplaceType"), work_mode("body"), work_mode("place")),
        salary_min=F.col("pay.min"), salary_max=F.col("pay.max"), salary_currency=F.col("pay.currency"),
        min_experience_years=F.col("years.min"), max_experience_years=F.col("years.max"),
        required_skills=text_array([]), preferred_skills=text_array([]), description=F.col("body"),
        application_url=F.coalesce(blank_to_null("raw.applyUrl"), col("raw.jobUrl")),
        source_url=col("raw.jobUrl"), source_job_id=col("raw.id"),
        posted_date=iso_date10("raw.publishedAt"), source=F.concat(F.lit("ashby:"), board),
    )


def normalize_smartrecruiters(rows: DataFrame, run_date: date) -> DataFrame:
    company, title = col("source_key"), or_empty("raw.name")
    place = F.coalesce(blank_to_null("raw.location.fullLocation"), blank_to_null("raw.location.city"), F.lit(""))
    flagged = F.when(col("raw.location.remote"), "remote").when(col("raw.location.hybrid"), "hybrid")
    label = blank_to_null("raw.experienceLevel.label")
    posting_id = blank_to_null("raw.id")
    url = F.concat(F.lit("https://jobs.smartrecruiters.com/"), company, F.lit("/"), posting_id)
    return _posting(
        rows, run_date,
        id=make_id(F.lit("smartrecruiters"), company, title, or_empty("raw.id")),
        company=company, title=title, location=place,
        work_mode=F.coalesce(flagged, work_mode(place)), industry=col("raw.industry.label"),
        required_skills=text_array([]), preferred_skills=text_array([]),
        description=F.coalesce(F.concat(F.lit("Experience level: "), label), F.lit("")),
        application_url=url, source_url=url, source_job_id=col("raw.id"),
        posted_date=iso_date10("raw.releasedDate"), source=F.concat(F.lit("smartrecruiters:"), company),
    )


def normalize_workday(rows: DataFrame, run_date: date) -> DataFrame:
    """``raw`` is the detail payload; ``source_key`` the company's display name."""
    company, info = col("source_key"), "raw.jobPostingInfo."
    title, place = or_empty(info + "title"), or_empty(info + "location")
    job_key = F.coalesce(blank_to_null(info + "jobReqId"), col(info + "jobPostingId"))
    rows = rows.withColumn("body", strip_html(info + "jobDescription"))

    def skill_list(label: str) -> Column:
        parts = F.transform(F.split(or_empty(labelled_field("body", label)), ","), strip)
        return F.filter(parts, lambda s: s != "")

    return _posting(
        rows, run_date,
        id=make_id(F.lit("workday"), company, title, or_empty(job_key)),
        company=company, title=title, location=place, work_mode=work_mode("body"),
        min_experience_years=parse_experience("body")["min"],
        required_skills=skill_list(rules.WORKDAY_REQUIRED_LABEL),
        preferred_skills=F.filter(skill_list(rules.WORKDAY_PREFERRED_LABEL), lambda s: F.upper(s) != "NA"),
        description=F.col("body"), application_url=col(info + "externalUrl"),
        source_url=col(info + "externalUrl"), source_job_id=job_key,
        source=F.concat(F.lit("workday:"), F.lower(company)),
    )


NORMALIZERS = {
    "lever": normalize_lever, "greenhouse": normalize_greenhouse, "ashby": normalize_ashby,
    "smartrecruiters": normalize_smartrecruiters, "workday": normalize_workday,
}
