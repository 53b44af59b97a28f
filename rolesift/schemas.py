"""Explicit schemas for landed payloads and for the tables the jobs write."""

from __future__ import annotations

from pyspark.sql import types as T

from rolesift.rules import WEIGHTS

_S, _D, _I, _B, _L = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.LongType()
_SA = T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Payloads. Identifiers that arrive as a number or as text are read as text.
GREENHOUSE = _struct(
    id=_S, title=_S, location=_struct(name=_S), content=_S, absolute_url=_S,
    updated_at=_S, first_published=_S,
)
LEVER = _struct(
    id=_S, text=_S, categories=_struct(location=_S), descriptionPlain=_S, description=_S,
    hostedUrl=_S, applyUrl=_S, createdAt=_D,
    lists=T.ArrayType(_struct(text=_S, content=_S)),
)
ASHBY = _struct(
    id=_S, title=_S, location=_S, isRemote=_B, isListed=_B, workplaceType=_S, publishedAt=_S,
    jobUrl=_S, applyUrl=_S, descriptionHtml=_S, descriptionPlain=_S,
    compensation=_struct(scrapeableCompensationSalarySummary=_S),
)
SMARTRECRUITERS = _struct(
    id=_S, name=_S, location=_struct(city=_S, fullLocation=_S, remote=_B, hybrid=_B),
    industry=_struct(id=_S, label=_S), experienceLevel=_struct(id=_S, label=_S), releasedDate=_S,
)
WORKDAY_SEARCH = _struct(externalPath=_S, title=_S, bulletFields=_SA)
WORKDAY_DETAIL = _struct(
    jobPostingInfo=_struct(
        title=_S, location=_S, jobDescription=_S, jobReqId=_S, jobPostingId=_S, externalUrl=_S,
    ),
)
PAYLOADS = {
    "greenhouse": GREENHOUSE, "lever": LEVER, "ashby": ASHBY,
    "smartrecruiters": SMARTRECRUITERS, "workday": WORKDAY_SEARCH,
}
# Where the list of postings sits in a response; None is a top-level array.
ENVELOPES = {
    "greenhouse": "jobs", "lever": None, "ashby": "jobs",
    "smartrecruiters": "content", "workday": "jobPostings",
}

# One API response per row; ``body`` is NULL where the request failed.
RESPONSES = _struct(
    candidate_id=_S, connector=_S, source_key=_S, source_no=_I, query_no=_I, page_no=_I, body=_S,
)
RAW_POSTINGS = _struct(
    candidate_id=_S, connector=_S, source_key=_S, source_no=_I, query_no=_I, page_no=_I, pos=_I, payload=_S,
)

POSTINGS = T.StructType([
    *[T.StructField(n, _S) for n in (
        "id", "company", "title", "location", "work_mode", "industry", "company_size")],
    T.StructField("salary_min", _D), T.StructField("salary_max", _D),
    T.StructField("salary_currency", _S),
    T.StructField("min_experience_years", _D), T.StructField("max_experience_years", _D),
    T.StructField("required_skills", _SA), T.StructField("preferred_skills", _SA),
    *[T.StructField(n, _S) for n in (
        "description", "application_url", "source_url", "source_job_id", "linkedin_url", "source")],
    *[T.StructField(n, T.DateType()) for n in ("posted_date", "date_discovered", "discovered_at")],
])
# Place of a posting in the order of all runs.
ORDINAL = _struct(
    candidate_id=_S, run_no=_I, rank=_I, source_no=_I, source_key=_S, query_no=_I, page_no=_I, pos=_I,
)
HISTORY_FIELDS = [T.StructField("first_seen_at", T.DateType()), T.StructField("last_seen_at", T.DateType())]
STORED_POSTINGS = T.StructType([*POSTINGS.fields, *HISTORY_FIELDS])

BREAKDOWN = _struct(**{name: _I for name in WEIGHTS})
# What discovery stores: place, posting, history and match of one candidate.
DISCOVERED = T.StructType([
    *[f for f in RAW_POSTINGS.fields if f.name != "payload"],
    T.StructField("ordinal", ORDINAL), *STORED_POSTINGS.fields,
    T.StructField("score", _I), T.StructField("role_family", _S), T.StructField("career_level", _S),
    T.StructField("application_decision", _S), T.StructField("decision_reason", _S),
    T.StructField("score_breakdown", BREAKDOWN), T.StructField("experience_gap_years", _D),
    *[T.StructField(n, _SA) for n in (
        "relevant_evidence", "transferable_evidence", "missing_requirements", "experience_gaps", "risks")],
    T.StructField("status", _S),
])
# Appended beside the postings: their identity keys, and when a run met a stored posting again.
KEYS = T.StructType([T.StructField("ordinal", ORDINAL), T.StructField("tier", _I), T.StructField("key", T.BinaryType()),
                     T.StructField("home", T.LongType())])
SIGHTINGS = T.StructType([T.StructField("ordinal", ORDINAL), T.StructField("seen_at", T.DateType())])

CAPABILITY = _struct(key=_S, strength=_S, evidence=_SA)
CANDIDATES = T.StructType([
    T.StructField("candidate_id", _S), T.StructField("name", _S),
    T.StructField("total_experience_years", _D),
    *[T.StructField(n, _SA) for n in (
        "target_titles", "secondary_titles", "skills", "preferred_industries", "avoid_industries",
        "preferred_locations", "preferred_work_modes", "preferred_company_sizes")],
    T.StructField("min_acceptable_salary_inr_per_year", _D),
    T.StructField("target_salary_min_inr_per_year", _D),
    T.StructField("target_salary_max_inr_per_year", _D),
    T.StructField("work_authorization", _S), T.StructField("earliest_start_date", _S),
    T.StructField("capabilities", T.ArrayType(CAPABILITY)),
])

SOURCES = _struct(connector=_S, source_key=_S, ordinal=_I)
APPLICATIONS = _struct(job_id=_S, application_url=_S)

ANALYSIS = T.StructType([
    T.StructField(name, kind) for name, kind in [
        ("target_role", _S), ("company", _S), ("core_mission", _S),
        *[(n, _SA) for n in (
            "must_have_requirements", "nice_to_have_requirements", "core_responsibilities",
            "technical_skills", "product_skills", "business_skills", "project_skills",
            "communication_skills", "domain_requirements", "seniority_signals", "success_signals",
            "candidate_matches", "candidate_gaps", "evidence_to_highlight",
            "unsupported_claims_to_avoid", "resume_keywords", "cover_letter_angles")],
        ("application_strategy", _S), ("confidence", _D),
    ]
])
RESUME = _struct(
    summary=_S, highlighted_experience=_SA, highlighted_projects=_SA, skills_to_feature=_SA,
    keywords_used=_SA,
)
COVER_LETTER = _struct(cover_letter_needed=_B, reason=_S, body=_S)
ANSWER = _struct(answer=_S, confidence=_S, reason=_S)

REVIEW = T.StructType([
    T.StructField("job_id", _S), T.StructField("review_status", _S),
    *[T.StructField(n, _I) for n in (
        "analysis_quality", "resume_quality", "cover_letter_quality", "answers_quality",
        "truthfulness", "overall_quality")],
    T.StructField("issues", _SA), T.StructField("needs_regeneration", _B),
    T.StructField("review_notes", _S), T.StructField("reviewed_at", T.TimestampType()),
])
