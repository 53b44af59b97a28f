"""Scoring of posting-candidate pairs.

The pairs to score come from the caller as a table ``(job_id, candidate_id)``:
what a candidate's discovery run collected. Work is done at the grain it belongs
to: posting columns once per posting, candidate columns once per candidate, and
only look-ups and substring tests per pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift import rules
from rolesift.functions import fit
from rolesift.functions.pyformat import quoted
from rolesift.functions.roles import career_level_fit
from rolesift.functions.text import col, or_empty, strip
from rolesift.operators import factors
from rolesift.operators.candidates import FEATURES, candidate_features
from rolesift.operators.joins import crowded_counts, parted_join, tasks_for
from rolesift.operators.pair_rules import (
    packed_features, posting_features, setting_points, setting_status, unpacked_features,
)
from rolesift.session import stored

PARTS = list(rules.WEIGHTS)
RESULT_COLUMNS = [
    "job_id", "candidate_id", "score", "role_family", "career_level", "application_decision",
    "decision_reason", "score_breakdown", "experience_gap_years", "relevant_evidence",
    "transferable_evidence", "missing_requirements", "experience_gaps", "risks", "status",
]


def pair_rows(postings: DataFrame, candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """Posting and candidate features side by side for every pair.

    Two equi-joins on keys that are unique on the feature side, so no row is
    multiplied. Up to MANY_ROWS pairs Spark broadcasts a feature side whose
    measured size allows it; otherwise it shuffles, and adaptive execution
    splits the partition of a posting or candidate that takes part in very many
    pairs. More pairs are dealt over tasks by their number, so what a task sorts
    does not grow with them, and keys are not shuffled to be counted; posting
    features go with them in their packed form.
    """
    pairs = stored(pairs.select("job_id", "candidate_id"), "pairs")
    tasks = tasks_for(pairs.count())
    postings, candidates = posting_features(postings), candidate_features(candidates, "candidate_id")
    if tasks is None:
        return pairs.join(postings, "job_id").join(candidates, "candidate_id")
    counts = lambda c: crowded_counts(pairs, [c])
    rows = parted_join(pairs, packed_features(postings), ["job_id"], F.col("candidate_id"), counts=counts("job_id"), tasks=tasks)
    return unpacked_features(
        parted_join(rows, candidates, ["candidate_id"], F.col("job_id"), counts=counts("candidate_id"), tasks=tasks))


def with_parts(rows: DataFrame) -> DataFrame:
    """The nine parts and what they rest on, of rows from :func:`pair_rows`.

    List functions come first, one column each, so that the points and the
    messages read plain columns; what a caller does not select is not computed.
    """
    family = fit.role_family_score("role_family", "target_families")
    alignment = fit.title_alignment(
        "title", "title_key", "title_family", "title_words", "target_titles", "secondary_titles",
        "target_families", "known_words")
    return with_points(
        rows.withColumns({
            "is_mismatch": family["is_mismatch"], "family_status": family["status"],
            "role_family_score": family["score"],
            "capability": F.try_element_at("capability_facts", col("role_family")),
            "capability_raw": F.try_element_at("capability_points", col("role_family")),
            "required_cov": fit.phrase_coverages("required_words", "blob"),
            "preferred_cov": fit.phrase_coverages("preferred_words", "blob"),
            "title_alignment_score": alignment["score"],
            **setting_status(),
        })
        .withColumns({"evidence": fit.relevant_evidence("required_cov", "preferred_cov"), **setting_points()})
    )


def with_points(rows: DataFrame) -> DataFrame:
    """What is left to do per pair once lists and texts have been looked into: arithmetic on facts."""
    experience = fit.experience_fit("min_experience_years", "max_experience_years", "years", "career_level")
    salary = fit.salary_fit("salary_min", "salary_max", "salary_floor", "salary_target")
    return (
        rows.withColumns({
            "experience_fit_score": experience["score"], "experience_status": experience["status"],
            "experience_gap_years": experience["gap"], "experience_detail": experience["detail"],
            "salary_fit": salary["score"], "salary_status": salary["status"], "salary_detail": salary["detail"],
            "career_level_fit": career_level_fit("career_level"),
            "damp": fit.dampening("role_family", "is_mismatch"),
        })
        .withColumns({
            "capability_score": fit.points(F.col("capability_raw") * F.col("damp")),
            "evidence_score": fit.points(F.col("evidence.raw_score") * F.col("damp")),
            "critical": fit.critical_missing(
                F.col("industry_status") == "avoided industry", F.col("salary_status"), F.col("evidence")),
        })
    )


def _listed(*items) -> Column:
    return F.array_compact(F.array(*items))


def explanations() -> dict[str, Column]:
    """Evidence, gaps and risks in the wording shown to a person."""
    joined = lambda c: F.array_join(c, "; ")
    weak, partial = F.col("evidence.weak_matches"), F.col("evidence.partial_matches")
    missing = F.concat(
        F.col("capability.missing_capabilities"),
        _listed(
            F.when(F.size(weak) > 0, F.concat(F.lit("Little to no evidence for: "), joined(weak))),
            F.when(F.col("is_mismatch"), F.col("family_status")),
            F.when(F.col("work_mode_status") == "not in preferred work modes", F.concat(
                F.lit("Work mode "), quoted("work_mode"), F.lit(" is not in your preferred work modes"))),
            F.when(F.col("location_status") == "outside preferred locations", F.concat(
                F.lit("Location "), quoted("location"), F.lit(" is outside your preferred locations"))),
            F.when(F.col("industry_status") == "avoided industry", F.concat(
                F.lit("Industry "), quoted("industry"), F.lit(" is on your avoid list"))),
            F.when(F.col("salary_status") == "below minimum acceptable", F.col("salary_detail")),
        ),
    )
    return {
        "relevant_evidence": F.concat(
            F.col("capability.relevant_evidence"), F.col("evidence.strong_matches")),
        "transferable_evidence": F.col("capability.transferable_evidence"),
        "missing_requirements": missing,
        "experience_gaps": _listed(
            F.when(F.col("experience_status") == "underqualified", F.col("experience_detail"))),
        "risks": _listed(
            F.when(F.size(partial) > 0, F.concat(F.lit("Only partial evidence for: "), joined(partial))),
            F.when(F.col("career_level") == "MID_LEVEL",
                   F.lit("Career level reads as mid-level, above your primary target")),
            F.when(F.col("role_family") == "UNKNOWN",
                   F.lit("Could not reliably classify this job's role family from its title")),
            F.when(F.col("experience_status") == "overqualified", F.col("experience_detail")),
            F.when(~F.col("legitimate"),
                   F.lit("Listing is missing an application URL or has an unusually thin description")),
        ),
    }


def decided(rows: DataFrame, *carried: str) -> DataFrame:
    """Total, decision and explanations of rows that hold the parts."""
    scored = rows.withColumn("score", fit.total_score(*PARTS))
    outcome = fit.decide_application(
        "score", "career_level", "is_mismatch", "family_status", "experience_gap_years", "critical", "legitimate")
    explained = scored.withColumns({
        "application_decision": outcome["decision"], "decision_reason": outcome["reason"], **explanations()})
    return explained.select(
        *carried, "job_id", "candidate_id", "score", "role_family", "career_level", "application_decision",
        "decision_reason", F.struct(*PARTS).alias("score_breakdown"), "experience_gap_years",
        *RESULT_COLUMNS[9:14],
        F.when(F.col("application_decision").isin(rules.ACTIONABLE_DECISIONS), "shortlisted")
        .otherwise("discovered").alias("status"),
    )


def score_rows(rows: DataFrame, *carried: str) -> DataFrame:
    """Score rows that already hold posting and candidate features."""
    return decided(with_parts(rows), *carried)


def score_pairs(postings: DataFrame, candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """match_results: one row per (job_id, candidate_id) of ``pairs``."""
    return score_rows(pair_rows(postings, candidates, pairs))


def score_pairs_by_factors(postings: DataFrame, candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of :func:`score_pairs` by factor tables.

    Pair rows stay narrow and every rule over lists or texts runs once per pair
    of values, for a price of some ten small jobs: for tables in which many
    pairs share their titles, settings, skills and wishes.
    """
    keyed = pairs.select("job_id", "candidate_id").join(factors.posting_keys(postings), "job_id").join(
        factors.person_keys(factors.people(candidates)), "candidate_id")
    return decided(with_points(factors.with_factors(keyed, postings, candidates)))


def annotate_match(postings: DataFrame, candidates: DataFrame) -> DataFrame:
    """Postings, each with the match columns for its own ``candidate_id``.

    No join on the posting id is involved, so equal ids cannot mix postings up.
    ``postings`` are read twice: the rows of each candidate are counted first.
    """
    fields = [c for c in postings.columns if c != "candidate_id"]
    counts = stored(postings.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n")), "owners")
    tasks = tasks_for(counts.agg(F.sum("n")).first()[0] or 0)
    # Features of candidates without a posting are not derived. They go under names that no posting column has.
    owners = candidates.join(counts.select("candidate_id").hint("merge"), "candidate_id", "left_semi")
    features = candidate_features(owners, "candidate_id").withColumnsRenamed({n: f"_own_{n}" for n in FEATURES})
    # One candidate may own most postings. They are moved as they are; what follows from them is derived afterwards.
    owned = parted_join(postings, features, ["candidate_id"], col("id"), counts=counts, tasks=tasks)
    rows = posting_features(
        owned.withColumn("posting", F.struct(*fields)), "posting", "candidate_id",
        *[F.col(f"_own_{n}").alias(n) for n in FEATURES])
    return score_rows(rows, "posting").select("posting.*", *RESULT_COLUMNS[1:])


def shortlisted(matches: DataFrame) -> DataFrame:
    """The rows of ``matches`` for the shortlist.

    The partition is asked for so that the status is a finished column: Spark
    would move a test of it below the scores and derive them at each place the
    decision names them.
    """
    status = F.when(F.spark_partition_id() >= 0, F.col("status"))
    return matches.withColumn("status", status).filter(F.col("status") == "shortlisted")


def auto_apply_preconditions(matches: DataFrame, applications: DataFrame) -> DataFrame:
    """Five checks, the reasons of the failed ones, and the verdict.

    ``matches`` holds postings with their decision. An application of the same
    candidate counts for a job when it names the same URL (blank equals blank)
    or the same id (absent equals absent). The two tests are separate joins;
    blank URLs and absent ids, which very many postings may share, are cut into
    parts like any other key.
    """
    same_url = applications.filter(F.col("application_url").isNotNull()).select(
        "candidate_id", F.col("application_url").alias("url")).distinct().withColumn("url_seen", F.lit(True))
    seen_id = F.coalesce(F.concat(F.lit("="), "job_id"), F.lit("-"))
    same_id = applications.select("candidate_id", seen_id.alias("seen_id")).distinct().withColumn("id_seen", F.lit(True))
    rows = matches.withColumns({
        "url": or_empty("application_url"), "seen_id": F.coalesce(F.concat(F.lit("="), "id"), F.lit("-"))})
    rows = parted_join(rows, same_url, ["candidate_id", "url"], F.struct("title", "company", "id"), "left")
    rows = parted_join(rows, same_id, ["candidate_id", "seen_id"], F.struct("title", "company", "url"), "left")
    applied = F.col("url_seen").isNotNull() | F.col("id_seen").isNotNull()
    decision = F.coalesce(F.col("application_decision"), F.lit("None"))
    checks = [
        ("not_already_applied", ~applied, F.lit("An application for this job exists")),
        ("valid_url", F.startswith(F.col("url"), F.lit("http")),
         F.lit("application_url is missing or not a valid http(s) URL")),
        ("identifiable", (strip(or_empty("company")) != "") & (strip(or_empty("title")) != ""),
         F.lit("Company or title is missing")),
        ("appears_legitimate", (F.col("url") != "") & (
            F.length(or_empty("description")) > rules.LEGITIMATE_MIN_DESCRIPTION),
         F.lit("Listing has no application URL or an unusually thin description")),
        ("decision_is_auto_apply", decision == "AUTO_APPLY",
         F.concat(F.lit("Scoring decision is "), decision, F.lit(", not AUTO_APPLY"))),
    ]
    checked = rows.withColumns({name: test for name, test, _ in checks})
    eligible = F.lit(True)
    for name, _, _ in checks:
        eligible = eligible & F.col(name)
    return checked.withColumns({
        "eligible": eligible,
        "reasons": _listed(*[F.when(~F.col(name), reason) for name, _, reason in checks]),
    }).drop("url", "url_seen", "seen_id", "id_seen")
