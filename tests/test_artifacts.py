"""Requests, responses, packages and reviews on small hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from rolesift import rules, schemas
from rolesift.operators import artifacts, browse, reviews, scoring
from rolesift.operators.candidates import candidate_context
from tests.test_scoring import CANDIDATE, POSTING

CONTEXT = {
    "total_experience_years": 1.0, "verified_employers": ["Acme LLP"], "evidence_blob": "sql 24 reports",
    "skills": ["SQL"], "name": "Sam", "contact_section": "", "experience_section": "", "education_section": "",
    "company": "Globex",
}


def responses(spark, rows):
    schema = ("candidate_id string, job_id string, cache_key string, analysis_status string, call_error string, raw string, "
              "total_experience_years double, verified_employers array<string>, evidence_blob string, skills array<string>, "
              "name string, contact_section string, experience_section string, education_section string, company string")
    return spark.createDataFrame([("c1", *r, *CONTEXT.values()) for r in rows], schema)


@pytest.mark.parametrize("text,valid", [
    ('{"a": 1}', True), ('[1]', True), ('{"a": 1} x', False), ('{"a": 1} {"b": 2}', False), ('{"a": 1}, {"b": 2}', False),
    ('{"a": ', False), ("", False), ("{'a': 1}", False),
])
def test_is_json(spark, text, valid):
    rows = spark.createDataFrame([(text, None)], "raw string, call_error string")
    assert artifacts.parse_generated_json(rows, "a int", []).first()["failed"] is not valid


def test_unfenced(evaluate):
    got = evaluate(artifacts.unfenced, ["```json\n{}\n```", "```\n{}```", " {} ", "{} ```", None])
    assert got == ["{}", "{}", "{}", "{} ```", ""]


def test_resume_intake(spark):
    good = {"summary": "Analyst with SQL", "highlighted_experience": ["Ran 24 reports"], "highlighted_projects": [],
            "skills_to_feature": ["sql"], "keywords_used": []}
    bad = {**good, "summary": "8 years experience at Initech. I only have doubts", "skills_to_feature": ["Rust"]}
    got = {r["job_id"]: r for r in artifacts.intake_resume(responses(spark, [
        ("ok", "k", "COMPLETED", None, json.dumps(good)), ("bad", "k", "NEEDS_REVIEW", None, json.dumps(bad)),
        ("early", "k", "FAILED", None, json.dumps(good)), ("call", "k", "COMPLETED", "timeout", None),
        ("part", "k", "COMPLETED", None, '{"summary": "x"}')])).collect()}
    assert got["ok"]["status"] == "COMPLETED" and got["ok"]["validation"]["issues"] == []
    assert "HIGHLIGHTS FOR THIS APPLICATION\n- Ran 24 reports" in got["ok"]["rendered_text"]
    assert got["bad"]["status"] == "NEEDS_REVIEW"
    assert got["bad"]["validation"]["issues"] == [
        "Text claims 8+ years of experience; candidate profile verifies only 1 year(s).",
        "Mentions an employer-like name not in the verified profile: 'Initech'",
        "Explicit experience-gap language found (1 mention(s), max 0 allowed): ['I only have']",
        "Skill(s) not in candidate profile: ['Rust']"]
    assert got["early"]["error"] == "Cannot tailor a resume without a completed job analysis (analysis status: FAILED)."
    assert (got["call"]["status"], got["call"]["error"]) == ("FAILED", "timeout")
    assert got["part"]["error"].endswith("['highlighted_experience', 'highlighted_projects', 'skills_to_feature', 'keywords_used']")


def test_target_company_is_no_claimed_employer(spark):
    body = {"cover_letter_needed": True, "reason": "", "body": "Eager to work at Globex after my time at Acme."}
    row = artifacts.intake_cover_letter(responses(spark, [("j", "k", "COMPLETED", None, json.dumps(body))])).first()
    assert (row["status"], row["validation"]["issues"]) == ("COMPLETED", [])


def jobs(spark):
    posting = {f.name: POSTING.get(f.name) for f in schemas.POSTINGS.fields if f.name != "id"}
    facts = {f.name: CANDIDATE.get(f.name) for f in schemas.CANDIDATES.fields}
    row = {"candidate_id": "c1", "job_id": "j1", "profile_hash": "h", **posting, **facts}
    fields = [f for f in [*schemas.POSTINGS.fields, *schemas.CANDIDATES.fields] if f.name in row]
    schema = schemas.T.StructType([
        schemas.T.StructField("job_id", schemas.T.StringType()), schemas.T.StructField("profile_hash", schemas.T.StringType()), *fields])
    return spark.createDataFrame([tuple(row[f.name] for f in schema.fields)], schema)


def test_fresh_job_makes_nine_requests_and_rerun_none(spark):
    rows = jobs(spark)
    none = spark.createDataFrame([], "candidate_id string, job_id string, cache_key string, status string, position int")
    asked = artifacts.analysis_requests(rows, none).collect()
    assert len(asked) == 1 and "Associate Product Manager" in asked[0]["prompt"] and "Shipped an app" in asked[0]["prompt"]
    key = asked[0]["cache_key"]
    analysed = spark.createDataFrame([("c1", "j1", key, "COMPLETED")], "candidate_id string, job_id string, cache_key string, status string").withColumn(
        "analysis", F.struct(F.lit("x").alias("target_role")))
    rest = artifacts.artifact_requests(rows, analysed, none, none, none).collect()
    assert len(asked) + len(rest) == 9 and sum(r["artifact"] == "answer" for r in rest) == 6
    done = spark.createDataFrame([("c1", "j1", key, "COMPLETED", 0)], none.schema)
    assert artifacts.analysis_requests(rows, done).count() == 0
    assert artifacts.artifact_requests(rows, analysed, done, done, done).count() == 0
    assert artifacts.analysis_requests(rows, done, force=True).count() == 1
    changed = rows.withColumn("description", F.lit("new text"))
    assert artifacts.analysis_requests(changed, done).count() == 1


def test_package_of_an_unprocessed_job(spark):
    rows = jobs(spark).withColumns({"application_decision": F.lit("REVIEW"), "decision_reason": F.lit("Close call"), "score": F.lit(80)})
    record = spark.createDataFrame([], "candidate_id string, job_id string, status string, error string, cover_letter_needed boolean").withColumn(
        "validation", F.struct(F.lit("").alias("status"), F.array().cast("array<string>").alias("issues")))
    answers = spark.createDataFrame([], "candidate_id string, job_id string, position int, question string, status string, confidence string")
    package = artifacts.assemble_package(artifacts.package_rows(rows, record, record, record, answers)).first()
    assert (package["readiness"], package["answers_status"], package["cover_letter_status"]) == ("NOT_READY", "INCOMPLETE", "NOT_PROCESSED")
    assert package["review_reasons"] == ["Close call"] and package["requires_human_review"]
    assert package["decision"] == "REVIEW" and package["decision_score"] == 80


def test_context_without_profile(spark):
    candidates = spark.createDataFrame([tuple(CANDIDATE.get(f.name) for f in schemas.CANDIDATES.fields)], schemas.CANDIDATES)
    none = spark.createDataFrame([], "candidate_id string, markdown string")
    row = candidate_context(candidates, none).first()
    assert row["verified_employers"] == [] and row["education_section"] == "" and len(row["profile_hash"]) == 64
    older = candidate_context(candidates.withColumn("total_experience_years", F.lit(2.0)), none).first()
    assert older["profile_hash"] != row["profile_hash"]


def test_review_fold_ignores_invalid_actions(spark):
    fields = ", ".join(f"{q} int" for q in rules.QUALITY_FIELDS)
    none = (None,) * 6
    rows = [
        ("j", 1, "save", (4, *none[1:]), ["a"], None, "first"), ("j", 2, "approve", none, None, True, None),
        ("j", 3, "reject", (9, *none[1:]), None, None, None), ("j", 4, "explode", none, None, None, "x"), ("k", 1, "save", none, None, None, None)]
    actions = spark.createDataFrame(
        [("c1", j, s, a, *q, i, g, n, s) for j, s, a, q, i, g, n in rows],
        f"candidate_id string, job_id string, seq int, action string, {fields}, issues array<string>, needs_regeneration boolean, review_notes string, acted_at int")
    got = {r["job_id"]: r for r in reviews.review_fold(actions).collect()}
    assert (got["j"]["review_status"], got["j"]["analysis_quality"], got["j"]["issues"], got["j"]["needs_regeneration"], got["j"]["review_notes"],
            got["j"]["reviewed_at"]) == ("APPROVED", 4, ["a"], True, "first", 2)
    assert (got["k"]["review_status"], got["k"]["issues"], got["k"]["review_notes"]) == ("PENDING", [], "")
    _, invalid = reviews.split_valid(actions, reviews.validate_action())
    assert invalid.count() == 2


def test_two_candidates_hold_one_posting(spark):
    """Packages, reviews and applications of one candidate say nothing about the other."""
    postings = spark.createDataFrame(
        [("c1", "g-1", "Acme", "T", 80, "REVIEW", 1, "http://a", "x" * 60), ("c2", "g-1", "Acme", "T", 90, "REVIEW", 2, "http://a", "x" * 60)],
        "candidate_id string, id string, company string, title string, score int, application_decision string, ordinal int, "
        "application_url string, description string")
    packages = spark.createDataFrame(
        [("c1", "g-1", "READY", True, False, "COMPLETED", "COMPLETED", "COMPLETED"), ("c2", "g-1", "NOT_READY", False, False, "FAILED", "COMPLETED", "COMPLETED")],
        "candidate_id string, job_id string, readiness string, ready_for_browser_automation boolean, requires_human_review boolean, "
        "analysis_status string, resume_status string, cover_letter_status string")
    marks = spark.createDataFrame([("c2", "g-1", "APPROVED", 5, False)],
                                  "candidate_id string, job_id string, review_status string, overall_quality int, needs_regeneration boolean")
    rows = browse.annotate_status(postings, packages, marks).collect()
    assert {(r["candidate_id"], r["intelligence_status"], r["review_status"]) for r in rows} == {
        ("c1", "READY_FOR_AUTOMATION", "NOT_REVIEWED"), ("c2", "VALIDATION_FAILED", "APPROVED")} and len(rows) == 2
    pending = browse.list_pending_review(postings, packages, marks).collect()
    assert {(r["candidate_id"], r["readiness"], r["review_status"]) for r in pending} == {("c1", "READY", "PENDING"), ("c2", "NOT_READY", "APPROVED")}
    assert browse.find_job(postings, "g-1", "c2").first()["score"] == 90 and browse.select_jobs(postings, candidate_id="c1").count() == 1
    applied = spark.createDataFrame([("c1", "g-1", "http://a")], "candidate_id string, job_id string, application_url string")
    checked = scoring.auto_apply_preconditions(postings, applied).collect()
    assert {(r["candidate_id"], r["not_already_applied"]) for r in checked} == {("c1", False), ("c2", True)}
    stored = spark.createDataFrame([("c1", "g-1", "k", "COMPLETED")], "candidate_id string, job_id string, cache_key string, status string")
    wanted = postings.select("candidate_id", F.col("id").alias("job_id"), F.lit("k").alias("cache_key"))
    hits, misses = artifacts.cache_lookup(wanted, stored, artifacts.USABLE)
    assert [r["candidate_id"] for r in hits.collect()] == ["c1"] and [r["candidate_id"] for r in misses.collect()] == ["c2"]
