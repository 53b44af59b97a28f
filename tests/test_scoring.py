"""Scoring of single postings with outcomes worked out by hand."""

from rolesift import rules, schemas
from rolesift.operators import factors, joins, scoring

LONG = "Own the roadmap with the team and talk to clients every week. " * 2

CANDIDATE = {
    "candidate_id": "c1", "name": "Sam", "total_experience_years": 1.0,
    "target_titles": ["Associate Product Manager", "Business Analyst"], "secondary_titles": ["Project Coordinator"],
    "skills": ["SQL", "Stakeholder management", "Requirements gathering"], "preferred_industries": ["Fintech"],
    "avoid_industries": ["Gambling"], "preferred_locations": ["Pune"], "preferred_work_modes": ["remote", "hybrid"],
    "preferred_company_sizes": [], "min_acceptable_salary_inr_per_year": 400000.0,
    "target_salary_min_inr_per_year": 600000.0, "target_salary_max_inr_per_year": 800000.0,
    "work_authorization": "Citizen", "earliest_start_date": "Now",
    "capabilities": [
        {"key": "product_management", "strength": "professional", "evidence": ["Shipped an app", "More"]},
        {"key": "analytics", "strength": "practical", "evidence": ["Built dashboards"]},
        {"key": "stakeholder_communication", "strength": "professional", "evidence": ["Led calls"]},
        {"key": "requirements_gathering", "strength": "professional", "evidence": ["Wrote specs"]},
        {"key": "documentation", "strength": "professional", "evidence": []},
        {"key": "business_analysis", "strength": "professional", "evidence": ["Mapped flows"]},
        {"key": "client_facing", "strength": "professional", "evidence": ["Ran demos"]},
        {"key": "software_development", "strength": "none", "evidence": []},
    ],
}
POSTING = {
    "id": "p1", "title": "Associate Product Manager", "company": "Acme", "location": "Pune", "work_mode": "hybrid",
    "industry": "Fintech", "company_size": None, "salary_min": None, "salary_max": None,
    "min_experience_years": 0.0, "max_experience_years": 2.0,
    "required_skills": ["Stakeholder management", "SQL"], "preferred_skills": [], "description": LONG,
    "application_url": "https://x.example.com/1",
}


def score_all(spark, variants):
    """One result per posting variant, in order, scored in one job."""
    rows = [{**POSTING, **v, "id": f"p{i}"} for i, v in enumerate(variants)]
    postings = spark.createDataFrame(
        [tuple(r.get(f.name) for f in schemas.POSTINGS.fields) for r in rows], schemas.POSTINGS)
    candidates = spark.createDataFrame(
        [tuple(CANDIDATE.get(f.name) for f in schemas.CANDIDATES.fields)], schemas.CANDIDATES)
    pairs = spark.createDataFrame([(r["id"], "c1") for r in rows], "job_id string, candidate_id string")
    got = {r["job_id"]: r for r in scoring.score_pairs(postings, candidates, pairs).collect()}
    return [got[r["id"]] for r in rows]


def score(spark, posting=None):
    return score_all(spark, [posting or {}])[0]


def test_weights():
    assert sum(rules.WEIGHTS.values()) == 100


def test_strong_match_applies(spark):
    got = score(spark)
    # capability: (2*1 + 2*0.65 + 1 + 1 + 1) / 7 of 20 = 18
    assert got["score_breakdown"].asDict() == {
        "role_family_score": 20, "capability_score": 18, "evidence_score": 15, "title_alignment_score": 10,
        "experience_fit_score": 10, "career_level_fit": 10, "location_fit": 8, "industry_fit": 4, "salary_fit": 3}
    assert (got["score"], got["application_decision"], got["career_level"]) == (98, "AUTO_APPLY", "JUNIOR")
    assert got["relevant_evidence"] == [
        "Shipped an app", "Led calls", "Wrote specs", "(project/practical, not professional) Built dashboards",
        "Stakeholder management", "SQL"]
    assert got["transferable_evidence"] == ["Ran demos"]
    assert got["missing_requirements"] == [] and got["risks"] == [] and got["status"] == "shortlisted"


DECISIONS = [
    ({"title": "Senior Product Manager"}, "SKIP", "Career level is SENIOR"),
    ({"title": "Product Counsel"}, "SKIP", "Role family mismatch: 'LEGAL' is not one"),
    ({"min_experience_years": 4.0, "max_experience_years": None, "title": "Product Manager"}, "SKIP", "Experience gap of 3 years"),
    ({"industry": "gambling "}, "SKIP", "A critical requirement"),
    ({"salary_max": 300000.0}, "SKIP", "A critical requirement"),
    # No skill is covered: 0 of 12 plus 3 for no optional skills is under 3.6.
    ({"required_skills": ["Kubernetes operations", "Terraform modules"]}, "SKIP", "A critical requirement"),
    ({"required_skills": ["Kubernetes operations", "SQL"], "work_mode": "onsite", "location": "Rome", "industry": "Retail"},
     "REVIEW", "score 83 is below the 85"),
    ({"min_experience_years": 2.0}, "REVIEW", "experience gap is 1 years"),
    ({"application_url": None}, "REVIEW", "listing legitimacy could not be fully confirmed"),
    ({"title": "Product Manager", "min_experience_years": 3.0, "max_experience_years": None}, "REVIEW", "career level is mid-level"),
]


def test_decisions(spark):
    results = score_all(spark, [d[0] for d in DECISIONS])
    for (_, decision, part), got in zip(DECISIONS, results):
        assert got["application_decision"] == decision, got["decision_reason"]
        assert part in got["decision_reason"]
        assert 0 <= got["score"] <= 100


def test_missing_facts_are_not_held_against_a_posting(spark):
    blank = {k: None for k in ("location", "work_mode", "industry", "company_size", "min_experience_years",
                               "max_experience_years", "required_skills", "preferred_skills")}
    got = score(spark, blank)
    assert got["score"] == 98 and got["experience_gap_years"] == 0.0


def test_explanations(spark):
    got = score(spark, {
        "title": "Business Operations Specialist", "work_mode": "Onsite", "location": "Rome", "salary_max": 100000.0,
        "min_experience_years": None, "max_experience_years": 0.5, "required_skills": ["Python tooling", "client calls weekly"],
        "description": "thin"})
    assert got["role_family"] == "UNKNOWN"
    assert got["missing_requirements"] == [
        "No demonstrated experience in 'project management', which this role family primarily needs",
        "Little to no evidence for: Python tooling",
        "Work mode 'Onsite' is not in your preferred work modes",
        "Location 'Rome' is outside your preferred locations",
        "Job offers up to 100000.0, below your minimum acceptable 400000"]
    assert got["risks"] == [
        "Only partial evidence for: client calls weekly",
        "Could not reliably classify this job's role family from its title",
        "Requires up to 0.5 years; you have 1",
        "Listing is missing an application URL or has an unusually thin description"]


def test_auto_apply_preconditions(spark):
    rows = [("1", "http://a", "A", "T", LONG, "AUTO_APPLY"), ("2", None, "A", "T", LONG, "AUTO_APPLY"),
            (None, "http://c", " ", "T", "x", "REVIEW"), ("4", "http://d", "A", "T", LONG, "AUTO_APPLY")]
    matches = spark.createDataFrame([("c1", *r) for r in rows], "candidate_id string, id string, application_url string, company string, title string, description string, application_decision string")
    applied = spark.createDataFrame([("c1", "9", "http://a"), ("c1", None, ""), ("c1", "4", "http://zzz"), ("c2", "1", "http://d")], "candidate_id string, job_id string, application_url string")
    got = {r["id"]: r for r in scoring.auto_apply_preconditions(matches, applied).collect()}
    assert [got[i]["not_already_applied"] for i in ("1", "2", None, "4")] == [False, False, False, False]
    none = spark.createDataFrame([], applied.schema)
    got = {r["id"]: r for r in scoring.auto_apply_preconditions(matches, none).collect()}
    assert got["1"]["eligible"] and got["4"]["eligible"] and not got["2"]["eligible"]
    assert got[None]["reasons"] == [
        "Company or title is missing", "Listing has no application URL or an unusually thin description",
        "Scoring decision is REVIEW, not AUTO_APPLY"]


def test_posting_side_is_read_once(spark):
    """The description must not travel with the pairs."""
    features = scoring.posting_features(spark.createDataFrame([], schemas.POSTINGS))
    assert "description" not in features.columns


VARIANTS = [
    {}, {"title": None}, {"title": ""}, {"title": "Product Counsel", "industry": "gambling "},
    {"location": None, "work_mode": None, "industry": None, "company_size": None},
    {"work_mode": "Onsite", "location": "Rome", "salary_max": 100000.0, "required_skills": ["Python tooling", "client calls"]},
    {"required_skills": None, "preferred_skills": None, "description": None, "application_url": None},
    {"required_skills": [], "preferred_skills": ["", "SQL"]}, {"title": "x " * 20_000, "description": "y " * 50_000},
]


def tables(spark, variants):
    """Postings of the variants, two candidates and one without any fact, all pairs and one pair without posting."""
    rows = [{**POSTING, **v, "id": f"p{i}"} for i, v in enumerate(variants)]
    postings = spark.createDataFrame(
        [tuple(r.get(f.name) for f in schemas.POSTINGS.fields) for r in rows], schemas.POSTINGS)
    people = [CANDIDATE, {**CANDIDATE, "candidate_id": "c2", "target_titles": ["Counsel"], "preferred_locations": []},
              {"candidate_id": "c3"}]
    candidates = spark.createDataFrame(
        [tuple(p.get(f.name) for f in schemas.CANDIDATES.fields) for p in people], schemas.CANDIDATES)
    pairs = [(r["id"], p["candidate_id"]) for r in rows for p in people] + [("gone", "c1")]
    return postings, candidates, spark.createDataFrame(pairs, "job_id string, candidate_id string")


def plain(frame):
    return sorted(repr(r.asDict(recursive=True)) for r in frame.collect())


def test_factors_give_the_same_rows(spark):
    given = tables(spark, VARIANTS)
    want = plain(scoring.score_pairs(*given))
    assert len(want) == 3 * len(VARIANTS) and plain(scoring.score_pairs_by_factors(*given)) == want


def test_factors_beyond_the_broadcast_bound(spark, monkeypatch):
    given = tables(spark, VARIANTS[:6])
    want = plain(scoring.score_pairs(*given))
    monkeypatch.setattr(factors, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    assert plain(scoring.score_pairs_by_factors(*given)) == want
    monkeypatch.setattr(factors, "HOT_PAIRS", 0)
    assert plain(scoring.score_pairs_by_factors(*given)) == want


def test_factors_of_empty_tables(spark):
    given = [frame.limit(0) for frame in tables(spark, [{}])]
    assert scoring.score_pairs_by_factors(*given).count() == 0


def test_pair_keys_carry_no_lists_or_maps(spark):
    postings, candidates, _ = tables(spark, [{}])
    persons = factors.person_keys(factors.people(candidates))
    kinds = [kind for frame in (factors.posting_keys(postings), persons) for _, kind in frame.dtypes]
    assert set(kinds) <= {"string", "boolean", "double", "binary"}
