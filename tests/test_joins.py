"""Joins of sides that may be wide, long or crowded."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolesift import schemas
from rolesift.operators import joins, scoring
from tests.test_scoring import CANDIDATE, POSTING


def plan_of(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def on_disk(df, path):
    """``df`` as files, whose size Spark knows."""
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def broadcasts_of_parts(df) -> list[str]:
    return [line for line in plan_of(df).splitlines() if "BroadcastHashJoin" in line and "_salt" in line]


def test_parted_join_cuts_crowded_keys_only(spark, monkeypatch):
    monkeypatch.setattr(joins, "ROWS_PER_PART", 3)
    left = spark.createDataFrame(
        [(k, i) for k, n in (("a", 10), ("b", 3), ("c", 1), (None, 7)) for i in range(n)], "k string, i int")
    right = spark.createDataFrame([("a", 1), ("b", 2), ("z", 3), (None, 4)], "k string, v int")
    for how in ("inner", "left"):
        got = joins.parted_join(left, right, ["k"], F.col("i"), how)
        assert got.columns == ["k", "i", "v"]
        assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k", how).collect()))


def applied(spark, tmp_path):
    match = ("c1", "p1", "https://x/1", "Acme", "Manager", "Text " * 20, "AUTO_APPLY")
    matches = spark.createDataFrame(
        [match, ("c1", "p2", None, *match[3:]), ("c2", "p1", *match[2:]), (None, None, *match[2:])],
        "candidate_id string, id string, application_url string, company string, title string, description string, application_decision string")
    applications = spark.createDataFrame(
        [("c1", "p9", "https://x/1"), ("c1", "p2", None), ("c2", "p3", "")], "candidate_id string, job_id string, application_url string")
    return scoring.auto_apply_preconditions(matches, on_disk(applications, tmp_path / "applications"))


def test_applications_are_not_sent_to_the_driver_in_parts(spark, tmp_path):
    rows = applied(spark, tmp_path)
    assert not broadcasts_of_parts(rows)
    assert {(r["candidate_id"], r["id"]): r["not_already_applied"] for r in rows.collect()} == {
        ("c1", "p1"): False, ("c1", "p2"): False, ("c2", "p1"): True, (None, None): True}


def test_candidates_are_not_sent_to_the_driver_in_parts(spark, tmp_path):
    owned = T.StructType([*schemas.POSTINGS.fields, T.StructField("candidate_id", T.StringType())])
    rows = [{**POSTING, "id": f"p{i}", "candidate_id": c} for i, c in enumerate(["c1", "c1", "other", None])]
    postings = spark.createDataFrame([tuple(r.get(f.name) for f in owned.fields) for r in rows], owned)
    candidates = spark.createDataFrame([tuple(CANDIDATE.get(f.name) for f in schemas.CANDIDATES.fields)], schemas.CANDIDATES)
    rows = scoring.annotate_match(postings, on_disk(candidates, tmp_path / "candidates"))
    assert not broadcasts_of_parts(rows)
    assert sorted((r["id"], r["title"], r["candidate_id"]) for r in rows.collect()) == [
        ("p0", POSTING["title"], "c1"), ("p1", POSTING["title"], "c1")]


def test_many_pairs_are_dealt_by_their_number(spark, monkeypatch):
    candidates = spark.createDataFrame(
        [tuple({**CANDIDATE, "candidate_id": c}.get(f.name) for f in schemas.CANDIDATES.fields) for c in ("c1", "c2")], schemas.CANDIDATES)
    postings = spark.createDataFrame(
        [tuple({**POSTING, "id": f"p{i}"}.get(f.name) for f in schemas.POSTINGS.fields) for i in range(6)], schemas.POSTINGS)
    pairs = spark.createDataFrame([(f"p{i}", c) for i in range(6) for c in ("c1", "c2", "c3", None)], "job_id string, candidate_id string")
    plain = sorted(map(str, scoring.score_pairs(postings, candidates, pairs).collect()))
    for name, value in (("MANY_ROWS", 5), ("ROWS_PER_TASK", 2), ("ROWS_PER_PART", 2)):
        monkeypatch.setattr(joins, name, value)
    assert scoring.pair_rows(postings, candidates, pairs).rdd.getNumPartitions() == 12
    assert sorted(map(str, scoring.score_pairs(postings, candidates, pairs).collect())) == plain
    monkeypatch.setattr("rolesift.operators.factors.BROADCAST_ROWS", 0)
    assert sorted(map(str, scoring.score_pairs_by_factors(postings, candidates, pairs).collect())) == plain
    assert len(plain) == 12


def test_rows_of_one_row_group_are_dealt_over_tasks(spark, tmp_path):
    from rolesift.plans import views
    spark.range(10).selectExpr("id AS c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    rows = views.spark_view(spark, str(tmp_path), "customer", [("k", "c_custkey")])
    assert "Exchange RoundRobin" in plan_of(rows)
    assert sorted(r["k"] for r in rows.collect()) == list(range(10))


def test_rows_that_are_few_bytes_are_still_dealt_over_all_cores(spark, tmp_path):
    from rolesift.plans import views
    spark.range(1000).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    rows = views.spark_view(spark, str(tmp_path), "part", [("k", "p_partkey")])
    assert rows.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_crowded_keys_are_found_without_counting_every_key(spark, monkeypatch):
    monkeypatch.setattr(joins, "ROWS_PER_PART", 3)
    rows = spark.createDataFrame(
        [(k, i) for k, n in (("a", 10), ("b", 3), ("c", 1), (None, 7)) for i in range(n)], "k string, i int")
    assert sorted(map(tuple, joins.crowded_counts(rows, ["k"]).collect()), key=str) == [("a", 10), (None, 7)]
    monkeypatch.setattr(joins, "KEY_BUCKETS", 1)
    assert sorted(map(tuple, joins.crowded_counts(rows, ["k"]).collect()), key=str) == [("a", 10), (None, 7)]


def test_pairs_take_the_same_way_at_six_and_sixty_times_the_tables():
    assert [joins.tasks_for(n) for n in (600_000, 3_600_000, 36_000_000)] == [None, 15, 144]


def test_profiles_are_parsed_once_and_not_broadcast(spark, tmp_path):
    from rolesift.operators.candidates import candidate_context
    text = "## Experience overview\n- Previous roles:\n  - Clerk, Acme Corp\n  - Clerk, ACME corp\n  - Analyst, Beta - Pune\n\n## Education\n- School\n"
    profiles = on_disk(spark.createDataFrame([("c1", text), ("c2", None)], "candidate_id string, markdown string"), tmp_path / "profiles")
    candidates = spark.createDataFrame(
        [tuple({**CANDIDATE, "candidate_id": c}.get(f.name) for f in schemas.CANDIDATES.fields) for c in ("c1", "c2", "c3")], schemas.CANDIDATES)
    rows = candidate_context(on_disk(candidates, tmp_path / "candidates"), profiles).select("candidate_id", "verified_employers")
    assert "Broadcast" not in plan_of(rows)
    assert plan_of(rows).count("regexp_extract_all") <= 3
    found = {r["candidate_id"]: r["verified_employers"] for r in rows.collect()}
    assert found == {"c1": ["Acme Corp", "Beta"], "c2": [], "c3": []}


def test_a_side_repeated_for_the_parts_of_a_key_is_not_sent_to_the_driver(spark, tmp_path):
    left = spark.createDataFrame([(k, i) for k, n in (("a", 40), ("b", 3), (None, 2)) for i in range(n)], "k string, i int")
    right = on_disk(spark.createDataFrame([("a", 1), ("z", 2), (None, 3)], "k string, v int"), tmp_path / "right")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = joins.salted_join(left, right, ["k"], F.col("i"), how)
        assert not broadcasts_of_parts(got)
        assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k", how).collect()))


def test_postings_of_many_pairs_are_dealt_by_their_number_to_their_candidates(spark, monkeypatch):
    owned = T.StructType([*schemas.POSTINGS.fields, T.StructField("candidate_id", T.StringType())])
    rows = [{**POSTING, "id": f"p{i}", "candidate_id": c} for i, c in enumerate(["c1"] * 5 + ["c2", "other", None])]
    postings = spark.createDataFrame([tuple(r.get(f.name) for f in owned.fields) for r in rows], owned)
    candidates = spark.createDataFrame(
        [tuple({**CANDIDATE, "candidate_id": c}.get(f.name) for f in schemas.CANDIDATES.fields) for c in ("c1", "c2", "c3")], schemas.CANDIDATES)
    plain = sorted(map(str, scoring.annotate_match(postings, candidates).collect()))
    for name, value in (("MANY_ROWS", 5), ("ROWS_PER_TASK", 1), ("ROWS_PER_PART", 2)):
        monkeypatch.setattr(joins, name, value)
    dealt = scoring.annotate_match(postings, candidates)
    assert dealt.rdd.getNumPartitions() == 8
    assert sorted(map(str, dealt.collect())) == plain and len(plain) == 6


def test_the_shortlist_reads_a_finished_decision(spark):
    owned = T.StructType([*schemas.POSTINGS.fields, T.StructField("candidate_id", T.StringType())])
    rows = [{**POSTING, "id": i, "title": t, "candidate_id": "c1"} for i, t in (("p0", POSTING["title"]), ("p1", "Chief Counsel"))]
    postings = spark.createDataFrame([tuple(r.get(f.name) for f in owned.fields) for r in rows], owned)
    candidates = spark.createDataFrame([tuple(CANDIDATE.get(f.name) for f in schemas.CANDIDATES.fields)], schemas.CANDIDATES)
    matches = scoring.annotate_match(postings, candidates)
    kept = scoring.shortlisted(matches)
    plan = kept._jdf.queryExecution().optimizedPlan().toString().splitlines()
    tests = [line for line in plan if "Filter" in line and "shortlisted" in line]
    assert tests and not any("CASE" in line for line in tests)
    assert kept.columns == matches.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in matches.collect() if r["status"] == "shortlisted")
    assert kept.count() == 1


def test_pairs_move_to_large_factor_tables_before_they_carry_texts(spark, monkeypatch):
    from rolesift.operators import factors
    candidates = spark.createDataFrame([tuple(CANDIDATE.get(f.name) for f in schemas.CANDIDATES.fields)], schemas.CANDIDATES)
    postings = spark.createDataFrame(
        [tuple({**POSTING, "id": f"p{i}", "required_skills": [f"Skill{i} writing"]}.get(f.name) for f in schemas.POSTINGS.fields)
         for i in range(40)], schemas.POSTINGS)
    pairs = spark.createDataFrame([(f"p{i}", "c1") for i in range(40)], "job_id string, candidate_id string")
    plain = sorted(map(str, scoring.score_pairs(postings, candidates, pairs).collect()))
    monkeypatch.setattr(joins, "MANY_ROWS", 5)
    monkeypatch.setattr(factors, "BROADCAST_ROWS", 20)
    moved = []
    monkeypatch.setattr(factors, "parted_join", lambda left, *rest: moved.append(left.columns) or joins.parted_join(left, *rest))
    assert sorted(map(str, scoring.score_pairs_by_factors(postings, candidates, pairs).collect())) == plain
    assert len(moved) == 1 and not {"capability", "family_status", "location", "industry"} & set(moved[0])


def test_features_that_travel_with_very_many_pairs_are_packed(spark, monkeypatch):
    from rolesift.operators import pair_rules
    lists = [None, [], ["SQL"], ["The Lead, with writing reports", None, ""], ["Python programming", "Python programming"]]
    postings = spark.createDataFrame(
        [tuple({**POSTING, "id": f"p{i}", "required_skills": a, "preferred_skills": lists[-1 - i], "location": b, "industry": b}.get(f.name)
               for f in schemas.POSTINGS.fields) for i, (a, b) in enumerate(zip(lists, [None, "", "\t Pune ", "REMOTE ", "İstanbul"], strict=True))],
        schemas.POSTINGS)
    features = pair_rules.posting_features(postings)
    packed = pair_rules.packed_features(features)
    assert not {"place_key", "mode_key", "industry_key"} & set(packed.columns)
    assert packed.schema["required_words"].dataType.elementType["words"].dataType == T.StringType()
    again = pair_rules.unpacked_features(packed).select(features.columns)
    assert again.schema["required_words"].dataType.simpleString() == features.schema["required_words"].dataType.simpleString()
    assert sorted(map(str, again.collect())) == sorted(map(str, features.collect()))
    candidates = spark.createDataFrame([tuple(CANDIDATE.get(f.name) for f in schemas.CANDIDATES.fields)], schemas.CANDIDATES)
    pairs = spark.createDataFrame([(f"p{i}", "c1") for i in range(5)], "job_id string, candidate_id string")
    plain = sorted(map(str, scoring.score_pairs(postings, candidates, pairs).collect()))
    monkeypatch.setattr(joins, "MANY_ROWS", 1)
    rows = scoring.pair_rows(postings, candidates, pairs)
    assert "array_join" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, scoring.score_pairs(postings, candidates, pairs).collect())) == plain and len(plain) == 5
