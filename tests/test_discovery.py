"""Discovery runs over landed responses, from files to stored tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from rolesift import schemas
from rolesift.operators import collect
from rolesift.operators.discovery import Limits, collect_run, run_discovery
from rolesift.sources import key_store, landing, sinks
from rolesift.streaming.incremental import incremental_discovery, response_stream
from tests.test_scoring import CANDIDATE

DAY, NEXT = dt.date(2026, 3, 2), dt.date(2026, 3, 3)


def greenhouse(*jobs):
    return json.dumps({"jobs": [{"id": i, "title": t, "location": {"name": p}, "content": "x" * 60,
                                 "absolute_url": u, "updated_at": "2026-02-01T00:00:00Z"} for i, t, p, u in jobs]})


def hits(*rows):
    return json.dumps({"jobPostings": [{"externalPath": p, "title": t, "bulletFields": ["id", place]} for p, t, place in rows]})


FULL_PAGE = [(f"/j{i}", "Chef", "Pune") for i in range(19)] + [("/a", "Business Analyst", "Pune")]
RESPONSES = [
    # connector, source, source_no, query_no, page_no, body
    ("greenhouse", "acme", 0, 0, 0, greenhouse(
        (1, "Product Manager", "Pune", "https://x.example.com/1"), (2, "Cook", "Pune", "https://x.example.com/2"),
        (3, "Business Analyst", "Rome", "https://x.example.com/3"), (4, "", "Pune", None),
        (5, "Product Manager", "Remote", "https://x.example.com/1?ref=again"), (None, "Product Manager", "", None))),
    ("greenhouse", "down", 1, 0, 0, None),
    ("lever", "beta", 0, 0, 0, json.dumps([
        {"id": "L1", "text": "Project Coordinator", "categories": {"location": "Pune"}, "descriptionPlain": "hybrid, 0 - 1 years",
         "hostedUrl": "https://x.example.com/1", "createdAt": 1767312000000,
         "lists": [{"text": "Skills", "content": "<li>SQL</li><li>Jira is a plus</li>"}]}])),
    ("ashby", "gamma", 0, 0, 0, json.dumps({"jobs": [
        {"id": "A1", "title": "Business Analyst", "location": "", "isRemote": True, "applyUrl": "https://a.example.com/1",
         "compensation": {"scrapeableCompensationSalarySummary": "$1K - $2K"}},
        {"id": "A2", "title": "Business Analyst", "isListed": False}]})),
    ("smartrecruiters", "delta", 0, 0, 0, json.dumps({"content": [
        {"id": "S1", "name": "Program Manager", "location": {"city": "Pune", "hybrid": True}, "releasedDate": "2026-02-03T1"}]})),
    ("smartrecruiters", "delta", 0, 0, 1, json.dumps({"content": [{"id": "S2", "name": "Program Manager"}]})),
    ("workday", "Omega", 0, 0, 0, hits(*FULL_PAGE)),
    ("workday", "Omega", 0, 0, 1, hits(("/a", "Business Analyst", "Pune"), (None, "x", "y"), ("/b", "Business Analyst", "Rome"))),
    ("workday", "Omega", 0, 1, 0, hits(("/a", "Business Analyst", "Pune"), ("/c", "Product Analyst", "Pune"))),
]
DETAILS = [("Omega", "/a", json.dumps({"jobPostingInfo": {
    "title": "Business Analyst", "location": "Pune", "jobReqId": "R1", "externalUrl": "https://w.example.com/a",
    "jobDescription": "<p>Must have skills : SQL, Excel</p><p>Good to have skills : NA</p><p>minimum 1 years</p>"}}))]


@pytest.fixture(scope="module")
def inputs(spark):
    responses = spark.createDataFrame([("c1", *r) for r in RESPONSES], schemas.RESPONSES)
    details = spark.createDataFrame(DETAILS, "source_key string, path string, payload string")
    candidates = spark.createDataFrame([tuple(CANDIDATE.get(f.name) for f in schemas.CANDIDATES.fields)], schemas.CANDIDATES)
    return responses, details, candidates, spark.createDataFrame([], schemas.DISCOVERED)


@pytest.fixture(scope="module")
def first(inputs):
    responses, details, candidates, empty = inputs
    return run_discovery(responses, details, empty, candidates, DAY, 0)


def test_first_run(first):
    rows = {r["source_job_id"]: r for r in first.new.collect()}
    # L1 comes first in connector order and holds the URL of both greenhouse copies.
    assert sorted(rows) == ["A1", "L1", "R1", "S1"]
    assert rows["L1"]["required_skills"] == ["SQL"] and rows["L1"]["preferred_skills"] == ["Jira is a plus"]
    assert (rows["L1"]["work_mode"], rows["L1"]["posted_date"]) == ("hybrid", dt.date(2026, 1, 2))
    assert (rows["A1"]["location"], rows["A1"]["work_mode"], rows["A1"]["salary_max"]) == ("Remote", "remote", 2000.0)
    assert rows["R1"]["required_skills"] == ["SQL", "Excel"] and rows["R1"]["preferred_skills"] == []
    assert rows["R1"]["id"] == "workday-omega-business-analyst-r1"
    assert (rows["S1"]["location"], rows["S1"]["work_mode"]) == ("Pune", "hybrid")
    assert {r["first_seen_at"] for r in rows.values()} == {DAY}
    assert {r["application_decision"] for r in rows.values()} <= {"AUTO_APPLY", "REVIEW", "SKIP"}


def test_first_run_figures(first):
    stats = {r["source"]: r.asDict() for r in first.stats.collect()}
    pick = lambda s: tuple(stats[s][c] for c in (
        "attempted", "found", "parsed", "malformed", "rejected", "duplicates", "new_unique", "errors", "status"))
    assert pick("greenhouse:acme") == (1, 6, 2, 2, 2, 2, 0, 0, "ok")
    assert pick("greenhouse:down") == (1, 0, 0, 0, 0, 0, 0, 1, "unavailable")
    assert pick("ashby:gamma") == (1, 2, 1, 0, 1, 0, 1, 0, "ok")
    # The first page is short, so the second would never have been requested.
    assert pick("smartrecruiters:delta") == (1, 1, 1, 0, 0, 0, 1, 0, "ok")
    # /a is taken once, misses count each time, the missing detail of /c is an error.
    assert pick("workday:omega") == (3, 25, 1, 1, 20, 0, 1, 1, "ok")
    assert [(r["source_key"], r["f_id"]) for r in first.lost.collect()] == [("Omega", "/c")]
    assert first.totals.first().asDict() == {
        "candidate_id": "c1", "fetched": 6, "duplicates": 2, "rediscovered": 0, "new": 4,
        "shortlisted": first.new.filter("status = 'shortlisted'").count()}


def test_second_run_adds_nothing(inputs, first):
    responses, details, candidates, _ = inputs
    again = run_discovery(responses, details, first.postings, candidates, NEXT, 1)
    assert again.new.count() == 0
    assert again.postings.count() == first.postings.count()
    assert {(r["first_seen_at"], r["last_seen_at"]) for r in again.postings.collect()} == {(DAY, NEXT)}
    totals = again.totals.first()
    assert (totals["duplicates"], totals["rediscovered"], totals["new"]) == (6, 4, 0)
    scores = lambda d: {r["id"]: (r["score"], r["decision_reason"]) for r in d.postings.collect()}
    assert scores(again) == scores(first)


def test_job_cap(inputs):
    responses, details, candidates, empty = inputs
    capped = run_discovery(responses, details, empty, candidates, DAY, 0, Limits(max_jobs=1))
    stats = {r["source"]: r for r in capped.stats.collect()}
    # Rows behind the first kept one of a source are not counted at all.
    assert (stats["greenhouse:acme"]["parsed"], stats["greenhouse:acme"]["rejected"], stats["greenhouse:acme"]["found"]) == (1, 0, 6)
    # The path behind the first detail is not asked for, so it is no error.
    assert (stats["workday:omega"]["parsed"], stats["workday:omega"]["errors"]) == (1, 0)


def numbered_pages(connector, n_pages, size):
    body = lambda p: json.dumps({"content": [{"id": f"{p}-{i}", "name": "Program Manager"} for i in range(size)]} if connector == "smartrecruiters"
                                else {"jobs": [{"id": p * size + i, "title": "Program Manager"} for i in range(size)]})
    return [("c1", connector, "big", 0, 0, p, body(p)) for p in range(n_pages)]


def test_nothing_is_cut_unless_asked(spark, inputs):
    """Eight pages and 800 postings of a source that pages, 2,100 in 7 landed pages of one that does not."""
    _, details, candidates, empty = inputs
    landed = spark.createDataFrame(numbered_pages("smartrecruiters", 8, 100) + numbered_pages("greenhouse", 7, 300), schemas.RESPONSES)
    figures = lambda limits: {r["source"]: (r["attempted"], r["found"], r["parsed"]) for r in run_discovery(
        landed, details, empty, candidates, DAY, 0, limits).stats.collect()}
    assert figures(Limits()) == {"smartrecruiters:big": (8, 800, 800), "greenhouse:big": (7, 2100, 2100)}
    # The limit is looked at between pages; a connector without pages has none to leave out.
    assert figures(Limits(max_jobs=50)) == {"smartrecruiters:big": (1, 100, 50), "greenhouse:big": (7, 2100, 50)}
    assert figures(Limits(max_pages=3)) == {"smartrecruiters:big": (3, 300, 300), "greenhouse:big": (7, 2100, 2100)}


def test_unlisted_and_latest_detail(spark):
    flags = ["{}", '{"isListed": null}', '{"isListed": false}', '{"isListed": true}', '{"isListed": 0}', '{"isListed": ""}']
    df = spark.createDataFrame([(f,) for f in flags], "p string")
    assert [r[0] for r in df.select(collect.is_unlisted(F.lit("ashby"), F.col("p"))).collect()] == [False, True, True, False, True, True]
    details = spark.createDataFrame([("s", "/a", "z-first", 1), ("s", "/a", "a-later", 2)], "source_key string, path string, payload string, ordinal int")
    hits = spark.createDataFrame([("s", "/a", "x"), ("s", "/b", "y")], "source_key string, f_id string, payload string")
    assert sorted((r["f_id"], r["payload"]) for r in collect.with_details(hits, details).collect()) == [("/a", "a-later"), ("/b", None)]


def test_landing_is_read_once_and_not_moved(spark, inputs, tmp_path):
    """Neither body nor entries go through a shuffle, and one scan serves postings and figures."""
    responses, details, candidates, _ = inputs
    responses.write.parquet(str(tmp_path / "landed"))
    landed = spark.read.schema(schemas.RESPONSES).parquet(str(tmp_path / "landed"))
    collected = collect_run(landed, details, candidates, DAY, 0)
    for frame in (collected.requests, collected.seen, collected.postings):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "FileScan parquet" not in plan
        assert "entries" not in plan


def test_streaming_run_is_idempotent(spark, inputs, tmp_path):
    responses, details, candidates, _ = inputs
    landed = str(tmp_path / "landed")
    paths = {n: str(tmp_path / n) for n in ("postings", "stats", "notes", "progress")}

    def drain():
        incremental_discovery(
            response_stream(spark, landed), lambda: details, lambda: candidates, paths["postings"], paths["stats"],
            paths["notes"], paths["progress"], lambda: DAY).awaitTermination(240)

    responses.coalesce(1).write.mode("append").parquet(landed)
    drain()
    stored = landing.read_history(spark, paths["postings"])
    assert stored.count() == 4 and key_store.read_keys(spark, paths["postings"]).count() > 4
    responses.filter("connector = 'lever'").coalesce(1).write.mode("append").parquet(landed)
    drain()
    drain()
    assert landing.read_history(spark, paths["postings"]).count() == 4
    # The second batch appended a sighting and no posting.
    appended = lambda name: spark.read.parquet(f"{paths['postings']}/{name}").filter("version = 1").count()
    assert (appended("postings"), appended("keys"), appended("sightings")) == (0, 0, 1)
    assert spark.read.parquet(paths["stats"]).select("version").distinct().count() == 2


def test_response_files(spark, tmp_path):
    for connector, key, source_no, query_no, page_no, body in RESPONSES:
        folder = tmp_path / f"candidate_id=c1/connector={connector}/source_key={key}/source_no={source_no}/query_no={query_no}/page_no={page_no}"
        folder.mkdir(parents=True)
        (folder / "body.json").write_text(body or "\n", encoding="utf-8")
    pages = landing.response_pages(landing.read_responses(spark, str(tmp_path)))
    got = {(r["connector"], r["source_key"], r["query_no"], r["page_no"]): (r["n_rows"], r["failed"]) for r in pages.collect()}
    assert len(got) == len(RESPONSES)
    assert got[("greenhouse", "acme", 0, 0)] == (6, False) and got[("greenhouse", "down", 0, 0)] == (0, True)
    assert got[("workday", "Omega", 0, 0)] == (20, False)
    assert landing.read_raw_postings(spark, str(tmp_path)).count() == sum(n for n, _ in got.values())


@pytest.mark.parametrize("content,ids", [
    ('[{"id": "1", "salary_max": 5}, "stray", null, 7, {"title": "sparse"}]', ["1", None]),
    ("", []), ("not json", []), ('{"id": "1"}', []), ("[]", []),
])
def test_tolerant_read(spark, tmp_path, content, ids):
    (tmp_path / "jobs.json").write_text(content, encoding="utf-8")
    got = landing.read_postings(spark, str(tmp_path / "jobs.json")).orderBy("ordinal").collect()
    assert [r["id"] for r in got] == ids


def test_missing_files(spark, tmp_path):
    assert landing.read_postings(spark, str(tmp_path / "no.json")).count() == 0
    assert landing.read_sources(spark, str(tmp_path / "no.json")).count() == 0
    assert landing.read_latest(spark, str(tmp_path / "no"), schemas.DISCOVERED).count() == 0


def test_read_candidates_and_sources(spark, tmp_path):
    capabilities = {c["key"]: {"strength": c["strength"], "evidence": c["evidence"]} for c in CANDIDATE["capabilities"]}
    (tmp_path / "c.json").write_text(json.dumps({**CANDIDATE, "capabilities": capabilities}, indent=1), encoding="utf-8")
    row = landing.read_candidates(spark, str(tmp_path / "c.json")).first()
    assert [c["key"] for c in row["capabilities"]] == [c["key"] for c in CANDIDATE["capabilities"]]
    assert row["candidate_id"] == "c1" and row["skills"] == CANDIDATE["skills"]
    registry = {"greenhouse_boards": ["a", "b"], "lever_companies": ["c"], "workday": [{"name": "W", "cxs_base_url": "u"}], "_note": "x"}
    (tmp_path / "s.json").write_text(json.dumps(registry, indent=1), encoding="utf-8")
    got = {tuple(r) for r in landing.read_sources(spark, str(tmp_path / "s.json")).collect()}
    assert got == {("greenhouse", "a", 0), ("greenhouse", "b", 1), ("lever", "c", 0), ("workday", "W", 0)}


def test_sinks(spark, first, tmp_path):
    path = str(tmp_path / "postings")
    sinks.write_postings(first.postings, path, 0, dry_run=True)
    assert not (tmp_path / "postings").exists()
    sinks.write_postings(first.postings, path, 0)
    sinks.write_postings(landing.read_latest(spark, path, schemas.DISCOVERED).limit(2), path, 1)
    assert landing.read_latest(spark, path, schemas.DISCOVERED).count() == 2
    assert landing.read_latest(spark, path, schemas.DISCOVERED, before=1).count() == first.postings.count()
    forced = first.new.withColumns({"status": F.lit("shortlisted"), "application_decision": F.lit("REVIEW")})
    for _ in range(2):
        sinks.write_shortlist(forced, str(tmp_path / "notes"))
    notes = spark.read.parquet(str(tmp_path / "notes"))
    assert notes.count() == first.new.count() and {r[0] for r in notes.select("application_decision").distinct().collect()} == {"REVIEW"}
    records = spark.createDataFrame([("j1", "COMPLETED"), ("j2", None)], "job_id string, status string")
    for hour in (1, 2):
        sinks.write_artifacts(records, str(tmp_path / "analyses"), F.lit(dt.datetime(2026, 3, 2, hour)))
    latest = landing.latest_artifacts(spark.read.parquet(str(tmp_path / "analyses")), ["job_id"])
    assert [(r["job_id"], r["written_at"].hour) for r in latest.collect()] == [("j1", 2)]
    reviews = spark.createDataFrame(
        [("j1", "APPROVED", 5), ("j2", "done", 9)], "job_id string, review_status string, overall_quality int")
    for name in ("analysis_quality", "resume_quality", "cover_letter_quality", "answers_quality", "truthfulness"):
        reviews = reviews.withColumn(name, F.lit(None).cast("int"))
    sinks.write_reviews(reviews, str(tmp_path / "reviews"), str(tmp_path / "bad"))
    assert [r["job_id"] for r in spark.read.parquet(str(tmp_path / "reviews")).collect()] == ["j1"]
    assert len(spark.read.parquet(str(tmp_path / "bad")).first()["errors"]) == 2


def test_a_broken_run_is_not_seen(spark, tmp_path, monkeypatch):
    """Readers take runs of the manifest only, which is written behind the tables."""
    path = str(tmp_path / "history")
    one = {name: spark.createDataFrame([tuple(None for _ in schema.fields)], schema)
           for name, schema in (("new", schemas.DISCOVERED), ("keys", schemas.KEYS), ("sightings", schemas.SIGHTINGS))}

    def stored():
        return landing.read_history(spark, path).count(), key_store.read_keys(spark, path).count()

    assert stored() == (0, 0)
    sinks.append_run(**one, path=path, run_no=0)
    assert stored() == (1, 1)
    written, plain = [], sinks.write_version

    def failing(df, to, version):
        if written:
            raise OSError("lost")
        written.append(to) if to.endswith("postings") else None
        plain(df, to, version)

    for run_no in (1, 0):  # a new run, and one that is written again
        written.clear()
        monkeypatch.setattr(sinks, "write_version", failing)
        with pytest.raises(OSError, match="lost"):
            sinks.append_run(**one, path=path, run_no=run_no)
        monkeypatch.setattr(sinks, "write_version", plain)
        assert stored() == ((1, 1) if run_no == 1 else (0, 0))
    for run_no in (0, 1):
        sinks.append_run(**one, path=path, run_no=run_no)
    assert stored() == (2, 2)
