"""Queries of requests, responses, packages and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolesift import rules, schemas
from rolesift.functions.notes import shortlist_note
from rolesift.operators import artifact_run, artifacts, reviews, scoring
from rolesift.operators.candidates import candidate_context, profile_hash
from rolesift.plans import oracle as o
from rolesift.plans import views
from rolesift.plans.collect_queries import BROWSE, BROWSE_SQL, browse_rows
from rolesift.plans.text_queries import SPARK_PROFILE, VALIDATION, _gap_issue, issues_cte
from rolesift.plans.text_queries import EMP_ISSUES, NUM_ISSUES, YEARS_ISSUES
from rolesift.session import scratch_folder
from rolesift.sources import sinks
from rolesift.sources.landing import latest_artifacts, parse_candidates

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = (function, sql)
        return function
    return add


# Response rows: the whole text of a document as the generated text of one job.
RESPONSES = [
    *views.DRAFTS, ("n", "doc_id"), ("candidate_id", "concat('C', doc_id % 2)"), ("job_id", "concat('P', doc_id - doc_id % 2)"), ("lang", "lang"), ("source", "source"), ("text", "text"),
    ("call_error", "CASE WHEN doc_id % 11 = 4 THEN 'timeout' END"),
    ("analysis_status", views.pick(["COMPLETED", "NEEDS_REVIEW", "COMPLETED", "FAILED", "COMPLETED", None, "COMPLETED"], "doc_id % 7")),
    ("cache_key", "concat('key', doc_id % 3)"),
]
RESPONSES_SQL = views.ansi_view("documents", RESPONSES)


def response_rows(spark, sf):
    rows = views.spark_view(spark, sf, "documents", RESPONSES)
    return rows.withColumns({
        "total_experience_years": F.col("years"), "verified_employers": F.col("employers"), "evidence_blob": F.col("blob"),
        "skills": F.expr("array('SQL', upper(lang))"), "name": F.concat(F.lit("Person "), "source"),
        "contact_section": F.lit("- Mail: x"), "experience_section": F.lit("- Worked 2021"), "education_section": F.lit(""),
    })


def fenced(json, every: int):
    """Every n-th response comes in a code fence, as generators like to answer."""
    return F.when(F.col("n") % every == 1, F.concat(F.lit(" ```json\n"), json, F.lit("\n``` \n"))).otherwise(json)


ERROR_SQL = "coalesce(call_error, CASE WHEN n % 5 = 3 THEN 'Response was not valid JSON' END)"


# --- analysis -------------------------------------------------------------------------

@query("intake_analysis", f"""SELECT candidate_id, job_id, CASE WHEN {ERROR_SQL} IS NOT NULL THEN 'FAILED' WHEN n % 5 = 2 THEN 'NEEDS_REVIEW' ELSE 'COMPLETED' END AS status,
  CASE WHEN {ERROR_SQL} IS NOT NULL THEN {ERROR_SQL} WHEN n % 5 = 2 THEN 'Analysis missing required fields: [''company'', ''confidence'']' END AS error,
  CASE WHEN {ERROR_SQL} IS NULL THEN md5(text) END AS mission, CASE WHEN {ERROR_SQL} IS NULL THEN lang END AS keywords FROM {RESPONSES_SQL}""")
def intake_analysis(spark, sf):
    scalar = {"target_role", "company", "core_mission", "application_strategy"}
    values = {f: "array(lang)" for f in rules.ANALYSIS_FIELDS if f not in scalar}
    values |= {f: "source" for f in scalar} | {"core_mission": "text", "confidence": "0.5D"}
    struct = lambda fields: "to_json(named_struct(" + ", ".join(f"'{f}', {values[f]}" for f in fields) + "))"
    full, part = struct(rules.ANALYSIS_FIELDS), struct([f for f in rules.ANALYSIS_FIELDS if f not in ("company", "confidence")])
    raw = F.expr(f"CASE n % 5 WHEN 2 THEN {part} WHEN 3 THEN substring({full}, 1, length({full}) - 3) ELSE {full} END")
    rows = response_rows(spark, sf).withColumn("raw", fenced(raw, 5))
    return artifacts.intake_analysis(rows).select(
        "candidate_id", "job_id", "status", "error", F.md5("analysis.core_mission").alias("mission"),
        F.array_join("analysis.resume_keywords", "|").alias("keywords"))


@query("parse_generated_json", "SELECT event_id, event_id % 4 IN (2, 3) AS failed, CASE WHEN event_id % 4 IN (0, 1) THEN regexp_extract(props, '[0-9]+') END AS k FROM events")
def parse_generated_json(spark, sf):
    """events.props as responses: plain, fenced, with trailing text, and cut off."""
    props = F.col("props")
    kind = F.col("event_id") % 4
    raw = (
        F.when(kind == 0, props).when(kind == 1, F.concat(F.lit("```json\n"), props, F.lit("\n```")))
        .when(kind == 2, F.concat(props, F.lit(" and so on"))).otherwise(F.expr("substring(props, 1, length(props) - 1)")))
    rows = views.table(spark, sf, "events").select("event_id", raw.alias("raw"), F.lit(None).cast("string").alias("call_error"))
    return artifacts.parse_generated_json(rows, "k STRING", []).select(
        "event_id", "failed", F.col("content.k").alias("k"))


@query("missing_fields", f"SELECT n, CASE n % 4 WHEN 0 THEN 'reason|body' WHEN 1 THEN '' WHEN 2 THEN 'cover_letter_needed|reason|body' ELSE 'cover_letter_needed' END AS missing FROM {RESPONSES_SQL}")
def missing_fields(spark, sf):
    body = F.expr("CASE n % 4 WHEN 0 THEN to_json(named_struct('cover_letter_needed', true, 'text', text)) WHEN 1 THEN to_json(named_struct('body', text, 'reason', '', "
                  "'cover_letter_needed', false)) WHEN 2 THEN '[1, 2]' ELSE to_json(named_struct('reason', source, 'body', text)) END")
    return response_rows(spark, sf).withColumn("b", body).select(
        "n", F.array_join(artifacts.missing_fields("b", rules.COVER_LETTER_FIELDS), "|").alias("missing"))


# --- resume and letter ------------------------------------------------------------------

def clean_sql(x: str) -> str:
    return o.strip(
        f"array_to_string(list_transform(string_split(regexp_replace(regexp_replace({x}, '[ \\t]{{2,}}', ' ', 'g'), "
        f"'\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)), lambda l: rtrim(l, {o.WS})), chr(10))")


def pre_sql(text: str) -> str:
    return (f"CASE WHEN coalesce(analysis_status, 'None') NOT IN ('COMPLETED', 'NEEDS_REVIEW') THEN concat('{text}', coalesce(analysis_status, 'None'), ').') END")


RESUME_ERROR = (f"coalesce({pre_sql('Cannot tailor a resume without a completed job analysis (analysis status: ')}, {ERROR_SQL}, "
                "CASE WHEN n % 5 = 2 THEN 'Resume content missing required fields: [''highlighted_projects'', ''keywords_used'']' END)")
RESUME_ROWS = f"(SELECT * EXCLUDE (draft), concat({clean_sql('draft')}, chr(10), 'Did x,y', chr(10), 'Built z') AS draft, {clean_sql('draft')} AS summary, {RESUME_ERROR} AS error FROM {RESPONSES_SQL})"
RENDERED = ("concat('Person ', source, chr(10), '- Mail: x', chr(10), chr(10), 'SUMMARY', chr(10), summary, chr(10), chr(10), 'PROFESSIONAL EXPERIENCE', chr(10), '- Worked 2021', "
            "chr(10), chr(10), 'HIGHLIGHTS FOR THIS APPLICATION', chr(10), '- Did x,y', chr(10), chr(10), 'RELEVANT PROJECTS', chr(10), '- Built z', chr(10), chr(10), "
            "'SKILLS', chr(10), 'sql, Magic', chr(10), chr(10), 'EDUCATION', chr(10))")


@query("intake_resume", f"""WITH {issues_cte(RESUME_ROWS, 'text_id')},
  v AS (SELECT text_id, list_concat({VALIDATION}, list_concat(w3.issues, ['Skill(s) not in candidate profile: [''Magic'']'])) AS all_issues FROM {RESUME_ROWS} d JOIN w3 USING (text_id))
  SELECT candidate_id, job_id, CASE WHEN error IS NOT NULL THEN 'FAILED' ELSE 'NEEDS_REVIEW' END AS status, error, CASE WHEN error IS NULL THEN array_to_string(all_issues, '|') END AS issues,
    CASE WHEN error IS NULL THEN md5({RENDERED}) END AS rendered FROM {RESUME_ROWS} JOIN v USING (text_id)""")
def intake_resume(spark, sf):
    fields = "'summary', draft, 'highlighted_experience', array('Did  x,y'), 'skills_to_feature', array('sql', 'Magic')"
    full = f"to_json(named_struct({fields}, 'highlighted_projects', array(' Built z '), 'keywords_used', array()))"
    raw = F.expr(f"CASE n % 5 WHEN 2 THEN to_json(named_struct({fields})) WHEN 3 THEN concat({full}, '}}') ELSE {full} END")
    return artifacts.intake_resume(response_rows(spark, sf).withColumn("raw", fenced(raw, 5))).select(
        "candidate_id", "job_id", "status", "error", F.array_join("validation.issues", "|").alias("issues"), F.md5("rendered_text").alias("rendered"))


@query("render_resume", f"SELECT candidate_id, job_id, {RENDERED} AS resume FROM (SELECT *, text AS summary FROM {RESPONSES_SQL})")
def render_resume(spark, sf):
    content = F.struct(
        F.col("text").alias("summary"), F.expr("array('Did x,y')").alias("highlighted_experience"),
        F.expr("array('Built z')").alias("highlighted_projects"), F.expr("array('sql', 'Magic')").alias("skills_to_feature"))
    return response_rows(spark, sf).select("candidate_id", "job_id", artifacts.render_resume(content).alias("resume"))


@query("fabricated_skills", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'Magic' ELSE 'Magic|En' END AS made_up FROM documents")
def fabricated_skills(spark, sf):
    made_up = artifacts.fabricated_skills(F.expr("array('sql', 'Magic', 'En')"), F.expr("array('SQL', upper(lang))"))
    return views.table(spark, sf, "documents").select("doc_id", F.array_join(made_up, "|").alias("made_up"))


LETTER_ERROR = (f"coalesce({pre_sql('Cannot draft a cover letter without a completed job analysis (status: ')}, {ERROR_SQL}, "
                "CASE WHEN n % 5 = 2 THEN 'Cover letter response missing fields: [''body'']' END)")
LETTER_ROWS = f"(SELECT * EXCLUDE (draft), {clean_sql('draft')} AS draft, n % 3 <> 0 AS needed, {LETTER_ERROR} AS error FROM {RESPONSES_SQL})"


@query("intake_cover_letter", f"""WITH {issues_cte(LETTER_ROWS, 'text_id')},
  v AS (SELECT text_id, CASE WHEN needed THEN list_concat(list_concat(list_concat(list_concat({YEARS_ISSUES}, {EMP_ISSUES}), {NUM_ISSUES}), {_gap_issue(1)}), w3.issues) ELSE []::VARCHAR[] END AS all_issues
    FROM {LETTER_ROWS} d JOIN w3 USING (text_id))
  SELECT candidate_id, job_id, CASE WHEN error IS NOT NULL THEN 'FAILED' WHEN len(all_issues) > 0 THEN 'NEEDS_REVIEW' ELSE 'COMPLETED' END AS status, error,
    CASE WHEN error IS NULL THEN array_to_string(all_issues, '|') END AS issues, CASE WHEN error IS NULL THEN needed END AS needed,
    CASE WHEN error IS NULL THEN md5(CASE WHEN needed THEN draft ELSE '' END) END AS body FROM {LETTER_ROWS} JOIN v USING (text_id)""")
def intake_cover_letter(spark, sf):
    full = "to_json(named_struct('cover_letter_needed', n % 3 <> 0, 'reason', lang, 'body', draft))"
    raw = F.expr(f"CASE n % 5 WHEN 2 THEN to_json(named_struct('cover_letter_needed', true, 'reason', lang)) WHEN 3 THEN concat('x', {full}) ELSE {full} END")
    return artifacts.intake_cover_letter(response_rows(spark, sf).withColumn("raw", fenced(raw, 5))).select(
        "candidate_id", "job_id", "status", "error", F.array_join("validation.issues", "|").alias("issues"),
        F.col("cover_letter_needed").alias("needed"), F.md5("letter_body").alias("body"))


# --- answers ---------------------------------------------------------------------------

QUESTIONS = [
    *rules.STANDARD_QUESTIONS, "Do you have 2.5+ years of experience?", "have you at least 1 year in sales?",
    "When can you join?", "Need a visa?", "What compensation do you expect?", "Have you worked here before?",
]


def _fact_sql(question: str) -> tuple[str, str, str]:
    """(answer, confidence, reason) for a fixed question, as SQL over candidate columns."""
    user = "'NEEDS_USER_INPUT'"

    def known(test: str, answer: str, confidence: str, reason: str, otherwise: str) -> tuple[str, str, str]:
        return (f"CASE WHEN {test} THEN {answer} ELSE {user} END", f"CASE WHEN {test} THEN '{confidence}' ELSE {user} END",
                f"CASE WHEN {test} THEN '{reason}' ELSE '{otherwise}' END")

    years = "coalesce(total_experience_years, 0.0::DOUBLE)"
    if "2.5+" in question or "1 year" in question:
        need = "2.5" if "2.5" in question else "1"
        return (f"concat(CASE WHEN {years} >= {need} THEN 'Yes' ELSE 'No' END, ' -- ', {o.general(years)}, ' year(s) of verified professional experience.')", "'HIGH'",
                f"concat('Computed directly from the candidate profile (', {o.general(years)}, ' years) against the stated {need}-year threshold; not eligible per profile if ''No''.')")
    if "notice" in question:
        return user, user, "'Candidate profile does not contain a verified notice period.'"
    if "salary" in question or "compensation" in question:
        pay = ("concat('INR ', format('{:,d}', target_salary_min_inr_per_year::BIGINT), CASE WHEN target_salary_max_inr_per_year IS NOT NULL THEN "
               "concat(' - ', format('{:,d}', target_salary_max_inr_per_year::BIGINT)) ELSE '' END, ' per year')")
        return known("target_salary_min_inr_per_year IS NOT NULL", pay, "HIGH", "Directly from the candidate''s stated target salary range.", "No salary preference stored.")
    if "authorized" in question or "visa" in question:
        return known("work_authorization IS NOT NULL", "work_authorization", "HIGH", "Directly from the candidate''s stated work authorization.", "No work authorization stored.")
    if "relocate" in question:
        return known("len(preferred_locations) > 0", "concat('Open to roles in: ', array_to_string(preferred_locations, ', '), '.')", "MEDIUM",
                     "Derived from the candidate''s preferred locations; willingness for a specific city not asked in the posting is not separately confirmed.", "No location preference stored.")
    if "can you" in question:
        return known("earliest_start_date IS NOT NULL", "earliest_start_date", "HIGH", "Directly from the candidate''s stated earliest start date.", "No start date stored.")
    return "NULL::VARCHAR", "NULL::VARCHAR", "NULL::VARCHAR"


def facts_sql(questions: list[str], source: str) -> str:
    parts = []
    for position, question in enumerate(questions):
        answer, confidence, reason = _fact_sql(question)
        parts.append(f"SELECT *, {position} AS position, {views.literal(question)} AS question, {answer} AS f_answer, {confidence} AS f_confidence, {reason} AS f_reason FROM {source}")
    return "(" + " UNION ALL ".join(parts) + ")"


@query("deterministic_answer", f"SELECT candidate_id, position, f_answer AS answer, f_confidence AS confidence, f_reason AS reason FROM {facts_sql(QUESTIONS, views.CANDIDATES_SQL)}")
def deterministic_answer(spark, sf):
    rows = artifacts.with_questions(views.candidates(spark, sf), QUESTIONS)
    return rows.select("candidate_id", "position", "fact.answer", "fact.confidence", "fact.reason")


ANSWERED = [
    ("reply", "CASE WHEN position % 5 = 4 THEN 'NEEDS_USER_INPUT' WHEN position = 3 AND n % 4 = 0 THEN ' ' ELSE draft END"),
    ("sure", views.pick(["HIGH", "certain", None, "MEDIUM"], "n % 4")),
]
ANSWER_SOURCE = f"(SELECT r.* EXCLUDE (candidate_id), c.* EXCLUDE (capabilities, skills, name) FROM {RESPONSES_SQL} r JOIN {views.CANDIDATES_SQL} c ON c.candidate_id = concat('C', r.n))"
ANSWER_ROWS = (
    "(SELECT * EXCLUDE (draft, years), coalesce(total_experience_years, 0.0::DOUBLE) AS years, reply AS draft, "
    "CASE WHEN sure IN ('HIGH', 'MEDIUM') THEN sure ELSE 'LOW' END AS stated FROM "
    f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in ANSWERED)} FROM {facts_sql(rules.STANDARD_QUESTIONS, ANSWER_SOURCE)}))")
ANSWER_ERROR = (
    f"CASE WHEN f_answer IS NULL THEN coalesce({pre_sql('Cannot answer without a completed job analysis (status: ')}, call_error, "
    "CASE WHEN trim(draft) = '' THEN concat('Empty answer (confidence reported as ''', stated, ''') instead of usable content or the NEEDS_USER_INPUT marker.') END) END")
ANSWER_ISSUES = f"list_concat(list_concat({YEARS_ISSUES}, {EMP_ISSUES}), {NUM_ISSUES})"


@query("intake_answers", f"""WITH a AS (SELECT *, {ANSWER_ERROR} AS error, CASE WHEN draft = 'NEEDS_USER_INPUT' THEN []::VARCHAR[] ELSE {ANSWER_ISSUES} END AS i FROM {ANSWER_ROWS})
  SELECT candidate_id, job_id, position, CASE WHEN error IS NOT NULL THEN 'FAILED' ELSE 'COMPLETED' END AS status, error,
    md5(CASE WHEN f_answer IS NOT NULL THEN f_answer WHEN error IS NULL THEN draft END) AS answer,
    CASE WHEN f_answer IS NOT NULL THEN f_confidence WHEN error IS NOT NULL THEN NULL WHEN len(i) > 0 THEN 'LOW' WHEN draft = 'NEEDS_USER_INPUT' THEN draft ELSE stated END AS confidence,
    CASE WHEN f_answer IS NOT NULL THEN f_reason WHEN error IS NULL THEN concat(lang, CASE WHEN len(i) > 0 THEN concat(' [claim validation flagged: ', array_to_string(i, '; '), ']') ELSE '' END) END AS reason
  FROM a""")
def intake_answers(spark, sf):
    people = views.candidates(spark, sf).drop("capabilities", "skills", "name")
    rows = response_rows(spark, sf).drop("total_experience_years", "skills", "name", "candidate_id").withColumn(
        "candidate_id", F.concat(F.lit("C"), "n")).join(people, "candidate_id")
    rows = artifacts.with_questions(rows).selectExpr("*", *[f"{e} AS {n}" for n, e in ANSWERED])
    raw = F.to_json(F.struct(F.col("reply").alias("answer"), F.col("sure").alias("confidence"), F.col("lang").alias("reason")))
    return artifacts.intake_answers(rows.withColumn("raw", raw).drop("reply", "sure")).select(
        "candidate_id", "job_id", "position", "status", "error", F.md5("answer").alias("answer"), "confidence", "reason")


ANSWERS = [
    ("candidate_id", "concat('C', l_orderkey % 2)"), ("job_id", "concat('P', l_orderkey - l_orderkey % 2)"), ("position", "l_linenumber"), ("question", "concat('Q', l_linenumber, '?')"),
    ("cache_key", "concat('key', l_orderkey % 3)"), ("status", "CASE WHEN l_quantity = 1 THEN 'FAILED' ELSE 'COMPLETED' END"),
    ("confidence", "CASE WHEN l_quantity = 2 THEN 'NEEDS_USER_INPUT' ELSE 'HIGH' END"),
]
ANSWERS_SQL = views.ansi_view("lineitem", ANSWERS)


def answers(spark, sf):
    return views.spark_view(spark, sf, "lineitem", ANSWERS)


@query("answers_status", f"SELECT candidate_id, job_id, CASE WHEN bool_and(status = 'COMPLETED') THEN 'COMPLETED' ELSE 'INCOMPLETE' END AS answers_status FROM {ANSWERS_SQL} GROUP BY 1, 2")
def answers_status(spark, sf):
    return artifacts.answers_status(answers(spark, sf))


@query("reusable_answers", f"SELECT candidate_id, job_id, arg_min(cache_key, position) AS cache_key FROM {ANSWERS_SQL} GROUP BY 1, 2 HAVING bool_and(status = 'COMPLETED')")
def reusable_answers(spark, sf):
    return artifacts.reusable_answers(answers(spark, sf))


# --- cache, requests ---------------------------------------------------------------------

STORED = [("candidate_id", "concat('C', o_orderkey % 2)"), ("job_id", "concat('P', o_orderkey - o_orderkey % 2)"), ("cache_key", "concat('key', o_custkey % 3)"), ("status", views.pick(["COMPLETED", "NEEDS_REVIEW", "FAILED"], "o_orderkey % 3"))]


@query("cache_lookup", f"""WITH w AS (SELECT candidate_id, job_id, cache_key FROM {RESPONSES_SQL}), s AS (SELECT DISTINCT candidate_id, job_id, cache_key FROM {views.ansi_view('orders', STORED)} WHERE status IN ('COMPLETED', 'NEEDS_REVIEW'))
  SELECT candidate_id, job_id, s.hit IS NOT NULL AS hit FROM w LEFT JOIN (SELECT *, true AS hit FROM s) s USING (candidate_id, job_id, cache_key)""")
def cache_lookup(spark, sf):
    wanted = response_rows(spark, sf).select("candidate_id", "job_id", "cache_key")
    hits, misses = artifacts.cache_lookup(wanted, views.spark_view(spark, sf, "orders", STORED), artifacts.USABLE)
    return hits.select("candidate_id", "job_id", F.lit(True).alias("hit")).unionByName(
        misses.select("candidate_id", "job_id", F.lit(False).alias("hit")))


@query("cache_key", "SELECT doc_id, sha256(concat_ws('|', doc_id::VARCHAR, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, text, lang, 'fit-analysis/1')) AS key FROM documents")
def cache_key(spark, sf):
    title = F.when(F.col("doc_id") % 3 != 0, F.col("source"))
    return views.table(spark, sf, "documents").select("doc_id", artifacts.cache_key("doc_id", title, "text", "lang").alias("key"))


# Facts of a person of the given tables for every posting's candidate.
PERSON = "p_partkey % 100 + 1"
REQUEST_VIEW = views.ansi_view("part", [*BROWSE, ("person", PERSON)])
JOBS_SQL = (f"(SELECT b.*, id AS job_id, concat('h', cc.c_nationkey) AS hash, sha256(concat_ws('|', b.id, title, description, concat('h', cc.c_nationkey), 'fit-analysis/1')) AS cache_key "
            f"FROM {REQUEST_VIEW} b JOIN customer cc ON cc.c_custkey = b.person WHERE application_decision IN ('AUTO_APPLY', 'REVIEW'))")


def selected_jobs(spark, sf):
    """Actionable postings, each with the facts of one person."""
    people = views.candidates(spark, sf).withColumn("person", F.substring("candidate_id", 2, 20).cast("long")).drop("candidate_id")
    nations = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("person"), F.concat(F.lit("h"), "c_nationkey").alias("profile_hash"))
    jobs = views.spark_view(spark, sf, "part", [*BROWSE, ("person", PERSON)]).withColumnRenamed("id", "job_id")
    return jobs.filter(F.col("application_decision").isin(rules.ACTIONABLE_DECISIONS)).join(people, "person").join(nations, "person")


def _fact_line(label: str, value: str) -> str:
    return f"concat('- {label}: ', coalesce({value}, 'not stated'))"


def _list_text(x: str) -> str:
    return f"array_to_string({x}, ', ')"


CANDIDATE_TEXT = f"""concat_ws(chr(10), 'Verified candidate facts:', {_fact_line('experience in years', o.general('c.total_experience_years'))},
  {_fact_line('target titles', _list_text('c.target_titles'))}, {_fact_line('skills', _list_text('c.skills'))}, '- capabilities (professional = paid work, practical = project or course):',
  array_to_string(list_transform(list_filter(c.capabilities, lambda k: coalesce(k.strength, 'none') <> 'none'),
    lambda k: concat('  - ', k.key, ' (', k.strength, '): ', array_to_string(k.evidence, '; '))), chr(10)),
  {_fact_line('work authorization', 'c.work_authorization')}, {_fact_line('earliest start', 'c.earliest_start_date')})"""
JOB_TEXT = f"""concat_ws(chr(10), 'Posting:', {_fact_line('title', 'j.title')}, {_fact_line('company', 'j.company')}, {_fact_line('location', 'j.location')}, {_fact_line('work mode', 'j.work_mode')},
  {_fact_line('required skills', _list_text('j.required_skills'))}, {_fact_line('preferred skills', _list_text('j.preferred_skills'))},
  {_fact_line('years asked for', f"nullif(concat_ws(' to ', {o.general('j.min_experience_years')}, {o.general('j.max_experience_years')}), '')")}, 'Description:', coalesce(j.description, ''))"""


@query("analysis_requests", f"""SELECT j.candidate_id, j.job_id, 'analysis' AS artifact, 'fit-analysis/1' AS version, cache_key, md5(concat_ws(chr(10) || chr(10), {JOB_TEXT}, {CANDIDATE_TEXT},
    'Compare the posting with the candidate and answer with one JSON object with the fields: {", ".join(rules.ANALYSIS_FIELDS)}.')) AS prompt
  FROM {JOBS_SQL} j JOIN {views.CANDIDATES_SQL} c ON c.candidate_id = concat('C', j.person) WHERE j.ordinal % 3 <> 0""")
def analysis_requests(spark, sf):
    jobs = selected_jobs(spark, sf)
    done = jobs.filter("ordinal % 3 = 0").select("candidate_id", "job_id", artifacts.cache_key(
        "job_id", "title", "description", "profile_hash").alias("cache_key"), F.lit("COMPLETED").alias("status"))
    return artifacts.analysis_requests(jobs, done).select(
        "candidate_id", "job_id", "artifact", "version", "cache_key", F.md5("prompt").alias("prompt"))


def _open_questions() -> list[str]:
    return [q for q in rules.STANDARD_QUESTIONS if _fact_sql(q)[0].startswith("NULL")]


def _request_text(artifact: str, fields: list[str], question: str | None = None) -> str:
    ask = f"concat('Question: ', {question})" if question else "NULL"
    return (f"md5(concat_ws(chr(10) || chr(10), {CANDIDATE_TEXT}, concat('Analysis:', chr(10), json_object('target_role', j.title)), {ask}, "
            f"'Write the {artifact.replace('_', ' ')} from these facts only and answer with one JSON object with the fields: {', '.join(fields)}.')) AS prompt")


@query("pending_requests", f"""WITH jj AS (SELECT *, 'a' || (ordinal % 5) AS key FROM {JOBS_SQL}), c AS (SELECT * FROM {views.CANDIDATES_SQL}), q AS (SELECT unnest([{o.quoted_in(_open_questions())}]) AS question)
  SELECT j.candidate_id, j.job_id, 'resume' AS artifact, NULL AS question, 'resume/1' AS version, {_request_text('resume', rules.RESUME_FIELDS)}
    FROM jj j JOIN c ON c.candidate_id = concat('C', j.person) WHERE ordinal % 4 <> 1 OR ordinal % 8 = 1
  UNION ALL SELECT j.candidate_id, j.job_id, 'cover_letter', NULL, 'cover-letter/1', {_request_text('cover_letter', rules.COVER_LETTER_FIELDS)}
    FROM jj j JOIN c ON c.candidate_id = concat('C', j.person) WHERE ordinal % 4 <> 1 OR ordinal % 8 = 5
  UNION ALL SELECT j.candidate_id, j.job_id, 'answer', question, 'answer/1', {_request_text('answer', ['answer', 'confidence', 'reason'], 'question')}
    FROM jj j JOIN c ON c.candidate_id = concat('C', j.person), q WHERE ordinal % 4 <> 1""")
def pending_requests(spark, sf):
    jobs = selected_jobs(spark, sf).drop("cache_key")
    key = F.concat(F.lit("a"), (F.col("ordinal") % 5).cast("string"))
    analyses = jobs.select("candidate_id", "job_id", key.alias("cache_key"), F.lit("COMPLETED").alias("status"),
                           F.struct(F.col("title").alias("target_role")).alias("analysis"))
    done = jobs.filter("ordinal % 4 = 1").select("candidate_id", "job_id", "ordinal", key.alias("cache_key"), F.lit("COMPLETED").alias("status"))
    resumes, letters = done.filter("ordinal % 8 = 5"), done.filter("ordinal % 8 = 1")
    stored = done.select("candidate_id", "job_id", "cache_key", "status", F.lit(0).alias("position"))
    return artifacts.artifact_requests(jobs, analyses, resumes, letters, stored).select(
        "candidate_id", "job_id", "artifact", "question", "version", F.md5("prompt").alias("prompt"))


_PROFILE_COLUMNS = ", ".join(n for n, _ in views.CANDIDATES if n not in ("candidate_id", "name"))


@query("profile_hash", f"""WITH g AS (SELECT {_PROFILE_COLUMNS}, count(*) AS n FROM {views.CANDIDATES_SQL} GROUP BY {_PROFILE_COLUMNS}) SELECT n, count(*) AS profiles FROM g GROUP BY 1""")
def profile_hash_query(spark, sf):
    rows = views.candidates(spark, sf).drop("candidate_id", "name", "capabilities")
    hashes = rows.select(profile_hash(F.struct(*rows.columns)).alias("h"))
    return hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("profiles"))


@query("build_candidate_context", f"""WITH {o.CF} SELECT candidate_id, blob AS evidence_blob, CASE WHEN cc.c_custkey % 3 = 0 THEN concat('Beta ', cc.c_nationkey, '|', lower(cc.c_mktsegment), ' works')
    ELSE concat(cc.c_mktsegment, ' Works|Beta ', cc.c_nationkey) END AS employers, concat('- Name: ', cc.c_name) AS contact,
  CASE WHEN cc.c_custkey % 4 = 0 THEN '' ELSE concat('- School ', cc.c_nationkey, ', Town') END AS education FROM cf JOIN customer cc ON concat('C', cc.c_custkey) = candidate_id""")
def build_candidate_context(spark, sf):
    rows = candidate_context(views.candidates(spark, sf), views.spark_view(spark, sf, "customer", SPARK_PROFILE))
    return rows.select("candidate_id", "evidence_blob", F.array_join("verified_employers", "|").alias("employers"),
                       F.col("contact_section").alias("contact"), F.col("education_section").alias("education"))


# --- packages -------------------------------------------------------------------------------

RECORD = [
    ("candidate_id", "concat('C', o_orderkey % 2)"), ("job_id", "concat('P', o_orderkey - o_orderkey % 2)"), ("k", "o_orderkey"), ("status", views.pick(["COMPLETED", "COMPLETED", "NEEDS_REVIEW", "FAILED", None], "o_custkey % 5")),
    ("error", "CASE WHEN o_custkey % 5 = 3 THEN 'timeout' END"), ("needed", "o_orderkey % 2 = 0"), ("found", "CASE WHEN o_custkey % 4 = 1 THEN ARR(concat('Issue ', o_orderpriority)) ELSE NONE_LIST END"),
]
RECORD_SQL = views.ansi_view("orders", RECORD)


def packages(spark, sf):
    records = views.spark_view(spark, sf, "orders", RECORD)
    checked = records.withColumn("validation", F.struct(
        F.when(F.size("found") > 0, "NEEDS_REVIEW").otherwise("OK").alias("status"), F.col("found").alias("issues")))
    letters = checked.filter("k % 5 <> 0").withColumn("cover_letter_needed", F.col("needed"))
    jobs = browse_rows(spark, sf).withColumnRenamed("id", "job_id")
    return artifacts.package_rows(
        jobs, records.filter("k % 7 <> 0"), checked.filter("k % 6 <> 0"), letters, answers(spark, sf))


def _status(alias: str) -> str:
    return f"CASE WHEN {alias}.job_id IS NULL THEN 'NOT_PROCESSED' ELSE coalesce({alias}.status, 'FAILED') END"


PACKAGE_SQL = f"""rec AS (SELECT * FROM {RECORD_SQL}),
ans AS (SELECT candidate_id, job_id, list(question ORDER BY position, question) FILTER (WHERE confidence = 'NEEDS_USER_INPUT') AS needs_input,
  list(question ORDER BY position, question) FILTER (WHERE status = 'FAILED') AS failed, bool_and(status = 'COMPLETED') AS done FROM {ANSWERS_SQL} GROUP BY 1, 2),
pk AS (SELECT b.*, {_status('a')} AS a_status, {_status('r')} AS r_status, {_status('l')} AS l_status, a.error AS a_error, r.error AS r_error, l.error AS l_error,
  coalesce(r.found, []) AS r_found, coalesce(l.found, []) AS l_found, coalesce(l.needed, false) AS l_needed, ans.needs_input, ans.failed, coalesce(ans.done, false) AS done
  FROM {BROWSE_SQL} b LEFT JOIN (SELECT * FROM rec WHERE k % 7 <> 0) a ON a.job_id = b.id AND a.candidate_id = b.candidate_id LEFT JOIN (SELECT * FROM rec WHERE k % 6 <> 0) r ON r.job_id = b.id AND r.candidate_id = b.candidate_id
  LEFT JOIN (SELECT * FROM rec WHERE k % 5 <> 0) l ON l.job_id = b.id AND l.candidate_id = b.candidate_id LEFT JOIN ans ON ans.job_id = b.id AND ans.candidate_id = b.candidate_id),
pr AS (SELECT *, {o.known([
    "CASE WHEN coalesce(id, '') = '' OR coalesce(title, '') = '' OR coalesce(company, '') = '' THEN 'The posting lacks an id, a title or a company.' END",
    "CASE WHEN NOT starts_with(coalesce(application_url, ''), 'http') THEN 'The posting has no usable application link.' END",
    f"CASE WHEN coalesce(application_decision, '') NOT IN ('AUTO_APPLY', 'REVIEW') THEN concat('Decision is ', {o.pyquote('application_decision')}, '; only AUTO_APPLY and REVIEW get a package.') END",
    "CASE WHEN a_status <> 'COMPLETED' THEN concat('The analysis is unfinished (', a_status, ').') END",
    f"CASE WHEN r_status <> 'COMPLETED' THEN concat('The resume is unfinished (', r_status, ').') WHEN len(r_found) > 0 THEN concat('The resume makes unverified claims: ', {o.pylist('r_found')}) END",
    f"CASE WHEN l_needed AND l_status <> 'COMPLETED' THEN concat('The cover letter is needed and unfinished (', l_status, ').') WHEN l_needed AND len(l_found) > 0 THEN concat('The cover letter makes unverified claims: ', {o.pylist('l_found')}) END",
    f"CASE WHEN len(needs_input) > 0 THEN concat('Questions only the candidate can answer: ', {o.pylist('needs_input')}) END",
    f"CASE WHEN len(failed) > 0 THEN concat('Questions without a usable answer: ', {o.pylist('failed')}) END"])} AS reasons,
  {o.known([
    "CASE WHEN application_decision = 'REVIEW' THEN decision_reason END",
    f"CASE WHEN r_status = 'NEEDS_REVIEW' THEN concat('Resume needs review: ', CASE WHEN len(r_found) > 0 THEN {o.pylist('r_found')} ELSE coalesce(r_error, 'None') END) END",
    f"CASE WHEN l_status = 'NEEDS_REVIEW' THEN concat('Cover letter needs review: ', CASE WHEN len(l_found) > 0 THEN {o.pylist('l_found')} ELSE coalesce(l_error, 'None') END) END",
    "CASE WHEN a_status = 'NEEDS_REVIEW' THEN concat('Analysis needs review: ', coalesce(a_error, 'None')) END"])} AS review_reasons FROM pk)"""


@query("check_readiness", f"WITH {PACKAGE_SQL} SELECT candidate_id, id AS job_id, CASE WHEN len(reasons) = 0 THEN 'READY' ELSE 'NOT_READY' END AS readiness, array_to_string(reasons, '|') AS reasons FROM pr")
def check_readiness(spark, sf):
    rows = packages(spark, sf).withColumn("r", artifacts.check_readiness())
    return rows.select("candidate_id", "job_id", F.when(F.size("r") == 0, "READY").otherwise("NOT_READY").alias("readiness"), F.array_join("r", "|").alias("reasons"))


@query("assemble_package", f"""WITH {PACKAGE_SQL} SELECT candidate_id, id AS job_id, company, title, application_decision AS decision, score AS decision_score, a_status AS analysis_status, r_status AS resume_status,
  l_status AS cover_letter_status, CASE WHEN done THEN 'COMPLETED' ELSE 'INCOMPLETE' END AS answers_status, len(review_reasons) > 0 AS requires_human_review,
  array_to_string(review_reasons, '|') AS review_reasons, len(reasons) = 0 AS ready_for_browser_automation FROM pr""")
def assemble_package(spark, sf):
    rows = artifacts.assemble_package(packages(spark, sf))
    return rows.drop("readiness", "readiness_reasons").withColumn("review_reasons", F.array_join("review_reasons", "|"))


@query("artifact_status", f"WITH {PACKAGE_SQL} SELECT a_status, r_status, l_status, count(*) AS n FROM pk GROUP BY 1, 2, 3")
def artifact_status(spark, sf):
    return packages(spark, sf).groupBy(
        F.col("analysis_status").alias("a_status"), F.col("resume_status").alias("r_status"), F.col("letter_status").alias("l_status")).agg(
        F.count(F.lit(1)).alias("n"))


def _respond(requests):
    """A generator that answers every request with a well-formed text; every seventh call of a letter times out."""
    lists = {f: "array(job_id)" for f in rules.ANALYSIS_FIELDS}
    values = lists | {f: "job_id" for f in ("target_role", "company", "core_mission", "application_strategy")} | {"confidence": "0.5D"}
    analysis = "to_json(named_struct(" + ", ".join(f"'{f}', {values[f]}" for f in rules.ANALYSIS_FIELDS) + "))"
    resume = ("to_json(named_struct('summary', 'Careful worker', 'highlighted_experience', array(), 'highlighted_projects', array(), "
              "'skills_to_feature', array('SQL'), 'keywords_used', array()))")
    letter = "to_json(named_struct('cover_letter_needed', true, 'reason', 'asked for', 'body', 'Dear team'))"
    number = "CAST(substring(job_id, 2, 20) AS BIGINT)"
    return requests.withColumns({
        "call_error": F.expr(f"CASE WHEN artifact = 'cover_letter' AND {number} % 7 = 0 THEN 'timeout' END"),
        "raw": F.expr(f"CASE artifact WHEN 'analysis' THEN {analysis} WHEN 'resume' THEN {resume} WHEN 'cover_letter' THEN {letter} "
                      "ELSE to_json(named_struct('answer', 'Gladly', 'confidence', 'HIGH', 'reason', question)) END")})


def _no_records(spark) -> artifact_run.Artifacts:
    key = "candidate_id string, job_id string, cache_key string, status string, error string, generated_at timestamp"
    checked = f"{key}, validation struct<status:string,issues:array<string>>"
    frame = lambda schema: spark.createDataFrame([], schema)
    return artifact_run.Artifacts(
        frame(f"{key}, analysis struct<{', '.join(f.simpleString() for f in schemas.ANALYSIS.fields)}>"), frame(checked),
        frame(f"{checked}, cover_letter_needed boolean"), frame(f"{key}, position int, question string, answer string, confidence string, reason string"))


def _artifact_run(spark, sf, stored=None, day: int = 1):
    """The postings of two candidates of the given tables through the whole pipeline."""
    postings = browse_rows(spark, sf).withColumn("candidate_id", F.when(F.col("candidate_id") == "C0", "C2").otherwise("C1"))
    owners = views.candidates(spark, sf).join(postings.select("candidate_id").distinct(), "candidate_id", "left_semi")
    people = candidate_context(owners, views.spark_view(spark, sf, "customer", SPARK_PROFILE))
    stored = stored or _no_records(spark)
    return artifact_run.run_artifacts(postings, people, stored, _respond, F.lit(f"2026-02-{day:02} 08:00:00").cast("timestamp"))


RUN_JOBS = f"(SELECT *, CASE WHEN candidate_id = 'C0' THEN 'C2' ELSE 'C1' END AS owner, CAST(substr(id, 2) AS BIGINT) % 7 = 0 AS lost FROM {BROWSE_SQL} WHERE application_decision IN ('AUTO_APPLY', 'REVIEW'))"


@query("artifact_requests_of_a_run", f"""WITH j AS (SELECT owner AS candidate_id, id AS job_id FROM {RUN_JOBS}), q AS (SELECT unnest([{o.quoted_in(_open_questions())}]) AS question)
  SELECT candidate_id, job_id, 'analysis' AS artifact, NULL AS question FROM j UNION ALL SELECT candidate_id, job_id, unnest(['resume', 'cover_letter']), NULL FROM j
  UNION ALL SELECT candidate_id, job_id, 'answer', question FROM j, q""")
def artifact_requests_of_a_run(spark, sf):
    return _artifact_run(spark, sf).requests.select("candidate_id", "job_id", "artifact", "question")


@query("artifact_run", f"""SELECT owner AS candidate_id, id AS job_id, application_decision AS decision, score AS decision_score, 'COMPLETED' AS analysis_status, 'COMPLETED' AS resume_status,
  CASE WHEN lost THEN 'FAILED' ELSE 'COMPLETED' END AS cover_letter_status, 'COMPLETED' AS answers_status, false AS ready_for_browser_automation,
  application_decision = 'REVIEW' AS requires_human_review, TIMESTAMP '2026-02-01 08:00:00' AS generated_at FROM {RUN_JOBS}""")
def artifact_run_packages(spark, sf):
    """Packages of a whole pass; nobody has a stated notice period, so none is ready."""
    return _artifact_run(spark, sf).packages.select(
        "candidate_id", "job_id", "decision", "decision_score", "analysis_status", "resume_status", "cover_letter_status", "answers_status",
        "ready_for_browser_automation", "requires_human_review", "generated_at")


@query("artifact_rerun", f"""SELECT owner AS candidate_id, id AS job_id, 'cover_letter' AS artifact FROM {RUN_JOBS} WHERE lost""")
def artifact_rerun(spark, sf):
    """A second pass asks only for the letters that failed in the first."""
    stored = _no_records(spark)
    again = _artifact_run(spark, sf, artifact_run.stored_after(stored, _artifact_run(spark, sf)), 2)
    return again.requests.select("candidate_id", "job_id", "artifact")


@query("write_artifacts", f"""SELECT candidate_id, job_id, cache_key, status, TIMESTAMP '2026-02-02 00:00:00' AS written_at FROM {views.ansi_view('orders', STORED)} WHERE status <> 'FAILED'""")
def write_artifacts(spark, sf):
    """Records appended twice and the newest of each read back; rows without a status are not written."""
    base = scratch_folder(spark, "artifacts")
    rows = views.spark_view(spark, sf, "orders", STORED).withColumn("status", F.when(F.col("status") != "FAILED", F.col("status")))
    for day in (1, 2):
        sinks.write_artifacts(rows, base, F.lit(f"2026-02-{day:02} 00:00:00").cast("timestamp"))
    return latest_artifacts(spark.read.parquet(base), ["candidate_id", "job_id"]).select(
        "candidate_id", "job_id", "cache_key", "status", "written_at")


@query("read_artifacts", "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def read_artifacts(spark, sf):
    rows = views.table(spark, sf, "events").select("user_id", "event_type", "value", "event_id")
    return latest_artifacts(rows, ["user_id", "event_type"], "event_id")


@query("auto_apply_preconditions", f"""WITH a AS (SELECT concat('C', o_orderkey % 2) AS candidate_id, concat('P', o_orderkey * 5) AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN concat('https://Jobs.Example.com/job/', o_custkey % 100, '?ref=', o_orderkey % 50) ELSE 'x' END AS url FROM orders),
  j AS (SELECT *, coalesce(application_url, '') AS u, length(description) > 50 AS long_text FROM {BROWSE_SQL}),
  c AS (SELECT *, (candidate_id, id) IN (SELECT (candidate_id, job_id) FROM a) OR (candidate_id, u) IN (SELECT (candidate_id, url) FROM a) AS applied, starts_with(u, 'http') AS good_url, u <> '' AND long_text AS real, coalesce(application_decision, 'None') AS d FROM j)
  SELECT candidate_id, id, NOT applied AS not_already_applied, good_url AS valid_url, real AS appears_legitimate, NOT applied AND good_url AND real AND d = 'AUTO_APPLY' AS eligible,
    array_to_string({o.known([
        "CASE WHEN applied THEN 'An application for this job exists' END",
        "CASE WHEN NOT good_url THEN 'application_url is missing or not a valid http(s) URL' END",
        "CASE WHEN NOT real THEN 'Listing has no application URL or an unusually thin description' END",
        "CASE WHEN d <> 'AUTO_APPLY' THEN concat('Scoring decision is ', d, ', not AUTO_APPLY') END"])}, '|') AS reasons FROM c""")
def auto_apply_preconditions(spark, sf):
    applications = views.table(spark, sf, "orders").selectExpr(
        "concat('C', o_orderkey % 2) AS candidate_id", "concat('P', o_orderkey * 5) AS job_id",
        "CASE WHEN o_orderkey % 2 = 0 THEN concat('https://Jobs.Example.com/job/', o_custkey % 100, '?ref=', o_orderkey % 50) ELSE 'x' END AS application_url")
    return scoring.auto_apply_preconditions(browse_rows(spark, sf), applications).select(
        "candidate_id", "id", "not_already_applied", "valid_url", "appears_legitimate", "eligible", F.array_join("reasons", "|").alias("reasons"))


# --- notes and reviews ----------------------------------------------------------------------

def _section_sql(title: str, items: str) -> str:
    body = f"CASE WHEN len({items}) = 0 THEN '- (none)' ELSE array_to_string(list_transform({items}, lambda i: concat('- ', i)), chr(10)) END"
    return f"concat(chr(10), chr(10), '## {title}', chr(10), {body})"


NOTE_SQL = f"""concat('# ', title, ' — ', company, chr(10), chr(10), '- Match: ', score, '/100', chr(10), '- Role family: ', role_family, '   Career level: ', career_level, chr(10),
  '- Decision: ', application_decision, ' -- ', decision_reason, chr(10), '- Location: ', coalesce(location, 'None'), ' (', coalesce(nullif(work_mode, ''), 'work mode not specified'), ')', chr(10),
  '- Experience required: ', CASE WHEN min_experience_years IS NULL THEN 'not specified' WHEN max_experience_years IS NULL THEN concat({o.dbl_text('min_experience_years')}, '+ years')
    ELSE concat({o.dbl_text('min_experience_years')}, '-', {o.dbl_text('max_experience_years')}, ' years') END, ' (gap: ', {o.general('gap')}, ' years)', chr(10),
  '- Source: ', source, chr(10), '- Discovered: ', date_discovered, chr(10), '- Apply: ', coalesce(application_url, 'None'), chr(10), chr(10), '## Score breakdown',
  {', '.join(f"chr(10), '- {p}: ', {p}" for p in rules.WEIGHTS)}, {_section_sql('Relevant evidence', 'relevant')}, {_section_sql('Transferable evidence', 'transferable')},
  {_section_sql('Missing requirements', 'missing')}, {_section_sql('Experience gaps', 'exp_gaps')}, {_section_sql('Risks', 'risk_list')},
  chr(10), chr(10), '## Description', chr(10), description)"""


@query("shortlist_note", f"WITH {o.MATCHES} SELECT candidate_id, job_id AS id, {NOTE_SQL} AS note FROM x7 WHERE application_decision <> 'SKIP'")
def shortlist_note_query(spark, sf):
    rows = scoring.shortlisted(scoring.annotate_match(views.owned_postings(spark, sf), views.candidates(spark, sf)))
    return rows.select("candidate_id", "id", shortlist_note().alias("note"))


ACTIONS = [
    ("candidate_id", "concat('C', user_id % 2)"), ("job_id", "concat('J', user_id - user_id % 2)"), ("seq", "event_id"), ("action", views.pick(["approve", "save", "reject", "save", "needs_changes", "submit"], "event_id % 6")),
    *[(q, f"CASE WHEN event_id % {i + 7} = 0 THEN CAST((event_id + {i}) % 5 + 1 AS INT) WHEN event_id % 97 = {i} THEN 9 END") for i, q in enumerate(rules.QUALITY_FIELDS)],
    ("issues", "CASE WHEN event_id % 13 = 0 THEN ARR(event_type) END"), ("needs_regeneration", "CASE WHEN event_id % 4 = 0 THEN event_id % 8 = 0 END"),
    ("review_notes", "CASE WHEN event_id % 9 = 0 THEN concat('note ', event_id) END"), ("acted_at", "ts"),
]
VALID_ACTION = "action <> 'submit' AND " + " AND ".join(f"coalesce({q}, 1) BETWEEN 1 AND 5" for q in rules.QUALITY_FIELDS)


def _last(expression: str) -> str:
    return f"arg_max({expression}, seq) FILTER (WHERE {expression} IS NOT NULL)"


@query("review_fold", f"""SELECT candidate_id, job_id, coalesce({_last("CASE action WHEN 'approve' THEN 'APPROVED' WHEN 'reject' THEN 'REJECTED' WHEN 'needs_changes' THEN 'NEEDS_CHANGES' END")}, 'PENDING') AS review_status,
  {', '.join(f'{_last(q)} AS {q}' for q in rules.QUALITY_FIELDS)}, array_to_string(coalesce({_last('issues')}, []), '|') AS issues, coalesce({_last('needs_regeneration')}, false) AS needs_regeneration,
  coalesce({_last('review_notes')}, '') AS review_notes, max(seq) AS last_seq FROM {views.ansi_view('events', ACTIONS)} WHERE {VALID_ACTION} GROUP BY 1, 2""")
def review_fold(spark, sf):
    actions = views.spark_view(spark, sf, "events", ACTIONS)
    folded = reviews.review_fold(actions.withColumn("acted_at", F.col("seq")))
    return folded.withColumnRenamed("reviewed_at", "last_seq").withColumn("issues", F.array_join("issues", "|"))


RECORDS = [
    ("n", "event_id"), ("job_id", "CASE WHEN event_id % 5 <> 0 THEN concat('J', user_id) ELSE '' END"),
    ("review_status", views.pick(["PENDING", "APPROVED", "done", None, "REJECTED"], "user_id % 5")),
    *[(q, f"CASE WHEN event_id % {i + 3} = 0 THEN CAST(event_id % 8 AS INT) END") for i, q in enumerate(rules.QUALITY_FIELDS)],
]
_STATUSES = "[''APPROVED'', ''NEEDS_CHANGES'', ''PENDING'', ''REJECTED'']"
ERRORS_SQL = o.known([
    "CASE WHEN job_id = '' THEN 'job_id is required' END",
    f"CASE WHEN coalesce(review_status, '') NOT IN ('PENDING', 'APPROVED', 'NEEDS_CHANGES', 'REJECTED') THEN concat('review_status must be one of {_STATUSES}, got ', {o.pyquote('review_status')}) END",
    *[f"CASE WHEN {q} NOT BETWEEN 1 AND 5 THEN concat('{q} must be null or one of [1, 2, 3, 4, 5] (1=unacceptable..5=excellent), got ', {q}) END" for q in rules.QUALITY_FIELDS]])


@query("validate_review", f"SELECT n, array_to_string({ERRORS_SQL}, '|') AS errors FROM {views.ansi_view('events', RECORDS)}")
def validate_review(spark, sf):
    return views.spark_view(spark, sf, "events", RECORDS).select("n", F.array_join(reviews.validate_review(), "|").alias("errors"))


@query("write_reviews_split", f"SELECT len({ERRORS_SQL}) = 0 AS valid, count(*) AS n FROM {views.ansi_view('events', RECORDS)} GROUP BY 1")
def write_reviews_split(spark, sf):
    valid, invalid = reviews.split_valid(views.spark_view(spark, sf, "events", RECORDS), reviews.validate_review())
    flagged = valid.select(F.lit(True).alias("valid")).unionByName(invalid.select(F.lit(False).alias("valid")))
    return flagged.groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


@query("already_applied", f"""WITH a AS (SELECT concat('C', o_orderkey % 2) AS candidate_id, concat('P', o_orderkey * 5) AS job_id, concat('https://Jobs.Example.com/job/', o_custkey % 100, '?ref=', o_orderkey % 50) AS url FROM orders)
  SELECT candidate_id, id, (candidate_id, id) IN (SELECT (candidate_id, job_id) FROM a) OR (candidate_id, coalesce(application_url, '')) IN (SELECT (candidate_id, url) FROM a) AS applied FROM {BROWSE_SQL}""")
def already_applied(spark, sf):
    applications = views.table(spark, sf, "orders").selectExpr(
        "concat('C', o_orderkey % 2) AS candidate_id", "concat('P', o_orderkey * 5) AS job_id", "concat('https://Jobs.Example.com/job/', o_custkey % 100, '?ref=', o_orderkey % 50) AS application_url")
    return scoring.auto_apply_preconditions(browse_rows(spark, sf), applications).select(
        "candidate_id", "id", (~F.col("not_already_applied")).alias("applied"))


@query("read_candidates", f"""WITH {o.CF} SELECT candidate_id, name, total_experience_years, array_to_string(target_titles, '|') AS titles,
  array_to_string(list_transform(capabilities, lambda c: concat(c.key, '=', coalesce(c.strength, '?'), ':', array_to_string(c.evidence, ','))), '|') AS capabilities FROM cf""")
def read_candidates(spark, sf):
    """Candidates written as JSON objects with a capability map and read back."""
    rows = views.candidates(spark, sf)
    as_map = F.map_from_entries(F.transform("capabilities", lambda c: F.struct(
        c["key"].alias("key"), F.struct(c["strength"].alias("strength"), c["evidence"].alias("evidence")).alias("value"))))
    objects = rows.withColumn("capabilities", as_map).select(F.to_json(F.struct("*")).alias("value"))
    shown = F.transform("capabilities", lambda c: F.concat(
        c["key"], F.lit("="), F.coalesce(c["strength"], F.lit("?")), F.lit(":"), F.array_join(c["evidence"], ",")))
    return parse_candidates(objects).select(
        "candidate_id", "name", "total_experience_years", F.array_join("target_titles", "|").alias("titles"),
        F.array_join(shown, "|").alias("capabilities"))
