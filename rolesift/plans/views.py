"""Postings, candidates and texts derived from the given tables.

The given tables hold no job postings, so the queries read them through these
views. A view is a list of SQL expressions that Spark and any ANSI database
evaluate alike; it covers every row of its table and grows with it. The few
spellings that differ (array, struct and JSON constructors) are written as
upper-case words and replaced per engine.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from rolesift.session import stored

SPARK_WORDS = {
    "ARR": "array", "NONE_LIST": "CAST(array() AS ARRAY<STRING>)", "TEXT": "STRING",
    "JSON_TEXT": "to_json",
}
ANSI_WORDS = {
    "ARR": "list_value", "NONE_LIST": "CAST([] AS VARCHAR[])", "TEXT": "VARCHAR",
    "JSON_TEXT": "to_json",
}


def _words(text: str, words: dict[str, str]) -> str:
    return re.sub(r"\b(" + "|".join(words) + r")\b", lambda m: words[m.group(1)], text)


def literal(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def pick(values: Iterable[str | None], index: str) -> str:
    """CASE over a small number; every row of the table gets a value."""
    cases = " ".join(f"WHEN {i} THEN {literal(v)}" for i, v in enumerate(values))
    return f"CASE {index} {cases} END"


def struct_list(entries: list[dict[str, str]], engine: str) -> str:
    """A list of structs in the spelling of the engine."""
    if engine == "spark":
        structs = ["named_struct(" + ", ".join(f"'{k}', {v}" for k, v in e.items()) + ")" for e in entries]
        return "array(" + ", ".join(structs) + ")"
    structs = ["{" + ", ".join(f"'{k}': {v}" for k, v in e.items()) + "}" for e in entries]
    return "[" + ", ".join(structs) + "]"


TITLES = [
    "Associate Product Manager", "Senior Product Manager", "Business Analyst", "Product Counsel",
    "Program Coordinator", "Software Engineer", "Sales Manager", "Product Analyst Intern",
    "Manager - Accounts", "Junior Business Systems Analyst", "Marketing Associate",
    "HR Business Partner", "Product Owner", "Operations Specialist", "Head of Analytics",
    "Technical Program Manager",
]
LOCATIONS = ["Pune", "Remote", "Berlin, Germany", "", None, "Bangalore, Karnataka", "Hybrid - Mumbai"]
SKILLS = [
    "Stakeholder management", "Requirements gathering and documentation", "Python programming",
    "Agile delivery with scrum",
]
DATE = "DATE'2026-01-01'"

POSTINGS = [
    ("ordinal", "p_partkey"),
    ("id", "concat('P', p_partkey)"),
    ("company", "p_brand"),
    ("title", pick(TITLES, "p_partkey % 16")),
    ("location", pick(LOCATIONS, "p_size % 7")),
    ("work_mode", pick([None, "remote", "Hybrid ", "onsite", ""], "p_partkey % 5")),
    ("industry", pick([None, "Fintech", "Gambling", "Retail", ""], "p_size % 5")),
    ("company_size", pick([None, "Startup", "enterprise"], "p_partkey % 3")),
    ("salary_min", "CASE WHEN p_partkey % 7 = 2 THEN 350000.0E0 END"),
    ("salary_max", "CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice * 400 END"),
    ("salary_currency", "CASE WHEN p_partkey % 3 <> 0 THEN 'USD' END"),
    ("min_experience_years", "CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size % 9 AS DOUBLE) / 2 END"),
    ("max_experience_years", "CASE WHEN p_size % 4 = 0 THEN CAST(p_size % 9 AS DOUBLE) / 2 + 1.5E0 END"),
    ("required_skills", "CASE WHEN p_partkey % 6 = 0 THEN NONE_LIST ELSE ARR("
     f"concat('Experience with ', p_name), 'SQL', {pick(SKILLS, 'p_partkey % 4')}, lower(p_type)) END"),
    ("preferred_skills", "CASE WHEN p_partkey % 4 = 1 THEN NONE_LIST ELSE ARR("
     f"{pick(['Excel reporting', 'Tableau dashboards', 'Roadmap planning'], 'p_size % 3')}) END"),
    ("description", "CASE WHEN p_partkey % 13 = 0 THEN 'Short text' ELSE concat('We build ', p_name, ' for ', "
     f"p_brand, '. ', {pick(['Our sales group grows.', 'You write reports for many clients.', 'The staff is friendly.'], 'p_size % 3')}"
     ", ' Apply when this sounds like you.') END"),
    ("application_url", "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE concat('https://Jobs.Example.com/job/', "
     "p_partkey % 300, '?ref=', p_size) END"),
    ("source", f"concat({pick(['lever', 'greenhouse', 'ashby'], 'p_partkey % 3')}, ':board', p_size % 3)"),
    ("source_job_id", "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE concat('J', p_partkey % 400) END"),
    ("date_discovered", f"{DATE} + CAST(p_partkey % 60 AS INT)"),
    ("discovered_at", f"{DATE} + CAST(p_partkey % 60 AS INT)"),
    ("first_seen_at", f"CASE WHEN p_size % 4 <> 1 THEN {DATE} + CAST(p_partkey % 60 AS INT) END"),
    ("last_seen_at", f"CASE WHEN p_size % 6 <> 1 THEN {DATE} + CAST(p_partkey % 60 + p_size % 5 AS INT) END"),
]

STRENGTHS = ["professional", "practical", "none", None]
CAPABILITIES = [
    "product_management", "analytics", "stakeholder_communication", "requirements_gathering", "documentation",
    "business_analysis", "project_management", "agile_scrum", "software_development", "client_facing",
]


def capabilities(engine: str) -> str:
    entries = [
        {
            "key": literal(key),
            "strength": pick(STRENGTHS, f"(c_custkey + {3 * i}) % 4" if i % 2 else f"(c_custkey + c_nationkey + {i}) % 4"),
            "evidence": f"ARR({literal('Did ' + key.replace('_', ' ') + ' for ')} || c_mktsegment, 'More proof')"
            if i % 3 else f"CASE WHEN c_custkey % 5 = 0 THEN NONE_LIST ELSE ARR({literal('Led ' + key.replace('_', ' '))}) END",
        }
        for i, key in enumerate(CAPABILITIES)
    ]
    return struct_list(entries, engine)


TARGET_TITLES = [
    "ARR('Product Manager', 'Associate Product Manager')", "ARR('Business Analyst')",
    "ARR('Project Manager', 'Program Manager')", "ARR('Software Engineer')",
]
SECONDARY_TITLES = ["ARR('Product Analyst')", "NONE_LIST", "ARR('Project Coordinator', 'Operations Specialist')"]


def _pick_list(lists: list[str], index: str) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(lists)) + " END"


CANDIDATES = [
    ("candidate_id", "concat('C', c_custkey)"),
    ("name", "c_name"),
    ("total_experience_years", "CASE WHEN c_custkey % 10 <> 9 THEN CAST(c_custkey % 9 AS DOUBLE) / 2 END"),
    ("target_titles", _pick_list(TARGET_TITLES, "c_custkey % 4")),
    ("secondary_titles", _pick_list(SECONDARY_TITLES, "c_custkey % 3")),
    ("skills", f"ARR('SQL', lower(c_mktsegment), {pick(['Excel reports', 'Tableau', 'Scrum delivery'], 'c_custkey % 3')})"),
    ("preferred_industries", "CASE WHEN c_custkey % 3 = 0 THEN NONE_LIST ELSE ARR('fintech', 'Health') END"),
    ("avoid_industries", "CASE WHEN c_custkey % 5 = 0 THEN ARR('gambling') ELSE NONE_LIST END"),
    ("preferred_locations", "CASE WHEN c_nationkey % 6 = 0 THEN NONE_LIST ELSE ARR("
     f"{pick(['Pune', 'Berlin', 'Mumbai', 'Bangalore'], 'c_nationkey % 4')}, 'Delhi') END"),
    ("preferred_work_modes", "CASE WHEN c_custkey % 4 = 0 THEN NONE_LIST ELSE ARR('Remote', 'hybrid') END"),
    ("preferred_company_sizes", "CASE WHEN c_custkey % 2 = 0 THEN NONE_LIST ELSE ARR('startup') END"),
    ("min_acceptable_salary_inr_per_year", "CASE WHEN c_custkey % 8 <> 7 THEN 300000.0E0 + c_nationkey * 10000 END"),
    ("target_salary_min_inr_per_year",
     "CASE WHEN c_custkey % 6 <> 5 THEN 300000.0E0 + c_nationkey * 10000 + (c_custkey % 5) * 50000 END"),
    ("target_salary_max_inr_per_year", "CASE WHEN c_custkey % 2 = 0 THEN 900000.0E0 END"),
    ("work_authorization", "CASE WHEN c_nationkey % 3 <> 0 THEN concat('Citizen of nation ', c_nationkey) END"),
    ("earliest_start_date", "CASE WHEN c_custkey % 4 <> 1 THEN 'Immediately' END"),
]

# A text as a generator could have written it: a whole document or a whole turn
# of a conversation with claims, links and slips of the pen around it.
CLAIMS = [
    " I have 7 years of professional experience at Acme Corp and cut costs by 45%.",
    " I only have 1.5 years experience; that is below the bar, fewer years than asked.",
    " Worked for Orwell Data LLP, see https://x.example.com/a,b:c or mail me@example.org now.",
    " Used e.g.Tableau and Excel.Then wrote reports,charts for  3 teams in 2024.",
    " A stretch role that does not meet the required 12+ years; I lack the necessary experience.",
    " Ready at Google.",
]
DRAFTS = [
    ("text_id", "doc_id"),
    ("draft", f"concat(text, {pick(CLAIMS, 'doc_id % 6')})"),
    ("years", "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(doc_id % 5 AS DOUBLE) / 2 END"),
    ("company", pick(["Acme Corp", "Gamma", None], "doc_id % 3")),
    ("employers", "CASE WHEN doc_id % 4 = 0 THEN NONE_LIST ELSE ARR('Orwell Data', 'Beta') END"),
    ("blob", "concat(lower(source), ' 45 3 2024 reports')"),
]
TURNS = [
    ("conv_id", "conv_id"), ("turn", "turn"),
    ("draft", f"concat(text, {pick(CLAIMS, '(conv_id + turn) % 6')})"),
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Short rows with much work for each: a file of few row groups would leave that work to as many tasks, and so would
# tasks cut by the bytes of these rows. They are dealt over a number of tasks that follows from the cluster.
DEALT = {"customer", "part"}
TASKS_PER_CORE = 2


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism)


def spark_view(spark: SparkSession, sf: str, name: str, columns: list[tuple[str, str]]) -> DataFrame:
    exprs = [f"{_words(e, SPARK_WORDS)} AS `{n}`" for n, e in columns]
    rows = table(spark, sf, name)
    return (dealt(rows) if name in DEALT else rows).selectExpr(*exprs)


def ansi_view(table: str, columns: list[tuple[str, str]]) -> str:
    listed = ", ".join(f'{_words(e, ANSI_WORDS)} AS "{n}"' for n, e in columns)
    return f"(SELECT {listed} FROM {table})"


def postings(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "part", POSTINGS)


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "customer", [*CANDIDATES, ("capabilities", capabilities("spark"))])


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """What each customer ordered: the postings to score for each candidate."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey")
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .select("l_partkey", "o_custkey").distinct()
        .selectExpr("concat('P', l_partkey) AS job_id", "concat('C', o_custkey) AS candidate_id")
    )


def owned_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair's posting with its ``candidate_id``. The pairs are written: who reads these rows twice makes them once."""
    owners = stored(pairs(spark, sf), "pairs").withColumnRenamed("job_id", "id")
    return postings(spark, sf).join(owners, "id")


POSTINGS_SQL = ansi_view("part", POSTINGS)
CANDIDATES_SQL = ansi_view("customer", [*CANDIDATES, ("capabilities", capabilities("ansi"))])
PAIRS_SQL = (
    "(SELECT DISTINCT concat('P', l_partkey) AS job_id, concat('C', o_custkey) AS candidate_id "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
)
DRAFTS_SQL = ansi_view("documents", DRAFTS)
TURNS_SQL = ansi_view("conversations", TURNS)
