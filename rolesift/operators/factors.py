"""Scoring by factors: every rule at the grain of the values it reads.

A pair row holds facts of its own (years, salaries, family, level) and ids of
values that many pairs share: the title, the setting and the skill lists of the
posting, the wishes, tastes, proofs and capabilities of the candidate. A rule
that looks into lists or texts runs once per pair of *values* that meet, in a
factor table, and pair rows look the outcome up by the two ids. No list, map or
text of either side travels with the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift import rules
from rolesift.functions import fit
from rolesift.functions.roles import title_family
from rolesift.functions.text import normalize, or_no_items, title_tokens
from rolesift.operators.candidates import candidate_features, evidence_blob
from rolesift.operators.joins import BROADCAST_ROWS, look_up, parted_join, salted_join, tasks_for
from rolesift.operators.pair_rules import posting_features, setting_points, setting_status
from rolesift.session import stored

FAMILIES = sorted({family for family, _ in rules.FAMILY_PHRASES} | set(rules.FAMILY_NEEDS) | {"UNKNOWN"})
# Raw columns behind every id of a posting and of a candidate.
POSTING_IDS = {
    "title_id": ["title"],
    "setting_id": ["location", "work_mode", "industry", "company_size"],
    "skills_id": ["required_skills", "preferred_skills"],
}
PERSON_IDS = {
    "wish_id": ["target_titles", "secondary_titles"],
    "taste_id": ["preferred_work_modes", "preferred_locations", "preferred_industries", "avoid_industries",
                 "preferred_company_sizes"],
    "power_id": ["capabilities"],
}
PERSON_FACTS = ["years", "salary_floor", "salary_target"]
# Pairs that may share one key of a factor table in a plain join; beyond, every key is dealt over several tasks.
HOT_PAIRS = 5_000_000


def value_id(*columns: Column | str) -> Column:
    """16 bytes that stand for the values of ``columns``."""
    return F.unhex(F.md5(F.to_json(F.struct(*columns))))


def with_ids(rows: DataFrame, ids: dict[str, list[str]]) -> DataFrame:
    return rows.withColumns({name: value_id(*columns) for name, columns in ids.items()})


def people(candidates: DataFrame) -> DataFrame:
    """Candidates with the ids of their values; ``proof_id`` stands for the evidence text."""
    return with_ids(candidates, PERSON_IDS).withColumn(
        "proof_id", F.unhex(F.md5(evidence_blob("skills", "capabilities"))))


def person_keys(persons: DataFrame) -> DataFrame:
    """What a pair row takes from a candidate."""
    return candidate_features(persons, "candidate_id", *PERSON_IDS, "proof_id", names=tuple(PERSON_FACTS))


def posting_keys(postings: DataFrame, *carried: str) -> DataFrame:
    """What a pair row takes from a posting."""
    return posting_features(with_ids(postings, POSTING_IDS), *carried, *POSTING_IDS).select(
        *carried, "job_id", "role_family", "career_level", "legitimate", "min_experience_years",
        "max_experience_years", "salary_min", "salary_max", *POSTING_IDS)


def posting_values(postings: DataFrame, name: str) -> DataFrame:
    """The distinct values behind one id of the postings."""
    return with_ids(postings.select(*POSTING_IDS[name]).distinct(), {name: POSTING_IDS[name]})


def person_values(persons: DataFrame, name: str, *features: str) -> DataFrame:
    """Features of the distinct values behind one id of the candidates."""
    return candidate_features(persons.dropDuplicates([name]), name, names=features)


def meetings(keyed: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The pairs of values that meet in ``keyed`` with the columns of both and the number of pairs, ``n``."""
    on = [left.columns[0], right.columns[0]]
    met = keyed.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    return met.join(left, on[0]).join(right, on[1])


def is_small(table: DataFrame) -> bool:
    """Whether a factor table may be sent to all executors."""
    return "n" not in table.columns or table.count() <= BROADCAST_ROWS


def with_factor(rows: DataFrame, table: DataFrame, on: list[str], small: bool, tasks: int | None = None) -> DataFrame:
    """``rows`` with the columns of a written factor table, looked up by its two ids.

    A table of bounded size is sent to all executors. A larger one is joined by
    its ids, and dealt over several tasks per key where one key has very many
    pairs; ``tasks`` is the number of tasks that very many rows ask for.
    """
    narrow, salt = table.drop("n"), F.struct("job_id", "candidate_id")
    if small:
        return look_up(rows, narrow, on, salt, "left")
    if tasks is not None:
        return parted_join(rows, narrow, on, salt, "left", table.select(*on, "n"), tasks)
    if table.agg(F.max("n")).first()[0] <= HOT_PAIRS:
        return rows.join(narrow, on, "left")
    return salted_join(rows, narrow, on, salt, "left")


def family_factor(persons: DataFrame) -> DataFrame:
    """Every family beside every set of wishes."""
    result = fit.role_family_score("role_family", "target_families")
    return (
        person_values(persons, "wish_id", "target_families")
        .withColumn("role_family", F.explode(F.array(*map(F.lit, FAMILIES)))).withColumn("r", result)
        .select("role_family", "wish_id", "r.is_mismatch", F.col("r.status").alias("family_status"),
                F.col("r.score").alias("role_family_score")))


def capability_factor(persons: DataFrame) -> DataFrame:
    """Points and proofs per family and list of capabilities."""
    power = person_values(persons, "power_id", "capability_points", "capability_facts")
    return power.select(
        "power_id", "capability_points", F.explode("capability_facts").alias("role_family", "capability")).select(
        "role_family", "power_id", "capability",
        F.try_element_at("capability_points", F.col("role_family")).alias("capability_raw"))


def title_factor(keyed: DataFrame, postings: DataFrame, persons: DataFrame) -> DataFrame:
    titles = posting_values(postings, "title_id").select(
        "title_id", "title", normalize("title").alias("title_key"), title_family("title").alias("title_family"),
        title_tokens("title").alias("title_words"))
    wishes = person_values(
        persons, "wish_id", "target_titles", "secondary_titles", "target_families", "known_words")
    return meetings(keyed, titles, wishes).select(
        "title_id", "wish_id", "n", fit.title_alignment(
            "title", "title_key", "title_family", "title_words", "target_titles", "secondary_titles",
            "target_families", "known_words")["score"].alias("title_alignment_score"))


def setting_factor(keyed: DataFrame, postings: DataFrame, persons: DataFrame) -> DataFrame:
    """Statuses of work mode, place, industry and size with their points, and the texts that name them."""
    settings = posting_values(postings, "setting_id").select(
        "setting_id", "location", "work_mode", "industry", normalize("location").alias("place_key"),
        normalize("work_mode").alias("mode_key"), normalize("industry").alias("industry_key"),
        normalize("company_size").alias("size_key"))
    tastes = person_values(
        persons, "taste_id", "preferred_modes", "preferred_places", "preferred_industries", "avoid_industries",
        "preferred_sizes")
    return meetings(keyed, settings, tastes).withColumns(setting_status()).withColumns(setting_points()).select(
        "setting_id", "taste_id", "n", *setting_status(), *setting_points(), "location", "work_mode", "industry")


def evidence_factor(keyed: DataFrame, postings: DataFrame, persons: DataFrame) -> DataFrame:
    """Coverage of the skill lists by what the candidate can point to."""
    skills = posting_values(postings, "skills_id").select(
        "skills_id", fit.phrase_words(or_no_items("required_skills")).alias("required_words"),
        fit.phrase_words(or_no_items("preferred_skills")).alias("preferred_words"))
    proofs = person_values(persons, "proof_id", "blob")
    covered = meetings(keyed, skills, proofs).withColumns({
        "required_cov": fit.phrase_coverages("required_words", "blob"),
        "preferred_cov": fit.phrase_coverages("preferred_words", "blob")})
    return covered.select(
        "skills_id", "proof_id", "n", fit.relevant_evidence("required_cov", "preferred_cov").alias("evidence"))


def with_factors(keyed: DataFrame, postings: DataFrame, candidates: DataFrame) -> DataFrame:
    """Key rows of pairs with the outcome of every rule that reads lists or texts.

    ``keyed`` holds :func:`posting_keys` and :func:`person_keys` side by side; it
    is written once, since every factor table starts from the ids in it. Tables
    of many rows are met first, while pair rows hold ids and numbers only.
    """
    persons = people(candidates)
    keyed = stored(keyed, "pair-keys")
    tasks = tasks_for(keyed.count())
    factors = [
        (["role_family", "wish_id"], family_factor(persons)),
        (["role_family", "power_id"], capability_factor(persons)),
        (["title_id", "wish_id"], title_factor(keyed, postings, persons)),
        (["setting_id", "taste_id"], setting_factor(keyed, postings, persons)),
        (["skills_id", "proof_id"], evidence_factor(keyed, postings, persons)),
    ]
    tables = [(on, stored(factor, f"factor-{on[0]}")) for on, factor in factors]
    tables = [(on, table, is_small(table)) for on, table in tables]
    rows = keyed
    # Rows are moved to a large table before they carry what they look up where they are.
    for on, table, small in sorted(tables, key=lambda t: t[2]):
        rows = with_factor(rows, table, on, small, tasks)
    return rows
