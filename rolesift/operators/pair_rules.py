"""Rules of a pair that several ways of scoring share: posting features and setting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.functions import fit
from rolesift.functions.roles import family_in_text, known_family, level_of_key
from rolesift.functions.text import col, normalize, or_no_items, text_array, title_tokens


def posting_features(postings: DataFrame, *carried: Column | str) -> DataFrame:
    """Posting-only part of the rules. The description is read here and dropped.

    The normalised title, its words and its family are columns of their own
    before anything reads them, so each is derived once per row.
    """
    keyed = postings.select(
        *carried, col("id").alias("job_id"), "title", "location", "work_mode", "industry",
        normalize("title").alias("title_key"), normalize("location").alias("place_key"),
        normalize("work_mode").alias("mode_key"), normalize("industry").alias("industry_key"),
        normalize("company_size").alias("size_key"),
        "salary_min", "salary_max", "min_experience_years", "max_experience_years",
        title_tokens("title").alias("title_words"),
        fit.phrase_words(or_no_items("required_skills")).alias("required_words"),
        fit.phrase_words(or_no_items("preferred_skills")).alias("preferred_words"),
        fit.appears_legitimate("application_url", "description").alias("legitimate"),
        col("description").alias("_description"),
    )
    known = keyed.withColumn("_family", known_family("title_key", "title_words"))
    return known.withColumns({
        "role_family": F.coalesce("_family", family_in_text("title_key", "_description"), F.lit("UNKNOWN")),
        "title_family": F.coalesce("_family", F.lit("UNKNOWN")),
        "career_level": level_of_key("title_key", "min_experience_years"),
    }).drop("_description", "_family")


# Features of a posting that follow from shorter columns beside them.
PHRASE_LISTS = ["required_words", "preferred_words"]
PLAIN_KEYS = {"place_key": "location", "mode_key": "work_mode", "industry_key": "industry"}


def packed_features(features: DataFrame) -> DataFrame:
    """Posting features as they travel with very many pairs: words in one text, no keys that are quickly made again."""
    def packed(phrases: str) -> Column:
        return F.transform(phrases, lambda p: F.struct(p["phrase"].alias("phrase"), F.array_join(p["words"], " ").alias("words")))

    return features.withColumns({c: packed(c) for c in PHRASE_LISTS}).drop(*PLAIN_KEYS)


def unpacked_features(rows: DataFrame) -> DataFrame:
    """What :func:`packed_features` has packed; a word holds no blank."""
    def unpacked(phrases: str) -> Column:
        return F.transform(phrases, lambda p: F.struct(
            p["phrase"].alias("phrase"), F.when(p["words"] == "", text_array([])).otherwise(F.split(p["words"], " ")).alias("words")))

    return rows.withColumns({**{c: unpacked(c) for c in PHRASE_LISTS}, **{k: normalize(c) for k, c in PLAIN_KEYS.items()}})


def setting_status() -> dict[str, Column]:
    """Statuses of work mode, place, industry and company size."""
    return {
        "work_mode_status": fit.work_mode_status("mode_key", "preferred_modes"),
        "location_status": fit.place_status("mode_key", "place_key", "preferred_places"),
        "industry_status": fit.industry_status("industry_key", "preferred_industries", "avoid_industries"),
        "company_size_status": fit.company_size_status("size_key", "preferred_sizes"),
    }


def setting_points() -> dict[str, Column]:
    return {
        "location_fit": fit.location_fit("work_mode_status", "location_status"),
        "industry_fit": fit.industry_fit("industry_status", "company_size_status"),
    }
