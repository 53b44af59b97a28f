"""Tiered identity of a posting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.functions.text import blank_to_null, canonical_url, col, normalize, or_empty, or_no_items, strip

SEPARATOR = "\u001f"
TIERS = {"source_id": 1, "url": 2, "company_title_location_skills": 3}


def sorted_skills(skills: Column | str) -> Column:
    return F.array_sort(F.transform(or_no_items(skills), lambda s: F.lower(strip(s))))


def dedupe_key(company: Column | str, title: Column | str, location: Column | str, skills: Column | str) -> Column:
    """Company, title, place and sorted skills as one text: the weakest tier."""
    return F.concat_ws(
        SEPARATOR, normalize(company), normalize(title), normalize(location),
        F.to_json(sorted_skills(skills)))


def identity_keys() -> Column:
    """array<struct<tier, key>> of at most three keys, strongest first.

    A posting that differs only in its required skills keeps its own third key.
    """
    source, source_id = blank_to_null("source"), blank_to_null(col("source_job_id").cast("string"))
    by_tier = [
        (1, F.when(source.isNotNull() & source_id.isNotNull(), F.concat(source, F.lit(SEPARATOR), source_id))),
        (2, canonical_url("application_url")),
        (3, dedupe_key("company", "title", "location", "required_skills")),
    ]
    return F.filter(
        F.array(*[F.struct(F.lit(t).alias("tier"), k.alias("key")) for t, k in by_tier]),
        lambda k: k["key"].isNotNull())


def _home(key: Column) -> Column:
    """What precedes the first separator or '/' of a key: its source, host or company."""
    return F.substring_index(F.substring_index(key, SEPARATOR, 1), "/", 1)


def key_rows(postings: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(ordinal, tier, key, home): up to three rows per posting, keys as 32-byte digests.

    ``scope`` columns are part of the key, e.g. to keep candidates apart. Equal
    keys have equal homes, and keys of one source, host or company share theirs.
    """
    owner = [or_empty(F.col(c).cast("string")) for c in scope or []]
    digest = F.unhex(F.sha2(
        F.concat_ws(SEPARATOR, *owner, F.col("k.tier").cast("string"), F.col("k.key")), 256))
    return (
        postings.withColumn("k", F.explode(identity_keys()))
        .select("ordinal", F.col("k.tier").alias("tier"), digest.alias("key"),
                F.xxhash64(*owner, "k.tier", _home(F.col("k.key"))).alias("home"))
    )
