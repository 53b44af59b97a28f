"""Source registry: which boards to check and which to promote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolesift.functions.text import title_is_relevant

KEY = ["connector", "source_key"]


def sources_anti_active(seeds: DataFrame, active: DataFrame) -> DataFrame:
    """Seeds that are not active yet."""
    return seeds.join(active.select(*KEY), KEY, "left_anti")


def check_cap(seeds: DataFrame, active: DataFrame, limit: int | None = None) -> DataFrame:
    """Non-active seeds; with a ``limit``, the first so many per connector, in list order."""
    if limit is None:
        return sources_anti_active(seeds, active)
    turn = Window.partitionBy("connector").orderBy("ordinal")
    return (
        sources_anti_active(seeds, active).withColumn("turn", F.row_number().over(turn))
        .filter(F.col("turn") <= limit).drop("turn")
    )


def board_relevance(checked: DataFrame, probes: DataFrame, titles: DataFrame, phrase_tokens: Column) -> DataFrame:
    """Checked boards with total and relevant openings and their bucket.

    ``probes(connector, source_key, exists, error)`` is the outcome of the one
    request per board, ``titles(connector, source_key, title)`` what it listed.
    """
    # Boards repeat titles; each distinct one is judged once.
    per_title = titles.groupBy(*KEY, "title").agg(F.count(F.lit(1)).alias("n"))
    relevant = F.coalesce(title_is_relevant("title", phrase_tokens), F.lit(False))
    counts = per_title.groupBy(*KEY).agg(
        F.sum("n").alias("total_jobs"), F.sum(F.when(relevant, F.col("n")).otherwise(0)).alias("relevant_jobs"))
    exists = F.coalesce(F.col("exists"), F.lit(False))
    rows = checked.join(probes, KEY, "left").join(counts, KEY, "left")
    total = F.when(exists, F.coalesce("total_jobs", F.lit(0)))
    relevant = F.when(exists, F.coalesce("relevant_jobs", F.lit(0)))
    return rows.select(
        *KEY, "ordinal", total.alias("total_jobs"), relevant.alias("relevant_jobs"),
        F.when(~exists, "not_found_or_unavailable").when(relevant > 0, "verified_relevant")
        .otherwise("verified_no_relevant_match").alias("bucket"),
        F.when(~exists, F.col("error")).alias("reason"))


def board_report(
    seeds: DataFrame, active: DataFrame, results: DataFrame, limit: int | None = None,
) -> DataFrame:
    """Figures per connector.

    With a ``limit``, active seeds behind the point where it stopped the list
    were never looked at and are not counted.
    """
    known = seeds.join(active.select(*KEY).distinct(), KEY, "left_semi")
    if limit is not None:
        turn = Window.partitionBy("connector").orderBy("ordinal")
        stop = (
            sources_anti_active(seeds, active).withColumn("turn", F.row_number().over(turn))
            .filter(F.col("turn") == limit + 1).select("connector", F.col("ordinal").alias("stop"))
        )
        known = known.join(stop, "connector", "left").filter(F.col("stop").isNull() | (F.col("ordinal") < F.col("stop")))
    known = known.groupBy("connector").agg(F.count(F.lit(1)).alias("already_active"))
    listed = seeds.groupBy("connector").agg(F.count(F.lit(1)).alias("candidates_total"))
    buckets = ["verified_relevant", "verified_no_relevant_match", "not_found_or_unavailable"]
    sizes = results.groupBy("connector").agg(
        F.count(F.lit(1)).alias("checked"),
        *[F.count_if(F.col("bucket") == b).alias(b) for b in buckets])
    names = ["candidates_total", "already_active", "checked", *buckets]
    return (
        listed.join(known, "connector", "left").join(sizes, "connector", "left")
        .select("connector", *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in names])
    )


def promote_sources(active: DataFrame, results: DataFrame) -> DataFrame:
    """Registry with the verified relevant boards behind the active ones.

    The order is (promoted, ordinal): active entries keep their place and a
    board is listed once.
    """
    old = active.select(*KEY, F.struct(F.lit(0).alias("promoted"), "ordinal").alias("at"))
    new = results.filter(F.col("bucket") == "verified_relevant").select(
        *KEY, F.struct(F.lit(1).alias("promoted"), "ordinal").alias("at"))
    return (
        old.unionByName(new).groupBy(*KEY).agg(F.min("at").alias("at"))
        .select(*KEY, F.col("at.promoted").alias("promoted"), F.col("at.ordinal").alias("ordinal"))
    )


def check_boards(
    seeds: DataFrame, active: DataFrame, probes: DataFrame, titles: DataFrame, phrase_tokens: Column, limit: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, report, registry): boards chosen, judged, counted and promoted in one go."""
    results = board_relevance(check_cap(seeds, active, limit), probes, titles, phrase_tokens)
    return results, board_report(seeds, active, results, limit), promote_sources(active, results)


def sources_distinct(sources: DataFrame) -> DataFrame:
    """Every source once, at its first place."""
    return sources.groupBy(*KEY).agg(F.min("ordinal").alias("ordinal"))
