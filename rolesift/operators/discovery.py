"""One discovery run: landed responses to new, scored postings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift import rules
from rolesift.operators import collect, dedup
from rolesift.operators.candidates import search_phrases
from rolesift.operators.scoring import annotate_match
from rolesift.operators.identity import key_rows
from rolesift.operators.joins import look_up_long, union_all
from rolesift.session import cut_lineage
from rolesift.sources.landing import LANDING_KEYS, entries_of, response_pages

SCOPE = ["candidate_id"]


@dataclass(frozen=True)
class Limits:
    """Limits of a source, for callers that want them; None takes everything."""

    max_pages: int | None = None
    max_jobs: int | None = None


@dataclass(frozen=True)
class Discovery:
    """Result tables of a run; nothing is written yet.

    ``new``, ``keys`` and ``sightings`` are what a run adds to the stored
    tables; ``postings`` is the whole history as it stands after the run.
    """

    postings: DataFrame
    new: DataFrame
    keys: DataFrame
    sightings: DataFrame
    stats: DataFrame
    totals: DataFrame
    lost: DataFrame


@dataclass(frozen=True)
class Collected:
    """What a run read: requests, seen raw rows with outcome, postings, and hits whose detail is missing."""

    requests: DataFrame
    seen: DataFrame
    postings: DataFrame
    lost: DataFrame


def collect_run(
    responses: DataFrame, details: DataFrame, candidates: DataFrame, run_date: date, run_no: int,
    limits: Limits = Limits(),
) -> Collected:
    """The landing is read, parsed and filtered in one pass without a shuffle.

    What the pass leaves is checkpointed: keys, figures of the page and the
    outcome of every raw row, and the payload of rows that passed the filter.
    Pages, limits and statistics come from that table.
    """
    raw = collect.with_ordinal(entries_of(response_pages(responses)), run_no)
    # Most candidates may have no response in a run; only those that do are looked at.
    owners = cut_lineage(candidates.join(responses.select("candidate_id").distinct(), "candidate_id", "left_semi"))
    wanted = search_phrases(owners).select("candidate_id", "phrase_tokens", "places")
    known = look_up_long(raw, wanted, ["candidate_id"], F.struct("source_key", "page_no", "pos"), "left")
    rows = collect.classify(known, F.col("phrase_tokens"), F.col("places"))
    passed = F.when(F.col("outcome") == "parsed", F.col("payload")).alias("payload")
    everything = cut_lineage(rows.filter(F.col("phrase_tokens").isNotNull() | F.col("pos").isNull() | (F.col("pos") == 0)).select(
        *LANDING_KEYS, "n_rows", "failed", "pos", "ordinal", "f_id", "outcome", passed,
        (F.col("phrase_tokens").isNotNull() & F.col("pos").isNotNull()).alias("counted")))

    paged = F.col("connector").isin(list(rules.PAGE_SIZE))
    size = F.when(F.col("connector") == "workday", rules.PAGE_SIZE["workday"]).otherwise(rules.PAGE_SIZE["smartrecruiters"])
    if limits.max_pages is not None:
        everything = everything.filter(~paged | (F.col("page_no") < limits.max_pages))
    pages = everything.filter(F.coalesce(F.col("pos") == 0, F.lit(True))).select(*LANDING_KEYS, "n_rows", "failed")
    ends = collect.last_pages(pages.filter(paged), size)
    rows = collect.until_last(everything.filter("counted"), ends)
    requests = collect.until_last(pages, ends)
    listed, searched = rows.filter(F.col("connector") != "workday"), rows.filter(F.col("connector") == "workday")
    if limits.max_jobs is not None:
        # This connector looks at the limit before each page.
        stops = collect.pages_until_limit(listed.filter(F.col("connector") == "smartrecruiters"), limits.max_jobs)
        requests = collect.until_last(requests, stops)
        listed = collect.cap_per_source(listed, limits.max_jobs)
    searched = collect.workday_first_path(searched)
    hits = collect.with_details(searched.filter(F.col("outcome") == "parsed"), details)
    # The limit of the searched connector counts fetched details; a hit without one is an error.
    hits = hits.withColumn("outcome", F.when(F.col("payload").isNull(), "lost").otherwise("parsed"))
    if limits.max_jobs is not None:
        hits = collect.cap_per_source(hits, limits.max_jobs)
    hits = hits.select(*listed.columns)
    parsed = listed.unionByName(hits).filter(F.col("outcome") == "parsed")
    return Collected(
        requests, listed.unionByName(searched.select(*listed.columns)), collect.normalize_postings(parsed, run_date),
        hits.filter(F.col("outcome") == "lost"))


def run_totals(decided: DataFrame, refreshed: DataFrame, new: DataFrame) -> DataFrame:
    """One row per candidate: fetched, duplicates, rediscovered, new, shortlisted."""
    frames = [
        decided.groupBy(*SCOPE).agg(
            F.count(F.lit(1)).alias("fetched"), F.count_if("is_duplicate").alias("duplicates")),
        refreshed.groupBy(*SCOPE).agg(F.count_if("rediscovered").alias("rediscovered")),
        new.groupBy(*SCOPE).agg(
            F.count(F.lit(1)).alias("new"), F.count_if(F.col("status") == "shortlisted").alias("shortlisted")),
    ]
    names = [c for f in frames for c in f.columns if c not in SCOPE]
    padded = [
        f.select(*SCOPE, *[(F.col(n) if n in f.columns else F.lit(0)).cast("long").alias(n) for n in names])
        for f in frames
    ]
    return union_all(padded).groupBy(*SCOPE).agg(*[F.sum(n).alias(n) for n in names])


def run_discovery(
    responses: DataFrame, details: DataFrame, existing: DataFrame, candidates: DataFrame, run_date: date,
    run_no: int, limits: Limits = Limits(), stored_keys: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
) -> Discovery:
    """Collect, de-duplicate against history, score what is new.

    ``existing`` is the stored history. Running again on the same responses adds
    no posting and only sights the stored ones. A stored posting is never scored
    again. With ``stored_keys``, the key rows written beside the postings or a
    function that finds those of the wanted keys, the history itself is not read
    to find duplicates.
    """
    collected = collect_run(responses, details, candidates, run_date, run_no, limits)
    incoming = cut_lineage(collected.postings)
    history = dedup.backfill_history(existing, run_date)
    keys = key_rows(incoming, SCOPE)
    verdicts = cut_lineage(dedup.resolve_keys(keys, key_rows(history, SCOPE) if stored_keys is None else stored_keys))
    decided = incoming.join(verdicts, "ordinal")
    fresh = (
        decided.filter(~F.col("is_duplicate")).select(*incoming.columns)
        .withColumns({"first_seen_at": F.lit(run_date), "last_seen_at": F.lit(run_date)})
    )
    new = cut_lineage(annotate_match(fresh, candidates))
    refreshed = dedup.refresh_last_seen(history, verdicts, run_date)
    postings = refreshed.drop("rediscovered").unionByName(new, allowMissingColumns=True)
    sightings = verdicts.filter(F.col("matched_existing").isNotNull()).select(
        F.col("matched_existing").alias("ordinal"), F.lit(run_date).alias("seen_at")).distinct()
    stats = collect.source_stats(collected.requests, collected.seen, decided, collected.lost)
    return Discovery(
        postings, new, key_rows(new, SCOPE), sightings, stats, run_totals(decided, refreshed, new), collected.lost)


def shortlisted(postings: DataFrame) -> DataFrame:
    return postings.filter(F.col("status") == "shortlisted")
