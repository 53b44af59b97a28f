"""De-duplication against history and inside a batch.

Rule: postings are taken in order; one that shares any identity key with a
stored posting or with an earlier *kept* posting is a duplicate and adds no
keys. Duplicates of duplicates can therefore be kept, so neither distinct() nor
connected components give the answer. But rows of different components do not touch, so a
small component is settled by one ordered pass; large ones are made smaller in
rounds of aggregations per key. Pairs inside a key are never formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.operators.components import with_components
from rolesift.operators.identity import key_rows
from rolesift.operators.joins import salted_join, union_all
from rolesift.session import cut_lineage


def existing_holders(existing: DataFrame, wanted: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(key, existing_ordinal) of stored postings for the keys in ``wanted(key)``."""
    return holders_of(key_rows(existing, scope), wanted)


def holders_of(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, existing_ordinal): the stored posting that answers for a key.

    Where several stored postings share a key the last one answers. Only keys
    in ``wanted(key)`` are looked at: a run is small beside the history, so the
    semi-join comes before the aggregation and keeps the history from being
    shuffled when the run's keys are small enough to broadcast.
    """
    keys = wanted.select("key").distinct()
    return stored.join(keys, "key", "left_semi").groupBy("key").agg(F.max("ordinal").alias("existing_ordinal"))


def shared_keys(rows: DataFrame) -> DataFrame:
    """Keys that more than one row holds; only these can make duplicates."""
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")


def _winners(rows: DataFrame) -> DataFrame:
    """Ordinals of rows that come first under all their keys.

    A row leads as many keys as it holds; both numbers are map-side combined
    sums, and no row meets the other rows of its key.
    """
    leads = rows.groupBy("key").agg(F.min("ordinal").alias("ordinal")).groupBy("ordinal").agg(F.count(F.lit(1)).alias("led"))
    holds = rows.groupBy("ordinal").agg(F.count(F.lit(1)).alias("held"))
    return leads.join(holds, "ordinal").filter("led = held").select("ordinal")


# Key rows that one ordered pass of a task settles: some 40 bytes each. Larger components go through rounds.
SETTLED_AT_ONCE = 500_000


def _round(undecided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept ordinals, undecided key rows): rows that lead all their keys are kept, those that share a key with them go."""
    winners = cut_lineage(_winners(undecided))
    # A kept row is the first of each of its keys, so every key is taken once.
    taken = undecided.join(winners, "ordinal", "left_semi").select("key")
    gone = salted_join(undecided, taken, ["key"], F.col("ordinal"), "left_semi").select("ordinal").distinct()
    return winners, cut_lineage(undecided.join(gone, "ordinal", "left_anti"))


def _first_come(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows kept of ordered (component, ordinal, keys) rows; keys taken are remembered for one component at a time."""
    component, taken = None, set()
    for batch in batches:
        keep = []
        for label, keys in zip(batch.column("component").to_pylist(), batch.column("keys").to_pylist()):
            if label != component:
                component, taken = label, set()
            free = taken.isdisjoint(keys)
            if free:
                taken.update(keys)
            keep.append(free)
        yield batch.filter(pa.array(keep, pa.bool_())).select(["ordinal"])


def settle(rows: DataFrame) -> DataFrame:
    """Ordinals kept of key rows ``(ordinal, key, component)``, each component in one ordered pass.

    A pass holds the keys of one component, whose number the caller bounds.
    """
    whole = rows.groupBy("component", "ordinal").agg(F.collect_set("key").alias("keys"))
    ordered = whole.repartition("component").sortWithinPartitions("component", "ordinal")
    return ordered.mapInArrow(_first_come, rows.select("ordinal").schema)


def dedupe_in_batch(rows: DataFrame, at_once: int = SETTLED_AT_ONCE) -> DataFrame:
    """Ordinals kept from key rows ``(ordinal, key)`` by the first-come rule.

    Rows that share no key are kept at once. Up to ``at_once`` contested key
    rows are settled in one ordered pass. Of more, a round first keeps the rows
    that lead all their keys and removes those that share a key with them, which
    ends groups of copies; then components of shared keys are found, those of up
    to ``at_once`` key rows are settled in a pass each, side by side, and only
    larger ones go through further rounds, until what is left of them is small
    enough. At least the smallest undecided row is settled in a round, so the
    loop ends. Steps are checkpointed: a lost executor does not replay them.
    """
    rows = rows.select("ordinal", "key")
    contested = salted_join(rows, shared_keys(rows), ["key"], F.col("ordinal"), "left_semi").select("ordinal").distinct()
    kept = [rows.select("ordinal").distinct().join(contested, "ordinal", "left_anti")]
    undecided = cut_lineage(rows.join(contested, "ordinal", "left_semi"))
    left = undecided.count()
    if left > at_once:
        winners, undecided = _round(undecided)
        kept.append(winners)
        left = undecided.count()
    if left <= at_once:
        return union_all([*kept, settle(undecided.withColumn("component", F.lit(0).cast("long")))])
    labelled = cut_lineage(with_components(undecided, at_once))
    while not labelled.isEmpty():
        large = cut_lineage(labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > at_once).select("component"))
        is_large = lambda how: salted_join(labelled, large, ["component"], F.col("ordinal"), how)  # noqa: E731, B023
        kept.append(cut_lineage(settle(is_large("left_anti"))))
        winners, labelled = _round(cut_lineage(is_large("left_semi")))
        kept.append(winners)
    return union_all(kept)


def resolve(incoming: DataFrame, existing: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Verdict per incoming posting.

    ``incoming`` and ``existing`` are postings with an ``ordinal`` each. Result:
    ``ordinal, is_duplicate, matched_tier, matched_existing, matched_incoming``,
    where the match is the holder of the strongest key at the time the posting
    came by: a stored posting, or a kept posting with a smaller ordinal.
    """
    return resolve_keys(key_rows(incoming, scope), key_rows(existing, scope))


def resolve_keys(incoming: DataFrame, stored: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """:func:`resolve` on key rows ``(ordinal, tier, key)``, as stored beside the postings.

    ``stored`` may be a function that finds the stored rows of wanted key rows.
    """
    keys = cut_lineage(incoming)
    holders = holders_of(stored(keys) if callable(stored) else stored, keys)
    with_holder = cut_lineage(salted_join(keys, holders, ["key"], F.col("ordinal"), "left"))
    old = with_holder.filter(F.col("existing_ordinal").isNotNull()).select("ordinal").distinct()
    fresh = with_holder.join(old, "ordinal", "left_anti").select("ordinal", "key")
    kept = cut_lineage(dedupe_in_batch(fresh))
    # Keys of kept rows are unique: no two kept rows share one. A key that only
    # one row holds has no second row to answer for.
    new_holders = (
        fresh.join(kept, "ordinal", "left_semi").join(shared_keys(keys), "key", "left_semi")
        .select("key", F.col("ordinal").alias("new_ordinal")))
    candidates = salted_join(with_holder, new_holders, ["key"], F.col("ordinal"), "left").withColumn(
        "earlier", F.when(F.col("new_ordinal") < F.col("ordinal"), F.col("new_ordinal")))
    held = F.col("existing_ordinal").isNotNull() | F.col("earlier").isNotNull()
    matches = candidates.groupBy("ordinal").agg(
        F.min(F.when(held, F.col("tier"))).alias("matched_tier"),
        F.min_by(F.when(held, F.struct("existing_ordinal", "earlier")), F.when(held, F.col("tier"))).alias("holder"),
    ).join(kept.withColumn("is_kept", F.lit(True)), "ordinal", "left")
    return matches.select(
        "ordinal", F.col("is_kept").isNull().alias("is_duplicate"), "matched_tier",
        F.col("holder.existing_ordinal").alias("matched_existing"),
        F.col("holder.earlier").alias("matched_incoming"))


def backfill_history(postings: DataFrame, run_date) -> DataFrame:
    """Stored postings without history dates get their discovery date, else today."""
    fallback = F.coalesce("date_discovered", F.lit(run_date))
    return postings.withColumns({
        "first_seen_at": F.coalesce("first_seen_at", fallback),
        "last_seen_at": F.coalesce("last_seen_at", fallback),
    })


def refresh_last_seen(existing: DataFrame, verdicts: DataFrame, run_date) -> DataFrame:
    """Stored postings, with last_seen_at moved to today where a duplicate hit them.

    Adds ``rediscovered``: hit now and not yet seen today.
    """
    hit = (
        verdicts.filter(F.col("matched_existing").isNotNull())
        .select(F.col("matched_existing").alias("ordinal")).distinct().withColumn("hit", F.lit(True))
    )
    today = F.lit(run_date)
    seen = F.col("hit").isNotNull()
    return existing.join(hit, "ordinal", "left").withColumns({
        "rediscovered": seen & ~F.col("last_seen_at").eqNullSafe(today),
        "last_seen_at": F.when(seen, today).otherwise(F.col("last_seen_at")),
    }).drop("hit")


def first_last_seen(log: DataFrame, identity: list[str], run_date: str = "run_date") -> DataFrame:
    """First and latest run per identity from a log of sightings."""
    return log.groupBy(*identity).agg(
        F.min(run_date).alias("first_seen_at"), F.max(run_date).alias("last_seen_at"))
