"""Mixing sources to target weights: nested hash thresholds found by histograms, never by sorting.

Each document has a fixed 40-bit hash. Of each source the mix takes whole
passes, and for the rest the documents whose hash lies below a threshold. The
threshold is found level by level: sum the words per source and bucket (10 bits
of the hash), find the bucket in which the running sum meets the budget, and
look again only at the documents inside that bucket. A smaller budget gives a
smaller threshold, so the mixes of growing budgets are nested.

Only DataFrame functions are used. A histogram is at most 1,024 sums per source
and level, combined before the shuffle; a source that owns a third of all rows
is never brought together. Reading off targets takes one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolesift.llm.base import BLANKS, WORD, aside, held, written
from rolesift.operators.joins import look_up

LEVELS, BITS = 4, 10
DEPTH = LEVELS * BITS


def n_words(text: Column) -> Column:
    """Words of a text; NULL has none."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, ".")
    return F.char_length(F.translate(marks, BLANKS, "")).cast("long")


def doc_hash(doc_id: Column, text: Column, seed: str) -> Column:
    """40 bits that depend on seed, id and text only: reruns agree."""
    parts = [F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit("")))]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, DEPTH // 4), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def targets(sizes: DataFrame, weights: list[int], share_percent: int, max_passes: int) -> DataFrame:
    """key, source_size, target per source: the share dealt by weight, none above max_passes times its size.

    Sources are filled in the order of limit per unit of weight. The first one
    that its part does not fill fixes the level for itself and all behind it.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    limits = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * max_passes).withColumn(
        "share", F.sum("source_size").over(everything) * F.lit(share_percent) / F.lit(100.0))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("share") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("w").over(behind)
    steps = limits.withColumn("level", level).withColumn("open", F.col("w") * F.col("level") <= F.col("most"))
    first = F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(everything)
    here = F.struct(F.col("most") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("level"))
    return steps.withColumn("first", first).withColumn("here", here).select(
        "key", "source_size",
        F.when(F.col("first").isNull() | (F.col("here") < F.col("first")), F.col("most").cast("double"))
        .otherwise(F.col("w") * F.col("first")["level"]).alias("target"))


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, source_size, target, passes, threshold per source, from rows of key, size and hash."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = wanted.withColumn("passes", whole).withColumn(
        "rest", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    names = ["key", "source_size", "target", "passes"]
    for level in range(1, LEVELS + 1):
        state = written(state, f"mix-level-{level}")
        shift = DEPTH - level * BITS
        inside = look_up(rows, state.select("key", "prefix").filter("rest > 0"), ["key"], F.col("hash")).filter(
            F.shiftright("hash", shift + BITS) == F.col("prefix"))
        histogram = inside.groupBy("key", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = histogram.withColumn("below", F.coalesce(F.sum("words").over(running), F.lit(0)))
        met = state.select("key", "rest").join(sums, "key").filter("below < rest AND rest <= below + words").groupBy("key").agg(
            F.min(F.struct("bucket", "below", "words")).alias("found"))
        state = state.join(met, "key", "left").select(
            *names, (F.col("rest") - F.coalesce(F.col("found.below"), F.lit(0))).alias("rest"),
            F.coalesce(F.col("found.bucket"), F.lit(0)).alias("prefix"), F.col("found.words").alias("words"))
    nearest = F.when(2 * F.col("rest") >= F.col("words"), F.col("prefix") + 1).otherwise(F.col("prefix"))
    return written(state.select(*names, F.when(F.col("rest") > 0, nearest).otherwise(0).alias("threshold")), "mix-thresholds")


def prepared(docs: DataFrame, seed: str, id_column: str, text_column: str, source_column: str) -> DataFrame:
    rows = aside(docs, {"doc_id": id_column, "text": text_column, "source": source_column})
    return written(rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", source_key(F.col("source")).alias("key"),
        n_words(F.col("text")).alias("size"), doc_hash(F.col("doc_id"), F.col("text"), seed).alias("hash")), "mix-rows")


def plan(rows: DataFrame, weights: list[int], share_percent: int, max_passes: int) -> DataFrame:
    sizes = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    return thresholds(rows, targets(sizes, weights, share_percent, max_passes))


COPIES = "passes + CASE WHEN hash < threshold THEN 1 ELSE 0 END"


def mix(docs: DataFrame, weights: list[int], share_percent: int = 150, max_passes: int = 2, seed: str = "mix",
        id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies, taken.

    A NULL text has no words; NULL is a source of its own, after all others.
    Rows with the same id and text have one hash and are taken together; an
    empty table gives an empty result.
    """
    rows = prepared(docs, seed, id_column, text_column, source_column)
    chosen = look_up(rows, plan(rows, weights, share_percent, max_passes), ["key"], F.col("hash"))
    copies = F.expr(COPIES).cast("long")
    return chosen.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed_documents(docs: DataFrame, weights: list[int], share_percent: int = 150, max_passes: int = 2, seed: str = "mix",
                    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: rows not taken are gone, a row taken twice stands there twice."""
    chosen = plan(prepared(docs, seed, id_column, text_column, source_column), weights, share_percent, max_passes)
    text, doc_id, source = docs[f"`{text_column}`"], docs[f"`{id_column}`"], docs[f"`{source_column}`"]
    rows = docs.select(held(docs), source_key(source).alias("key"), doc_hash(doc_id, text, seed).alias("hash"))
    copies = F.expr(f"CAST({COPIES} AS INT)")
    return (
        look_up(rows, chosen, ["key"], F.col("hash")).withColumn("copies", copies).filter("copies > 0")
        .select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*"))
