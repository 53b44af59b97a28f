"""Joins in which no key owns a task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts into which the rows of one key are cut.
SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salt: Column, how: str = "inner") -> DataFrame:
    """Equality join of a large side with one short row per key.

    ``salt`` deals the rows of ``left`` over SALTS parts of each key; ``right``
    has at most one row per key and is repeated once per part. They meet in a
    merge join: Spark takes the size of the repeated side for that of ``right``,
    so a broadcast could bring SALTS times what it bears to the driver. Keys
    compare as Spark compares them: NULL meets nothing.
    """
    left = left.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return left.join(right.hint("merge"), [*on, "_salt"], how).drop("_salt")


# Rows of one key that one task takes; a key with more rows is cut into parts.
ROWS_PER_PART = 50_000


# Buckets of keys that are counted first; a bucket of few rows holds no crowded key.
KEY_BUCKETS = 65_536


def crowded_counts(rows: DataFrame, on: list[str]) -> DataFrame:
    """(on, n) of the keys of more than ROWS_PER_PART rows.

    Rows are counted per bucket of keys, so a task hands on KEY_BUCKETS numbers
    at most and not its keys. Keys are counted where a bucket is full only.
    ``rows`` are read twice.
    """
    bucket = F.pmod(F.xxhash64(*on), F.lit(KEY_BUCKETS)).alias("_bucket")
    full = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > ROWS_PER_PART).select("_bucket")
    near = rows.select(*on, bucket).join(F.broadcast(full), "_bucket", "left_semi")
    return near.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > ROWS_PER_PART)


def parted_join(left: DataFrame, right: DataFrame, on: list[str], salt: Column, how: str = "inner",
                counts: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Equality join of a large side with one row per key, however many keys there are or however wide their rows.

    The rows of ``left`` are counted per key, and only keys of more than
    ROWS_PER_PART rows are cut into parts by ``salt``; such keys are few. Rows
    of ``right`` are repeated for the parts of their key and for no other. They
    meet in a merge join: Spark's guess of a repeated or computed side may be
    far too low to let it choose a broadcast. ``counts`` (on, n) saves the
    counting; ``tasks`` deals ``left`` over so many tasks.
    """
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    parts = F.ceil(F.col("n") / ROWS_PER_PART).cast("int").alias("_parts")
    many = F.broadcast(counts.filter(F.col("n") > ROWS_PER_PART).select(*on, parts))
    count = F.coalesce("_parts", F.lit(1))
    # A key with NULL meets nothing, so its rows may lie anywhere.
    blank = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    dealt = F.when(blank, F.lit(SALTS)).otherwise(count)
    left = left.join(many, on, "left").withColumn("_salt", F.pmod(F.xxhash64(salt), dealt).cast("int")).drop("_parts")
    right = right.join(many, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), count - 1))).drop("_parts")
    if tasks is not None:
        left = left.repartition(tasks, *on, "_salt")
    return left.join(right.hint("merge"), [*on, "_salt"], how).drop("_salt")


# Wide rows that one task sorts at once; of more than MANY_ROWS, the number of tasks follows from them.
ROWS_PER_TASK = 250_000
MANY_ROWS = 1_000_000


def tasks_for(rows: int) -> int | None:
    """Tasks for so many wide rows, or None where Spark may choose."""
    return -(-rows // ROWS_PER_TASK) if rows > MANY_ROWS else None


# A table with one short row per key is sent to every executor up to this many rows; beyond, rows meet in a salted join.
BROADCAST_ROWS = 100_000


def look_up(left: DataFrame, right: DataFrame, on: list[str], salt: Column, how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right``, which has one row per key; the rows of ``right`` are counted first."""
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    return salted_join(left, right, on, salt, how)


# A table with a long row per key is sent to every executor up to this many rows.
BROADCAST_LONG_ROWS = 5_000


def look_up_long(left: DataFrame, right: DataFrame, on: list[str], salt: Column, how: str = "inner") -> DataFrame:
    """:func:`look_up` for rows of some kilobytes; of more rows than a broadcast bears, none is repeated without need."""
    if right.count() <= BROADCAST_LONG_ROWS:
        return left.join(F.broadcast(right), on, how)
    return parted_join(left, right, on, salt, how)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
