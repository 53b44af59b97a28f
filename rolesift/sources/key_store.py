"""Identity keys of the stored history, kept so that a run reads what may concern it only.

Keys of one source, host or company lie in one bucket, a folder of each run.
Beside the keys a run stores a Bloom filter per bucket as a table of 64-bit
words: a key belongs to one word and sets four of its bits. A run asks the
filters first and then reads the buckets that may hold one of its keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolesift import schemas
from rolesift.sources.landing import complete_runs, read_runs

KEYS_FOLDER, FILTERS_FOLDER = "keys", "key_filters"
# A run has as many buckets as its keys fill, a power of two that is written beside its filters.
KEYS_PER_BUCKET = 10_000
MOST_BUCKETS = 1024
# 16 bits of a filter for each key: about 1 stranger in 100 passes.
KEYS_PER_WORD = 4
BITS_PER_KEY = 4
FILTERS = T.StructType([
    T.StructField("buckets", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("words", T.LongType()),
    T.StructField("word", T.LongType()), T.StructField("bits", T.LongType())])


def buckets_for(keys: int) -> int:
    filled = -(-keys // KEYS_PER_BUCKET)
    return min(MOST_BUCKETS, 1 << max(filled - 1, 0).bit_length())


def bucket_of(buckets: Column) -> Column:
    return F.coalesce(F.pmod("home", buckets), F.lit(0)).cast("int")


def _in_places(places: dict[int, list[int]], outer: str) -> Column:
    return reduce(lambda a, b: a | b, [(F.col(outer) == n) & F.col("bucket").isin(buckets) for n, buckets in places.items()])


def _places(rows: DataFrame, outer: str) -> dict[int, list[int]]:
    """{outer: buckets} of the rows: bucket numbers only, at most MOST_BUCKETS for each outer value."""
    found: dict[int, list[int]] = {}
    for row in rows.select(outer, "bucket").distinct().collect():
        found.setdefault(row[outer], []).append(row["bucket"])
    return {n: sorted(buckets) for n, buckets in sorted(found.items())}


def _word() -> Column:
    return F.pmod(F.xxhash64("key"), F.col("words"))


def _mask() -> Column:
    """The bits of a key in its word: four numbers of six bits of a second hash."""
    bits = [f"shiftleft(1L, CAST(shiftright(xxhash64(key, 1), {6 * i}) & 63 AS INT))" for i in range(BITS_PER_KEY)]
    return F.expr(" | ".join(bits))


def bloom_filters(keys: DataFrame, buckets: int) -> DataFrame:
    """(buckets, bucket, words, word, bits) of key rows with a bucket.

    Words are combined before they are shuffled, so a bucket that holds most
    keys has no task of its own. The table of sizes has a row per bucket.
    """
    sizes = keys.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / KEYS_PER_WORD).alias("words"))
    return (
        keys.join(F.broadcast(sizes), "bucket")
        .groupBy("bucket", "words", _word().alias("word")).agg(F.bit_or(_mask()).alias("bits"))
        .withColumn("buckets", F.lit(buckets)).select(*FILTERS.names)
    )


def write_keys(keys: DataFrame, path: str, run_no: int) -> None:
    """Keys and filters of a run, which replace an earlier writing of the same run.

    Buckets of ordinary size are one file each; a larger one is split by size.
    """
    spark, run = keys.sparkSession, f"version={run_no:010d}"
    folder = f"{path}/{KEYS_FOLDER}/{run}"
    rows = keys.select(*schemas.KEYS.names)
    buckets = buckets_for(rows.count())
    rows = rows.withColumn("bucket", bucket_of(F.lit(buckets)))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket").parquet(folder)
    written = spark.read.schema(T.StructType([*schemas.KEYS.fields, FILTERS["bucket"]])).parquet(folder)
    bloom_filters(written, buckets).sortWithinPartitions("bucket", "word").write.mode("overwrite").parquet(f"{path}/{FILTERS_FOLDER}/{run}")


def read_keys(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """All identity keys of complete runs."""
    return read_runs(spark, f"{path}/{KEYS_FOLDER}", schemas.KEYS, before, complete_runs(spark, path))


def buckets_to_read(spark: SparkSession, path: str, wanted: DataFrame, before: int | None = None) -> dict[int, list[int]]:
    """{run: buckets} that may hold a key of ``wanted(key, home)``; none that does is left out.

    What comes to the driver are the numbers of buckets that occur, at most
    eleven powers of two, and bucket numbers.
    """
    filters = read_runs(spark, f"{path}/{FILTERS_FOLDER}", FILTERS, before, complete_runs(spark, path), numbered=True)
    widths = sorted(r["buckets"] for r in filters.select("buckets").distinct().collect())
    asked = wanted.select("home", "key").distinct().withColumn("buckets", F.explode(F.array(*[F.lit(n) for n in widths]).cast("array<int>")))
    asked = asked.withColumn("bucket", bucket_of(F.col("buckets")))
    near = _places(asked, "buckets")
    if not near:
        return {}
    filters = filters.filter(_in_places(near, "buckets"))
    sizes = filters.select("version", "buckets", "bucket", "words").distinct()
    probes = asked.join(sizes, ["buckets", "bucket"]).select("version", "bucket", _word().alias("word"), _mask().alias("mask"))
    passed = probes.join(filters, ["version", "bucket", "word"]).filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    return _places(passed, "version")


def matching_keys(spark: SparkSession, path: str, wanted: DataFrame, before: int | None = None) -> DataFrame:
    """Stored key rows of the buckets that may hold a key of ``wanted``.

    Holds every stored row of a wanted key, and other rows of the same buckets.
    Folders of other buckets are not opened.
    """
    places = buckets_to_read(spark, path, wanted, before)
    if not places:
        return spark.createDataFrame([], schemas.KEYS)
    parts = T.StructType([*schemas.KEYS.fields, T.StructField("version", T.IntegerType()), FILTERS["bucket"]])
    rows = spark.read.schema(parts).parquet(f"{path}/{KEYS_FOLDER}")
    return rows.filter(_in_places(places, "version")).select(*schemas.KEYS.names)
