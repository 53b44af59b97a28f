"""De-duplication against a sequential statement of the first-come rule."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rolesift import schemas
from rolesift.operators import components, dedup, joins
from rolesift.operators.identity import key_rows
from rolesift.session import cut_lineage
from rolesift.sources import key_store, sinks

SCHEMA = ("ordinal long, source string, source_job_id string, application_url string, company string, "
          "title string, location string, required_skills array<string>")


def keys_of(row):
    found = []
    _, source, job, url, company, title, place, skills = row
    if source and job:
        found.append((1, source, job))
    if url:
        found.append((2, url.split("://")[1].split("?")[0].rstrip("/").lower()))
    found.append((3, (company or "").lower(), (title or "").lower(), (place or "").lower(), tuple(sorted(skills or []))))
    return found


def sequential(incoming, stored):
    """{ordinal: (tier, stored ordinal, incoming ordinal)} of duplicates, in file order."""
    index = {}
    for row in stored:
        for key in keys_of(row):
            index[key] = ("old", row[0])
    verdict = {}
    for row in incoming:
        hit = next((k for k in keys_of(row) if k in index), None)
        if hit:
            kind, at = index[hit]
            verdict[row[0]] = (hit[0], at if kind == "old" else None, at if kind == "new" else None)
            continue
        for key in keys_of(row):
            index[key] = ("new", row[0])
    return verdict


def random_rows(rng, first, n):
    return [(
        first + i, rng.choice(["a", "b", "", None]), rng.choice(["1", "2", "3", "4", "5", None]),
        rng.choice([None, "http://x/1", "https://x/1?q", "http://x/2", "http://x/3", "http://x/4/"]),
        rng.choice(["A", "B"]), rng.choice(["t", "u", None]), rng.choice(["p", ""]),
        rng.choice([[], ["s"], ["s", "r"], ["r", "s"]])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_resolve_equals_sequential_rule(spark, seed):
    rng = random.Random(seed)
    stored, incoming = random_rows(rng, 0, 5), random_rows(rng, 100, 120)
    got = dedup.resolve(
        spark.createDataFrame(incoming, SCHEMA), spark.createDataFrame(stored, SCHEMA)).collect()
    assert len(got) == len(incoming)
    duplicates = {r["ordinal"]: (r["matched_tier"], r["matched_existing"], r["matched_incoming"])
                  for r in got if r["is_duplicate"]}
    assert duplicates == sequential(incoming, stored)


def test_chain_keeps_every_second_row(spark):
    """a~b, b~c, c~d: a and c stay. Connected components would keep only a."""
    rows = [(i, key) for i in range(9) for key in (f"k{i}", f"k{i + 1}")]
    kept = dedup.dedupe_in_batch(spark.createDataFrame(rows, "ordinal long, key string"))
    assert sorted(r[0] for r in kept.collect()) == [0, 2, 4, 6, 8]


def test_one_key_with_most_rows(spark):
    rows = [(i, "hot") for i in range(500)] + [(i, f"own{i}") for i in range(700)]
    kept = dedup.dedupe_in_batch(spark.createDataFrame(rows, "ordinal long, key string"))
    assert sorted(r[0] for r in kept.collect()) == [0, *range(500, 700)]


def test_nothing_to_do(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert dedup.resolve(empty, empty).count() == 0


def test_salted_join_cuts_a_key(spark):
    facts = spark.range(1000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    dims = facts.select("k").distinct().withColumn("name", F.concat(F.lit("n"), F.col("k")))
    joined = joins.salted_join(facts, dims, ["k"], F.col("row"))
    assert joined.count() == 1000
    assert joined.filter(F.col("name") != F.concat(F.lit("n"), F.col("k"))).count() == 0
    salts = facts.withColumn("s", F.pmod(F.xxhash64("row"), F.lit(joins.SALTS))).filter("k = 0").groupBy("s").count()
    assert salts.agg(F.max("count")).first()[0] < 60


def test_look_up_beyond_the_broadcast_bound(spark, monkeypatch):
    facts = spark.range(100).select(F.col("id").alias("row"), (F.col("id") % 3).alias("k"))
    dims = spark.createDataFrame([(0, "a"), (1, "b")], "k long, name string")
    rows = lambda: sorted(tuple(r) for r in joins.look_up(facts, dims, ["k"], F.col("row")).collect())
    small = rows()
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1)
    assert rows() == small and len(small) == 67


def test_scope_separates_candidates(spark):
    rows = [(1, "s", "1", None, "A", "t", "", [], "c1"), (2, "s", "1", None, "A", "t", "", [], "c2")]
    df = spark.createDataFrame(rows, SCHEMA + ", candidate_id string")
    assert key_rows(df).select("key").distinct().count() == 2
    assert key_rows(df, ["candidate_id"]).select("key").distinct().count() == 4


def test_history_dates(spark):
    day = lambda n: dt.date(2026, 3, n)
    rows = [(1, None, None, day(1)), (2, day(1), day(2), day(1)), (3, day(1), day(9), None), (4, None, None, None)]
    stored = spark.createDataFrame(rows, "ordinal long, first_seen_at date, last_seen_at date, date_discovered date")
    filled = dedup.backfill_history(stored, day(9))
    verdicts = spark.createDataFrame([(1,), (1,), (3,), (None,)], "matched_existing long")
    got = {r["ordinal"]: (r["first_seen_at"], r["last_seen_at"], r["rediscovered"])
           for r in dedup.refresh_last_seen(filled, verdicts, day(9)).collect()}
    assert got == {1: (day(1), day(9), True), 2: (day(1), day(2), False), 3: (day(1), day(9), False), 4: (day(9), day(9), False)}


def in_order(pairs):
    """Rows kept of (ordinal, key) pairs by the first-come rule."""
    taken, kept = set(), []
    for row in sorted({r for r, _ in pairs}):
        keys = {k for r, k in pairs if r == row}
        if taken.isdisjoint(keys):
            taken |= keys
            kept.append(row)
    return kept


def rooted(pairs):
    """{ordinal: smallest ordinal of its component}"""
    root = {r: r for r, _ in pairs}
    while True:
        low = {}
        for r, k in pairs:
            low[k] = min(low.get(k, r), root[r])
        after = {}
        for r, k in pairs:
            after[r] = min(after.get(r, root[r]), low[k])
        if after == root:
            return root
        root = after


def tangled(seed):
    """Pairs, chains, one key of a third of all rows, and a dense part."""
    rng = random.Random(seed)
    rows = [(i, f"dense{rng.randrange(60)}") for i in range(60) for _ in range(2)]
    rows += [(100 + i, f"c{i // 2 + j}") for i in range(80) for j in (0, 1)]
    rows += [(200 + i, "hot") for i in range(90)] + [(200 + i, f"h{rng.randrange(70)}") for i in range(90)]
    rows += [(300 + i, f"p{i // 2}") for i in range(40)]
    moved = list(range(400))
    rng.shuffle(moved)
    return [(moved[r], k) for r, k in rows]


@pytest.mark.parametrize("seed,at_once", [(1, 20), (2, 60), (3, 10_000)])
def test_small_and_large_components(spark, seed, at_once):
    pairs = tangled(seed)
    kept = dedup.dedupe_in_batch(spark.createDataFrame(pairs, "ordinal long, key string"), at_once)
    assert sorted(r[0] for r in kept.collect()) == in_order(pairs)


@pytest.mark.parametrize("at_once", [20, 10_000])
def test_components_of_shared_keys(spark, at_once):
    pairs = tangled(5)
    got = components.with_components(spark.createDataFrame(pairs, "ordinal long, key string"), at_once).collect()
    assert len(got) == len(pairs)
    want, label = rooted(pairs), {r["ordinal"]: r["component"] for r in got}
    assert len({(label[r], want[r]) for r in want}) == len(set(want.values())) == len(set(label.values()))


def test_a_long_chain_takes_a_fixed_number_of_jobs(spark):
    def jobs(n):
        group = f"chain-{n}"
        rows = spark.range(n).select(F.col("id").alias("ordinal"), F.explode(F.array("id", F.col("id") + 1)).alias("key"))
        spark.sparkContext.setJobGroup(group, group)
        kept = dedup.dedupe_in_batch(rows)
        assert kept.agg(F.sum("ordinal"), F.count("*")).first() == (sum(range(0, n, 2)), (n + 1) // 2)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    try:
        assert jobs(10_000) <= jobs(100) + 4 <= 30
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def key_store_of(spark, path, runs):
    for run_no, rows in enumerate(runs):
        keys = key_rows(spark.createDataFrame(rows, SCHEMA)).withColumn("ordinal", F.struct(*[
            (F.col("ordinal") if f.name == "pos" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.ORDINAL.fields]))
        sinks.append_run(
            spark.createDataFrame([], schemas.DISCOVERED), keys, spark.createDataFrame([], schemas.SIGHTINGS), path, run_no)


def board(source, first, n):
    return [(first + i, f"s{source}", str(first + i), f"https://h{source}.example.com/jobs/{first + i}", f"Company {source}",
             f"title {first + i}", "x", []) for i in range(n)]


def test_a_run_reads_its_buckets_of_the_key_store(spark, tmp_path, monkeypatch):
    """A run of one source in a hundred reads under a tenth of the store and reaches the same verdicts."""
    monkeypatch.setattr(key_store, "KEYS_PER_BUCKET", 100)
    path = str(tmp_path / "history")
    key_store_of(spark, path, [[r for s in range(100) for r in board(s, 1000 * s + 100 * run, 20)] for run in (0, 1)])
    everything = key_store.read_keys(spark, path)
    assert everything.count() == 100 * 2 * 20 * 3
    incoming = cut_lineage(key_rows(spark.createDataFrame(board(7, 7005, 20), SCHEMA)))
    places = key_store.buckets_to_read(spark, path, incoming)
    # Only the first run holds keys of these postings; the filters leave the second one out, or nearly.
    assert 1 <= len(places[0]) <= 3 and len(places.get(1, [])) <= 2
    near = key_store.matching_keys(spark, path, incoming)
    assert 0 < near.count() < everything.count() / 10
    assert near.select(F.input_file_name()).distinct().count() <= sum(len(b) for b in places.values())
    scan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "bucket" in scan.split("PartitionFilters: [")[1].split("]")[0]
    verdicts = lambda stored: sorted(
        (r["ordinal"], r["is_duplicate"], r["matched_tier"], r["matched_existing"]) for r in dedup.resolve_keys(incoming, stored).collect())
    pruned = verdicts(lambda wanted: key_store.matching_keys(spark, path, wanted))
    assert pruned == verdicts(everything)
    assert sum(r[1] for r in pruned) == 15


def test_filters_know_every_key(spark, tmp_path, monkeypatch):
    """No stored key is missed, strangers of known homes mostly are, and a repeated run replaces its filters."""
    monkeypatch.setattr(key_store, "KEYS_PER_BUCKET", 500)
    assert [key_store.buckets_for(n) for n in (0, 500, 501, 1800, 10**9)] == [1, 1, 2, 4, 1024]
    path = str(tmp_path / "history")
    key_store_of(spark, path, [[r for s in range(5) for r in board(s, 1000 * s, 200)]])
    key_store_of(spark, path, [[r for s in range(3) for r in board(s, 1000 * s, 200)]])
    stored = key_store.read_keys(spark, path)
    assert stored.count() == 3 * 200 * 3
    for known in (0, 2):
        wanted = key_rows(spark.createDataFrame(board(known, 1000 * known, 200), SCHEMA))
        found = key_store.matching_keys(spark, path, wanted)
        assert wanted.join(found, "key", "left_semi").count() == 600
    gone = key_rows(spark.createDataFrame(board(4, 4000, 200), SCHEMA))
    assert gone.join(key_store.matching_keys(spark, path, gone), "key", "left_semi").count() == 0
    keys = key_rows(spark.createDataFrame(board(0, 500_000, 300), SCHEMA)).withColumn("bucket", key_store.bucket_of(F.lit(4)))
    bits = spark.read.schema(key_store.FILTERS).parquet(f"{path}/{key_store.FILTERS_FOLDER}")
    sizes = bits.select("bucket", "words").distinct()
    passed = keys.join(sizes, "bucket").withColumns({"word": key_store._word(), "mask": key_store._mask()}).join(
        bits.drop("words"), ["bucket", "word"]).filter("bits & mask = mask").count()
    assert passed <= 45  # of 900
    nothing = key_store.matching_keys(spark, str(tmp_path / "none"), keys)
    assert nothing.count() == 0 and nothing.columns == schemas.KEYS.names
