"""Filter interaction audit: what each filter removes, in every order, from sorted posting lists of failing ids.

A posting list holds the failing documents of one filter in one part, ascending.
Lists are kept per id range: documents are sorted by part and id over all tasks,
and each run of at most an Arrow batch of one part is a range of its own, so a
part with most documents is spread over many tasks and a list never outgrows a
batch. Within a range the union of each set of filters grows out of a smaller
set's union by one merge: the shorter list gallops through the longer one, its
fences first, then the postings between two fences. Differences need no merge of
their own: what a filter removes after a set is the size of the union with it
less the size without. Sizes add up over ranges; only those reach a shuffle.

Every order of the filters passes through such sets only, so all 120 orders are
read off 32 sizes per part.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.llm.base import aside, slices, written
from rolesift.operators.joins import look_up

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 200, 50, 2
CAPITALS = bytes(range(65, 91))
SYMBOLS = b"#$%&*|"
SETS = 1 << len(FILTERS)
FENCE = 16
FLAGS = "part string, doc_id long, mask int, digest binary"
SIZES = "part string, filters int, failing long, good long, toxic long"


def text_flags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters A to D of each whole text as bits, and its digest."""
    for part in slices(batches, "text"):
        texts = pc.fill_null(part.column("text"), "")
        points = pc.utf8_length(texts).to_pylist()
        masks, digests = [], []
        for raw, size in zip(texts.cast(pa.binary()).to_pylist(), points, strict=True):
            words = raw.split()
            masks.append(
                (len(words) < LEAST_WORDS)
                | (100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words)) << 1
                | (100 * (len(raw) - len(raw.translate(None, CAPITALS))) > MOST_CAPITALS_PERCENT * size) << 2
                | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3)
            digests.append(hashlib.sha256(raw).digest())
        yield pa.RecordBatch.from_arrays(
            [pc.fill_null(part.column("part"), ""), part.column("doc_id"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
            names=["part", "doc_id", "mask", "digest"])


def gallop(keys: np.ndarray, into: np.ndarray) -> np.ndarray:
    """For each of some ascending keys, how many of ``into`` are smaller.

    Every FENCE-th key is placed first. The keys behind it start where it stands
    and double their steps until they are past their place, then halve.
    """
    n = len(into)
    low = np.zeros(len(keys), np.int64) if len(keys) <= FENCE else np.repeat(gallop(keys[::FENCE], into), FENCE)[:len(keys)]
    high, step = low.copy(), 1
    live = np.flatnonzero(high < n)
    while len(live := live[into[high[live]] < keys[live]]):
        low[live] = high[live] + 1
        high[live] = np.minimum(high[live] + step, n)
        step *= 2
        live = live[high[live] < n]
    while len(live := np.flatnonzero(low < high)):
        middle = (low[live] + high[live]) // 2
        below = into[middle] < keys[live]
        low[live[below]] = middle[below] + 1
        high[live[~below]] = middle[~below]
    return low


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of two posting lists: the shorter one gallops through the longer."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return b
    at = gallop(a, b)
    new = (at == len(b)) | (b[np.minimum(at, len(b) - 1)] != a)
    return np.insert(b, at[new], a[new])


def union_sizes(lists: list[np.ndarray], marks: list[np.ndarray]) -> np.ndarray:
    """For every set of lists the size of its union, and how many of that union each of ``marks`` (flags by id) has."""
    unions: list[np.ndarray] = [np.zeros(0, np.int64)]
    for chosen in range(1, 1 << len(lists)):
        last = chosen.bit_length() - 1
        unions.append(merged(unions[chosen ^ (1 << last)], lists[last]))
    return np.array([[len(u), *[int(m[u].sum()) for m in marks]] for u in unions], np.int64)


def range_sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the sizes of each part's ranges, from rows sorted by part."""
    part, total = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * SETS, pa.string()), pa.array(np.arange(SETS, dtype=np.int32)), *[pa.array(total[:, i]) for i in range(3)]],
            names=["part", "filters", "failing", "good", "toxic"])

    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("part").dictionary_encode()
        code = names.indices.to_numpy()
        mask = batch.column("mask").to_numpy()
        flags = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic")]
        bounds = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1], [True])))
        for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            name = names.dictionary[int(code[begin])].as_py()
            if name != part:
                if part is not None:
                    yield out()
                part, total = name, np.zeros((SETS, 3), np.int64)
            # A document's number in its range is its posting.
            lists = [np.flatnonzero(mask[begin:end] >> i & 1) for i in range(len(FILTERS))]
            total += union_sizes(lists, [f[begin:end] for f in flags])
    if part is not None:
        yield out()


@cache
def order_steps() -> list[tuple[str, int, int, int, int]]:
    """Order, step, the filter's number, and the sets of filters before and after the step, for all orders."""
    return [
        (order, step, FILTERS.index(order[step - 1]), *(sum(1 << FILTERS.index(c) for c in order[:n]) for n in (step - 1, step)))
        for order in map("".join, permutations(FILTERS)) for step in range(1, len(FILTERS) + 1)]


def failing(docs: DataFrame) -> DataFrame:
    """part, doc_id, mask with the bits of all five filters; ``docs``: part, doc_id, text."""
    rows = written(docs.mapInArrow(text_flags, FLAGS), "flags")
    # The smallest id of each text that stands there more than once; minima are combined before the shuffle.
    first = written(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).filter(
        "copies > 1 AND first IS NOT NULL").select("digest", "first"), "copies")
    found = look_up(rows, first, ["digest"], F.coalesce("doc_id", F.lit(0)), "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    return found.select("part", "doc_id", F.col("mask").bitwiseOR(F.shiftleft(copy, 4)).alias("mask"))


def audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          part_column: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step; see the columns below.

    kept (after the step), removed, redundant (failing, but gone before),
    unique_fails (failing this filter only), good_lost and toxic_lost (removed,
    with quality or toxic 1), shapley (removed by the filter, summed over all
    orders). NULL parts and the empty string are one part; NULL texts are empty.
    Every row counts as a document: rows that repeat an id each count, and fail
    filter E only beside a smaller id with their text. A NULL id is smaller than
    none and has no smaller one, and no labels. Of labels that repeat an id any
    1 counts. No documents, no rows.
    """
    rows = written(failing(aside(docs, {"part": part_column, "doc_id": id_column, "text": text_column}).withColumn(
        "doc_id", F.col("doc_id").cast("long"))), "failing")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    lists = rows.filter("mask <> 0").join(marks, "doc_id", "left").select(
        "part", "doc_id", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    ranges = lists.repartitionByRange("part", "doc_id", "mask").sortWithinPartitions("part", "doc_id")
    sums = ranges.mapInArrow(range_sizes, SIZES).groupBy("part", "filters").agg(*[F.sum(c).alias(c) for c in ("failing", "good", "toxic")])
    # At most 32 rows per part from here on.
    per_part = sums.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("filters", "failing", "good", "toxic"))).alias("sizes"))
    none = F.expr(f"transform(sequence(0, {SETS - 1}), s -> struct(int(s) AS filters, 0L AS failing, 0L AS good, 0L AS toxic))")
    parts = rows.groupBy("part").agg(F.count("*").alias("total")).join(per_part, "part", "left").withColumn("sizes", F.coalesce("sizes", none))
    # As many orders have a filter behind a set as there are orders of the set times orders of the rest.
    fact = [1, 1, 2, 6, 24]
    shares = [" + ".join(
        f"{fact[s.bit_count()] * fact[len(FILTERS) - 1 - s.bit_count()]} * (sizes[{s | 1 << number}].failing - sizes[{s}].failing)"
        for s in range(SETS) if not s >> number & 1) for number in range(len(FILTERS))]
    shapley = F.expr(f"array({', '.join(shares)})")
    # A table of its own: the sums above are not worked out again for every order and step.
    parts = written(parts.withColumn("shapley", shapley), "parts")
    names = ("filter_order", "step", "number", "before", "after")
    steps = F.from_json(
        F.lit(json.dumps([dict(zip(names, row, strict=True)) for row in order_steps()])),
        "array<struct<filter_order: string, step: int, number: int, before: int, after: int>>")
    one = parts.withColumn("s", F.explode(steps)).select("part", "total", "sizes", "shapley", "s.*")
    own, every = "shiftleft(1, number)", SETS - 1
    return one.selectExpr(
        "part", "filter_order", "step",
        "total - sizes[after].failing AS kept",
        "sizes[after].failing - sizes[before].failing AS removed",
        f"sizes[{own}].failing - (sizes[after].failing - sizes[before].failing) AS redundant",
        f"sizes[{every}].failing - sizes[{every} - {own}].failing AS unique_fails",
        "sizes[after].good - sizes[before].good AS good_lost",
        "sizes[after].toxic - sizes[before].toxic AS toxic_lost",
        "shapley[number] AS shapley")
