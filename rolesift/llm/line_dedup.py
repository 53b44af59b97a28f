"""Incremental line dedup: sharded cuckoo filters over exact reference counts.

The exact table holds, per line digest, in how many documents the line stands.
Inserting documents adds to it, deleting them subtracts, so a batch can be taken
back. Per shard of the digests a cuckoo filter holds those lines whose count has
reached the limit; lines that cross it either way are inserted into or deleted
from the filter, which is why it is a cuckoo and not a Bloom filter. Removal
sends every line past its shard's filter first; only hits are looked up in the
exact table, so false positives cost a look-up and change nothing.

A line that stands in a third of all documents is counted before the shuffle
and, on the way back, dealt over SALTS parts of its shard. Filters are streamed
ahead of the lines of their shard: a task holds one filter, never a group of
lines. A digest is 128 bits of MD5.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.functions.text import let
from rolesift.llm.base import BLANKS, aside, ascii_lower, held, row_key, written
from rolesift.operators.joins import SALTS, salted_join

SLOTS = 4
MAX_KICKS = 200
FILTERS = "shard int, blob binary"
REFS = "digest binary, refs long"


class CuckooFilter:
    """A set of 16-byte digests by 16-bit fingerprints, with deletion.

    A table that is too full for another digest gets a larger one beside it;
    look-ups ask all tables.
    """

    def __init__(self, blob: bytes | None = None, expected: int = 16) -> None:
        self.tables: list[np.ndarray] = []
        at = 0
        while blob and at < len(blob):
            buckets = int.from_bytes(blob[at:at + 4], "little")
            size = buckets * SLOTS * 2
            self.tables.append(np.frombuffer(blob, np.uint16, buckets * SLOTS, at + 4).reshape(buckets, SLOTS).copy())
            at += 4 + size
        if not self.tables:
            self._add_table(expected)

    def _add_table(self, expected: int) -> None:
        buckets = 4
        while buckets * SLOTS * 0.8 < expected:
            buckets *= 2
        self.tables.append(np.zeros((buckets, SLOTS), np.uint16))

    def blob(self) -> bytes:
        return b"".join(len(t).to_bytes(4, "little") + t.tobytes() for t in self.tables)

    @staticmethod
    def _hashes(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints (never 0), first bucket numbers and what leads to the other bucket."""
        words = digests.reshape(-1, 16).view(np.uint32)
        prints = (words[:, 0] & 0xFFFF).astype(np.uint32)
        prints[prints == 0] = 1
        return prints, words[:, 1], prints * np.uint32(0x5BD1E995) >> np.uint32(7)

    def contains(self, digests: np.ndarray) -> np.ndarray:
        prints, first, jump = self._hashes(digests)
        found = np.zeros(len(prints), bool)
        for table in self.tables:
            mask = np.uint32(len(table) - 1)
            one = first & mask
            two = (one ^ jump) & mask
            found |= ((table[one] == prints[:, None]) | (table[two] == prints[:, None])).any(axis=1)
        return found

    def insert(self, digests: np.ndarray) -> None:
        prints, first, jump = self._hashes(digests)
        for p, f, j in zip(prints.tolist(), first.tolist(), jump.tolist(), strict=True):
            while not self._placed(self.tables[-1], p, f, j):
                self._add_table(2 * SLOTS * len(self.tables[-1]))

    @staticmethod
    def _placed(table: np.ndarray, print_: int, first: int, jump: int) -> bool:
        mask = len(table) - 1
        bucket, undo = first & mask, []
        for at in (bucket, (bucket ^ jump) & mask):
            free = np.flatnonzero(table[at] == 0)
            if len(free):
                table[at, free[0]] = print_
                return True
        for kick in range(MAX_KICKS):
            slot = kick % SLOTS
            undo.append((bucket, slot, int(table[bucket, slot])))
            print_, table[bucket, slot] = int(table[bucket, slot]), print_
            bucket = (bucket ^ ((print_ * 0x5BD1E995 & 0xFFFFFFFF) >> 7)) & mask
            free = np.flatnonzero(table[bucket] == 0)
            if len(free):
                table[bucket, free[0]] = print_
                return True
        for at, slot, old in reversed(undo):
            table[at, slot] = old
        return False

    def delete(self, digests: np.ndarray) -> None:
        """Remove digests that were inserted before.

        The largest table that has the fingerprint loses it. Digests with equal
        buckets there have equal buckets in all smaller tables too, so if the
        entry was another digest's, that one is found by the entry left behind.
        """
        prints, first, jump = self._hashes(digests)
        for p, f, j in zip(prints.tolist(), first.tolist(), jump.tolist(), strict=True):
            for table in reversed(self.tables):
                mask = len(table) - 1
                places = [(at, s) for at in {f & mask, ((f & mask) ^ j) & mask} for s in range(SLOTS) if table[at, s] == p]
                if places:
                    table[places[0]] = 0
                    break


def _bytes(column: pa.Array | pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist() if isinstance(column, pa.Array) else list(column)), np.uint8)


@dataclass(frozen=True)
class LineIndex:
    """The state: exact counts and filters as written tables, and the rule."""

    refs: DataFrame
    filters: DataFrame
    shards: int
    min_documents: int = 10
    min_chars: int = 1


def empty_index(spark, shards: int = 64, min_documents: int = 10, min_chars: int = 1) -> LineIndex:
    """``shards`` bounds a filter: choose it so that a shard has at most some 100,000 frequent lines."""
    return LineIndex(spark.createDataFrame([], REFS), spark.createDataFrame([], FILTERS), shards, min_documents, min_chars)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_digests(text: Column, min_chars: int) -> Column:
    """Hexadecimal digest per line; NULL for lines whose key is too short to count."""
    def digest(line: Column) -> Column:
        key = F.btrim(line, F.lit(BLANKS))
        return F.when(F.char_length(key) >= min_chars, F.md5(ascii_lower(key)))

    return F.transform(lines_of(text), digest)


def _shard(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def _changed(index: LineIndex, docs: DataFrame, sign: int, text_column: str) -> LineIndex:
    keys = F.array_distinct(F.array_compact(line_digests(F.col("text"), index.min_chars)))
    batch = (
        aside(docs, {"text": text_column}).select(F.explode(keys).alias("hex"))
        .groupBy("hex").agg((F.count("*") * sign).alias("delta"))
        .select(F.unhex("hex").alias("digest"), F.lit(0).cast("long").alias("refs"), "delta"))
    before = index.refs.select("digest", "refs", F.lit(0).cast("long").alias("delta"))
    counts = written(
        before.unionByName(batch).groupBy("digest").agg(F.sum("refs").alias("before"), F.sum("delta").alias("delta"))
        .select("digest", "before", (F.col("before") + F.col("delta")).alias("refs")), "line-counts")
    if sign < 0 and not counts.filter("refs < 0").isEmpty():
        raise ValueError("documents to delete were not inserted before")
    limit = index.min_documents
    crossing = counts.filter((F.col("before") < limit) != (F.col("refs") < limit)).select(
        _shard(F.col("digest"), index.shards).alias("shard"), "digest", (F.col("refs") >= limit).alias("gained"))

    def updated(key: tuple, old: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
        gained = changes["gained"].astype(bool)
        blob = old["blob"].iloc[0] if len(old) else None
        cuckoo = CuckooFilter(blob, int(gained.sum()))
        cuckoo.delete(_bytes(changes["digest"][~gained]))
        cuckoo.insert(_bytes(changes["digest"][gained]))
        return pd.DataFrame({"shard": [key[0]], "blob": [cuckoo.blob()]})

    filters = written(
        index.filters.groupBy("shard").cogroup(crossing.groupBy("shard")).applyInPandas(updated, FILTERS), "line-filters")
    return replace(index, refs=counts.filter("refs > 0").select("digest", "refs"), filters=filters)


def insert(index: LineIndex, docs: DataFrame, text_column: str = "text") -> LineIndex:
    """The index with these documents counted. Every row is a document of its own, repeated rows too."""
    return _changed(index, docs, 1, text_column)


def delete(index: LineIndex, docs: DataFrame, text_column: str = "text") -> LineIndex:
    """The index without these documents, the inverse of ``insert``; ValueError if a line of theirs has fewer documents."""
    return _changed(index, docs, -1, text_column)


def _past_filter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines whose digest their shard's filter holds. The filter stands ahead of the lines of its part."""
    cuckoo, part_of = None, None
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        salts = batch.column("salt").to_numpy()
        edges = np.flatnonzero((shards[1:] != shards[:-1]) | (salts[1:] != salts[:-1])) + 1
        for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(shards)], strict=True):
            if begin == end:
                continue
            rows, part = batch.slice(begin, end - begin), (int(shards[begin]), int(salts[begin]))
            if part != part_of:
                cuckoo, part_of = None, part
            if rows.column("blob")[0].is_valid:
                cuckoo = CuckooFilter(rows.column("blob")[0].as_py())
                rows = rows.slice(1)
            if cuckoo is None or not rows.num_rows:
                continue
            hits = rows.filter(pa.array(cuckoo.contains(_bytes(rows.column("digest")))))
            if hits.num_rows:
                yield hits.select(["key", "pos", "digest"])


def dropped_lines(index: LineIndex, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """key, positions: the lines to drop, per distinct (id, text) of ``docs`` that has any."""
    rows = aside(docs, {"doc_id": id_column, "text": text_column})
    lines = (
        rows.select(row_key(F.col("doc_id"), F.col("text")).alias("key"),
                    F.posexplode(line_digests(F.col("text"), index.min_chars)).alias("pos", "hex"))
        .filter("hex IS NOT NULL")
        .select("key", "pos", F.unhex("hex").alias("digest"))
        .select("key", "pos", "digest", _shard(F.col("digest"), index.shards).alias("shard"),
                F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(None).cast("binary").alias("blob")))
    heads = index.filters.select(
        F.lit(None).cast("binary").alias("key"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("binary").alias("digest"),
        "shard", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"), "blob")
    routed = (
        lines.unionByName(heads).repartition("shard", "salt")
        .sortWithinPartitions("shard", "salt", F.col("blob").isNull()))
    hits = routed.mapInArrow(_past_filter, "key binary, pos int, digest binary")
    frequent = index.refs.filter(F.col("refs") >= index.min_documents).select("digest")
    return (
        salted_join(hits, frequent, ["digest"], F.col("key"), "left_semi")
        .groupBy("key").agg(F.collect_set("pos").alias("positions")))


def remove_lines(index: LineIndex, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """row (all columns of ``docs``), kept (text without frequent lines), n_lines, n_dropped.

    A NULL or empty text is one empty line, which has no key and stays. Rows
    with the same id and text, NULL ids included, share one decision.
    """
    key = row_key(docs[f"`{id_column}`"], docs[f"`{text_column}`"])
    drops = dropped_lines(index, docs, id_column, text_column)
    text = F.coalesce(F.col("text"), F.lit(""))

    def rest(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("positions"))
        return F.array_join(F.transform(left, lambda i: lines[i]), "\n")

    return (
        docs.select(held(docs), docs[f"`{text_column}`"].alias("text"), key.alias("key"))
        .join(drops, "key", "left")
        .select(
            "row", F.when(F.col("positions").isNull(), text).otherwise(let(lines_of(F.col("text")), rest)).alias("kept"),
            F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
            F.coalesce(F.size("positions"), F.lit(0)).cast("long").alias("n_dropped")))


def index_of(docs: DataFrame, min_documents: int = 10, min_chars: int = 1, text_column: str = "text") -> LineIndex:
    """An index of these documents alone, with shards in proportion to them."""
    shards = max(16, docs.count() // 50_000)
    return insert(empty_index(docs.sparkSession, shards, min_documents, min_chars), docs, text_column)


def without_frequent_lines(docs: DataFrame, min_documents: int = 10, id_column: str = "doc_id",
                           text_column: str = "text") -> DataFrame:
    """``docs`` with frequent lines gone from the text column; texts that lose nothing, NULL among them, stay as they are.

    ``n_chars``, where it exists, follows the text.
    """
    out = remove_lines(index_of(docs, min_documents, text_column=text_column), docs, id_column, text_column)
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row")[text_column])
    columns = []
    for c in docs.columns:
        value = F.col("row")[c]
        if c == text_column:
            value = text
        elif c == "n_chars":
            value = F.when(F.col("n_dropped") > 0, F.char_length("kept")).otherwise(value).cast(docs.schema[c].dataType)
        columns.append(value.alias(c))
    return out.select(*columns)
