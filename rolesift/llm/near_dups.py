"""Near-duplicate documents by an LSH forest over MinHash signatures.

Each distinct shingle set gets a signature of VALUES values. Every tree sorts the
sets by its own order of the signature: PREFIX values as the root, then all
others, four bits of each, so rows beside each other have the longest common
prefixes. Depth follows the region: sets that share a root with at most SMALL
sets are compared with all of them; in a more crowded region the order goes on
through the signature and a set is compared with the sets beside it. A tree is
cut by range, so a crowded region is spread over tasks; the rows at the cuts are
compared once more.

Sets of a crowded region agree in most values (a form, a page frame), so those
values tell its sets apart badly. Such sets get MORE values and are sorted once
more, in one order per value in which a set differs from most of its region,
rooted in that value alone: sets that share a filled-in part stand beside each
other there, whatever the size of the region. Each set has a bounded number of
neighbours in every order, so candidates grow with the sets.

A candidate counts only when the full sets reach the similarity. First each
set's best candidates are confirmed, twice; then all between classes that are
still apart. After each step a set beside a member of another class is compared
with that class's hub, the member with most links, since a set may be close to
the centre of a class and to nobody else in it; this goes on until no link is
new, once per set and hub. Copies count once from the start: a set stands for
all its documents.

At similarity 0.8 a pair shares the root of at least one of 20 trees with
probability 1 - (1 - 0.8^4)^20, more than 0.9999.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolesift.llm.base import aside, held, released, row_key, slices, written
from rolesift.operators.joins import look_up, look_up_long, salted_join

TREES, PREFIX = 20, 4
VALUES = TREES * PREFIX
#: Values of sets in crowded regions beyond those.
MORE = 160
#: A region of so many sets is compared pair by pair; a larger one row by row in its order.
SMALL = 8
#: Trees whose crowded regions say in which values their sets differ.
REGION_TREES = range(0, TREES, 5)
#: Of VALUES four-bit values at least so many agree in a pair at the limit, but for 1 in 10,000.
LEAST_MATCHES = 52
#: Best candidates per set that are confirmed in the first rounds; then all that are left.
QUOTAS = (1, 1, None)
EDGES_PER_TASK = 500_000
RESULT = "a binary, b binary, ca binary, cb binary, similarity double, linked boolean"
SETS = "doc_id long, key binary, n_shingles long, digest binary, signature binary, shingles binary"
NODE = "tree int, root long, bits binary, digest binary, n long"
CROWD = "tree int, root long, digest binary, n long, values binary"
ORDER = ["tree", "root", "bits", "digest"]
FIELDS = [("tree", pa.int32()), ("root", pa.int64()), ("bits", pa.binary()), ("digest", pa.binary()), ("n", pa.int64())]
FOUND = "a binary, b binary, matches int, region struct<tree:int,root:long>, edge struct<tree:int,root:long,bits:binary,digest:binary,n:long>"


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text; a shorter text is one shingle."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    counts = pc.list_value_length(lists).to_numpy()
    flat = lists.flatten()
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(texts)), counts)[~empty]
    words = flat.filter(pa.array(~empty)).dictionary_encode()
    counts = np.bincount(owner, minlength=len(texts))
    table = pd.util.hash_array(np.array(words.dictionary.to_pylist(), dtype=object), categorize=False) if len(words) else None
    hashes = table[words.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    out, at = [], 0
    for count in counts.tolist():
        w = hashes[at:at + count]
        at += count
        width = min(size, count)
        x = np.full(count - width + 1 if count else 0, np.uint64(width), np.uint64)
        for i in range(width):
            x = _mix(x + w[i:i + len(x)] * np.uint64(0x9E3779B97F4A7C15))
        out.append(np.unique(x))
    return out


def _seeds(count: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    base = _mix(np.arange(first, first + 2 * count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return base[:count] | np.uint64(1), base[count:]


def signatures(sets: list[np.ndarray], count: int = VALUES, first: int = 1) -> np.ndarray:
    """``count`` 32-bit MinHash values per set; an empty set has zeros."""
    out = np.zeros((len(sets), count), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[i] for i in full])
    starts = np.cumsum([0, *[len(sets[i]) for i in full[:-1]]])
    for k, (a, b) in enumerate(zip(*_seeds(count, first), strict=True)):
        out[full, k] = np.minimum.reduceat(flat * a + b, starts) >> np.uint64(32)
    return out


def _pack(shingles: np.ndarray) -> bytes:
    """Six bytes of each hash: enough to tell the shingles of two texts apart."""
    return np.ascontiguousarray(shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _sketcher(size: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text"), size)
            found = signatures(sets)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("key"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([f.tobytes() for f in found], pa.binary()), pa.array([_pack(s) for s in sets], pa.binary()),
            ], names=["doc_id", "key", "n_shingles", "digest", "signature", "shingles"])

    return run


def _nodes(part: pa.RecordBatch, rows: np.ndarray, tree: np.ndarray, root: np.ndarray, low: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """Rows of orders: the four-bit values follow from place ``first`` on, round to the one before it."""
    turned = low[rows[:, None], (first[:, None] + np.arange(VALUES)) % VALUES]
    bits = turned[:, ::2] << 4 | turned[:, 1::2]
    at = pa.array(rows)
    return pa.RecordBatch.from_arrays([
        pa.array(tree.astype(np.int32)), pa.array(root.view(np.int64)), pa.array([r.tobytes() for r in bits], pa.binary()),
        part.column("digest").take(at), part.column("n").take(at)], names=[f[0] for f in FIELDS])


def tree_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per set and tree: hash of the root's values, then four bits of every value from behind the root on."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 2_000):
            part = batch.slice(begin, 2_000)
            values = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(-1, VALUES)
            low, rows = (values & 15).astype(np.uint8), np.arange(len(values))
            for tree in range(TREES):
                root = np.zeros(len(values), np.uint64)
                for i in range(tree * PREFIX, tree * PREFIX + PREFIX):
                    root = _mix(root + values[:, i] + np.uint64(1))
                yield _nodes(part, rows, np.full(len(rows), tree), root, low, np.full(len(rows), tree * PREFIX + PREFIX))


def crowd_values(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of crowded regions with all their values instead of their shingles."""
    for part in slices(batches, "shingles"):
        sets = [_unpack(b) for b in part.column("shingles").to_pylist()]
        values = np.concatenate((signatures(sets), signatures(sets, MORE, 1 + 2 * VALUES)), axis=1)
        yield pa.RecordBatch.from_arrays(
            [*[part.column(c) for c in ("tree", "root", "digest", "n")], pa.array([v.tobytes() for v in values], pa.binary())],
            names=["tree", "root", "digest", "n", "values"])


def _low_values(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    values = np.frombuffer(b"".join(part.column("values").to_pylist()), np.uint32).reshape(part.num_rows, VALUES + MORE)
    return values, (values & 15).astype(np.uint8)


def _by_region(counted: Callable, result: Callable, name: str) -> Callable:
    """``result`` of the summed counts of each region, whose rows follow each other; only one region's counts are held."""
    def row(region: tuple[int, int], counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([region[0]], pa.int32()), pa.array([region[1]], pa.int64()), pa.array([result(counts)], pa.binary())],
            names=["tree", "root", name])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, counts = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, root = batch.column("tree").to_numpy(), batch.column("root").to_numpy()
            bounds = np.flatnonzero(np.concatenate(([True], (tree[1:] != tree[:-1]) | (root[1:] != root[:-1]), [True])))
            for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                here = (int(tree[begin]), int(root[begin]))
                if here != region:
                    if region is not None:
                        yield row(region, counts)
                    region, counts = here, np.zeros((16, VALUES + MORE), np.int64)
                counts += counted(batch.slice(begin, end - begin))
        if region is not None:
            yield row(region, counts)

    return run


def _counts(part: pa.RecordBatch) -> np.ndarray:
    """How many of the sets have each four-bit value, per place."""
    low = _low_values(part)[1]
    return np.stack([(low == v).sum(axis=0) for v in range(16)])


def _counts_of_parts(part: pa.RecordBatch) -> np.ndarray:
    return sum(np.frombuffer(zlib.decompress(b), np.int64).reshape(16, -1) for b in part.column("counts").to_pylist())


def _most_frequent(counts: np.ndarray) -> bytes:
    """The four-bit value of most sets per place; 16, which no set has, where a region has no more than two."""
    usual = counts.argmax(axis=0) if counts[:, 0].sum() > 2 else np.full(counts.shape[1], 16)
    return usual.astype(np.uint8).tobytes()


def differing_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per set and value in which it differs from what is ``usual`` in its region, rooted in that value."""
    for batch in batches:
        for first in range(0, batch.num_rows, 2_000):
            part = batch.slice(first, 2_000)
            values, low = _low_values(part)
            usual = np.frombuffer(b"".join(part.column("usual").to_pylist()), np.uint8).reshape(low.shape)
            rows, column = np.nonzero(low != usual)
            for begin in range(0, len(rows), 20_000):
                at, c = rows[begin:begin + 20_000], column[begin:begin + 20_000]
                yield _nodes(part, at, TREES + c, _mix(values[at, c] + np.uint64(1)), low[:, :VALUES], np.where(c < VALUES, c + 1, 0))


def crowd_rows(crowds: DataFrame) -> DataFrame:
    """What ``differing_rows`` makes of ``crowds`` (tree, root, digest, n, shingles), however their regions are cut over tasks.

    What is usual is counted per region and task and summed, so the parts of a
    region agree on it. The rows are written: a cut by range reads its input
    twice, to find the cuts and to make them.
    """
    by = ["tree", "root", "digest"]
    valued = written(
        crowds.select(*by, "n", "shingles").repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(released(crowd_values), CROWD), "crowd-values")
    counts = valued.mapInArrow(_by_region(_counts, lambda c: zlib.compress(c.tobytes(), 1), "counts"), "tree int, root long, counts binary")
    usual = written(counts.repartition("tree", "root").sortWithinPartitions("tree", "root").mapInArrow(
        _by_region(_counts_of_parts, _most_frequent, "usual"), "tree int, root long, usual binary"), "usual")
    return written(look_up_long(valued, usual, ["tree", "root"], F.col("digest")).mapInArrow(released(differing_rows), NODE), "differing")


def _neighbours(percent: int, with_edges: bool) -> Callable:
    """Candidates among rows in the order of trees, sets of crowded regions, and the rows at both ends."""
    names = [f[0] for f in FIELDS]
    node, region = pa.struct(FIELDS), pa.struct(FIELDS[:2])
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("matches", pa.int32()), ("region", region), ("edge", node)])

    def out(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def edges(rows: pa.RecordBatch) -> pa.RecordBatch:
        column = pa.StructArray.from_arrays([rows.column(c) for c in names], fields=[pa.field(*f) for f in FIELDS])
        return pa.RecordBatch.from_arrays([*[pa.nulls(rows.num_rows, f.type) for f in list(schema)[:4]], column], schema=schema)

    def compared(rows: pa.RecordBatch, crowd: bool) -> Iterator[pa.RecordBatch]:
        """Pairs of whole regions; with ``crowd`` the first row is the last one of a crowded region and was compared with those before it."""
        if not rows.num_rows:
            return
        tree, root, n = (rows.column(c).to_numpy() for c in ("tree", "root", "n"))
        digest = rows.column("digest").to_pylist()
        bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8).reshape(len(tree), -1)
        starts = np.flatnonzero(np.concatenate(([True], (tree[1:] != tree[:-1]) | (root[1:] != root[:-1]))))
        sizes = np.diff(np.append(starts, len(tree)))
        of = np.repeat(np.arange(len(starts)), sizes)
        crowded = sizes > SMALL
        crowded[0] |= crowd
        for apart in range(1, min(SMALL, len(tree))):
            j = np.arange(apart, len(tree))
            i = j - apart
            near = (of[i] == of[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            if apart > 1:
                near &= ~crowded[of[j]]
            i, j = i[near], j[near]
            differ = bits[i] ^ bits[j]
            matches = ((differ & 15 == 0).sum(axis=1) + (differ & 240 == 0).sum(axis=1)).astype(np.int32)
            pairs = [(min(digest[x], digest[y]), max(digest[x], digest[y]), m)
                     for x, y, m in zip(i.tolist(), j.tolist(), matches.tolist(), strict=True) if m >= LEAST_MATCHES and digest[x] != digest[y]]
            if pairs:
                a, b, m = zip(*pairs, strict=True)
                yield out(len(a), a=a, b=b, matches=m)
        for k in np.flatnonzero(crowded & (sizes > SMALL) & np.isin(tree[starts], REGION_TREES)).tolist():
            at = slice(int(starts[k]), int(starts[k] + sizes[k]))
            size = at.stop - at.start
            yield out(size, a=digest[at], region=[{"tree": int(tree[at.start]), "root": int(root[at.start])}] * size)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last region of a batch may go on in the next: a small one waits, of a crowded one the last row does.
        waiting, crowd, seen, last = None, False, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = batch.select(names)
            if with_edges and seen < SMALL:
                yield edges(fresh.slice(0, SMALL - seen))
            seen += fresh.num_rows
            if with_edges:
                last = fresh if last is None else _joined(last, fresh)
                last = last.slice(max(0, last.num_rows - SMALL))
            rows = fresh if waiting is None else _joined(waiting, fresh)
            tree, root = rows.column("tree").to_numpy(), rows.column("root").to_numpy()
            same = np.flatnonzero((tree != tree[-1]) | (root != root[-1]))
            begin = int(same[-1]) + 1 if len(same) else 0
            goes_on = crowd and begin == 0
            if goes_on or rows.num_rows - begin > SMALL:
                yield from compared(rows, crowd)
                waiting, crowd = rows.slice(rows.num_rows - 1), True
            else:
                yield from compared(rows.slice(0, begin), crowd)
                waiting, crowd = rows.slice(begin), False
        if waiting is not None:
            yield from compared(waiting, crowd)
        if with_edges and last is not None:
            yield edges(last)

    return run


def _joined(a: pa.RecordBatch, b: pa.RecordBatch) -> pa.RecordBatch:
    return pa.Table.from_batches([a, b]).combine_chunks().to_batches()[0]


def _ordered_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """What ``_neighbours`` finds in all orders of ``rows``, over the cuts between tasks too."""
    found = written(rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(released(_neighbours(percent, True)), FOUND), "neighbours")
    cuts = found.filter("edge IS NOT NULL").select("edge.*").distinct().repartition("tree").sortWithinPartitions(*ORDER)
    return found.filter("edge IS NULL").unionByName(written(cuts.mapInArrow(_neighbours(percent, False), FOUND), "cuts"))


def candidate_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a < b (digests) and matches: neighbours in any order, each pair once. ``nodes``: digest, n, signature; ``sets``: digest, shingles."""
    found = _ordered_pairs(nodes.mapInArrow(released(tree_rows), NODE), percent)
    crowds = written(found.filter("region IS NOT NULL").groupBy(F.col("a").alias("digest")).agg(
        F.min("region").alias("r")).select("digest", "r.*"), "crowds")
    pairs = found
    if not crowds.isEmpty():
        full = look_up(sets, crowds, ["digest"], F.col("doc_id")).dropDuplicates(["digest"]).withColumn(
            "n", (F.octet_length("shingles") / 6).cast("long"))
        pairs = pairs.unionByName(_ordered_pairs(crowd_rows(full), percent))
    return pairs.filter("b IS NOT NULL").groupBy("a", "b").agg(F.max("matches").alias("matches"))


def _confirm(percent: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "set_a"):
            similarity, linked = [], []
            for x, y in zip(part.column("set_a"), part.column("set_b"), strict=True):
                x, y = _unpack(x.as_py()), _unpack(y.as_py())
                common = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - common
                similarity.append(common / union)
                linked.append(100 * common >= percent * union)
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in ("a", "b", "ca", "cb")], pa.array(similarity, pa.float64()), pa.array(linked, pa.bool_())],
                names=["a", "b", "ca", "cb", "similarity", "linked"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, hubs: bool = False) -> DataFrame:
    """``pairs`` (a, b, ca, cb), a written table, with similarity and linked, from the full sets. With ``hubs``, b is one of a few."""
    # Only sets that these pairs ask for are moved.
    needed = {c: look_up(sets, written(pairs.select(F.col(c).alias("digest")).distinct(), "needed"), ["digest"], F.col("digest"), "left_semi")
              for c in ("a", "b")}
    left = pairs.select("a", "b", "ca", "cb").join(needed["a"].select(F.col("digest").alias("a"), F.col("shingles").alias("set_a")), "a")
    right = needed["b"].select(F.col("digest").alias("b"), F.col("shingles").alias("set_b"))
    if not hubs:
        both = left.join(right, "b")
    else:
        # All pairs of a large class share its hub.
        both = salted_join(left, right, ["b"], F.col("a"))
    return written(both.mapInArrow(released(_confirm(percent)), RESULT), "confirmed")


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of some edges with the least node it is connected with by them."""
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while (up := root[x]) != x:
            root[x] = root[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            root.setdefault(a, a)
            root.setdefault(b, b)
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    nodes = list(root)
    for begin in range(0, len(nodes), 10_000):
        part = nodes[begin:begin + 10_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.binary()), pa.array([find(x) for x in part], pa.binary())], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b), a written table: the least node it is connected with.

    Parts of EDGES_PER_TASK edges are contracted to stars on their own; few
    edges make one part, and that is all. More parts are joined by two steps
    that point all neighbours of a node to the least among them, those above the
    node first, then those below, until only stars are left. Minima are combined
    before the shuffle and met in salted joins: a node with very many edges owns
    no task.
    """
    parts = -(-edges.count() // EDGES_PER_TASK)
    stars = written(edges.select("a", "b").repartition(max(parts, 1)).mapInArrow(_forest, "node binary, root binary"), "stars")
    if parts <= 1:
        return stars
    edges = written(stars.select(F.col("node").alias("u"), F.col("root").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both, least, ["u"], F.col("v")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(
            "u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, ["u"], F.col("v"))
        edges = written(
            small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
            .distinct(), "edges")
        if edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
            return written(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "stars")


def _relabelled(df: DataFrame, columns: list[str], roots: DataFrame, salt: str) -> DataFrame:
    """``df`` with the classes in ``columns`` replaced by what they have become part of."""
    for c in columns:
        df = look_up(df, roots.select(F.col("node").alias(c), F.col("root").alias("_root")), [c], F.col(salt), "left").withColumn(
            c, F.coalesce("_root", c)).drop("_root")
    return df


def classes(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, class for every digest that is linked with another. ``sets``: digest, doc_id, shingles, a row per document."""
    left = written(candidate_pairs(nodes, sets, percent).withColumns(
        {"ca": F.col("a"), "cb": F.col("b"), "tested": F.lit(False)}), "candidates")
    # Only sets that have a candidate are carried on; few such digests are sent to the sets, not the sets to them.
    ends = written(left.select("a").unionByName(left.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "digest"), "ends")
    sets = written(look_up(sets, ends, ["digest"], F.col("doc_id"), "left_semi").select("digest", "shingles").dropDuplicates(["digest"]), "sets")
    label = written(sets.select(F.col("digest").alias("node"), F.col("digest").alias("class")), "classes")
    degrees, met = None, None

    def settle(results: DataFrame) -> bool:
        """Contract the classes of linked pairs; False if nothing is new."""
        nonlocal label, left, degrees
        linked = results.filter("linked")
        ends = linked.select(F.col("a").alias("node")).unionByName(linked.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("d"))
        degrees = written((ends if degrees is None else degrees.unionByName(ends)).groupBy("node").agg(F.sum("d").alias("d")), "degrees")
        new = written(linked.filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "links")
        if new.isEmpty():
            return False
        roots = components(new)
        label = written(_relabelled(label, ["class"], roots, "node"), "classes")
        left = written(_relabelled(left, ["ca", "cb"], roots, "a").filter("ca <> cb"), "candidates")
        return True

    def by_hubs() -> None:
        """Compare sets with the hubs of the classes they stand beside, until no link is new."""
        nonlocal met
        while True:
            hubs = written(degrees.join(label, "node").groupBy("class").agg(F.max(F.struct("d", "node")).alias("m")).select(
                "class", F.col("m.node").alias("hub")), "hubs")
            sides = [
                look_up(left.withColumn("class", F.col(there)), hubs, ["class"], F.col("a")).select(
                    F.col(node).alias("a"), F.col("hub").alias("b"), F.col(here).alias("ca"), F.col(there).alias("cb"))
                for node, here, there in (("a", "ca", "cb"), ("b", "cb", "ca"))]
            again = sides[0].unionByName(sides[1]).distinct()
            if met is not None:
                again = again.join(met, ["a", "b"], "left_anti")
            again = written(again, "again")
            if again.isEmpty():
                return
            met = again.select("a", "b") if met is None else met.unionByName(again.select("a", "b"))
            if not settle(confirmed(again, sets, percent, hubs=True)):
                return

    for quota in QUOTAS:
        if quota is None:
            now = ~F.col("tested")
        else:
            # A set has a bounded number of neighbours in a bounded number of orders, so these windows are small.
            best = [F.row_number().over(Window.partitionBy(c).orderBy("tested", F.col("matches").desc(), "a", "b")) <= quota for c in ("a", "b")]
            now = ~F.col("tested") & (best[0] | best[1])
        left = written(left.withColumn("now", now), "candidates")
        chosen = left.filter("now")
        left = left.select("a", "b", "matches", "ca", "cb", (F.col("tested") | F.col("now")).alias("tested"))
        if settle(confirmed(chosen, sets, percent)):
            by_hubs()
    return label


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """doc_id, key, n_shingles, component_id, kept per row of ``docs``.

    Texts without words are linked with nothing; NULL and empty texts are such.
    ``component_id`` is the smallest id of the class, NULL ids counting for
    nothing; rows that repeat an id stand or fall together, and in a class
    without any id all rows stay. ``key`` tells (id, text) apart.
    """
    rows = aside(docs, {"doc_id": id_column, "text": text_column}).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = written(rows.withColumn("key", row_key(F.col("doc_id"), F.col("text"))).mapInArrow(released(_sketcher(shingle_words)), SETS), "signatures")
    some = rows.filter("digest IS NOT NULL")
    nodes = written(some.groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"),
        F.count("*").alias("copies")), "nodes")
    label = classes(nodes.select("digest", "n", "signature"), some.select("digest", "doc_id", "shingles"), percent)
    whole = label.withColumnRenamed("node", "digest").join(nodes.select("digest", "first_id"), "digest")
    least = whole.groupBy("class").agg(F.min("first_id").alias("least"))
    linked = salted_join(whole, least, ["class"], F.col("digest")).select("digest", "least")
    copied = nodes.filter("copies > 1").select("digest", F.col("first_id").alias("least")).join(linked, "digest", "left_anti")
    ids = written(linked.unionByName(copied), "class-ids")
    narrow = rows.select("doc_id", "key", "n_shingles", "digest")
    out = look_up(narrow, ids.withColumn("found", F.lit(True)), ["digest"], F.col("key"), "left")
    component = F.when(F.col("found"), F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "key", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def first_of_class(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_column: str = "doc_id",
                   text_column: str = "text") -> DataFrame:
    """``docs`` without the rows that another row of their class stands for."""
    gone = near_duplicates(docs, shingle_words, percent, id_column, text_column).filter("NOT kept").select("key")
    key = row_key(docs[f"`{id_column}`"].cast("long"), docs[f"`{text_column}`"])
    return docs.select(held(docs), key.alias("key")).join(gone, "key", "left_anti").select("row.*")
