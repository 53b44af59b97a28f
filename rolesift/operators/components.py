"""Components of rows that share keys, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.operators.joins import salted_join
from rolesift.session import cut_lineage


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, root) of (label, other) edges, the smallest label of a component being its root."""
    parent: dict[int, int] = {}

    def find(label: int) -> int:
        root = label
        while (above := parent.setdefault(root, root)) != root:
            root = above
        while parent[label] != root:
            parent[label], label = root, parent[label]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    labels = list(parent)
    yield pa.RecordBatch.from_arrays(
        [pa.array(labels, pa.int64()), pa.array([find(label) for label in labels], pa.int64())], ["label", "root"])


def _jump(parents: DataFrame) -> DataFrame:
    """(label, root) of a forest (label, root) whose roots have no row, by doubling every path until none grows."""
    while True:
        above = parents.select(F.col("label").alias("root"), F.col("root").alias("above"))
        longer = cut_lineage(salted_join(parents, above, ["root"], F.col("label"), "left"))
        if longer.filter(F.col("above").isNotNull()).isEmpty():
            return parents
        parents = longer.select("label", F.coalesce("above", "root").alias("root"))


def _relabel(rows: DataFrame, roots: DataFrame, salt: str) -> DataFrame:
    """``rows`` with their ``label`` replaced by its root, where it has one."""
    return salted_join(rows, roots, ["label"], F.col(salt), "left").withColumn("label", F.coalesce("root", "label")).drop("root")


def with_components(rows: DataFrame, at_once: int) -> DataFrame:
    """Key rows ``(ordinal, key)`` with the ``component`` they belong to.

    Labels are hashes of the ordinals; two ordinals of one hash would merge two
    components, which the first-come rule allows. A step links every label of a
    key with the smallest one there, so links grow with the rows and not with
    pairs. Up to ``at_once`` links are contracted in one task. Of more, every
    label hooks onto the smallest it meets, paths are halved by jumps, and what
    remains is linked again; as labels are random, paths are short and a step
    leaves less than half of the labels that had a link.
    """
    labels = rows.select("ordinal").distinct().withColumn("label", F.xxhash64("ordinal"))
    places = rows.select("key", F.xxhash64("ordinal").alias("label")).distinct()
    while True:
        least = places.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most").select("key", "least")
        met = cut_lineage(salted_join(places, least, ["key"], F.col("label")))
        links = cut_lineage(met.filter("label > least").select("label", "least").distinct())
        if links.count() <= at_once:
            break
        roots = _jump(cut_lineage(links.groupBy("label").agg(F.min("least").alias("root"))))
        labels = cut_lineage(_relabel(labels, roots, "ordinal"))
        places = cut_lineage(_relabel(met.select("key", "label"), roots, "key").distinct())
    roots = cut_lineage(links.repartition(1).mapInArrow(_roots, "label long, root long"))
    component = _relabel(labels, roots, "ordinal").withColumnRenamed("label", "component")
    return rows.join(component, "ordinal")
