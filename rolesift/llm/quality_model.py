"""Quality classifier: hashed word and character n-gram vectors, averaged per document, with a softmax on top.

Features are character n-grams inside words (white space counts as the mark of
a word's end), words, pairs of words, and words that come again within a few
words: such a pair is named by its distance, whatever the word. Each is hashed
to one of BUCKETS vectors. A document is the mean of its features' vectors; a
softmax over two classes gives the score. Vectors and softmax are learned
together by stochastic gradient descent in numpy.

Training uses a bounded sample of labelled documents, the same on every run.
Its sparse counts come from Spark tasks; a document has at most BUCKETS of them,
so the driver holds no more than ``per_class`` x 2 x BUCKETS counts of 8 bytes.
A softmax on a mean is linear in the features: scoring adds one number per
feature, for every whole text, in the tasks that read them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.llm.base import aside, slices

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
CHARACTER_GRAMS = (3, 4)
REPEAT_WITHIN = 4
#: Longer texts are read in pieces of so many characters, cut at white space; n-grams do not cross a cut.
PIECE = 1_000_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
THRESHOLD = 0.7


@dataclass(frozen=True)
class Training:
    """``per_class``: the most documents of a label that are learned from."""

    per_class: int = 1_000
    size: int = 16
    epochs: int = 8
    rate: float = 4.0
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """One weight per feature bucket, and the score's offset."""

    weights: np.ndarray
    offset: float


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (((hashes + np.uint64(kind)) * GOLDEN) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def pieces(text: str | None, size: int = PIECE) -> list[str]:
    """``text`` in runs of at most ``size`` characters, cut behind white space where there is some."""
    text, out, at = text or "", [], 0
    while len(text) - at > size:
        stop = max(text.rfind(c, at, at + size) for c in " \n\t")
        stop = stop + 1 if stop > at else at + size
        out.append(text[at:stop])
        at = stop
    return [*out, text[at:]]


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text number and bucket of every feature of some texts, one kind of feature at a time."""
    joined = "\n" + "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    blank = (cp == 32) | ((cp >= 9) & (cp <= 13))
    # The first and last characters are line ends; character i + 1 belongs to text owner[i].
    marked = _mix(np.where(blank, np.uint32(32), cp).astype(np.uint64) * GOLDEN)
    for size in CHARACTER_GRAMS:
        n = len(cp) - size + 1
        if n <= 0:
            continue
        inner = ~blank[1:n + 1]
        for i in range(2, size - 1):
            inner &= ~blank[i:n + i]
        at = np.flatnonzero(inner)
        total = np.zeros(len(at), np.uint64)
        for i in range(size):
            total = total * np.uint64(31) + marked[at + i]
        yield owner[at], _bucket(_mix(total), size)
    edges = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    begin, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    if not len(begin):
        return
    lengths = end - begin
    flat = np.flatnonzero(~blank)
    inside = (flat - np.repeat(begin, lengths)).astype(np.uint64)
    words = _mix(np.add.reduceat(_mix(marked[flat] + (inside + np.uint64(1)) * GOLDEN), np.cumsum(lengths) - lengths))
    of = owner[begin - 1]
    yield of, _bucket(words, 1)
    for apart in range(1, min(REPEAT_WITHIN, len(words) - 1) + 1):
        together = of[apart:] == of[:-apart]
        same = together & (words[apart:] == words[:-apart])
        yield of[:-apart][same], _bucket(np.full(int(same.sum()), 100 + apart, np.uint64), 2)
        if apart == 1:
            other = together & ~same
            yield of[:-1][other], _bucket(_mix(words[:-1][other] * np.uint64(3) + words[1:][other]), 2)


def document_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text, ascending, and how many features fall on each."""
    total = np.zeros(BUCKETS, np.int64)
    for piece in pieces(text):
        for _, bucket in features([piece]):
            total += np.bincount(bucket, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at].astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, settings: Training, log_odds: float) -> Model:
    """Vectors and softmax from (buckets, counts) and 0/1 labels; ``log_odds`` of label 1, for a sample with one label only."""
    rng = np.random.default_rng(settings.seed)
    ones = int(labels.sum())
    if not len(labels) or ones in (0, len(labels)):
        return Model(np.zeros(BUCKETS, np.float32), log_odds)
    vectors = rng.uniform(-1 / settings.size, 1 / settings.size, (BUCKETS, settings.size)).astype(np.float32)
    softmax = np.zeros((settings.size, 2), np.float32)
    offset = np.zeros(2, np.float32)
    shares = [counts / max(counts.sum(), 1) for _, counts in rows]
    # Both labels weigh alike while learning, however many documents the sample has of each.
    weight = np.where(labels == 1, len(labels) / (2 * ones), len(labels) / (2 * (len(labels) - ones)))
    steps, done = settings.epochs * len(rows), 0
    for _ in range(settings.epochs):
        for i in rng.permutation(len(rows)):
            rate = settings.rate * (1 - done / steps) * weight[i]
            done += 1
            at, share = rows[i][0], shares[i]
            mean = share @ vectors[at]
            scores = mean @ softmax + offset
            scores = np.exp(scores - scores.max())
            error = scores / scores.sum()
            error[labels[i]] -= 1
            pull = softmax @ error
            softmax -= rate * np.outer(mean, error)
            offset -= 0.1 * rate * error
            vectors[at] -= np.outer(rate * share, pull)
    direction = softmax[:, 1] - softmax[:, 0]
    return Model((vectors @ direction).astype(np.float32), float(offset[1] - offset[0]))


def score_texts(texts: list[str | None], model: Model) -> np.ndarray:
    """Scores of whole texts; a text without features gets the offset's score."""
    parts, of = [], []
    for number, text in enumerate(texts):
        for piece in pieces(text):
            parts.append(piece)
            of.append(number)
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    runs, size = [[]], 0
    for i, piece in enumerate(parts):
        if size and size + len(piece) > PIECE:
            runs.append([])
            size = 0
        runs[-1].append(i)
        size += len(piece) + 1
    for run in runs:
        if not run:
            continue
        numbers = np.array([of[i] for i in run])
        for owner, bucket in features([parts[i] for i in run]):
            at = numbers[owner]
            total += np.bincount(at, weights=model.weights[bucket], minlength=len(texts))
            count += np.bincount(at, minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + model.offset, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """One id in four is never learned from; NULL ids have no labels and are not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, settings: Training) -> DataFrame:
    """doc_id, quality, bucket list and counts of the sample: the first ids of each label in hash order."""
    order = [F.xxhash64(F.col("doc_id"), F.lit(settings.seed)), F.col("doc_id")]
    some = [labels.filter(F.col("quality") == c).orderBy(*order).limit(settings.per_class) for c in (0, 1)]
    sample = some[0].unionByName(some[1])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            for i, text in enumerate(part.column("text").to_pylist()):
                at, counts = document_counts(text)
                one = part.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [one.column("doc_id"), one.column("quality"), pa.array([at.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())],
                    names=["doc_id", "quality", "buckets", "counts"])

    # The sample has at most 2 x per_class ids; rows that repeat an id count once.
    found = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    return found.mapInArrow(run, "doc_id long, quality int, buckets binary, counts binary")


def fit(docs: DataFrame, labels: DataFrame, settings: Training = Training()) -> Model:
    """A model from the labelled rows that are not held out. ``docs``: doc_id, text; ``labels``: doc_id, quality.

    Of labels that repeat an id the larger counts; NULL ids and labels other
    than 0 and 1 are left out. With one label only, or none, every text gets
    that label's smoothed share.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(
        "doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    totals = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    found = training_rows(docs, known, settings).toArrow().sort_by("doc_id")
    rows = [(np.frombuffer(b, np.int32), np.frombuffer(c, np.float32))
            for b, c in zip(found.column("buckets").to_pylist(), found.column("counts").to_pylist(), strict=True)]
    log_odds = math.log((totals.get(1, 0) + 1) / (totals.get(0, 0) + 1))
    return train(rows, found.column("quality").to_numpy().astype(np.int64), settings, log_odds)


def _scorer(model: Model) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(score_texts(part.column("text").to_pylist(), model), pa.float64())], names=["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, settings: Training = Training(), id_column: str = "doc_id",
                   text_column: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``.

    Only texts are inputs of a score: equal texts have equal scores. NULL and
    empty texts, and texts of white space, get the score without any feature.
    Rows that repeat an id give a row each; a NULL id is not held out. An empty
    table gives no rows. Other columns are not read.
    """
    rows = aside(docs, {"doc_id": id_column, "text": text_column}).withColumn("doc_id", F.col("doc_id").cast("long"))
    model = fit(rows, labels, settings)
    out = rows.mapInArrow(_scorer(model), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
