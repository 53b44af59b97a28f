"""Quality rules on repetition: word suffix arrays, LCP intervals, covered share and longest repeat.

A text is the sequence of its words. Its suffix array comes from prefix
doubling in which only tied suffixes are sorted again; the ranks of every
doubling step are kept, so the longest common prefix of neighbouring suffixes
is read off by binary descent. The larger of the two LCP values beside a suffix
is the longest passage starting there that occurs elsewhere in the text. Those
that cannot be extended to the left are the maximal repeats; the union of their
spans is the covered part. Many texts share one array: words carry their text's
number, so no repeat crosses two texts.

Memory of a task: about 4 bytes x words x (2 + log2 of the longest repeat) of
one slice, which is 1.5 MB of text or one longer text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.llm.base import aside, released, slices

SYMBOLS = b"#*$%&|<>"
ASCII_BLANKS = b" \t\n\x0b\f\r"
BASE_WINDOW = 3


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict. ``min_words``: shortest repeat that counts."""

    min_words: int = 10
    max_covered_percent: int = 40
    max_longest: int = 60
    least_words: int = 50
    max_repeat_percent: int = 50


MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_covered long, longest_repeat long, spans array<struct<start:long,end:long>>"
)


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of non-negative integers, and the ranks by the first 1, 2, 4, ... symbols."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    first = np.ones(n, dtype=bool)
    first[1:] = symbols[order[1:]] != symbols[order[:-1]]
    heads = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    ranks = np.empty(n, dtype=np.int64)
    ranks[order] = heads
    levels, width = [ranks.astype(np.int32)], 1
    while True:
        last = np.append(first[1:], True)
        tied = np.flatnonzero(~(first & last))
        if not len(tied):
            return order, levels
        suffix = order[tied]
        after = suffix + width
        key = ranks[suffix] * (n + 1) + np.where(after < n, ranks[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        key, suffix = key[by], suffix[by]
        order[tied] = suffix
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        first[tied] = new
        ranks = ranks.copy()
        ranks[suffix] = np.maximum.accumulate(np.where(new, tied, 0))
        levels.append(ranks.astype(np.int32))
        width *= 2


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest passage from there that occurs at another position."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    order, levels = suffix_array(symbols)
    left, right = order[:-1], order[1:]
    lcp = np.zeros(max(n - 1, 0), dtype=np.int64)
    # Only neighbours that share their first symbol have anything in common.
    live = np.flatnonzero(levels[0][left] == levels[0][right])
    a, b, common = left[live], right[live], np.zeros(len(live), dtype=np.int64)
    for step in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < n) & (y < n)
        equal = inside & (levels[step][np.minimum(x, n - 1)] == levels[step][np.minimum(y, n - 1)])
        common += np.where(equal, 1 << step, 0)
    lcp[live] = common
    best = np.zeros(n, dtype=np.int64)
    best[order] = np.maximum(np.append(lcp, 0), np.append(0, lcp))
    return best


def maximal_repeats(best: np.ndarray, least: int) -> np.ndarray:
    """Starts of repeats of at least ``least`` symbols that are no tail of a repeat one to the left."""
    extended = np.zeros(len(best), dtype=bool)
    extended[1:] = best[:-1] == best[1:] + 1
    return np.flatnonzero((best >= least) & ~extended)


def covered(best: np.ndarray, least: int) -> np.ndarray:
    """True where a maximal repeat of at least ``least`` symbols lies."""
    n = len(best)
    starts = maximal_repeats(best, least)
    ends = starts + best[starts]
    edges = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(edges[:n]) > 0


def _spans(text: bytes, words: list[bytes], inside: np.ndarray) -> list[dict[str, int]]:
    """Code point spans of the runs of covered words."""
    flags = np.concatenate(([False], inside, [False]))
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    wanted, spans, at, chars, number = set(edges.tolist()) | {int(e) - 1 for e in edges[1::2]}, [], 0, 0, 0
    places: dict[int, tuple[int, int]] = {}
    for number, word in enumerate(words):
        begin = text.index(word, at)
        chars += begin - at
        size = len(word.decode("utf-8", "replace"))
        if number in wanted:
            places[number] = (chars, chars + size)
        chars += size
        at = begin + len(word)
    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        spans.append({"start": places[begin][0], "end": places[end - 1][1]})
    return spans


def measure_texts(texts: list[str | None], least: int, with_spans: bool) -> dict[str, list]:
    """All measures of some texts, from one suffix array over their words."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    words = [r.split() for r in raw]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    flat = [w for ws in words for w in ws]
    owner = np.repeat(np.arange(len(texts)), counts)
    if flat:
        held = np.empty(len(flat), dtype=object)
        held[:] = flat
        codes = pd.factorize(held)[0].astype(np.int64)
        symbols = owner * (int(codes.max()) + 1) + codes
    else:
        symbols = np.zeros(0, dtype=np.int64)
    best = longest_repeats(symbols)
    inside = covered(best, least)
    total = len(texts)
    longest = np.zeros(total, dtype=np.int64)
    np.maximum.at(longest, owner, best)
    blanks = [len(r) - len(r.translate(None, ASCII_BLANKS)) for r in raw]
    bounds = np.concatenate(([0], np.cumsum(counts)))
    lines = [[x for x in (t or "").split("\n") if x.strip(" \t\x0b\f\r")] for t in texts]
    n_covered = np.bincount(owner, weights=inside, minlength=total).astype(np.int64)
    return {
        "n_words": counts.tolist(),
        "word_chars": [len(t or "") - b for t, b in zip(texts, blanks, strict=True)],
        "n_symbols": [len(r) - len(r.translate(None, SYMBOLS)) for r in raw],
        "n_dup_lines": [len(x) - len(set(x)) for x in lines],
        "n_repeat_words": np.bincount(owner, weights=covered(best, BASE_WINDOW), minlength=total).astype(np.int64).tolist(),
        "n_covered": n_covered.tolist(),
        "longest_repeat": longest.tolist(),
        "spans": [
            _spans(raw[i], words[i], inside[bounds[i]:bounds[i + 1]]) if with_spans and n_covered[i] else []
            for i in range(total)],
    }


def _measurer(least: int, with_spans: bool, schema: pa.Schema) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = measure_texts(part.column("text").to_pylist(), least, with_spans)
            arrays = [part.column("doc_id"), *[pa.array(found[f.name], type=f.type) for f in list(schema)[1:]]]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def _arrow_schema() -> pa.Schema:
    long = pa.int64()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]
    spans = pa.list_(pa.struct([("start", long), ("end", long)]))
    return pa.schema([("doc_id", long), *[(n, long) for n in names], ("spans", spans)])


def measure(docs: DataFrame, rules: Rules = Rules(), id_column: str = "doc_id", text_column: str = "text",
            with_spans: bool = True) -> DataFrame:
    """One row per row of ``docs``: its measures, base verdict and verdict.

    A NULL or empty text has no words and fails the base rule. Every row is
    judged alone, so repeated rows and NULL ids give a row each. Other columns
    of ``docs`` are not read. ``spans`` are the covered passages as code points.
    """
    rows = aside(docs, {"doc_id": id_column, "text": text_column}).withColumn("doc_id", F.col("doc_id").cast("long"))
    out = rows.mapInArrow(released(_measurer(rules.min_words, with_spans, _arrow_schema())), f"doc_id long, {MEASURES}")
    return out.withColumn("base_failed", base_failed(rules)).withColumn("kept", ~F.col("base_failed") & acceptable(rules))


def base_failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.least_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def acceptable(rules: Rules) -> Column:
    """The method's verdict: covered share and longest repeat within their limits."""
    return (100 * F.col("n_covered") <= rules.max_covered_percent * F.col("n_words")) & (
        F.col("longest_repeat") <= rules.max_longest)


def keep_acceptable(docs: DataFrame, rules: Rules = Rules(), text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that the verdict keeps, with all their columns, unchanged.

    Only texts go through Python; what comes back is a flag.
    """
    @F.arrow_udf("boolean")
    def fine(texts: pa.Array) -> pa.Array:
        flags = [np.zeros(0, bool)]
        for part in slices([pa.RecordBatch.from_arrays([texts], names=["text"])], "text"):
            found = {k: np.array(v) for k, v in measure_texts(part.column("text").to_pylist(), rules.min_words, False).items() if k != "spans"}
            n = found["n_words"]
            failed = (n < rules.least_words) | (100 * found["n_repeat_words"] > rules.max_repeat_percent * n)
            flags.append(~failed & (100 * found["n_covered"] <= rules.max_covered_percent * n) & (found["longest_repeat"] <= rules.max_longest))
        return pa.array(np.concatenate(flags))

    return docs.filter(fine(docs[f"`{text_column}`"]))
