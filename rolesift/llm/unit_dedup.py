"""Substring dedup by line hashing: the earliest ranked copy of a unit stays, later ones go, with their offsets.

A unit is a line, and inside a line of more than a few words also each of its
segments. Segments end where the hash of two neighbouring words is the least
among RADIUS places either side, so they depend on the words around them only:
a passage spliced into another line falls into the same segments there. Units
are normalised (ASCII lower case, white space between words ignored) and
compared by 128-bit digests over their words. A unit of a few words means little
alone: a short line is compared together with the words before it, and again
with the words after it, on whatever lines they stand; a short segment with the
words of its own line, those behind it at the start of a line, else those before.

Texts are split twice. The first pass leaves digests and ranks only: per digest
the first occurrence is a minimum, combined before the shuffle. The units of the
second pass meet the digests that occur again in a join that adaptive execution
splits where one digest has very many rows; nothing is collected per digest, and
units are never written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolesift.llm.base import aside, held, row_key, slices, written

RADIUS = 5
MIN_WORDS = 6
RUN_WORDS = 16
#: Removed units that follow each other make a passage; segments of shorter passages stay.
MIN_PASSAGE = 11
UNITS = "doc_id long, key binary, line long, whole boolean, start long, end long, word long, n_words long, digest binary"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums modulo 2^64 over [begin, end)."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[ends] - total[begins]


def _unit_digests(words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """16 bytes per run of words, by word and place in the run."""
    sizes = ends - begins
    flat = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    inside = (flat - np.repeat(begins, sizes)).astype(np.uint64)
    stops = np.cumsum(sizes)
    out = np.empty((len(begins), 2), np.uint64)
    for half, seed in enumerate((np.uint64(1), np.uint64(0x5851F42D4C957F2D))):
        out[:, half] = _sums(_mix(words[flat] * (seed | np.uint64(1)) + (inside + np.uint64(1)) * GOLDEN + seed), stops - sizes, stops)
    raw = out.tobytes()
    return [raw[i:i + 16] for i in range(0, len(raw), 16)]


def split_units(texts: list[str | None], least: int) -> dict[str, np.ndarray | list]:
    """Units of some texts: text number, line, whole line or segment, code point span, words and digest.

    Lines of fewer than ``least`` words have up to two rows, with digests over
    ``least`` more words before or after them, such segments one.
    """
    joined = "\n".join(t or "" for t in texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t or "") for t in texts], dtype=np.int64)
    text_start = np.cumsum(sizes + 1) - (sizes + 1)
    blank = (cp == 32) | ((cp >= 9) & (cp <= 13))
    edges = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    begin, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    n = len(begin)
    if n == 0:
        return {"text": np.zeros(0, np.int64), "digest": []}
    line_of_char = np.cumsum(cp == 10)
    line = line_of_char[begin]
    lower = np.where((cp >= 65) & (cp <= 90), cp + 32, cp).astype(np.uint64)
    lengths = end - begin
    flat = np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    inside = (flat - np.repeat(begin, lengths)).astype(np.uint64)
    stops = np.cumsum(lengths)
    words = _mix(_sums(_mix(lower[flat] + (inside + np.uint64(1)) * GOLDEN), stops - lengths, stops))
    # Two neighbouring words of a line; the last word of a line stands alone.
    same_next = np.append(line[1:] == line[:-1], False)
    pair = _mix(words + np.where(same_next, np.append(words[1:], np.uint64(0)), np.uint64(7)) * GOLDEN)
    cut = np.ones(n, bool)
    for d in range(1, min(RADIUS, n - 1) + 1):
        together = line[d:] == line[:-d]
        cut[:-d] &= ~together | (pair[:-d] < pair[d:])
        cut[d:] &= ~together | (pair[d:] <= pair[:-d])
    # In a run of one word no place is the least: cut it at fixed lengths from its start.
    follows = np.append(False, (pair[1:] == pair[:-1]) & (line[1:] == line[:-1]))
    at = np.arange(n)
    cut |= follows & ((at - np.maximum.accumulate(np.where(follows, 0, at))) % RUN_WORDS == 0)
    first = np.append(True, line[1:] != line[:-1])
    line_begin = np.flatnonzero(first)
    line_end = np.append(line_begin[1:], n)
    seg_begin = np.flatnonzero(first | cut)
    seg_end = np.append(seg_begin[1:], n)
    whole_line = first[seg_begin] & np.append(first, True)[seg_end]
    seg_begin, seg_end = seg_begin[~whole_line], seg_end[~whole_line]
    b, e = np.concatenate((line_begin, seg_begin)), np.concatenate((line_end, seg_end))
    whole = np.arange(len(b)) < len(line_begin)
    owner = np.searchsorted(text_start, begin, side="right") - 1
    short = e - b < least
    before = np.maximum(b - least, np.searchsorted(owner, owner[b], side="left"))
    after = np.minimum(e + least, np.searchsorted(owner, owner[b], side="right"))
    rows, froms, tos, marks = [], [], [], []
    back, ahead = short & (e - before >= least), short & (after - b >= least)
    starts_line = first[b] & ~whole
    back, ahead = back & ~(starts_line & ahead), ahead & ~(~whole & ~starts_line & back)
    for chosen, lo, hi, mark in ((~short, b, e, b""), (back, before, e, b"<"), (ahead, b, after, b">")):
        rows.append(np.flatnonzero(chosen))
        froms.append(lo[chosen])
        tos.append(hi[chosen])
        marks.extend([mark] * len(rows[-1]))
    # A text of fewer words is compared as a whole, place by place.
    alone = np.flatnonzero(short & (after - before < least))
    rows.append(alone)
    froms.append(before[alone])
    tos.append(after[alone])
    marks.extend(b"=%02d" % place for place in (b - before)[alone].tolist())
    at, froms, tos = np.concatenate(rows), np.concatenate(froms), np.concatenate(tos)
    b, e, whole = b[at], e[at], whole[at]
    text = owner[b]
    return {
        "text": text, "line": line[b] - line_of_char[np.maximum(text_start[text] - 1, 0)] * (text_start[text] > 0),
        "whole": whole, "start": begin[b] - text_start[text], "end": end[e - 1] - text_start[text], "word": b, "n_words": e - b,
        "digest": [d + m for d, m in zip(_unit_digests(words, froms, tos), marks, strict=True)] if len(b) else []}


def _splitter(least: int) -> Callable:
    names = ["line", "whole", "start", "end", "word", "n_words"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = split_units(part.column("text").to_pylist(), least)
            if len(found["text"]):
                at = pa.array(found["text"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(at), part.column("key").take(at), *[pa.array(found[c]) for c in names],
                     pa.array(found["digest"], pa.binary())], names=["doc_id", "key", *names, "digest"])

    return run


def _key(doc_id: Column, text: Column) -> Column:
    """Eight bytes that tell rows of one id apart, and rows without id."""
    return F.substring(row_key(doc_id, text), 1, 8)


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS, min_passage: int = MIN_PASSAGE, id_column: str = "doc_id",
                   text_column: str = "text") -> DataFrame:
    """One row per unit to remove: doc_id, key, unit, start, end (code points), n_words, first_doc_id, first_start.

    Occurrences rank by document id, then offset; rows without id rank last, by
    a hash of their text. Rows that repeat an id and its text are one document.
    Units of fewer than ``min_words`` words are repeated if they are so with as
    many words before or after them. Segments stay that make no passage of
    ``min_passage`` words with their neighbours, and lines that make none of
    ``min_words``, but for copies of whole texts. A segment inside a line that
    goes as a whole has no row of its own. NULL and empty texts have no units.
    """
    rows = aside(docs, {"doc_id": id_column, "text": text_column}).withColumn("doc_id", F.col("doc_id").cast("long"))
    units = rows.withColumn("key", _key(F.col("doc_id"), F.col("text"))).mapInArrow(_splitter(min_words), UNITS)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.when(F.col("doc_id").isNull(), F.col("key")).alias("key"), "start")
    first = written(units.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"), "first")
    again = units.join(first, "digest").filter(rank > F.col("first"))
    unit = F.struct(
        F.when(F.col("whole"), "line").otherwise("segment").alias("unit"), "start", "end", "word", "n_words", (F.length("digest") > 17).alias("copy"),
        F.col("first.no_id").alias("no_id"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"))
    # The units of one line of one document meet here.
    lines = again.groupBy("doc_id", "key", "line").agg(
        F.sort_array(F.collect_set(unit)).alias("units"), F.max("whole").alias("whole"))
    # A unit of a few words may be found by the words on either side; the earlier place counts.
    once = F.filter("units", lambda u, i: (i == 0) | (F.get("units", i - 1)["start"] != u["start"]) | (F.get("units", i - 1)["unit"] != u["unit"]))
    lines = lines.withColumn("units", once)
    kept = F.when(F.col("whole"), F.filter("units", lambda u: u["unit"] == "line")).otherwise(F.col("units"))
    gone = lines.select("doc_id", "key", F.explode(kept).alias("u")).select("doc_id", "key", "u.*")
    # Passages inside one document: units of which each begins where the one before ends.
    document = Window.partitionBy("doc_id", "key").orderBy("word", "start")
    begins = F.coalesce(F.lag(F.col("word") + F.col("n_words")).over(document) != F.col("word"), F.lit(True))
    numbered = gone.withColumn("begins", begins.cast("int")).withColumn("passage", F.sum("begins").over(document))
    passage = Window.partitionBy("doc_id", "key", "passage")
    in_lines = F.sum(F.when(F.col("unit") == "line", F.col("n_words"))).over(passage)
    numbered = numbered.withColumns({"total": F.sum("n_words").over(passage), "in_lines": in_lines})
    return numbered.filter((F.col("total") >= min_passage) | (F.col("unit") == "line") & (F.col("copy") | (F.col("in_lines") >= min_words))).select(
        "doc_id", "key", "unit", "start", "end", "n_words", "first_doc_id", "first_start")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, min_passage: int = MIN_PASSAGE, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """``docs`` with the units cut out of the text; a line that goes takes its line end along."""
    cuts = repeated_units(docs, min_words, min_passage, id_column, text_column).groupBy("doc_id", "key").agg(
        F.sort_array(F.collect_set(F.struct("start", "end", "unit"))).alias("cuts")).select(
        F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "key").alias("key"), "cuts")
    doc_id = docs[f"`{id_column}`"].cast("long")
    key = F.struct(F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("none"), _key(doc_id, docs[f"`{text_column}`"]).alias("key"))

    def cut_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                at, parts = 0, []
                for c in cuts or []:
                    start, end = c["start"], c["end"]
                    if c["unit"] == "line":
                        # White space around the words and the end of the line belong to it.
                        start = text.rfind("\n", 0, start) + 1
                        end = len(text) if (stop := text.find("\n", end)) < 0 else stop + 1
                    parts.append(text[at:start])
                    at = max(at, end)
                texts.append(text if not cuts else "".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    joined = docs.select(held(docs), docs[f"`{text_column}`"].alias("text"), key.alias("key")).join(cuts, "key", "left")
    schema = joined.select("row", "text").schema
    out = joined.select("row", "text", "cuts").mapInArrow(cut_out, schema)
    return out.select(*[(F.col("text") if c == text_column else F.col("row")[c]).alias(c) for c in docs.columns])
