"""Packing token sequences: non-negative least squares over shallow length combinations.

A document of n tokens is cut by its own length alone: whole windows first, then
the rest at its largest multiple of ``unit`` (the body), and what is left (the
tail, shorter than a unit). So one pass gives every piece with its checksum,
and packing only deals with lengths, of which there are fewer than
``window / unit + unit``, however many documents there are.

The bodies are packed by combinations: all ways to fill a window with at most
``depth`` bodies are enumerated, their repeat counts solved by non-negative
least squares against the histogram of bodies, and rounded within what is
there. The residual bodies and all tails are packed greedily, longest first. A
plan is a short list of slots; pieces find theirs by their rank among the
pieces of their length, counted per bucket and inside buckets, so no length is
ever brought together.
"""

from __future__ import annotations

import os
import re
import sys
import types
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolesift.llm.base import aside, released, slices, written
from rolesift.operators.joins import look_up

END_ID = 2
WINDOW, UNIT, DEPTH = 4096, 64, 3
BUCKET_ROWS = 20_000
#: Parts of words a process remembers: some 16 MB.
CACHED_PARTS = 80_000
SLICE = 2_000_000
#: Words of every kind; a tokenizer that does not split them like WordEncoder encodes whole texts itself.
PROBE = "The cat's 2,048 caf\u00e9s; na\u00efve x86-64 CPU <|x|> \u00df \u65e5\u672c a_b... (ok) 3rd\n\tEND! end#tag"


def byte_letters() -> list[str]:
    """The printable stand-in of every byte in a byte-level vocabulary: printable Latin-1 stands for itself."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Token ids of texts by way of their distinct words.

    The vocabulary drops white space and never joins across it, and it splits a
    word at the borders of letters, digits and signs. Words of plain lower-case
    Latin letters, digits and signs are split here and their parts encoded by
    the model once each; every other word goes through the whole tokenizer.
    """

    # Parts of a word that no normalisation changes: lower-case letters, one digit, signs but the apostrophe.
    PART = re.compile(r"[a-z\u00e0-\u00f6\u00f8-\u00ff]+|[0-9]|[!-&(-/:-@\[-`{-~]+")

    def __init__(self, path: str | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.known: dict[str, bytes] = {}
        self.by_words = True
        want = self.tokenizer.encode(PROBE, add_special_tokens=False).ids
        self.by_words = self.encode(pa.array([PROBE]))[0].tolist() == want and self.encode(pa.array([PROBE.lower()]))[0].tolist() == (
            self.tokenizer.encode(PROBE.lower(), add_special_tokens=False).ids)

    @staticmethod
    def of_process(path: str | None) -> WordEncoder:
        """The encoder of this Python process, which runs many tasks: what one has learnt serves the next."""
        store = sys.modules.setdefault("rolesift_encoders", types.ModuleType("rolesift_encoders")).__dict__
        name = f"encoder of {path}"
        if name not in store:
            store[name] = WordEncoder(path)
        return store[name]

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
        ids = np.array([t.id for t in self.model.tokenize(shown)], dtype="<u4").tobytes()
        if len(self.known) >= CACHED_PARTS:
            self.known.clear()
        self.known[part] = ids
        return ids

    def _words(self, words: list[str], marked: bool) -> list[bytes]:
        out: list[bytes] = []
        other: list[int] = []
        known, split = self.known, self.PART.findall
        for number, word in enumerate(words):
            ids = known.get(word)
            if ids is None or marked:
                parts = split(word)
                if sum(map(len, parts)) != len(word) or (marked and "<|" in word):
                    other.append(number)
                    ids = b""
                else:
                    ids = b"".join([known.get(p) or self._part(p) for p in parts])
            out.append(ids)
        if other:
            found = self.tokenizer.encode_batch([words[i] for i in other], add_special_tokens=False)
            for i, encoding in zip(other, found, strict=True):
                out[i] = np.array(encoding.ids, dtype="<u4").tobytes()
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has; NULL has none."""
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            ids = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, "<u4"), *ids]), np.array([len(i) for i in ids], np.int64)
        # Names of special tokens are lower case: a text that has some keeps its case.
        marked = pc.any(pc.match_substring(texts, "<|")).as_py() or False
        lists = pc.ascii_split_whitespace(texts if marked else pc.ascii_lower(texts))
        counts = pc.list_value_length(lists).to_numpy()
        flat = lists.flatten().dictionary_encode()
        if not len(flat):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        ids = self._words(flat.dictionary.to_pylist(), marked)
        codes = flat.indices.to_numpy()
        sizes = np.array([len(i) for i in ids], dtype=np.int64) // 4
        table = np.frombuffer(b"".join(ids), dtype="<u4")
        starts = np.cumsum(sizes) - sizes
        lengths = sizes[codes]
        ends = np.cumsum(lengths)
        out = table[np.repeat(starts[codes] - (ends - lengths), lengths) + np.arange(int(ends[-1]))]
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return out, np.diff(bounds)


def cuts(n: int, window: int, unit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    whole, rest = divmod(n, window)
    body = rest - rest % unit
    pieces = [(i * window, window) for i in range(whole)]
    pieces += [(whole * window, body)] if body else []
    return pieces + ([(n - rest % unit, rest % unit)] if rest % unit else [])


def _cutter(path: str | None, window: int, unit: int, with_ids: bool, schema: pa.Schema) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of_process(path)
        for part in slices(batches, "text", SLICE):
            flat, counts = encoder.encode(part.column("text"))
            rows, at = [], 0
            for doc_id, count in zip(part.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                ids = np.append(flat[at:at + count], np.uint32(END_ID)).astype("<u4")
                at += count
                for start, length in cuts(len(ids), window, unit):
                    piece = ids[start:start + length]
                    rows.append((doc_id, start, length, zlib.crc32(piece.tobytes()), len(ids), piece if with_ids else None))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=False)], schema=schema)

    return run


def cut_documents(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, unit: int = UNIT,
                  with_ids: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, its ids.

    A NULL or empty text is the end id alone. Repeated rows are documents of their own.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    arrow = pa.schema([(n, pa.int64()) for n in names] + ([("ids", pa.list_(pa.int32()))] if with_ids else []))
    spark_schema = ", ".join(f"{n} long" for n in names) + (", ids array<int>" if with_ids else "")
    rows = aside(docs, {"doc_id": id_column, "text": text_column}).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(released(_cutter(tokenizer_path, window, unit, with_ids, arrow)), spark_schema)


def combinations(total: int, depth: int, largest: int) -> Iterator[tuple[int, ...]]:
    """Descending parts of at most ``largest`` that add up to ``total``, at most ``depth`` of them."""
    if total == 0:
        yield ()
    elif depth:
        for part in range(min(total, largest), 0, -1):
            for rest in combinations(total - part, depth - 1, part):
                yield (part, *rest)


def solve_nonnegative(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with least |a x - b|, by an active set."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(3 * a.shape[1]):
        slope = np.where(active, -np.inf, a.T @ (b - a @ x))
        if slope.max(initial=-np.inf) <= tolerance:
            break
        active[int(slope.argmax())] = True
        while True:
            trial = np.zeros_like(x)
            trial[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            below = active & (trial <= 0)
            if not below.any():
                break
            step = (x[below] / np.maximum(x[below] - trial[below], 1e-300)).min()
            x = x + step * (trial - x)
            active &= x > 1e-12
            x[~active] = 0
        x = trial
    return x


def plan_slots(histogram: dict[int, int], window: int, unit: int, depth: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset, pieces per sequence): where each rank of a length goes."""
    left = {length: count for length, count in histogram.items() if count > 0}
    patterns: list[tuple[dict[int, int], int]] = []
    if left.get(window):
        patterns.append(({window: 1}, left.pop(window)))
    bodies = sorted(length for length in left if length >= unit)
    place = {length: i for i, length in enumerate(bodies)}
    fills = []
    for parts in combinations(window // unit, depth, window // unit - 1):
        lengths = [p * unit for p in parts]
        if all(length in place for length in lengths):
            fills.append({length: lengths.count(length) for length in lengths})
    if fills:
        matrix = np.zeros((len(bodies), len(fills)))
        for j, fill in enumerate(fills):
            for length, times in fill.items():
                matrix[place[length], j] = times
        repeats = solve_nonnegative(matrix, np.array([left[x] for x in bodies], dtype=float))
        for j in np.argsort(-repeats, kind="stable"):
            times = min([round(float(repeats[j])), *(left[x] // m for x, m in fills[j].items())])
            if times > 0:
                patterns.append((fills[j], times))
                for length, m in fills[j].items():
                    left[length] -= times * m
    while any(left.values()):
        gap, fill = window, {}
        for length in sorted(left, reverse=True):
            if take := min(left[length], gap // length):
                fill[length] = take
                gap -= take * length
        times = min(left[x] // m for x, m in fill.items())
        patterns.append((fill, times))
        for length, m in fill.items():
            left[length] -= times * m
    slots, used, sequence = [], dict.fromkeys(histogram, 0), 0
    for fill, times in patterns:
        offset = 0
        for length, m in fill.items():
            slots.append((length, used[length], used[length] + times * m, sequence, offset, m))
            used[length] += times * m
            offset += m * length
        sequence += times
    return slots


def place(pieces: DataFrame, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> DataFrame:
    """A written table of pieces with sequence_id and offset: every piece in one sequence, without gaps.

    An empty table gives an empty result.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = pieces.sparkSession.createDataFrame(
        plan_slots(histogram, window, unit, depth),
        "length long, low long, high long, first long, base long, times long")
    buckets = max(1, sum(histogram.values()) // BUCKET_ROWS)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = look_up(
        dealt.withColumn("inside", F.row_number().over(inside) - 1), written(counts, "pack-counts"), ["length", "bucket"],
        F.col("doc_id")).withColumn("rank", F.col("ahead") + F.col("inside"))
    # Fewer slots than 3 x (window / unit + unit) ** 2, whatever the data: safe to send to every executor.
    at = F.col("rank") - F.col("low")
    return ranked.join(F.broadcast(slots), "length").filter("rank >= low AND rank < high").select(
        *pieces.columns, (F.col("first") + F.floor(at / F.col("times"))).alias("sequence_id"),
        (F.col("base") + at % F.col("times") * F.col("length")).alias("offset"))


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH,
         with_ids: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece of every document with its sequence and offset; see ``cut_documents`` for odd rows."""
    pieces = cut_documents(docs, tokenizer_path, window, unit, with_ids, id_column, text_column)
    return place(written(pieces, "pieces"), window, unit, depth)
