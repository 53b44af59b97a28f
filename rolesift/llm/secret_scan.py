"""Secret scans: Aho-Corasick keyword prefilter, anchored expressions at the hits, checksum validation.

One automaton pass over the ASCII-lowered text finds the keywords. Only at a
hit is an expression tried, anchored there, so a text without keywords costs
one linear pass. Long hexadecimal runs have no keyword: every 32nd character of
such a run must be a hexadecimal digit, so only those places are looked at.
Tokens of the kinds in CHECKED carry a checksum in their last six characters
and count only if it is right.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.llm.base import aside, slices

# The forms of the three base kinds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_KEYWORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ACCESS = r"AKIA[A-Z0-9]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
# Public token forms whose last six characters are the CRC-32 of the thirty before, in base 62.
CHECKED = {"github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], "npm": ["npm_"]}
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ["assign", "access", "hex", *CHECKED]

SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"


def checksum62(body: str) -> str:
    value, out = zlib.crc32(body.encode("ascii")), ""
    while value:
        value, digit = divmod(value, 62)
        out = DIGITS62[digit] + out
    return out.rjust(6, "0")


def make_scanner() -> Callable[[str | None], list[tuple[str, int, int]]]:
    """A function from a text to its (kind, start, end), ordered by start and kind; code points, end exclusive."""
    automaton = ahocorasick.Automaton()
    for word in ASSIGN_KEYWORDS:
        automaton.add_word(word, ("assign", len(word)))
    automaton.add_word("akia", ("access", 4))
    for kind, prefixes in CHECKED.items():
        for prefix in prefixes:
            automaton.add_word(prefix, (kind, len(prefix)))
    automaton.make_automaton()
    assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
    access = re.compile(ACCESS)
    checked = re.compile(r"[a-z]{3}_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
    hexadecimal = re.compile(r"[0-9a-f]+")
    candidate = re.compile(r"[0-9a-f]")
    letters = set("0123456789abcdef")
    order = {kind: i for i, kind in enumerate(KINDS)}

    def tried(kind: str, text: str, at: int) -> tuple[int, bool] | None:
        """End of the match at this place and whether it counts; None without a match."""
        if kind == "assign":
            match = assign.match(text, at)
            return match and (match.end(), len(match[2]) >= ASSIGN_LEAST)
        if kind == "access":
            match = access.match(text, at)
            return match and (match.end(), match.end() - at >= ACCESS_LEAST)
        match = checked.match(text, at)
        return match and (match.end(), checksum62(match[1]) == match[2])

    def scan(text: str | None) -> list[tuple[str, int, int]]:
        if not text:
            return []
        lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        hits = sorted((end + 1 - size, kind) for end, (kind, size) in automaton.iter(lowered))
        found, free = [], {}
        for at, kind in hits:
            # A match takes its text, whether it counts or not: the next one of its kind begins behind it.
            if at >= free.get(kind, 0) and (match := tried(kind, text, at)):
                free[kind] = match[0]
                if match[1]:
                    found.append((kind, at, match[0]))
        if candidate.search(text[HEX_LEAST - 1::HEX_LEAST]):
            sample = text[HEX_LEAST - 1::HEX_LEAST]
            end = 0
            for number, letter in enumerate(sample):
                at = HEX_LEAST * (number + 1) - 1
                if letter in letters and at >= end:
                    start = at
                    while start > end and text[start - 1] in letters and at - start < HEX_LEAST:
                        start -= 1
                    end = hexadecimal.match(text, at).end()
                    if end - start >= HEX_LEAST:
                        found.append(("hex", start, end))
        found.sort(key=lambda x: (x[1], order[x[0]], x[2]))
        return found

    return scan


def scan_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scan = make_scanner()
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for part in slices(batches, "text"):
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t)] for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, type=spans)], names=["doc_id", "spans"])


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs`` with the spans found in its whole text.

    NULL and empty texts have none. Rows are scanned alone: repeated rows and
    NULL ids give a row each, other columns are not read.
    """
    rows = aside(docs, {"doc_id": id_column, "text": text_column}).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(scan_rows, SCHEMA)


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as one text."""
    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def brute_force(text: str | None) -> str:
    """The base digest by plain expressions, for tests."""
    text, found = text or "", []
    for order, (kind, pattern, least) in enumerate((
            ("assign", re.compile(ASSIGN, re.IGNORECASE | re.ASCII), lambda m: len(m[2]) >= ASSIGN_LEAST),
            ("access", re.compile(ACCESS), lambda m: len(m[0]) >= ACCESS_LEAST),
            ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= HEX_LEAST))):
        found += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text) if least(m)]
    return hashlib.sha256(",".join(x[2] for x in sorted(found)).encode()).hexdigest()
