"""Positions of regular-expression matches, as built-in expressions.

The text is split at the pattern and the pieces between matches are measured,
which yields exact character offsets without leaving the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesift.functions.text import col, let


# Matches whose places are added up together; places grow by copying, so a block keeps the copies short.
BLOCK = 64


def match_spans(text: Column | str, pattern: str) -> Column:
    """array<struct<start, end>> of all matches, zero-based, end exclusive.

    Sums run over blocks of matches first and inside a block second, so the work
    grows with the matches and not with their square.
    """
    text = col(text)
    gaps = F.transform(F.split(text, pattern), F.length)
    widths = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.length)
    steps = F.arrays_zip(F.slice(gaps, 1, F.size(widths)).alias("gap"), widths.alias("width"))
    spans_type = "struct<at:int,spans:array<struct<start:int,end:int>>>"
    sums_type = "struct<at:int,before:array<int>>"

    def places(block: Column, begin: Column) -> Column:
        def advance(state: Column, step: Column) -> Column:
            first = state["at"] + step["gap"]
            span = F.struct(first.alias("start"), (first + step["width"]).alias("end"))
            return F.struct((first + step["width"]).alias("at"), F.concat(state["spans"], F.array(span)).alias("spans")).cast(spans_type)

        start = F.struct(begin.alias("at"), F.array().alias("spans")).cast(spans_type)
        return F.aggregate(block, start, advance, lambda state: state["spans"])

    def total(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda n, step: n + step["gap"] + step["width"])

    def before(blocks: Column) -> Column:
        def advance(state: Column, block: Column) -> Column:
            return F.struct((state["at"] + total(block)).alias("at"), F.concat(state["before"], F.array(state["at"])).alias("before")).cast(sums_type)

        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().alias("before")).cast(sums_type), advance, lambda state: state["before"])

    def in_blocks(steps: Column) -> Column:
        starts = F.when(F.size(steps) > 0, F.sequence(F.lit(1), F.size(steps), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(steps, i, BLOCK))

    return let(let(steps, in_blocks), lambda blocks: F.flatten(F.zip_with(blocks, before(blocks), places)))


# Characters of a piece of text that is looked into by place.
PIECE = 256


def pieces(text: Column | str) -> Column:
    """The text in pieces of PIECE characters: a place is found without counting from the start."""
    return F.regexp_extract_all(col(text), F.lit(f"(?s)(.{{1,{PIECE}}})"), F.lit(1))


def between(parts: Column, begin: Column, finish: Column) -> Column:
    """Characters [begin, finish) of the text in ``parts``, zero-based."""
    first = F.floor(begin / PIECE).cast("int")
    near = F.slice(parts, first + 1, F.floor(finish / PIECE).cast("int") - first + 1)
    return F.substring(F.array_join(near, ""), begin - first * PIECE + 1, finish - begin)


def snippet(parts: Column, span: Column, context: int) -> Column:
    """The match with up to ``context`` characters on either side, from the text in ``parts``."""
    return between(parts, F.greatest(span["start"] - context, F.lit(0)), span["end"] + context)
