"""Mechanical text defects: white-space clean-up and detectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesift import rules
from rolesift.functions.pyformat import quoted
from rolesift.functions.spans import between, match_spans, pieces, snippet
from rolesift.functions.text import col, let, or_empty, strip, text_array


def normalize_whitespace(value: Column | str) -> Column:
    """Fold blanks and blank lines and cut trailing white space; never inserts."""
    text = F.regexp_replace(or_empty(value), r"[ \t]{2,}", " ")
    text = F.regexp_replace(text, r"\n{3,}", F.lit("\n\n"))
    lines = F.transform(F.split(text, "\n"), lambda line: F.rtrim(line, F.lit(rules.STRIP_CHARS)))
    return strip(F.array_join(lines, "\n"))


def mask_safe_spans(value: Column | str) -> Column:
    """URLs and e-mail addresses become '#' runs of the same length."""
    value = col(value)
    masks = F.transform(
        F.regexp_extract_all(value, F.lit(rules.URL_OR_EMAIL), F.lit(1)),
        lambda u: F.repeat(F.lit("#"), F.length(u)),
    )
    pieces = F.split(value, rules.URL_OR_EMAIL)
    possible = F.lit(False)
    for mark in ("@", "http", "www."):
        possible = possible | F.contains(value, F.lit(mark))
    return F.when(
        possible,
        F.array_join(F.zip_with(pieces, masks, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), ""),
    ).otherwise(value)


def _ends_in_abbreviation(text: Column) -> Column:
    words = "|".join(a.replace(".", r"\.") for a in rules.ABBREVIATIONS)
    return text.rlike(rf"(?iU)\b(?:{words})\.$")


def whitespace_issues(value: Column | str) -> Column:
    """array<string>: one message per suspected missing or repeated space."""
    text = or_empty(value)
    both = let(F.struct(text.alias("text"), mask_safe_spans(text).alias("masked")), lambda t: F.struct(
        t["text"].alias("text"), t["masked"].alias("masked"), pieces(t["text"]).alias("parts"), pieces(t["masked"]).alias("masked_parts")))
    return let(both, lambda t: _issues(t["text"], t["masked"], t["parts"], t["masked_parts"]))


def _issues(text: Column, masked: Column, parts: Column, masked_parts: Column) -> Column:
    def found(source: Column, pattern: str, label: str, keep=None) -> Column:
        spans = match_spans(source, pattern)
        if keep is not None:
            spans = F.filter(spans, keep)
        messages = F.transform(
            spans, lambda s: F.concat(F.lit(label), quoted(snippet(parts, s, rules.SNIPPET_CHARS))))
        return F.when(source.rlike(pattern), messages).otherwise(text_array([]))

    def no_abbreviation(span: Column) -> Column:
        # The longest abbreviation has four letters; eight characters hold it
        # with its period and the character in front of it.
        begin = F.greatest(span["end"] - 10, F.lit(0))
        tail = between(masked_parts, begin, begin + F.least(F.lit(8), span["end"] - 2))
        return ~_ends_in_abbreviation(tail)

    fused = F.transform(
        F.regexp_extract_all(text, F.lit(f"({rules.FUSED_WORD})"), F.lit(1)),
        lambda w: F.concat(
            F.lit("Unusually long unbroken lowercase word (possible missing space, best-effort check): "),
            quoted(w)),
    )
    return F.concat(
        found(text, rules.REPEATED_WHITESPACE, "Repeated whitespace near: "),
        found(masked, rules.MISSING_SPACE_PUNCTUATION, "Missing space after punctuation near: "),
        found(masked, r"[A-Za-z]+\.[A-Z][a-z]", "Missing space after period near: ", no_abbreviation),
        fused,
    )
