"""Sections and employers read from a candidate's Markdown profile."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesift.functions.spans import match_spans
from rolesift.functions.text import let, or_empty, strip

# Headings, role lines and separators of the profile format.
EMPLOYER_LINE = (
    r"(?mdU)^\s*-?\s*(?:Current / most recent role|Previous roles?)\s*:\s*([^\n]+)$"
)
ROLE_LINE = r"(?mdU)^\s*-\s+([^\n]+)$"
PLACE_SEPARATOR = r"(?U)\s+—\s+|\s+-\s+(?=[A-Z])"


def md_section(text: Column | str, heading: str) -> Column:
    """Text below '## heading' up to the next second-level heading."""
    pattern = rf"(?mdsU)^##\s+{heading}\s*$(.*?)(?=\n## |\z)"
    return strip(F.regexp_extract(or_empty(text), pattern, 1))


def _employer(line: Column) -> Column:
    parts = F.split(F.get(F.split(line, PLACE_SEPARATOR), F.lit(0)), ",")
    return let(parts, lambda p: F.when(F.size(p) > 1, strip(F.element_at(p, -1))))


def distinct_ignoring_case(values: Column) -> Column:
    """First spelling of every value, order kept; ``values`` and their lower-case forms are computed once."""
    return let(values, lambda listed: let(F.transform(listed, F.lower), lambda low: F.filter(
        listed, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)))


def verified_employers(markdown: Column | str) -> Column:
    """Employer names on the role lines and on the bullet lines below them."""
    text = or_empty(markdown)

    def own(role: Column) -> Column:
        return F.array(F.when(~F.endswith(role, F.lit(":")), _employer(role)))

    def block(rest: Column) -> Column:
        return F.when(
            F.contains(rest, F.lit("\n## ")), F.regexp_extract(rest, r"(?s)^(.*?)\n## ", 1)
        ).otherwise(rest)

    def names(span: Column) -> Column:
        line = F.substring(text, span["start"] + 1, span["end"] - span["start"])
        role = strip(F.regexp_extract(line, EMPLOYER_LINE, 1))
        rest = F.substring(text, span["end"] + 1, F.length(text))
        listed = F.transform(F.regexp_extract_all(let(rest, block), F.lit(ROLE_LINE), F.lit(1)), _employer)
        return F.concat(let(role, own), listed)

    found = F.flatten(F.transform(match_spans(text, EMPLOYER_LINE.replace("([^", "(?:[^")), names))
    return distinct_ignoring_case(F.filter(found, lambda n: n.isNotNull() & (n != "")))
