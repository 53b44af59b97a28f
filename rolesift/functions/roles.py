"""Role family and career level of a title."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesift import rules
from rolesift.functions.text import (
    col, contains_phrase, contains_word, let, normalize, or_empty, or_no_items, sql_text, title_tokens,
)


def _phrase_family(text: Column | str, contains: Callable = contains_word) -> Column:
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for family, phrases in rules.FAMILY_PHRASES:
        chain = chain.when(contains(text, *phrases), F.lit(family))
    return chain


def _token_family(tokens: Column | str) -> Column:
    def has(word: str) -> Column:
        return F.array_contains(col(tokens), word)

    return (
        F.when(has("product") & (has("analy") | has("manage") | has("own")), "PRODUCT")
        .when((has("business") | has("functional") | has("systems")) & has("analy"), "BUSINESS_ANALYSIS")
        .when((has("project") | has("program")) & (has("manage") | has("coordinat")), "PROJECT_PROGRAM")
    )


def title_family(title: Column | str) -> Column:
    """Family from the title alone."""
    return F.coalesce(
        _phrase_family(normalize(title)), _token_family(title_tokens(title)), F.lit("UNKNOWN")
    )


def role_family(title: Column | str, description: Column | str, head_chars: int | None = None) -> Column:
    """Title phrases, then title words, then phrases in title plus description.

    ``head_chars`` narrows the last step to the beginning of the description.
    """
    head = normalize(description)
    if head_chars is not None:
        head = F.substring(head, 1, head_chars)
    return F.coalesce(
        _phrase_family(normalize(title)),
        _token_family(title_tokens(title)),
        F.when(or_empty(description) != "", _phrase_family(F.concat_ws(" ", normalize(title), head))),
        F.lit("UNKNOWN"),
    )


def known_family(title_key: str, title_words: str) -> Column:
    """Family of a title from columns that hold its normalised text and its words; NULL when it has none."""
    return F.coalesce(_phrase_family(title_key, contains_phrase), _token_family(title_words))


def family_in_text(title_key: str, description: Column | str) -> Column:
    """Last step of :func:`role_family`, beside a column with the normalised title; NULL when it finds none."""
    text = F.concat_ws(" ", col(title_key), normalize(description))
    return F.when(or_empty(description) != "", let(text, lambda t: _phrase_family(t, contains_phrase)))


def target_families(target: Column | str, secondary: Column | str) -> Column:
    """Families of the candidate's own titles, without UNKNOWN."""
    titles = F.concat(or_no_items(target), or_no_items(secondary))
    return F.array_sort(F.array_remove(F.array_distinct(F.transform(titles, title_family)), "UNKNOWN"))


def career_level(title: Column | str, min_years: Column | str) -> Column:
    """Title wording first, stated years second."""
    return _level(normalize(title), col(min_years), contains_word)


def level_of_key(title_key: str, min_years: Column | str) -> Column:
    """:func:`career_level` from a column that holds the normalised title."""
    return _level(title_key, col(min_years), contains_phrase)


def _level(text: Column | str, years: Column, contains: Callable) -> Column:
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for level, markers in rules.LEVEL_MARKERS:
        chain = chain.when(contains(text, *markers), F.lit(level))
    people_manager = contains(text, "manager") & ~contains(text, *rules.FUNCTION_TITLE_PHRASES)
    return (
        chain.when(people_manager, "MANAGER")
        .when(years < 1, "ENTRY_LEVEL")
        .when(years <= 2, "JUNIOR")
        .when(years <= 4, "MID_LEVEL")
        .when(years <= 7, "SENIOR")
        .when(years.isNotNull(), "LEAD")
        .otherwise("UNKNOWN")
    )


def career_level_fit(level: Column | str) -> Column:
    level = col(level)
    return (
        F.when(level.isin(rules.ENTRY_LEVELS), 10).when(level == "MID_LEVEL", 6)
        .when(level == "UNKNOWN", 5).otherwise(1)
    )


def family_needs() -> Column:
    """Literal array<struct<family, primary, secondary>>, one entry per family."""
    keys = lambda names: f"cast(array({', '.join(map(sql_text, names))}) as array<string>)"
    entries = [
        f"named_struct('family', {sql_text(family)}, 'primary', {keys(first)}, 'secondary', {keys(second)})"
        for family, (first, second) in rules.FAMILY_NEEDS.items()
    ]
    return F.expr(f"array({', '.join(entries)})")
