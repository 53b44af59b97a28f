"""Scalar text functions: Column in, Column out, all JVM built-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesift import rules


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def sql_text(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_array(values: Iterable[str]) -> Column:
    """A literal array<string>, also for an empty list."""
    return F.expr(f"cast(array({', '.join(sql_text(v) for v in values)}) as array<string>)")


def text_map(pairs: dict[str, str]) -> Column:
    return F.expr(f"map({', '.join(sql_text(x) for pair in pairs.items() for x in pair)})")


def strip(value: Column | str) -> Column:
    """Remove leading and trailing white space of every kind, not only blanks."""
    return F.btrim(col(value), F.lit(rules.STRIP_CHARS))


def blank_to_null(value: Column | str) -> Column:
    value = col(value)
    return F.when(value != "", value)


def or_empty(value: Column | str) -> Column:
    return F.coalesce(col(value), F.lit(""))


def or_no_items(value: Column | str) -> Column:
    return F.coalesce(col(value), text_array([]))


def normalize(value: Column | str) -> Column:
    """NULL becomes '', surrounding white space goes, letters become lower case."""
    return F.lower(strip(or_empty(value)))


def word_boundary_pattern(phrases: Iterable[str]) -> str:
    """One alternation for a phrase class; boundaries are Unicode-aware."""
    return r"(?U)\b(?:" + "|".join(phrases) + r")\b"


def contains_word(value: Column | str, *phrases: str) -> Column:
    return col(value).rlike(word_boundary_pattern(phrases))


def contains_phrase(value: Column | str, *phrases: str) -> Column:
    """:func:`contains_word` for phrases without pattern signs in a column that costs nothing to read again.

    A text with a phrase as a word holds it; a plain search spares most texts the pattern.
    """
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(col(value), F.lit(phrase))
    return found & contains_word(value, *phrases)


def overlap_match(a: Column | str, b: Column | str) -> Column:
    """Either normalised text contains the other; blanks never match."""
    a, b = col(a), col(b)
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def titles_match(a: Column | str, b: Column | str) -> Column:
    return overlap_match(normalize(a), normalize(b))


def word_tokens(value: Column | str) -> Column:
    """The set of [a-z0-9]+ runs of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(or_empty(value)), F.lit("[a-z0-9]+"), F.lit(0)))


def normalize_words(tokens: Column | str, forms: dict[str, list[str]] = rules.SCORE_WORD_FORMS) -> Column:
    """Map word forms to their canonical form, then drop repeats."""
    lookup = text_map({v: canonical for canonical, variants in forms.items() for v in variants})
    return F.array_distinct(F.transform(col(tokens), lambda t: F.coalesce(F.try_element_at(lookup, t), t)))


def title_tokens(title: Column | str, forms: dict[str, list[str]] = rules.SCORE_WORD_FORMS) -> Column:
    return normalize_words(word_tokens(title), forms)


def significant_words(value: Column | str) -> Column:
    """Runs of four or more letters that are no stop word, repeats kept."""
    words = F.regexp_extract_all(F.lower(or_empty(value)), F.lit("[a-z]{4,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*rules.STOPWORDS))


def words_coverage(words: Column | str, blob: Column | str) -> Column:
    """Share of ``words`` that occur as substrings of ``blob``; none means 1.0."""
    words, blob = col(words), col(blob)
    found = F.size(F.filter(words, lambda w: F.contains(blob, w)))
    return F.when(F.size(words) == 0, F.lit(1.0)).otherwise(found / F.size(words))


def phrase_coverage(phrase: Column | str, blob: Column | str) -> Column:
    return words_coverage(significant_words(phrase), blob)


def mean_coverage(coverages: Column | str) -> Column:
    """Mean in list order, so that the floating-point sum is reproducible."""
    coverages = col(coverages)
    total = F.aggregate(coverages, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(coverages) > 0, total / F.size(coverages))


def strip_html(value: Column | str) -> Column:
    """Line-breaking tags become newlines, other tags vanish, white space folds.

    Entities stay as they are; tag names are matched in lower case only.
    """
    text = or_empty(value)
    for pattern, replacement in (
        (r"(?U)<br\s*/?>", "\n"),
        (r"<li[^>]*>", "\n"),
        (r"</(p|li|div)>", "\n"),
        (r"<[^>]+>", ""),
        (r"[ \t]+", " "),
        (r"\n{2,}", "\n"),
    ):
        text = F.regexp_replace(text, F.lit(pattern), F.lit(replacement))
    return strip(text)


def make_id(*parts: Column | str) -> Column:
    """Slug of every non-empty part joined by '-'.

    A part whose slug is empty still contributes its separator.
    """
    slugs = [
        F.when(col(p) != "", F.btrim(F.regexp_replace(F.lower(col(p)), "[^a-z0-9]+", "-"), F.lit("-")))
        for p in parts
    ]
    return F.concat_ws("-", *slugs)


def canonical_url(url: Column | str) -> Column:
    """Lower-case host plus path without trailing '/'; NULL when there is no host.

    Scheme, query and fragment are dropped because tracking parameters differ
    between copies of one link.
    """
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)([^?#]*)"
    cleaned = F.regexp_replace(F.regexp_replace(strip(url), r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    host = blank_to_null(F.regexp_extract(cleaned, pattern, 1))
    balanced = F.contains(host, F.lit("[")) == F.contains(host, F.lit("]"))
    path = F.rtrim(F.regexp_extract(cleaned, pattern, 2), F.lit("/"))
    return F.when(balanced, F.concat(F.lower(host), path))


def parse_experience(value: Column | str) -> Column:
    """struct(min, max) years: a range, else 'N+ years', else 'minimum N years'."""
    value = or_empty(value)
    # Most texts state no years at all; a plain search spares them the patterns.
    stated = F.when(F.contains(F.lower(value), F.lit("year")), value)

    def number(pattern: str, group: int) -> Column:
        return blank_to_null(F.regexp_extract(stated, pattern, group)).try_cast("double")

    low, high = number(rules.EXPERIENCE_RANGE, 1), number(rules.EXPERIENCE_RANGE, 2)
    return F.struct(
        F.coalesce(low, number(rules.EXPERIENCE_PLUS, 1), number(rules.EXPERIENCE_MINIMUM, 1)).alias("min"),
        high.alias("max"))


def is_experience_line(value: Column | str) -> Column:
    value = or_empty(value)
    return F.contains(F.lower(value), F.lit("year")) & (
        value.rlike(rules.EXPERIENCE_RANGE) | value.rlike(rules.EXPERIENCE_PLUS)
        | value.rlike(rules.EXPERIENCE_MINIMUM)
    )


def parse_salary(value: Column | str) -> Column:
    """struct(min, max, currency) from '$a[k|m] - $b[k|m]'; b inherits a's suffix."""
    value = or_empty(value)

    def group(n: int) -> Column:
        return F.regexp_extract(value, rules.SALARY_RANGE, n)

    def amount(digits: Column, suffix: Column) -> Column:
        number = blank_to_null(F.regexp_replace(digits, ",", "")).try_cast("double")
        factor = F.when(F.lower(suffix) == "k", 1_000.0).when(F.lower(suffix) == "m", 1_000_000.0).otherwise(1.0)
        return number * factor

    low = amount(group(1), group(2))
    high = amount(group(3), F.when(group(4) != "", group(4)).otherwise(group(2)))
    known = low.isNotNull() & high.isNotNull()
    return F.struct(
        F.when(known, low).alias("min"), F.when(known, high).alias("max"),
        F.when(known, F.lit(rules.SALARY_CURRENCY)).alias("currency"),
    )


def work_mode(value: Column | str) -> Column:
    text = F.lower(or_empty(value))

    def has(*words: str) -> Column:
        test = F.lit(False)
        for word in words:
            test = test | F.contains(text, F.lit(word))
        return test

    return (
        F.when(has("hybrid"), "hybrid")
        .when(has("remote") & contains_word(text, "remote"), "remote")
        .when(has("onsite", "on-site", "based at", "based in"), "onsite")
    )


def bullets(value: Column | str) -> Column:
    """Lines without their bullet marks; empty lines are dropped."""
    lines = F.split(or_empty(value), r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
    return F.filter(F.transform(lines, lambda x: F.btrim(x, F.lit("-• \t"))), lambda x: x != "")


def labelled_field(value: Column | str, label: str) -> Column:
    """Rest of the line after 'label:'; NULL when the label is absent."""
    pattern = r"(?U)" + label + r"\s*:\s*([^\n]+)"
    return F.when(or_empty(value).rlike(pattern), strip(F.regexp_extract(or_empty(value), pattern, 1)))


def iso_date10(value: Column | str) -> Column:
    """Date of the first ten characters; NULL when blank or no date."""
    return blank_to_null(F.substring(or_empty(value), 1, 10)).try_cast("date")


def epoch_millis_to_date(value: Column | str) -> Column:
    """UTC date of an epoch-millisecond number given as text or number."""
    seconds = col(value).cast("string").try_cast("double") / 1000
    return F.to_date(F.timestamp_seconds(seconds))


def expand_target_titles(target: Column | str, secondary: Column | str) -> Column:
    """Own titles plus curated variants of every family the titles touch.

    The order is kept; a variant equal to a listed title up to letter case is
    not added again.
    """
    base = F.concat(or_no_items(target), or_no_items(secondary))
    words, known = F.flatten(F.transform(base, word_tokens)), F.transform(base, F.lower)
    # No variant occurs in two families, so only the own titles can repeat one.
    added = [
        F.when(
            F.arrays_overlap(words, text_array(triggers)),
            F.filter(text_array(variants), lambda v: ~F.array_contains(known, F.lower(v))),
        ).otherwise(text_array([]))
        for triggers, variants in rules.TITLE_VARIANTS
    ]
    return F.concat(base, *added)


def phrase_token_sets(phrases: Column | str) -> Column:
    return F.transform(col(phrases), lambda p: title_tokens(p, rules.COLLECT_WORD_FORMS))


def title_is_relevant(title: Column | str, phrase_tokens: Column | str) -> Column:
    """True when all words of at least one phrase occur in the title."""
    words = title_tokens(title, rules.COLLECT_WORD_FORMS)
    return F.exists(
        col(phrase_tokens),
        lambda p: (F.size(p) > 0) & (F.size(F.array_except(p, words)) == 0),
    )


def location_is_relevant(location: Column | str, preferences: Column | str) -> Column:
    """False only for a stated place outside the preferred ones."""
    place, wanted = normalize(location), col(preferences)
    remote = F.lit(False)
    for word in rules.REMOTE_LOCATION_WORDS:
        remote = remote | F.contains(place, F.lit(word))
    return (
        (F.size(wanted) == 0) | (place == "") | remote
        | F.exists(wanted, lambda p: F.contains(place, F.lower(p)))
    )
