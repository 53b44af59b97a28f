"""Per-candidate facts, derived once before any pair is looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift import rules, schemas
from rolesift.functions import profile_text
from rolesift.functions.roles import family_needs, target_families
from rolesift.functions.text import (
    col, expand_target_titles, normalize, normalize_words, or_no_items, phrase_token_sets, text_array,
    word_tokens,
)


def evidence_blob(skills: Column | str, capabilities: Column | str) -> Column:
    """Everything the candidate can point to, as one lower-case text."""
    capabilities = F.coalesce(col(capabilities), F.expr(f"cast(array() as array<{schemas.CAPABILITY.simpleString()}>)"))
    evidence = F.flatten(F.transform(capabilities, lambda c: or_no_items(c["evidence"])))
    return F.lower(F.array_join(F.concat(or_no_items(skills), evidence), " "))


def profile_hash(candidate: Column) -> Column:
    """Stable fingerprint of a candidate struct; field order is the schema's."""
    return F.sha2(F.to_json(candidate), 256)


def with_capability_lists(candidates: DataFrame) -> DataFrame:
    """Parallel lists cap_keys, cap_strengths and cap_proofs (first evidence), and
    cap_spare, the generic capabilities any employer may value.

    Looking a key up in a list is a native loop, which a filter() with a lambda
    per look-up is not.
    """
    listed = F.coalesce(col("capabilities"), F.expr(f"cast(array() as array<{schemas.CAPABILITY.simpleString()}>)"))
    return candidates.withColumn("capabilities", listed).withColumns({
        "cap_keys": F.col("capabilities.key"),
        "cap_strengths": F.transform("capabilities", lambda c: F.coalesce(c["strength"], F.lit("none"))),
        "cap_proofs": F.transform("capabilities", lambda c: F.get(c["evidence"], F.lit(0))),
        "cap_spare": F.transform(
            F.filter("capabilities", lambda c: c["key"].isin(rules.TRANSFERABLE_CAPABILITIES) & (
                F.coalesce(c["strength"], F.lit("none")) != "none")),
            lambda c: F.struct(c["key"].alias("key"), F.get(c["evidence"], F.lit(0)).alias("proof"))),
    })


def _place(key: Column) -> Column:
    return (F.array_position("cap_keys", key) - 1).cast("int")


def _strength(key: Column) -> Column:
    return F.coalesce(F.get("cap_strengths", _place(key)), F.lit("none"))


def _held(keys: Column) -> Column:
    """The capabilities behind some keys: array<struct<key, strength, proof>>."""
    return F.transform(keys, lambda k: F.struct(
        k.alias("key"), _strength(k).alias("strength"), F.get("cap_proofs", _place(k)).alias("proof")))


def _per_family(facts) -> Column:
    """map family -> facts(held); nine entries per candidate, each key looked up once."""
    held = F.transform(family_needs(), lambda needs: F.struct(
        needs["family"].alias("family"), _held(needs["primary"]).alias("primary"),
        _held(needs["secondary"]).alias("secondary")))
    return F.map_from_entries(F.transform(
        held, lambda h: F.struct(h["family"].alias("family"), facts(h).alias("facts"))))


def capability_points() -> Column:
    """map family -> raw capability points, primary needs counting twice."""
    scores = rules.STRENGTH_SCORE

    def summed(held: Column, start: Column, factor: int) -> Column:
        return F.aggregate(held, start, lambda total, c: total + (
            F.when(c["strength"] == "professional", scores["professional"])
            .when(c["strength"] == "practical", scores["practical"]).otherwise(scores["none"])) * factor)

    def raw(held: Column) -> Column:
        weight = F.size(held["primary"]) * 2 + F.size(held["secondary"])
        total = summed(held["secondary"], summed(held["primary"], F.lit(0.0), 2), 1)
        return F.when(
            weight > 0, F.lit(float(rules.WEIGHTS["capability_score"])) * (total / weight)).otherwise(0.0)

    return _per_family(raw)


def capability_relevance() -> Column:
    """map family -> matches, gaps and proofs, for the explanations."""
    def having(held: Column, wanted: str) -> Column:
        return F.filter(held, lambda c: c["strength"] == wanted)

    def gaps(held: Column) -> Column:
        return F.filter(held, lambda c: ~c["strength"].isin("professional", "practical"))

    def facts(held: Column) -> Column:
        needed = F.concat(held["primary"], held["secondary"])
        professional, practical = having(needed, "professional"), having(needed, "practical")
        return F.struct(
            professional["key"].alias("professional_matches"), practical["key"].alias("practical_matches"),
            gaps(needed)["key"].alias("capability_gaps"),
            F.array_compact(F.concat(
                professional["proof"],
                F.transform(practical, lambda c: F.concat(
                    F.lit("(project/practical, not professional) "), c["proof"])))).alias("relevant_evidence"),
            F.array_compact(F.filter(
                "cap_spare", lambda c: ~F.array_contains(needed["key"], c["key"]))["proof"]
            ).alias("transferable_evidence"),
            F.transform(gaps(held["primary"]), lambda c: F.concat(
                F.lit("No demonstrated experience in '"), F.replace(c["key"], F.lit("_"), F.lit(" ")),
                F.lit("', which this role family primarily needs"))).alias("missing_capabilities"),
        )

    return _per_family(facts)


def _normalized(values: Column | str) -> Column:
    return F.transform(or_no_items(values), normalize)


def _keyed(titles: Column | str) -> Column:
    """array<struct<text, key>> with normalised keys."""
    return F.transform(or_no_items(titles), lambda t: F.struct(t.alias("text"), normalize(t).alias("key")))


def _known_words() -> Column:
    titles = F.concat(or_no_items("target_titles"), or_no_items("secondary_titles"))
    return normalize_words(F.flatten(F.transform(titles, word_tokens)))


def _minimum() -> Column:
    return F.coalesce(col("min_acceptable_salary_inr_per_year"), F.lit(0.0))


# Everything pair scoring looks up; expressions are built only for what is asked for.
FEATURES = {
    "years": lambda: F.coalesce(col("total_experience_years"), F.lit(0.0)),
    "target_titles": lambda: _keyed("target_titles"),
    "secondary_titles": lambda: _keyed("secondary_titles"),
    "target_families": lambda: target_families("target_titles", "secondary_titles"),
    "known_words": _known_words,
    "preferred_modes": lambda: _normalized("preferred_work_modes"),
    "preferred_places": lambda: _normalized("preferred_locations"),
    "preferred_industries": lambda: _normalized("preferred_industries"),
    "avoid_industries": lambda: _normalized("avoid_industries"),
    "preferred_sizes": lambda: _normalized("preferred_company_sizes"),
    "salary_floor": _minimum,
    "salary_target": lambda: F.coalesce(col("target_salary_min_inr_per_year"), _minimum()),
    "blob": lambda: evidence_blob("skills", "capabilities"),
    "capability_points": capability_points,
    "capability_facts": capability_relevance,
}
LISTED_FEATURES = {"capability_points", "capability_facts"}


def candidate_features(candidates: DataFrame, *carried: str, names: tuple[str, ...] = tuple(FEATURES)) -> DataFrame:
    """One row per candidate with ``carried`` columns and the features named."""
    rows = with_capability_lists(candidates) if LISTED_FEATURES & set(names) else candidates
    return rows.select(*carried, *[FEATURES[n]().alias(n) for n in names])


def search_phrases(candidates: DataFrame) -> DataFrame:
    """candidate_id, expanded titles, their token sets, and places to accept."""
    titles = expand_target_titles("target_titles", "secondary_titles")
    return candidates.select("candidate_id", titles.alias("phrases"), "preferred_locations").select(
        "candidate_id", "phrases", phrase_token_sets("phrases").alias("phrase_tokens"),
        F.concat(or_no_items("preferred_locations"), text_array(rules.REMOTE_PSEUDO_LOCATIONS)).alias("places"),
    )


def candidate_context(candidates: DataFrame, profiles: DataFrame) -> DataFrame:
    """Candidate, fingerprint, evidence, employers and verbatim profile sections.

    ``profiles(candidate_id, markdown)`` may lack candidates; their sections
    are then empty. Profiles are texts, whose size Spark guesses far too low: both
    sides are dealt by candidate and no profile goes through the driver.
    """
    facts = F.struct(*[F.col(c) for c in candidates.columns])
    return (
        candidates.withColumns({
            "profile_hash": profile_hash(facts),
            "evidence_blob": evidence_blob("skills", "capabilities"),
        })
        .join(profiles.select("candidate_id", "markdown").hint("merge"), "candidate_id", "left")
        .withColumns({
            "verified_employers": profile_text.verified_employers("markdown"),
            "experience_section": profile_text.md_section("markdown", "Experience overview"),
            "education_section": profile_text.md_section("markdown", "Education"),
            "contact_section": profile_text.md_section("markdown", "Contact"),
        })
        .drop("markdown")
    )
