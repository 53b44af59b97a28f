"""Queries over posting-candidate pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift import rules
from rolesift.functions import fit
from rolesift.functions.roles import career_level, career_level_fit, target_families
from rolesift.functions.text import normalize_words, title_tokens, titles_match, word_tokens
from rolesift.operators import browse, scoring
from rolesift.operators.candidates import candidate_features, evidence_blob, search_phrases
from rolesift.plans import oracle as o
from rolesift.plans import views

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = (function, sql)
        return function
    return add


def joined(column, sep: str = "|"):
    return F.array_join(column, sep)


def matches(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_pairs(views.postings(spark, sf), views.candidates(spark, sf), views.pairs(spark, sf))


def rows(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.pair_rows(views.postings(spark, sf), views.candidates(spark, sf), views.pairs(spark, sf))


BREAKDOWN = ", ".join(rules.WEIGHTS)


@query("score_pairs", f"WITH {o.MATCHES} SELECT job_id, candidate_id, score, role_family, career_level, "
       f"application_decision, {BREAKDOWN}, gap AS experience_gap_years, "
       "CASE WHEN application_decision = 'SKIP' THEN 'discovered' ELSE 'shortlisted' END AS status FROM x7")
def score_pairs(spark, sf):
    return matches(spark, sf).select(
        "job_id", "candidate_id", "score", "role_family", "career_level", "application_decision",
        *[F.col(f"score_breakdown.{p}").alias(p) for p in rules.WEIGHTS], "experience_gap_years", "status")


@query("score_pairs_by_factors", f"WITH {o.MATCHES} SELECT job_id, candidate_id, score, application_decision, decision_reason, "
       f"{o.joined('relevant')} AS relevant_evidence, {o.joined('transferable')} AS transferable_evidence, "
       f"{o.joined('missing')} AS missing_requirements, {o.joined('risk_list')} AS risks FROM x7")
def score_pairs_by_factors(spark, sf):
    scored = scoring.score_pairs_by_factors(
        views.postings(spark, sf), views.candidates(spark, sf), views.pairs(spark, sf))
    names = ["relevant_evidence", "transferable_evidence", "missing_requirements", "risks"]
    return scored.select(
        "job_id", "candidate_id", "score", "application_decision", "decision_reason",
        *[joined(n).alias(n) for n in names])


@query("decide_application", f"WITH {o.MATCHES} SELECT job_id, candidate_id, application_decision, decision_reason FROM x7")
def decide_application(spark, sf):
    return matches(spark, sf).select("job_id", "candidate_id", "application_decision", "decision_reason")


@query("explanations", f"WITH {o.MATCHES} SELECT job_id, candidate_id, {o.joined('relevant')} AS relevant_evidence, "
       f"{o.joined('transferable')} AS transferable_evidence, {o.joined('missing')} AS missing_requirements, "
       f"{o.joined('exp_gaps')} AS experience_gaps, {o.joined('risk_list')} AS risks FROM x7")
def explanations(spark, sf):
    names = ["relevant_evidence", "transferable_evidence", "missing_requirements", "experience_gaps", "risks"]
    return matches(spark, sf).select("job_id", "candidate_id", *[joined(n).alias(n) for n in names])


@query("decisions_by_family", f"WITH {o.MATCHES} SELECT role_family, application_decision, count(*) AS pairs, "
       "min(score) AS lowest, max(score) AS highest FROM x7 GROUP BY 1, 2")
def decisions_by_family(spark, sf):
    return matches(spark, sf).groupBy("role_family", "application_decision").agg(
        F.count(F.lit(1)).alias("pairs"), F.min("score").alias("lowest"), F.max("score").alias("highest"))


@query("top_matches", f"WITH {o.MATCHES} SELECT * FROM (SELECT candidate_id, job_id, score, row_number() OVER "
       "(PARTITION BY candidate_id ORDER BY score DESC, job_id)::INT AS rank FROM x7) WHERE rank <= 5")
def top_matches(spark, sf):
    return browse.top_matches(matches(spark, sf), 5).select("candidate_id", "job_id", "score", "rank")


@query("role_family", f"WITH {o.PF} SELECT id, title, role_family, title_family FROM pf")
def role_family_query(spark, sf):
    return scoring.posting_features(views.postings(spark, sf)).select(
        F.col("job_id").alias("id"), "title", "role_family", "title_family")


@query("career_level", f"WITH {o.PF} SELECT id, career_level, CASE WHEN career_level IN ('ENTRY_LEVEL', 'JUNIOR') THEN 10 "
       "WHEN career_level = 'MID_LEVEL' THEN 6 WHEN career_level = 'UNKNOWN' THEN 5 ELSE 1 END AS fit FROM pf")
def career_level_query(spark, sf):
    return views.postings(spark, sf).select("id", career_level("title", "min_experience_years").alias("career_level")).withColumn(
        "fit", career_level_fit("career_level"))


@query("career_level_fit", f"WITH {o.PF}, f AS (SELECT CASE WHEN career_level IN ('ENTRY_LEVEL', 'JUNIOR') THEN 10 "
       "WHEN career_level = 'MID_LEVEL' THEN 6 WHEN career_level = 'UNKNOWN' THEN 5 ELSE 1 END AS fit FROM pf) "
       "SELECT fit, count(*) AS postings FROM f GROUP BY 1")
def career_level_fit_query(spark, sf):
    fits = views.postings(spark, sf).select(
        career_level_fit(career_level("title", "min_experience_years")).alias("fit"))
    return fits.groupBy("fit").agg(F.count(F.lit(1)).alias("postings"))


@query("title_tokens", f"WITH {o.PF} SELECT id, {o.joined('list_sort(title_words)', ' ')} AS words FROM pf")
def title_tokens_query(spark, sf):
    return views.postings(spark, sf).select("id", joined(F.array_sort(title_tokens("title")), " ").alias("words"))


@query("role_family_score", f"WITH {o.MATCHES} SELECT job_id, candidate_id, role_family_score AS score, is_mismatch, "
       "family_status AS status, damp AS dampening FROM x2")
def role_family_score(spark, sf):
    result = fit.role_family_score("role_family", "target_families")
    return rows(spark, sf).withColumn("r", result).select(
        "job_id", "candidate_id", "r.score", "r.is_mismatch", "r.status",
        fit.dampening("role_family", "r.is_mismatch").alias("dampening"))


@query("dampening", f"WITH {o.MATCHES} SELECT role_family, damp AS dampening, count(*) AS pairs FROM x2 GROUP BY 1, 2")
def dampening(spark, sf):
    mismatch = fit.role_family_score("role_family", "target_families")["is_mismatch"]
    return rows(spark, sf).select("role_family", fit.dampening("role_family", mismatch).alias("dampening")).groupBy(
        "role_family", "dampening").agg(F.count(F.lit(1)).alias("pairs"))


CAP_SQL = (
    f"WITH {o.CF} SELECT candidate_id, family, cap_raw AS raw_score, {o.joined('professional')} AS professional_matches, "
    f"{o.joined('practical')} AS practical_matches, {o.joined('gaps')} AS capability_gaps, "
    f"{o.joined('cap_evidence')} AS evidence, {o.joined('transferable')} AS transferable FROM capfacts"
)


@query("capability_relevance", CAP_SQL)
def capability_relevance(spark, sf):
    return (
        candidate_features(views.candidates(spark, sf), "candidate_id")
        .select("candidate_id", "capability_points", F.explode("capability_facts").alias("family", "f"))
        .select("candidate_id", "family", F.try_element_at("capability_points", F.col("family")).alias("raw_score"),
                *[joined(F.col(f"f.{n}")).alias(n) for n in (
                    "professional_matches", "practical_matches", "capability_gaps")],
                joined(F.col("f.relevant_evidence")).alias("evidence"),
                joined(F.col("f.transferable_evidence")).alias("transferable"))
    )


@query("capability_fraction", f"WITH {o.CF} SELECT family, count(*) AS candidates, max(cap_raw / 20) AS best, "
       "min(cap_raw / 20) AS worst FROM capfacts GROUP BY 1")
def capability_fraction(spark, sf):
    points = candidate_features(views.candidates(spark, sf), "candidate_id").select(
        F.explode("capability_points").alias("family", "points"))
    fraction = F.col("points") / 20
    return points.groupBy("family").agg(
        F.count(F.lit(1)).alias("candidates"), F.max(fraction).alias("best"), F.min(fraction).alias("worst"))


NEEDS_SQL = " UNION ALL ".join(
    f"SELECT '{fam}' AS family, '{key}' AS capability, {weight} AS weight"
    for fam, (first, second) in rules.FAMILY_NEEDS.items() for weight, keys in ((2, first), (1, second)) for key in keys)


@query("capability_needs_join", f"WITH {o.PF}, needs AS ({NEEDS_SQL}) SELECT capability, weight, count(*) AS postings "
       "FROM pf JOIN needs ON family = role_family GROUP BY 1, 2")
def capability_needs_join(spark, sf):
    from rolesift.functions.roles import family_needs
    needs = scoring.posting_features(views.postings(spark, sf)).select(
        F.filter(family_needs(), lambda n: n["family"] == F.col("role_family"))[0].alias("n"))
    weighted = F.concat(
        F.transform("n.primary", lambda k: F.struct(k.alias("capability"), F.lit(2).alias("weight"))),
        F.transform("n.secondary", lambda k: F.struct(k.alias("capability"), F.lit(1).alias("weight"))))
    return needs.select(F.explode(weighted).alias("e")).groupBy("e.capability", "e.weight").agg(
        F.count(F.lit(1)).alias("postings"))


def _evidence_rows(spark, sf):
    return rows(spark, sf).withColumns({
        "required_cov": fit.phrase_coverages("required_words", "blob"),
        "preferred_cov": fit.phrase_coverages("preferred_words", "blob"),
    }).select("job_id", "candidate_id", "required_cov", "preferred_cov")


@query("relevant_evidence", f"WITH {o.MATCHES} SELECT job_id, candidate_id, ev_raw AS raw_score, {o.joined('strong')} AS strong_matches, "
       f"{o.joined('partial')} AS partial_matches, {o.joined('weak')} AS weak_matches, "
       f"{o.joined('nice_matches')} AS nice_to_have_matches, len(required_skills)::INT AS required_count FROM x2")
def relevant_evidence(spark, sf):
    return _evidence_rows(spark, sf).withColumn("e", fit.relevant_evidence("required_cov", "preferred_cov")).select(
        "job_id", "candidate_id", "e.raw_score", *[joined(F.col(f"e.{n}")).alias(n) for n in (
            "strong_matches", "partial_matches", "weak_matches", "nice_to_have_matches")], "e.required_count")


@query("mean_coverage", f"WITH {o.MATCHES} SELECT job_id, candidate_id, CASE WHEN len(req_cov) > 0 THEN {o.mean('req_cov')} END AS mean FROM x1")
def mean_coverage(spark, sf):
    from rolesift.functions.text import mean_coverage as mean
    coverage = F.transform("required_cov", lambda p: p["coverage"])
    return _evidence_rows(spark, sf).select("job_id", "candidate_id", mean(coverage).alias("mean"))


TITLE_DETAIL = f"""CASE WHEN t_match IS NOT NULL THEN concat('Title matches target title ''', t_match, '''')
  WHEN s_match IS NOT NULL THEN concat('Title matches secondary title ''', s_match, '''')
  WHEN list_contains(target_families, title_family) THEN concat('Title is a ''', array_to_string(list_transform(string_split(title_family, '_'),
    lambda w: upper(left(w, 1)) || lower(w[2:])), ' '), '''-family role, not an exact/secondary title match')
  WHEN len(overlap) > 0 THEN concat('Partial title-word overlap: ', {o.pylist('overlap')})
  ELSE concat('Title ''', title, ''' is not recognized as a related role') END"""


@query("title_alignment", f"WITH {o.MATCHES} SELECT job_id, candidate_id, title_alignment_score AS score, {TITLE_DETAIL} AS detail FROM x3")
def title_alignment(spark, sf):
    result = fit.title_alignment(
        "title", "title_key", "title_family", "title_words", "target_titles", "secondary_titles", "target_families", "known_words")
    return rows(spark, sf).withColumn("r", result).select("job_id", "candidate_id", "r.score", "r.detail")


@query("title_overlap", f"WITH {o.MATCHES} SELECT job_id, candidate_id, {o.joined('overlap', ' ')} AS words FROM x2")
def title_overlap(spark, sf):
    return rows(spark, sf).select("job_id", "candidate_id", joined(
        F.array_sort(F.array_intersect("title_words", "known_words")), " ").alias("words"))


@query("titles_match", f"WITH {o.MATCHES} SELECT job_id, candidate_id, t_match IS NOT NULL AS target, "
       "s_match IS NOT NULL AS secondary FROM x2")
def titles_match_query(spark, sf):
    found = lambda c: F.exists(c, lambda t: titles_match("title", t["text"]))
    return rows(spark, sf).select(
        "job_id", "candidate_id", found("target_titles").alias("target"), found("secondary_titles").alias("secondary"))


@query("experience_fit", f"WITH {o.MATCHES} SELECT job_id, candidate_id, experience_fit_score AS score, exp_status AS status, "
       "CASE WHEN unstated THEN 0.0 ELSE gap END AS gap, exp_detail AS detail FROM x6")
def experience_fit(spark, sf):
    result = fit.experience_fit("min_experience_years", "max_experience_years", "years", "career_level")
    return rows(spark, sf).withColumn("r", result).select("job_id", "candidate_id", "r.*")


@query("location_fit", f"""WITH {o.MATCHES} SELECT job_id, candidate_id, location_fit AS score,
  CASE WHEN mode = '' THEN 'not specified' WHEN mode_points = 4 THEN 'matches preference' ELSE 'not in preferred work modes' END AS work_mode_status,
  CASE WHEN mode = 'remote' THEN 'remote (location not applicable)' WHEN place = '' THEN 'not specified'
    WHEN place_points = 4 THEN 'matches preference' ELSE 'outside preferred locations' END AS location_status FROM x4""")
def location_fit(spark, sf):
    return scoring.with_parts(rows(spark, sf)).select(
        "job_id", "candidate_id", F.col("location_fit").alias("score"), "work_mode_status", "location_status")


@query("industry_fit", f"""WITH {o.MATCHES} SELECT job_id, candidate_id, industry_fit AS score,
  CASE WHEN avoided THEN 'avoided industry' WHEN field = '' THEN 'not specified' WHEN liked THEN 'preferred'
    ELSE 'not in preferred industries' END AS industry_status,
  CASE WHEN size_word = '' THEN 'not specified' WHEN size_points = 1 THEN 'preferred' ELSE 'not a preferred size' END AS company_size_status,
  avoided AS is_avoided_industry FROM x4""")
def industry_fit(spark, sf):
    return scoring.with_parts(rows(spark, sf)).select(
        "job_id", "candidate_id", F.col("industry_fit").alias("score"), "industry_status", "company_size_status",
        (F.col("industry_status") == "avoided industry").alias("is_avoided_industry"))


@query("salary_fit", f"""WITH {o.MATCHES} SELECT job_id, candidate_id, salary_fit AS score,
  CASE WHEN offer IS NULL THEN 'not specified' WHEN offer >= target_pay THEN 'meets or exceeds target'
    WHEN offer >= floor_pay THEN 'between minimum and target' ELSE 'below minimum acceptable' END AS status,
  CASE WHEN offer IS NULL THEN 'Job does not list a salary (not held against it)'
    WHEN offer >= target_pay THEN concat('Job offers up to ', {o.dbl_text('offer')})
    WHEN offer >= floor_pay THEN concat('Job offers up to ', {o.dbl_text('offer')}, ', between your minimum ',
      {o.whole_text('floor_pay')}, ' and target ', {o.whole_text('target_pay')})
    ELSE concat('Job offers up to ', {o.dbl_text('offer')}, ', below your minimum acceptable ', {o.whole_text('floor_pay')}) END AS detail FROM x4""")
def salary_fit(spark, sf):
    result = fit.salary_fit("salary_min", "salary_max", "salary_floor", "salary_target")
    return rows(spark, sf).withColumn("r", result).select("job_id", "candidate_id", "r.*")


@query("total_score", f"WITH {o.MATCHES} SELECT score, count(*) AS pairs FROM x7 GROUP BY 1")
def total_score(spark, sf):
    return matches(spark, sf).groupBy("score").agg(F.count(F.lit(1)).alias("pairs"))


@query("critical_missing", f"WITH {o.MATCHES} SELECT job_id, candidate_id, critical, legitimate FROM x4")
def critical_missing(spark, sf):
    return scoring.with_parts(rows(spark, sf)).select("job_id", "candidate_id", "critical", "legitimate")


@query("appears_legitimate", f"WITH {o.PF} SELECT id, legitimate FROM pf")
def appears_legitimate(spark, sf):
    return views.postings(spark, sf).select(
        "id", fit.appears_legitimate("application_url", "description").alias("legitimate"))


@query("target_families", f"WITH {o.CF} SELECT candidate_id, {o.joined('target_families')} AS families FROM cf")
def target_families_query(spark, sf):
    return views.candidates(spark, sf).select(
        "candidate_id", joined(target_families("target_titles", "secondary_titles")).alias("families"))


@query("evidence_blob", f"WITH {o.CF} SELECT candidate_id, blob FROM cf")
def evidence_blob_query(spark, sf):
    return views.candidates(spark, sf).select("candidate_id", evidence_blob("skills", "capabilities").alias("blob"))


@query("known_words", f"WITH {o.CF} SELECT candidate_id, {o.joined('list_sort(known_words)', ' ')} AS words FROM cf")
def known_words(spark, sf):
    titles = F.concat("target_titles", "secondary_titles")
    words = normalize_words(F.flatten(F.transform(titles, word_tokens)))
    return views.candidates(spark, sf).select("candidate_id", joined(F.array_sort(words), " ").alias("words"))


def _variants_sql() -> str:
    parts = []
    base = "list_concat(target_titles, secondary_titles)"
    words = f"flatten(list_transform({base}, lambda t: {o.tokens('t')}))"
    for triggers, variants in rules.TITLE_VARIANTS:
        listed = "[" + o.quoted_in(variants) + "]"
        parts.append(
            f"CASE WHEN list_has_any({words}, [{o.quoted_in(triggers)}]) THEN list_filter({listed}, lambda v: "
            f"NOT list_contains(list_transform({base}, lambda b: lower(b)), lower(v))) ELSE []::VARCHAR[] END")
    return base + "".join(f" || {p}" for p in parts)


@query("expand_target_titles", f"WITH {o.CF} SELECT candidate_id, array_to_string({_variants_sql()}, '|') AS titles FROM cf")
def expand_target_titles_query(spark, sf):
    return search_phrases(views.candidates(spark, sf)).select("candidate_id", joined("phrases").alias("titles"))


@query("annotate_match", f"WITH {o.MATCHES} SELECT candidate_id, id, title, score, application_decision, status FROM ("
       "SELECT candidate_id, job_id AS id, title, score, application_decision, "
       "CASE WHEN application_decision = 'SKIP' THEN 'discovered' ELSE 'shortlisted' END AS status FROM x7)")
def annotate_match(spark, sf):
    return scoring.annotate_match(views.owned_postings(spark, sf), views.candidates(spark, sf)).select(
        "candidate_id", "id", "title", "score", "application_decision", "status")
