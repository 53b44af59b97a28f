"""SQL fragments for the side-by-side checks, written for a plain SQL database.

They state the rules a second time, in SQL and without any of the column
functions, so that a mistake in one statement of a rule shows up as a difference.
"""

from __future__ import annotations

from rolesift import rules
from rolesift.plans import views

WS = "concat(chr(9),chr(10),chr(11),chr(12),chr(13),chr(28),chr(29),chr(30),chr(31),' ',chr(133),chr(160)," \
     "chr(5760),chr(8192),chr(8193),chr(8194),chr(8195),chr(8196),chr(8197),chr(8198),chr(8199),chr(8200)," \
     "chr(8201),chr(8202),chr(8232),chr(8233),chr(8239),chr(8287),chr(12288))"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def norm(x: str) -> str:
    return f"lower({strip(f'coalesce({x}, chr(0)[1:0])')})".replace("chr(0)[1:0]", "''")


def quoted_in(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def has(text: str, phrases: list[str]) -> str:
    return f"regexp_matches({text}, '\\b({'|'.join(phrases)})\\b')"


def tokens(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'))"


def word_forms(words: str, forms: dict[str, list[str]]) -> str:
    cases = " ".join(f"WHEN w IN ({quoted_in(v)}) THEN '{k}'" for k, v in forms.items())
    return f"list_distinct(list_transform({words}, lambda w: CASE {cases} ELSE w END))"


def title_words(x: str) -> str:
    return word_forms(tokens(x), rules.SCORE_WORD_FORMS)


def family_of_title(title: str, otherwise: str = "'UNKNOWN'") -> str:
    text, words = norm(title), title_words(title)

    def w(word: str) -> str:
        return f"list_contains({words}, '{word}')"

    phrases = " ".join(f"WHEN {has(text, p)} THEN '{f}'" for f, p in rules.FAMILY_PHRASES)
    return (
        f"CASE {phrases} WHEN {w('product')} AND ({w('analy')} OR {w('manage')} OR {w('own')}) THEN 'PRODUCT' "
        f"WHEN ({w('business')} OR {w('functional')} OR {w('systems')}) AND {w('analy')} THEN 'BUSINESS_ANALYSIS' "
        f"WHEN ({w('project')} OR {w('program')}) AND ({w('manage')} OR {w('coordinat')}) THEN 'PROJECT_PROGRAM' "
        f"ELSE {otherwise} END"
    )


def family(title: str, description: str) -> str:
    both = f"concat({norm(title)}, ' ', {norm(description)})"
    phrases = " ".join(f"WHEN {has(both, p)} THEN '{f}'" for f, p in rules.FAMILY_PHRASES)
    return family_of_title(title, f"CASE {phrases} ELSE 'UNKNOWN' END")


def level(title: str, years: str) -> str:
    text = norm(title)
    markers = " ".join(f"WHEN {has(text, m)} THEN '{lv}'" for lv, m in rules.LEVEL_MARKERS)
    return (
        f"CASE {markers} WHEN {has(text, ['manager'])} AND NOT {has(text, rules.FUNCTION_TITLE_PHRASES)} THEN 'MANAGER' "
        f"WHEN {years} < 1 THEN 'ENTRY_LEVEL' WHEN {years} <= 2 THEN 'JUNIOR' WHEN {years} <= 4 THEN 'MID_LEVEL' "
        f"WHEN {years} <= 7 THEN 'SENIOR' WHEN {years} IS NOT NULL THEN 'LEAD' ELSE 'UNKNOWN' END"
    )


def significant(x: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z]{{4,}}'), "
        f"lambda w: w NOT IN ({quoted_in(rules.STOPWORDS)}))"
    )


def coverage(x: str, blob: str) -> str:
    words = significant(x)
    return (
        f"CASE WHEN len({words}) = 0 THEN 1.0::DOUBLE ELSE "
        f"len(list_filter({words}, lambda s: contains({blob}, s)))::DOUBLE / len({words}) END"
    )


def titles_match(a: str, b: str) -> str:
    a, b = norm(a), norm(b)
    return f"({a} <> '' AND {b} <> '' AND (contains({a}, {b}) OR contains({b}, {a})))"


def dbl_text(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN printf('%.1f', {x}) ELSE {x}::VARCHAR END"


def whole_text(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN printf('%.0f', {x}) ELSE {x}::VARCHAR END"


def general(x: str) -> str:
    """For numbers with few digits: the value without a trailing '.0'."""
    return f"regexp_replace(({x})::VARCHAR, '\\.0$', '')"


def pyquote(x: str) -> str:
    e = x
    for raw, shown in (("chr(92)", "chr(92)||chr(92)"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'"),
                       ("chr(160)", "'\\xa0'")):
        e = f"replace({e}, {raw}, {shown})"
    sq = "chr(39)"
    single = f"concat({sq}, replace({e}, {sq}, chr(92)||{sq}), {sq})"
    double = f"concat(chr(34), {e}, chr(34))"
    return f"CASE WHEN {x} IS NULL THEN 'None' WHEN contains({x}, {sq}) AND NOT contains({x}, chr(34)) THEN {double} ELSE {single} END"


def pylist(x: str) -> str:
    return f"concat('[', array_to_string(list_transform({x}, lambda q: {pyquote('q')}), ', '), ']')"


def joined(x: str, sep: str = "|") -> str:
    return f"array_to_string({x}, '{sep}')"


def strength(key: str) -> str:
    return f"coalesce(list_filter(capabilities, lambda c: c.key = '{key}')[1].strength, 'none')"


def first_evidence(key: str) -> str:
    return f"list_filter(capabilities, lambda c: c.key = '{key}')[1].evidence[1]"


def strength_points(key: str) -> str:
    return f"CASE {strength(key)} WHEN 'professional' THEN 1.0::DOUBLE WHEN 'practical' THEN 0.65::DOUBLE ELSE 0.0::DOUBLE END"


def known(xs: list[str]) -> str:
    return "list_filter([" + ", ".join(xs) + "]::VARCHAR[], lambda z: z IS NOT NULL)" if xs else "[]::VARCHAR[]"


# posting features
PF = f"""pf AS (
  SELECT *, id AS job_id, {family('title', 'description')} AS role_family,
    {family_of_title('title')} AS title_family, {title_words('title')} AS title_words,
    {level('title', 'min_experience_years')} AS career_level,
    coalesce(starts_with(application_url, 'http'), false) AND length(coalesce(description, '')) > 50 AS legitimate
  FROM {views.POSTINGS_SQL} p)"""


def _facts() -> str:
    rows = []
    for fam, (primary, secondary) in rules.FAMILY_NEEDS.items():
        need = primary + secondary
        total = "0.0::DOUBLE"
        for k in primary:
            total += f" + ({strength_points(k)}) * 2"
        for k in secondary:
            total += f" + ({strength_points(k)})"
        weight = 2 * len(primary) + len(secondary)
        raw = f"20.0::DOUBLE * (({total}) / {weight})" if weight else "0.0::DOUBLE"
        prof = known([f"CASE WHEN {strength(k)} = 'professional' THEN '{k}' END" for k in need])
        prac = known([f"CASE WHEN {strength(k)} = 'practical' THEN '{k}' END" for k in need])
        gaps = known([f"CASE WHEN {strength(k)} NOT IN ('professional', 'practical') THEN '{k}' END" for k in need])
        evid = known(
            [f"CASE WHEN {strength(k)} = 'professional' THEN {first_evidence(k)} END" for k in need]
            + [f"CASE WHEN {strength(k)} = 'practical' THEN '(project/practical, not professional) ' || {first_evidence(k)} END"
               for k in need])
        miss = known([
            f"CASE WHEN {strength(k)} NOT IN ('professional', 'practical') THEN 'No demonstrated experience in ''"
            f"{k.replace('_', ' ')}'', which this role family primarily needs' END" for k in primary])
        not_needed = f"c.key NOT IN ({quoted_in(need)})" if need else "true"
        trans = (
            f"list_filter(list_transform(list_filter(capabilities, lambda c: c.key IN "
            f"({quoted_in(rules.TRANSFERABLE_CAPABILITIES)}) AND {not_needed} AND coalesce(c.strength, 'none') <> 'none'), "
            f"lambda c: c.evidence[1]), lambda z: z IS NOT NULL)")
        rows.append(
            f"SELECT candidate_id, '{fam}' AS family, {raw} AS cap_raw, {prof} AS professional, {prac} AS practical, "
            f"{gaps} AS gaps, {evid} AS cap_evidence, {trans} AS transferable, {miss} AS cap_missing FROM c0")
    return "capfacts AS (" + " UNION ALL ".join(rows) + ")"


CF = f"""c0 AS (SELECT * FROM {views.CANDIDATES_SQL} c),
cf AS (
  SELECT *, coalesce(total_experience_years, 0.0) AS years,
    coalesce(min_acceptable_salary_inr_per_year, 0.0) AS floor_pay,
    coalesce(target_salary_min_inr_per_year, min_acceptable_salary_inr_per_year, 0.0) AS target_pay,
    list_sort(list_distinct(list_filter(list_transform(list_concat(target_titles, secondary_titles),
      lambda t: {family_of_title('t')}), lambda f: f <> 'UNKNOWN'))) AS target_families,
    {word_forms("list_distinct(flatten(list_transform(list_concat(target_titles, secondary_titles), lambda t: " + tokens('t') + ")))", rules.SCORE_WORD_FORMS)} AS known_words,
    list_transform(preferred_work_modes, lambda m: {norm('m')}) AS modes,
    list_transform(preferred_company_sizes, lambda m: {norm('m')}) AS sizes,
    lower(array_to_string(list_concat(skills, flatten(list_transform(capabilities, lambda c: c.evidence))), ' ')) AS blob
  FROM c0),
{_facts()}"""

SUM_LIST = "list_reduce(list_concat([0.0::DOUBLE], {x}), lambda a, b: a + b)"


def mean(x: str) -> str:
    return f"({SUM_LIST.format(x=x)} / len({x}))"


PAIR = f"""x1 AS (
  SELECT pf.* EXCLUDE (id), cf.* EXCLUDE (capabilities, name), k.cap_raw, k.cap_evidence, k.transferable, k.cap_missing,
    list_transform(required_skills, lambda s: {coverage('s', 'blob')}) AS req_cov,
    list_transform(preferred_skills, lambda s: {coverage('s', 'blob')}) AS nice_cov
  FROM {views.PAIRS_SQL} pr JOIN pf USING (job_id) JOIN cf USING (candidate_id)
  JOIN capfacts k ON k.candidate_id = cf.candidate_id AND k.family = pf.role_family),
x2 AS (
  SELECT *,
    list_contains(target_families, role_family) AS known_family,
    CASE WHEN list_contains(target_families, role_family) THEN 20 WHEN role_family = 'UNKNOWN' THEN 7 ELSE 0 END AS role_family_score,
    NOT list_contains(target_families, role_family) AND role_family <> 'UNKNOWN' AS is_mismatch,
    CASE WHEN list_contains(target_families, role_family) THEN concat('''', role_family, ''' is one of your target role families')
      WHEN role_family = 'UNKNOWN' THEN 'role family could not be reliably classified from the title'
      ELSE concat('''', role_family, ''' is not one of your target role families (',
        CASE WHEN len(target_families) = 0 THEN 'none set' ELSE {joined('target_families', ', ')} END, ')') END AS family_status,
    CASE WHEN list_contains(target_families, role_family) OR role_family = 'UNKNOWN' THEN
      CASE WHEN role_family = 'UNKNOWN' THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END ELSE 0.2::DOUBLE END AS damp,
    (CASE WHEN len(req_cov) = 0 THEN 12.0::DOUBLE ELSE 12.0::DOUBLE * {mean('req_cov')} END)
      + (CASE WHEN len(nice_cov) = 0 THEN 3.0::DOUBLE ELSE 3.0::DOUBLE * {mean('nice_cov')} END) AS ev_raw,
    list_filter(required_skills, lambda s, i: req_cov[i] >= 0.6) AS strong,
    list_filter(required_skills, lambda s, i: req_cov[i] >= 0.3 AND req_cov[i] < 0.6) AS partial,
    list_filter(required_skills, lambda s, i: req_cov[i] < 0.3) AS weak,
    list_filter(preferred_skills, lambda s, i: nice_cov[i] >= 0.6) AS nice_matches,
    list_filter(target_titles, lambda t: {titles_match('title', 't')})[1] AS t_match,
    list_filter(secondary_titles, lambda t: {titles_match('title', 't')})[1] AS s_match,
    list_sort(list_intersect(title_words, known_words)) AS overlap,
    CASE WHEN years < min_experience_years THEN round_even((min_experience_years - years) * 100, 0)::DOUBLE / 100 ELSE 0.0::DOUBLE END AS gap,
    coalesce(years < min_experience_years, false) AS under,
    coalesce(years > max_experience_years, false) AS over,
    min_experience_years IS NULL AND max_experience_years IS NULL AS unstated,
    career_level IN ('SENIOR', 'LEAD', 'MANAGER', 'DIRECTOR', 'EXECUTIVE') AS is_senior,
    {norm('work_mode')} AS mode, {strip("coalesce(location, '')")} AS place,
    {strip("coalesce(industry, '')")} AS field, {norm('company_size')} AS size_word,
    coalesce(salary_max, salary_min) AS offer
  FROM x1),
x3 AS (
  SELECT *,
    round_even(cap_raw * damp, 0)::INT AS capability_score,
    round_even(ev_raw * damp, 0)::INT AS evidence_score,
    CASE WHEN t_match IS NOT NULL THEN 10 WHEN s_match IS NOT NULL THEN 7
      WHEN list_contains(target_families, title_family) THEN 5
      WHEN len(overlap) > 0 THEN round_even(10::DOUBLE * 0.3::DOUBLE * (len(overlap)::DOUBLE / len(title_words)), 0)::INT ELSE 0 END AS title_alignment_score,
    CASE WHEN unstated THEN 10
      WHEN under THEN round_even(10.0::DOUBLE * (CASE WHEN gap <= 1 THEN 0.85::DOUBLE WHEN gap <= 2 THEN 0.6::DOUBLE
        WHEN gap <= 3 THEN 0.4::DOUBLE WHEN gap <= 5 THEN 0.2::DOUBLE ELSE 0.05::DOUBLE END * CASE WHEN is_senior THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END), 0)::INT
      WHEN over THEN round_even(10.0::DOUBLE * greatest(0.7::DOUBLE, 1.0::DOUBLE - (years - max_experience_years) * 0.05::DOUBLE), 0)::INT
      ELSE 10 END AS experience_fit_score,
    CASE WHEN unstated THEN 'not specified' WHEN under THEN 'underqualified' WHEN over THEN 'overqualified' ELSE 'meets requirement' END AS exp_status,
    CASE WHEN career_level IN ('ENTRY_LEVEL', 'JUNIOR') THEN 10 WHEN career_level = 'MID_LEVEL' THEN 6
      WHEN career_level = 'UNKNOWN' THEN 5 ELSE 1 END AS career_level_fit,
    CASE WHEN mode = '' OR len(modes) = 0 OR list_contains(modes, mode) THEN 4 ELSE 0 END AS mode_points,
    CASE WHEN mode = 'remote' OR place = '' OR len(preferred_locations) = 0
      OR len(list_filter(preferred_locations, lambda l: {titles_match('place', 'l')})) > 0 THEN 4 ELSE 0 END AS place_points,
    field <> '' AND len(list_filter(avoid_industries, lambda a: {norm('a')} = lower(field))) > 0 AS avoided,
    len(list_filter(preferred_industries, lambda a: {titles_match('field', 'a')})) > 0 OR len(preferred_industries) = 0 AS liked,
    CASE WHEN size_word = '' OR len(sizes) = 0 OR list_contains(sizes, size_word) THEN 1 ELSE 0 END AS size_points,
    CASE WHEN offer IS NULL OR offer >= target_pay THEN 3
      WHEN offer >= floor_pay THEN round_even(3.0::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * ((offer - floor_pay) / greatest(target_pay - floor_pay, 1.0))), 0)::INT
      ELSE 0 END AS salary_fit,
    coalesce(offer < target_pay AND offer < floor_pay, false) AS low_pay
  FROM x2),
x4 AS (
  SELECT *, mode_points + place_points AS location_fit,
    CASE WHEN avoided THEN 0 WHEN field = '' OR liked THEN 3 ELSE 2 END + size_points AS industry_fit,
    avoided OR low_pay OR (len(required_skills) > 0 AND len(weak) >= greatest(1, len(required_skills) // 2)
      AND ev_raw < 12 * 0.3::DOUBLE) AS critical
  FROM x3),
x5 AS (
  SELECT *, greatest(0, least(100, role_family_score + capability_score + evidence_score + title_alignment_score
    + experience_fit_score + career_level_fit + location_fit + industry_fit + salary_fit)) AS score
  FROM x4),
x6 AS (
  SELECT *,
    CASE WHEN is_senior THEN 'SKIP' WHEN is_mismatch THEN 'SKIP' WHEN gap > 2 THEN 'SKIP' WHEN critical THEN 'SKIP'
      WHEN score < 75 THEN 'SKIP'
      WHEN score >= 85 AND career_level IN ('ENTRY_LEVEL', 'JUNIOR') AND gap <= 0 AND legitimate THEN 'AUTO_APPLY'
      ELSE 'REVIEW' END AS application_decision,
    CASE WHEN is_senior THEN concat('Career level is ', career_level, ' -- above your target (entry-level/junior).')
      WHEN is_mismatch THEN concat('Role family mismatch: ', family_status, '.')
      WHEN gap > 2 THEN concat('Experience gap of ', {general('gap')}, ' years exceeds the 2-year SKIP threshold.')
      WHEN critical THEN 'A critical requirement (avoided industry, below-minimum salary, or near-total skills mismatch) is missing.'
      WHEN score < 75 THEN concat('Score ', score, ' is below the 75 review threshold.')
      WHEN score >= 85 AND career_level IN ('ENTRY_LEVEL', 'JUNIOR') AND gap <= 0 AND legitimate THEN
        concat('Score ', score, ' >= 85, target role family, ', career_level, ' level, and the stated experience requirement does not exceed your professional experience.')
      ELSE concat('Worth a human look: ', array_to_string({known([
          "CASE WHEN score < 85 THEN concat('score ', score, ' is below the 85 auto-apply bar') END",
          "CASE WHEN career_level = 'MID_LEVEL' THEN 'career level is mid-level' END",
          f"CASE WHEN gap > 0 THEN concat('experience gap is ', {general('gap')}, ' years') END",
          "CASE WHEN NOT legitimate THEN 'listing legitimacy could not be fully confirmed' END"])}, '; '), '.') END AS decision_reason,
    CASE WHEN unstated THEN 'Job does not state an experience requirement'
      WHEN under THEN concat('Requires ', {general('min_experience_years')}, '+ years; you have ', {general('years')}, ' (gap: ', {general('gap')}, ' years)',
        CASE WHEN is_senior THEN ' -- senior-level role, scored conservatively' ELSE '' END)
      WHEN over THEN concat('Requires up to ', {general('max_experience_years')}, ' years; you have ', {general('years')})
      ELSE concat('Your ', {general('years')}, ' years fits the stated range') END AS exp_detail
  FROM x5),
x7 AS (
  SELECT *, list_concat(cap_evidence, strong) AS relevant,
    list_concat(cap_missing, {known([
        f"CASE WHEN len(weak) > 0 THEN 'Little to no evidence for: ' || {joined('weak', '; ')} END",
        "CASE WHEN is_mismatch THEN family_status END",
        f"CASE WHEN mode_points = 0 THEN concat('Work mode ', {pyquote('work_mode')}, ' is not in your preferred work modes') END",
        f"CASE WHEN place_points = 0 THEN concat('Location ', {pyquote('location')}, ' is outside your preferred locations') END",
        f"CASE WHEN avoided THEN concat('Industry ', {pyquote('industry')}, ' is on your avoid list') END",
        f"CASE WHEN low_pay THEN concat('Job offers up to ', {dbl_text('offer')}, ', below your minimum acceptable ', {whole_text('floor_pay')}) END"])}) AS missing,
    {known(["CASE WHEN exp_status = 'underqualified' THEN exp_detail END"])} AS exp_gaps,
    {known([
        f"CASE WHEN len(partial) > 0 THEN 'Only partial evidence for: ' || {joined('partial', '; ')} END",
        "CASE WHEN career_level = 'MID_LEVEL' THEN 'Career level reads as mid-level, above your primary target' END",
        "CASE WHEN role_family = 'UNKNOWN' THEN 'Could not reliably classify this job''s role family from its title' END",
        "CASE WHEN exp_status = 'overqualified' THEN exp_detail END",
        "CASE WHEN NOT legitimate THEN 'Listing is missing an application URL or has an unusually thin description' END"])} AS risk_list
  FROM x6)"""

MATCHES = f"{PF}, {CF}, {PAIR}"
