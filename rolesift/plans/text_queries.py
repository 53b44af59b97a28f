"""Queries of text functions over pages, documents, conversations and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolesift import rules
from rolesift.functions import claims, profile_text, quality, roles, spans, text
from rolesift.operators.identity import dedupe_key, identity_keys, sorted_skills
from rolesift.plans import oracle as o
from rolesift.plans import views

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = (function, sql)
        return function
    return add


def html_sql(x: str) -> str:
    steps = [("'<br\\s*/?>'", "chr(10)"), ("'<li[^>]*>'", "chr(10)"), ("'</(p|li|div)>'", "chr(10)"),
             ("'<[^>]+>'", "''"), ("'[ \\t]+'", "' '"), ("'\\n{2,}'", "chr(10)")]
    out = f"coalesce({x}, '')"
    for pattern, new in steps:
        out = f"regexp_replace({out}, {pattern}, {new}, 'g')"
    return o.strip(out)


def ascii_words(x: str) -> str:
    """Non-ASCII letters, marks and digits become '_', one for one: \\b then works
    as a Unicode boundary in an engine whose \\b knows ASCII only."""
    for kind in ("L", "M", "N"):
        x = f"regexp_replace({x}, '[^\\x00-\\x7F\\P{{{kind}}}]', '_', 'g')"
    return x


@query("strip_html", f"SELECT page_id, {html_sql('html')} AS text FROM pages")
def strip_html(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", text.strip_html("html").alias("text"))


@query("page_text_stats", f"WITH t AS (SELECT page_id, {html_sql('html')} AS x FROM pages) SELECT page_id, "
       "length(x)::INT AS chars, len(string_split(x, chr(10)))::INT AS lines, len(regexp_extract_all(lower(x), '[a-z0-9]+'))::INT AS words FROM t")
def page_text_stats(spark, sf):
    words = F.regexp_extract_all(F.lower("x"), F.lit("[a-z0-9]+"), F.lit(0))
    return views.table(spark, sf, "pages").select("page_id", text.strip_html("html").alias("x")).select(
        "page_id", F.length("x").alias("chars"), F.size(F.split("x", "\n")).alias("lines"), F.size(words).alias("words"))


# Years, pay and work mode as postings state them, around every part name.
REQUIREMENT = [
    ("p_partkey", "p_partkey"),
    ("note", "concat(p_name, CASE p_partkey % 9 WHEN 0 THEN concat(' needs ', p_size % 9, ' - ', p_size % 9 + 2, ' years') "
     "WHEN 1 THEN concat(' needs ', p_size % 12, '+ Years in ', p_type) WHEN 2 THEN concat(' asks MINIMUM ', p_size % 6, '.5 year of work') "
     "WHEN 3 THEN concat(' 1-', p_size, 'years, or ', p_size, '+ years') WHEN 4 THEN ' hybrid, partly remote' WHEN 5 THEN ' Remote only' "
     "WHEN 6 THEN ' remotely on-site' WHEN 7 THEN ' based in Pune' ELSE ' unspecified' END)"),
    ("pay", "CASE p_partkey % 7 WHEN 0 THEN concat('$', p_size, 'K - $', p_size + 40, '.5K') "
     "WHEN 1 THEN concat('pays $ ', p_size, ',000.50 – 90,000') WHEN 2 THEN concat('$', p_size, ' - ', p_size + 1, 'm a year') "
     "WHEN 3 THEN '$. - $5' WHEN 4 THEN NULL WHEN 5 THEN concat('$1.', p_size, 'M-$2M') ELSE 'by agreement' END"),
]
REQUIREMENT_SQL = views.ansi_view("part", REQUIREMENT)
RANGE, PLUS, LEAST = (
    "'(?i)(\\d+(?:\\.\\d+)?)\\s*-\\s*(\\d+(?:\\.\\d+)?)\\s*years?'", "'(?i)(\\d+(?:\\.\\d+)?)\\s*\\+\\s*years?'",
    "'(?i)minimum\\s*(\\d+(?:\\.\\d+)?)\\s*years?'")


def years_sql(x: str) -> tuple[str, str]:
    def number(pattern: str, group: int) -> str:
        return f"try_cast(nullif(regexp_extract({x}, {pattern}, {group}), '') AS DOUBLE)"
    return f"coalesce({number(RANGE, 1)}, {number(PLUS, 1)}, {number(LEAST, 1)})", number(RANGE, 2)


def mode_sql(x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    return (f"CASE WHEN contains({low}, 'hybrid') THEN 'hybrid' WHEN regexp_matches({ascii_words(low)}, '\\bremote\\b') THEN 'remote' "
            f"WHEN regexp_matches({low}, 'onsite|on-site|based at|based in') THEN 'onsite' END")


@query("parse_experience", f"SELECT p_partkey, {years_sql('note')[0]} AS low, {years_sql('note')[1]} AS high FROM {REQUIREMENT_SQL}")
def parse_experience(spark, sf):
    rows = views.spark_view(spark, sf, "part", REQUIREMENT).withColumn("y", text.parse_experience("note"))
    return rows.select("p_partkey", F.col("y.min").alias("low"), F.col("y.max").alias("high"))


SAL = "'\\$\\s*([\\d,.]+)\\s*([kKmM]?)\\s*[-–]\\s*\\$?\\s*([\\d,.]+)\\s*([kKmM]?)'"


def _pay(digits: int, suffix: str) -> str:
    return (f"(try_cast(replace(regexp_extract(pay, {SAL}, {digits}), ',', '') AS DOUBLE) * CASE lower({suffix}) "
            "WHEN 'k' THEN 1000.0::DOUBLE WHEN 'm' THEN 1000000.0::DOUBLE ELSE 1.0::DOUBLE END)")


_LO = _pay(1, f"regexp_extract(pay, {SAL}, 2)")
_HI = _pay(3, f"CASE WHEN regexp_extract(pay, {SAL}, 4) <> '' THEN regexp_extract(pay, {SAL}, 4) ELSE regexp_extract(pay, {SAL}, 2) END")


@query("parse_salary", f"SELECT p_partkey, CASE WHEN {_HI} IS NOT NULL THEN {_LO} END AS low, CASE WHEN {_LO} IS NOT NULL THEN {_HI} END AS high, "
       f"CASE WHEN {_LO} IS NOT NULL AND {_HI} IS NOT NULL THEN 'USD' END AS currency FROM {REQUIREMENT_SQL}")
def parse_salary(spark, sf):
    rows = views.spark_view(spark, sf, "part", REQUIREMENT).withColumn("s", text.parse_salary("pay"))
    return rows.select("p_partkey", F.col("s.min").alias("low"), F.col("s.max").alias("high"), "s.currency")


@query("work_mode", f"SELECT p_partkey, {mode_sql('note')} AS mode FROM {REQUIREMENT_SQL}")
def work_mode(spark, sf):
    return views.spark_view(spark, sf, "part", REQUIREMENT).select("p_partkey", text.work_mode("note").alias("mode"))


@query("contains_word", "SELECT doc_id, " + ", ".join(
    f"regexp_matches({ascii_words('lower(text)')}, '\\b({p})\\b') AS {n}" for n, p in (("has_the", "the"), ("has_les", "les|la"), ("has_der", "der|die"))) + " FROM documents")
def contains_word(spark, sf):
    low = F.lower("text")
    return views.table(spark, sf, "documents").select(
        "doc_id", text.contains_word(low, "the").alias("has_the"), text.contains_word(low, "les", "la").alias("has_les"),
        text.contains_word(low, "der", "die").alias("has_der"))


def slug_sql(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-')"


@query("make_id", f"SELECT page_id, array_to_string(list_filter(['greenhouse', CASE WHEN url <> '' THEN {slug_sql('url')} END, "
       f"CASE WHEN html <> '' THEN {slug_sql('html')} END, page_id::VARCHAR], lambda z: z IS NOT NULL), '-') AS id FROM pages")
def make_id(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", text.make_id(
        F.lit("greenhouse"), "url", "html", F.col("page_id").cast("string")).alias("id"))


LINKS = [("page_id", "page_id"), ("url", "CASE page_id % 6 WHEN 0 THEN concat(url, '/') WHEN 1 THEN concat('  ', upper(url), '?utm_x=1#frag') "
         "WHEN 2 THEN replace(url, 'https:', '') WHEN 3 THEN replace(replace(url, 'https://', ''), 'http://', '') "
         "WHEN 4 THEN NULL ELSE url END")]
LINKS_SQL = views.ansi_view("pages", LINKS)
URL_RE = "'^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)([^?#]*)'"


def url_sql(x: str) -> str:
    s = o.strip(x)
    return (f"CASE WHEN regexp_extract({s}, {URL_RE}, 1) <> '' THEN lower(regexp_extract({s}, {URL_RE}, 1)) || "
            f"rtrim(regexp_extract({s}, {URL_RE}, 2), '/') END")


@query("canonical_url", f"SELECT page_id, {url_sql('url')} AS canonical FROM {LINKS_SQL}")
def canonical_url(spark, sf):
    return views.spark_view(spark, sf, "pages", LINKS).select("page_id", text.canonical_url("url").alias("canonical"))


@query("url_duplicates", f"SELECT {url_sql('url')} AS canonical, count(*) AS pages, min(page_id) AS first_page FROM pages GROUP BY 1")
def url_duplicates(spark, sf):
    return views.table(spark, sf, "pages").groupBy(text.canonical_url("url").alias("canonical")).agg(
        F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"))


@query("word_tokens", f"SELECT doc_id, {o.joined('list_sort(' + o.tokens('text') + ')', ' ')} AS words FROM documents")
def word_tokens(spark, sf):
    return views.table(spark, sf, "documents").select(
        "doc_id", F.array_join(F.array_sort(text.word_tokens("text")), " ").alias("words"))


@query("normalize_word", f"SELECT id, {o.joined('list_sort(' + o.word_forms(o.tokens('concat(title, chr(32), description)'), rules.COLLECT_WORD_FORMS) + ')', ' ')} AS words FROM {views.POSTINGS_SQL}")
def normalize_word(spark, sf):
    tokens = text.word_tokens(F.concat_ws(" ", "title", "description"))
    return views.postings(spark, sf).select(
        "id", F.array_join(F.array_sort(text.normalize_words(tokens, rules.COLLECT_WORD_FORMS)), " ").alias("words"))


@query("significant_words", f"SELECT doc_id, len({o.significant('text')})::INT AS n, md5({o.joined(o.significant('text'), ' ')}) AS digest FROM documents")
def significant_words(spark, sf):
    words = text.significant_words("text")
    return views.table(spark, sf, "documents").select(
        "doc_id", F.size(words).alias("n"), F.md5(F.array_join(words, " ")).alias("digest"))


@query("normalize", f"SELECT doc_id, md5({o.norm('concat(chr(10), chr(160), text, chr(9))')}) AS digest FROM documents")
def normalize(spark, sf):
    padded = F.concat(F.lit("\n\xa0"), "text", F.lit("\t"))
    return views.table(spark, sf, "documents").select("doc_id", F.md5(text.normalize(padded)).alias("digest"))


@query("phrase_coverage", f"""SELECT a.conv_id, a.turn, {o.coverage('a.text', 'lower(b.text)')} AS coverage
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1""")
def phrase_coverage(spark, sf):
    """How far a turn's words occur in the turn before it."""
    turns = views.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lower("text").alias("blob"))
    return turns.join(before, ["conv_id", "turn"]).select(
        "conv_id", "turn", text.phrase_coverage("text", "blob").alias("coverage"))


PHRASES = ["Product Manager", "Business Analyst", "Program Coordinator", "Technical Program Manager"]


def _relevant_sql(phrases: list[str] = PHRASES) -> str:
    words = o.word_forms(o.tokens("title"), rules.COLLECT_WORD_FORMS)
    tests = [f"list_has_all({words}, {o.word_forms(o.tokens(o.quoted_in([p])), rules.COLLECT_WORD_FORMS)})" for p in phrases]
    return " OR ".join(tests)


@query("title_is_relevant", f"SELECT id, ({_relevant_sql()}) AS relevant FROM {views.POSTINGS_SQL}")
def title_is_relevant(spark, sf):
    phrases = text.phrase_token_sets(text.text_array(PHRASES))
    return views.postings(spark, sf).select("id", text.title_is_relevant("title", phrases).alias("relevant"))


PLACE_SQL = o.norm("location")


@query("location_is_relevant", f"SELECT id, ({PLACE_SQL} = '' OR regexp_matches({PLACE_SQL}, 'remote|work from home|wfh|pune|mumbai')) AS relevant FROM {views.POSTINGS_SQL}")
def location_is_relevant(spark, sf):
    return views.postings(spark, sf).select(
        "id", text.location_is_relevant("location", text.text_array(["Pune", "Mumbai"])).alias("relevant"))


@query("normalize_whitespace", "SELECT doc_id, " + o.strip(
    "array_to_string(list_transform(string_split(regexp_replace(regexp_replace(concat(text, chr(10), chr(10), chr(10), '  ', source, '  '), '[ \\t]{2,}', ' ', 'g'), "
    "'\\n{3,}', chr(10) || chr(10), 'g'), chr(10)), lambda l: rtrim(l, " + o.WS + ")), chr(10))") + " AS text FROM documents")
def normalize_whitespace(spark, sf):
    padded = F.concat("text", F.lit("\n\n\n  "), "source", F.lit("  "))
    return views.table(spark, sf, "documents").select("doc_id", quality.normalize_whitespace(padded).alias("text"))


# --- texts with claims ----------------------------------------------------------

URL_SQL = ("'(https?://\\S+|www\\.\\S+|[\\p{L}\\p{M}\\p{N}_][\\p{L}\\p{M}\\p{N}_.+-]*@[\\p{L}\\p{M}\\p{N}_-]+\\.[\\p{L}\\p{M}\\p{N}_.-]*[\\p{L}\\p{M}\\p{N}_])'")


def mask_sql(x: str) -> str:
    pieces, links = f"regexp_split_to_array({x}, {URL_SQL})", f"regexp_extract_all({x}, {URL_SQL})"
    return (f"array_to_string(list_transform(range(1, len({pieces}) + 1), lambda i: concat(({pieces})[i], "
            f"repeat('#', coalesce(length(({links})[i]), 0)::BIGINT))), '')")


@query("mask_safe_spans", f"SELECT text_id, {mask_sql('draft')} AS masked FROM {views.DRAFTS_SQL}")
def mask_safe_spans(spark, sf):
    return _drafts(spark, sf).select("text_id", quality.mask_safe_spans("draft").alias("masked"))


def _spans_sql(source: str, pattern: str) -> str:
    """[start, end] of all matches: lengths of the gaps and the matches summed up."""
    gaps, hits = f"regexp_split_to_array({source}, {pattern})", f"regexp_extract_all({source}, {pattern})"
    return (f"list_transform(range(1, len({hits}) + 1), lambda i: [list_sum(list_transform(({gaps})[:i], lambda g: length(g)))::BIGINT + "
            f"coalesce(list_sum(list_transform(({hits})[:i - 1], lambda h: length(h))), 0)::BIGINT, "
            f"list_sum(list_transform(({gaps})[:i], lambda g: length(g)))::BIGINT + list_sum(list_transform(({hits})[:i], lambda h: length(h)))::BIGINT])")


def _report_sql(label: str, spans_name: str) -> str:
    cut = "substring(t, greatest(s[1] - 15, 0) + 1, s[2] + 15 - greatest(s[1] - 15, 0))"
    return f"list_transform({spans_name}, lambda s: concat('{label}', {o.pyquote(cut)}))"


ABBR = "|".join(a.replace(".", "\\.") for a in rules.ABBREVIATIONS)


def issues_cte(source: str, key: str) -> str:
    return f"""w0 AS (SELECT {key}, draft AS t, {mask_sql('draft')} AS m FROM {source}),
w1 AS (SELECT *, {_spans_sql('t', "'[ \\t]{2,}|\\n{3,}'")} AS rep, {_spans_sql('m', "'[A-Za-z][,:;!?][A-Za-z]'")} AS punct,
  {_spans_sql('m', "'[A-Za-z]+\\.[A-Z][a-z]'")} AS period_all,
  list_filter(regexp_extract_all({ascii_words('t')}, '\\b\\w+\\b'), lambda x: regexp_full_match(x, '[a-z]{{22,}}')) AS fused FROM w0),
w2 AS (SELECT *, list_filter(period_all, lambda s: NOT regexp_matches({ascii_words('left(m, s[2] - 2)')}, '(?i)\\b(?:{ABBR})\\.$')) AS period FROM w1),
w3 AS (SELECT *, list_concat(list_concat(list_concat({_report_sql('Repeated whitespace near: ', 'rep')},
  {_report_sql('Missing space after punctuation near: ', 'punct')}), {_report_sql('Missing space after period near: ', 'period')}),
  list_transform(fused, lambda x: concat('Unusually long unbroken lowercase word (possible missing space, best-effort check): ''', x, ''''))) AS issues FROM w2)"""


def _drafts(spark, sf):
    return views.spark_view(spark, sf, "documents", views.DRAFTS)


@query("whitespace_issues", f"WITH {issues_cte(views.DRAFTS_SQL, 'text_id')} SELECT text_id, array_to_string(issues, '|') AS issues, len(issues)::INT AS n FROM w3")
def whitespace_issues(spark, sf):
    rows = _drafts(spark, sf).withColumn("i", quality.whitespace_issues("draft"))
    return rows.select("text_id", F.array_join("i", "|").alias("issues"), F.size("i").alias("n"))


@query("whitespace_issues_turns", f"WITH {issues_cte(views.TURNS_SQL, 'conv_id, turn')} SELECT conv_id, turn, array_to_string(issues, '|') AS issues FROM w3")
def whitespace_issues_turns(spark, sf):
    rows = views.spark_view(spark, sf, "conversations", views.TURNS)
    return rows.select("conv_id", "turn", F.array_join(quality.whitespace_issues("draft"), "|").alias("issues"))


@query("match_spans", f"""WITH s AS (SELECT doc_id, {_spans_sql('text', "'[0-9]+'")} AS found FROM documents)
  SELECT doc_id, array_to_string(list_transform(found, lambda s: concat(s[1], '-', s[2])), ',') AS spans FROM s""")
def match_spans(spark, sf):
    shown = F.transform(spans.match_spans("text", "[0-9]+"), lambda s: F.concat_ws("-", s["start"], s["end"]))
    return views.table(spark, sf, "documents").select("doc_id", F.array_join(shown, ",").alias("spans"))


def _gap_list(x: str) -> str:
    lists = [f"regexp_extract_all({ascii_words(x)}, '(?i){p}')".replace("'(?i)" + p, "'(?i)" + p.replace("'", "''")) for p in rules.GAP_PATTERNS]
    return "flatten([" + ", ".join(lists) + "])"


@query("gap_language", f"SELECT text_id, len({_gap_list('draft')})::INT AS mentions, array_to_string({_gap_list('draft')}, '|') AS hits FROM {views.DRAFTS_SQL}")
def gap_language(spark, sf):
    hits = claims.gap_mentions("draft")
    return _drafts(spark, sf).select("text_id", F.size(hits).alias("mentions"), F.array_join(hits, "|").alias("hits"))


YEARS_RE = "'(?i)(\\d+(?:\\.\\d+)?)\\+?\\s*years?\\s+(?:of\\s+)?(?:professional\\s+|full-?time\\s+)?experience'"
YEARS_ISSUES = (
    f"list_transform(list_filter(list_transform(regexp_extract_all(draft, {YEARS_RE}, 1), lambda n: n::DOUBLE), lambda n: n > coalesce(years, 0) + 0.5), "
    f"lambda n: concat('Text claims ', {o.general('n')}, '+ years of experience; candidate profile verifies only ', {o.general('coalesce(years, 0.0::DOUBLE)')}, ' year(s).'))")
NUM_ISSUES = (
    f"list_transform(list_filter(regexp_extract_all({ascii_words('draft')}, '\\b(\\d+(?:\\.\\d+)?%|\\d{{2,}}\\+?)\\b', 1), lambda v: NOT contains(blob, v)), "
    f"lambda v: concat('Unsupported quantified claim: ', {o.pyquote('v')}, ' does not appear in the candidate''s evidence.'))")
_PH = f"regexp_extract_all({ascii_words('draft')}, '\\b(?:at|for)\\s+([A-Z][a-zA-Z&]+(?:\\s+[A-Z][a-zA-Z&]+){{0,3}})\\b', 1)"
EMP_ISSUES = (
    f"list_transform(list_filter({_PH}, lambda p: NOT (lower(p) IN ({o.quoted_in(rules.GENERIC_CAPITALIZED_TERMS)}) "
    "OR (coalesce(company, '') <> '' AND (contains(lower(company), lower(p)) OR contains(lower(p), lower(company)))) "
    "OR len(list_filter(employers, lambda e: contains(lower(e), lower(p)) OR contains(lower(p), string_split(lower(e), ' ')[1]))) > 0)), "
    f"lambda p: concat('Mentions an employer-like name not in the verified profile: ', {o.pyquote('p')}))")


def _gap_issue(maximum: int) -> str:
    return (f"CASE WHEN len({_gap_list('draft')}) > {maximum} THEN [concat('Explicit experience-gap language found (', len({_gap_list('draft')}), "
            f"' mention(s), max {maximum} allowed): ', {o.pylist(_gap_list('draft'))})] ELSE []::VARCHAR[] END")


def _texts(column):
    return F.array_join(column, "|").alias("issues")


@query("check_years_claims", f"SELECT text_id, array_to_string({YEARS_ISSUES}, '|') AS issues FROM {views.DRAFTS_SQL}")
def check_years_claims(spark, sf):
    return _drafts(spark, sf).select("text_id", _texts(claims.check_years_claims("draft", "years")))


@query("check_numeric_claims", f"SELECT text_id, array_to_string({NUM_ISSUES}, '|') AS issues FROM {views.DRAFTS_SQL}")
def check_numeric_claims(spark, sf):
    return _drafts(spark, sf).select("text_id", _texts(claims.check_numeric_claims("draft", "blob")))


@query("check_employers", f"SELECT text_id, array_to_string({EMP_ISSUES}, '|') AS issues FROM {views.DRAFTS_SQL}")
def check_employers(spark, sf):
    return _drafts(spark, sf).select("text_id", _texts(claims.check_employers("draft", "employers", "company")))


@query("check_gap_language", f"SELECT text_id, array_to_string({_gap_issue(1)}, '|') AS issues FROM {views.DRAFTS_SQL}")
def check_gap_language(spark, sf):
    return _drafts(spark, sf).select("text_id", _texts(claims.check_gap_language("draft", 1)))


VALIDATION = f"list_concat(list_concat(list_concat({YEARS_ISSUES}, {EMP_ISSUES}), {NUM_ISSUES}), {_gap_issue(0)})"


@query("validate_content", f"WITH v AS (SELECT text_id, {VALIDATION} AS i FROM {views.DRAFTS_SQL}) SELECT text_id, "
       "CASE WHEN len(i) > 0 THEN 'NEEDS_REVIEW' ELSE 'OK' END AS status, array_to_string(i, '|') AS issues FROM v")
def validate_content(spark, sf):
    issues = claims.validation_issues("draft", "years", "employers", "blob", "company", 0)
    return _drafts(spark, sf).withColumn("i", issues).select(
        "text_id", claims.validation_status("i").alias("status"), _texts("i"))


# --- identity --------------------------------------------------------------------

SKILLS_SQL = f"list_sort(list_transform(required_skills, lambda s: lower({o.strip('s')})))"


@query("sorted_skills", f"SELECT id, {o.joined(SKILLS_SQL, '|')} AS skills FROM {views.POSTINGS_SQL}")
def sorted_skills_query(spark, sf):
    return views.postings(spark, sf).select("id", F.array_join(sorted_skills("required_skills"), "|").alias("skills"))


KEY3_SQL = (f"concat_ws(chr(31), {o.norm('company')}, {o.norm('title')}, {o.norm('location')}, "
            f"CASE WHEN len({SKILLS_SQL}) = 0 THEN '[]' ELSE concat('[\"', {o.joined(SKILLS_SQL, chr(34) + ',' + chr(34))}, '\"]') END)")
KEY1_SQL = "CASE WHEN coalesce(source, '') <> '' AND coalesce(source_job_id, '') <> '' THEN concat(source, chr(31), source_job_id) END"
KEYS_SQL = " UNION ALL ".join([
    f"SELECT *, 1 AS tier, {KEY1_SQL} AS key FROM p", f"SELECT *, 2, {url_sql('application_url')} FROM p",
    f"SELECT *, 3, {KEY3_SQL} FROM p"])


@query("dedupe_key", f"SELECT id, {KEY3_SQL} AS key FROM {views.POSTINGS_SQL}")
def dedupe_key_query(spark, sf):
    return views.postings(spark, sf).select("id", dedupe_key("company", "title", "location", "required_skills").alias("key"))


@query("identity_keys", f"WITH p AS (SELECT * FROM {views.POSTINGS_SQL}), k AS ({KEYS_SQL}) SELECT id, tier, key FROM k WHERE key IS NOT NULL")
def identity_keys_query(spark, sf):
    return views.postings(spark, sf).select("id", F.explode(identity_keys()).alias("k")).select("id", "k.tier", "k.key")


# --- helpers -----------------------------------------------------------------------

@query("iso_date10", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d')::DATE END AS day FROM events")
def iso_date10(spark, sf):
    stamp = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return views.table(spark, sf, "events").select("event_id", text.iso_date10(stamp).alias("day"))


@query("epoch_millis_to_date", "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN ts::DATE END AS day FROM events")
def epoch_millis_to_date(spark, sf):
    millis = F.when(F.col("event_id") % 7 != 0, F.unix_millis(F.col("ts").cast("timestamp")))
    return views.table(spark, sf, "events").select("event_id", text.epoch_millis_to_date(millis).alias("day"))


# Markdown profiles: the sections of a candidate, one per customer.
PROFILE = [
    ("candidate_id", "concat('C', c_custkey)"),
    ("markdown", "concat('# Profile', chr(10), chr(10), '## Contact', chr(10), chr(10), '- Name: ', c_name, chr(10), chr(10), "
     "'## Experience overview', chr(10), chr(10), CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('- Current / most recent role: Analyst, ', c_mktsegment, "
     "' Works — Pune (2025)', chr(10)) END, '- Previous roles:', chr(10), '  - Intern, Beta ', c_nationkey, ' - Delhi (2023)', chr(10), "
     "'  - Clerk, ', lower(c_mktsegment), ' works — Rome', chr(10), '  - Freelancer', chr(10), "
     "CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat(chr(10), '## Education', chr(10), '- School ', c_nationkey, ', Town', chr(10)) END)"),
]
PROFILE_SQL = views.ansi_view("customer", PROFILE)
SPARK_PROFILE = [(n, e.replace("chr(10)", "char(10)")) for n, e in PROFILE]


@query("md_section", "SELECT concat('C', c_custkey) AS candidate_id, concat('- Name: ', c_name) AS contact, CASE WHEN c_custkey % 4 = 0 THEN '' "
       "ELSE concat('- School ', c_nationkey, ', Town') END AS education, '' AS absent FROM customer")
def md_section(spark, sf):
    rows = views.spark_view(spark, sf, "customer", SPARK_PROFILE)
    return rows.select("candidate_id", profile_text.md_section("markdown", "Contact").alias("contact"),
                       profile_text.md_section("markdown", "Education").alias("education"),
                       profile_text.md_section("markdown", "Awards").alias("absent"))


@query("verified_employers", "SELECT concat('C', c_custkey) AS candidate_id, CASE WHEN c_custkey % 3 = 0 THEN concat('Beta ', c_nationkey, '|', lower(c_mktsegment), ' works') "
       "ELSE concat(c_mktsegment, ' Works|Beta ', c_nationkey) END AS employers FROM customer")
def verified_employers(spark, sf):
    rows = views.spark_view(spark, sf, "customer", SPARK_PROFILE)
    return rows.select("candidate_id", F.array_join(profile_text.verified_employers("markdown"), "|").alias("employers"))


@query("employers_distinct", "SELECT doc_id % 50 AS grp, lower(source) AS name, min(doc_id) AS first_doc FROM documents GROUP BY 1, 2")
def employers_distinct(spark, sf):
    return views.table(spark, sf, "documents").groupBy((F.col("doc_id") % 50).alias("grp"), F.lower("source").alias("name")).agg(
        F.min("doc_id").alias("first_doc"))


@query("role_family_of_texts", f"SELECT doc_id, {o.family('source', 'text')} AS family FROM documents")
def role_family_of_texts(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", roles.role_family("source", "text").alias("family"))


LISTS = [("p_partkey", "p_partkey"), ("lines", "concat('- ', p_name, chr(10), chr(10), ' • ', p_type, ' -', chr(10), '3+ Years of work', chr(9))")]
LISTS_SQL = views.ansi_view("part", LISTS)
SPARK_LISTS = [(n, e.replace("chr(", "char(")) for n, e in LISTS]


@query("bullets", f"SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(lines, chr(10)), lambda l: trim(l, concat('-• ', chr(9)))), lambda l: l <> ''), '|') AS items FROM {LISTS_SQL}")
def bullets(spark, sf):
    return views.spark_view(spark, sf, "part", SPARK_LISTS).select("p_partkey", F.array_join(text.bullets("lines"), "|").alias("items"))


@query("is_experience_line", f"SELECT p_partkey, {years_sql('note')[0]} IS NOT NULL AS stated FROM {REQUIREMENT_SQL}")
def is_experience_line(spark, sf):
    return views.spark_view(spark, sf, "part", REQUIREMENT).select("p_partkey", text.is_experience_line("note").alias("stated"))


@query("workday_field", "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN concat(p_name, ', SQL') END AS field FROM part")
def workday_field(spark, sf):
    note = F.expr("concat('About us', char(10), CASE WHEN p_partkey % 3 <> 0 THEN concat('Must have skills :  ', p_name, ', SQL ') ELSE 'Nothing' END, char(10), p_type)")
    return views.table(spark, sf, "part").select("p_partkey", text.labelled_field(note, rules.WORKDAY_REQUIRED_LABEL).alias("field"))


@query("lever_list_text", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('SQL', chr(10), source) WHEN 1 THEN lang END AS needs FROM documents")
def lever_list_text(spark, sf):
    """First list whose label fits; a later list with a fitting label is ignored."""
    from rolesift.operators.normalize import lever_list_text as first_list
    lists = F.expr("array(named_struct('text', 'Perks', 'content', text), named_struct('text', CASE WHEN doc_id % 3 = 0 THEN 'Key Skills' END, 'content', "
                   "concat('<li>SQL</li><li>', source, '</li>')), named_struct('text', CASE WHEN doc_id % 3 < 2 THEN 'SKILLSET' ELSE 'Place' END, 'content', lang))")
    return views.table(spark, sf, "documents").select("doc_id", first_list(lists, rules.LEVER_SKILL_LABELS).alias("needs"))
