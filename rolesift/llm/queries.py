"""Registered queries of the operators, each over its whole table, and the same results as SQL where SQL has them.

An entry is ``name: (function(spark, folder), sql or None)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.llm import audit_queries, license_scan, line_dedup, mixing, near_dups, packing, repetition, secret_scan, topk_search, unit_dedup, warc_index
from rolesift.session import scratch_folder

MIX_WEIGHTS = [5, 2, 1]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def repetition_rules(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.measure(table(spark, folder, "documents"), with_spans=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered")


def incremental_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = line_dedup.remove_lines(line_dedup.index_of(docs), docs)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), MIX_WEIGHTS).select(
        "doc_id", "size", "source_size", "target", "taken")


def secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digest_columns(secret_scan.find_secrets(table(spark, folder, "documents")))


def packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), with_ids=False)


def capture_histories(spark: SparkSession, folder: str) -> DataFrame:
    index = warc_index.capture_index(table(spark, folder, "pages"), scratch_folder(spark, "archives"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "timestamp")


def near_duplicate_classes(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, folder, "documents"), shingle_words=2).select(
        "doc_id", "n_shingles", "component_id", "kept")


def repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return unit_dedup.repeated_units(table(spark, folder, "documents")).drop("key")


def licenses(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, folder, "documents"))


def best_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return topk_search.search(topk_search.build_index(docs), docs.filter("doc_id % 100 = 0"))


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_RULES = repetition.Rules()


def _windows(size: int) -> str:
    """Places of a text's windows of so many words that occur twice in it."""
    return f"""
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, md5(array_to_string(list_slice(words, i, i + {size - 1}), ' '))) AS times
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - {size - 2})) AS i FROM w WHERE len(words) >= {size}))
  WHERE times > 1"""


def _inside(windows: str, size: int) -> str:
    return f"SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {size})) AS p FROM {windows}) GROUP BY doc_id"


REPETITION_SQL = f"""
WITH w AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
w3 AS ({_windows(3)}),
wk AS ({_windows(_RULES.min_words)}),
wl AS ({_windows(_RULES.max_longest + 1)}),
c3 AS ({_inside('w3', 3)}),
ck AS ({_inside('wk', _RULES.min_words)}),
cl AS (SELECT DISTINCT doc_id FROM wl),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM
  (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE trim(line, {_BLANKS}) <> '' GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(c3.n, 0) AS n_repeat_words, coalesce(ck.n, 0) AS n_covered,
    cl.doc_id IS NOT NULL AS too_long
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN c3 USING (doc_id) LEFT JOIN ck USING (doc_id) LEFT JOIN cl USING (doc_id)),
b AS (SELECT *, n_words < {_RULES.least_words} OR 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * n_covered <= {_RULES.max_covered_percent} * n_words AND NOT too_long AS kept, n_covered
FROM b"""

LINE_DEDUP_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, {_BLANKS}), {_LOWER}) AS key FROM l),
hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, hot.key IS NOT NULL AS dropped FROM k LEFT JOIN hot USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

MIX_SQL = f"""
WITH r AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
    CAST('0x' || substr(md5(concat_ws('|', 'mix', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 10) AS BIGINT) AS hash
  FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM r GROUP BY source),
n AS (SELECT *, list_value(5, 2, 1)[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2 * source_size AS most,
    sum(source_size) OVER () * 150 / 100.0::DOUBLE AS share FROM s),
f AS (SELECT *, (share - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER o AS place
  FROM n WINDOW o AS (ORDER BY most / w::DOUBLE, source NULLS LAST)),
o AS (SELECT min(place) AS place FROM f WHERE w * level <= most),
t AS (SELECT f.source, source_size, CASE WHEN o.place IS NULL OR f.place < o.place THEN most::DOUBLE
    ELSE w * (SELECT level FROM f WHERE place = (SELECT place FROM o)) END AS target FROM f, o),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t),
q AS (SELECT *, target - passes * source_size AS rest FROM p),
a AS (SELECT source, hash, sum(size) AS words FROM r GROUP BY source, hash),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY hash) - words AS below FROM a),
h AS (SELECT c.source, min(CASE WHEN 2 * (rest - below) >= words THEN hash + 1 ELSE hash END) AS threshold
  FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source WHERE below < rest AND rest <= below + words GROUP BY c.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(size * (passes + CASE WHEN hash < coalesce(threshold, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source LEFT JOIN h ON r.source IS NOT DISTINCT FROM h.source"""

WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload,
    regexp_extract(url, '^[a-z]+://([^/?#]*)([^?#]*)(\?[^#]*)?', ['host', 'path', 'query']) AS u FROM pages),
d AS (SELECT page_id, payload, u, octet_length(encode(payload)) AS payload_bytes,
    translate(list_aggregate(list_transform(range(8), lambda i:
      to_base(CAST('0x' || substr(sha1(payload), CAST(1 + 5 * i AS BIGINT), 5) AS BIGINT), 32, 4)), 'string_agg', ''),
      '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to,
  array_to_string(list_reverse(string_split(lower(u.host), '.')), ',') || ')' || coalesce(nullif(lower(u.path), ''), '/')
    || lower(u.query) AS urlkey,
  strftime(make_timestamp((1767225600 + page_id % 31536000) * 1000000), '%Y%m%d%H%M%S') AS timestamp
FROM f"""

NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_LOWER}), '[\\x20\\x09-\\x0D]+'),
    lambda x: x <> '') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words ELSE
    list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingle FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y USING (shingle)
  WHERE x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * common >= 80 * (na.n + nb.n - common)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) m USING (doc_id)"""

def _license_sql() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    known = ", ".join(f"({quoted(s)}, {quoted(f'<{i}>')})" for i, s in license_scan.SENTENCES.items())
    steps, last = [], "s0"
    for number, (licence, ids) in enumerate(license_scan.RULES, 1):
        sequence = quoted("".join(f"<{i}>" for i in ids))
        steps.append(f"""s{number} AS (SELECT doc_id, n_sentences, replace(seq, {sequence}, '{license_scan.TAKEN}') AS seq,
  CASE WHEN contains(seq, {sequence}) AND NOT list_contains(found, {quoted(licence)}) THEN list_append(found, {quoted(licence)}) ELSE found END AS found FROM {last})""")
        last = f"s{number}"

    def reading(name: str, end: str) -> str:
        """Known sentences of a reading with the letters and digits before and up to their end."""
        return f"""{name}_p AS (SELECT doc_id, unnest(string_split_regex(t, '{end}')) AS s, generate_subscripts(string_split_regex(t, '{end}'), 1) AS i FROM d),
{name}_s AS (SELECT doc_id, s, length(regexp_replace(s, '[^A-Za-z0-9]+', '', 'g')) AS size, sum(size) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM {name}_p),
{name} AS (SELECT doc_id, stop - size AS start, stop, id FROM {name}_s JOIN k
  ON k.s = trim(regexp_replace(translate({name}_s.s, {_LOWER}), '[^a-z0-9]+', ' ', 'g')))"""

    lines, sentences = reading("a", license_scan.LINE_END), reading("b", license_scan.SENTENCE_END)
    return f"""
WITH k(s, id) AS (VALUES {known}), d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{lines},
{sentences},
u AS (SELECT *, stop > coalesce(max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fresh
  FROM (SELECT * FROM a UNION ALL SELECT * FROM b)),
g AS (SELECT doc_id, string_agg(id, '' ORDER BY start, stop DESC, id) AS seq, count(*) AS n FROM u WHERE fresh GROUP BY doc_id),
s0 AS (SELECT d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(seq, '') AS seq, CAST([] AS VARCHAR[]) AS found FROM d LEFT JOIN g USING (doc_id)),
{', '.join(steps)}
SELECT doc_id, array_to_string(found, ',') AS licences, n_sentences, CAST(length(seq) - length(replace(seq, '<', '')) AS BIGINT) AS n_left FROM {last}"""


SEARCH_SQL = f"""
WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), {_LOWER}), '[\\x20\\x09-\\x0D]+'),
    lambda x: x <> '')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM w GROUP BY doc_id, term),
l AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
g AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(n) FROM l)::DOUBLE / (SELECT count(*) FROM documents) AS mean),
f AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY term),
i AS (SELECT p.doc_id, p.term, CAST(round_even(1000000 * (ln(1 + (g.n - df + 0.5) / (df + 0.5))
    * (tf * (1.2::DOUBLE + 1) / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * l.n / g.mean)))), 0) AS BIGINT) AS impact
  FROM p JOIN f USING (term) JOIN l USING (doc_id), g),
s AS (SELECT q.doc_id AS query_id, i.doc_id, CAST(sum(impact) AS BIGINT) AS score FROM p q JOIN i USING (term)
  WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, i.doc_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s QUALIFY rank <= 10"""

QUERIES = {
    "op1_repetition_rules": (repetition_rules, REPETITION_SQL),
    "op2_packing": (packed_sequences, None),
    "op3_line_dedup": (incremental_line_dedup, LINE_DEDUP_SQL),
    "op4_warc_index": (capture_histories, WARC_SQL),
    "op5_source_mix": (source_mix, MIX_SQL),
    "op6_near_duplicates": (near_duplicate_classes, NEAR_SQL),
    "op7_secret_scan": (secrets, None),
    "op8_unit_dedup": (repeated_passages, None),
    "op9_license_scan": (licenses, _license_sql()),
    "op10_topk_search": (best_documents, SEARCH_SQL),
} | audit_queries.QUERIES
