"""Registered queries of the quality model, conversation repair and filter audit, and their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.llm import conversation_repair, filter_audit, quality_model
from rolesift.llm.base import written


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def document_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def repaired_conversations(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    rows = conversation_repair.damaged(conversations)
    found = written(conversation_repair.audits(rows, conversations), "audits")
    digests = written(conversation_repair.text_digests(conversation_repair.repaired(rows, found)), "digests")
    # NULL conversations meet too: ids are compared with their NULLs.
    both = found.join(digests.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return both.withColumn("repaired_sha256", F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest()))).drop("_conv", "sha256")


def filter_interactions(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


# The 256 values of the checksum's byte steps, from its polynomial: eight shifts each.
_SHIFT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_CRC_TABLE = ", ".join(
    ["c0 AS (SELECT i AS b, i::BIGINT AS c FROM range(256) r(i))",
     *[f"c{k + 1} AS (SELECT b, {_SHIFT} AS c FROM c{k})" for k in range(8)],
     "crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM c8)"])


def _least(options: list[str]) -> str:
    return f"least({', '.join(options)})"


def _edit(letter: str, cost: str, behind: str) -> str:
    """Cost (nine digits) and letters of an edit in front of what follows it."""
    return f"(lpad((substr({behind}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({behind}, 10))"


def _state(before: str, keeps: str, kept: str, made: str) -> str:
    """Best edit of a turn in state ``before``; ``keeps``: roles that fit, ``kept``: the state behind by role."""
    keep = f"CASE WHEN fault < 2 AND {keeps} THEN {_edit('K', '3 * fault', kept)} ELSE '9' END"
    change = f"CASE WHEN fault < 2 THEN {_edit('R', '3 + 3 * fault', made)} ELSE '9' END"
    return _least([_edit("D", "4", before), keep, change])


REPAIR_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
r0 AS (SELECT conv_id, turn::BIGINT AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
      lambda x: ord(x)::BIGINT)), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295::BIGINT) % 20 AS h FROM conversations, crc),
r1 AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS twice FROM r0 WHERE h <> 0),
r2 AS (SELECT *, row_number() OVER w AS i, substr(role, 1, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, twice) > 1 AS again
  FROM r1 WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), twice)),
r AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 3 WHEN again THEN 2
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 1 ELSE 0 END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM r2),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 3) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
v AS (SELECT conv_id, n AS i, '000000000' AS s0, '000000006II' AS s1, '000000003I' AS s2, '000000000' AS s3 FROM n
  UNION ALL
  SELECT conv_id, i, {_least(['b0', _edit('I', '3', 'b2')])}, {_least(['b1', _edit('I', '3', 'b2')])}, b2, {_least(['b3', _edit('I', '3', 'b2')])}
  FROM (SELECT conv_id, i, b0, b1, {_least(['b2', _edit('I', '3', 'b3')])} AS b2, b3 FROM (
    SELECT v.conv_id, v.i - 1 AS i,
      {_state('s0', "initial IN ('s', 'u')", "CASE initial WHEN 's' THEN s1 ELSE s2 END", 's2')} AS b0,
      {_state('s1', "initial = 'u'", 's2', 's2')} AS b1,
      {_state('s2', "initial = 'a'", 's3', 's3')} AS b2,
      {_state('s3', "initial = 'u'", 's2', 's2')} AS b3
    FROM v JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.i = v.i))),
a AS (SELECT conv_id, substr(s0, 1, 9)::BIGINT AS cost, substr(s0, 10) AS audit FROM v WHERE i = 0),
e AS (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS p FROM a),
f AS (SELECT conv_id, p, substr(audit, p, 1) AS letter, len(replace(substr(audit, 1, p), 'I', '')) AS i FROM e),
-- A turn is the user's when an even number of turns behind a system turn stand before it.
g AS (SELECT f.conv_id, p, letter, text, r.role, row_number() OVER w AS place, max(coalesce(initial = 's' AND letter = 'K', false)::INT) OVER w AS system
  FROM f LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i AND letter <> 'I' WHERE letter <> 'D'
  WINDOW w AS (PARTITION BY f.conv_id ORDER BY p)),
t AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS repaired FROM g GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id"""

_LETTERS = "unnest(['A', 'B', 'C', 'D', 'E'])"
AUDIT_SQL = f"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
f AS (SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS MATERIALIZED (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x AS (SELECT {_LETTERS} AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, 1 << (ascii(letter) - 65) AS own,
    list_sum(list_transform(string_split(left(filter_order, step - 1), ''), lambda y: CASE WHEN y = '' THEN 0 ELSE 1 << (ascii(y) - 65) END))::INT AS gone
  FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
q AS (SELECT part, filter_order, step, letter, sum(n) FILTER (mask & (gone | own) = 0) AS kept, sum(n) FILTER (mask & own <> 0 AND mask & gone = 0) AS removed,
    sum(n) FILTER (mask & own <> 0 AND mask & gone <> 0) AS redundant, sum(n) FILTER (mask = own) AS unique_fails,
    sum(good) FILTER (mask & own <> 0 AND mask & gone = 0) AS good_lost, sum(toxic) FILTER (mask & own <> 0 AND mask & gone = 0) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost'))},
  coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley FROM q"""

QUERIES = {
    "op11_quality_model": (document_quality, None),
    "op12_conversation_repair": (repaired_conversations, REPAIR_SQL),
    "op13_filter_audit": (filter_interactions, AUDIT_SQL),
}
