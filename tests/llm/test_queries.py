"""Registered queries beside their SQL, and the pipeline stage by stage beside brute force, on the smallest tables."""

import zlib
from pathlib import Path

import pytest

import corpus_pipeline
from rolesift.llm import packing, queries, repetition
from rolesift.llm.base import written
from tests.llm import odd

DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DIR.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def database():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in ("documents", "pages", "labels", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return connection


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in queries.QUERIES.items() if sql))
def test_same_rows(spark, database, name):
    function, sql = queries.QUERIES[name]
    frame = function(spark, str(DIR))
    columns = sorted(frame.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect())
    cursor = database.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in queries.QUERIES.items() if not sql))
def test_runs(spark, name):
    frame = queries.QUERIES[name][0](spark, str(DIR))
    assert "doc_id" in frame.columns and not frame.isEmpty()


def test_repeated_passages_are_found(spark):
    """Documents that share a window of 50 words with an earlier one, and no others with long texts of their own."""
    rows = spark.read.parquet(f"{DIR}/documents.parquet").orderBy("doc_id").collect()
    seen, want = {}, set()
    for r in rows:
        words = odd.WORD.findall(r.text.lower())
        for i in range(len(words) - 49):
            if seen.setdefault(tuple(words[i:i + 50]), r.doc_id) != r.doc_id:
                want.add(r.doc_id)
    found = {r.doc_id for r in queries.repeated_passages(spark, str(DIR)).collect()}
    assert want <= found


def pairs(df):
    return [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]


def good(text):
    rules, words = repetition.Rules(), odd.WORD.findall(text or "")

    def inside(size):
        places = {}
        for i in range(len(words) - size + 1):
            places.setdefault(tuple(words[i:i + size]), []).append(i)
        return len({p for at in places.values() if len(at) > 1 for i in at for p in range(i, i + size)})

    return (len(words) >= rules.least_words and 100 * inside(3) <= rules.max_repeat_percent * len(words)
            and 100 * inside(rules.min_words) <= rules.max_covered_percent * len(words) and not inside(rules.max_longest + 1))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    before = pairs(docs)
    docs = written(stages["quality_rules"](spark, docs, str(DIR)), "stage")
    assert pairs(docs) == [(i, t) for i, t in before if good(t)]

    before = pairs(docs)
    docs = written(stages["line_dedup"](spark, docs, str(DIR)), "stage")
    assert pairs(docs) == [(i, t) for (i, _), t in zip(before, odd.without_lines(before), strict=True)]

    before = pairs(docs)
    docs = written(stages["near_duplicates"](spark, docs, str(DIR)), "stage")
    least = odd.classes(before, 5)
    assert pairs(docs) == [(i, t) for i, t in before if least[i] == i]

    before = docs.collect()
    mixed = written(stages["source_mix"](spark, docs, str(DIR)), "stage")
    assert mixed.columns == docs.columns
    sizes = {r.doc_id: len(odd.WORD.findall(r.text)) for r in before}
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 2 and set(copies) <= set(sizes)
    total = sum(sizes.values())
    assert sum(sizes[i] * n for i, n in copies.items()) == pytest.approx(1.5 * total, rel=0.2)

    out = stages["packing"](spark, mixed, str(DIR)).collect()
    tokenizer = packing.WordEncoder(None).tokenizer
    ids = {r.doc_id: tokenizer.encode(r.text, add_special_tokens=False).ids + [2] for r in before}
    lengths = {}
    for r in out:
        piece = ids[r.doc_id][r.start:r.start + r.length]
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece)) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {i: len(ids[i]) * n for i, n in copies.items()}
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(x for _, x in sorted(p)) <= 4096 and [o for o, _ in sorted(p)][0] == 0 for p in places.values())
