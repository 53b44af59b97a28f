"""Operators beside brute force, and cases that once went wrong."""

import hashlib
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from rolesift.llm import license_scan, line_dedup, near_dups, packing, queries, unit_dedup, warc_index
from rolesift.llm.base import written
from rolesift.session import scratch_folder
from tests.llm import odd

DIR = Path("/root/testdata/sf0.001")
FULL, GOLDEN = 2**64 - 1, 0x9E3779B97F4A7C15


# Repeated units

def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & FULL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & FULL
    return x ^ (x >> 31)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_units(text, least):
    """(digest, kind, line, start, end, place of the first word, words) of a text, one unit after the other."""
    text = text or ""
    words = [(m.start(), m.end(), text.count("\n", 0, m.start()), lower(m[0])) for m in odd.WORD.finditer(text)]
    n, names = len(words), [w[3] for w in words]
    hashes = [mix(sum(mix((ord(c) + (i + 1) * GOLDEN) & FULL) for i, c in enumerate(w)) & FULL) for w in names]
    line = [w[2] for w in words]
    pair = [mix((hashes[i] + (hashes[i + 1] if i + 1 < n and line[i + 1] == line[i] else 7) * GOLDEN) & FULL) for i in range(n)]
    runs = [0] * n
    for i in range(1, n):
        runs[i] = runs[i - 1] + 1 if pair[i] == pair[i - 1] and line[i] == line[i - 1] else 0

    def cut(i):
        if runs[i] and runs[i] % unit_dedup.RUN_WORDS == 0:
            return True
        for d in range(1, unit_dedup.RADIUS + 1):
            if i + d < n and line[i + d] == line[i] and pair[i] >= pair[i + d]:
                return False
            if i >= d and line[i - d] == line[i] and pair[i] > pair[i - d]:
                return False
        return True

    lines, segments = [], []
    for number in sorted(set(line)):
        at = [i for i in range(n) if line[i] == number]
        lines.append((at[0], at[-1] + 1))
        begins = [i for i in at if i == at[0] or cut(i)]
        parts = list(zip(begins, [*begins[1:], at[-1] + 1], strict=True))
        segments += parts if len(parts) > 1 else []
    out = []
    for kind, (b, e) in [("line", x) for x in lines] + [("segment", x) for x in segments]:
        before, after = max(b - least, 0), min(e + least, n)
        if e - b >= least:
            digests = [("", tuple(names[b:e]))]
        elif after - before < least:
            digests = [("=", b - before, tuple(names[before:after]))]
        else:
            back, ahead = e - before >= least, after - b >= least
            if kind == "segment" and back and ahead:
                back, ahead = (False, True) if b in {x for x, _ in lines} else (True, False)
            digests = [("<", tuple(names[before:e]))] * back + [(">", tuple(names[b:after]))] * ahead
        out += [(d, kind, line[b], words[b][0], words[e - 1][1], b, e - b) for d in digests]
    return out


def plain_repeats(rows, least=unit_dedup.MIN_WORDS, passage=unit_dedup.MIN_PASSAGE):
    found, places = {}, {}
    for doc_id, text in dict.fromkeys(rows):
        parts = [f"={v}" if v is not None else "-" for v in (doc_id, text)]
        key = hashlib.md5("\x1f".join(parts).encode()).digest()
        for unit in plain_units(text, least):
            rank = (doc_id is None, doc_id or 0, key if doc_id is None else b"", unit[3])
            places.setdefault(unit[0], []).append(rank)
            found.setdefault((doc_id, key), []).append((rank, doc_id, unit))
    out = []
    for units in found.values():
        again = {}
        for rank, doc_id, (digest, kind, line, start, end, word, n) in units:
            first = min(places[digest])
            if first < rank:
                entry = (digest[0] == "=", first, (doc_id, kind, line, start, end, word, n))
                again[kind, start] = min(again.get((kind, start), entry), entry, key=lambda x: x[:2])
        whole = {u[2] for _, _, u in again.values() if u[1] == "line"}
        left = sorted((x for x in again.values() if x[2][1] == "line" or x[2][2] not in whole), key=lambda x: (x[2][5], x[2][3]))
        passages = []
        for x in left:
            if passages and passages[-1][-1][2][5] + passages[-1][-1][2][6] == x[2][5]:
                passages[-1].append(x)
            else:
                passages.append([x])
        for p in passages:
            total, in_lines = sum(x[2][6] for x in p), sum(x[2][6] for x in p if x[2][1] == "line")
            for copy, first, (doc_id, kind, _, start, end, _, n) in p:
                if total >= passage or kind == "line" and (copy or in_lines >= least):
                    out.append((doc_id, kind, start, end, n, None if first[0] else first[1], first[3]))
    return sorted(out, key=repr)


def unit_rows(df):
    return sorted(((r.doc_id, r.unit, r.start, r.end, r.n_words, r.first_doc_id, r.first_start) for r in df.collect()), key=repr)


def test_repeated_units_are_those_of_brute_force(spark):
    extra = [(300 + i, f"{odd.prose(300 + i, 30)} {odd.prose(900, 60)} {odd.prose(400 + i, 30)}", "p") for i in range(3)]
    extra += [(310, "tiny text", "p"), (311, "tiny text", "p"), (312, "w " * 100, "p"), (313, "w " * 100, "p"), (314, "a b\nc d\n" * 9, "p")]
    rows = [(i, t) for i, t, _ in odd.texts() + extra]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = unit_rows(unit_dedup.repeated_units(df))
    assert got == plain_repeats(rows) and {r[0] for r in got} >= {301, 302, 311, 313, 314}


@pytest.mark.skipif(not DIR.exists(), reason="test tables are not here")
def test_repeated_units_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert unit_rows(queries.repeated_passages(spark, str(DIR))) == plain_repeats(rows)


@pytest.mark.parametrize("size", [51, 60])
def test_spliced_passages_are_removed(spark, size):
    rows = []
    for n in range(120):
        passage = odd.prose(5_000 + n, size)
        rows += [(2 * n, f"{odd.prose(6_000 + n, 40)} {passage} {odd.prose(7_000 + n, 40)}"),
                 (2 * n + 1, f"{odd.prose(8_000 + n, 40)} {passage} {odd.prose(9_000 + n, 40)}")]
    found = {r.doc_id for r in unit_dedup.repeated_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found <= {2 * n + 1 for n in range(120)} and len(found) >= 119


# Near duplicates

def variants(count, changed, words=220, seed=5):
    r = random.Random(seed)
    frame = odd.prose(77, words).split(" ")
    for n in range(count):
        text = list(frame)
        for place in r.sample(range(words), changed):
            text[place] = f"new{n}x{place}"
        yield n, " ".join(text)


def test_crowds_without_links_need_few_comparisons(spark, monkeypatch):
    """Texts that all resemble each other just below the limit: comparisons grow with the texts, not with their pairs."""
    compared = []
    plain = near_dups.confirmed

    def counted(pairs, *rest, **more):
        compared.append(pairs.count())
        return plain(pairs, *rest, **more)

    monkeypatch.setattr(near_dups, "confirmed", counted)
    per_text = []
    for count in (100, 400):
        compared.clear()
        rows = list(variants(count, 9))
        out = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2).collect()
        if count == 100:
            assert {r.doc_id: r.component_id for r in out} == odd.classes(rows, 2)
        per_text.append(sum(compared) / count)
    assert per_text[0] < 45 and per_text[1] < 1.5 * per_text[0]


@pytest.fixture
def tasks(spark):
    """tasks(n): from now on shuffles have exactly n tasks."""
    settings = {"spark.sql.shuffle.partitions": str, "spark.sql.adaptive.coalescePartitions.enabled": lambda n: "false"}
    before = {k: spark.conf.get(k) for k in settings}
    yield lambda n: [spark.conf.set(k, value(n)) for k, value in settings.items()]
    for k, v in before.items():
        spark.conf.set(k, v)


def test_orders_of_a_crowd_are_made_once(spark, monkeypatch, tmp_path, tasks):
    """Each row of a set in a crowded region is made once, not again for finding the cuts between tasks."""
    plain = near_dups.differing_rows

    def recorded(batches):
        for batch in plain(batches):
            with open(tmp_path / "made", "a") as out:
                out.write("".join(f"{t} {r} {d.hex()}\n" for t, r, d in zip(*[batch.column(c).to_pylist() for c in ("tree", "root", "digest")])))
            yield batch

    monkeypatch.setattr(near_dups, "differing_rows", recorded)
    tasks(8)
    rows = list(variants(150, 9))
    out = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2).collect()
    assert {r.doc_id: r.component_id for r in out} == odd.classes(rows, 2)
    made = (tmp_path / "made").read_text().splitlines()
    assert len(made) == len(set(made)) > len(rows)


def test_orders_of_a_crowd_do_not_follow_the_cuts(spark, tasks):
    """Sets have a row for each value that most sets of their whole region have not, in however many tasks it lies."""
    sets = near_dups.shingle_sets(pa.array([t for _, t in variants(90, 9)], pa.string()), 2)
    regions = [(0, 5)] * 60 + [(0, -7)] * 28 + [(5, 1)] * 2
    rows = [(*region, bytes([n]), len(s), near_dups._pack(s)) for n, (region, s) in enumerate(zip(regions, sets, strict=True))]
    crowds = spark.createDataFrame(rows, "tree int, root long, digest binary, n long, shingles binary")
    low = np.concatenate([near_dups.signatures([near_dups._unpack(r[-1]) for r in rows], *more) & 15
                          for more in ((), (near_dups.MORE, 1 + 2 * near_dups.VALUES))], axis=1)
    want = set()
    for region in set(regions):
        at = [n for n, r in enumerate(regions) if r == region]
        usual = [np.bincount(low[at, c], minlength=16).argmax() if len(at) > 2 else 16 for c in range(low.shape[1])]
        want |= {(near_dups.TREES + c, bytes([n])) for n in at for c in range(low.shape[1]) if low[n, c] != usual[c]}
    for count in (1, 40):
        tasks(count)
        got = [(r.tree, bytes(r.digest)) for r in near_dups.crowd_rows(crowds).collect()]
        assert len(got) == len(want) and set(got) == want


def test_pairs_at_the_limit_agree_in_most_values():
    r = np.random.default_rng(4)
    sets = []
    for _ in range(1_500):
        both = r.integers(0, 2**63, 240, dtype=np.uint64)
        sets += [np.sort(both[:216]), np.sort(both[24:])]
    low = near_dups.signatures(sets) & 15
    assert ((low[::2] == low[1::2]).sum(axis=1) >= near_dups.LEAST_MATCHES).mean() > 0.998


# Line filters, archives, packing

def test_a_growing_filter_loses_nothing():
    keys = np.random.default_rng(6).integers(0, 256, (40_000, 16), dtype=np.uint8)
    cuckoo = line_dedup.CuckooFilter()
    for begin in range(0, 40_000, 2_000):
        cuckoo.insert(keys[begin:begin + 2_000].ravel())
        cuckoo = line_dedup.CuckooFilter(cuckoo.blob())
    cuckoo.delete(keys[::2].ravel())
    assert cuckoo.contains(keys[1::2].ravel()).all()
    cuckoo.delete(keys[1::2].ravel())
    assert not any(t.any() for t in cuckoo.tables)


def test_only_inserted_documents_can_be_deleted(spark):
    docs = spark.createDataFrame([("a line\nanother",), (None,)], "text string")
    index = line_dedup.insert(line_dedup.empty_index(spark, 2), docs)
    assert line_dedup.delete(index, docs).refs.count() == 0
    with pytest.raises(ValueError, match="not inserted"):
        line_dedup.delete(index, spark.createDataFrame([("a stranger",)], "text string"))


URLS = ["http://exa：mple.com/x", "http://ex℀mple.com/", "http://[::1", "//", "a:b:c", "?q", "#f", "http://u:p@H.example:80/A?B#c", "\n", "ftp://", "http://x\\y/"]


def test_odd_urls_are_indexed(spark):
    pages = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(URLS)], "page_id long, url string, html string")
    out = warc_index.capture_index(pages, scratch_folder(spark, "warc-test")).collect()
    assert {r.page_id for r in out} == set(range(len(URLS))) and [r.urlkey for r in out] == sorted(r.urlkey for r in out)
    assert warc_index.url_key(URLS[7]) == "example:80,h)/a?b" and warc_index.url_key("http://exa：mple.com/x") == "com,exa：mple)/x"


def test_merge_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc_index, "ROWS_PER_RANGE", 30)
    monkeypatch.setattr(warc_index, "RECORDS_PER_FILE", 40)
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.example/{i % 50}", "x") for i in range(400)], "page_id long, url string, html string")
    out = warc_index.capture_index(pages, scratch_folder(spark, "warc-test"))
    rows = [(r.urlkey, r.timestamp, r.file, r.offset) for r in out.collect()]
    assert len(rows) == 400 and rows == sorted(rows)


def test_other_tokenizers_encode_whole_texts():
    path = Path("/opt/tokenizers/byte_bpe_50k.json")
    if not path.exists():
        pytest.skip("no second vocabulary")
    encoder = packing.WordEncoder(str(path))
    texts = [odd.prose(1, 50), None, "Two words  and\nNEW lines 123", ""]
    flat, counts = encoder.encode(pa.array(texts, pa.string()))
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert flat.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


# Licences

GRANT = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
SOURCE = "Redistributions of source code must retain the above copyright notice, this\nlist of conditions and the following disclaimer.\n\n"
BINARY = "Redistributions in binary form must reproduce the above copyright notice,\nthis list of conditions and the following disclaimer in the " \
    "documentation\nand/or other materials provided with the distribution.\n\n"
NAMED = "Released under the MIT License.\n\n"
LICENCES = [
    (GRANT + SOURCE + BINARY, "BSD-2-Clause", 0), (GRANT + NAMED + SOURCE + BINARY, "MIT", 3),
    ("// SPDX-License-Identifier: MIT\ncode", "MIT", 0), ("# SPDX-License-Identifier: GPL-3.0-or-later\n" + NAMED, "MIT,GPL-3.0-or-later", 0),
    ("This is free and unencumbered software released into the public domain.\n", "Unlicense", 0), ("All  rights\treserved.\n", "All rights reserved", 0),
    ("some words before\nReleased under the MIT License\nand words without a stop behind them\n\nLicensed under the Apache License,\nVersion 2.0 "
     "(the \"License\");\nyou may not use this file except in compliance\nwith the License.\n", "MIT,Apache-2.0", 0)]


def test_taken_sentences_leave_a_mark(spark):
    rows = [(i, text) for i, (text, _, _) in enumerate(LICENCES)]
    got = {r.doc_id: (r.licences, r.n_left) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (licences, left) for i, (_, licences, left) in enumerate(LICENCES)}


def test_the_sql_has_the_same_rule(spark):
    duckdb = pytest.importorskip("duckdb")
    import pandas as pd

    texts = [t for t, _, _ in LICENCES] + ["", NAMED * 3, SOURCE + GRANT + NAMED, "Released under the MIT License\nReleased under the MIT License."]
    connection = duckdb.connect()
    connection.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    want = connection.execute(queries.QUERIES["op9_license_scan"][1]).fetchall()
    got = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


# Pipeline

def test_pipeline_on_odd_and_empty_tables(spark):
    for empty in (False, True):
        docs = odd.table(spark, empty)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = docs.columns
            docs = written(stage(spark, docs, ""), name)
            assert docs.columns == before
        out = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        assert (not out) if empty else {1, 10} & {r.doc_id for r in out}
