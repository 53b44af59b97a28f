"""The operators on Spark: odd rows, empty tables, clashing columns, and brute force."""

import base64
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from rolesift.llm import (
    license_scan, line_dedup, mixing, near_dups, packing, repetition, secret_scan, topk_search, unit_dedup, warc_index,
)
from rolesift.llm.base import written
from rolesift.session import scratch_folder
from tests.llm import odd

TEXTS = odd.texts()


@pytest.fixture(scope="module")
def docs(spark):
    return written(odd.table(spark), "odd")


@pytest.fixture(scope="module")
def nothing(spark):
    return odd.table(spark, empty=True)


def as_rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_repetition(docs, nothing):
    out = repetition.measure(docs)
    rules = repetition.Rules()
    want = []
    for i, text, _ in TEXTS:
        if text is not None and len(text) > 5_000:
            continue
        m = odd.repetition(text)
        failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        fine = 100 * m["n_covered"] <= rules.max_covered_percent * m["n_words"] and m["longest_repeat"] <= rules.max_longest
        want.append((i, *m.values(), failed, fine and not failed))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat", "base_failed", "kept"]
    assert as_rows(out.filter("doc_id IS NULL OR doc_id NOT IN (10, 11)"), *names) == sorted(want, key=repr)
    kept = as_rows(repetition.keep_acceptable(docs), "doc_id")
    assert len(kept) == out.filter("kept").count() and repetition.keep_acceptable(docs).columns == docs.columns
    assert repetition.measure(nothing).count() == 0 and repetition.keep_acceptable(nothing).count() == 0


def test_packing(docs, nothing):
    out = packing.pack(docs).collect()
    tokenizer = packing.WordEncoder(None).tokenizer
    whole = {}
    for row in out:
        whole.setdefault((row.doc_id, row.doc_tokens), []).append(row)
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in row.ids)) == row.ids_crc32 and len(row.ids) == row.length
    want = sorted((tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (2,) for _, t, _ in TEXTS), key=repr)
    got = []
    for rows in whole.values():
        starts = sorted({r.start for r in rows})
        copies = len(rows) // len(starts)
        for n in range(copies):
            got.append(tuple(i for s in starts for i in [r for r in rows if r.start == s][n].ids))
    assert sorted(map(len, got)) == sorted(map(len, want)) and set(got) == set(want)
    places = {}
    for row in out:
        places.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(nothing, with_ids=False).count() == 0


def test_line_dedup(docs, nothing):
    index = line_dedup.index_of(docs)
    out = line_dedup.remove_lines(index, docs)
    want = odd.without_lines([(i, t) for i, t, _ in TEXTS])
    got = as_rows(out.select("row.doc_id", "row.text", "kept", "n_lines", "n_dropped"), "doc_id", "text", "kept", "n_lines", "n_dropped")
    assert got == sorted((
        (i, t, w, (t or "").count("\n") + 1, (t or "").count("\n") + 1 - (w.count("\n") + 1 if w or not t else 0))
        for (i, t, _), w in zip(TEXTS, want, strict=True)), key=repr)
    stage = line_dedup.without_frequent_lines(docs)
    assert stage.columns == docs.columns and stage.schema == docs.schema
    assert as_rows(stage, "doc_id", "text", "n_chars") == sorted((
        (i, t and w, None if t is None else len(w)) for (i, t, _), w in zip(TEXTS, want, strict=True)), key=repr)
    assert line_dedup.without_frequent_lines(nothing).count() == 0


def test_line_index_is_reversible(docs):
    first, second = docs.filter("doc_id < 107"), docs.filter("doc_id >= 107")
    one = line_dedup.insert(line_dedup.empty_index(docs.sparkSession, 4), first)
    both = line_dedup.insert(one, second)
    back = line_dedup.delete(both, second)
    assert as_rows(back.refs, "digest", "refs") == as_rows(one.refs, "digest", "refs")
    assert line_dedup.dropped_lines(one, docs).count() == 0 and line_dedup.dropped_lines(back, docs).count() == 0
    assert line_dedup.dropped_lines(both, docs).count() == 14
    held = {r.digest for r in both.refs.filter("refs >= 10").collect()}
    assert len(held) == 1
    filters = [line_dedup.CuckooFilter(bytes(r.blob)) for r in back.filters.collect()]
    assert not any(t.any() for f in filters for t in f.tables)


def test_warc(spark):
    rows = [(1, "http://a.example/x", "same"), (2, "http://a.example/x", "same"), (3, None, None), (4, "http://b.example/\r\nz", ""),
            (5, "http://b.example/", "WARC/1.1\r\n\r\n\r\n"), (None, "http://c.example/", "same"), (6, "", "é" * 100_000), (6, "", "é" * 100_000)]
    pages = spark.createDataFrame([(*r, "d", "t") for r in rows], "page_id long, url string, html string, digest string, time string")
    path = scratch_folder(spark, "warc-test")
    out = warc_index.capture_index(pages, path).collect()
    first = {"same": 1, "": 3, "é" * 100_000: 6}
    want = []
    for page, _, html in rows:
        payload = (html or "").encode()
        again = (html or "") in first and first[html or ""] != page
        want.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response",
                     first[html or ""] if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=repr) == sorted(want, key=repr)
    assert all(r.intact for r in out)
    assert [r.urlkey for r in out] == sorted(r.urlkey for r in out)
    assert sum(f.name.endswith(".gz") for f in _files(path)) > 0
    large = warc_index.capture_index(pages, scratch_folder(spark, "warc-test"), least_bytes=5)
    assert {r.page_id for r in large.collect() if r.record_type == "revisit"} == set()
    assert warc_index.capture_index(pages.limit(0), scratch_folder(spark, "warc-test")).count() == 0


def _files(path):
    from pathlib import Path

    return list(Path(path.removeprefix("file:")).iterdir())


def test_mixing(docs, nothing):
    out = mixing.mix(docs, [5, 2, 1]).collect()
    sizes, taken, targets = {}, {}, {}
    total = sum(r["size"] for r in out)
    assert sorted((r.doc_id, r["size"]) for r in out if r.doc_id) == sorted((i, len(odd.WORD.findall(t or ""))) for i, t, _ in TEXTS if i)
    for r in out:
        assert r.taken == r["size"] * r.copies and 0 <= r.copies <= 2
        targets[r.source_size, r.target] = None
    names = sorted({s for _, _, s in TEXTS if s}) + [None]
    for i, t, s in TEXTS:
        sizes[s] = sizes.get(s, 0) + len(odd.WORD.findall(t or ""))
    weights, open_, goal = {s: [5, 2, 1][n % 3] for n, s in enumerate(names)}, set(names), {}
    while True:
        left = 1.5 * total - sum(2 * sizes[s] for s in names if s not in open_)
        above = {s for s in open_ if left * weights[s] / sum(weights[x] for x in open_) > 2 * sizes[s]}
        if not above:
            break
        open_ -= above
    for s in names:
        goal[s] = left * weights[s] / sum(weights[x] for x in open_) if s in open_ else 2.0 * sizes[s]
    want = sorted((sizes[s], goal[s]) for s in names)
    assert [x for pair in sorted(targets) for x in pair] == pytest.approx([x for pair in want for x in pair])
    again = mixing.mix(docs.repartition(7), [5, 2, 1])
    assert as_rows(again, "doc_id", "size", "taken") == sorted(((r.doc_id, r["size"], r.taken) for r in out), key=repr)
    for r in out:
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    largest = max(r["size"] for r in out)
    assert all(abs(taken[sizes[s]] - goal[s]) <= largest for s in names)
    mixed = mixing.mixed_documents(docs, [5, 2, 1])
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in out)
    assert mixing.mix(nothing, [5, 2, 1]).count() == 0 and mixing.mixed_documents(nothing, [5, 2, 1]).count() == 0


def test_near_duplicates(docs, nothing):
    out = near_dups.near_duplicates(docs, shingle_words=2)
    plain = [(i, t) for i, t, _ in TEXTS if i is not None]
    want = odd.classes(list(dict(plain).items()), 2)
    got = out.filter("doc_id IS NOT NULL").collect()
    assert {(r.doc_id, r.component_id) for r in got} == set(want.items()) and len(got) == len(plain)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(odd.shingles(t, 2)) for i, t in plain}
    nameless = out.filter("doc_id IS NULL").collect()
    assert len(nameless) == 3 and all(r.component_id is None and r.kept for r in nameless)
    stage = near_dups.first_of_class(docs, shingle_words=2)
    assert stage.columns == docs.columns and stage.count() == out.filter("kept").count()
    assert near_dups.near_duplicates(nothing).count() == 0 and near_dups.first_of_class(nothing).count() == 0


def test_near_duplicates_around_one_centre(spark):
    """Variants that resemble their origin and not each other: every link leads to the centre."""
    import random

    r = random.Random(5)
    base = odd.prose(70, 220).split(" ")
    rows = [(1_000, " ".join(base))]
    for n in range(120):
        words = list(base)
        for place in r.sample(range(0, 220, 2), 11):
            words[place] = f"new{n}x{place}"
        rows.append((n, " ".join(words)))
    out = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2)
    assert {r.doc_id: r.component_id for r in out.collect()} == odd.classes(rows, 2)


def test_near_duplicates_among_filled_in_forms(spark):
    """Copies of one form that resemble each other below the limit, each with one true partner."""
    frame = odd.prose(71, 220).split(" ")
    rows = []
    for n in range(200):
        for half in (0, 1):
            words = list(frame)
            for field in range(16):
                words[6 + 13 * field] = f"f{n}x{field}" + (f"y{half}" if field < 11 else "")
            rows.append((2 * n + half, " ".join(words)))
    want = odd.classes(rows, 2)
    assert all(want[i] == i - i % 2 for i, _ in rows)
    out = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2)
    assert {r.doc_id: r.component_id for r in out.collect()} == want


def test_components_of_chains_and_stars(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 180)] + [(200, 200), (301, 300)]
    df = spark.createDataFrame(edges, "a int, b int").select(*[F.unhex(F.lpad(F.hex(c), 4, "0")).alias(c) for c in "ab"])
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 180)} | {200: 200, 300: 300, 301: 300}
    for size in (1_000, 20):
        monkeypatch.setattr(near_dups, "EDGES_PER_TASK", size)
        found = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in near_dups.components(df.repartition(8)).collect()}
        assert {k: v for k, v in found.items() if k != 200} == {k: v for k, v in want.items() if k != 200}


def test_secrets(docs, nothing):
    out = secret_scan.digest_columns(secret_scan.find_secrets(docs))
    assert as_rows(out, "doc_id", "base_sha256") == sorted(((i, secret_scan.brute_force(t)) for i, t, _ in TEXTS), key=repr)
    row = out.filter("doc_id = 16").first()
    assert (row.n_assign, row.n_access, row.n_hex) == (1, 1, 1)
    assert secret_scan.find_secrets(nothing).count() == 0


def test_repeated_units(docs, nothing):
    out = unit_dedup.repeated_units(docs).collect()
    texts = dict((i, t) for i, t, _ in TEXTS if i is not None)
    for r in out:
        if r.doc_id is not None:
            words = odd.WORD.findall(texts[r.doc_id][r.start:r.end].lower())
            assert words == odd.WORD.findall(texts[r.first_doc_id][r.first_start:].lower())[:r.n_words]
            assert (r.first_doc_id, r.first_start) < (r.doc_id, r.start)
    assert {1, 15, 10} & {r.doc_id for r in out} == set() and {2, 3} <= {r.doc_id for r in out}
    kept = unit_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)
    left = {r.doc_id: r.text for r in kept.collect()}
    assert left[1] == texts[1] and left[2] == "" and left[4] is None and left[5] == ""
    assert left[8] == texts[8][:texts[8].rindex("\n") + 1]
    assert unit_dedup.repeated_units(nothing).count() == 0 and unit_dedup.without_repeats(nothing).count() == 0


def test_repeated_passages_of_short_lines(spark):
    words = odd.prose(80, 400).split(" ")
    verse = "\n".join(" ".join(words[i:i + 4]) for i in range(0, 200, 4))
    listed = "\n".join(f"{' '.join(words[i:i + 2])}\n{' '.join(words[i + 2:i + 14])}" for i in range(200, 396, 14))
    single = "\n".join(str(n % 7) for n in range(60))
    own = [odd.prose(81 + n, 40) for n in range(4)]
    rows = [(1, f"{own[0]}\n{verse}\n{listed}\n{own[1]}"), (2, f"{own[2]}\n{verse}\n{own[3]}"), (3, listed), (4, verse),
            (5, "\n".join(reversed(verse.split("\n")))), (6, single)]
    left = {r.doc_id: r.text for r in unit_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left[1] == rows[0][1] and left[2] == f"{own[2]}\n{own[3]}" and left[3] == "" and left[4] == ""
    # The same lines in another order are no passage; a list that repeats itself keeps its first turn.
    assert left[5] == rows[4][1] and single.startswith(left[6]) and left[6]


def test_repeated_lines_and_short_copies(spark):
    own = [odd.prose(90 + n, 30) for n in range(4)]
    line = odd.prose(95, 9)
    rows = [(1, f"{own[0]}\n{line}\n{own[1]}"), (2, f"{own[2]}\n{line}\n{own[3]}"), (3, "only four\nwords here"), (4, "only four\nwords here"),
            (5, "three lines of\nfour words each\nand some more words"), (6, "three lines of\nfour words each\nand some more words"), (7, "words here")]
    left = {r.doc_id: r.text for r in unit_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == dict(rows) | {2: f"{own[2]}\n{own[3]}", 4: "", 6: ""}


def test_licenses(docs, spark, nothing):
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert got[18].licences == "MIT" and got[18].n_left == 0 and got[4].licences == "" and got[4].n_sentences == 0
    wrapped = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation " \
        "files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, " \
        "modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software " \
        "is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be " \
        "included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY " \
        "KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND " \
        "NONINFRINGEMENT."
    some = spark.createDataFrame([(1, wrapped), (2, "See the GNU General Public License for more details."), (3, None)], "doc_id long, text string")
    assert as_rows(license_scan.scan_licenses(some), "doc_id", "licences", "n_sentences", "n_left") == [(1, "MIT", 3, 0), (2, "", 1, 1), (3, "", 0, 0)]
    assert license_scan.scan_licenses(nothing).count() == 0


def test_published_notices(spark):
    free = "This {0} is free software{1} you can redistribute it and/or modify\nit under the terms of the GNU {2} as published by\n" \
        "the Free Software Foundation{3} either version {4} of the License, or\n(at your option) any later version.\n\n" \
        "This {0} is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\n" \
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU {2} for more details.\n\n" \
        "You should have received a copy of the GNU {2}\nalong with this {0}{5}"
    general, lesser = "General Public License", "Lesser General Public\nLicense"
    bsd = "Copyright (c) 2020, A. Holder\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted " \
        "provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n" \
        "   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n" \
        "   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n"
    third = "\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived " \
        "from\n   this software without specific prior written permission.\n"
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that " \
        "the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR " \
        "DISCLAIMS ALL WARRANTIES WITH\nREGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY\nAND FITNESS."
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\n" \
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    notices = {
        "GPL-3.0-or-later": free.format("program", ":", general, ",", "3", ".  If not, see <https://www.gnu.org/licenses/>."),
        "GPL-2.0-or-later": free.format("program", ";", general, ";", "2", "; if not, write to the Foundation."),
        "LGPL-2.1-or-later": free.format("library", ";", lesser, ";", "2.1", "; if not, write to the Foundation."),
        "LGPL-3.0-or-later": free.format("library", ":", lesser, ",", "3", "."),
        "BSD-2-Clause": bsd, "BSD-3-Clause": bsd + third, "ISC": isc, "MPL-2.0": mpl,
        "All rights reserved": "Copyright (c) 2020 A. Holder. All rights reserved."}
    rows = list(enumerate(notices.values()))
    got = {r.doc_id: (r.licences, r.n_left) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (licence, 0) for i, licence in enumerate(notices)}


def test_both_readings_of_a_text_count(spark):
    line = "some words before\nReleased under the MIT License\nand words without a stop behind them\n"
    wrapped = "\nLicensed under the Apache License,\nVersion 2.0 (the \"License\");\nyou may not use this file except in compliance\nwith " \
        "the License.\n"
    bare = "Released under the MIT License\n" * 3
    rows = [(1, line + wrapped), (2, wrapped + line), (3, bare + wrapped), (4, "Released under the MIT License.\n\n" + bare)]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_rows(license_scan.scan_licenses(some), "doc_id", "licences", "n_sentences", "n_left") == [
        (1, "MIT,Apache-2.0", 3, 0), (2, "MIT,Apache-2.0", 3, 0), (3, "MIT,Apache-2.0", 5, 0), (4, "MIT", 4, 0)]


def test_every_query_row_has_its_own_ranks(spark):
    texts = [odd.prose(100 + n % 2, 30) for n in range(8)]
    index = topk_search.build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    queries = spark.createDataFrame([(q, texts[n]) for q in (7, None) for n in (0, 1)], "doc_id long, text string")
    got = as_rows(topk_search.search(index, queries, k=3), "query_id", "rank", "doc_id")
    want = [(q, rank, 2 * (rank - 1) + n) for q in (7, None) for n in (0, 1) for rank in (1, 2, 3)]
    assert got == sorted(want, key=repr)


def test_search(docs, nothing, monkeypatch):
    index = topk_search.build_index(docs)
    queries = docs.filter("doc_id % 2 = 0 OR doc_id IS NULL")
    small = topk_search.search(index, queries, k=3)
    every = topk_search.search(index, queries, k=1_000)
    best = {}
    for r in every.collect():
        best.setdefault(r.query_id, []).append((-r.score, r.doc_id is None, r.doc_id or 0, r["rank"]))
    for q, rows in best.items():
        if q is not None:
            assert [x[3] for x in sorted(rows)] == list(range(1, len(rows) + 1))
    assert as_rows(small.filter("query_id IS NOT NULL"), "query_id", "rank", "doc_id", "score") == as_rows(
        every.filter("rank <= 3 AND query_id IS NOT NULL"), "query_id", "rank", "doc_id", "score")
    assert {r.query_id for r in small.collect()} >= {2, 100} and 4 not in {r.query_id for r in small.collect()}
    monkeypatch.setattr(topk_search, "QUERY_TERMS", 500)
    assert as_rows(topk_search.search(index, queries, k=3), "query_id", "rank", "doc_id", "score") == as_rows(
        small, "query_id", "rank", "doc_id", "score")
    assert topk_search.search(topk_search.build_index(nothing), queries).count() == 0
    assert topk_search.search(index, nothing).count() == 0
