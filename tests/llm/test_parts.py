"""The plain parts of the operators against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rolesift.llm import license_scan, line_dedup, near_dups, packing, repetition, secret_scan, topk_search, unit_dedup, warc_index
from tests.llm import odd


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_longest_repeats(symbols):
    found = repetition.longest_repeats(np.array(symbols, dtype=np.int64))

    def common(i, j):
        length = 0
        while max(i, j) + length < len(symbols) and symbols[i + length] == symbols[j + length]:
            length += 1
        return length

    assert found.tolist() == [max([0, *[common(i, j) for j in range(len(symbols)) if j != i]]) for i in range(len(symbols))]


def test_measures_of_odd_texts():
    texts = [t for _, t, _ in odd.texts() if t is None or len(t) < 5_000]
    found = repetition.measure_texts(texts, 10, True)
    for number, text in enumerate(texts):
        want = odd.repetition(text)
        assert {k: found[k][number] for k in want} == want
        words = [w for s in found["spans"][number] for w in odd.WORD.findall(text[s["start"]:s["end"]])]
        assert len(words) == want["n_covered"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([
    "password", "PassWd", "secret", "token", " ", ":", "=", "'", '"', "abc", "abcdefgh12", "AKIA", "AKIA0123456789ABCD", "é", "ſ", "K",
    "api_key", "apikey", "0123456789abcdef", "deadbeef" * 4, "ghp_", "z"]), max_size=14).map("".join))
def test_secrets_like_plain_expressions(text):
    import hashlib

    spans = [f"{k}:{s}:{e}" for k, s, e in secret_scan.make_scanner()(text) if k in ("assign", "access", "hex")]
    assert hashlib.sha256(",".join(spans).encode()).hexdigest() == secret_scan.brute_force(text)


def test_checked_tokens():
    body = "abcdefghij0123456789ABCDEFGHIJ"
    scan = secret_scan.make_scanner()
    good = f"é npm_{body}{secret_scan.checksum62(body)}"
    assert scan(good) == [("npm", 2, len(good))]
    assert scan(f"npm_{body}000000") == [] and scan(good + "x") == []


def test_cuckoo_filter_takes_back():
    r = np.random.default_rng(0)
    keys = r.integers(0, 256, (3_000, 16), dtype=np.uint8)
    cuckoo = line_dedup.CuckooFilter(None, 100)
    cuckoo.insert(keys.ravel())
    assert len(cuckoo.tables) > 1 and cuckoo.contains(keys.ravel()).all()
    again = line_dedup.CuckooFilter(cuckoo.blob())
    again.delete(keys[:1_500].ravel())
    assert again.contains(keys[1_500:].ravel()).all()
    assert again.contains(keys[:1_500].ravel()).mean() < 0.02
    again.delete(keys[1_500:].ravel())
    assert not any(t.any() for t in again.tables)


def test_loser_tree():
    r = random.Random(1)
    for _ in range(300):
        runs = [sorted((r.randint(0, 9), i, j) for j in range(r.randint(0, 6))) for i in range(r.randint(0, 9))]
        assert list(warc_index.LoserTree(runs)) == sorted(x for run in runs for x in run)


def test_nonnegative_least_squares():
    r = np.random.default_rng(2)
    for _ in range(50):
        a, b = r.integers(0, 3, (8, 12)).astype(float), r.integers(0, 50, 8).astype(float)
        x = packing.solve_nonnegative(a, b)
        slope = a.T @ (a @ x - b)
        assert (x >= 0).all() and (slope > -1e-6).all() and np.abs(slope[x > 1e-9]).max(initial=0) < 1e-6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 700), min_size=1, max_size=120))
def test_plan_fills_sequences(tokens):
    window, unit, histogram = 256, 16, {}
    for n in tokens:
        pieces = packing.cuts(n, window, unit)
        assert [s for s, _ in pieces] == np.cumsum([0, *[x for _, x in pieces]])[:-1].tolist() and sum(x for _, x in pieces) == n
        for _, length in pieces:
            histogram[length] = histogram.get(length, 0) + 1
    held, ranks = {}, {}
    for length, low, high, first, base, times in packing.plan_slots(histogram, window, unit, 3):
        assert low == ranks.get(length, 0)
        ranks[length] = high
        for rank in range(low, high):
            held.setdefault(first + (rank - low) // times, []).append((base + (rank - low) % times * length, length))
    assert ranks == histogram and sorted(held) == list(range(len(held)))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window


def test_encoder_equals_the_tokenizer():
    texts = [t for _, t, _ in odd.texts()] + [
        "á b", "don't I'll 'sx", "a​b", "́abc def", "A<|B|>c <|ENDOFTEXT|> Q", "<|endoftext|> x", "1½ ² 22b", "~`^_-(x)", "ẞß ×÷"]
    encoder = packing.WordEncoder(None)
    for batch in (texts, [t for t in texts if t and "<|" not in t]):
        flat, counts = encoder.encode(pa.array(batch, pa.string()))
        at = 0
        for text, count in zip(batch, counts.tolist(), strict=True):
            assert flat[at:at + count].tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
            at += count


def test_shingle_sets_and_signatures():
    texts = [t for _, t, _ in odd.texts()]
    sets = near_dups.shingle_sets(pa.array(texts, pa.string()), 2)
    for text, found in zip(texts, sets, strict=True):
        assert len(found) == len(odd.shingles(text, 2))
    values = near_dups.signatures(sets)
    assert (values[0] == values[1]).all() and 0.9 < (values[0] == values[2]).mean() <= 1
    assert (near_dups._unpack(near_dups._pack(sets[0])) == sets[0] >> np.uint64(16)).all()


def test_units_cover_lines_and_spliced_passages():
    passage = odd.prose(50, 60)
    texts = [f"{odd.prose(51, 40)} {passage} {odd.prose(52, 30)}", None, "", f"{odd.prose(53, 70)}\n{odd.prose(54, 20)} {passage.upper()} x"]
    found = unit_dedup.split_units(texts, 6)
    for i in range(len(found["text"])):
        text = texts[found["text"][i]]
        unit = text[found["start"][i]:found["end"][i]]
        assert len(odd.WORD.findall(unit)) == found["n_words"][i] and "\n" not in unit
        assert text[:found["start"][i]].count("\n") == found["line"][i]
    shared = {d for d, t in zip(found["digest"], found["text"], strict=True) if t == 0} & {
        d for d, t in zip(found["digest"], found["text"], strict=True) if t == 3}
    words = sum(n for d, t, n in zip(found["digest"], found["text"], found["n_words"], strict=True) if t == 0 and d in shared)
    assert words >= 25


@pytest.mark.parametrize("ids", [r for _, r in license_scan.RULES])
def test_rules_name_known_sentences(ids):
    assert all(i in license_scan.SENTENCES for i in ids)


def test_records_are_read_by_length():
    import io

    block = b"HTTP/1.1 200 OK\r\n\r\nx\r\n\r\nWARC/1.1\r\n\r\n"
    record = b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    assert [(o, b) for o, _, b in warc_index.read_records(io.BytesIO(record * 2))] == [(0, block), (len(record), block)]
    with pytest.raises(ValueError, match="cut off"):
        list(warc_index.read_records(io.BytesIO(record[:-3])))


def test_url_keys():
    assert warc_index.url_key("https://M.Example.com/A/b?x=1#top") == "com,example,m)/a/b?x=1"
    assert warc_index.url_key("") == ")/" and warc_index.url_key("http://[bad/") and re.search("日", warc_index.url_key("http://日.example/"))


def test_term_numbers_ignore_white_space():
    flat, counts = topk_search.term_numbers(pa.array(["a  b\tA", None, "", " \n"]))
    assert counts.tolist() == [3, 0, 0, 0] and flat[0] == flat[2] != flat[1]
