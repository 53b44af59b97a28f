"""Quality model, conversation repair and filter audit beside plain versions, on odd rows and on the smallest tables."""

import hashlib
import itertools
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest

from rolesift.llm import audit_queries, conversation_repair, filter_audit, quality_model
from tests.llm import odd

DIR = Path("/root/testdata/sf0.01")
LEGAL = re.compile(r"(s?(ua)+)?")


# Conversation repair

def plain_repair(turns):
    """Every string of edits of a few letters, the legal ones by cost, then as text. ``turns``: (initial, fault)."""
    best = None
    for size in range(2 * len(turns) + 4):
        for letters in itertools.product("DIKR", repeat=size):
            if len([x for x in letters if x != "I"]) != len(turns):
                continue
            # A made turn is the user's or the assistant's; try both.
            cost, roles, i = 0, [""], 0
            for x in letters:
                if x == "I":
                    cost, roles = cost + 3, [r + c for r in roles for c in "ua"]
                    continue
                initial, fault = turns[i]
                i += 1
                if x == "D":
                    cost += 4
                    continue
                if fault == conversation_repair.MUST_GO:
                    roles = []
                cost += 3 * (x == "R") + 3 * (fault == conversation_repair.CUT_OFF)
                roles = [r + c for r in roles for c in ("ua" if x == "R" else initial or "-")]
            if any(LEGAL.fullmatch(r) for r in roles):
                found = (cost, "".join(letters))
                best = found if best is None else min(best, found)
    return best


@pytest.mark.parametrize("turns", [
    [], [("u", 0)], [("a", 0), ("u", 0)], [("s", 0)], [("s", 0), ("u", 2), ("a", 0)], [("u", 1), ("u", 0), ("a", 2)],
    [("t", 0), ("a", 0)], [("", 0), ("s", 0), ("u", 0)], [("u", 0), ("s", 0), ("a", 2)], [("a", 1), ("a", 2), ("a", 0)]])
def test_repair_is_the_cheapest_and_least(turns):
    assert conversation_repair.repair(bytes(conversation_repair.symbol(*t) for t in turns)) == plain_repair(turns)


def whole_table_repair(turns):
    """The DP with all vectors held, as (cost, letters)."""
    after = {0: (0, ""), 1: (6, "II"), 2: (3, "I"), 3: (0, "")}
    for initial, fault in reversed(turns):
        here = {}
        for state in range(4):
            options = [(4 + after[state][0], "D" + after[state][1])]
            fits = {"s": (0,), "u": (0, 1, 3), "a": (2,)}.get(initial, ())
            made = 3 if state == 2 else 2
            if fault != 1:
                extra = 3 if fault == 2 else 0
                if state in fits:
                    behind = {"s": 1, "u": 2, "a": 3}[initial]
                    options.append((extra + after[behind][0], "K" + after[behind][1]))
                options.append((3 + extra + after[made][0], "R" + after[made][1]))
            here[state] = min(options)
        here[2] = min(here[2], (3 + here[3][0], "I" + here[3][1]))
        for state in (0, 1, 3):
            here[state] = min(here[state], (3 + here[2][0], "I" + here[2][1]))
        after = here
    return after[0]


def test_checkpoints_change_nothing():
    r = random.Random(3)
    for n in (1, 2, 3, 8, 9, 10, 99, 100, 101, 1_000):
        turns = [(r.choice("suaaut") if r.random() > 0.02 else "", r.choice((0, 0, 0, 1, 2))) for _ in range(n)]
        assert conversation_repair.repair(bytes(conversation_repair.symbol(*t) for t in turns)) == whole_table_repair(turns)


def odd_conversations():
    long = "word " * 40_000 + "end."
    rows = [(1, i, "user" if i % 2 else "assistant", f"turn {i}.") for i in range(60)]
    rows += [(2, None, "user", "no number."), (2, None, "user", "no number."), (2, 3, None, "text."), (2, 3, "user", None), (2, 9, "", "x!")]
    rows += [(3, 1, "system", "Rules."), (3, 2, "user", "Hello?  \n"), (3, 2, "user", "Hello?  \n"), (3, 4, "assistant", long), (3, 5, "user", "")]
    rows += [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (None, None, None, None)]
    rows += [(4, i, r, t) for i, (r, t) in enumerate([("user", "same."), ("assistant", "ok."), ("user", "same."), ("tool", "x."), ("assistant", "cut")])]
    # A conversation whose only turn is dropped.
    lost = next(i for i in range(10_000, 20_000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    return rows + [(lost, 1, "user", "gone.")]


def plain_conversations(rows):
    out, groups = {}, {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, [])
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            groups[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    for conv, turns in groups.items():
        key = "-" if conv is None else f"={conv}"

        def digest(t, key=key):
            return hashlib.md5(f"{len(key)}:{key}{len(t[1])}:{t[1]}{t[2]}".encode()).digest()

        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], digest(t)))
        seen, faults = set(), []
        for _, role, text in turns:
            body = text.strip(" \t\n\x0b\f\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        kinds = {"blank": 1, "duplicate": 1, "truncated": 2, "": 0}
        cost, audit = whole_table_repair([(t[1][:1], kinds[f]) for t, f in zip(turns, faults, strict=True)])
        numbers = [t[0] for t in turns if t[0] is not None]
        lines, left, state = [], iter(turns), ""
        for x in audit:
            t = None if x == "I" else next(left)
            if x == "D":
                continue
            role = t[1] if x == "K" else "assistant" if state == "u" else "user"
            state = role[:1]
            lines.append(f"{role}:{t[2] if t else ''}")
        assert next(left, None) is None and LEGAL.fullmatch("".join(x[0] for x in lines))
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns)), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def write_tables(spark, folder, **tables):
    for name, frame in tables.items():
        frame.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_odd_conversations(spark, tmp_path):
    rows = odd_conversations()
    clashing = ["conv", "opens", "digest", "audit", "fault", "again", "twice", "position"]
    schema = "conv_id long, turn int, role string, text string, " + ", ".join(f"`{c}` string" for c in clashing)
    folder = write_tables(spark, tmp_path, conversations=spark.createDataFrame([(*r, *clashing) for r in rows], schema))
    got = audit_queries.repaired_conversations(spark, folder).collect()
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r.conv_id: tuple(r[c] for c in columns) for r in got} == plain_conversations(rows) and len(got) == 6


def test_no_conversations(spark, tmp_path):
    folder = write_tables(spark, tmp_path, conversations=spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert audit_queries.repaired_conversations(spark, folder).collect() == []


def test_repaired_turns(spark):
    rows = spark.createDataFrame([(1, 1, "user", "a."), (1, 2, "user", "b."), (1, 3, "assistant", "c")], "conv_id long, turn long, role string, text string")
    found = conversation_repair.audits(rows, rows)
    out = conversation_repair.repaired(rows, found).orderBy("position").collect()
    # An empty answer between the users' turns costs 3 and the cut-off turn 3 more.
    assert (found.collect()[0].cost, found.collect()[0].audit) == (6, "KIKK")
    assert [(r.position, r.edit, r.turn, r.role, r.text) for r in out] == [
        (0, "K", 1, "user", "a."), (1, "I", None, "assistant", ""), (2, "K", 2, "user", "b."), (3, "K", 3, "assistant", "c")]


# Filter audit

def plain_audit(rows, labels):
    first, good, toxic = {}, {}, {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, q, t in labels:
        good[i], toxic[i] = good.get(i) or q == 1, toxic.get(i) or t == 1
    parts = {}
    for i, text, part in rows:
        text = text or ""
        words = odd.WORD.findall(text)
        failing = {c for c, bad in {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and first[text] < i}.items() if bad}
        labelled = i is not None
        parts.setdefault(part or "", []).append((failing, bool(labelled and good.get(i)), bool(labelled and toxic.get(i))))
    out = []
    for part, docs in parts.items():
        removals = {}
        for order in itertools.permutations("ABCDE"):
            left = list(docs)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                removals[f] = removals.get(f, 0) + len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), sum(f in d[0] for d in docs) - len(gone),
                            sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)])
        for row in out[-600:]:
            row.append(removals[row[1][row[2] - 1]])
    return sorted(map(tuple, out))


def test_odd_documents_are_audited(spark):
    rows = odd.texts()
    labels = [(1, 1, 0), (1, 0, 1), (9, 0, 1), (10, 1, 1), (None, 1, 1), (15, None, 1), (777, 1, 1), (104, 1, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(odd.table(spark), table).collect()
    assert sorted(map(tuple, got)) == plain_audit(rows, labels)


def test_no_documents_no_audit(spark):
    table = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(odd.table(spark, empty=True), table).collect() == []


def test_clean_documents_lose_nothing(spark):
    text = " ".join(f"word{i}" for i in range(300))
    docs = spark.createDataFrame([(1, text, None)], "doc_id long, text string, source string")
    got = filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 600 and all(tuple(r)[3:] == (1, 0, 0, 0, 0, 0, 0) and r.part == "" for r in got)


def test_galloping_merges():
    r = np.random.default_rng(1)
    for n, m in ((0, 5), (1, 1), (3, 1_000), (500, 700), (1_000, 1_000)):
        a, b = (np.unique(r.integers(0, 1_500, k)) for k in (n, m))
        assert (filter_audit.gallop(a, b) == np.searchsorted(b, a)).all()
        assert (filter_audit.merged(a, b) == np.union1d(a, b)).all()


# Quality model

def test_features_of_pieces_and_slices():
    text = odd.prose(3, 400)
    together = {}
    for owner, bucket in quality_model.features(["", text, "one", text]):
        for i, b in zip(owner.tolist(), bucket.tolist(), strict=True):
            together.setdefault(i, []).append(b)
    at, counts = quality_model.document_counts(text)
    alone = sorted(np.repeat(at, counts.astype(int)).tolist())
    assert sorted(together[1]) == alone == sorted(together[3]) and 0 not in together
    assert "".join(quality_model.pieces(text, 50)) == text and max(map(len, quality_model.pieces("x" * 1_000, 50))) == 50


def test_odd_documents_have_scores(spark):
    docs = odd.table(spark)
    labels = spark.createDataFrame([(1, 1), (10, 1), (9, 0), (8, None), (None, 0), (11, 0), (104, 7), (4, 0), (5, 1)], "doc_id long, quality int")
    once = quality_model.quality_scores(docs, labels).collect()
    assert len(once) == len(odd.texts()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in once)
    by_id = {r.doc_id: r.score for r in once}
    assert by_id[1] == by_id[2] and by_id[4] == by_id[5] == by_id[6]
    assert {r.doc_id: r.held_out for r in once if r.doc_id is not None} == {
        i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in odd.texts() if i is not None}
    again = quality_model.quality_scores(docs.repartition(3), labels).collect()
    assert sorted(map(repr, once)) == sorted(map(repr, again))


def test_without_labels_every_text_scores_alike(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_model.quality_scores(odd.table(spark), none).collect()} == {0.5}
    assert quality_model.quality_scores(odd.table(spark, empty=True), none).collect() == []


@pytest.mark.skipif(not DIR.exists(), reason="test tables are not here")
def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{DIR}/labels.parquet").select("doc_id", "quality")
    rows = audit_queries.document_quality(spark, str(DIR)).join(labels, "doc_id").filter("held_out").collect()
    good, bad = ([r for r in rows if r.quality == q] for q in (1, 0))
    above = sum(g.score > b.score for g in good for b in bad) / (len(good) * len(bad))
    assert above > 0.98 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
