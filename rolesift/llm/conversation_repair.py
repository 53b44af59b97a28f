"""Conversation structure repair: cheapest edits that make turns alternate, by a DP with square-root checkpoints.

A repaired conversation is empty, or an optional system turn and then pairs of a
user and an assistant turn. Turns may be kept, given the other role, deleted, and
inserted with an empty text. The DP has four states (nothing yet, after system,
after user, after assistant); a vector holds the least cost from a turn to the
end for each. Vectors are computed backward and kept only every square root of
the length; walking forward, the vectors of one block at a time are computed
again and the ASCII-least of the edits that keep the least cost is taken. Every
edit leads to one state, so the letters of the edits name one repair only.

A turn is one byte to the DP (first letter of its role, its fault). Turns
stream through a task in order, so a conversation takes a byte per turn, two
vectors per square root, and its edits; texts are never gathered. Which turns
repeat an earlier one is found by digest over the whole table, minima combined
before the shuffle. One conversation is walked by one task: its edits are one
string, and a digest of its text has no parallel form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.llm.base import BLANKS, WORD, aside, written
from rolesift.operators.joins import look_up

START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
#: Costs of the edits; an unfinished turn that stays adds UNFINISHED.
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
ACCEPTED = (START, ASSISTANT)
#: State behind a system, user or assistant turn, by state before; other roles fit nowhere.
BEHIND = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: State behind the one turn that may be inserted, or that a turn may be made into.
MADE = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua"
FINE, MUST_GO, CUT_OFF = range(3)
LEGAL = ("su", "ua", "au")


def symbol(initial: str, fault: int) -> int:
    """One byte per turn: first letter of the role (3: any other), and fault."""
    return fault * 4 + (INITIALS.index(initial) if initial and initial in INITIALS else 3)


def _moves() -> list[list[list[tuple[str, int, int]]]]:
    """Edits of a turn in ASCII order by symbol and state: letter, cost, state behind."""
    out = []
    for fault in (FINE, MUST_GO, CUT_OFF):
        for initial in (*INITIALS, ""):
            rows = []
            for state in range(4):
                moves = [("D", DELETE, state)]
                if fault != MUST_GO:
                    extra = UNFINISHED if fault == CUT_OFF else 0
                    if state in BEHIND.get(initial, {}):
                        moves.append(("K", extra, BEHIND[initial][state]))
                    moves.append(("R", REROLE + extra, MADE[state]))
                rows.append(moves)
            out.append(rows)
    return out


MOVES = _moves()


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    user = min(costs[USER], INSERT + costs[ASSISTANT])
    return min(costs[START], INSERT + user), min(costs[SYSTEM], INSERT + user), user, min(costs[ASSISTANT], INSERT + costs[USER])


END = _with_inserts([0 if state in ACCEPTED else NEVER for state in range(4)])


def _before(turn: int, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs before a turn from those behind it."""
    return _with_inserts([min(cost + costs[after] for _, cost, after in moves) for moves in MOVES[turn]])


def repair(turns: bytes) -> tuple[int, str]:
    """Least cost and the ASCII-least edits of that cost, of a conversation as symbols."""
    n = len(turns)
    block = isqrt(n) + 1
    checkpoints, costs = {n: END}, END
    for i in range(n - 1, -1, -1):
        costs = _before(turns[i], costs)
        if i % block == 0:
            checkpoints[i] = costs
    least, out, state = costs[START], [], START
    for begin in range(0, n, block):
        end = min(begin + block, n)
        vectors = [checkpoints[end]]
        for i in range(end - 1, begin, -1):
            vectors.append(_before(turns[i], vectors[-1]))
        vectors.append(checkpoints[begin])
        here = vectors.pop()
        for i in range(begin, end):
            after = vectors.pop()
            while True:
                letter, cost, behind = MOVES[turns[i]][state][0]
                if here[state] != cost + after[behind]:
                    if here[state] == INSERT + here[MADE[state]]:
                        out.append("I")
                        state = MADE[state]
                        continue
                    letter, cost, behind = next(m for m in MOVES[turns[i]][state] if here[state] == m[1] + after[m[2]])
                out.append(letter)
                state = behind
                break
            here = after
    while END[state]:
        out.append("I")
        state = MADE[state]
    return least, "".join(out)


def _conversation(conv_id: Column) -> Column:
    """A key under which NULL is a conversation too."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit("-"))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in, decided by ``crc32("conv_id:turn") % 20``.

    0 drops the turn, 1 empties its text, 2 takes its sentence ends, 3 repeats
    it, 4 makes it the user's. NULL ids, roles and texts read as one space; ids
    and turns stay NULL in the result.
    """
    space = F.lit(" ")
    rows = aside(conversations, {c: c for c in ("conv_id", "turn", "role", "text")}).withColumn("turn", F.col("turn").cast("long"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("fault", F.crc32(key) % 20).filter("fault <> 0")
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("twice")).drop("twice")


def _turns(rows: DataFrame) -> DataFrame:
    """Turns under their conversation's key, with a digest of conversation, role and text."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = rows.select("conv_id", _conversation(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.withColumn("digest", F.unhex(F.md5(F.concat(
        F.length("conv").cast("string"), F.lit(":"), F.col("conv"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))))


#: Turns in order (NULL first), behind one row that opens the conversation; rows that tie in all of these are the same turn twice.
ORDER = ["conv", "opens", "turn", "role", "digest"]


def _auditor(id_type: pa.DataType) -> Callable:
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    schema = pa.schema([("conv_id", id_type), *[(c, pa.int64()) for c in names[1:7]], ("audit", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, found = None, None
        rows: list[tuple] = []
        size = 0

        def close() -> None:
            nonlocal size
            cost, edits = repair(bytes(found["turns"]))
            gaps = found["last"] - found["first"] + 1 - found["distinct"] if found["distinct"] else 0
            rows.append((found["id"], gaps, *found["faults"], found["illegal"], cost, edits))
            size += len(edits)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv", "conv_id", "turn", "role", "digest", "blank", "cut", "again")]
            for key, conv_id, turn, role, digest, blank, cut, again in zip(*columns, strict=True):
                if key != conv or found is None:
                    if found is not None:
                        close()
                        if size > 4_000_000 or len(rows) >= 5_000:
                            yield out()
                            rows, size = [], 0
                    conv, found = key, {"id": conv_id, "turns": bytearray(), "faults": [0, 0, 0], "illegal": 0, "distinct": 0,
                                        "first": 0, "last": None, "role": None, "digest": None}
                    continue
                again = again or (turn, digest) == found["digest"]
                fault = 0 if blank else 1 if again else 2 if cut else None
                if fault is not None:
                    found["faults"][fault] += 1
                if turn is not None and turn != found["last"]:
                    found["first"] = turn if found["last"] is None else found["first"]
                    found["last"] = turn
                    found["distinct"] += 1
                if found["role"] is not None and found["role"] + role[:1] not in LEGAL:
                    found["illegal"] += 1
                found["role"], found["digest"] = role[:1], (turn, digest)
                found["turns"].append(symbol(role[:1], FINE if fault is None else CUT_OFF if fault == 2 else MUST_GO))
        if found is not None:
            close()
            yield out()

    return run


def audits(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conversation of ``conversations`` or ``rows``: its faults in ``rows``, least cost and edits.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. Turns are
    taken by number, NULL first, ties by role and text digest. NULL roles and
    texts read as one space; a NULL id is a conversation of its own. Without
    rows all counts are 0 and there are no edits.
    """
    turns = _turns(rows)
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    narrow = written(turns.select(
        "conv_id", "conv", "turn", "role", "digest", (~F.col("text").rlike(WORD)).alias("blank"),
        (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut")), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = written(narrow.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"), "first")
    marked = look_up(narrow, first, ["digest"], F.coalesce("turn", F.lit(0)), "left").withColumn(
        "again", F.coalesce(place > F.col("first"), F.lit(False))).drop("first").withColumn("opens", F.lit(1))
    every = conversations.select("conv_id").unionByName(narrow.select("conv_id"))
    opening = every.select("conv_id", _conversation(F.col("conv_id")).alias("conv")).distinct().withColumn("opens", F.lit(0))
    streams = marked.unionByName(opening, allowMissingColumns=True).repartition("conv").sortWithinPartitions(*ORDER)
    kind = conversations.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return streams.mapInArrow(_auditor(_arrow_type(conversations)), schema)


def _arrow_type(conversations: DataFrame) -> pa.DataType:
    return conversations.select("conv_id").limit(0).toArrow().schema.field(0).type


def _repairer(schema: pa.Schema) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, conv_id, edits, at, state, position = None, None, "", 0, START, 0
        rows: list[tuple] = []
        size = 0

        def inserted() -> None:
            nonlocal at, state, position
            while at < len(edits) and edits[at] == "I":
                state = MADE[state]
                rows.append((conv_id, position, "I", None, ROLE_OF[state], ""))
                position, at = position + 1, at + 1

        def out() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv", "conv_id", "audit", "turn", "role")]
            texts = batch.column("text")
            for i, (key, own_id, audit, turn, role) in enumerate(zip(*columns, strict=True)):
                if key != conv:
                    conv, conv_id, edits, at, state, position = key, own_id, audit, 0, START, 0
                    inserted()
                    continue
                letter = edits[at]
                at += 1
                if letter != "D":
                    state = MADE[state] if letter == "R" else BEHIND[role[:1]][state]
                    text = texts[i].as_py()
                    rows.append((conv_id, position, letter, turn, ROLE_OF[state] if letter == "R" else role, text))
                    position += 1
                    size += len(text)
                inserted()
                if size > 4_000_000 or len(rows) >= 5_000:
                    yield out()
                    rows, size = [], 0
        if rows:
            yield out()

    return run


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position, edit, turn, role, text, each conversation in order in one partition.

    ``found``: what ``audits`` gave for ``rows``. Inserted turns have no number
    and an empty text. A conversation of which nothing is left has no row.
    """
    opening = found.select("conv_id", _conversation(F.col("conv_id")).alias("conv"), "audit", F.lit(0).alias("opens"))
    turns = _turns(rows).withColumn("opens", F.lit(1))
    streams = turns.unionByName(opening, allowMissingColumns=True).repartition("conv").sortWithinPartitions(*ORDER)
    id_type = _arrow_type(found)
    schema = pa.schema([("conv_id", id_type), ("position", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    kind = found.schema["conv_id"].dataType.simpleString()
    return streams.select("conv", "conv_id", "audit", "turn", "role", "text").mapInArrow(
        _repairer(schema), f"conv_id {kind}, position long, edit string, turn long, role string, text string")


def _digester(id_type: pa.DataType) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, digests, current = [], [], None
        for batch in batches:
            texts = batch.column("text")
            for i, (conv_id, position, role) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("conv_id", "position", "role")], strict=True)):
                if position == 0:
                    if current is not None:
                        digests.append(current.hexdigest())
                    ids.append(conv_id)
                    current = hashlib.sha256()
                else:
                    current.update(b"\n")
                current.update(f"{role}:{texts[i].as_py()}".encode("utf-8", "replace"))
            if len(digests) >= 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids[:-1], id_type), pa.array(digests)], names=["conv_id", "sha256"])
                ids, digests = ids[-1:], []
        if current is not None:
            digests.append(current.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(digests)], names=["conv_id", "sha256"])

    return run


def text_digests(repairs: DataFrame) -> DataFrame:
    """conv_id, sha256 of ``role:text`` lines per conversation, of what ``repaired`` gave."""
    kind = repairs.schema["conv_id"].dataType.simpleString()
    return repairs.mapInArrow(_digester(_arrow_type(repairs)), f"conv_id {kind}, sha256 string")
