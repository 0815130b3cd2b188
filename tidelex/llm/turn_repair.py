"""Conversation structure repair: the cheapest edits that leave ``(system)? (user assistant)+``, or nothing.

A dynamic program over the turns. Its steps are macro edits, a run of inserted turns followed by what becomes of one
given turn: ``D``, ``K`` or ``R`` behind up to two ``I``. No such code begins another, so of two audit strings over
the same turns neither begins the other, and their order is that of their first differing steps. A layer thus
needs no strings: it keeps per state (nothing yet, after system, after user, after assistant) a cost and the rank of
the state's least audit string among those of the layer, and pointers to the state and code that it comes from.
Costs relative to the layer's least one and ranks take few values, so the steps between them are remembered.

Rows are sorted by range over the whole cluster and cut into segments of a bounded number of turns. A conversation in
one segment is repaired where it lies. Of a longer one, every segment is summed up as the costs and ranks from each
state to each other state; a fold over these small rows settles the states at the cuts, and all segments are rebuilt
apart from each other. Only a digest of a whole repaired conversation reads it in order, in constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import product
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelex.llm.common import kept, partitions_of

SEGMENT_TURNS, SEGMENT_CHARS = 1024, 1 << 20
BLANKS = " \t\n\v\f\r"
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (NOTHING, ASSISTANT)
#: The state after a turn of this initial, where the pattern allows one.
AFTER = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state after the user or assistant turn that may follow, and its role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
LEGAL = ("su", "ua", "au")
MOST_INSERTS = 2
CODES = sorted("I" * k + x for k, x in product(range(MOST_INSERTS + 1), "DKR"))
TURNS = "array<struct<role:string,text:string>>"
SEGMENT = f"conv_id long, part int, no int, open boolean, turn array<long>, said {TURNS}"
FACT_NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
FACTS = ", ".join(f"{k} long" for k in FACT_NAMES)
BLOCK = f"conv_id long, part int, no int, open boolean, facts struct<{FACTS.replace(' long', ':long')}>, audit string, turns {TURNS}"
SUM = "conv_id long, part int, no int, size long, counts array<long>, ends array<string>, low long, high long, distinct long, ways array<long>"
SETTLED = f"part int, no int, enter int, leave int, more int, facts struct<{FACTS.replace(' long', ':long')}>"
SAID_ARROW = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
FACTS_ARROW = pa.struct([(k, pa.int64()) for k in FACT_NAMES])
SEGMENT_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("no", pa.int32()), ("open", pa.bool_()), ("turn", pa.list_(pa.int64())), ("said", SAID_ARROW)])
BLOCK_ARROW = pa.schema([*list(SEGMENT_ARROW)[:4], ("facts", FACTS_ARROW), ("audit", pa.string()), ("turns", SAID_ARROW)])
DIGEST_ARROW = pa.schema([*list(SEGMENT_ARROW)[:3], ("place", pa.int32()), ("digest", pa.binary())])
SUM_ARROW = pa.schema([
    *list(SEGMENT_ARROW)[:3], ("size", pa.int64()), ("counts", pa.list_(pa.int64())), ("ends", pa.list_(pa.string())),
    *((k, pa.int64()) for k in ("low", "high", "distinct")), ("ways", pa.list_(pa.int64())),
])
SETTLED_ARROW = pa.schema([*list(SEGMENT_ARROW)[1:3], ("enter", pa.int32()), ("leave", pa.int32()), ("more", pa.int32()), ("facts", FACTS_ARROW)])
REPORT_ARROW = pa.schema([("conv_id", pa.int64()), *((k, pa.int64()) for k in FACT_NAMES), ("audit", pa.string()), ("repaired_sha256", pa.string())])


class Fate(NamedTuple):
    """What decides a turn's edits: its role's initial, whether it has to go, whether it is truncated."""

    initial: str
    gone: bool
    truncated: bool


class Layer(NamedTuple):
    """Per state its cost above the layer's least and the rank of its least audit string; None where it can't be."""

    cost: tuple
    rank: tuple


@cache
def edges(fate: Fate) -> tuple:
    """(state, next state, cost, number of the code): the cheapest macro edit, then the least code, from each state to each other."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for state, (n, code) in product(range(4), enumerate(CODES)):
        at, cost = state, INSERT * (len(code) - 1)
        for _ in code[1:]:
            at = NEXT[at]
        if code[-1] == "D":
            cost += DELETE
        elif fate.gone or code[-1] == "K" and (at, fate.initial) not in AFTER:
            continue
        else:
            cost += fate.truncated * TRUNCATED + (REROLE if code[-1] == "R" else 0)
            at = NEXT[at] if code[-1] == "R" else AFTER[at, fate.initial]
        best[state, at] = min(best.get((state, at), (cost, n)), (cost, n))
    return tuple((a, b, *x) for (a, b), x in sorted(best.items()))


@cache
def step(layer: Layer, fate: Fate) -> tuple[int, Layer, tuple]:
    """What the least cost grows by, the next layer, and per state of it (state before, number of the code)."""
    best: list = [None] * 4
    for a, b, cost, code in edges(fate):
        if layer.cost[a] is not None:
            found = (layer.cost[a] + cost, layer.rank[a], code, a)
            best[b] = min(best[b] or found, found)
    least = min(x[0] for x in best if x)
    order = sorted(x[1:3] for x in best if x)
    made = Layer(tuple(x and x[0] - least for x in best), tuple(x and order.index(x[1:3]) for x in best))
    return least, made, tuple(x and (x[3], x[2]) for x in best)


def from_state(state: int) -> Layer:
    return Layer(tuple(0 if s == state else None for s in range(4)), tuple(0 if s == state else None for s in range(4)))


def passed(fates: list[Fate], layer: Layer) -> tuple[int, Layer, list[tuple]]:
    """The cost taken off, the last layer and all pointers."""
    total, pointers = 0, []
    for f in fates:
        grown, layer, back = step(layer, f)
        total += grown
        pointers.append(back)
    return total, layer, pointers


def ending(layer: Layer) -> tuple[int, int, int]:
    """Cost above the layer's least, last state and number of turns inserted at the end, of the cheapest complete audit."""
    found = []
    for state in range(4):
        if layer.cost[state] is not None:
            at, k = state, 0
            while at not in ACCEPTED:
                at, k = NEXT[at], k + 1
            found.append((layer.cost[state] + INSERT * k, layer.rank[state], state, k))
    cost, _, state, k = min(found)
    return cost, state, k


def codes_of(pointers: list[tuple], state: int) -> list[str]:
    out = []
    for back in reversed(pointers):
        state, code = back[state]
        out.append(CODES[code])
    return out[::-1]


def rebuilt(said: list[dict], codes: list[str], state: int) -> list[dict]:
    """The repaired turns; a code beyond the given turns inserts only."""
    out = []
    for i, code in enumerate(codes):
        for x in code:
            if x == "I":
                out.append({"role": ROLE[state], "text": ""})
                state = NEXT[state]
            elif x == "R":
                out.append({"role": ROLE[state], "text": said[i]["text"]})
                state = NEXT[state]
            elif x == "K":
                out.append(said[i])
                state = AFTER[state, said[i]["role"][:1]]
    return out


def digest(turn: dict) -> bytes:
    role, text = (x.encode("utf-8", "surrogatepass") for x in (turn["role"], turn["text"]))
    return hashlib.blake2b(b"%d:" % len(role) + role + text, digest_size=16).digest()


def faults(said: list[dict], first: set[int]) -> tuple[list[Fate], tuple[int, int, int]]:
    """The fate of each turn, and how many are blank, duplicate (not at a place in ``first``) and truncated; the first fault counts."""
    fates, blank, duplicate, truncated = [], 0, 0, 0
    for i, t in enumerate(said):
        body = t["text"].rstrip(BLANKS)
        empty, again = not body, i not in first
        cut = not empty and not again and body[-1] not in ".!?"
        blank, duplicate, truncated = blank + empty, duplicate + (again and not empty), truncated + cut
        fates.append(Fate(t["role"][:1], empty or again, cut))
    return fates, (blank, duplicate, truncated)


def first_places(said: list[dict]) -> dict[bytes, int]:
    """Where each different role and text stands first."""
    held: dict[bytes, int] = {}
    for i, t in enumerate(said):
        held.setdefault(digest(t), i)
    return held


def illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def span(turns: list) -> tuple:
    """First and last turn number and how many are distinct, nulls ignored; ``turns`` do not fall."""
    known = [t for t in turns if t is not None]
    return (known[0], known[-1], len(set(known))) if known else (None, None, 0)


def gaps(low, high, distinct: int) -> int:
    return 0 if low is None else high - low + 1 - distinct


def in_batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows in batches of a few thousand turns."""
    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += 16 + len(r.get("turns") or r.get("said") or ())
        if weight > 8192:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def each(function, schema: pa.Schema):
    """For ``mapInArrow``: the rows that the function makes of each row."""
    return lambda batches: in_batches((made for b in batches for r in b.to_pylist() for made in function(r)), schema)


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[dict]:
    """Sorted rows of one range as segments. Those are open that may be one of several: of a cut conversation, and of the range's first and last."""
    part, no, begun, again, ready = TaskContext.get().partitionId(), 0, 0, False, None
    conv, turns, said, chars = None, [], [], 0

    def made(more: bool) -> dict:
        return {"conv_id": conv, "part": part, "no": no, "open": more or begun == 1, "turn": turns, "said": said}

    for b in batches:
        for c, turn, role, text, absent in zip(*(b[k].to_pylist() for k in ("conv_id", "turn", "role", "text", "absent")), strict=True):
            new, full = not begun or c != conv, len(said) >= most or chars >= SEGMENT_CHARS
            if begun and (new or full):
                if ready:
                    yield ready
                again = again or not new
                ready, no, turns, said, chars = made(again), no + 1, [], [], 0
            if new:
                conv, begun, again = c, begun + 1, False
            if not absent:
                turns.append(turn)
                said.append({"role": role, "text": text})
                chars += len(role) + len(text)
    if ready:
        yield ready
    if begun:
        yield made(True)


def _whole(r: dict) -> Iterator[dict]:
    """The block of a conversation in one segment."""
    fates, counts = faults(r["said"], set(first_places(r["said"]).values()))
    total, layer, pointers = passed(fates, from_state(NOTHING))
    more, state, k = ending(layer)
    codes = [*codes_of(pointers, state), "I" * k]
    facts = dict(zip(FACT_NAMES, (gaps(*span(r["turn"])), *counts, illegal([t["role"][:1] for t in r["said"]]), total + more), strict=True))
    yield {**_place(r), "open": False, "facts": facts, "audit": "".join(codes), "turns": rebuilt(r["said"], codes, NOTHING)}


def _place(r: dict) -> dict:
    return {k: r[k] for k in ("conv_id", "part", "no")}


def _digests(r: dict) -> Iterator[dict]:
    for d, i in first_places(r["said"]).items():
        yield {**_place(r), "place": i, "digest": d}


def _summed(r: dict) -> Iterator[dict]:
    """Of a segment the counts, what its neighbours have to know, and cost and rank of the way from each state to each other."""
    fates, counts = faults(r["said"], set(r["first"] or []))
    initials = [t["role"][:1] for t in r["said"]]
    low, high, distinct = span(r["turn"])
    ways: list = []
    for state in range(4):
        total, layer, _ = passed(fates, from_state(state))
        for cost, rank in zip(layer.cost, layer.rank, strict=True):
            ways += [None, None] if cost is None else [total + cost, rank]
    yield {**_place(r), "size": len(initials), "counts": [*counts, illegal(initials)], "ends": [initials[0], initials[-1]] if initials else [], "low": low, "high": high, "distinct": distinct, "ways": ways}


def _settled(group: pa.Table) -> pa.Table:
    """The states at the cuts of one conversation, from a small row for each of its segments."""
    parts = sorted(group.to_pylist(), key=lambda r: (r["part"], r["no"]))
    costs, ranks, froms = [0, None, None, None], [0, None, None, None], []
    counts, distinct, low, high, last = [0] * 4, 0, None, None, None
    for r in parts:
        best: list = [None] * 4
        for a, b in product(range(4), range(4)):
            cost, rank = r["ways"][8 * a + 2 * b : 8 * a + 2 * b + 2]
            if costs[a] is not None and cost is not None:
                found = (costs[a] + cost, ranks[a], rank, a)
                best[b] = min(best[b] or found, found)
        order = sorted(x[1:3] for x in best if x)
        costs, ranks = [x and x[0] for x in best], [x and order.index(x[1:3]) for x in best]
        froms.append([x and x[3] for x in best])
        counts = [x + y for x, y in zip(counts, r["counts"], strict=True)]
        if r["ends"]:
            counts[3] += last is not None and last + r["ends"][0] not in LEGAL
            last = r["ends"][1]
        if r["low"] is not None:
            distinct += r["distinct"] - (high == r["low"])
            low, high = r["low"] if low is None else low, r["high"]
    cost, state, k = ending(Layer(tuple(costs), tuple(ranks)))
    facts = dict(zip(FACT_NAMES, (gaps(low, high, distinct), *counts, cost), strict=True))
    out: list[dict] = []
    for r, before in zip(reversed(parts), reversed(froms), strict=True):
        out.append({"part": r["part"], "no": r["no"], "enter": before[state], "leave": state, "more": 0 if out else k, "facts": facts if len(out) == len(parts) - 1 else None})
        state = before[state]
    return pa.Table.from_pylist(out, schema=SETTLED_ARROW)


def _rebuilt(r: dict) -> Iterator[dict]:
    fates, _ = faults(r["said"], set(r["first"] or []))
    codes = [*codes_of(passed(fates, from_state(r["enter"]))[2], r["leave"]), "I" * r["more"]]
    yield {**_place(r), "open": True, "facts": r["facts"], "audit": "".join(codes), "turns": rebuilt(r["said"], codes, r["enter"])}


def _blocks(turns: DataFrame, absent: Column | None, segment_turns: int) -> tuple[DataFrame, DataFrame]:
    """The blocks of conversations in one segment, and those of all others."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    gone = F.lit(False) if absent is None else F.coalesce(absent, F.lit(False))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"), gone.alias("absent"))
    rows = rows.withColumn("tie", F.xxhash64("role", "text")).withColumn("own", F.monotonically_increasing_id())
    # the row's own number lets even equal rows of one conversation lie in several ranges
    ordered = rows.repartitionByRange(max(8, 2 * partitions_of(turns)), "conv_id", "turn", "tie", "own").sortWithinPartitions("conv_id", "turn", "tie", "role", "text", "own")
    cut_up = kept(ordered.mapInArrow(lambda batches: in_batches(_cut(batches, segment_turns), SEGMENT_ARROW), SEGMENT), "turn-segments")
    alone, parts = cut_up.where("not open"), cut_up.where("open")
    first = parts.mapInArrow(each(_digests, DIGEST_ARROW), "conv_id long, part int, no int, place int, digest binary")
    first = first.groupBy("conv_id", "digest").agg(F.min(F.struct("part", "no", "place")).alias("at")).select("at.*").groupBy("part", "no").agg(F.collect_list("place").alias("first"))
    known = parts.join(first, ["part", "no"], "left").select(*parts.columns, "first")
    settled = known.mapInArrow(each(_summed, SUM_ARROW), SUM).groupBy("conv_id").applyInArrow(_settled, SETTLED)
    again = known.join(settled, ["part", "no"]).select(*known.columns, "enter", "leave", "more", "facts")
    return alone.mapInArrow(each(_whole, BLOCK_ARROW), BLOCK), again.mapInArrow(each(_rebuilt, BLOCK_ARROW), BLOCK)


def repaired_blocks(turns: DataFrame, absent: Column | None = None, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """conv_id, part, no, open, facts, audit, turns array<struct<role,text>>: repaired conversations in blocks, ordered by (part, no).

    ``turns``: conv_id, turn, role, text. A conversation's turns are ordered by turn, null first, then by a hash of role and text, role and
    text. Null roles and texts count as one space; a null conv_id is a conversation as any other. Rows for which
    ``absent`` holds only name their conversation, so that it has a block even if no turn is left. A blank text (only ASCII
    white space) or a role and text that the conversation had before must be deleted (3); a turn may be kept (0),
    given the role user or assistant (2) or deleted (3), a turn without text may be inserted anywhere (2), and a turn that
    stays and does not end in ``.``, ``!`` or ``?`` adds 1. Of the cheapest edits those of the least audit string count.

    ``facts`` (gaps, blank, duplicate, truncated, illegal, cost) stand in a conversation's first block. A block holds the
    repair of at most ``segment_turns`` given turns, or of some 1 MB of them and one turn more, however long it is. An
    empty table gives no blocks; repeated rows are duplicates of the first; other columns are not read.
    """
    alone, parts = _blocks(turns, absent, segment_turns)
    return alone.unionByName(parts)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row for each conversation from its blocks in a row; what is held of a conversation is its audit and a running hash."""
    begun, conv, facts, audit, running, empty = False, None, None, [], hashlib.sha256(), True

    def made() -> dict:
        return {"conv_id": conv, **facts, "audit": "".join(audit), "repaired_sha256": running.hexdigest()}

    for b in batches:
        for r in b.to_pylist():
            if not begun or r["facts"] is not None:
                if begun:
                    yield made()
                begun, conv, facts, audit, running, empty = True, r["conv_id"], r["facts"], [], hashlib.sha256(), True
            audit.append(r["audit"])
            for t in r["turns"]:
                running.update(("" if empty else "\n").encode() + f"{t['role']}:{t['text']}".encode("utf-8", "surrogatepass"))
                empty = False
    if begun:
        yield made()


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return in_batches(_read(batches), REPORT_ARROW)


def repair_report(turns: DataFrame, absent: Column | None = None, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row a conversation, as ``repaired_blocks`` repairs it.

    ``gaps`` counts the turn numbers missing between the least and the largest, ``illegal`` adjacent turns before the
    repair whose roles' initials are not su, ua or au. The digest is of ``role:text`` of the repaired turns, joined by
    line breaks. A conversation of several blocks is streamed through one task in order, as a SHA-256 has to be; that
    task holds no more of it than a batch and its audit string.
    """
    schema = f"conv_id long, {FACTS}, audit string, repaired_sha256 string"
    alone, parts = _blocks(turns, absent, segment_turns)
    return alone.mapInArrow(_reported, schema).unionByName(parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no").mapInArrow(_reported, schema))


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """(conv_id, turn, role, text, gone) with faults planted by the CRC-32 of ``conv_id:turn`` modulo 20, and the condition of rows that are dropped.

    0 drops the row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 repeats the row, 4 gives it the role user. Nulls count
    as one space, in the key as well.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy"))
    return rows.drop("copy"), F.col("gone")
