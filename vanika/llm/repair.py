"""Conversation structure repair: cost layers of grammar states, cheapest edits, repaired conversations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vanika.llm.common import crc_mod, cut, parts

# What blank is, what ends a sentence, and what edits cost.
BLANK, STOPS = " \t\n\x0b\x0c\r", ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: States of the grammar (s?(ua)+)?: nothing yet, after the system's turn, after a user's, after an assistant's.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = 1 << NONE | 1 << ASSISTANT
#: The state that a role's initial leads to from each state, and what an edit can write there.
NEXT = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
WRITTEN = {NONE: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
_NAMES = {"u": "user", "a": "assistant"}

Layers = tuple[int, ...]  # bit q of layer d: from state q, what follows can be repaired for d more than the least


def _before(states: int, initial: str) -> int:
    """The states from which the initial leads to one of states (a set of bits)."""
    return sum(1 << q for q, to in NEXT.get(initial, {}).items() if states >> to & 1)


def _before_written(states: int) -> int:
    return _before(states, "u") | _before(states, "a")


def _rebased(layers: dict[int, int]) -> tuple[int, Layers]:
    """The cost of the first layer with a state, and the layers from there until all states are in."""
    first, out, held = min(d for d, x in layers.items() if x), [], 0
    for d in range(first, max(layers) + 1):
        held |= layers.get(d, 0)
        out.append(held)
        if held == 15:
            break
    return first, tuple(out)


@lru_cache(maxsize=None)
def step(after: Layers, initial: str, fault: str) -> tuple[int, Layers]:
    """The layers before a turn, from those after it, by increasing cost: each layer is got by keeping, reroling or deleting the turn from earlier layers after it, and by inserting from earlier layers before it.

    initial: of the role ('' for none of s, u, a); fault: '', blank, duplicate or truncated. There are few layers and few turns that differ,
    so each is made once a worker.
    """
    def at(d: int) -> int:
        return 0 if d < 0 else after[min(d, len(after) - 1)]

    gone, late = fault in ("blank", "duplicate"), TRUNCATED * (fault == "truncated")
    layers: dict[int, int] = {}
    d = 0
    while not layers or layers[d - 1] != 15:
        x = at(d - DELETE)
        if not gone:
            x |= _before(at(d - late), initial) | _before_written(at(d - late - REROLE))
        layers[d] = x | _before_written(layers.get(d - INSERT, 0))
        d += 1
    return _rebased(layers)


def end() -> Layers:
    """The layers after the last turn: what only insertions repair."""
    layers = {0: ACCEPTING}
    while layers[max(layers)] != 15:
        d = max(layers) + 1
        layers[d] = layers[d - 1] | _before_written(layers.get(d - INSERT, 0))
    return _rebased(layers)[1]


def _cost(layers: Layers, state: int) -> int:
    return next(d for d, x in enumerate(layers) if x >> state & 1)


@lru_cache(maxsize=None)
def trace(after: Layers, initial: str, fault: str, state: int) -> tuple[str, int]:
    """The least cheapest edits from a state up to and with a turn, and the state after it: D before I before K before R wherever the costs are equal."""
    base, before = step(after, initial, fault)
    gone, late = fault in ("blank", "duplicate"), TRUNCATED * (fault == "truncated")
    edits = ""
    while True:
        cost = base + _cost(before, state)
        if cost == DELETE + _cost(after, state):
            return edits + "D", state
        to = NEXT[WRITTEN[state]][state]
        if cost == INSERT + base + _cost(before, to):
            edits, state = edits + "I", to
            continue
        kept = NEXT.get(initial, {}).get(state)
        if not gone and kept is not None and cost == late + _cost(after, kept):
            return edits + "K", kept
        return edits + "R", to


def cheapest(turns: list[tuple[str, str]]) -> tuple[int, str]:
    """The least cost of a conversation's turns (initial, fault), and its edits' initials, ASCII-least among the cheapest."""
    layers, base = [end()], 0
    for initial, fault in reversed(turns):
        more, x = step(layers[-1], initial, fault)
        layers.append(x)
        base += more
    cost, state, edits = base + _cost(layers[-1], NONE), NONE, []
    for k, (initial, fault) in enumerate(turns):
        found, state = trace(layers[len(turns) - 1 - k], initial, fault, state)
        edits.append(found)
    while not ACCEPTING >> state & 1:
        edits.append("I")
        state = NEXT[WRITTEN[state]][state]
    return cost, "".join(edits)


#: Turns of a conversation go by number, nulls first (as Spark sorts); of one number, by role and hashes of role and text.
_ORDER = ["conv_id", "head", "turn", "role", "h1", "h2"]
_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_REPAIRED = "conv_id long, place long, role string, text string, edit string"


def _turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone, h1, h2: nulls in role or text are one space; the hashes tell role and text apart."""
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.coalesce(gone, F.lit(False)).alias("gone"))
    return own.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64("text", "role", F.lit(1))})


def judged(rows: DataFrame) -> DataFrame:
    """A row for each conversation of rows (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit.

    gaps: turns missing between the least and the greatest. A turn's first fault counts: blank, duplicate (its role and text were there before),
    truncated (no stop at its end). illegal: neighbours whose roles can't follow each other. audit: the cheapest edits that leave
    (s?(ua)+)?, one initial each (Delete, Insert, Keep, Rerole), ASCII-least. Rows with a true column gone don't count, but their conversation does. Null conv_ids
    are one conversation. A role or text that is null is one space. No rows: no rows; other columns are ignored.

    Texts of any length stay behind: of a turn, a task gets its fault, its role and two hashes, in order, and holds some 200 bytes of each turn of the conversation at hand.
    """
    bare = F.rtrim("text", F.lit(BLANK))
    own = _turns(rows).select("conv_id", F.lit(0).alias("head"), "turn", "gone", "role", (bare == "").alias("blank"), F.right(bare, F.lit(1)).isin(*STOPS).alias("stopped"), "h1", "h2")
    dealt = own.repartition(parts(rows.sparkSession), "conv_id").sortWithinPartitions(*_ORDER)
    names = [f.split()[0] for f in _REPORT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = each  # no conversation
        numbers: set[int] = set()
        seen: set[tuple[int, int]] = set()
        turns: list[tuple[str, str]] = []
        illegal, last = 0, None
        out: list[tuple] = []

        def close() -> None:
            cost, audit = cheapest(turns)
            faults = [f for _, f in turns]
            gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
            out.append((now, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit))

        def made() -> pa.RecordBatch:
            return pa.record_batch({f: pa.array([r[k] for r in out], kinds[k]) for k, f in enumerate(names)})

        for batch in batches:
            for conv, turn, gone, role, blank, stopped, h1, h2 in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "gone", "role", "blank", "stopped", "h1", "h2")), strict=True):
                if conv != now:
                    if now is not each:
                        close()
                    now, illegal, last = conv, 0, None
                    numbers, seen, turns = set(), set(), []
                if gone:
                    continue
                if turn is not None:
                    numbers.add(turn)
                initial = role[:1]
                if last is not None and last + initial not in ("su", "ua", "au"):
                    illegal += 1
                last = initial
                fault = "blank" if blank else "duplicate" if (h1, h2) in seen else "" if stopped else "truncated"
                seen.add((h1, h2))
                turns.append((initial if initial in NEXT else "", fault))
            if out:
                yield made()
                out.clear()
        if now is not each:
            close()
            yield made()

    return dealt.mapInArrow(each, _REPORT)


def repaired(rows: DataFrame, report: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text, edit of the repaired conversations: what judged() (report) has found cheapest, done to the same rows.

    Conversations lie in one partition each, in order: a turn is written as it is read, so a task holds one batch and one audit at a time, however long a
    conversation is. A kept turn has its own role, a reroled one user or assistant; an inserted one has no text.
    """
    turns = _turns(rows).filter("NOT gone").drop("gone").withColumns({"head": F.lit(1), "audit": F.lit(None).cast("string")})
    heads = report.select("conv_id", F.lit(0).alias("head"), "audit")
    dealt = turns.unionByName(heads, allowMissingColumns=True).repartition(parts(rows.sparkSession), "conv_id").sortWithinPartitions(*_ORDER)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, place = None, "", 0, NONE, 0
        out: list[tuple] = []

        def write(role: str, text: str, edit: str) -> None:
            nonlocal place, state
            out.append((conv, place, role, text, edit))
            place, state = place + 1, NEXT[role[:1]][state]

        def inserted() -> None:
            nonlocal at
            while audit[at : at + 1] == "I":
                write(_NAMES[WRITTEN[state]], "", "I")
                at += 1

        def made() -> pa.RecordBatch:
            fields = ("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())
            return pa.record_batch({f: pa.array([r[k] for r in out], kind) for k, (f, kind) in enumerate(fields)})

        for batch in batches:
            for c, head, edits, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "head", "audit", "role", "text")), strict=True):
                if head == 0:
                    inserted()
                    conv, audit, at, state, place = c, edits, 0, NONE, 0
                    continue
                inserted()
                edit, at = audit[at], at + 1
                if edit == "K":
                    write(role, text, "K")
                elif edit == "R":
                    write(_NAMES[WRITTEN[state]], text, "R")
            if out:
                yield made()
                out.clear()
        inserted()
        if out:
            yield made()

    return dealt.mapInArrow(each, _REPAIRED)


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of repaired() turns, as they lie: lowercase hex of `role:text`, joined by line feeds, hashed turn by turn."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = each
        h = hashlib.sha256()
        for batch in batches:
            out = []
            for conv, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
                if place == 0:
                    if now is not each:
                        out.append((now, h.hexdigest()))
                    now, h = conv, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
            if out:
                yield pa.record_batch({"conv_id": pa.array([x[0] for x in out], pa.int64()), "repaired_sha256": pa.array([x[1] for x in out], pa.string())})
        if now is not each:
            yield pa.record_batch({"conv_id": pa.array([now], pa.int64()), "repaired_sha256": pa.array([h.hexdigest()], pa.string())})

    return turns.mapInArrow(each, "conv_id long, repaired_sha256 string")


#: One in so many rows gets each of five damages.
OF = 20


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with faults: by a hash of `conv_id:turn`, one row in OF each goes (gone is true), loses its text, loses its stops, comes twice, or becomes a user's. Nulls: one space."""
    def said(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = crc_mod(F.concat(said("conv_id"), F.lit(":"), said("turn")), OF)
    text = F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), STOPS, "")).otherwise(said("text"))
    own = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return own.withColumn("_", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "_")


def repair_report(rows: DataFrame) -> DataFrame:
    """judged() with repaired_sha256, the hash of each repaired conversation (of nothing: that of an empty text), for damaged rows."""
    report = cut(judged(rows), "judged")
    found = digests(repaired(rows, report)).withColumnRenamed("conv_id", "_conv")
    return report.join(found, report["conv_id"].eqNullSafe(found["_conv"]), "left").drop("_conv").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))
