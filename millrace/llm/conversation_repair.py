"""Conversation structure repair by a Viterbi search with survivor coalescence.

A repaired conversation is empty, or an optional system turn followed by user and
assistant turns in alternation that end with the assistant.  Edits of its turns in order:
Keep costs 0, Rerole to user or assistant 1, Delete 2, Insert of an empty turn 5; a blank
or repeated turn must be deleted, and a truncated one costs 5 more unless it is.  The
cheapest edits win, and among those the least string of their initials.

Per state of that pattern the search has one survivor, a node of a tree of back pointers
that counts its references.  A way that is dearer than another state's by more than that
one can ever lose is dropped, as are nodes that no survivor needs; once all survivors
share an ancestor, the edits up to it are given out and forgotten, so only the part still
open is in memory.  Equal costs are decided by the whole open parts of both candidates:
what is given out is common to them, and neither of two equally dear paths to a state can
be the beginning of the other, so the least one stays least whatever follows.

Rows are range-partitioned in their order, so a conversation of any size is spread over
tasks.  One that fits a chunk is finished in its task.  Of the others, every chunk is
searched from each state by the task that has it; a second pass puts the chunks together
with the same search, a chunk taking the place of a turn.  That pass reads a long
conversation in one task, chunk by chunk, since a digest of its text has to.

Defined cases: a null role or text is one space; a null conversation id is a conversation
of its own; turns are in ascending order, null first, and equal turns by role and text;
a role counts by its first character, and a turn with an empty or another role cannot be
kept; equal rows are repeats of the first; a row with no copies only names its
conversation; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.sources.scratch import cut_lineage

KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
KEEP_TRUNCATED = 5

#: Faults, the first one that a row has.
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
AFTER = {
    (START, "s"): SYSTEM,
    (START, "u"): USER,
    (SYSTEM, "u"): USER,
    (ASSISTANT, "u"): USER,
    (USER, "a"): ASSISTANT,
}
#: The role that a turn may be given in each state.
WANTED = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
ENDS = (START, ASSISTANT)
#: What a way from one state costs more, at most, than the best way from another one, whatever
#: follows.  From the start everything goes that goes after an assistant turn; after an
#: assistant turn the other way's system turn, or the user's missing answer, is deleted; an
#: open user turn deletes the other way's user turn or gets an empty answer; a lone system
#: turn gets an empty user turn, or two empty turns if nothing follows.
LAG = {
    START: {SYSTEM: 0, USER: DELETE, ASSISTANT: 0},
    SYSTEM: {START: 2 * INSERT, USER: INSERT, ASSISTANT: 2 * INSERT},
    USER: {START: INSERT, SYSTEM: DELETE, ASSISTANT: INSERT},
    ASSISTANT: {START: DELETE, SYSTEM: 0, USER: DELETE},
}
LEGAL = ("su", "ua", "au")

CHUNK_ROWS = 1024
CHUNK_BYTES = 2**20

Move = tuple[int, int, int, str]


def given(state: int) -> int:
    """The state after a turn of the wanted role."""
    return AFTER[state, WANTED[state][0]]


def inserts(state: int) -> list[tuple[int, int, str]]:
    """States reached by inserts alone, with cost and edits; more would come back."""
    one = given(state)
    return [(state, 0, ""), (one, INSERT, "I"), (given(one), 2 * INSERT, "II")]


def least(moves: Iterable[Move]) -> list[Move]:
    """The best move between each two states."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for q, r, cost, edits in moves:
        best[q, r] = min(best.get((q, r), (cost, edits)), (cost, edits))
    return [(q, r, cost, edits) for (q, r), (cost, edits) in best.items()]


def turn_moves(initial: str, fault: int) -> list[Move]:
    """All ways over one turn, with inserts before it."""
    moves = []
    for q in STATES:
        for state, cost, edits in inserts(q):
            moves.append((q, state, cost + DELETE, edits + "D"))
            if fault in (BLANK, DUPLICATE):
                continue
            extra = KEEP_TRUNCATED if fault == TRUNCATED else 0
            if (state, initial) in AFTER:
                moves.append((q, AFTER[state, initial], cost + KEEP + extra, edits + "K"))
            moves.append((q, given(state), cost + REROLE + extra, edits + "R"))
    return least(moves)


MOVES = {(i, f): turn_moves(i, f) for i in ("s", "u", "a", "") for f in (NONE, BLANK, DUPLICATE, TRUNCATED)}
#: Ways to the end of a conversation, which counts as one state.
LAST = least((q, START, cost, edits) for q in STATES for state, cost, edits in inserts(q) if state in ENDS)


class Node:
    """One step on the way to a survivor: its edits and the turns that they are of."""

    __slots__ = ("parent", "edits", "turns", "refs")

    def __init__(self, parent: Node | None, edits: str, turns: list) -> None:
        self.parent, self.edits, self.turns, self.refs = parent, edits, turns, 1
        if parent is not None:
            parent.refs += 1


class Survivors:
    """The cheapest way to each state, as ends of a tree of back pointers."""

    def __init__(self, entry: int) -> None:
        self.root = Node(None, "", [])
        self.best: dict[int, tuple[int, Node]] = {entry: (0, self.root)}

    def open_edits(self, node: Node, last: str = "") -> str:
        """All edits from the root to ``node``, and ``last``."""
        parts = [last]
        while node is not self.root:
            parts.append(node.edits)
            node = node.parent
        return "".join(reversed(parts))

    def advance(self, moves: Iterable[Move], turns: list) -> list[tuple[str, list]]:
        """Go on by ``moves`` over ``turns``; the steps that this settles."""
        chosen: dict[int, tuple[int, Node, str]] = {}
        for q, r, price, edits in moves:
            if q not in self.best:
                continue
            cost, node = self.best[q]
            cost += price
            other = chosen.get(r)
            if other is None or cost < other[0] or (
                cost == other[0] and self.open_edits(node, edits) < self.open_edits(*other[1:])
            ):
                chosen[r] = cost, node, edits
        before, self.best = self.best, {}
        for r, (cost, node, edits) in chosen.items():
            # A way that another state's way beats whatever follows is no survivor.
            if all(chosen[p][0] + LAG[p][r] >= cost for p in chosen if p != r):
                self.best[r] = cost, Node(node, edits, turns)
        for _, node in before.values():
            self.release(node)
        return self.settled()

    def release(self, node: Node) -> None:
        """A survivor is no longer one: drop what only it referred to."""
        node.refs -= 1
        while node.refs == 0 and node is not self.root:
            node = node.parent
            node.refs -= 1

    def settled(self) -> list[tuple[str, list]]:
        """Steps that all survivors share; they leave the tree."""
        if self.root.refs > 1:
            return []
        ends = [node for _, node in self.best.values()]
        way, node = [], ends[0]
        while node is not self.root:
            way.append(node)
            node = node.parent
        found = []
        while way and self.root.refs == 1 and self.root not in ends:
            self.root = way.pop()
            self.root.parent = None
            found.append((self.root.edits, self.root.turns))
        return found


@dataclass
class Tally:
    """What a run of turns of one conversation has; runs add up in order."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    low: int | None = None
    high: int | None = None
    turns: int = 0
    first: str | None = None
    last: str | None = None

    def add(self, other: Tally) -> None:
        self.blank += other.blank
        self.duplicate += other.duplicate
        self.truncated += other.truncated
        self.illegal += other.illegal
        if other.first is not None:
            if self.first is None:
                self.first = other.first
            elif self.last + other.first not in LEGAL:
                self.illegal += 1
            self.last = other.last
        if other.low is not None:
            self.turns += other.turns - (self.high == other.low)
            self.low = other.low if self.low is None else self.low
            self.high = other.high

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else min(self.high - self.low + 1 - self.turns, 2**63 - 1)


def tally_of(turn: int | None, initial: str, fault: int) -> Tally:
    found = Tally(low=turn, high=turn, turns=int(turn is not None), first=initial, last=initial)
    found.blank, found.duplicate, found.truncated = (int(fault == f) for f in (BLANK, DUPLICATE, TRUNCATED))
    return found


@dataclass
class Chunk:
    """Consecutive turns ``(role, text, fault)`` of one conversation."""

    conv_id: object
    opens: bool
    turns: list = field(default_factory=list)
    tally: Tally = field(default_factory=Tally)
    size: int = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.turns.append((role, text, fault))
        self.tally.add(tally_of(turn, role[:1], fault))
        self.size += len(role) + len(text)

    @property
    def full(self) -> bool:
        return len(self.turns) >= CHUNK_ROWS or self.size >= CHUNK_BYTES


def over_turns(survivors: Survivors, turns: list) -> Iterator[tuple[str, list]]:
    for turn in turns:
        initial = turn[0][:1]
        yield from survivors.advance(MOVES[initial if initial in ("s", "u", "a") else "", turn[2]], [turn])


def chunk_moves(turns: list) -> list[Move]:
    """The best way over a whole chunk between each two states."""
    moves = []
    for q in STATES:
        survivors = Survivors(q)
        done = "".join([edits for edits, _ in over_turns(survivors, turns)])
        moves += [(q, r, cost, done + survivors.open_edits(node)) for r, (cost, node) in survivors.best.items()]
    return moves


class Repaired:
    """Applies edits to turns in order; ``state`` tells the role that a new turn has."""

    def __init__(self) -> None:
        self.state = START

    def apply(self, steps: Iterable[tuple[str, list]]) -> Iterator[tuple[str, str | None, str | None]]:
        """``(edit, role, text)`` of every edit; a deleted turn has neither."""
        for edits, turns in steps:
            left = iter(turns)
            for edit in edits:
                role, text = WANTED[self.state], ""
                if edit != "I":
                    old, text, _ = next(left)
                    role = old if edit == "K" else role
                if edit == "D":
                    yield edit, None, None
                    continue
                self.state = AFTER[self.state, role[0]]
                yield edit, role, text


class Report:
    """One row per conversation: faults, cost, edits and a digest of what is left."""

    FIELDS = (
        "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    )

    def __init__(self) -> None:
        self.audit: list[str] = []
        self.digest = hashlib.sha256()
        self.between = ""

    def take(self, edits: Iterable[tuple[str, str | None, str | None]]) -> Iterator[dict]:
        for edit, role, text in edits:
            self.audit.append(edit)
            if role is not None:
                self.digest.update(f"{self.between}{role}:{text}".encode())
                self.between = "\n"
        return iter(())

    def close(self, tally: Tally, cost: int) -> Iterator[dict]:
        yield {
            "gaps": tally.gaps, "blank": tally.blank, "duplicate": tally.duplicate, "truncated": tally.truncated,
            "illegal": tally.illegal, "cost": cost, "audit": "".join(self.audit),
            "repaired_sha256": self.digest.hexdigest(),
        }


class Turns:
    """The repaired turns themselves, numbered from 1."""

    FIELDS = "place long, edit string, role string, text string"

    def __init__(self) -> None:
        self.place = 0

    def take(self, edits: Iterable[tuple[str, str | None, str | None]]) -> Iterator[dict]:
        for edit, role, text in edits:
            if role is not None:
                self.place += 1
                yield {"place": self.place, "edit": edit, "role": role, "text": text}

    def close(self, tally: Tally, cost: int) -> Iterator[dict]:
        return iter(())


#: A chunk of a conversation that other tasks may have parts of.
PIECE = (
    "part long, number long, tally struct<blank: long, duplicate: long, truncated: long, illegal: long, low: long, "
    "high: long, turns: long, first: string, last: string>, "
    "moves array<struct<q: int, r: int, cost: long, edits: string>>, rows array<struct<role: string, text: string>>"
)


def in_batches(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of some MB at most, or of one row."""
    waiting, size = [], 0
    for row in rows:
        waiting.append(row)
        size += 1 + sum(len(x) for x in row.values() if isinstance(x, str)) // 256
        if size >= 4096 or "rows" in row:
            yield pa.RecordBatch.from_pylist(waiting, schema)
            waiting, size = [], 0
    if waiting:
        yield pa.RecordBatch.from_pylist(waiting, schema)


def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Chunk, bool]]:
    """Chunks of sorted rows, and whether another conversation follows in the stream."""
    chunk, last = None, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "fault")]
        for conv_id, turn, role, text, copies, fault in zip(*columns):
            if chunk is None or chunk.conv_id != conv_id:
                if chunk is not None:
                    yield chunk, True
                chunk, last = Chunk(conv_id, opens=True), None
            for copy in range(copies):
                if chunk.full:
                    yield chunk, False
                    chunk = Chunk(conv_id, opens=False)
                if (turn, role, text) == last and fault != BLANK:
                    fault = DUPLICATE
                last = turn, role, text
                chunk.add(turn, role, text, fault)
    if chunk is not None:
        yield chunk, False


def search(batches: Iterable[pa.RecordBatch], output: Callable, part: int) -> Iterator[dict]:
    """Finished conversations, and pieces of those that may go on elsewhere."""
    for number, (chunk, closes) in enumerate(chunks(batches)):
        own = {"conv_id": chunk.conv_id}
        if number and chunk.opens and closes:
            survivors, out, repaired = Survivors(START), output(), Repaired()
            rows = out.take(repaired.apply(over_turns(survivors, chunk.turns)))
            yield from (own | row for row in rows)
            yield from (own | row for row in finish(survivors, out, repaired, chunk.tally))
            continue
        yield own | {
            "part": part,
            "number": number,
            "tally": vars(chunk.tally),
            "moves": [dict(zip(("q", "r", "cost", "edits"), move)) for move in chunk_moves(chunk.turns)],
            "rows": [{"role": role, "text": text} for role, text, _ in chunk.turns],
        }


def finish(survivors: Survivors, out: Report | Turns, repaired: Repaired, tally: Tally) -> Iterator[dict]:
    yield from out.take(repaired.apply(survivors.advance(LAST, [])))
    yield from out.close(tally, survivors.best[START][0])


def assemble(batches: Iterable[pa.RecordBatch], output: Callable) -> Iterator[dict]:
    """Conversations from their pieces, which come in order."""
    own = None
    for batch in batches:
        for i in range(batch.num_rows):  # a piece at a time: each may have a MB of text
            piece = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            if own is None or own["conv_id"] != piece["conv_id"]:
                if own is not None:
                    yield from (own | row for row in finish(survivors, out, repaired, tally))
                own = {"conv_id": piece["conv_id"]}
                survivors, out, repaired, tally = Survivors(START), output(), Repaired(), Tally()
            tally.add(Tally(**piece["tally"]))
            moves = [(m["q"], m["r"], m["cost"], m["edits"]) for m in piece["moves"]]
            turns = [(row["role"], row["text"], NONE) for row in piece["rows"]]
            rows = out.take(repaired.apply(survivors.advance(moves, turns)))
            yield from (own | row for row in rows)
    if own is not None:
        yield from (own | row for row in finish(survivors, out, repaired, tally))


def prepared(conversations: DataFrame, copies: Column) -> DataFrame:
    """``(conv_id, turn, role, text, copies, fault)``: the rows with their first fault."""
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        copies.cast("long").alias("copies"),
    )
    named = [F.col("conv_id").isNull(), "conv_id", "role", "text"]
    rows = rows.withColumns({"h1": F.xxhash64(*named), "h2": F.xxhash64(F.lit(1), *named)})
    # Only texts met again need to know where they stand first.
    again = rows.where("copies > 0").groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("met"), F.max(F.col("turn").isNull()).alias("at_null"), F.min("turn").alias("at")
    )
    again = cut_lineage(again.where("met > 1").drop("met"), "repeated_turns")
    later = F.when(F.col("at_null"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("at"))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
        .when(F.coalesce(later, F.lit(False)), DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED)
        .otherwise(NONE)
    )
    columns = ["conv_id", "turn", "role", "text", "copies"]
    return rows.join(again, ["h1", "h2"], "left").select(*columns, fault.alias("fault"))


def merge_equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one row with their copies, before they are shuffled."""
    for batch in batches:
        names = batch.schema.names
        merged = pa.table(batch).group_by([c for c in names if c != "copies"]).aggregate([("copies", "sum")])
        merged = merged.select([c if c != "copies" else "copies_sum" for c in names]).rename_columns(names)
        yield from merged.combine_chunks().to_batches()


def repair(conversations: DataFrame, output: Callable, copies: Column | None) -> DataFrame:
    rows = prepared(conversations, F.lit(1) if copies is None else copies)
    rows = rows.mapInArrow(merge_equal, rows.schema)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role")]
    # The bounds of the ranges come to the driver, so they have the beginnings of texts only.
    dealt = rows.repartitionByRange(*order, F.substring("text", 1, 64))
    dealt = dealt.sortWithinPartitions(*order, "text")
    result = StructType().add("conv_id", rows.schema["conv_id"].dataType)
    for name in StructType.fromDDL(output.FIELDS):
        result = result.add(name)
    both = StructType([*result, *StructType.fromDDL(PIECE)])
    arrow_both, arrow_result = to_arrow_schema(both), to_arrow_schema(result)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(search(batches, output, TaskContext.get().partitionId()), arrow_both)

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(assemble(batches, output), arrow_result)

    found = cut_lineage(dealt.mapInArrow(first_pass, both), "repaired")
    pieces = found.where("part IS NOT NULL").select("conv_id", "part", "number", "tally", "moves", "rows")
    pieces = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    done = found.where("part IS NULL").select(*result.names)
    return done.union(pieces.mapInArrow(second_pass, result))


def repair_report(conversations: DataFrame, copies: Column | None = None) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256)`` of every conversation.

    ``gaps`` are turn numbers missing between the first and the last, ``illegal`` adjacent
    turns that may not follow each other, both before repair; ``audit`` has the initials
    of the edits, and the digest is of the repaired ``role:text`` lines.  ``copies`` tells
    how often each row counts (once).
    """
    return repair(conversations, Report, copies)


def repaired_turns(conversations: DataFrame, copies: Column | None = None) -> DataFrame:
    """``(conv_id, place, edit, role, text)`` of every turn after repair."""
    return repair(conversations, Turns, copies)
