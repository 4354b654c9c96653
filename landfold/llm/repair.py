"""Structure of conversations: faults, and the cheapest edits that mend them.

A conversation's rows, in order, and a small automaton for the roles that are allowed, (s?(ua)+)?, span a graph of nodes
(rows passed, state) whose arcs are edits with their costs. The least costs from the start and to the end identify all
arcs of optimal paths (tight: forward + arc + backward = optimum). A traversal from the start keeps the set of nodes that
the letters so far lead to and goes on by the least letter that a tight arc offers, which gives the ASCII-least of the
cheapest edits. (Here a sequence of letters determines the state, so the set has one node and the repaired rows are
unique.)

Scale: rows are pre-aggregated (equal rows of a turn are one row with a count) and put in order by ranges of (conversation,
turn, role, beginning of text), so that a conversation may go over many tasks. Within a task a conversation's rows are cut
into blocks of BLOCK_BYTES. A block that isn't a whole conversation is summed up as a matrix of least costs between states;
these matrices are folded forward and backward, and so are the states in which traversals leave blocks. The driver gets
about 200 bytes for two blocks of each partition and for each block within a longer conversation, never rows. Only the
digest of such a conversation's repaired text, which is sequential, and its audit are put together by one task, which
streams its parts in order.

Damage and faults are those of `damaged` and `ordered`.

Defined results: a null in any of conv_id, turn, role or text is one space where it is text; null turns come first, equal
turns go by role and then by text, and a null conv_id is a conversation. A role's initial is its first character; only s, u and
a can be kept. An empty or all-dropped conversation has zeros, an empty audit and the digest of the empty text; an empty table
gives no rows; other columns, whatever their names, are not read. Texts and conversations may have any length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, small_batches, utf8

#: Text of a block, and what a row counts besides its text; text that a part carries.
BLOCK_BYTES, ROW_BYTES, PART_TEXT = 32 << 20, 64, 1 << 20
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the automaton: nothing yet, after s, after u, after a. Where an inserted row leads, and the role it has.
STATES, ENDS, TO, ROLE = 4, (0, 3), (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: Which states a row that is kept may follow, by initial.
KEEPS = {"s": (0,), "u": (0, 1, 3), "a": (2,)}
LEADS = {"s": 1, "u": 2, "a": 3}
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60
#: Whitespace of the contract.
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: by crc32 of `conv_id:turn` modulo 20, 0 drops a row (it leaves copies 0 and no
    role), 1 empties its text, 2 takes `.`, `!` and `?` out, 3 doubles it, 4 makes its role user."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), told("role").alias("role"), told("text").alias("text"))
    act = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(F.col("act") == 1, "").when(F.col("act") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    kept = lambda c: F.when(F.col("act") != 0, c)
    return rows.withColumn("act", act).select("conv_id", kept(F.col("turn")).alias("turn"), kept(F.when(F.col("act") == 4, "user").otherwise(F.col("role"))).alias("role"), kept(text).alias("text"), F.when(F.col("act") == 0, 0).when(F.col("act") == 3, 2).otherwise(1).cast("long").alias("copies"))


def ordered(rows: DataFrame) -> DataFrame:
    """Damaged rows in order, each once with its copies, and their faults: blank, again (role and text were seen in an
    earlier turn), truncated. The frame is kept in the shared folder, partition after partition."""
    one = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    bare = F.expr(f"trim(TRAILING '{SPACE}' FROM text)")
    one = one.withColumn("digest", F.sha2("text", 256)).withColumn("blank", bare == "").withColumn("truncated", ~F.right(bare, F.lit(1)).isin(".", "!", "?"))
    # a role and text belong to the first turn that has them; the key of this join is unique
    first = rows.where("role is not null").select("conv_id", "role", F.sha2("text", 256).alias("digest"), "turn").groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("at"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("at.turn").alias("t"), F.lit(True).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")) & F.col("turn").eqNullSafe(F.col("t"))
    told = one.join(first, same, "left").select("conv_id", "turn", "role", "text", "copies", "blank", "truncated", F.col("first").isNull().alias("again"))
    order = ["conv_id", "turn", "role"]
    return cut(told.repartitionByRange(partitions(rows, 4), *order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text"))


def _arcs() -> list[list[list[tuple[str, int, int]]]]:
    """For a step's code (initial, must go, truncated) and each state: (letter, cost, next state), letters ascending."""
    out = []
    for code in range(16):
        initial, must_go, late = "sua?"[code & 3], code & 4, TRUNCATED if code & 8 else 0
        by_state = []
        for q in range(STATES):
            arcs = [("D", DELETE, q)]
            if not must_go:
                if q in KEEPS.get(initial, ()):
                    arcs.append(("K", late, LEADS[initial]))
                arcs.append(("R", REROLE + late, TO[q]))
            by_state.append(arcs)
        out.append(by_state)
    return out


ARCS = _arcs()
MUST_GO, LATE = 4, 8
#: A step: code and how often. More than once only where it must go.
Steps = list[tuple[int, int]]


def step_code(role: str, truncated: bool) -> int:
    found = "sua".find(role[:1]) if role else -1
    return (found if found >= 0 else 3) | (LATE if truncated else 0)


def _inserted(v: list[int]) -> list[int]:
    """Least costs from the start, when rows may be inserted here."""
    v = list(v)
    for _ in range(2):
        for q in range(STATES):
            v[TO[q]] = min(v[TO[q]], v[q] + INSERT)
    return v


def _to_insert(v: list[int]) -> list[int]:
    """Least costs to the end, when rows may be inserted here."""
    v = list(v)
    for _ in range(2):
        for q in range(STATES):
            v[q] = min(v[q], v[TO[q]] + INSERT)
    return v


START = _inserted([0 if q == 0 else FAR for q in range(STATES)])
END = _to_insert([0 if q in ENDS else FAR for q in range(STATES)])


def forward(steps: Steps, start: list[int]) -> list[list[int]]:
    out = [start]
    for code, times in steps:
        v = [FAR] * STATES
        for q, arcs in enumerate(ARCS[code]):
            for _, cost, to in arcs:
                v[to] = min(v[to], out[-1][q] + cost * times)
        out.append(_inserted(v))
    return out


def backward(steps: Steps, end: list[int]) -> list[list[int]]:
    out = [end]
    for code, times in reversed(steps):
        v = out[-1]
        out.append(_to_insert([min(cost * times + v[to] for _, cost, to in arcs) for arcs in ARCS[code]]))
    return out[::-1]


def matrix(steps: Steps) -> list[list[int]]:
    """Least costs between each state before the steps and each state after them."""
    return [forward(steps, _inserted([0 if p == q else FAR for p in range(STATES)]))[-1] for q in range(STATES)]


def traverse(steps: Steps, ahead: list[list[int]], back: list[list[int]], entry: int, last: bool) -> tuple[list[tuple[str, int, int]], int]:
    """The least letters of optimal paths from `entry`: (letter, state before it, how often), and the state at the end.

    ahead, back: least costs at each place. Rows inserted at the end are the next block's, unless this is the last one.
    """
    best = ahead[0][entry] + back[0][entry]
    frontier, out, i = {entry}, [], 0
    while i < len(steps) or (last and all(back[i][q] for q in frontier)):
        offers: dict[str, set[int]] = {}
        times = 1
        for q in frontier:
            if ahead[i][q] + INSERT + back[i][TO[q]] == best:
                offers.setdefault("I", set()).add(TO[q])
            if i < len(steps):
                code, times = steps[i]
                for letter, cost, to in ARCS[code][q]:
                    if ahead[i][q] + cost * times + back[i + 1][to] == best:
                        offers.setdefault(letter, set()).add(to)
        letter = min(offers)
        out.append((letter, next(iter(frontier)), 1 if letter == "I" else times))
        frontier = offers[letter]
        i += letter != "I"
    return out, next(iter(frontier))


@dataclass
class Found:
    """Counts of consecutive rows; what is needed to add those of the rows that follow."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    cost: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None
    first: str | None = None
    last: str | None = None

    def then(self, other: Found) -> Found:
        met = self.last is not None and other.first is not None
        return Found(
            self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated,
            self.illegal + other.illegal + int(met and self.last + other.first not in LEGAL), self.cost + other.cost,
            self.turns + other.turns - int(self.high is not None and self.high == other.low),
            other.low if self.low is None else self.low, self.high if other.high is None else other.high,
            other.first if self.first is None else self.first, self.last if other.last is None else other.last,
        )

    def gaps(self) -> int:
        return 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)


class Block:
    """Consecutive rows of a conversation: steps, counts, and (unless light) the rows that steps stand for."""

    def __init__(self, conv_id: int | None, number: int):
        self.conv_id, self.number, self.size = conv_id, number, 0
        self.steps: Steps = []
        self.rows: list[tuple[str, str]] = []
        self.found = Found()

    def add(self, turn, role, text, copies: int, blank: bool, truncated: bool, again: bool, size: int) -> None:
        self.size += size + ROW_BYTES
        if not copies:
            return
        initial, code = role[:1], step_code(role, truncated)
        own = Found(turns=int(turn is not None), low=turn, high=turn, first=initial, last=initial, illegal=copies - 1)
        if blank or again:
            own = replace(own, blank=copies if blank else 0, duplicate=0 if blank else copies)
            self.steps.append((code & 3 | MUST_GO, copies))
            self.rows.append((role, text))
        else:
            own = replace(own, duplicate=copies - 1, truncated=int(truncated))
            self.steps.append((code, 1))
            self.rows.append((role, text))
            if copies > 1:
                self.steps.append((code & 3 | MUST_GO, copies - 1))
                self.rows.append((role, text))
        self.found = self.found.then(own)

    def repaired(self, ahead, back, entry: int, last: bool) -> tuple[Iterator[str], Found, int, str]:
        """Lines, counts with the cost, the state at the end, and the letters."""
        path, state = traverse(self.steps, ahead, back, entry, last)
        letters = "".join(letter * times for letter, _, times in path)
        cost, i = 0, 0
        for letter, q, times in path:
            if letter == "I":
                cost += INSERT
            else:
                cost += next(c for x, c, _ in ARCS[self.steps[i][0]][q] if x == letter) * times
                i += 1

        def lines() -> Iterator[str]:
            at = 0
            for letter, q, _ in path:
                if letter == "I":
                    yield f"{ROLE[q]}:"
                    continue
                role, text = self.rows[at]
                at += 1
                if letter != "D":
                    yield f"{role if letter == 'K' else ROLE[q]}:{text}"

        return lines(), replace(self.found, cost=cost), state, letters


LIGHT = ["conv_id", "turn", "role", "copies", "blank", "truncated", "again", "size"]


def blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[Block, bool, bool]]:
    """A partition's blocks in order, and whether each begins and ends its conversation as far as the partition can tell: the
    first conversation may have begun before, and the last may go on after it."""
    before: Block | None = None
    begins = False  # the partition's first conversation may have begun before it
    for b in batches:
        texts = b.column("text").to_pylist() if "text" in b.schema.names else [""] * b.num_rows
        for conv_id, turn, role, copies, blank, truncated, again, size, text in zip(*(b.column(c).to_pylist() for c in LIGHT), texts, strict=True):
            if before is None:
                before = Block(conv_id, 0)
            elif conv_id != before.conv_id:
                yield before, begins, True
                before, begins = Block(conv_id, before.number + 1), True
            elif before.size >= block_bytes:
                yield before, begins, False
                before, begins = Block(conv_id, before.number + 1), False
            before.add(turn, role, text, copies, blank, truncated, again, size or 0)
    if before is not None:
        yield before, begins, False


def _packed(steps: Steps) -> bytes:
    return zlib.compress(np.array(steps, np.int64).reshape(-1, 2).tobytes(), 1)


def _unpacked(b: bytes) -> Steps:
    return [tuple(x) for x in np.frombuffer(zlib.decompress(b), np.int64).reshape(-1, 2).tolist()]


def _open_blocks(block_bytes: int):
    """The blocks that aren't whole conversations by themselves: steps, and the matrix of least costs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for block, begins, ends in blocks(batches, block_bytes):
            if begins and ends:
                continue
            flat = [x for row in matrix(block.steps) for x in row]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block.number], pa.int64()), pa.array([block.conv_id], pa.int64()), pa.array([_packed(block.steps)], pa.binary()), pa.array([flat], pa.list_(pa.int64()))], ["part", "number", "conv_id", "steps", "costs"])

    return run


@dataclass
class Place:
    """Of an open block: least costs from the start and to the end at its edges, where the traversal enters, whether it is last."""

    ahead: list[int]
    back: list[int]
    last: bool
    entry: int = 0


def _runs(open_blocks: list[tuple[int, int, int | None, list[int]]]) -> list[list[tuple[tuple[int, int], np.ndarray]]]:
    """Open blocks in order, those of a conversation together."""
    out: list = []
    before = None
    for part, number, conv_id, flat in sorted(open_blocks, key=lambda x: x[:2]):
        if before is None or conv_id != before[0]:
            out.append([])
        before = (conv_id,)
        out[-1].append(((part, number), [flat[i : i + STATES] for i in range(0, len(flat), STATES)]))
    return out


def places(rows: DataFrame, block_bytes: int) -> dict[tuple[int, int], Place]:
    """What each open block must know of the others of its conversation."""
    light = rows.select(*LIGHT)
    held = cut(light.mapInArrow(_open_blocks(block_bytes), "part int, number long, conv_id long, steps binary, costs array<long>"))
    runs = _runs([(r["part"], r["number"], r["conv_id"], r["costs"]) for r in held.select("part", "number", "conv_id", "costs").toLocalIterator()])
    at: dict[tuple[int, int], Place] = {}
    for run in runs:
        ahead = START
        for key, costs in run:
            at[key] = Place(ahead, END, key == run[-1][0])
            ahead = [min(min(ahead[p] + costs[p][q] for p in range(STATES)), FAR) for q in range(STATES)]
        back = END
        for key, costs in reversed(run):
            at[key].back = back
            back = [min(min(costs[p][q] + back[q] for q in range(STATES)), FAR) for p in range(STATES)]
    shared = held.sparkSession.sparkContext.broadcast(at)

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In which state a traversal leaves a block, for each state in which it can enter on an optimal path."""
        for b in batches:
            for part, number, steps in zip(*(b.column(c).to_pylist() for c in ("part", "number", "steps")), strict=True):
                here, steps = shared.value[part, number], _unpacked(steps)
                ahead, back = forward(steps, here.ahead), backward(steps, here.back)
                best = min(a + z for a, z in zip(ahead[0], back[0], strict=True))
                out = [traverse(steps, ahead, back, q, here.last)[1] if ahead[0][q] + back[0][q] == best else -1 for q in range(STATES)]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([out], pa.list_(pa.int32()))], ["part", "number", "leaves"])

    longer = {key for run in runs if len(run) > 1 for key, _ in run}
    if longer:
        left = {(r["part"], r["number"]): r["leaves"] for r in held.select("part", "number", "steps").mapInArrow(leave, "part int, number long, leaves array<int>").toLocalIterator()}
        for run in runs:
            state = 0
            for key, _ in run:
                at[key].entry = state
                state = left[key][state]
    # conversations of one block are whole after all
    return {key: place for key, place in at.items() if key in longer}


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPORT_NAMES = [c.split()[0] for c in REPORT.split(", ")]
PART = REPORT + ", part int, number long, piece long, turns long, low long, high long, first string, last string, text binary"
PART_NAMES = [c.split()[0] for c in PART.split(", ")]
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _TYPES[t]) for c, t in fields], [c for c, _ in fields])


def _report(conv_id: int | None, found: Found, audit: str, digest: str) -> dict:
    return {"conv_id": conv_id, "gaps": found.gaps(), "blank": found.blank, "duplicate": found.duplicate, "truncated": found.truncated, "illegal": found.illegal, "cost": found.cost, "audit": audit, "repaired_sha256": digest}


def _pieces(lines: Iterator[str]) -> Iterator[bytes]:
    """Lines joined, in pieces of about PART_TEXT."""
    held, size = [], 0
    for line in lines:
        held.append(utf8(line))
        size += len(held[-1])
        if size >= PART_TEXT:
            yield b"\n".join(held)
            held, size = [], 0
    if held:
        yield b"\n".join(held)


def _repair(at, block_bytes: int):
    """Reports of the conversations that a partition has whole, and parts (repaired_sha256 null) of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), []
        for block, _, _ in blocks(batches, block_bytes):
            place = at.value.get((part, block.number), None)
            here = place or Place(START, END, True)
            lines, found, _, letters = block.repaired(forward(block.steps, here.ahead), backward(block.steps, here.back), here.entry, here.last)
            if place is None:
                held.append(_report(block.conv_id, found, letters, hashlib.sha256(b"\n".join(map(utf8, lines))).hexdigest()))
            else:
                of = {"conv_id": block.conv_id, "part": part, "number": block.number}
                yield _batch([of | vars(found) | {"piece": 0, "audit": letters}], PART)
                for i, text in enumerate(_pieces(lines), 1):
                    yield _batch([of | vars(Found()) | {"piece": i, "audit": "", "text": text}], PART)
            if len(held) >= 500:
                yield _batch(held, PART)
                held = []
        if held:
            yield _batch(held, PART)

    return run


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports of conversations whose parts come in order."""
    conv_id, found, audit, digest, some = None, None, [], hashlib.sha256(), False
    for b in batches:
        for r in b.to_pylist():
            if found is None or r["conv_id"] != conv_id:
                if found is not None:
                    yield _batch([_report(conv_id, found, "".join(audit), digest.hexdigest())], REPORT)
                conv_id, found, audit, digest, some = r["conv_id"], Found(), [], hashlib.sha256(), False
            found = found.then(Found(**{c: r[c] for c in vars(found)}))
            audit.append(r["audit"])
            if r["text"] is not None:
                digest.update(b"\n" * some + r["text"])
                some = True
    if found is not None:
        yield _batch([_report(conv_id, found, "".join(audit), digest.hexdigest())], REPORT)


def repaired(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """REPORT for every conversation of rows that come damaged already (columns of `damaged`)."""
    spark = rows.sparkSession
    small_batches(spark)
    held = ordered(rows).withColumn("size", F.octet_length("text"))
    at = spark.sparkContext.broadcast(places(held, block_bytes))
    told = cut(held.select(*LIGHT, "text").mapInArrow(_repair(at, block_bytes), PART))
    parts = told.where("repaired_sha256 is null").repartition("conv_id").sortWithinPartitions("conv_id", "part", "number", "piece")
    return told.where("repaired_sha256 is not null").select(*REPORT_NAMES).unionByName(parts.mapInArrow(_together, REPORT))


def repair_report(conversations: DataFrame) -> DataFrame:
    """REPORT for every conversation, after the damage that `damaged` does to its rows."""
    return repaired(damaged(conversations))
