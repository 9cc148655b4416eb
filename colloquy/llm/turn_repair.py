"""Repair of conversation structure: the cheapest edits that make roles read `(s?(ua)+)?`, by divide and conquer.

A conversation is a sequence of steps between four states. What a step, or any run of steps, costs from state to state is a small
matrix, and so is the order in which its cheapest edits sort. Both compose, so forward and backward vectors of four costs meet in the
middle of a run, the crossing of least cost (of several, the one whose edits sort first) is fixed, and both halves go on alone: the
edits of a run are found in space linear in its length, and a conversation of any length is cut into blocks that are worked on apart.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.arrow import arrow_schema, map_columns, rows_batch
from colloquy.llm.shared import written

#: States: nothing so far, after a system turn, after a user's, after an assistant's. A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The state that an inserted or renamed turn leads to.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Where a kept turn leads to, by state and initial of its role.
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
RENAME, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
NEVER = 1 << 40
#: Rows and characters of a block at most (one row at least), and blocks or runs that are folded at a time.
BLOCK_ROWS, BLOCK_CHARS, FOLD = 2048, 2 << 20, 6
LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\x0b\x0c\r"


class Step(NamedTuple):
    """From state to state: costs, the places of the edits among those from the same state, and (of single turns) the edits."""

    cost: tuple
    order: tuple
    edits: tuple | None = None


def places(keys: list) -> tuple:
    """The rank of each key; None stands last."""
    ranked = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] if keys[i] is not None else 0))
    out = [0] * len(keys)
    for rank, i in enumerate(ranked):
        out[i] = rank
    return tuple(out)


@functools.cache
def step(kind: str) -> Step:
    """The step of a turn: `x` must be deleted; else the initial of its role, a capital if the turn is cut off.

    Inserted turns stand right before the turn that makes them necessary; two in a row lead to any state that insertions reach.
    """
    cut = CUT_OFF if kind.isupper() else 0
    best: list[dict] = [{} for _ in STATES]
    for p in STATES:
        at, put, paid = p, "", 0
        for _ in range(3):
            ways = [(at, DELETE, "D")]
            if kind != "x":
                ways.append((NEXT[at], RENAME + cut, "R"))
                if (at, kind.lower()) in KEEP:
                    ways.append((KEEP[at, kind.lower()], cut, "K"))
            for q, cost, letter in ways:
                best[p][q] = min(best[p].get(q, (NEVER, "")), (paid + cost, put + letter))
            at, put, paid = NEXT[at], put + "I", paid + INSERT
    edits = tuple(tuple(row[q][1] if q in row else None for q in STATES) for row in best)
    return Step(tuple(tuple(row[q][0] if q in row else NEVER for q in STATES) for row in best), tuple(places(list(row)) for row in edits), edits)


def ahead(costs: list, order: tuple, one: Step) -> tuple[list, tuple]:
    """Vectors after one more step: least costs of the four states, and the places of their edits among each other.

    All edits so far end with a turn of the same number, so none is the beginning of another: who sorts first before sorts first after.
    """
    out, keys = [], []
    for q in STATES:
        cost, place, p = min((costs[p] + one.cost[p][q], order[p], p) for p in STATES)
        out.append(min(cost, NEVER))
        keys.append((place, one.order[p][q]) if cost < NEVER else None)
    return out, places(keys)


def back(costs: list, one: Step) -> list:
    """Least costs from each state to the end, one step earlier."""
    return [min(min(map(sum, zip(row, costs))), NEVER) for row in one.cost]


def fold(steps: list[Step]) -> Step:
    """One step for all of them."""
    rows = []
    for p in STATES:
        costs, order = [0 if q == p else NEVER for q in STATES], (0,) * 4
        for one in steps:
            costs, order = ahead(costs, order, one)
        rows.append((tuple(costs), order))
    return Step(tuple(r[0] for r in rows), tuple(r[1] for r in rows))


def crossings(steps: list[Step], first: int, last: int) -> list[int]:
    """The states before each step, and after the last one, of the cheapest edits (of several, those that sort first) from `first` to `last`."""
    out = [first] * len(steps) + [last]
    todo = [(0, len(steps))] if steps else []
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        costs, order = [0 if q == out[lo] else NEVER for q in STATES], (0,) * 4
        for one in steps[lo:mid]:
            costs, order = ahead(costs, order, one)
        rest = [0 if q == out[hi] else NEVER for q in STATES]
        for i in range(hi - 1, mid - 1, -1):
            rest = back(rest, steps[i])
        out[mid] = min((costs[q] + rest[q], order[q], q) for q in STATES)[2]
        todo += [(lo, mid), (mid, hi)]
    return out


#: Turns that are inserted at the very end, by state.
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def ending(whole: Step) -> tuple[int, int]:
    """(cost, last state) of a whole conversation."""
    cost, _, q = min((whole.cost[START][q] + INSERT * len(CLOSING[q]), whole.order[START][q], q) for q in STATES)
    return cost, q


def kinds(roles: list[str], texts: list[str], again: set[int]) -> tuple[list[str], tuple[int, int, int]]:
    """The kind of each turn, and how many are blank, repeats (`again`: their places) and cut off; the first of these counts."""
    out, found = [], [0, 0, 0]
    for i, (role, text) in enumerate(zip(roles, texts)):
        shown = text.rstrip(WHITE)
        fault = 0 if not shown else 1 if i in again else 2 if shown[-1] not in ".!?" else None
        if fault is not None:
            found[fault] += 1
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        out.append("x" if fault in (0, 1) else initial.upper() if fault == 2 else initial)
    return out, tuple(found)


class Tally(NamedTuple):
    """Counts of a run of turns in order, and what its neighbours need to know of its ends."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first_role: str | None = None
    last_role: str | None = None
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None

    def __add__(self, more: Tally) -> Tally:
        if more.first_role is None:
            return self
        if self.first_role is None:
            return more
        wrong = self.last_role + more.first_role not in LEGAL
        same = self.last_turn is not None and self.last_turn == more.first_turn
        return Tally(
            self.blank + more.blank, self.duplicate + more.duplicate, self.truncated + more.truncated, self.illegal + more.illegal + wrong,
            self.first_role, more.last_role, self.turns + more.turns - same,
            self.first_turn if self.first_turn is not None else more.first_turn, more.last_turn if more.last_turn is not None else self.last_turn,
        )

    @property
    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns


def tallied(turns: list, roles: list[str], found: tuple[int, int, int]) -> Tally:
    numbers = [t for t in turns if t is not None]
    wrong = sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:]))
    return Tally(*found, wrong, roles[0][:1], roles[-1][:1], len(set(numbers)), min(numbers, default=None), max(numbers, default=None))


def edited(roles: list[str], texts: list[str], own: list[str], states: list[int], end: str = "") -> tuple[str, list[str], list[str]]:
    """The edits of a run of turns, and the roles and texts that they leave."""
    audit, left, said = [], [], []
    for i, kind in enumerate(own):
        edits, at = step(kind).edits[states[i]][states[i + 1]], states[i]
        audit.append(edits)
        for letter in edits:
            if letter == "D":
                continue
            at = NEXT[at] if letter in "IR" else KEEP[at, kind.lower()]
            left.append(roles[i] if letter == "K" else NAMES[at])
            said.append("" if letter == "I" else texts[i])
    at = states[-1]
    for _ in end:
        at = NEXT[at]
        left.append(NAMES[at])
        said.append("")
    return "".join(audit) + end, left, said


def solved(turns: list, roles: list[str], texts: list[str]) -> tuple[Tally, int, str, list[str], list[str]]:
    """A whole conversation at once."""
    seen, again = set(), set()
    for i, one in enumerate(zip(roles, texts)):
        again.add(i) if one in seen else seen.add(one)
    own, found = kinds(roles, texts, again)
    steps = list(map(step, own))
    cost, last = ending(fold(steps))
    return tallied(turns, roles, found), cost, *edited(roles, texts, own, crossings(steps, START, last), CLOSING[last])


# The same over tables.

TALLY = "blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, turns long, first_turn long, last_turn long"
STEP = "cost array<long>, order array<long>"


def flat(one: Step) -> tuple[list, list]:
    return [x for row in one.cost for x in row], [x for row in one.order for x in row]


def unflat(cost: list, order: list) -> Step:
    return Step(tuple(tuple(cost[i : i + 4]) for i in range(0, 16, 4)), tuple(tuple(order[i : i + 4]) for i in range(0, 16, 4)))


def same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    """Equality of these columns, nulls included."""
    return functools.reduce(Column.__and__, (a[c].eqNullSafe(b[c]) for c in columns))


def cut(turns: DataFrame, conv: str, rows: int, chars: int) -> DataFrame:
    """Blocks of consecutive turns, one row each: conv_id, part, block, whole, turns, roles, texts.

    Turns are dealt to ranges of (conversation, turn, role, text), so a conversation of any length is spread; equal rows are counted before and
    written out again here. `whole`: no other block has turns of the conversation.
    """
    kind = turns.schema[conv].dataType.simpleString()
    schema = f"conv_id {kind}, part int, block int, whole boolean, turns array<long>, roles array<string>, texts array<string>"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, block = None, [], 0, 0
        first, begun = True, False  # no conversation has ended yet; a block of this one is made
        made, waiting = [], 0

        def close(whole: bool) -> None:
            nonlocal block, held, size, waiting
            made.append((now[0], part, block, whole, *map(list, zip(*held))))
            waiting += size
            block, held, size = block + 1, [], 0

        for batch in batches:
            for part, one, turn, role, text, copies in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if now is None or now[0] != one:
                    if held:
                        close(not first and not begun)
                        first = False
                    now, begun = (one,), False
                for _ in range(copies):
                    if held and (len(held) >= rows or size + len(text) > chars):
                        close(False)
                        begun = True
                    held.append((turn, role, text))
                    size += len(text)
                if len(made) >= 512 or waiting > chars:
                    yield rows_batch(made, out)
                    made, waiting = [], 0
        if held:
            close(False)
        yield rows_batch(made, out)

    named = turns.select(F.col(f"`{conv}`").alias("conv_id"), "turn", "role", "text")
    counted = named.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    # the first letters of texts are enough to cut ranges by, and sort as texts do
    ranged = counted.repartitionByRange(*order[:3], F.substring("text", 1, 48)).sortWithinPartitions(*order)
    return ranged.select(F.spark_partition_id().alias("part"), "conv_id", "turn", "role", "text", "copies").mapInArrow(run, schema)


def repeats(blocks: DataFrame) -> DataFrame:
    """conv_id, part, block, again: places of turns whose role and text an earlier turn of the conversation has.

    A block sends each of its turns' digests once, with the first place; only first places that aren't the conversation's first come back.
    """
    kind = blocks.schema["conv_id"].dataType.simpleString()

    def run(convs, parts, numbers, roles, texts):
        out = []
        for conv, part, block, own, said in zip(convs, parts, numbers, roles, texts):
            firsts: dict = {}
            for i, (role, text) in enumerate(zip(own, said)):
                firsts.setdefault(hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), i)
            out += [(conv, part, block, i, digest) for digest, i in firsts.items()]
        return dict(zip(("conv_id", "part", "block", "at", "digest"), map(list, zip(*out)))) if out else {c: [] for c in ("conv_id", "part", "block", "at", "digest")}

    own = map_columns(blocks, {"conv_id": "conv_id", "part": "part", "block": "block", "roles": "roles", "texts": "texts"}, run, f"conv_id {kind}, part int, block int, at int, digest binary")
    least = own.groupBy("conv_id", "digest").agg(F.min(F.struct("part", "block", "at")).alias("least"))
    met = own.join(least.withColumnRenamed("conv_id", "c").withColumnRenamed("digest", "d"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")))
    return met.where(F.struct("part", "block", "at") > F.col("least")).groupBy("conv_id", "part", "block").agg(F.collect_list("at").alias("again"))


def again_in(roles: list[str], texts: list[str], late: list[int] | None) -> set[int]:
    """Places of repeats in a block: those of a turn of the block, and those of turns before it (`late`: their first places)."""
    before = {(roles[i], texts[i]) for i in late or ()}
    out = set()
    for i, one in enumerate(zip(roles, texts)):
        out.add(i) if one in before else before.add(one)
    return out


def folded(runs: DataFrame, group: str, by: str) -> DataFrame:
    """Runs (conv_id, `by`, tally, cost, order) of a conversation and group folded into one, with the steps of its children kept."""
    kind = runs.schema["conv_id"].dataType.simpleString()
    both = runs.groupBy("conv_id", F.expr(group).alias("run")).agg(F.sort_array(F.collect_list(F.struct(by, "tally", "cost", "order"))).alias("own"))

    def run(convs, keys, own):
        steps = [[unflat(x["cost"], x["order"]) for x in xs] for xs in own]
        flats = [flat(fold(s)) for s in steps]
        tallies = [sum((Tally(**x["tally"]) for x in xs), Tally())._asdict() for xs in own]
        return {"conv_id": convs, "run": keys, "tally": tallies, "cost": [f[0] for f in flats], "order": [f[1] for f in flats],
                "children": [[{"id": x[by], "cost": x["cost"], "order": x["order"]} for x in xs] for xs in own]}

    schema = f"conv_id {kind}, run long, tally struct<{TALLY.replace(' ', ': ').replace(',: ', ', ')}>, cost array<long>, order array<long>, children array<struct<id: long, cost: array<long>, order: array<long>>>"
    return map_columns(both, {"conv_id": "conv_id", "run": "run", "own": "own"}, run, schema)


def descended(groups: DataFrame, states: DataFrame) -> DataFrame:
    """conv_id, run, id, first, last: the states around each child of the groups, from those around the groups (conv_id, run, first, last)."""
    kind = groups.schema["conv_id"].dataType.simpleString()

    def run(convs, keys, children, firsts, lasts):
        out = []
        for conv, key, own, first, last in zip(convs, keys, children, firsts, lasts):
            at = crossings([unflat(x["cost"], x["order"]) for x in own], first, last)
            out += [(conv, key, x["id"], at[i], at[i + 1]) for i, x in enumerate(own)]
        return {c: [r[i] for r in out] for i, c in enumerate(("conv_id", "run", "id", "first", "last"))}

    given = states.withColumnsRenamed({"conv_id": "c", "run": "r"})
    met = groups.join(given, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r")))
    return map_columns(met, {c: c for c in ("conv_id", "run", "children", "first", "last")}, run, f"conv_id {kind}, run long, id long, first int, last int")


PIECE = "conv_id {kind}, part int, block int, audit string, roles array<string>, texts array<string>"


def pieces_of_long(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Totals (conv_id, tally, spent, last) and repaired pieces of conversations that may have several blocks.

    Blocks are folded to one step each, those of a part of the sort to one, then 64 parts at a time; crossings come back the same way.
    """
    kind = blocks.schema["conv_id"].dataType.simpleString()
    late = repeats(blocks).withColumnsRenamed({"conv_id": "c", "part": "p", "block": "b"})
    known = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("block") == F.col("b"))
    blocks = written(blocks.join(late, known, "left").drop("c", "p", "b"), "turns")

    def leaf(convs, parts, numbers, turns, roles, texts, again):
        tallies, costs, orders = [], [], []
        for t, r, s, late in zip(turns, roles, texts, again):
            own, found = kinds(r, s, again_in(r, s, late))
            one = flat(fold(list(map(step, own))))
            tallies.append(tallied(t, r, found)._asdict())
            costs.append(one[0])
            orders.append(one[1])
        return {"conv_id": convs, "part": parts, "block": numbers, "tally": tallies, "cost": costs, "order": orders}

    named = TALLY.replace(" ", ": ").replace(",: ", ", ")
    columns = {c: c for c in ("conv_id", "part", "block", "turns", "roles", "texts", "again")}
    leaves = map_columns(blocks, columns, leaf, f"conv_id {kind}, part long, block long, tally struct<{named}>, {STEP}")
    # the parts of a sort are numbered from zero
    top = blocks.agg(F.max("part")).first()[0] or 0
    levels = [written(folded(leaves.withColumn("id", F.col("block")), "part", "id"), "runs")]
    while top:
        top >>= FOLD
        levels.append(written(folded(levels[-1].withColumn("id", F.col("run")), f"shiftright(run, {FOLD})", "id"), "runs"))
    totals = map_columns(levels[-1], {c: c for c in ("conv_id", "tally", "cost", "order")}, lambda convs, tallies, costs, orders: {
        "conv_id": convs, "tally": tallies, **dict(zip(("spent", "last"), map(list, zip(*(ending(unflat(c, o)) for c, o in zip(costs, orders))))))} if convs else {
        "conv_id": [], "tally": [], "spent": [], "last": []}, f"conv_id {kind}, tally struct<{named}>, spent long, last int")
    totals = written(totals, "totals")
    states = totals.select("conv_id", F.lit(0).cast("long").alias("run"), F.lit(START).alias("first"), "last")
    for level in reversed(levels):
        states = descended(level, states)
        if level is not levels[0]:
            states = states.select("conv_id", F.col("id").alias("run"), "first", "last")
    states = states.select(F.col("conv_id").alias("c"), F.col("run").alias("p"), F.col("id").alias("b"), "first", "last")

    def made(convs, parts, numbers, roles, texts, again, firsts, lasts):
        out = []
        for r, s, late, first, last in zip(roles, texts, again, firsts, lasts):
            own, _ = kinds(r, s, again_in(r, s, late))
            out.append(edited(r, s, own, crossings(list(map(step, own)), first, last)))
        return {"conv_id": convs, "part": parts, "block": numbers, "audit": [x[0] for x in out], "roles": [x[1] for x in out], "texts": [x[2] for x in out]}

    met = blocks.join(states, known)
    pieces = map_columns(met, {c: c for c in ("conv_id", "part", "block", "roles", "texts", "again", "first", "last")}, made, PIECE.format(kind=kind))

    def closing(convs, lasts):
        ends = [edited([], [], [], [q], CLOSING[q]) for q in lasts]
        return {"conv_id": convs, "part": [2**31 - 1] * len(convs), "block": [0] * len(convs), "audit": [x[0] for x in ends], "roles": [x[1] for x in ends], "texts": [x[2] for x in ends]}

    return totals, pieces.unionByName(map_columns(totals, {"conv_id": "conv_id", "last": "last"}, closing, PIECE.format(kind=kind)))


RESULT = "conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def told(conv, tally: Tally, cost: int, audit: str, digest: str) -> tuple:
    return conv, tally.gaps, tally.blank, tally.duplicate, tally.truncated, tally.illegal, cost, audit, digest


def lines(roles: list[str], texts: list[str]) -> list[str]:
    return [f"{r}:{t}" for r, t in zip(roles, texts)]


class Repair:
    """Repaired conversations of turns (conv_id, turn, role, text).

    Turns stand by number (nulls first), then role and text, so ties have one order; null roles and texts are read as one space; turns
    with a null conv_id are a conversation of their own; further columns don't matter; an empty table gives empty results. Blank turns and
    repeats of an earlier turn's role and text are deleted; others are kept, renamed or deleted, and empty turns inserted, at least cost.
    """

    def __init__(self, turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rows: int = BLOCK_ROWS, chars: int = BLOCK_CHARS):
        def text(c):
            return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))

        named = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
        self.kind = named.schema["conv_id"].dataType.simpleString()
        self.blocks = written(cut(named, "conv_id", rows, chars), "blocks")

    @functools.cached_property
    def long(self) -> tuple[DataFrame, DataFrame]:
        return pieces_of_long(self.blocks.where("not whole"))

    def turns(self) -> DataFrame:
        """conv_id, part, block, pos, role, text: the repaired turns; part, block and pos are in order within a conversation."""

        def made(convs, parts, numbers, turns, roles, texts):
            out = [solved(*x)[2:] for x in zip(turns, roles, texts)]
            return {"conv_id": convs, "part": parts, "block": numbers, "audit": [x[0] for x in out], "roles": [x[1] for x in out], "texts": [x[2] for x in out]}

        columns = {c: c for c in ("conv_id", "part", "block", "turns", "roles", "texts")}
        short = map_columns(self.blocks.where("whole"), columns, made, PIECE.format(kind=self.kind))
        both = short.unionByName(self.long[1])
        return both.select("conv_id", "part", "block", F.posexplode(F.arrays_zip("roles", "texts")).alias("pos", "own")).select("conv_id", "part", "block", "pos", F.col("own.roles").alias("role"), F.col("own.texts").alias("text"))

    def audits(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

        The digest of a conversation has to be taken turn by turn; a task that does so for a long one holds a block at a time.
        """
        schema = RESULT.format(kind=self.kind)
        names = [f.name for f in arrow_schema(schema)]

        def short(convs, turns, roles, texts):
            out = []
            for conv, *own in zip(convs, turns, roles, texts):
                tally, cost, audit, left, said = solved(*own)
                out.append(told(conv, tally, cost, audit, hashlib.sha256("\n".join(lines(left, said)).encode()).hexdigest()))
            return {c: [r[i] for r in out] for i, c in enumerate(names)}

        out = arrow_schema(f"conv_id {self.kind}, audit string, repaired_sha256 string")

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, audit, digest, any_ = None, [], None, False
            for batch in batches:
                for conv, edits, roles, texts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    if now != (conv,):
                        if now:
                            yield rows_batch([(*now, "".join(audit), digest.hexdigest())], out)
                        now, audit, digest, any_ = (conv,), [], hashlib.sha256(), False
                    audit.append(edits)
                    for line in lines(roles, texts):
                        digest.update((f"\n{line}" if any_ else line).encode())
                        any_ = True
            if now:
                yield rows_batch([(*now, "".join(audit), digest.hexdigest())], out)

        totals, pieces = self.long
        placed = pieces.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "block").select("conv_id", "audit", "roles", "texts")
        digests = placed.mapInArrow(stream, f"conv_id {self.kind}, audit string, repaired_sha256 string").withColumnRenamed("conv_id", "c")
        gaps = "if(tally.first_turn is null, 0L, tally.last_turn - tally.first_turn + 1 - tally.turns) AS gaps"
        long_ = totals.join(digests, F.col("conv_id").eqNullSafe(F.col("c"))).selectExpr("conv_id", gaps, "tally.blank", "tally.duplicate", "tally.truncated", "tally.illegal", "spent AS cost", "audit", "repaired_sha256")
        return map_columns(self.blocks.where("whole"), {c: c for c in ("conv_id", "turns", "roles", "texts")}, short, schema).unionByName(long_)
