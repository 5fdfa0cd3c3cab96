"""Repair of conversation structure at the least cost, by depth-first branch-and-bound.

A conversation is its rows by turn, null turns first. Its roles, by their first letters, should be
an optional system turn and then pairs of user and assistant: ``(s?(ua)+)?``. Each row has one fault
at most, the first that holds: blank (white space alone), duplicate (role and text stood in an
earlier row) or truncated (the last letter that is not white space ends no sentence). A plan gives
each row an edit: Keep, Rerole to the role that fits, or Delete, which blank and duplicate rows
need; and it may Insert rows without text anywhere. Of the cheapest plans, the one whose letters
(D, I, K, R) sort first is taken.

The search keeps an explicit stack of prefixes (next row, last role, cost, letters). A prefix
goes when its cost and the lower bound of its rest exceed the incumbent, when it costs as much and its
letters sort after the incumbent's, or when the dominance table of its node (row, last role) holds a
prefix that costs less, or as much with letters that sort before. Bounds come from the rest's
costs alone, from each role, computed backwards. Children are tried from the smallest bound on,
then by letter, so the first plan found is cheap; the search ends when the stack is empty, which
proves the optimum. What stands behind a node depends on the node alone, so dominance loses nothing.

Rows are shuffled by conversation and stream through a task in order, as letters and flags alone. A
conversation of any length is solved in segments of SEGMENT rows: the search gives the best
prefix for each role that a segment can begin and end with, and the best of them goes on. Then texts
stream past the plans, in order. No conversation is held in memory, but its plan's letters are.
One conversation stays in one task, as its rows' hash and the plan are sequences; a task's memory does not
grow with it but for a letter a row.

Null roles and texts are empty. Rows of one turn are ordered by role, then by a hash of role and
text, so equal rows stand together. Rows with ``gone`` true are not part of the conversation, but the
conversation is listed. A null conversation id is a conversation of its own. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map

#: Costs of the edits, and of keeping a truncated row.
REROLE, DELETE, INSERT, CUT_KEPT = 3, 4, 3, 3
#: Rows that one search covers.
SEGMENT = 4096
#: Last roles of a prefix: nothing yet, system, user, assistant; and where a letter leads from there.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FOLLOWS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ENDS = (START, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
_FAR = 1 << 60

Row = tuple[str, int]  # first letter of the role, fault
Plan = tuple[int, str]  # cost, letters


def edits(row: Row, last: int) -> list[tuple[str, int, int]]:
    """(letter, cost, new last role) of what can be done with a row after ``last``."""
    letter, fault = row
    found = [("D", DELETE, last)]
    if fault not in (BLANK, DUPLICATE):
        cut = CUT_KEPT if fault == TRUNCATED else 0
        if (last, letter) in NEXT:
            found.append(("K", cut, NEXT[last, letter]))
        found.append(("R", REROLE + cut, FOLLOWS[last]))
    return found


def suffix_bounds(rows: list[Row], ends: tuple[int, ...]) -> list[list[int]]:
    """bounds[i][last]: the least cost of rows i and after, ending in one of ``ends``."""
    def inserted(costs: list[int]) -> list[int]:
        user, assistant = min(costs[USER], INSERT + costs[ASSISTANT]), min(costs[ASSISTANT], INSERT + costs[USER])
        return [min(costs[START], INSERT + user), min(costs[SYSTEM], INSERT + user), user, assistant]

    bounds = [inserted([0 if last in ends else _FAR for last in range(4)])]
    for row in reversed(rows):
        after = bounds[-1]
        bounds.append(inserted([min(cost + after[to] for _, cost, to in edits(row, last)) for last in range(4)]))
    return bounds[::-1]


def best_plan(rows: list[Row], begins: dict[int, Plan], ends: tuple[int, ...]) -> Plan | None:
    """The cheapest plan, of least letters, from one of ``begins`` (last role: what it cost so far) through ``rows`` to one of ``ends``."""
    bounds = suffix_bounds(rows, ends)
    incumbent: Plan | None = None
    dominance: dict[tuple[int, int], Plan] = {}

    def children(at: int, last: int, plan: Plan) -> list[tuple[int, int, Plan]]:
        found = [(at, FOLLOWS[last], (plan[0] + INSERT, plan[1] + "I"))]
        if at < len(rows):
            found += [(at + 1, to, (plan[0] + cost, plan[1] + letter)) for letter, cost, to in edits(rows[at], last)]
        return found

    def promise(node: tuple[int, int, Plan]) -> tuple[int, str]:
        return node[2][0] + bounds[node[0]][node[1]], node[2][1]

    stack = sorted(((0, last, plan) for last, plan in begins.items()), key=promise, reverse=True)
    while stack:
        at, last, plan = stack.pop()
        bound = plan[0] + bounds[at][last]
        if bound >= _FAR or (incumbent and (bound, plan[1]) > incumbent):  # a prefix of the incumbent's letters sorts before it
            continue
        if dominance.get((at, last), (_FAR, "")) <= plan:
            continue
        dominance[at, last] = plan
        if at == len(rows) and last in ends and (incumbent is None or plan < incumbent):
            incumbent = plan
        stack += sorted(children(at, last, plan), key=promise, reverse=True)
    return incumbent


class Repair:
    """The plan of one conversation whose rows come in order, a segment at a time."""

    def __init__(self, segment: int = SEGMENT):
        self.segment = segment
        self.begins: dict[int, Plan] = {START: (0, "")}
        self.rows: list[Row] = []

    def add(self, row: Row) -> None:
        if len(self.rows) == self.segment:
            # Letters of the segment alone are searched; each begin's own come before them.
            found: dict[int, Plan] = {}
            for end in range(4):
                for begin, (cost, letters) in self.begins.items():
                    plan = best_plan(self.rows, {begin: (0, "")}, (end,))
                    if plan:
                        whole = (cost + plan[0], letters + plan[1])
                        found[end] = min(found.get(end, whole), whole)
            self.begins, self.rows = found, []
        self.rows.append(row)

    def plan(self) -> Plan:
        found = []
        for begin, (cost, letters) in self.begins.items():
            plan = best_plan(self.rows, {begin: (0, "")}, ENDS)
            if plan:
                found.append((cost + plan[0], letters + plan[1]))
        return min(found)


# On tables ------------------------------------------------------------------------------


def _gone(rows: DataFrame) -> Column:
    return F.coalesce("gone", F.lit(False)) if "gone" in rows.columns else F.lit(False)


def ordered_rows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, name, gone): what is compared and sorted by; ``name`` is a hash of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    shaped = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), _gone(conversations).alias("gone"))
    return shaped.withColumn("name", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def _order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.col("role"), F.col("name")]


def plans(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit), one row for each conversation of ``ordered_rows``."""
    solid = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(solid == "", BLANK).when(F.right(solid, F.lit(1)).isin(".", "!", "?"), OK).otherwise(TRUNCATED)
    slim = rows.select("conv", "turn", F.substring("role", 1, 1).alias("letter"), "role", "name", "gone", fault.alias("fault")).repartition("conv")
    # The shuffle by conversation serves the window too. Rows that are gone are no earlier ones.
    earlier = Window.partitionBy("conv", "gone", "name").orderBy(F.asc_nulls_first("turn"))
    slim = slim.withColumn("nth", F.row_number().over(earlier)).sortWithinPartitions("conv", *_order(), "nth")
    slim = slim.select("conv", "turn", "letter", F.when((F.col("fault") != BLANK) & (F.col("nth") > 1), DUPLICATE).otherwise(F.col("fault")).alias("fault"), "gone")

    def solve(conv, rows: Iterator[tuple]) -> tuple:
        repair, counts, turns, illegal, before = Repair(segment), [0] * 4, [None, None, 0], 0, None
        for _, turn, letter, fault, gone in rows:
            if gone:
                continue
            counts[fault] += 1
            illegal += before is not None and before + letter not in ("su", "ua", "au")
            before = letter
            if turn is not None and turn != turns[1]:  # rows come by turn
                turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
            repair.add((letter, fault))
        cost, audit = repair.plan()
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
        return conv, gaps, counts[BLANK], counts[DUPLICATE], counts[TRUNCATED], illegal, cost, audit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        found: list[tuple] = []
        for conv, own in groupby(every, key=lambda row: row[0]):
            found.append(solve(conv, own))
            if len(found) == 256:
                yield _batch(found, names, types)
                found = []
        yield _batch(found, names, types)

    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    types = [pa.int64()] * 7 + [pa.string()]
    return arrow_map(slim.withColumn("conv", F.col("conv").cast("long")), run, ", ".join(f"{n} {'string' if n == 'audit' else 'long'}" for n in names))


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


_FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _beside(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's plan, then its rows in order, in one task."""
    none = F.lit(None).cast("long")
    heads = plans.select("conv", F.lit(0).alias("kind"), none.alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("name"), F.col("audit").alias("text"), *_FIGURES)
    body = rows.filter("not gone").select(F.col("conv").cast("long").alias("conv"), F.lit(1).alias("kind"), "turn", "role", "name", "text", *[none.alias(c) for c in _FIGURES])
    return heads.unionByName(body).repartition("conv").sortWithinPartitions("conv", "kind", *_order()).drop("name")


def _steps(every: Iterator[tuple]) -> Iterator[tuple]:
    """(head, edit, turn, role, text) for each edit of a plan that is beside its rows; a head alone first."""
    for conv, own in groupby(every, key=lambda row: row[0]):
        _, _, _, _, audit, *figures = next(own)
        head, last = (conv, *figures, audit), START
        yield head, None, None, None, None
        for edit in audit:
            if edit == "I":
                last = FOLLOWS[last]
                yield head, edit, None, ROLES[last], ""
                continue
            _, _, turn, role, text, *_ = next(own)
            if edit == "K":
                last = NEXT[last, role[:1]]
            elif edit == "R":
                last = FOLLOWS[last]
                role = ROLES[last]
            yield head, edit, turn, role, text


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))


def repaired_turns(conversations: DataFrame, **columns: str) -> DataFrame:
    """(conv, place, edit, turn, role, text): the rows of all repaired conversations, ``place`` from 0; deleted rows are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        place, held = 0, 0
        for head, edit, turn, role, text in _steps(_rows(batches)):
            if edit is None:
                place = 0
            elif edit != "D":
                found.append((head[0], place, edit, turn, role, text))
                place, held = place + 1, held + len(text)
                if len(found) >= 1024 or held > 4 << 20:
                    yield _batch(found, names, types)
                    found, held = [], 0
        yield _batch(found, names, types)

    names, types = ["conv", "place", "edit", "turn", "role", "text"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    rows = ordered_rows(conversations, **columns)
    return arrow_map(_beside(rows, plans(rows)), run, "conv long, place long, edit string, turn long, role string, text string")


def digest(conversations: DataFrame, segment: int = SEGMENT, **columns: str) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): figures, plan and hash of the repaired ``role:text`` lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for head, steps in groupby(_steps(_rows(batches)), key=lambda step: step[0]):
            lines, between = hashlib.sha256(), b""
            for _, edit, _, role, text in steps:
                if edit is not None and edit != "D":
                    lines.update(between + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                    between = b"\n"
            found.append((*head, lines.hexdigest()))
            if len(found) == 256:
                yield _batch(found, names, types)
                found = []
        yield _batch(found, names, types)

    names, types = ["conv_id", *_FIGURES, "audit", "repaired_sha256"], [pa.int64()] * 7 + [pa.string()] * 2
    rows = ordered_rows(conversations, **columns)
    return arrow_map(_beside(rows, plans(rows, segment)), run, "conv_id long, " + ", ".join(f"{c} long" for c in _FIGURES) + ", audit string, repaired_sha256 string")
