"""Conversation structure repair: the cheapest edits that give a conversation legal turns.

A conversation is written as one sign a turn, its role and fault. The distinct sequences, read from
their ends, form an automaton whose nodes are shared by all conversations that end alike. Sorted by
their reversed form, sequences with a common end stand together, so a task walks the automaton
depth first: the nodes of the open sequence are a stack, a common end is on it already, and each
node is worked out once: for every state of the grammar its cheapest cost and first edit.

Roles must read ``(s?(ua)+)?`` in the end. A state is what the grammar has read: nothing, ``s``,
``u`` or ``a``; in each at most one of ``u`` and ``a`` may follow, so an edit's initial says what it does.
Edits at equal cost have different initials, so the least audit takes the least initial.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clustercat.llm.common import small_batches
from clustercat.storage import keep

SPACE = " \t\n\x0b\f\r"
START, S, U, A = range(4)
# State to the state behind a user or assistant turn, and that turn's role.
NEXT = (U, U, A, U)
ROLE = ("user", "user", "assistant", "user")
ENDS = (START, A)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
# Signs of a turn: initial of a role that may be kept, "o" for others, in capitals if truncated; "x" must go.
GONE = "x"


class Node:
    """Cost to go and first edit for each state, with the state behind that edit."""

    __slots__ = ("cost", "edit", "then")

    def __init__(self, sign: str | None, rest: Node | None):
        if sign is None:
            choices = [[(0, "", state)] if state in ENDS else [] for state in range(4)]
        else:
            choices = [self._choices(sign, rest, state) for state in range(4)]
        # Insertions stay at the node; three of them pass through every state.
        cost = [min((c[0] for c in found), default=1 << 60) for found in choices]
        for _ in range(3):
            cost = [min(cost[q], INSERT + cost[NEXT[q]]) for q in range(4)]
        self.cost, self.edit, self.then = cost, [], []
        for q in range(4):
            found = [*choices[q], (INSERT + cost[NEXT[q]], "I", NEXT[q])]
            _, edit, then = min(c for c in found if c[0] == cost[q])
            self.edit.append(edit)
            self.then.append(then)

    @staticmethod
    def _choices(sign: str, rest: Node, state: int) -> list[tuple[int, str, int]]:
        """Edits of the turn: cost to the end, initial, state behind it."""
        found = [(DELETE + rest.cost[state], "D", state)]
        if sign == GONE:
            return found
        more = TRUNCATED if sign.isupper() else 0
        role, then = sign.lower(), NEXT[state]
        if role == ROLE[state][0]:
            found.append((KEEP + more + rest.cost[then], "K", then))
        elif role == "s" and state == START:
            found.append((KEEP + more + rest.cost[S], "K", S))
        found.append((REROLE + more + rest.cost[then], "R", then))
        return found


class Ends:
    """The automaton along one sequence at a time, from its end; give sequences in order of their reversed form."""

    def __init__(self):
        self.end = Node(None, None)
        self.stack: list[Node] = []
        self.reversed = ""
        self.made = 0

    def cheapest(self, signs: str) -> tuple[int, str]:
        """Cost and audit of a sequence."""
        turned = signs[::-1]
        common = len(commonprefix((turned, self.reversed)))
        del self.stack[common:]
        for sign in turned[common:]:
            self.stack.append(Node(sign, self.stack[-1] if self.stack else self.end))
            self.made += 1
        self.reversed = turned
        state, depth, audit = START, len(self.stack), []
        cost = (self.stack[-1] if self.stack else self.end).cost[START]
        while True:
            node = self.stack[depth - 1] if depth else self.end
            edit = node.edit[state]
            if not edit:
                return cost, "".join(audit)
            audit.append(edit)
            state = node.then[state]
            depth -= edit != "I"


def cheapest_repairs(sequences: DataFrame) -> DataFrame:
    """``signs, cost, audit`` for the distinct ``signs`` of ``sequences``.

    Sequences are dealt by ranges of their reversed form, so that common ends meet; only the
    nodes on the way to a border of two ranges are worked out on both sides.
    """

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = Ends()
        for batch in batches:
            signs = batch.column(0).to_pylist()
            found = [ends.cheapest(s) for s in signs]
            cost, audit = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cost, pa.int64()), pa.array(audit, pa.string())], ["signs", "cost", "audit"]
            )

    turned = F.reverse("signs")
    rows = sequences.select("signs").distinct().repartitionByRange(turned).sortWithinPartitions(turned)
    return rows.mapInArrow(solve, "signs string, cost long, audit string")


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long"
REPAIRED = ["conv_id", "turn_no", "role", "text", "edit"]
BATCH_ROWS = 10_000


class Faults:
    """Faults and signs of one conversation, whose turns are added in order."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.before = None
        self.signs: list[str] = []

    def add(self, turn: int | None, role: str, fault: str, copies: int, first: bool) -> None:
        if turn is not None and turn != self.most:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        initial = role[:1] or " "
        again = copies - first
        if fault == "blank":
            self.blank += copies
            self.signs.append(GONE * copies)
        else:
            self.duplicate += again
            if first:
                sign = initial if initial in "sua" else "o"
                self.truncated += fault == "truncated"
                self.signs.append(sign.upper() if fault == "truncated" else sign)
            self.signs.append(GONE * again)
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.illegal += copies - 1  # a copy behind its like
        self.before = initial

    def row(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, "".join(self.signs)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def conversation_faults(rows: DataFrame) -> DataFrame:
    """``conv_id``, the columns of ``REPORT`` and ``signs``, one row per conversation.

    Equal rows are counted first, so a row that repeats a million times is one; whether an earlier
    turn says the same is ranked among equal roles and texts. No text is shuffled.
    """
    end = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    fault = F.when(end == "", "blank").when(~end.isin(".", "!", "?"), "truncated").otherwise("")
    same = ["conv_id", "marker", "role", "digest"]
    turn = F.col("turn").asc_nulls_first()
    counted = rows.withColumn("fault", fault).groupBy(*same, "turn", "fault").agg(F.count(F.lit(1)).alias("copies"))
    first = F.row_number().over(Window.partitionBy(*same).orderBy(turn)) == 1
    marked = counted.withColumn("first", first).repartition("conv_id").sortWithinPartitions("conv_id", turn, "role", "digest")
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *(f.split()[0] for f in REPORT.split(", ")), "signs"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, faults, done, kinds = (), Faults(), [], []
        for batch in batches:
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 5, pa.string()]
            for conv, marker, *turn in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv,) != opened:
                    if opened:
                        done.append((*opened, *faults.row()))
                    opened, faults = (conv,), Faults()
                if not marker:
                    faults.add(*turn)
            if len(done) >= BATCH_ROWS:
                yield _batch(done, kinds, names)
                done = []
        if opened:
            yield _batch([*done, (*opened, *faults.row())], kinds, names)

    columns = ["conv_id", "marker", "turn", "role", "fault", "copies", "first"]
    return marked.select(*columns).mapInArrow(read, f"conv_id {kind}, {REPORT}, signs string")


def repaired_turns(rows: DataFrame, report: DataFrame) -> DataFrame:
    """``conv_id, turn_no, role, text, edit``: what each conversation reads after its edits, sorted in its task.

    A conversation's audit goes ahead of its turns in one sorted stream, so no turn is held.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    audits = report.select(
        "conv_id", F.lit(True).alias("marker"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
        F.col("audit").alias("text"), F.unhex(F.lit("")).alias("digest"),
    )
    order = ["conv_id", F.col("marker").desc(), F.col("turn").asc_nulls_first(), "role", "digest"]
    stream = rows.filter(~F.col("marker")).unionByName(audits).repartition("conv_id").sortWithinPartitions(*order)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, audit, at, state, number = None, "", 0, START, 0
        out: list[tuple] = []

        def insert():
            """Turns that the audit puts in here."""
            nonlocal at, state, number
            while audit[at : at + 1] == "I":
                out.append((opened, number, ROLE[state], "", "I"))
                at, state, number = at + 1, NEXT[state], number + 1

        for batch in batches:
            for conv, marker, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if marker:
                    insert()
                    opened, audit, at, state, number = conv, text, 0, START, 0
                    continue
                insert()
                edit = audit[at]
                at += 1
                if edit == "D":
                    continue
                then = S if edit == "K" and role[:1] == "s" else NEXT[state]
                out.append((conv, number, role if edit == "K" else ROLE[state], text, edit))
                state, number = then, number + 1
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
            if out:
                yield _batch(out, kinds, REPAIRED)
                out = []
        insert()
        if out:
            yield _batch(out, kinds, REPAIRED)

    types = f"conv_id {kind}, turn_no long, role string, text string, edit string"
    return stream.select("conv_id", "marker", "role", "text").mapInArrow(read, types)


def repair(
    turns: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    known: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The report, a row per conversation, and the repaired turns.

    The report holds ``conv_id, gaps, blank, duplicate, truncated, illegal, signs, cost, audit``. Ids
    of ``known`` are reported even where they have no turns: zeros and an empty audit. Turns are ordered by number, null
    first, ties by role and then by the text's digest; null roles and texts are one blank, which is no role and a blank
    turn; repeated rows are turns of their own, all but the first duplicates; null ids are one conversation; an
    empty table gives no rows; other columns are ignored. A conversation is one sequence: its signs
    and its audit, a character a turn, are held by a task.
    """
    small_batches(turns)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    text = blank(text_column)
    rows = turns.select(
        F.col(id_column).alias("conv_id"), F.lit(False).alias("marker"), F.col(turn_column).cast("long").alias("turn"),
        blank(role_column).alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    if known is not None:
        none = [F.lit(None).cast("long").alias("turn"), *(F.lit("").alias(c) for c in ("role", "text")), F.unhex(F.lit("")).alias("digest")]
        rows = rows.unionByName(known.select(F.col(id_column).alias("conv_id"), F.lit(True).alias("marker"), *none))
    faults = keep(conversation_faults(rows), "faults")
    repairs = keep(cheapest_repairs(faults), "repairs")
    report = keep(faults.join(repairs, "signs").select(*faults.columns, "cost", "audit"), "repair-report")
    return report, repaired_turns(rows, report)


def repaired_digest(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of ``role:text`` lines, from :func:`repaired_turns` as it stands in its tasks."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, digest, done, kinds = (), None, [], []
        names = ["conv_id", "repaired_sha256"]
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.string()]
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv,) != opened:
                    if opened:
                        done.append((*opened, digest.hexdigest()))
                    opened, digest = (conv,), hashlib.sha256(f"{role}:{text}".encode())
                else:
                    digest.update(f"\n{role}:{text}".encode())
            if len(done) >= BATCH_ROWS:
                yield _batch(done, kinds, names)
                done = []
        if opened:
            yield _batch([*done, (*opened, digest.hexdigest())], kinds, names)

    return repaired.select("conv_id", "role", "text").mapInArrow(read, f"conv_id {kind}, repaired_sha256 string")
