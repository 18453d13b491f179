"""Chat formatting: a state machine over roles and a template that says how a turn is written.

Turns arrive sorted by conversation and turn and are formatted as they stream by; only
the state of the open conversation is held, so a conversation may be of any length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What stands before and after a turn's text, and whether the text counts for the loss.
# "*" is any other role, whose name is written in place of {role}.
TEMPLATE = {
    "system": {"before": "<s>[SYS] ", "after": " [/SYS]", "loss": False},
    "user": {"before": "<s>[INST] ", "after": " [/INST]", "loss": False},
    "assistant": {"before": " ", "after": " </s>", "loss": True},
    "*": {"before": "<s>[ROLE] {role} [/ROLE] ", "after": " [/TURN]", "loss": False},
}
CONTROLS = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[TURN]", "[/TURN]")
# State to the roles that may follow; a state is the role before, which may be empty or unknown, None the start.
TURNS = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}

SEGMENTS = "conv_id {id}, turn_no long, segment_no int, text string, loss boolean, error string"
BATCH_CHARS = 4 << 20

_control = re.compile("|".join(map(re.escape, CONTROLS)))


def escape(text: str) -> str:
    """Double each backslash, and put one behind the first character of each control string."""
    return _control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def turn_segments(role: str, text: str, template: dict) -> list[tuple[str, bool]]:
    """The turn's three segments with their loss flags."""
    named = role in template and role != "*"
    form = template[role if named else "*"]
    before = form["before"] if named else form["before"].replace("{role}", escape(role))
    return [(before, False), (escape(text), form["loss"]), (form["after"], False)]


def parse_turn(written: str, template: dict) -> tuple[str, str]:
    """Role and text of a formatted turn, from its marks alone."""
    for role, form in template.items():
        before = re.escape(form["before"]).replace(re.escape("{role}"), "(?P<role>.*?)")
        if m := re.fullmatch(f"{before}(?P<text>.*){re.escape(form['after'])}", written, re.DOTALL):
            return (unescape(m["role"]) if role == "*" else role), unescape(m["text"])
    raise ValueError("the turn has no marks of the template")


def format_chat(
    turns: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    template: dict = TEMPLATE,
) -> DataFrame:
    """Segments ``conv_id, turn_no, segment_no, text, loss, error``, three for each row of ``turns``.

    Joined in order they are the formatted conversation. ``error`` says on a turn's segments
    why its role may not stand there; such turns are formatted all the same. Null
    texts and roles count as empty, and an empty or unknown role is written out by
    name. Turns are ordered by number, null first, ties by role and text; repeated rows are turns of
    their own; null ids are one conversation; an empty table gives no rows; other columns are ignored.
    """
    kind = turns.schema[id_column].dataType.simpleString()

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, state, number = (), None, 0
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv,) != opened:
                    opened, state, number = (conv,), None, 0
                allowed = TURNS.get(state, tuple(TURNS["assistant"]))
                error = None if role in allowed else f"{role or 'no role'} after {'the start' if state is None else state or 'no role'}"
                for k, (part, loss) in enumerate(turn_segments(role, text, template)):
                    out.append((conv, number, k, part, loss, error))
                    size += len(part)
                state, number = role, number + 1
                if size >= BATCH_CHARS:
                    yield _segments(out, batch.schema.field(0).type)
                    out, size = [], 0
            if out:
                yield _segments(out, batch.schema.field(0).type)

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(
        F.col(id_column).alias("conv_id"), empty(role_column).alias("role"), empty(text_column).alias("text"),
        F.col(turn_column).alias("turn"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    return rows.mapInArrow(convert, SEGMENTS.format(id=kind))


def _segments(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
    names = ["conv_id", "turn_no", "segment_no", "text", "loss", "error"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_back(segments: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Per conversation what its formatted text says: turns, digests, text under the loss mask, errors.

    Roles and texts are parsed from the joined segments of each turn.
    """
    kind = segments.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, errors long"
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple = ()
        turns = loss = None
        counts = [0, 0, 0, 0]  # turns, loss characters, formatted characters, errors
        parts: list[str] = []
        done: list[tuple] = []

        def close_turn():
            if parts:
                role, text = parse_turn("".join(parts), template)
                turns.update(f"{role}\n{text}\n".encode())
                parts.clear()

        def close():
            if opened:
                close_turn()
                done.append((opened[0], counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2], counts[3]))

        def batch_of(type_):
            kinds = [type_, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = [f.split()[0] for f in schema.split(", ")]
            columns = zip(*done) if done else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        type_ = None
        for batch in batches:
            type_ = batch.schema.field(0).type
            for conv, k, text, masked, error in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv,) != opened:
                    close()
                    opened, turns, loss, counts = (conv,), hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0]
                if k == 0:
                    close_turn()
                    counts[0] += 1
                    counts[3] += error is not None
                parts.append(text)
                counts[2] += len(text)
                if masked:
                    plain = unescape(text)
                    loss.update(plain.encode())
                    counts[1] += len(plain)
            if len(done) >= 10_000:
                yield batch_of(type_)
                done.clear()
        close()
        if type_ is not None:
            yield batch_of(type_)

    rows = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no", "segment_no")
    return rows.select("conv_id", "segment_no", "text", "loss", "error").mapInArrow(digest, schema)
