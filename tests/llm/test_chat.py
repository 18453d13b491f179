import random

import pytest
from conftest_llm import with_clashes

from clustercat.llm import chat


@pytest.mark.parametrize("text", ["", "\\", "</s>[INST] ok [/INST]", "<\\/s>", "\\\\<s>", "<<s>>", "[[INST]]", "<s", "a\nb", *chat.CONTROLS])
def test_escape_is_undone_and_leaves_no_control(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def test_random_turns_are_read_back():
    draw = random.Random(0)
    signs = ["\\", "<", ">", "/", "s", "[", "]", " ", "INST", "SYS", "ROLE", "TURN", "\n", "é", *chat.CONTROLS]
    for _ in range(5000):
        role = draw.choice(["system", "user", "assistant", "", "tool", "[/ROLE] x", "*"])
        text = "".join(draw.choice(signs) for _ in range(draw.randint(0, 12)))
        written = "".join(part for part, _ in chat.turn_segments(role, text, chat.TEMPLATE))
        assert chat.parse_turn(written, chat.TEMPLATE) == (role, text)


def test_odd_rows(shipped):
    rows = [
        (1, 0, "user", "hello"), (1, 1, "assistant", None), (1, 1, "assistant", None), (1, None, "system", ""),
        (2, 5, None, "x"), (2, 6, "tool", "y"), (None, 0, "user", "long " * 50_000), (None, 1, "assistant", "z"),
        (3, 0, "assistant", "early"),
        (4, 0, "user", "a"), (4, 1, "assistant", "b"), (4, 2, None, "c"), (4, 3, "system", "d"), (4, 4, "user", "e"),
    ]
    turns = with_clashes(shipped.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    segments = chat.format_chat(turns)
    found = {r["conv_id"]: r for r in chat.read_back(segments).collect()}
    assert {i: r["n_turns"] for i, r in found.items()} == {1: 4, 2: 2, None: 2, 3: 1, 4: 5}
    assert {i: r["errors"] for i, r in found.items()} == {1: 1, 2: 2, None: 0, 3: 1, 4: 2}
    assert found[None]["loss_chars"] == 1 and found[3]["loss_chars"] == 5
    parts = [r for r in segments.collect() if r["conv_id"] == 1]
    parts.sort(key=lambda r: (r["turn_no"], r["segment_no"]))
    assert "".join(r["text"] for r in parts) == "<s>[SYS]  [/SYS]<s>[INST] hello [/INST]  </s>  </s>"
    assert [r["error"] for r in parts[-3:]] == ["assistant after assistant"] * 3
    assert [r["loss"] for r in parts] == [False] * 7 + [True, False, False, True, False]
    nothing = turns.filter("conv_id = 99")
    assert chat.read_back(chat.format_chat(nothing)).count() == 0
