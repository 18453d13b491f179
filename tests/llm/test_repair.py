import hashlib
import itertools
import random
import re
import sys
import zlib
from functools import cache

from conftest_llm import with_clashes

from clustercat.llm import repair as r
from clustercat.llm.queries import QUERIES, table

SPACES = " \t\n\x0b\f\r"
LEGAL = re.compile(r"(s?(ua)+)?")
sys.setrecursionlimit(20_000)


@cache
def cheapest(signs, last="", inserted=0):
    """Least (cost, audit) of all edits behind a turn of role ``last``."""
    found = [(0, "")] if not signs and last in ("", "a") else []
    for role in {"": "su", "s": "u", "u": "a", "a": "u"}[last]:
        if role != "s" and inserted < 4:
            cost, audit = cheapest(signs, role, inserted + 1)
            found.append((cost + 2, "I" + audit))
        if signs and signs[0] != "x":
            cost, audit = cheapest(signs[1:], role)
            more = signs[0].isupper()
            if signs[0].lower() == role:
                found.append((cost + more, "K" + audit))
            if role != "s":
                found.append((cost + 2 + more, "R" + audit))
    if signs:
        cost, audit = cheapest(signs[1:], last)
        found.append((cost + 3, "D" + audit))
    return min(found, default=(10**9, ""))


def test_automaton_against_all_edits_and_each_node_once():
    draw = random.Random(5)
    every = ["".join(p) for n in range(4) for p in itertools.product("suaoSUAOx", repeat=n)]
    every += ["".join(draw.choice("suaoSUAOx") for _ in range(draw.randint(0, 9))) for _ in range(2000)]
    ends = r.Ends()
    for signs in sorted(set(every), key=lambda s: s[::-1]):
        assert ends.cheapest(signs) == cheapest(signs)
    assert ends.made == len({s[k:] for s in every for k in range(len(s))})


def test_a_long_sequence_is_walked_without_recursion():
    cost, audit = r.Ends().cheapest("ua" * 100_000)
    assert cost == 0 and audit == "K" * 200_000


def plain(rows):
    """The report and repaired lines of one conversation's rows after damage."""
    rows = sorted(rows, key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).digest()))
    seen, signs, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        core = text.strip(SPACES)
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        sign = role[:1] if role[:1] in ("s", "u", "a") else "o"
        signs += "x" if fault in ("blank", "duplicate") else sign.upper() if fault else sign
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    numbers = {t for t, _, _ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    cost, audit = cheapest(signs)
    lines, last, at = [], "", 0
    for edit in audit:
        following = "a" if last == "u" else "u"
        if edit == "I":
            lines.append(({"u": "user", "a": "assistant"}[following], ""))
        else:
            _, role, text = rows[at]
            at += 1
            if edit == "D":
                continue
            lines.append((role if edit == "K" else {"u": "user", "a": "assistant"}[following], text))
        last = lines[-1][0][0]
    assert LEGAL.fullmatch("".join(role[0] for role, _ in lines))
    digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in lines).encode()).hexdigest()
    return (gaps, *counts.values(), illegal, cost, audit, digest)


def damage(rows):
    for conv, turn, role, text in rows:
        conv_name, turn_name = (" " if x is None else x for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{conv_name}:{turn_name}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        yield from [(conv, (turn, role, text))] * (0 if kind == 0 else 2 if kind == 3 else 1)


def expected(rows):
    groups = {conv: [] for conv, *_ in rows}
    for conv, row in damage(rows):
        groups[conv].append(row)
    return {conv: plain(found) for conv, found in groups.items()}


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_query_against_all_edits(shipped, folder):
    rows = [tuple(x) for x in table(shipped, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    found = QUERIES["op13_conversation_repair"](shipped, folder).collect()
    assert {x["conv_id"]: tuple(x[c] for c in COLUMNS) for x in found} == expected(rows)


def odd_rows():
    draw = random.Random(9)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User"], ["Yes.", "No", "", " \n", None, "What?", "a b! "]
    rows = [
        (conv, draw.choice([None, 0, 1, 2, 3, 5, 9]), draw.choice(roles), draw.choice(texts))
        for conv in [None, *range(60)] for _ in range(draw.randint(1, 8))
    ]
    return rows + rows[:40] + [(1000, t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(120)]


def test_odd_rows(shipped, tmp_path):
    rows = odd_rows()
    turns = shipped.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    with_clashes(turns).write.parquet(f"{tmp_path}/conversations.parquet")
    found = QUERIES["op13_conversation_repair"](shipped, str(tmp_path)).collect()
    assert {x["conv_id"]: tuple(x[c] for c in COLUMNS) for x in found} == expected(rows)
    report, repaired = r.repair(with_clashes(turns))
    groups = {}
    for conv, *row in rows:
        row = (row[0], *(" " if x is None else x for x in row[1:]))
        groups.setdefault(conv, []).append(row)
    told = {conv: plain(g) for conv, g in groups.items()}
    assert {x["conv_id"]: (x["cost"], x["audit"]) for x in report.collect()} == {c: t[5:7] for c, t in told.items()}
    lines = {}
    for x in repaired.collect():
        lines.setdefault(x["conv_id"], []).append((x["turn_no"], f"{x['role']}:{x['text']}"))
    for conv, t in told.items():
        found = sorted(lines.get(conv, []))
        assert [n for n, _ in found] == list(range(len(found)))
        assert hashlib.sha256("\n".join(line for _, line in found).encode()).hexdigest() == t[7]


def test_empty_and_long(shipped):
    turns = shipped.createDataFrame([], "conv_id long, turn long, role string, text string")
    report, repaired = r.repair(turns)
    assert report.count() == 0 and repaired.count() == 0
    known = shipped.createDataFrame([(1,), (1,), (None,)], "conv_id long")
    report, repaired = r.repair(turns, known=known)
    assert sorted((x["cost"], x["audit"]) for x in report.collect()) == [(0, ""), (0, "")] and repaired.count() == 0
    long = shipped.createDataFrame([(1, 0, "user", "x" * 5_000_000 + "."), (1, 1, "assistant", "ok" + " " * 1_000_000)], turns.schema)
    report, repaired = r.repair(long)
    assert report.first()["audit"] == "KK" and report.first()["truncated"] == 1
