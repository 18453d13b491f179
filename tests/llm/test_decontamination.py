import random
import re

import pytest
from conftest_llm import no_documents, odd_documents, with_clashes

from clustercat.llm import decontamination as dc
from clustercat.llm.queries import QUERIES, table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(texts, items, size):
    """Words, hit words and items of each text, from all pairs of windows and places."""
    windows = [(i, w[k : k + size]) for i, t in items for w in [words(t)] if w for k in range(max(len(w) - size + 1, 1))]
    rows = []
    for text in texts:
        w, hit, names = words(text), set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit.update(range(k, k + len(x)))
                    names |= {i} - {None}
        rows.append((len(w), hit, sorted(names)))
    return rows


def windows_of(items, size):
    rows = set()
    for item, text in items:
        w = [x for block in dc._blocks((text or "").encode(), 7) for x in block]
        rows |= {(item, b" ".join(w[k : k + size])) for k in range(max(len(w) - size + 1, 1)) if w}
    return list(rows)


def test_random_texts_against_all_places(monkeypatch):
    draw = random.Random(3)
    monkeypatch.setattr(dc, "STRETCH", 5)
    for _ in range(300):
        some, size = ["a", "B", "b", "É", "é", "日", "x1", "y" * 70][: draw.randint(2, 8)], draw.randint(1, 4)
        text = lambda most: "".join(draw.choice(some) + draw.choice([" ", "-", "\n", "  "]) for _ in range(draw.randint(0, most)))
        items, texts = [(draw.choice([None, "1", "2", "10"]), text(6)) for _ in range(4)], [text(30) for _ in range(5)] + [None, ""]
        found = dc.scan_texts(dc.WindowSet(windows_of(items, size)), [None if t is None else t.encode() for t in texts])
        found = [(n, {k for i, j in spans for k in range(i, j)}, names) for n, spans, names in found]
        assert found == plain(texts, items, size)


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(dc.WindowSet, "hashes", staticmethod(lambda n, size: (n[: max(len(n) - size + 1, 0)] * 0).astype("uint64")))
    items, texts = [("1", "a b c d"), ("2", "b c a")], ["a b c a b", "c b a", "b c d"]
    found = dc.scan_texts(dc.WindowSet(windows_of(items, 2)), [t.encode() for t in texts])
    assert [(n, {k for i, j in s for k in range(i, j)}, names) for n, s, names in found] == plain(texts, items, 2)


@pytest.mark.parametrize("block_bytes", [1, 200, dc.BLOCK_BYTES])
def test_all_documents_in_any_number_of_blocks(shipped, folder, block_bytes):
    if block_bytes == 1:  # a block for nearly every byte is too many for a test: few items
        items = table(shipped, folder, "benchmark").filter("item_id < 2").withColumn("text", dc.F.substring("text", 1, 80))
        block_bytes = 400
    else:
        items = table(shipped, folder, "benchmark")
        block_bytes = max(block_bytes, 30_000)
    docs = table(shipped, folder, "documents")
    rows = docs.collect()
    found = {r["id"]: r for r in dc.find_contamination(docs, items, block_bytes=block_bytes).collect()}
    told = plain([r["text"] for r in rows], [(str(r["item_id"]), r["text"]) for r in items.collect()], 10)
    assert len(found) == len(rows)
    for r, (n, hit, names) in zip(rows, told):
        f = found[r["doc_id"]]
        assert (f["n_words"], {k for s in f["spans"] for k in range(s["first"], s["stop"])}, f["items"]) == (n, hit, names)


def test_hits_are_cut_or_dropped(shipped):
    docs = with_clashes(shipped.createDataFrame(
        [(1, "Intro. One, TWO three!\nRest é"), (2, "nothing here"), (1, "one two"), (None, "one two three"), (3, None)],
        "doc_id long, text string",
    ))
    items = shipped.createDataFrame([(7, "one two three"), (None, "nothing"), (8, "é")], "item_id long, text string")
    found = dc.find_contamination(docs, items, window=3)
    names = {(r["id"], r["n_words"]): (len(r["spans"]), r["items"]) for r in found.collect()}
    assert names == {(1, 6): (2, ["7", "8"]), (2, 2): (1, []), (1, 2): (0, []), (None, 3): (1, ["7"]), (3, 0): (0, [])}
    cut = dc.remove_contamination(docs, found)
    assert cut.columns == docs.columns
    texts = [(r["doc_id"], r["text"]) for r in cut.collect()]
    assert sorted(texts, key=repr) == sorted([(1, "Intro. !\nRest "), (2, " here"), (1, "one two"), (None, ""), (3, None)], key=repr)
    left = dc.remove_contamination(docs, found, whole=True).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left if r["text"]) == [(1, "one two")] and len(left) == 2


def test_odd_tables(shipped):
    odd, none = odd_documents(shipped), no_documents(shipped)
    items = with_clashes(shipped.createDataFrame(
        [(1, "The cat sat"), (1, "the CAT sat"), (2, None), (3, ""), (None, "mat"), (4, "one")], "item_id long, text string"
    ))
    found = dc.find_contamination(odd, items, window=3).collect()
    assert len(found) == 12 and sum(r["items"] == ["1"] for r in found) == 4 and max(r["n_words"] for r in found) == 60_000
    assert sorted(len(r["spans"]) for r in found) == [0] * 6 + [1] * 2 + [2] * 4
    assert dc.find_contamination(none, items).count() == 0
    assert dc.find_contamination(odd, items.filter("item_id = 99")).filter("size(spans) > 0").count() == 0
    giant = shipped.createDataFrame([(1, "w" * 3_000_000 + " x " + "é" * 2_000_000)], "doc_id long, text string")
    assert dc.find_contamination(giant, giant.withColumnRenamed("doc_id", "item_id")).first()["items"] == ["1"]


def test_query_columns(shipped, folder):
    rows = QUERIES["op11_benchmark_decontamination"](shipped, folder).collect()
    assert any(r["contaminated"] for r in rows) and all(r["contaminated"] == (r["n_hit"] > 0) for r in rows)
