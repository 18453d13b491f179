import re

import pytest
from conftest_llm import no_documents, odd_documents

from clustercat.llm import mixing
from clustercat.storage import keep


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    """Targets by resharing the excess until none is above its limit; ``sizes`` as {source: size}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > repeats * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = float(repeats * sizes[s])
            left -= target[s]
        free -= over
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("block", [16, 2048])
def test_all_documents(shipped, folder, block):
    docs = shipped.read.parquet(f"{folder}/documents.parquet")
    rows, schedule = mixing.mix(docs, block=block)
    schedule = keep(schedule)
    taken = {r["id"]: r for r in mixing.taken_words(rows, schedule).collect()}
    texts = {r["doc_id"]: r for r in docs.collect()}
    sizes, played = {}, {}
    for i, r in texts.items():
        assert taken[i]["size"] == words(r["text"]) and 0 <= taken[i]["taken"] <= 2 * taken[i]["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
        played[r["source"]] = played.get(r["source"], 0) + taken[i]["taken"]
    target = brute_targets(sizes)
    for i, r in texts.items():
        assert taken[i]["source_size"] == sizes[r["source"]]
        assert taken[i]["target"] == pytest.approx(target[r["source"]])
    for source, amount in played.items():
        assert abs(amount - target[source]) < 1.001
    # A slot is one block of one source, full but for the source's last.
    slots = {}
    for r in schedule.collect():
        key, size = slots.get(r["slot"], ((r["source_id"], r["block_no"]), 0))
        assert key == (r["source_id"], r["block_no"])
        slots[r["slot"]] = (key, size + r["words"])
    last = {}
    for (source, number), size in slots.values():
        last[source] = max(last.get(source, 0), number)
    assert all(size == block or number == last[source] for (source, number), size in slots.values())
    again = mixing.taken_words(*mixing.mix(docs, block=block))
    assert {r["id"]: r["taken"] for r in again.collect()} == {i: r["taken"] for i, r in taken.items()}


def test_any_stretch_of_the_schedule_is_near_the_weights(shipped):
    sources = shipped.createDataFrame([(0, 50_000.0), (1, 30_000.0), (2, 20_000.0)], "source_id long, target double")
    order = [r["source_id"] for r in mixing.slot_schedule(sources, 10).orderBy("slot").collect()]
    assert len(order) == 10_000
    for start in range(0, 9_000, 500):
        part = order[start : start + 500]
        assert abs(part.count(0) / 500 - 0.5) < 0.02 and abs(part.count(2) / 500 - 0.2) < 0.02


def test_odd_rows(shipped):
    docs = odd_documents(shipped)
    rows, schedule = mixing.mix(docs, block=4)
    schedule = keep(schedule)
    taken = mixing.taken_words(rows, schedule).collect()
    assert len(taken) == 12
    for r in taken:
        assert r["taken"] <= 2 * r["size"]
    assert all(r["taken"] == 0 for r in taken if r["id"] in (3, 4, 5))
    texts = mixing.mixed_documents(docs, schedule)
    assert texts.columns == docs.columns
    assert sum(words(r["text"]) for r in texts.collect()) == sum(r["taken"] for r in taken)
    empty, none = mixing.mix(no_documents(shipped))
    assert empty.count() == 0 and none.count() == 0
    assert mixing.mixed_documents(no_documents(shipped), none).count() == 0
