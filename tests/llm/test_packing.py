import itertools
import random
import zlib

import numpy as np
import pytest
from conftest_llm import no_documents, odd_documents
from tokenizers import Tokenizer

from clustercat.llm import packing
from clustercat.llm.queries import word_vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(word_vocabulary())


def check(rows, texts, tokenizer, capacity):
    """Pieces are the texts' ids in order; sequences have no gaps and hold at most ``capacity``."""
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts}
    pieces = {i: [] for i in ids}
    for r in rows:
        part = ids[r["id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        pieces[r["id"]].append((r["piece"], r["start"], r["length"]))
    for i, found in pieces.items():
        sizes = [min(capacity, len(ids[i]) - at) for at in range(0, len(ids[i]), capacity)]
        assert sorted(found) == [(k, k * capacity, n) for k, n in enumerate(sizes)]
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_all_documents(shipped, folder, tokenizer, capacity):
    docs = shipped.read.parquet(f"{folder}/documents.parquet")
    rows = packing.pack(docs, word_vocabulary(), capacity=capacity).collect()
    bins = check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer, capacity)
    total = sum(r["length"] for r in rows)
    assert bins <= -(-total // capacity) + 1


def test_odd_rows(shipped, tokenizer):
    rows = packing.pack(odd_documents(shipped).filter("doc_id is not null and doc_id <> 1"), word_vocabulary()).collect()
    texts = [(r["doc_id"], r["text"]) for r in odd_documents(shipped).collect()]
    check(rows, [t for t in texts if t[0] not in (None, 1)], tokenizer, 2048)
    rows = packing.pack(odd_documents(shipped), word_vocabulary()).collect()
    assert sum(r["id"] is None for r in rows) == 2 and sum(r["id"] == 1 for r in rows) == 2
    assert packing.pack(no_documents(shipped), word_vocabulary()).count() == 0


def test_words_give_the_ids_of_the_whole_text(tokenizer):
    words = packing.WordTokens(word_vocabulary(), remembered=300)
    draw = random.Random(1)
    signs = [*"aAbBzZ09 \t\n'.,!?<|>éÉǰŹσΣςİß  日本😀_-/\\&́̌", "'s", "'LL", "<|endoftext|>", "J̌", "Å"]
    for _ in range(3000):
        text = "".join(draw.choice(signs) for _ in range(draw.randint(0, 30)))
        found = np.frombuffer(b"".join(words.encode(text.encode())), "<u4").tolist()
        assert found == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_fullest_is_the_largest_sum():
    draw = random.Random(2)
    for _ in range(200):
        counts = {draw.randint(1, 20): draw.randint(1, 3) for _ in range(4)}
        room = draw.randint(0, 40)
        items = list(counts.items())
        best = max(
            total
            for picks in itertools.product(*(range(n + 1) for _, n in items))
            if (total := sum(k * length for k, (length, _) in zip(picks, items))) <= room
        )
        chosen = packing.fullest(counts, room)
        assert sum(length * n for length, n in chosen.items()) == best
        assert all(n <= counts[length] for length, n in chosen.items())


def test_patterns_use_every_piece_once():
    draw = random.Random(3)
    histogram = {length: draw.randint(1, 50) for length in range(1, 51)}
    patterns = packing.bin_patterns(histogram, 100)
    used = {}
    for repeats, pattern in patterns:
        assert sum(length * n for length, n in pattern.items()) <= 100
        for length, n in pattern.items():
            used[length] = used.get(length, 0) + n * repeats
    assert used == histogram
    total = sum(length * n for length, n in histogram.items())
    assert sum(r for r, _ in patterns) <= total / 100 * 1.02 + 1
