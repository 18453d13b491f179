import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from conftest_llm import no_documents, odd_documents
from pyspark.sql import functions as F

from clustercat.llm import exact_dedup, simhash


def brute_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    values = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in values) > len(values))


def brute_components(prints, distance):
    """Smallest id reachable, for ``prints`` as a list of (id, fingerprint)."""
    parent = list(range(len(prints)))

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    values = np.array([p for _, p in prints], np.uint64)
    for k in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[k]) <= distance):
            parent[find(int(j))] = find(k)
    least = {}
    for k, (i, _) in enumerate(prints):
        least[find(k)] = min((x for x in (least.get(find(k)), i) if x is not None), default=None)
    return [least[find(k)] for k in range(len(prints))]


def test_fingerprints_and_components_of_all_documents(shipped, folder):
    docs = shipped.read.parquet(f"{folder}/documents.parquet")
    found = {r["id"]: r for r in simhash.simhash_groups(docs).collect()}
    prints = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
    want = brute_components(prints, 3)
    assert len(found) == len(prints)
    for (i, value), least in zip(prints, want):
        assert found[i]["fp"] & (2**64 - 1) == value
        assert found[i]["component_id"] == least
        assert found[i]["survivor"] == (i == least)


@pytest.mark.parametrize("text", ["", None, "One", "a B", "A b c D", "x " * 5, "é Ä ß"])
def test_short_fingerprints(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_fingerprint_in_small_blocks():
    text = " ".join(str(k % 97) for k in range(500)).encode()
    whole = [s for part in simhash._shingles(text, 3) for s in part]
    pieces = [s for part in simhash._shingles(text, 3, block=7) for s in part]
    assert whole == pieces and len(whole) == 498


@pytest.mark.parametrize("distance, block", [(1, 4096), (3, 4096), (3, 8), (4, 16)])
def test_components_of_a_dense_ball(shipped, distance, block):
    """A large group around one centre, chains that leave it, and strangers; also with buckets dealt to blocks."""
    draw = np.random.default_rng(distance)
    centre = int(draw.integers(0, 2**63))
    values = {centre}
    for _ in range(150):
        flips = draw.choice(64, size=draw.integers(1, 5), replace=False)
        values.add(centre ^ sum(1 << int(b) for b in flips))
    chain = int(draw.integers(0, 2**63))
    for _ in range(12):
        chain ^= sum(1 << int(b) for b in draw.choice(64, size=distance, replace=False))
        values.add(chain)
    values |= {int(v) for v in draw.integers(0, 2**63, 50)}
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    prints = shipped.createDataFrame([(v,) for v in signed], "fp long")
    found = {r["fp"]: r["comp"] for r in simhash.components(prints, distance, block).collect()}
    want = brute_components(list(zip(signed, values)), distance)
    assert [found.get(v, v) for v in signed] == want


def test_every_close_pair_meets_in_a_bucket(shipped):
    draw = np.random.default_rng(0)
    rows = []
    for _ in range(300):
        a = int(draw.integers(0, 2**63))
        b = a ^ sum(1 << int(k) for k in draw.choice(64, size=draw.integers(1, 4), replace=False))
        rows.append((a, int(np.uint64(b).view(np.int64))))
    prints = shipped.createDataFrame([(v,) for pair in rows for v in pair], "fp long").distinct()
    buckets = defaultdict(set)
    for r in simhash.candidate_buckets(prints, 3).collect():
        buckets[(r["start"], r["key"])].add((r["fp"], r["home"]))
    together = set()
    for members in buckets.values():
        homes = [fp for fp, home in members if home]
        together |= {(x, y) for x in homes for y, _ in members}
    assert all((a, b) in together or (b, a) in together for a, b in rows)


def test_simhash_of_odd_rows(shipped):
    rows = simhash.simhash_groups(odd_documents(shipped)).collect()
    assert len(rows) == 12
    by_id = defaultdict(list)
    for r in rows:
        by_id[r["id"]].append(r)
    assert {r["component_id"] for i in (1, 2) for r in by_id[i]} == {1}
    assert sum(r["survivor"] for i in (1, 2, None) for r in by_id[i] if r["component_id"] == 1) == 1
    assert by_id[3][0]["fp"] == 0 and by_id[3][0]["component_id"] == by_id[4][0]["component_id"] == 3
    assert by_id[6][0]["component_id"] == by_id[7][0]["component_id"] == 6
    assert simhash.simhash_groups(no_documents(shipped)).count() == 0


def brute_groups(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    return groups


def test_exact_groups_of_all_documents(shipped, folder):
    docs = shipped.read.parquet(f"{folder}/documents.parquet")
    groups = brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    found = {r["id"]: r for r in exact_dedup.exact_groups(docs).collect()}
    for text, ids in groups.items():
        for i in ids:
            r = found[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (min(ids), len(ids), i == min(ids))
            assert r["digest"] == hashlib.sha256(text.encode()).hexdigest()


def test_full_texts_decide_where_digests_collide(shipped):
    """A digest of two bits makes most hits false; many small parts."""
    rows = [(k, f"text {k % 7}") for k in range(60)]
    docs = shipped.createDataFrame(rows, "doc_id long, text string")
    weak = lambda text: F.substring(F.sha2(text, 256), 1, 1).between("0", "7").cast("string")
    found = {r["id"]: r for r in exact_dedup.exact_groups(docs, digest=weak, salt_rows=4).collect()}
    for ids in brute_groups(rows).values():
        assert {(found[i]["keep_id"], found[i]["group_size"]) for i in ids} == {(min(ids), len(ids))}
        assert [i for i in ids if found[i]["kept"]] == [min(ids)]


def test_exact_groups_of_odd_rows(shipped):
    rows = exact_dedup.exact_groups(odd_documents(shipped)).collect()
    assert len(rows) == 12
    cats = [r for r in rows if r["keep_id"] == 1]
    assert len(cats) == 3 and {r["group_size"] for r in cats} == {3} and sum(r["kept"] for r in cats) == 1
    empty = [r for r in rows if r["digest"] == hashlib.sha256(b"").hexdigest()]
    assert len(empty) == 3 and {r["keep_id"] for r in empty} == {3}
    assert exact_dedup.exact_groups(no_documents(shipped)).count() == 0


def test_state_goes_on_from_its_checkpoint(shipped, tmp_path):
    """A second run with the same checkpoint finds copies of what the first one has read, in several batches."""
    schema = "digest string, id long, _cc_file long, _cc_row long"
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")

    def feed(rows):
        shipped.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(source)
        stream = shipped.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        exact_dedup.run_stream(stream, checkpoint)
        state = exact_dedup.read_state(shipped, checkpoint).collect()
        return {r["digest"]: (r["first"]["id"], r["copies"]) for r in state}

    assert feed([("a", 5, 0, 0), ("b", 6, 0, 1)]) == {"a": (5, 1), "b": (6, 1)}
    assert feed([("a", 3, 1, 0), ("c", 7, 1, 1), ("a", 9, 1, 2)]) == {"a": (3, 3), "b": (6, 1), "c": (7, 1)}


@pytest.mark.parametrize("words", [1, 64, 1 << 19])
def test_filter_loses_no_hit(shipped, words):
    docs = shipped.range(2000).selectExpr("concat('d', id) as digest")
    hits = docs.filter("digest like '%7'")
    passed = {r["digest"] for r in exact_dedup._maybe_hits(docs, hits, words).collect()}
    assert passed >= {r["digest"] for r in hits.collect()} and (words < 1000 or len(passed) < 210)
