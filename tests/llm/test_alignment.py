import hashlib
import random
from collections import Counter

import pytest
from conftest_llm import no_documents, odd_documents

from clustercat.llm import alignment
from clustercat.llm.queries import QUERIES, byte_vocabulary, piece_vocabulary, table


@pytest.fixture(scope="module")
def pair():
    return alignment.TokenPair(byte_vocabulary(), piece_vocabulary())


@pytest.fixture(scope="module")
def first():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(byte_vocabulary())
    tokenizer.encode_special_tokens = True
    return tokenizer


def plain(pair, first, text):
    """Ids, groups and links of a text coded as a whole, from all pairs of tokens."""
    full = (" " + (text or "")).encode()
    a, b = first.encode(" " + (text or ""), add_special_tokens=False).ids, pair.b.encode(text or "")
    spelt = b"".join(pair.bytes_a[i] for i in a) == full == b"".join(pair.bytes_b[i] for i in b)
    if not text or not spelt:
        return [], [], [], Counter()
    spans = []
    for ids, spelling in ((a, pair.bytes_a), (b, pair.bytes_b)):
        at, found = 0, []
        for i in ids:
            found.append((at, at + len(spelling[i]), i))
            at += len(spelling[i])
        spans.append(found)
    groups, low = [], 0
    for end in sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]}):
        groups.append([[i for _, stop, i in side if low < stop <= end] for side in spans])
        low = end
    links = Counter((i, k) for s, e, i in spans[0] for t, f, k in spans[1] if s < f and t < e)
    return a, b, groups, links


def written(groups):
    return ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)


def test_random_texts_against_all_pairs(pair, first):
    draw = random.Random(1)
    signs = [" ", "  ", "\n", "\t", "\r\n", "a", "the", "é", "日本", "!", ";", "\x1c", "　", "\xa0", "▁", "23", "'s",
             "<s>", "<unk>", "<|endoftext|>", "\x00", " ", "ﬁ", "​", "🙂"]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 14))) for _ in range(3000)] + [None, "", " ", "  "]
    for text, row in zip(texts, alignment.text_rows(pair, texts, alignment.DigestRow)):
        a, b, groups, links = plain(pair, first, text)
        digest = hashlib.sha256(written(groups).encode()).hexdigest() if groups else ""
        assert row[:5] == (len(a), len(b), len(groups), sum(links.values()), digest), repr(text)
        assert {(int(p) >> 32, int(p) & 0xFFFFFFFF): n for p, n in zip(row[5], row[6])} == links


@pytest.mark.parametrize("ends_a, ends_b, found", [
    ([1], [1], []),
    ([1, 2, 3, 4, 5, 6, 7, 8, 9], [1, 2, 3, 4, 5, 6, 7, 8, 9], []),
    ([2], [1, 2], [(0, 0, 1, 2)]),
    ([1, 2, 4, 5, 6, 9], [1, 3, 4, 5, 7, 8, 9], [(1, 1, 3, 3), (4, 4, 6, 7)]),
])
def test_runs_on_the_diagonal_are_skipped(ends_a, ends_b, found):
    assert alignment.irregular_groups(ends_a, ends_b) == found


def test_a_long_text_in_parts_is_as_one(pair, first, monkeypatch):
    monkeypatch.setattr(alignment, "TOGETHER_CHARS", 500)
    text = " ".join(random.Random(2).choice(["alpha", "Zqx\n", "the", "ünwort,", "12.5"]) for _ in range(2000))
    monkeypatch.setattr(alignment, "segments", lambda t, cut=alignment.segments: cut(t, 90))
    row, groups = (alignment.text_rows(pair, [text], kind)[0] for kind in (alignment.DigestRow, alignment.GroupRow))
    a, b, whole, links = plain(pair, first, text[:20_000])
    assert row[:5] == (len(a), len(b), len(whole), sum(links.values()), hashlib.sha256(written(whole).encode()).hexdigest())
    at, rebuilt = (0, 0), []
    for stops in zip(groups[2].tolist(), groups[3].tolist()):
        rebuilt.append([groups[0][at[0] : stops[0]].tolist(), groups[1][at[1] : stops[1]].tolist()])
        at = stops
    assert rebuilt == whole


def expected(pair, first, rows):
    done = [(i, *plain(pair, first, text)) for i, text in rows]
    counts = sum((d[4] for d in done), Counter())
    best: Counter = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for i, a, b, groups, links in done:
        n_best = sum(n for p, n in links.items() if counts[p] == best[p[1]])
        digest = hashlib.sha256(written(groups).encode()).hexdigest() if groups else ""
        out.append((i, len(a), len(b), len(groups), sum(links.values()), n_best, sum(n * counts[p] for p, n in links.items()), digest))
    return sorted(out, key=repr)


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_against_all_pairs(shipped, folder, pair, first):
    rows = [(r["doc_id"], r["text"]) for r in table(shipped, folder, "documents").collect()]
    rows = [(i, t) for i, t in rows if len(t or "") < 20_000]
    assert len(rows) >= 190
    docs = shipped.createDataFrame(rows, "doc_id long, text string")
    found = alignment.link_counts(docs, byte_vocabulary(), piece_vocabulary()).select("id", *COLUMNS).collect()
    assert sorted(map(tuple, found), key=repr) == expected(pair, first, rows)
    assert QUERIES["op12_tokenizer_alignment"](shipped, folder).count() == table(shipped, folder, "documents").count()


@pytest.mark.parametrize("head_pairs", [0, 5, 1_000_000])
def test_odd_rows_with_heads_of_any_size(shipped, pair, first, head_pairs):
    docs = odd_documents(shipped).filter("doc_id is null or doc_id not in (6, 7)")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = alignment.link_counts(docs, byte_vocabulary(), piece_vocabulary(), head_pairs=head_pairs)
    assert sorted(map(tuple, found.select("id", *COLUMNS).collect()), key=repr) == expected(pair, first, rows)
    groups = alignment.align(docs, byte_vocabulary(), piece_vocabulary()).collect()
    assert sorted(len(r["a_stops"]) for r in groups) == sorted(r["n_groups"] for r in found.collect())


def test_long_and_empty(shipped):
    long = alignment.link_counts(odd_documents(shipped), byte_vocabulary(), piece_vocabulary()).collect()
    assert len(long) == 12 and max(r["n_a"] for r in long) > 60_000
    assert alignment.link_counts(no_documents(shipped), byte_vocabulary(), piece_vocabulary()).count() == 0


def test_other_vocabularies_are_refused(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError):
        alignment.TokenPair(public_tokenizers.path("word_bpe_49k.json"), piece_vocabulary())
