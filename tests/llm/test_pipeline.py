import re
from collections import Counter

import corpus_pipeline
import pytest
from conftest_llm import no_documents, odd_documents
from test_dedup import brute_components, brute_fingerprint, brute_groups
from test_mixing import brute_targets, words

from clustercat.llm import queries
from clustercat.storage import keep


def stage_outputs(spark, docs, folder):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(keep(stage(spark, out[-1], folder), name.replace(" ", "-")))
    return out


def test_every_stage_against_brute_force(shipped, folder):
    docs = shipped.read.parquet(f"{folder}/documents.parquet")
    start, good, single, near, mixed, packed = stage_outputs(shipped, docs, folder)
    rows = [{r["doc_id"]: r for r in df.collect()} for df in (start, good, single, near)]
    # Quality: labels are met but for a few.
    labels = {r["doc_id"]: r for r in shipped.read.parquet(f"{folder}/labels.parquet").collect()}
    wrong = [i for i, r in labels.items() if (i in rows[1]) != (r["quality"] == 1 and r["toxic"] == 0)]
    assert len(wrong) <= 0.12 * len(labels)
    for earlier, later in zip(rows, rows[1:]):
        assert all(earlier[i] == r for i, r in later.items())
    groups = brute_groups([(i, r["text"]) for i, r in rows[1].items()])
    assert set(rows[2]) == {min(ids) for ids in groups.values()}
    prints = [(i, brute_fingerprint(r["text"])) for i, r in rows[2].items()]
    assert set(rows[3]) == set(brute_components(prints, 3))
    sizes = Counter()
    for r in rows[3].values():
        sizes[r["source"]] += words(r["text"])
    played = Counter()
    for r in mixed.collect():
        whole = re.findall(r"[^\x20\x09-\x0D]+", rows[3][r["doc_id"]]["text"])
        part = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        assert part == whole[: len(part)]
        played[r["source"]] += len(part)
    for source, target in brute_targets(sizes).items():
        assert abs(played[source] - target) < 1.001
    assert max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 2
    assert [df.columns for df in (good, single, near, mixed)] == [docs.columns] * 4
    pieces = packed.collect()
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed.collect())
    fill = Counter()
    for r in pieces:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= 1.02 * sum(fill.values()) / 2048 + 1


@pytest.mark.parametrize("docs", [odd_documents, no_documents])
def test_odd_rows_pass_every_stage(shipped, folder, docs):
    out = stage_outputs(shipped, docs(shipped), folder)
    assert all(df.columns == out[0].columns for df in out[:-1])
    assert out[-1].count() == 0 if docs is no_documents else out[-1].count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(shipped, folder, name):
    import oracle

    found = oracle.difference(shipped, oracle.connect(folder), folder, name, queries.QUERIES[name], queries.ORACLE[name])
    assert found is None


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5
