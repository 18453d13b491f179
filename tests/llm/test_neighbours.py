import numpy as np
import pytest
from conftest_llm import with_clashes
from pyspark.sql import functions as F

from clustercat.llm.hilbert import hilbert_keys
from clustercat.llm.neighbours import nearest_neighbours


@pytest.mark.parametrize("dims, bits", [(1, 5), (2, 4), (3, 3), (5, 2)])
def test_curve_visits_every_point_one_step_at_a_time(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hilbert_keys(grid, bits)
    assert sorted(keys) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def brute(ids, x, query, k):
    apart = np.sqrt(((x - x[ids == query][0]) ** 2).sum(axis=1))
    order = [j for j in np.lexsort((ids, apart)) if ids[j] != query][:k]
    return [(int(ids[j]), apart[j]) for j in order]


def compare(found, ids, x, queries, k):
    """Share of the true neighbours that were found; ranks and scores must be right in any case."""
    rows = {}
    for r in found.collect():
        rows.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(rows) == sorted(int(q) for q in queries)
    hits = total = 0
    for q in queries:
        got = sorted(rows[q])
        assert [g[0] for g in got] == list(range(1, len(got) + 1))
        assert [(s, v) for _, v, s in got] == sorted((s, v) for _, v, s in got)
        for _, v, s in got:
            assert v != q and s == pytest.approx(np.sqrt(((x[ids == v][0] - x[ids == q][0]) ** 2).sum()), abs=1e-12)
        want = brute(ids, x, q, k)
        hits += len({v for v, _ in want} & {v for _, v, _ in got})
        total += len(want)
    return hits / total


def test_all_embeddings(shipped, folder):
    vectors = shipped.read.parquet(f"{folder}/embeddings.parquet")
    rows = vectors.toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.array(rows["embedding"].tolist(), float)
    queries = ids[ids % 100 == 0]
    assert compare(nearest_neighbours(vectors, F.col("vec_id") % 100 == 0), ids, x, queries, 10) == 1


def test_recall_over_many_small_windows(shipped):
    """Clustered vectors, 40 windows on each curve."""
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(25, 16))
    x = np.round(centres[draw.integers(0, 25, 2000)] + 0.25 * draw.normal(size=(2000, 16)), 3)
    ids = np.arange(2000)
    vectors = shipped.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    found = nearest_neighbours(vectors, F.col("vec_id") % 50 == 0, size=16, curves=12, window=50)
    assert compare(found, ids, x, ids[ids % 50 == 0], 10) >= 0.9


@pytest.mark.parametrize("rows", [1500, 6000])
def test_recall_where_the_windows_are_a_small_part_of_the_table(shipped, rows):
    """Vectors without structure; own window and two beside find less than nine in ten."""
    x = np.random.default_rng(2).normal(size=(rows, 16))
    ids = np.arange(rows)
    vectors = shipped.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    found = nearest_neighbours(vectors, F.col("vec_id") % 50 == 0, size=16, curves=5, window=20)
    assert compare(found, ids, x, ids[ids % 50 == 0], 10) >= 0.9


def test_ties_beyond_the_answer_go_to_the_smaller_id(shipped):
    """One-hot vectors: more different ones at one distance than an answer has places."""
    ids = np.random.default_rng(4).permutation(40)
    rows = [(int(i), [float(j == at) for j in range(40)]) for at, i in enumerate(ids)]
    found = nearest_neighbours(shipped.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") >= 35, size=40)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert sorted(got) == list(range(35, 40)) and all([v for _, v in sorted(g)] == list(range(10)) for g in got.values())


def test_rows_that_share_an_id_each_take_part(shipped):
    rows = [(1, [0.0, 1.0]), (2, [-9.0, 1.0]), (2, [0.0, 2.0]), (2, [0.0, 2.0]), (3, [0.0, 4.0]), (3, [5.0, 1.0])]
    vectors = shipped.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest_neighbours(vectors, F.col("vec_id") != 2, size=2, k=3).collect()
    one = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == 1)
    assert one == [(1, 2, 1.0), (2, 2, 1.0), (3, 3, 3.0)]
    three = sorted((r["rank"], r["vec_id"], round(r["score"], 6)) for r in found if r["query_id"] == 3)
    assert three == [(1, 1, 5.0), (1, 2, 2.0), (2, 2, 2.0), (2, 2, 5.09902), (3, 1, 3.0), (3, 2, 5.09902)]


def test_a_twin_of_the_query_is_its_neighbour(shipped):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [9.0, 9.0])]
    vectors = shipped.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest_neighbours(vectors, F.col("vec_id") == 0, k=2).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in found) == [(1, 0, 0.0), (1, 0, 0.0), (2, 1, 1.0), (2, 1, 1.0)]


def test_the_length_comes_from_the_data(shipped):
    x = np.random.default_rng(8).normal(size=(300, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, [1.0] * 5) for i in range(20)]
    found = nearest_neighbours(shipped.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0)
    assert compare(found, np.arange(300), x, np.array([0, 100, 200]), 10) == 1.0


def test_odd_rows(shipped):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(30)]  # more copies than an answer has places
    rows += [(100, [1.0, 2.5]), (100, [1.0, 2.5]), (101, [0.0, -0.0]), (102, [nan, 1.0]), (103, [inf, 1.0]), (104, None),
             (105, [1.0, None]), (106, [1.0]), (107, []), (None, [1.0, 2.0]), (200, [-0.0, 3.0]), (300, [0.0, 3.0])]
    vectors = with_clashes(shipped.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = nearest_neighbours(vectors, (F.col("vec_id") % 100 == 0) | (F.col("vec_id") == 25), size=2)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [0, 25, 100, 200, 300]
    assert [v for _, v, _ in sorted(got[0])] == list(range(1, 11))
    assert [v for _, v, _ in sorted(got[25])] == list(range(10))
    # Two rows are 100, and each is the other's nearest.
    assert [v for _, v, _ in sorted(got[100])] == [v for v in [100, *range(9)] for _ in "ab"]
    assert sorted(got[200])[0] == (1, 300, 0.0) and sorted(got[300])[0] == (1, 200, 0.0)
    assert nearest_neighbours(vectors.filter("vec_id = 104"), F.lit(True), size=2).count() == 0
    few = nearest_neighbours(vectors.filter("vec_id in (100, 200, 300)"), F.col("vec_id") == 100, size=2).collect()
    assert sorted(r["vec_id"] for r in few) == [100, 100, 200, 200, 300, 300]
