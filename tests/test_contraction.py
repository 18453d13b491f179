import math
import random

import pytest

from clustercat.operators.density.contraction import best_below, contract_block

SCHEMA = "node bigint, parent bigint, own double"


def plain(rows):
    """Sum over children of their bests, walking up from the deepest."""
    parent, own = {n: p for n, p, _ in rows}, {n: w for n, _, w in rows}
    depth = {}
    for n in parent:
        path = []
        while n is not None and n not in depth:
            path.append(n)
            n = parent[n]
        base = -1 if n is None else depth[n]
        for k, m in enumerate(reversed(path), 1):
            depth[m] = base + k
    below = dict.fromkeys(parent, 0.0)
    for n in sorted(parent, key=lambda n: -depth[n]):
        if parent[n] is not None:
            below[parent[n]] += max(own[n], below[n])
    return below


def tree(shape, n, draw):
    up = {
        "path": lambda i: i - 1,
        "star": lambda i: 0,
        "binary": lambda i: (i - 1) // 2,
        "caterpillar": lambda i: i - 1 if i % 2 else max(i - 2, 0),
        "random": lambda i: draw.randrange(i),
    }[shape]
    names = draw.sample(range(10 * n), n)
    return [(names[i], None if i == 0 else names[up(i)], draw.choice([0.0, draw.random(), 5 * draw.random()])) for i in range(n)]


@pytest.mark.parametrize("shape", ["path", "star", "binary", "caterpillar", "random"])
def test_any_tree_against_a_walk(spark, shape):
    rows = tree(shape, 60, random.Random(shape))
    found, rounds = best_below(spark.createDataFrame(rows, SCHEMA), block_rows=20)
    told = plain(rows)
    got = {r["node"]: (r["own"], r["below"]) for r in found.collect()}
    assert got.keys() == told.keys()
    for n, _, own in rows:
        assert got[n][0] == own and got[n][1] == pytest.approx(told[n], abs=1e-9)
    assert rounds <= 4 * math.log2(60)


def test_rounds_on_a_path_grow_with_its_logarithm(spark):
    """Blocks of shuffled names help little, so the rounds are those of the splices."""
    rows = tree("path", 3000, random.Random(1))
    found, rounds = best_below(spark.createDataFrame(rows, SCHEMA).repartition(4), block_rows=100)
    told = plain(rows)
    assert all(r["below"] == pytest.approx(told[r["node"]], abs=1e-9) for r in found.collect())
    assert rounds <= 2 * math.log2(3000)
    assert best_below(spark.createDataFrame(rows, SCHEMA))[1] == 1


def test_a_block_with_outside_parents_and_children():
    """3 is spliced, 4 waits for its parent outside, 2 has a child outside."""
    inf = float("-inf")
    rows = [(3, 9, 1.0, 2.0, 1, inf, 0.0), (4, 3, 5.0, 0.0, 1, inf, 0.0), (2, 4, 0.0, 0.0, 1, inf, 0.0), (7, 8, 1.0, 0.0, 0, inf, 0.0)]
    out = {r[0]: r for r in contract_block(rows)}
    assert out[7][10] is None and out[7][7] is None  # a leaf of a parent elsewhere
    assert out[3][7] == 4 and out[4][7] == 2 and out[2][1] == 9
    # 2's best y reaches 9 as max(1, 2 + max(5, y)).
    assert max(out[2][5], 10.0 + out[2][6]) == 12.0 and max(out[2][5], 1.0 + out[2][6]) == 7.0


def test_forests_and_empty_trees(spark):
    rows = [(1, None, 1.0), (2, None, 0.0), (3, 2, 4.0), (4, 2, 2.0), (5, 4, 3.0)]
    found, _ = best_below(spark.createDataFrame(rows, SCHEMA))
    assert {r["node"]: r["below"] for r in found.collect()} == {1: 0.0, 2: 7.0, 3: 0.0, 4: 3.0, 5: 0.0}
    found, rounds = best_below(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and rounds == 0
