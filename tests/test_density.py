"""Density clustering against a full distance matrix, also with many cells and segments."""

import bruteforce
import numpy as np
import pytest
from pyspark.sql import functions as F

from clustercat.operators.density import components, hierarchy, neighbours, selection, spanning
from clustercat.operators.density.cells import build_cells


def frame(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, features array<double>")


def sample(kind):
    rng = np.random.default_rng(0)
    if kind == "blobs":
        return np.r_[rng.normal(0, 0.3, (40, 4)), rng.normal(3, 0.3, (40, 4))]
    x = np.r_[rng.normal(0, 0.3, (60, 2)), rng.normal(3, 0.6, (80, 2)), rng.normal((0, 4), 0.2, (30, 2)), rng.uniform(-4, 7, (50, 2))]
    if kind == "grid":
        return np.round(x * 3) / 3
    if kind == "copies":
        x[:70] = x[0]
        x[100:106] = x[100]
    return x


@pytest.mark.parametrize(
    "kind, m, k, options",
    [
        ("blobs", 10, None, {}),
        ("noisy", 8, 3, {"cell_rows": 40, "segment_edges": 60}),
        ("grid", 6, 4, {"segment_edges": 40}),
        ("copies", 10, None, {"segment_edges": 60}),
    ],
)
def test_labels_and_probabilities(spark, kind, m, k, options):
    x = sample(kind)
    got = selection.density_cluster(frame(spark, x), m, k, **options).toPandas().sort_values("row_id")
    label, prob = bruteforce.cluster(x, m, k)
    assert got["row_id"].tolist() == list(range(len(x)))
    assert got["cluster"].tolist() == label.tolist()
    np.testing.assert_allclose(got["prob"], prob)


@pytest.fixture(scope="module")
def tables(spark):
    return selection.hierarchy(frame(spark, sample("noisy")), 5, 3)


@pytest.mark.parametrize("method, epsilon, single", [("eom", 0.0, True), ("leaf", 0.0, False), ("eom", 0.5, False), ("leaf", 0.9, True)])
def test_selection(tables, method, epsilon, single):
    chosen = selection.select_clusters(tables["clusters"], method, epsilon, single)
    got = selection.label_points(tables, chosen).toPandas().sort_values("point_id")
    label, prob = bruteforce.cluster(sample("noisy"), 5, 3, method, epsilon, single)
    assert got["cluster"].tolist() == label.tolist()
    np.testing.assert_allclose(got["prob"], prob)


def test_too_few_rows_are_noise(spark):
    got = selection.density_cluster(frame(spark, sample("blobs")[:5]), 10).collect()
    assert {(r.cluster, r.prob) for r in got} == {(-1, 0.0)} and len(got) == 5


def test_unknown_choices(spark):
    with pytest.raises(ValueError):
        selection.density_cluster(frame(spark, sample("blobs")), method="other")
    with pytest.raises(ValueError):
        selection.density_cluster(frame(spark, sample("blobs")), metric="hamming")


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev"])
def test_neighbours_across_cells(spark, metric):
    x = np.random.default_rng(2).normal(size=(300, 3))
    gaps = np.abs(x[:, None] - x[None])
    dist = {"euclidean": np.sqrt((gaps**2).sum(-1)), "manhattan": gaps.sum(-1), "chebyshev": gaps.max(-1)}[metric]
    np.fill_diagonal(dist, np.inf)
    got = neighbours.knn(frame(spark, x), 4, metric, cell_rows=16).toPandas().sort_values(["row_id", "rank"])
    assert got["neighbor_id"].tolist() == np.argsort(dist, axis=1)[:, :4].ravel().tolist()


def test_core_distance_counts_copies(spark):
    x = np.array([[0.0], [0.0], [0.0], [1.0], [3.0]])
    got = {r.row_id: r.core for r in neighbours.core_distance(frame(spark, x), 2).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 0.0, 3: 1.0, 4: 3.0}
    assert {r.core for r in neighbours.core_distance(frame(spark, x[3:]), 9).collect()} == {2.0}


@pytest.mark.parametrize("kind, cell_rows", [("noisy", 12), ("grid", 12)])
def test_spanning_tree_over_many_cells(spark, kind, cell_rows):
    x = np.unique(sample(kind), axis=0)
    reach, _ = bruteforce.reach_matrix(x, 2)
    placed, cells = build_cells(neighbours.distinct_points(frame(spark, x)), cell_rows)
    assert cells.depth >= 3
    points = neighbours.with_core(placed, neighbours.neighbour_lists(placed, cells, 2), 2)
    edges = spanning.min_span_tree(points, cells).toPandas()
    inside, best, weights = np.zeros(len(x), bool), np.full(len(x), np.inf), []
    at = 0
    for _ in range(len(x) - 1):
        inside[at] = True
        best = np.minimum(best, reach[at])
        best[inside] = np.inf
        at = int(best.argmin())
        weights.append(best[at])
    np.testing.assert_allclose(np.sort(edges["w"]), np.sort(weights))
    linked = np.zeros(reach.shape, bool)
    linked[edges["a"], edges["b"]] = linked[edges["b"], edges["a"]] = True
    assert len(bruteforce.components(np.arange(len(x)), linked)) == 1


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40) if i != 20] + [(50, 50), (60, 61), (100, 60), (7, 3)]
    got = components.connected_components(spark.createDataFrame(pairs, "u long, v long"))
    want = {i: 0 for i in range(21)} | {i: 21 for i in range(21, 41)} | {50: 50, 60: 60, 61: 60, 100: 60}
    assert {r.node: r["comp"] for r in got.collect()} == want
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 3, 2.0)], "a long, b long, w double")
    assert {r.row_id: r.component for r in components.components_at(edges, 1.0).collect()} == {1: 1, 2: 1, 3: 3}


def test_most_stable_choice(spark):
    rows = [(0, None, 5.0), (1, 0, 1.0), (2, 0, 3.0), (3, 1, 1.0), (4, 1, 4.0), (5, 4, 2.0), (6, 4, 1.0)]
    tree = spark.createDataFrame(rows, "cluster long, parent long, stability double")
    assert {r.cluster for r in selection._excess_of_mass(tree).collect()} == {2, 3, 4, 5, 6}


def test_components_of_many_cuts(spark):
    rng = np.random.default_rng(6)
    pairs = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 80), rng.integers(0, 60, 80), rng.integers(1, 9, 80))]
    edges = spark.createDataFrame(pairs, "a long, b long, w double")
    cuts = [8.0, 0.5, 3.0, 5.0]
    every = {(r.cut, r.row_id): r.component for r in components.components_at(edges, cuts).collect()}
    rows = {i for a, b, _ in pairs for i in (a, b)}
    assert set(every) == {(c, i) for c in cuts for i in rows}
    for cut in cuts:
        home = {i: i for i in rows}
        for _ in rows:
            for a, b, w in pairs:
                if w <= cut:
                    home[a] = home[b] = min(home[a], home[b])
        assert {i: every[(cut, i)] for i in rows} == home
        assert {r.row_id: r.component for r in components.components_at(edges, cut).collect()} == home


def test_hierarchy_tables(tables):
    n = len(sample("noisy"))
    tree = tables["tree"].toPandas()
    points, clusters = tree[~tree["is_cluster"]], tables["clusters"].toPandas()
    assert sorted(points["child"]) == list(range(n))
    assert (clusters["stability"] >= 0).all() and clusters["parent"].isna().sum() == 1
    inner = tree[tree["is_cluster"]].groupby("parent").size()
    assert (inner >= 2).all() and (tree[tree["is_cluster"]]["child_size"] >= 5).all()
    assert clusters[clusters["parent"].isna()]["size"].item() == n


def test_copies_are_neighbours(spark):
    """Rows at 0, 0, 0 and 1: a copy's nearest rows are the other copies, by id."""
    df = spark.createDataFrame([(5, [0.0]), (2, [0.0]), (7, [0.0]), (1, [1.0])], "row_id long, features array<double>")
    found = {}
    for r in neighbours.knn(df, 2).orderBy("row_id", "rank").collect():
        found.setdefault(r.row_id, []).append((r["rank"], r.neighbor_id, r.dist))
    assert found == {
        2: [(1, 5, 0.0), (2, 7, 0.0)], 5: [(1, 2, 0.0), (2, 7, 0.0)], 7: [(1, 2, 0.0), (2, 5, 0.0)], 1: [(1, 2, 1.0), (2, 5, 1.0)]
    }
    weights = {(r.row_id, r.neighbor_id): r.weight for r in neighbours.mutual_reachability(df, 2).collect()}
    assert weights[(2, 5)] == 0.0 and weights[(1, 2)] == 1.0 and len(weights) == 8


def _sphere(metric, x):
    if metric == "cosine":
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        return 1 - unit @ unit.T
    lat, lon = x[:, 0], x[:, 1]
    half = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat)[:, None] * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    return 2 * np.arcsin(np.sqrt(np.minimum(half, 1)))


@pytest.mark.parametrize("metric", ["haversine", "cosine"])
def test_neighbours_on_the_sphere(spark, metric):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3)) if metric == "cosine" else np.c_[rng.uniform(-1.5, 1.5, 200), rng.uniform(-3.1, 3.1, 200)]
    dist = _sphere(metric, x)
    np.fill_diagonal(dist, np.inf)
    df = frame(spark, x)
    if metric == "cosine":
        df = df.unionByName(spark.createDataFrame([(999, [0.0, 0.0, 0.0])], df.schema))  # no direction: left out
    got = neighbours.knn(df, 4, metric, cell_rows=16).toPandas().sort_values(["row_id", "rank"])
    assert got["neighbor_id"].tolist() == np.argsort(dist, axis=1)[:, :4].ravel().tolist()
    np.testing.assert_allclose(got["dist"], np.sort(dist, axis=1)[:, :4].ravel(), atol=1e-12)
    core = {r.row_id: r.core for r in neighbours.core_distance(df, 4, metric, cell_rows=16).collect()}
    np.testing.assert_allclose([core[i] for i in range(200)], np.sort(dist, axis=1)[:, 3], atol=1e-12)


def test_clusters_on_the_sphere(spark):
    """Two fields across the meridian of 0 degrees and near a pole, where plain coordinates fail."""
    rng = np.random.default_rng(4)
    lon = np.r_[rng.normal(0, 0.02, 40) % (2 * np.pi), rng.uniform(0, 2 * np.pi, 40)]
    lat = np.r_[rng.normal(0, 0.02, 40), np.pi / 2 - np.abs(rng.normal(0, 0.02, 40))]
    got = selection.density_cluster(frame(spark, np.c_[lat, lon]), 10, metric="haversine").toPandas().sort_values("row_id")
    label = got["cluster"].to_numpy()
    assert set(label) - {-1} == {0, 1} and len(set(label[:40]) - {-1}) == len(set(label[40:]) - {-1}) == 1
    assert (label >= 0).mean() > 0.7


@pytest.mark.parametrize("fan_bits", [2, 8])
def test_nested_cells(spark, monkeypatch, fan_bits):
    """Many small nodes on several levels find the same neighbours as one level."""
    from clustercat.operators.density import cells as module

    monkeypatch.setattr(module, "FAN_BITS", fan_bits)
    x = np.random.default_rng(7).normal(size=(400, 2))
    placed, cells = build_cells(neighbours.distinct_points(frame(spark, x)), 12)
    assert cells.depth == 6 and len(cells.bits) == (3 if fan_bits == 2 else 1)
    assert placed.select("cell").distinct().count() > 40
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(dist, np.inf)
    lists = neighbours.neighbour_lists(placed, cells, 3).toPandas().sort_values("point_id")
    got = [[n["id"] for n in row] for row in lists["neighbours"]]
    assert got == np.argsort(dist, axis=1)[:, :3].tolist()


def test_boxes_of_all_pairs_are_not_visited(spark):
    """Queries enter few cells: the search goes down the tree, not over all boxes."""
    from clustercat.operators.density.cells import descend

    x = np.random.default_rng(8).uniform(size=(2000, 2))
    placed, cells = build_cells(neighbours.distinct_points(frame(spark, x)), 16)
    asked = placed.select("point_id", "features", F.lit(0.02).alias("radius"), F.col("cell").alias("own"))
    visits = descend(asked, cells).groupBy("point_id").count().agg(F.avg("count")).first()[0]
    assert cells.depth >= 7 and visits < 4


def test_blocks_leave_few_edges_to_segments(spark, monkeypatch):
    rng = np.random.default_rng(5)
    edges = [(i, i + 1, float(w)) for i, w in enumerate(np.round(rng.uniform(0.1, 2.0, 239), 1))]
    span = spark.createDataFrame(edges, "a long, b long, w double")
    points = spark.createDataFrame([(i, 1 + 4 * (i % 50 == 7), 0.1, i // 30) for i in range(240)], "point_id long, weight long, core double, cell long")
    left, segments = [], hierarchy._segments

    def counted(edges, m, segment_edges):
        left.append(edges.count())
        return segments(edges, m, segment_edges)

    monkeypatch.setattr(hierarchy, "_segments", counted)

    def found(points, segment_edges):
        tree, clusters = hierarchy.condensed_tree(span, points, 4, segment_edges)
        fallen = {(r.child, round(r.lambda_val, 9)) for r in tree.filter("not is_cluster").collect()}
        return fallen, sorted((r["size"], round(r.birth, 9)) for r in clusters.collect())

    plain, blocks = found(points, 10_000), found(points, 60)
    assert blocks == plain
    assert left[1] < left[0] / 2


def test_neighbours_bring_both_core_distances(spark):
    """Pairs come with the core distances of both rows, so that no pair is joined to the rows again."""
    x = np.random.default_rng(9).normal(size=(120, 2))
    df = frame(spark, np.r_[x, x[:5]])
    placed, cells, lists = neighbours.prepare(df, 3, "euclidean", 16, "row_id")
    assert set(placed.columns) < set(lists.columns)
    core = neighbours.with_core(placed, lists, 3)
    known = {r.row_id: r.core for r in neighbours.core_distance(df, 3, cell_rows=16).collect()}
    pairs = neighbours.row_neighbours(df, placed, lists, 3, core=core).collect()
    assert len(pairs) == 3 * 125
    assert all((r.core_a, r.core_b) == (known[r.row_id], known[r.neighbor_id]) for r in pairs)


def test_cell_leaves_only_edges_of_its_own_tree():
    """What a cell leaves to the rounds is the rest of its tree: one edge less than it has fragments."""
    import pandas as pd

    x = np.random.default_rng(10).normal(size=(80, 3))
    reach, core = bruteforce.reach_matrix(x, 3)
    pdf = pd.DataFrame({"point_id": range(80), "cell": 4, "features": list(x), "core": core, "clear": np.abs(x[:, 0])})
    row = spanning._merge_in_cell(pdf, "euclidean").iloc[0]
    made, left = row["made"], row["left"]
    assert len(left) == len(row["fragment"]) - 1 > 0 and len(made) + len(left) == 79
    a, b, w = spanning._cell_tree(x, core, "euclidean")
    np.testing.assert_allclose(w, reach[a, b])
    linked = np.zeros(reach.shape, bool)
    linked[a, b] = linked[b, a] = True
    assert len(bruteforce.components(np.arange(80), linked)) == 1
    for e in left:  # longer than the way out of both fragments it joins
        for end in (e["u"], e["v"]):
            inside = row["fragment"][row["place"]] == end
            assert e["w"] > np.maximum(core, np.abs(x[:, 0]))[inside].min()


def test_components_join_blocks_of_edges_first(spark, monkeypatch):
    """Only nodes that several blocks of edges have in common take part in the search for components."""
    searched, search = [], components.connected_components

    def counted(edges):
        searched.append(edges.count())
        return search(edges)

    monkeypatch.setattr(components, "connected_components", counted)
    rows = [(i, i + 1, 1.0 if i % 100 else 3.0) for i in range(1, 2000)] + [(5000, None, 0.5)]
    edges = spark.createDataFrame(rows, "a long, b long, w double").coalesce(2)
    every = components.components_at(edges, [2.0, 4.0]).collect()
    low = {r.row_id: r.component for r in every if r.cut == 2.0}
    assert low == {i: max(1, (i - 1) // 100 * 100 + 1) for i in range(1, 2001)} | {5000: 5000, None: None}
    assert {r.component for r in every if r.cut == 4.0} == {1, 5000, None} and len(every) == 2 * 2002
    assert len(searched) == 1 and searched[0] < 20


def test_points_of_a_cell_ask_together(spark, monkeypatch):
    """Other cells are asked by rows of a cell's points, never by a row a point; cores alone need no lists."""
    x = np.random.default_rng(5).uniform(size=(600, 2))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "row_id long, features array<double>")
    asked, visit = [], neighbours.visit
    monkeypatch.setattr(neighbours, "visit", lambda queries, *args, **named: asked.append(queries.count()) or visit(queries, *args, **named))
    placed, cells, known = neighbours.prepare(df, 4, "euclidean", 64, "row_id", core_only=True)
    assert "neighbours" not in known.columns and known.count() == 600
    assert 0 < asked[0] <= (2**cells.depth) ** 2 < 600
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), axis=1)
    found = dict(known.select("point_id", "core").collect())
    assert np.allclose([found[i] for i in range(600)], d[:, 4], rtol=1e-12)


def test_largest_component_does_not_ask(spark, monkeypatch):
    """The others' ways out lead to it, and the tree is as short as the least one of all pairs."""
    rng = np.random.default_rng(3)
    x = np.r_[rng.uniform(0, 1, (150, 2)), rng.uniform(0, 1, (30, 2)) + 3, rng.uniform(0, 1, (20, 2)) - 4]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "row_id long, features array<double>")
    placed, cells, lists = neighbours.prepare(df, 3, "euclidean", 16, "row_id")
    points = neighbours.with_core(placed, lists, 3)
    rounds, picks_of = [], spanning._round_picks

    def watched(blocks, names, *args):
        picks = picks_of(blocks, names, *args)
        rounds.append(({r.comp for r in names.select("comp").distinct().collect()}, {r.comp for r in picks.collect()}))
        return picks

    monkeypatch.setattr(spanning, "_round_picks", watched)
    edges = spanning.min_span_tree(points, cells).toPandas()
    assert rounds and all(len(comps - asked) == 1 and asked < comps for comps, asked in rounds)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, 3]
    w = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    inside, best, total = np.zeros(200, bool), np.full(200, np.inf), 0.0
    best[0] = 0
    for _ in range(200):
        i = int(np.where(inside, np.inf, best).argmin())
        inside[i], total, best = True, total + best[i], np.minimum(best, w[i])
    assert len(edges) == 199 and np.isclose(edges["w"].sum(), total, rtol=1e-12)


def test_shortest_edge_between_two_sides():
    """As among all pairs, whatever the bound and the order of the cores, with equal edges too."""
    rng = np.random.default_rng(8)
    for turn in range(40):
        x, y = np.round(rng.normal(size=(50, 3)), 1), np.round(rng.normal(size=(70, 3)) + turn / 20, 1)
        a_core, b_core = (np.round(rng.uniform(0, 1, n), 1) for n in (50, 70))
        a, b = rng.permutation(50), 50 + rng.permutation(70)
        w = np.maximum(np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2)), np.maximum(a_core[:, None], b_core[None, :]))
        for bound in (np.inf, np.median(w), w.min()):
            best, i, j = spanning._shortest(x, a_core, a, y, b_core, b, bound, "euclidean")
            assert (i, j) == (-1, -1) if w.min() >= bound else np.isclose(best, w.min()) and np.isclose(w[i, j], w.min())
