import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clustercat.operators import distributions as d
from clustercat.operators.silhouette import silhouette_exact, silhouette_sampled


@pytest.fixture(scope="module")
def df(spark):
    i = np.arange(60)
    rows = zip(
        i.tolist(), np.linspace(55, 56, 60).tolist(), np.linspace(22, 23, 60).tolist(), np.where(i < 30, 20.0, 21.0).tolist(),
        np.where(i < 30, -45.0, -44.0).tolist(), np.linspace(0.2, 0.95, 60).tolist(), (i >= 30).astype(int).tolist(), (i >= 30).tolist(),
    )
    return spark.createDataFrame(list(rows), "row_id long, ra double, dec double, pmra double, pmdec double, prob double, cluster int, is_member boolean")


@pytest.mark.parametrize("values", [np.linspace(0.2, 0.95, 60), [3.0] * 5, np.arange(31) / 30])
def test_histogram(spark, values):
    x = spark.createDataFrame([(float(v),) for v in values], "x double")
    n, edges = np.histogram(values, bins=30)
    got = d.histogram(x, "x", 30).orderBy("bin").collect()
    assert [r.n for r in got] == n.tolist()
    np.testing.assert_allclose([r.lo for r in got], edges[:-1])
    np.testing.assert_allclose([r.hi for r in got], edges[1:])


def test_histogram_of_nothing(spark):
    x = spark.createDataFrame([(0, None)], "cluster int, x double")
    assert d.histogram(x, "x").count() == 0 and d.histogram(x, "x", by="cluster").count() == 0


def test_each_cluster_has_its_own_range(df):
    rows = d.histogram_by_cluster(df, "ra", 10).collect()
    assert {r.cluster: min(q.lo for q in rows if q.cluster == r.cluster) for r in rows} == pytest.approx({0: 55.0, 1: 55 + 30 / 59})
    assert d.histogram_by_cluster(df.drop("cluster"), "ra", 10).count() == 10
    with pytest.raises(KeyError):
        d.histogram_by_cluster(df, "parallax")


def test_hexbin_counts_every_row_once(spark, df):
    cells = d.sky_hexbin(df).collect()
    assert sum(r.n for r in cells) == 60
    corner = d.hexbin(spark.createDataFrame([(1.0, 1.0)] * 3, "x double, y double"), "x", "y", 10).collect()
    assert [r.n for r in corner] == [3]


def test_cdf(df):
    rows = d.prob_cdf(df).orderBy("cdf").collect()
    np.testing.assert_allclose([r.cdf for r in rows], np.linspace(0, 1, 60))
    assert [r.prob for r in rows] == sorted(r.prob for r in rows)
    assert [r.cdf for r in d.prob_cdf(df.limit(1)).collect()] == [0.0]


def test_threshold_curve_counts_the_edge(df):
    curve = {round(r.threshold, 3): r.n for r in d.members_vs_threshold(df.withColumn("prob", F.lit(0.5))).collect()}
    assert len(curve) == 41 and curve[0.5] == 60 and curve[0.525] == 0


def test_ellipse(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2)) @ np.array([[2.0, 0.7], [0.0, 0.5]])
    data = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(1.0, None)], "x double, y double")
    got = d.covariance_ellipse(data, "x", "y").first()
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert got.width == pytest.approx(4 * np.sqrt(values[1])) and got.height == pytest.approx(4 * np.sqrt(values[0]))
    long_axis = np.degrees(np.arctan2(vectors[1, 1], vectors[0, 1]))
    assert (got.angle - long_axis) % 180 == pytest.approx(0, abs=1e-6) or (got.angle - long_axis) % 180 == pytest.approx(180)
    few = d.covariance_ellipse(data.limit(4), "x", "y").first()
    assert few.center_x is None and few.width == 0


def test_box_and_violin(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    data = spark.createDataFrame([(0, v, True) for v in values] + [(1, 7.0, True)] * 3 + [(0, -50.0, False)], "cluster int, x double, is_member boolean")
    box = {r.cluster: r for r in d.box_stats(data, "x").collect()}
    assert tuple(box[0])[1:] == (2.0, 3.0, 4.0, 1.0, 4.0, 1)
    violin = d.violin_density(data, "x").collect()
    assert {r.density for r in violin if r.cluster == 1} == {1.0}
    mine = [r for r in violin if r.cluster == 0 and r.grid_i == 50][0]
    h = np.std(values, ddof=1) * 5 ** -0.2
    at = 1 + 50 * (99 / 99)
    assert mine.density == pytest.approx(np.exp(-0.5 * ((at - np.array(values)) / h) ** 2).sum() / (5 * h * np.sqrt(2 * np.pi)))
    both = d.box_stats(data.withColumn("y", F.col("x") * 2), ["x", "y"]).filter("feature = 'y' and cluster = 0").first()
    assert both.med == 6.0


def test_radial_profile(spark, df):
    bins = d.radial_profile(df, members_only=False, center=(55.5, 22.5)).collect()
    assert len(bins) == 25 and sum(r.n for r in bins) <= 60
    wrap = spark.createDataFrame([(359.9, 0.0), (0.1, 0.0)], "ra double, dec double")
    assert max(r.r_hi for r in d.radial_profile(wrap, center="circular").collect()) < 0.2


def test_views_need_their_columns(df):
    with pytest.raises(KeyError):
        d.cmd_points(df)
    with pytest.raises(KeyError):
        d.overlay_pm(df, df.select("ra", "dec"))
    assert d.ruwe_vs_g(df) is None
    assert d.sky_points(df, True, "prob", df).count() == 90
    assert d.sky_vectors(df, sample=10).count() == 10


def test_panel(df):
    rows = d.cluster_panel(df).collect()
    assert {(r.feature, r.cluster) for r in rows} == {("_pm_mag", 0), ("_pm_mag", 1)} and len(rows) == 40
    centers = {r.cluster: r.n_arrows for r in d.cluster_panel_centers(df, 20).collect()}
    assert centers == {0: 20, 1: 20}


def _silhouette(x, y):
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    scores = []
    for i in range(len(x)):
        own = (y == y[i]).sum()
        if own == 1:
            scores.append(0.0)
            continue
        a = dist[i, y == y[i]].sum() / (own - 1)
        b = min(dist[i, y == c].mean() for c in set(y) - {y[i]})
        scores.append((b - a) / max(a, b))
    return np.mean(scores)


def test_silhouette(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 3))
    y = np.r_[np.zeros(40), np.ones(45), [2], np.full(4, -1)].astype(int)
    x[y == 1] += 2
    x[:20] = x[0]
    data = spark.createDataFrame([(i, int(c), r.tolist()) for i, (c, r) in enumerate(zip(y, x))], "row_id long, cluster int, features array<double>")
    want = _silhouette(x[y >= 0], y[y >= 0])
    assert silhouette_exact(data).first()[0] == pytest.approx(want)
    assert silhouette_exact(data, block_rows=17).first()[0] == pytest.approx(want)
    assert silhouette_exact(data.filter("cluster = 1")).first()[0] is None
    wide = data.select("row_id", "cluster", *[F.col("features")[i].alias(f"f{i}") for i in range(3)])
    z = (x[y >= 0] - x[y >= 0].mean(0)) / x[y >= 0].std(0)
    assert silhouette_sampled(wide, ["f0", "f1", "f2"]).first()[0] == pytest.approx(_silhouette(z, y[y >= 0]))
    assert -1 <= silhouette_sampled(wide, ["f0", "f1", "f2"], sample=30).first()[0] <= 1
    assert silhouette_sampled(wide, ["none"]).first()[0] is None


def test_each_distance_between_blocks_is_computed_once(monkeypatch):
    from clustercat.operators import silhouette as module

    rng = np.random.default_rng(7)
    x, y, weight = rng.normal(size=(60, 3)), rng.integers(0, 4, 60), rng.integers(1, 3, 60)
    rows = pd.DataFrame({"point": np.arange(60), "cluster": y, "features": list(x), "weight": weight, "block": np.arange(60) % 3})
    count, plain = [], module.distances
    monkeypatch.setattr(module, "distances", lambda a, b: count.append(len(a) * len(b)) or plain(a, b))
    sums = []
    for i in range(3):
        for j in range(i, 4):  # the last block is empty
            part = rows[rows["block"].isin([i, j])].assign(i=i, j=j)
            sums.append(module._pair_sums(part))
    assert sum(count) == 6 * 20 * 20  # six pairs of three blocks of 20 rows
    got = pd.concat(sums).groupby(["point", "other"])["total"].sum()
    dist = plain(x, x) * weight
    for point in range(60):
        for other in range(4):
            assert got[(point, other)] == pytest.approx(dist[point, y == other].sum())


def test_sums_of_blocks_larger_than_a_tile():
    from clustercat.operators import silhouette as module

    rng = np.random.default_rng(8)
    n = 2 * module.TILE[1] + 300
    x = rng.normal(size=(n, 3)) + 1000
    x[1] = x[0] + 1e-9  # so near that a product of matrices has nothing left of it
    y = np.r_[np.zeros(n - 400), np.arange(400) // 4].astype(int)  # a large cluster and many small ones
    rows = pd.DataFrame({"point": np.arange(n), "cluster": y, "features": list(x), "weight": 1, "block": np.arange(n) % 2, "i": 0, "j": 1})
    parts = [rows[rows["block"] == i].assign(i=i, j=i) for i in range(2)] + [rows]
    got = pd.concat([module._pair_sums(part) for part in parts]).groupby(["point", "other"])["total"].sum()
    plain = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.testing.assert_allclose(module.distances(x, x), plain, rtol=1e-9)
    want = np.stack([plain[:, y == c].sum(axis=1) for c in range(100)], axis=1)
    np.testing.assert_allclose(got.unstack().to_numpy(), want, rtol=1e-9)


def test_silhouette_blocks_are_bounded_and_few():
    """A row goes to each block, so blocks must grow with the table until a task's room is used up."""
    from clustercat.operators import silhouette as module

    assert module._block_rows(1_600_000, 5, 3) > 60_000
    assert module._block_rows(10**9, 5, 3) == module.BLOCK_ROWS
    for width, clusters in ((5, 10**6), (2000, 3), (64, 700)):
        rows = module._block_rows(10**9, width, clusters)
        assert rows * width <= module.BLOCK_NUMBERS and rows * min(rows, clusters) <= module.BLOCK_SUMS


def test_box_and_violin_share_their_quartiles(df, monkeypatch):
    features = ["ra", "dec"]
    sort = lambda table: sorted(map(tuple, table.collect()))
    alone = sort(d.box_stats(df, features)), sort(d.violin_density(df, features, 10))
    shapes = d.member_shapes(df, features)
    monkeypatch.setattr(d, "group_profile", None)
    shared = sort(d.box_stats(df, features, shapes)), sort(d.violin_density(df, features, 10, shapes))
    assert [len(t) for t in shared] == [2, 20] and shared[0] == alone[0]
    for one, two in zip(shared[1], alone[1]):
        assert one[:3] == two[:3] and one[3:] == pytest.approx(two[3:])


def test_a_panel_skips_missing_values_and_features_without_any(spark):
    rows = [(0, 1.0, None), (0, 3.0, None), (0, float("nan"), None), (1, 5.0, 2.0), (None, 9.0, 9.0)]
    wide = spark.createDataFrame(rows, "cluster int, parallax double, ruwe double")
    found = {(r.feature, r.cluster): (r.median, r.mad) for r in d.cluster_panel(wide, bins=2).collect()}
    assert found == {("parallax", 0): (2.0, 1.0), ("parallax", 1): (5.0, 0.0), ("ruwe", 1): (2.0, 0.0)}
