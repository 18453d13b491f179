import numpy as np
import pytest
from pyspark.sql import functions as F

from clustercat.operators import compare, quantiles, ranking, summary
from clustercat.operators.quantiles import group_quantiles, median_mad, robust_limits


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, 6.2 if i < 25 else 6.6, 20.0 if i < 25 else 21.0, -45.0 if i < 25 else -44.0, int(i >= 25), 1.0) for i in range(50)]
    return spark.createDataFrame(rows, "row_id long, parallax double, pmra double, pmdec double, cluster int, prob double")


@pytest.fixture(scope="module")
def reference(spark):
    return spark.createDataFrame([(6.4, 20.5, -44.5)] * 20, "parallax double, pmra double, pmdec double")


@pytest.mark.parametrize("steps, slack", [(512, 2), (64, 0), (2048, -30)])
def test_quantiles_are_exact(spark, monkeypatch, steps, slack):
    """Also where the brackets are narrow, and where they miss their ranks and all values are looked at."""
    monkeypatch.setattr(quantiles, "STEPS", steps)
    monkeypatch.setattr(quantiles, "SLACK", slack)
    rng = np.random.default_rng(1)
    x = np.r_[rng.lognormal(0, 2, 3000), np.full(1500, 0.25), rng.normal(50, 1, 500)]
    g = np.r_[np.zeros(4000), np.ones(997), [2, 2, 3]].astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, x)], "g int, x double").repartition(5)
    ps = [0.0, 0.005, 0.25, 0.5, 0.995, 1.0]
    for r in group_quantiles(df, ["g"], {"x": ps}).collect():
        assert r.x_n == (g == r.g).sum()
        np.testing.assert_allclose([r[f"x_q{i}"] for i in range(len(ps))], np.quantile(x[g == r.g], ps), rtol=1e-12)
    r = group_quantiles(df, [], {"x": ps}).first()
    np.testing.assert_allclose([r[f"x_q{i}"] for i in range(len(ps))], np.quantile(x, ps), rtol=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0)], "g int, x double")
    assert {r.g: r.x_q0 for r in group_quantiles(df, ["g"], {"x": [0.5]}).collect()} == {1: None, 2: 5.0}
    assert group_quantiles(df.filter("g = 1"), [], {"x": [0.5]}).first().x_q0 is None
    assert median_mad(df.limit(0), [], ["x"]).first().x_mad is None
    assert tuple(robust_limits(df.filter("g = 1"), "x").first()) == (0.0, 1.0)
    assert tuple(robust_limits(df, "x").first()) == (4.0, 6.0)


def test_overview(spark, labelled):
    r = summary.cluster_overview(labelled).first()
    assert (r.n_samples, r.n_clusters, r.frac_noise, r.max_cluster_size, r.prob_mean, r.prob_median) == (50, 2, 0.0, 25, 1.0, 1.0)
    with pytest.raises(KeyError):
        summary.cluster_overview(labelled.drop("cluster"))
    empty = summary.clustering_overview(labelled.limit(0)).first()
    assert (empty.n_samples, empty.n_clusters, empty.frac_noise, empty.max_cluster_size) == (0, 0, None, 0)
    assert "prob_mean" not in summary.clustering_overview(labelled.drop("prob")).columns


def test_noise_share_of_used_and_of_all(labelled):
    used = labelled.withColumn("is_used", F.col("row_id") < 40).withColumn("cluster", F.when(F.col("row_id") < 30, F.col("cluster")).otherwise(-1))
    assert summary.clustering_overview(used).first().frac_noise == 0.4
    assert summary.clustering_overview(used, population="used").first().frac_noise == 0.25


def test_summaries_skip_noise_and_small_groups(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0), (-1, 9.0), (None, 9.0)], "cluster int, x double")
    out = {r.cluster: r for r in summary.numeric_summary(df, ["x", "absent"]).collect()}
    assert sorted(out) == [0, 1] and out[1].x_std is None and out[0].x_median == 2.0
    assert summary.numeric_summary(df, ["absent"]).count() == 0
    assert summary.centroids_full(df.filter("cluster = -1"), ["x"]).count() == 0
    assert {r.stat for r in summary.cluster_stats_long(df, ["x"]).collect()} == {"mean", "std", "median"}


def test_target_cluster(spark, labelled, reference):
    picked = compare.choose_target_cluster(labelled, reference.withColumn("parallax", F.lit(6.55))).first()
    assert (picked.label, picked.method, picked.details.n) == (1, "closest_to_valid_median", 25)
    assert compare.choose_target_cluster(labelled).first().label == 0
    noise = labelled.withColumn("cluster", F.lit(-1))
    assert compare.choose_target_cluster(noise, reference).first().label is None
    zero = reference.withColumns({c: F.lit(0.0) for c in reference.columns})
    assert compare.choose_target_cluster(labelled, zero).first().score == pytest.approx((6.6 - 1) + (np.hypot(21, 44) - 1))
    gap = labelled.withColumn("parallax", F.when(F.col("cluster") == 1, F.col("parallax")))
    assert compare.choose_target_cluster(gap, reference).first().label == 1
    blank = labelled.withColumn("parallax", F.lit(None).cast("double"))
    row = compare.choose_target_cluster(blank, reference).first()
    assert (row.label, row.method, row.score) == (0, "largest_non_noise", None)


def test_comparison(labelled, reference):
    r = compare.compare_to_reference(labelled, reference).first()
    assert r.parallax_mean_cluster == pytest.approx(6.4) and r.parallax_mean_valid == pytest.approx(6.4)
    assert r.pm_angle_diff_deg == pytest.approx(0, abs=1e-9) and "color_mean_diff" not in r.asDict()


def test_positions_spread_ties(spark):
    df = spark.range(1000).selectExpr("id as row_id", "if(id % 3 = 0, 0.5, id / 1000.0D) as prob")
    got = ranking.positions(df, F.col("prob"), F.col("row_id")).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1000))
    assert [(r.prob, r.row_id) for r in got] == sorted((r.prob, r.row_id) for r in got)


def test_samples_are_stable(spark):
    df = spark.range(5000).selectExpr("id as row_id", "cast(if(id < 4990, 0, 1) as int) as cluster")
    one, two = (sorted(r.row_id for r in ranking.sample_rows(d, 50).collect()) for d in (df, df.repartition(7)))
    assert one == two and len(one) == 50
    groups = ranking.cluster_counts(ranking.sample_rows(df, 50, by="cluster")).collect()
    assert [(r.cluster, r.n) for r in groups] == [(0, 50), (1, 10)]


def test_top_clusters(spark):
    sizes = {0: 5, 1: 9, 2: 9, 3: 1, -1: 20}
    df = spark.createDataFrame([(c,) for c, n in sizes.items() for _ in range(n)], "cluster int")
    assert [r.cluster for r in ranking.top_clusters(df, 3).collect()] == [1, 2, 0, -1]
    assert ranking.largest_cluster(df).first().cluster == 1
    assert [r.cluster for r in ranking.panel_labels(df, [3, -1, 8]).collect()] == [-1, 3]


def test_target_without_labels(spark, labelled, reference):
    r = compare.choose_target_cluster(labelled.drop("cluster"), reference).first()
    assert (r.label, r.method, r.score) == (None, None, None)


def test_samples_are_the_same_each_time(spark):
    df = spark.range(5000).withColumnRenamed("id", "row_id").withColumn("g", F.col("row_id") % 3)
    once = {r.row_id for r in ranking.sample_rows(df, 50).collect()}
    assert len(once) == 50 and once == {r.row_id for r in ranking.sample_rows(df.repartition(9), 50).collect()}
    by = ranking.sample_rows(df, 40, by="g").groupBy("g").count().collect()
    assert [r["count"] for r in by] == [40, 40, 40]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_beside_nan_and_infinity(spark, by):
    """NaN counts nowhere, infinities at the ends, with and without groups."""
    rows = [(i % 2, float(i)) for i in range(400)] + [(g, x) for g in (0, 1) for x in (float("nan"), None, float("inf"), -float("inf"))]
    data = spark.createDataFrame(rows, "g int, x double").repartition(5)
    for r in group_quantiles(data, by, {"x": [0.25, 0.5]}).collect():
        values = [x for g, x in rows if x is not None and x == x and (not by or g == r.g)]
        assert r.x_n == len(values)
        assert [r.x_q0, r.x_q1] == pytest.approx(np.quantile(values, [0.25, 0.5]).tolist())
