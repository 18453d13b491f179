import math

import pytest
from pyspark.sql import functions as F

from clustercat.functions import numeric, sky
from clustercat.operators import harmonise, members, scale

NAN = float("nan")
MAP = {"parallax": "plx", "pmra": "pmra", "pmdec": "pmdec", "g": "phot_g_mean_mag", "bp": "bp_mag", "rp": "rp_mag", "ruwe": "ruwe"}


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        (1, 5.0, 20.0, -45.0, 10.0, 12.0, 11.0, 1.1),
        (2, 0.0, 20.0, -45.0, 10.0, 12.0, 11.0, 1.1),
        (3, -1.0, 20.0, -45.0, 10.0, 12.0, 11.0, 1.1),
        (4, NAN, 20.0, -45.0, 10.0, 12.0, 11.0, 1.1),
        (5, None, 20.0, -45.0, 10.0, 12.0, 11.0, 1.1),
        (6, 6.0, 20.0, -45.0, 10.0, 12.0, 11.0, 1.4),
        (7, 6.0, 20.0, -45.0, 10.0, 12.0, 11.0, NAN),
        (8, 7.0, None, -45.0, 11.0, 12.5, 11.0, 1.39),
    ]
    names = "row_id long, plx double, pmra double, pmdec double, phot_g_mean_mag double, bp_mag double, rp_mag double, ruwe double"
    return spark.createDataFrame(rows, names)


def test_filters_and_derived_columns(raw):
    out = {r.row_id: r for r in harmonise.harmonize_catalog(raw, MAP).collect()}
    assert sorted(out) == [1, 8]
    assert out[1].color == 1.0
    assert out[1].M_G == pytest.approx(10.0 + 5 * math.log10(5.0) - 10.0)
    assert sorted(r.row_id for r in harmonise.harmonize_catalog(raw, MAP, ruwe_max=None).collect()) == [1, 6, 7, 8]
    assert [r.row_id for r in harmonise.harmonize_catalog(raw, MAP, drop_missing=True).collect()] == [1]


def test_rescale_follows_the_filter(raw):
    out = harmonise.harmonize_catalog(raw, MAP, rescale={"parallax": 2.0, "pm": 3.0}).orderBy("row_id").first()
    assert (out.parallax, out.pmra, out.pmdec) == (10.0, 60.0, -135.0)


def test_core_is_required_and_the_rest_optional(raw):
    with pytest.raises(KeyError):
        harmonise.harmonize_catalog(raw.drop("plx"), MAP)
    out = harmonise.harmonize_catalog(raw.drop("bp_mag", "ruwe", "phot_g_mean_mag"), MAP)
    assert not {"color", "M_G"} & set(out.columns) and out.count() == 4


def test_reference_requires_nothing(raw):
    out = harmonise.harmonize_reference(raw, MAP)
    assert "color" not in out.columns and sorted(r.row_id for r in out.collect()) == [1, 6, 7, 8]
    assert harmonise.harmonize_reference(raw.select("row_id")).count() == 8


def test_bad_text(spark):
    df = spark.createDataFrame([(1, " 1.5 "), (2, "abc"), (3, None)], "row_id long, x string")
    assert [r.x for r in harmonise.coerce_numeric(df, ["x"]).collect()] == [1.5, None, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        harmonise.strict_numeric(df, ["x"]).collect()


def test_first_alias_wins(spark):
    spark.conf.set("spark.sql.caseSensitive", True)
    try:
        df = spark.createDataFrame([(1.0, 2.0, 0.7, 0)], "BP_RP double, bp_rp double, probability double, cluster_label int")
        out = harmonise.alias_harmonise(df, 0.7)
        assert out.columns == ["color", "bp_rp", "prob", "cluster", "is_member"] and out.first().is_member
    finally:
        spark.conf.set("spark.sql.caseSensitive", False)


@pytest.mark.parametrize(
    "columns, expected", [("cluster int, prob double", False), ("prob double", False), ("cluster int", True), ("other int", False)]
)
def test_membership_fallbacks(spark, columns, expected):
    row = tuple(0 if " int" in c else 0.4 for c in columns.split(","))
    assert harmonise.alias_harmonise(spark.createDataFrame([row], columns)).first().is_member is expected


def test_unit_checks(spark):
    small = spark.createDataFrame([(0.5, 3.0, 4.0), (0.7, 3.0, 4.0)], "parallax double, pmra double, pmdec double")
    big = spark.createDataFrame([(7.0, 30.0, 40.0)], "parallax double, pmra double, pmdec double")
    assert harmonise.unit_sanity(small).first().suspicious and not harmonise.unit_sanity(big).first().suspicious
    ratio = harmonise.unit_ratio_check(small, big).first()
    assert ratio.parallax_ratio == pytest.approx(7 / 0.6) and ratio.pm_ratio == 10 and ratio.suspicious


def test_scaling(spark):
    df = spark.createDataFrame([(i, float(i + 1), 10 + 2 * i, 3.0) for i in range(4)] + [(9, NAN, 1, 3.0)], "row_id long, a double, b int, c double")
    out = scale.standardize(df, ["a", "b", "c"])
    assert dict(out.dtypes)["features"] == "array<float>" and out.count() == 4
    for i in range(3):
        x = [r.features[i] for r in out.collect()]
        assert sum(x) == pytest.approx(0, abs=1e-6)
        assert sum(v * v for v in x) / 4 == pytest.approx(1.0 if i < 2 else 0.0, abs=1e-6)
    fitted = {r.feature: (r["mean"], r["scale"]) for r in scale.scaler_params(scale.select_features(df, ["a", "c"]), ["a", "c"]).collect()}
    assert fitted["c"] == (3.0, 1.0) and fitted["a"][0] == 2.5
    with pytest.raises(ValueError):
        scale.select_features(df, ["nope"])
    with pytest.raises(KeyError):
        scale.select_features_strict(df, ["a", "nope"])


def test_angles(spark):
    diff = sky.angle_diff(F.lit(-179.0), F.lit(179.0))
    away = sky.angular_distance(F.lit(10.0), F.lit(0.0), F.lit(190.0), F.lit(0.0))
    row = spark.range(1).select(diff.alias("d"), away.alias("a"), sky.direction_deg(F.lit(0.0), F.lit(2.0)).alias("up")).first()
    assert row.d == pytest.approx(2.0) and row.a == pytest.approx(180.0) and row.up == 90.0


def test_bins_agree_with_edges(spark):
    df = spark.createDataFrame([(i / 10,) for i in range(11)], "x double")
    b = numeric.bin_index(F.col("x"), F.lit(0.0), F.lit(1.0), 10)
    for r in df.select("x", b.alias("b")).collect():
        lo, hi = r.b * 0.1, (r.b + 1) * 0.1
        assert lo <= r.x and (r.x < hi or r.b == 9)


def test_attach(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "row_id long, name string")
    labels = spark.createDataFrame([(1, 0, 0.7), (2, -1, 0.9)], "row_id long, cluster int, prob double")
    with pytest.raises(ValueError):
        members.attach_cluster(df, labels)
    out = members.attach_cluster(df.filter("row_id < 3"), labels, 0.7)
    assert {r.row_id: r.is_member for r in out.collect()} == {1: True, 2: False}
    every = {r.row_id: (r.cluster, r.prob, r.is_member) for r in members.reattach_all_rows(df, labels).collect()}
    assert every == {1: (0, 0.7, True), 2: (-1, 0.9, False), 3: (-1, 0.0, False)}


def test_member_helpers(spark):
    df = spark.createDataFrame([(1, 0, 0.9, True), (2, 1, 0.8, True), (3, -1, None, False)], "row_id long, cluster int, prob double, is_member boolean")
    none = spark.createDataFrame([(None,)], "label int")
    assert not any(r.is_target for r in members.flag_target_cluster(df, none).collect())
    with pytest.raises(ValueError):
        members.filter_cluster(df, 5)
    assert members.subset_members(df.drop("is_member")).count() == 3
    check = members.members_only_check(df).first()
    assert (check.all_members, check.any_member) == (False, True)
    assert [r.row_id for r in members.export_members_ranked(df).collect()] == [1, 2]


def test_repeated_keys_are_refused(spark):
    rows = spark.createDataFrame([(1,), (2,)], "row_id long")
    once = spark.createDataFrame([(1, 0, 0.9), (2, -1, 0.0)], "row_id long, cluster int, prob double")
    assert members.attach_cluster(rows, once).count() == 2
    for labels in (once.union(once.limit(1)), once.filter("row_id = 1"), once.withColumn("row_id", F.col("row_id") + 1)):
        with pytest.raises(ValueError):
            members.attach_cluster(rows, labels)
    with pytest.raises(ValueError):
        members.attach_cluster(rows.union(rows), once)
    with pytest.raises(ValueError):
        members.reattach_all_rows(rows, once.union(once))


def test_nan_is_no_member(spark):
    df = spark.createDataFrame([(1, 0, float("nan")), (2, 0, 0.9)], "row_id long, cluster int, prob double")
    chosen = spark.createDataFrame([(0,)], "label int")
    for flagged, flag in (
        (members.with_members(df), "is_member"), (harmonise.alias_harmonise(df), "is_member"),
        (members.flag_target_cluster(df, chosen), "is_target"),
    ):
        assert {r.row_id: r[flag] for r in flagged.collect()} == {1: False, 2: True}


def test_member_columns_in_order(spark):
    names = ["cluster", "prob", "g", "ruwe", "M_G", "color", "pmdec", "pmra", "parallax", "dec", "ra", "source_id"]
    df = spark.range(1).select(*[F.lit(1.0).alias(c) for c in names], F.lit(True).alias("is_member"))
    assert members.export_members_ranked(df, "source_id").columns == [
        "source_id", "ra", "dec", "parallax", "pmra", "pmdec", "color", "M_G", "ruwe", "prob", "cluster"
    ]
