import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from clustercat.plans import jobs
from clustercat.together import together

CATALOG = {"ra": "ra", "dec": "dec", "parallax": "parallax", "pmra": "pmra", "pmdec": "pmdec", "g": "phot_g_mean_mag", "bp": "phot_bp_mean_mag", "rp": "phot_rp_mean_mag", "ruwe": "ruwe"}
REFERENCE = {"ra": "RA_ICRS", "dec": "DE_ICRS", "parallax": "plx", "pmra": "pmRA", "pmdec": "pmDE", "gmag": "Gmag", "color": "Bp-Rp"}


def stars(rng, n, parallax, pm):
    return np.c_[
        rng.uniform(50, 60, n), rng.uniform(20, 25, n), rng.normal(parallax, 0.1, n), rng.normal(pm[0], 0.5, n), rng.normal(pm[1], 0.5, n),
        rng.uniform(9.5, 12, n), rng.uniform(12, 14, n), rng.uniform(10, 12.5, n), np.full(n, 1.1),
    ]


def test_from_files_to_figures(spark, tmp_path):
    rng = np.random.default_rng(42)
    rows = np.r_[stars(rng, 60, 7.4, (20, -45)), stars(rng, 140, 1.5, (2, -4))]
    rows[3, 8] = 2.2
    rows[5, 5] = np.nan
    names = list(CATALOG.values())
    catalog = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], ", ".join(["source_id long"] + [f"{c} double" for c in names]))
    catalog.write.option("header", True).csv(str(tmp_path / "catalog.csv"))
    near = stars(rng, 8, 7.4, (20, -45))[:, :7]
    near[:, 6] = 1.3
    spark.createDataFrame([tuple(map(float, r)) for r in near], ", ".join(f"`{c}` double" for c in REFERENCE.values())).write.parquet(str(tmp_path / "list.parquet"))

    done = jobs.job_preprocess(spark, str(tmp_path / "catalog.csv"), str(tmp_path / "list.parquet"), str(tmp_path / "interim"), CATALOG, REFERENCE, key="source_id")
    assert done["catalog"].count() == 199 and done["reference"].count() == 8
    assert {r.column for r in done["catalog_report"].collect()} >= {"parallax", "M_G"}

    clean, processed = str(tmp_path / "interim" / "catalog_clean.parquet"), str(tmp_path / "processed")
    out = jobs.job_cluster(spark, clean, processed, min_cluster_size=15, min_samples=5)
    meta = out["meta"].first()
    assert (meta.n_total, meta.n_used, meta.n_samples) == (199, 198, 198) and meta.n_clusters >= 2
    unused = out["labelled"].filter("source_id = 5").first()
    assert (unused.cluster, unused.prob, unused.is_member) == (-1, 0.0, False)

    checked = jobs.job_validate(spark, f"{processed}/clustered.parquet", f"{processed}/features.parquet", str(tmp_path / "interim" / "valid_clean.parquet"), str(tmp_path / "validated"))
    target = checked["selection"].first()
    assert target.method == "closest_to_valid_median" and abs(target.details.plx_c - 7.4) < 0.3
    assert checked["silhouette"].first()[0] > 0.2
    assert checked["target_members"].agg(F.max("source_id")).first()[0] < 60

    manifest = jobs.job_report(spark, str(tmp_path / "validated" / "validated.parquet"), str(tmp_path / "figures"), str(tmp_path / "interim" / "valid_clean.parquet"), f"{processed}/condensed_tree.parquet", panels_for=[0, 1])
    written = {r.name: r.path for r in manifest.collect()}
    assert {"condensed_tree", "cmd_members_vs_valid", "radial_profile_members", "panel_cluster"} <= set(written)
    assert spark.read.parquet(written["sky_scatter_all"]).filter("source = 'catalog'").count() == 199
    assert {r.cluster for r in spark.read.parquet(written["panel_labels"]).collect()} == {0, 1}
    assert {"panel_cluster_sky", "panel_cluster_cmd", "members_only_check"} <= set(written)
    assert checked["silhouette"].first().n_scored == checked["labelled"].filter("cluster >= 0").count()

    # Inputs are found; without members there are no box and violin tables.
    none = spark.read.parquet(f"{processed}/clustered.parquet").withColumn("is_member", F.lit(False))
    none.write.parquet(str(tmp_path / "alone" / "clustered.parquet"))
    found = {r.name for r in jobs.job_report(spark, None, str(tmp_path / "more"), processed=str(tmp_path / "alone")).collect()}
    assert "cmd_members_vs_valid" in found and not {"box_by_cluster_members", "violin_by_cluster_members"} & found


def test_row_numbers_without_a_key(spark):
    """Numbers are unique and depend on the rows alone, not on their files."""
    rows = spark.range(100).select((F.col("id") % 90).alias("a"), F.lit(None).cast("string").alias("b"))
    numbered = [sorted((r.row_id, r.a) for r in jobs.with_row_id(rows.repartition(n), None).collect()) for n in (1, 4)]
    assert numbered[0] == numbered[1] and [i for i, _ in numbered[0]] == list(range(100))


def test_independent_jobs_run_side_by_side(spark):
    """Each waits for the other inside a job of its own; results come in the order given, errors are raised."""
    met = threading.Barrier(2, timeout=60)

    def build(n):
        met.wait()
        return spark.range(n).count()

    assert list(together(spark, {"a": lambda: build(3), "b": lambda: build(5)}, ["b"]).items()) == [("a", 3), ("b", 5)]
    with pytest.raises(ZeroDivisionError):
        together(spark, {"a": lambda: 1 // 0, "b": lambda: 1})
