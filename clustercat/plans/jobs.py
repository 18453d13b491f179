"""The four jobs: prepare, cluster, validate, report.

Each reads tables, writes new ones below its output folder and returns what it
wrote. No job overwrites a table it reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clustercat.operators import compare, distributions, harmonise, members, scale, summary
from clustercat.operators.density.cells import CELL_ROWS
from clustercat.operators.density.selection import hierarchy, label_points, select_clusters
from clustercat.operators.density.neighbours import searchable, to_rows
from clustercat.operators.distributions import PANEL_FEATURES
from clustercat.operators.ranking import panel_labels, positions, sample_rows
from clustercat.operators.silhouette import silhouette_exact
from clustercat.sources.tables import (
    first_existing_reference,
    latest_output,
    load_catalog,
    load_reference,
    save_record,
    save_table,
    scan_any,
)
from clustercat.storage import keep
from clustercat.together import together

# The features clustered and summarised by default, those with histograms and
# with box and violin tables; the names of the views in figure_tables, those with most steps.
FEATURES = ("parallax", "pmra", "pmdec", "color", "M_G")
HISTOGRAMS = ("pmra", "pmdec", "parallax", "color", "M_G", "ruwe", "_pm_mag")
SHAPES = ("_pm_mag", "color", "M_G", "parallax", "ruwe")
LONGEST = ("panel_cluster", "radial_profile_members", "shapes_by_cluster_members", "prob_cdf_all")


def _write(df: DataFrame, path: str) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).parquet(save_table(df, path))


def with_row_id(df: DataFrame, key: str | None) -> DataFrame:
    """``row_id`` from a declared key, else the row's place in the order of a hash of all its columns.

    The place depends on the rows alone, not on how they are spread over files; only equal rows are interchangeable.
    """
    if key is not None:
        return df.withColumn("row_id", F.col(f"`{key}`"))
    columns = [F.col(f"`{c}`") for c in df.columns]
    tied = df.withColumns({"_hash": F.xxhash64(*columns), "_tie": F.monotonically_increasing_id()})
    return positions(tied, F.col("_hash"), *columns, F.col("_tie"), name="row_id").drop("_hash", "_tie")


def job_preprocess(
    spark: SparkSession,
    catalog_path: str,
    reference_path: str,
    out: str,
    catalog_map: Mapping[str, str] | None = None,
    reference_map: Mapping[str, str] | None = None,
    ruwe_max: float | None = 1.4,
    rescale: Mapping[str, float] | None = None,
    key: str | None = None,
) -> dict[str, DataFrame]:
    """Load and harmonise both tables, write them, describe them, compare their units."""

    def clean_catalog() -> DataFrame:
        raw = load_catalog(spark, catalog_path, catalog_map, key=key)
        clean = harmonise.harmonize_catalog(raw, catalog_map, ruwe_max, rescale=rescale)
        return _write(with_row_id(clean, key), f"{out}/catalog_clean.parquet")

    def clean_reference() -> DataFrame:
        listed = load_reference(spark, reference_path, reference_map)
        return _write(harmonise.harmonize_reference(listed, reference_map), f"{out}/valid_clean.parquet")

    catalog, reference = together(spark, {"catalog": clean_catalog, "reference": clean_reference}).values()

    def report(df: DataFrame) -> DataFrame:
        return summary.describe_table(df, [c for c in (*FEATURES, "ruwe") if c in df.columns])

    def units() -> tuple[DataFrame, DataFrame]:
        medians = keep(harmonise.unit_medians(catalog), "medians")
        return harmonise.unit_sanity(catalog, medians), harmonise.unit_ratio_check(catalog, reference, medians)

    done = together(spark, {"catalog": lambda: report(catalog), "reference": lambda: report(reference), "units": units})
    return {
        "catalog": catalog,
        "reference": reference,
        "catalog_report": done["catalog"],
        "reference_report": done["reference"],
        "unit_sanity": done["units"][0],
        "unit_ratio": done["units"][1],
    }


def job_cluster(
    spark: SparkSession,
    catalog_path: str,
    out: str,
    features: Iterable[str] = FEATURES,
    min_cluster_size: int = 30,
    min_samples: int | None = None,
    threshold: float = 0.5,
    metric: str = "euclidean",
    epsilon: float = 0.0,
    method: str = "eom",
    allow_single_cluster: bool = False,
    cell_rows: int = CELL_ROWS,
) -> dict[str, DataFrame]:
    """Scale, cluster, attach to all rows; rows with a missing feature become noise."""
    features = list(features)
    catalog = spark.read.parquet(catalog_path)
    used = scale.select_features_strict(catalog, features)
    scaler = scale.scaler_params(used, features)
    save_record(scaler, f"{out}/scaler.json")
    scaled = _write(scale.standardize(catalog, features), f"{out}/features.parquet")
    tables = hierarchy(scaled, min_cluster_size, min_samples, metric, cell_rows)
    chosen = keep(select_clusters(tables["clusters"], method, epsilon, allow_single_cluster), "selected")
    named = tables["points"].select("point_id", "features").join(label_points(tables, chosen), "point_id")
    labels = keep(to_rows(searchable(scaled, metric), named.drop("point_id")), "labels")
    labelled = _write(members.reattach_all_rows(catalog, labels, threshold), f"{out}/clustered.parquet")
    tree = _write(tables["tree"], f"{out}/condensed_tree.parquet")
    meta = summary.run_meta(summary.clustering_overview(labels), features, min_cluster_size, threshold, labels, catalog)
    save_record(meta, f"{out}/cluster_meta.json")
    return {"labelled": labelled, "features": scaled, "scaler": scaler, "tree": tree, "meta": meta}


def job_validate(
    spark: SparkSession,
    labelled_path: str,
    features_path: str,
    reference_path: str,
    out: str,
    threshold: float = 0.5,
    silhouette_rows: int | None = None,
) -> dict[str, DataFrame]:
    """Overview, silhouette, summaries, comparison, target cluster; flags and member lists.

    The silhouette looks at all rows that were clustered, matched by key, or at a sample
    of ``silhouette_rows`` of them; the record says at how many.
    """
    labelled = scan_any(spark, labelled_path)
    reference = scan_any(spark, reference_path)
    labels = members.filter_non_noise(labelled).select("row_id", "cluster")
    scored = spark.read.parquet(features_path).join(labels, "row_id")
    scored = scored if silhouette_rows is None else sample_rows(scored, silhouette_rows)
    scored = keep(scored, "scored")
    selection = keep(compare.choose_target_cluster(labelled, reference), "selection")
    flagged = members.flag_target_cluster(members.with_members(labelled, threshold), selection, threshold)
    flagged = _write(flagged, f"{out}/validated.parquet")
    result = {
        "overview": summary.clustering_overview(labelled),
        "silhouette": silhouette_exact(scored).withColumn("n_scored", F.lit(scored.count())),
        "numeric_summary": summary.numeric_summary(labelled, [*FEATURES, "ruwe"]),
        "centroids": summary.centroids_full(labelled, FEATURES),
        "comparison": compare.compare_to_reference(labelled, reference),
        "target_comparison": compare.compare_to_reference(flagged, reference, "is_target"),
        "selection": selection,
    }
    for name, table in result.items():
        save_record(table, f"{out}/{name}.json")
    for flag, name in (("is_member", "members"), ("is_target", "target_members")):
        result[name] = _write(members.export_members(flagged, flag), f"{out}/{name}.parquet")
    return result | {"labelled": flagged, "counts": members.member_count(flagged)}


def _views(
    df: DataFrame, reference: DataFrame | None, tree: DataFrame | None, max_arrows: int, panels_for: Iterable[int] | None
) -> dict[str, Callable[[], dict[str, DataFrame]]]:
    """What makes each table of :func:`figure_tables`; box and violin tables share their quartiles and come as two."""
    d, columns = distributions, set(df.columns)
    out: dict[str, Callable[[], dict[str, DataFrame]]] = {}

    def view(name: str, build: Callable[..., DataFrame], *args, **named) -> None:
        out[name] = lambda: {name: build(*args, **named)}

    view("sky_scatter_all", d.sky_points, df, reference=reference)
    view("sky_scatter_members", d.sky_points, df, True, reference=reference)
    view("sky_scatter_prob_all", d.sky_points, df, color_by="prob")
    view("sky_scatter_prob_members", d.sky_points, df, True, color_by="prob")
    view("sky_hexbin_all", d.sky_hexbin, df)
    view("sky_quiver_members", d.sky_vectors, df, sample=max_arrows)
    view("pm_plane_all", d.pm_points, df)
    view("pm_plane_all_ellipse", d.covariance_ellipse, df, "pmra", "pmdec")
    view("pm_plane_prob_all", d.pm_points, df, color_by="prob")
    view("pm_plane_members", d.pm_points, df, True)
    view("pm_plane_members_ellipse", d.covariance_ellipse, members.subset_members(df), "pmra", "pmdec")
    view("pm_plane_hexbin_members", d.pm_hexbin, df)
    view("cmd_members", d.cmd_points, df)
    view("cmd_hexbin_members", d.cmd_hexbin, df)
    if reference is not None and not reference.isEmpty():
        view("cmd_members_vs_valid", d.overlay_cmd, members.subset_members(df), reference)
        if harmonise.has_columns(reference, ("pmra", "pmdec")):
            view("pm_plane_members_vs_valid", d.overlay_pm, members.subset_members(df), reference)
    if {"parallax", "M_G"} <= columns:
        view("mg_vs_parallax_members", d.mg_vs_parallax, df)
    view("hist_by_cluster", d.histogram_by_cluster, df, [c for c in HISTOGRAMS if c in columns])
    if "cluster" in columns and not members.subset_members(df).isEmpty():
        shown = [c for c in SHAPES if c in columns]

        def shaped() -> dict[str, DataFrame]:
            shapes = d.member_shapes(df, shown)
            return {
                "box_by_cluster_members": d.box_stats(df, shown, shapes),
                "violin_by_cluster_members": d.violin_density(df, shown, shapes=shapes),
            }

        out["shapes_by_cluster_members"] = shaped
    if "prob" in columns:
        view("prob_hist", d.prob_histogram, df)
        view("prob_cdf_all", d.prob_cdf, df)
        view("prob_cdf_members", d.prob_cdf, df, True)
        view("members_vs_threshold", d.members_vs_threshold, df)
    if {"ra", "dec"} <= columns:
        view("radial_profile_members", d.radial_profile, df)
    if d.ruwe_vs_g(df) is not None:
        view("ruwe_vs_g_members", d.ruwe_vs_g, df)
    if tree is not None:
        out["condensed_tree"] = lambda: {"condensed_tree": tree}
    if "cluster" in columns:
        chosen = df if panels_for is None else df.filter(F.col("cluster").isin(list(panels_for)))
        view("panel_labels", panel_labels, chosen)
        if any(c in columns for c in PANEL_FEATURES):
            view("panel_cluster", d.cluster_panel, chosen)
        if {"ra", "dec"} <= columns:
            view("panel_cluster_sky", d.cluster_panel_points, chosen, "ra", "dec")
        if {"color", "M_G"} <= columns:
            view("panel_cluster_cmd", d.cluster_panel_points, chosen, "color", "M_G")
        view("panel_cluster_centers", d.cluster_panel_centers, chosen, max_arrows)
        view("panel_cluster_vectors", d.cluster_panel_vectors, chosen, max_arrows)
    return out


def figure_tables(
    df: DataFrame,
    reference: DataFrame | None = None,
    tree: DataFrame | None = None,
    max_arrows: int = 800,
    panels_for: Iterable[int] | None = None,
) -> dict[str, DataFrame]:
    """All distribution tables of a labelled frame, by the name of the view they feed.

    Views of several features are one table with a ``feature`` column.
    """
    made = together(df.sparkSession, _views(df, reference, tree, max_arrows, panels_for), LONGEST)
    return {name: table for tables in made.values() for name, table in tables.items()}


def job_report(
    spark: SparkSession,
    labelled_path: str | None,
    out: str,
    reference_path: str | None = None,
    tree_path: str | None = None,
    threshold: float = 0.5,
    max_arrows: int = 800,
    panels_for: Iterable[int] | None = None,
    processed: str | None = None,
) -> DataFrame:
    """Write every distribution table and the manifest ``name, path`` of what was written.

    With a folder ``processed`` the labelled table may be named inside it or left out, which takes
    the newest there; a reference list that isn't given is looked for near it.
    """
    if processed is not None:
        labelled_path = latest_output(spark, processed, labelled_path)
        reference_path = reference_path or first_existing_reference(spark, processed)
    if labelled_path is None:
        raise ValueError("name a labelled table or the folder to find it in")
    df = keep(harmonise.alias_harmonise(scan_any(spark, labelled_path), threshold), "labelled")
    reference = harmonise.rename_aliases(scan_any(spark, reference_path)) if reference_path else None
    tree = spark.read.parquet(tree_path) if tree_path else None
    views = _views(df, reference, tree, max_arrows, panels_for)
    if "is_member" in df.columns:
        views["members_only_check"] = lambda: {"members_only_check": members.members_only_check(df)}

    def write(build: Callable[[], dict[str, DataFrame]]) -> list[tuple[str, str]]:
        return [(name, save_table(table, f"{out}/{name}.parquet")) for name, table in build().items()]

    done = together(spark, {name: partial(write, build) for name, build in views.items()}, LONGEST)
    manifest = spark.createDataFrame([row for rows in done.values() for row in rows], "name string, path string")
    save_table(manifest, f"{out}/manifest.csv")
    return manifest
