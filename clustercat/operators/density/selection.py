"""Choose clusters from the hierarchy, label the rows, give them probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustercat.functions.geometry import real_distance
from clustercat.operators.density.cells import CELL_ROWS
from clustercat.operators.density.components import roots
from clustercat.operators.density.contraction import best_below
from clustercat.operators.density.hierarchy import SEGMENT_EDGES, cluster_stability, condensed_tree
from clustercat.operators.density.neighbours import prepare, searchable, to_rows
from clustercat.operators.density.spanning import min_span_tree
from clustercat.operators.ranking import positions
from clustercat.storage import keep, unbroadcast

METHODS = ("eom", "leaf")


def _topmost(clusters: DataFrame, flagged: DataFrame) -> DataFrame:
    """``cluster, chosen``: the highest flagged cluster on the way up, itself included."""
    marks = flagged.select("cluster", F.col("cluster").alias("chosen"))
    now = keep(clusters.select("cluster", F.col("parent").alias("up")).join(unbroadcast(marks), "cluster", "left"), "chosen")
    while not now.filter("up is not null").isEmpty():
        above = now.select(F.col("cluster").alias("up"), F.col("up").alias("next"), F.col("chosen").alias("higher"))
        now = keep(
            now.join(unbroadcast(above), "up", "left").select(
                "cluster", F.col("next").alias("up"), F.coalesce("higher", "chosen").alias("chosen")
            ),
            "chosen",
        )
    return now.select("cluster", "chosen")


def _excess_of_mass(stable: DataFrame) -> DataFrame:
    """Clusters at least as stable as the best choice below them, on a tree of any size and depth."""
    tree = stable.select(F.col("cluster").alias("node"), "parent", F.col("stability").alias("own"))
    below, _ = best_below(tree)
    return below.filter("own >= below").select(F.col("node").alias("cluster"))


def select_clusters(
    stable: DataFrame, method: str = "eom", epsilon: float = 0.0, allow_single_cluster: bool = False
) -> DataFrame:
    """``cluster, chosen``: for every cluster the selected one it belongs to, or NULL.

    "eom" keeps what lasts longest, "leaf" the smallest clusters. A selected
    cluster that formed below distance ``epsilon`` gives way to its first ancestor
    formed above it. The root is eligible only with ``allow_single_cluster``.
    """
    if method not in METHODS:
        raise ValueError(f"unsupported method {method!r}, use one of {METHODS}")
    if method == "eom":
        flagged = _excess_of_mass(stable)
    else:
        parents = stable.filter("parent is not null").select(F.col("parent").alias("cluster")).distinct()
        flagged = stable.select("cluster").join(parents, "cluster", "left_anti")
    if not allow_single_cluster:
        flagged = flagged.join(unbroadcast(stable.filter("parent is not null").select("cluster")), "cluster")
    chosen = _topmost(stable, flagged)
    if epsilon <= 0:
        return chosen
    picked = chosen.filter("cluster = chosen").select("cluster")
    inner = stable.filter("parent is not null")
    if not allow_single_cluster:
        top = stable.filter("parent is null").select(F.col("cluster").alias("parent"))
        inner = inner.join(top, "parent", "left_anti")
    # Climb while the cluster formed at or below epsilon.
    climb = inner.filter(F.col("born_w") <= float(epsilon)).select(F.col("cluster").alias("node"), "parent")
    ends = roots(climb).withColumnRenamed("node", "cluster")
    short = picked.join(stable.select("cluster", "born_w"), "cluster").join(ends, "cluster", "left")
    moved = short.select(
        F.when(F.col("born_w") < float(epsilon), F.coalesce("root", "cluster")).otherwise(F.col("cluster")).alias("cluster")
    )
    return _topmost(stable, moved.distinct())


def membership_probability(tree: DataFrame, stable: DataFrame, chosen: DataFrame) -> DataFrame:
    """``point_id, chosen, prob``: lambda of the point over the largest in its cluster, at most 1; 0 for noise."""
    deaths = stable.select(F.col("cluster").alias("chosen"), "death")
    of_parent = chosen.join(unbroadcast(deaths), "chosen", "left").withColumnRenamed("cluster", "parent")
    points = tree.filter(~F.col("is_cluster")).select("parent", F.col("child").alias("point_id"), "lambda_val", "child_size")
    share = F.try_divide(F.least("lambda_val", "death"), F.col("death"))
    prob = F.when(F.col("chosen").isNull(), 0.0).otherwise(F.coalesce(share, F.lit(1.0)))
    return points.join(unbroadcast(of_parent), "parent").select("point_id", "chosen", prob.alias("prob"), F.col("child_size").alias("weight"))


def hierarchy(
    df: DataFrame,
    min_cluster_size: int = 30,
    min_samples: int | None = None,
    metric: str = "euclidean",
    cell_rows: int = CELL_ROWS,
    segment_edges: int = SEGMENT_EDGES,
    key: str = "row_id",
) -> dict[str, DataFrame]:
    """Every table from points to cluster stabilities: points, edges, tree, clusters."""
    k = max(1, int(min_samples or min_cluster_size))
    _, cells, points = prepare(searchable(df, metric, key), k, metric, cell_rows, key, core_only=True)
    edges = keep(min_span_tree(points, cells).withColumn("w", real_distance(F.col("w"), metric)), "span")
    points = points.withColumn("core", real_distance(F.col("core"), metric))
    tree, clusters = condensed_tree(edges, points, min_cluster_size, segment_edges)
    return {
        "points": points,
        "edges": edges,
        "tree": tree,
        "clusters": keep(cluster_stability(tree, clusters), "stability"),
    }


def label_points(tables: dict[str, DataFrame], chosen: DataFrame) -> DataFrame:
    """``point_id, cluster, prob``: labels 0, 1, … by size, then by smallest row; -1 for noise."""
    fitted = keep(membership_probability(tables["tree"], tables["clusters"], chosen), "fitted")
    sizes = fitted.filter("chosen is not null").groupBy("chosen").agg(
        F.sum("weight").alias("size"), F.min("point_id").alias("first")
    )
    names = positions(sizes, F.desc("size"), F.asc("first"), name="cluster").select("chosen", F.col("cluster").cast("int"))
    known = fitted.join(unbroadcast(names), "chosen", "left").select("point_id", "cluster", "prob")
    every = tables["points"].select("point_id").join(unbroadcast(known), "point_id", "left")
    return every.select(
        "point_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("prob", F.lit(0.0)).alias("prob")
    )


def density_cluster(
    df: DataFrame,
    min_cluster_size: int = 30,
    min_samples: int | None = None,
    metric: str = "euclidean",
    epsilon: float = 0.0,
    method: str = "eom",
    allow_single_cluster: bool = False,
    cell_rows: int = CELL_ROWS,
    segment_edges: int = SEGMENT_EDGES,
    key: str = "row_id",
) -> DataFrame:
    """``row_id, cluster, prob`` for every row with features.

    ``min_samples`` neighbours, the row itself not counted, set the core
    distance; by default as many as ``min_cluster_size``.
    """
    if method not in METHODS:
        raise ValueError(f"unsupported method {method!r}, use one of {METHODS}")
    tables = hierarchy(df, min_cluster_size, min_samples, metric, cell_rows, segment_edges, key)
    chosen = keep(select_clusters(tables["clusters"], method, epsilon, allow_single_cluster), "selected")
    labels = label_points(tables, chosen)
    named = tables["points"].select("point_id", "features").join(unbroadcast(labels), "point_id").drop("point_id")
    return to_rows(searchable(df, metric, key), named, key)
