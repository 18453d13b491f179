"""Statistics of a labelled table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustercat.functions.numeric import clean, coerce
from clustercat.functions.sky import pm_magnitude
from clustercat.operators.harmonise import require_columns
from clustercat.operators.quantiles import group_profile, group_quantiles


def clustering_overview(
    df: DataFrame, label: str = "cluster", prob: str | None = "prob", population: str = "all"
) -> DataFrame:
    """One row: sizes, noise share and mean/median probability.

    ``population`` is "all" rows, or "used" rows only: those with ``is_used``.
    The labels are counted per label first, so only one row per label meets.
    """
    require_columns(df, [label])
    if population == "used":
        df = df.filter("is_used")
    with_prob = prob is not None and prob in df.columns
    sums = [F.count("*").alias("n")]
    if with_prob:
        p = clean(F.col(prob).cast("double"))
        sums += [F.sum(p).alias("p_sum"), F.count(p).alias("p_n")]
    per_label = df.groupBy(label).agg(*sums)
    clustered = F.col(label) >= 0
    total = F.sum("n")
    out = [
        F.coalesce(total, F.lit(0)).alias("n_samples"),
        F.count_if(clustered).alias("n_clusters"),
        F.try_divide(F.coalesce(F.sum(F.when(F.col(label) < 0, F.col("n"))), F.lit(0)), total).alias("frac_noise"),
        F.coalesce(F.max(F.when(clustered, F.col("n"))), F.lit(0)).alias("max_cluster_size"),
    ]
    if not with_prob:
        return per_label.agg(*out)
    out.append(F.try_divide(F.sum("p_sum"), F.sum("p_n")).alias("prob_mean"))
    median = group_quantiles(df.select(clean(F.col(prob).cast("double")).alias("p")), [], {"p": [0.5]})
    return per_label.agg(*out).withColumn("prob_median", median.select("p_q0").scalar())


def cluster_overview(df: DataFrame, label: str = "cluster", prob: str = "prob") -> DataFrame:
    return clustering_overview(df, label, prob)


def run_meta(
    overview: DataFrame, features: Iterable[str], min_cluster_size: int, threshold: float, used: DataFrame, total: DataFrame
) -> DataFrame:
    """The overview with the run's parameters and row counts."""
    return overview.select(
        "*",
        F.array(*[F.lit(c) for c in features]).alias("features"),
        F.lit(min_cluster_size).alias("min_cluster_size"),
        F.lit(float(threshold)).alias("prob_threshold"),
        used.agg(F.count("*")).scalar().alias("n_used"),
        total.agg(F.count("*")).scalar().alias("n_total"),
    )


def _present(df: DataFrame, columns: Iterable[str] | None) -> list[str]:
    return [c for c in (columns or []) if c in df.columns]


def _clustered(df: DataFrame, label: str, columns: Iterable[str]) -> DataFrame:
    require_columns(df, [label])
    return df.filter(F.col(label) >= 0).select(label, *[coerce(F.col(c)).alias(c) for c in columns])


def numeric_summary(df: DataFrame, features: Iterable[str], label: str = "cluster") -> DataFrame:
    """Per non-noise cluster and feature: count, mean, std, min, median, max."""
    features = _present(df, features)
    rows = _clustered(df, label, features)
    if not features:
        return rows.limit(0)
    profile = group_profile(rows, [label], {c: [0.5] for c in features})
    ordered = []
    for c in features:
        ordered += [F.col(f"{c}_n").alias(f"{c}_count"), f"{c}_mean", f"{c}_std", f"{c}_min"]
        ordered += [F.col(f"{c}_q0").alias(f"{c}_median"), f"{c}_max"]
    return profile.select(label, *ordered)


def centroids_mean(df: DataFrame, features: Iterable[str], label: str = "cluster") -> DataFrame:
    """Per non-noise cluster: the mean of each feature."""
    features = _present(df, features)
    rows = _clustered(df, label, features)
    if not features:
        return rows.limit(0)
    return rows.groupBy(label).agg(*[F.avg(c).alias(f"{c}_mean") for c in features])


def centroids_full(df: DataFrame, features: Iterable[str] = (), label: str = "cluster") -> DataFrame:
    """Per non-noise cluster: n, mean/std/median of features, mean position and motion."""
    features = _present(df, features)
    sky = _present(df, ["ra", "dec"])
    motion = _present(df, ["pmra", "pmdec"])
    motion = motion if len(motion) == 2 else []
    means = [c for c in dict.fromkeys([*sky, *motion]) if c not in features]
    rows = _clustered(df, label, [*features, *means])
    columns: dict[str, list[float]] = {c: [0.5] for c in features} | {c: [] for c in means}
    if motion:
        rows = rows.withColumn("pm_mag", pm_magnitude(F.col("pmra"), F.col("pmdec")))
        columns["pm_mag"] = []
    profile = group_profile(rows, [label], columns)
    out = [F.col("_rows").alias("n")]
    for c in features:
        out += [f"{c}_mean", f"{c}_std"]
    out += [f"{c}_mean" for c in columns if c not in features]
    return profile.select(label, *out, *[F.col(f"{c}_q0").alias(f"{c}_median") for c in features])


def cluster_stats_long(df: DataFrame, features: Iterable[str], label: str = "cluster") -> DataFrame:
    """``cluster, stat`` with one column per feature; rows mean, std, median."""
    features = _present(df, features)
    wide = numeric_summary(df, features, label)
    stats = [
        F.struct(F.lit(stat).alias("stat"), *[F.col(f"{c}_{stat}").alias(c) for c in features])
        for stat in ("mean", "std", "median")
    ]
    return wide.select(label, F.inline(F.array(*stats)))


def describe_table(
    df: DataFrame, columns: Iterable[str], probabilities: Iterable[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """One row per column: count, mean, std, min, the percentiles, max."""
    columns, probabilities = list(columns), list(probabilities)
    rows = df.select(*[F.col(c).try_cast("double").alias(c) for c in columns])
    profile = group_profile(rows, [], {c: probabilities for c in columns})
    records = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"{c}_n").alias("count"),
            *[F.col(f"{c}_{s}").alias(s) for s in ("mean", "std", "min")],
            *[F.col(f"{c}_q{j}").alias(f"p{round(p * 100):02d}") for j, p in enumerate(probabilities)],
            F.col(f"{c}_max").alias("max"),
        )
        for c in columns
    ]
    return profile.select(F.inline(F.array(*records)))
