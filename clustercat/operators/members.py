"""Attach labels to rows, choose members, export them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clustercat.functions.numeric import clean, finite

# Fixed value: column order of the ranked member list.
MEMBER_COLUMNS = (
    "source_id", "ra", "dec", "parallax", "pmra", "pmdec", "color", "M_G", "ruwe", "prob", "cluster",
)


def choose_members(cluster: Column, prob: Column, threshold: float = 0.5) -> Column:
    """True for clustered rows at or above the threshold; never NULL, and NaN is below any threshold."""
    return F.coalesce((cluster >= 0) & (clean(prob) >= float(threshold)), F.lit(False))


def with_members(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return df.withColumn("is_member", choose_members(F.col("cluster"), F.col("prob"), threshold))


def attach_cluster(df: DataFrame, labels: DataFrame, threshold: float = 0.5, key: str = "row_id") -> DataFrame:
    """Join labels one to one by key.

    A key that either side lacks or repeats raises ValueError before anything is returned.
    """
    plain = labels.select(key, "cluster", "prob")
    sides = df.select(key, F.lit(1).alias("rows"), F.lit(0).alias("labels")).unionByName(
        plain.select(key, F.lit(0).alias("rows"), F.lit(1).alias("labels"))
    )
    counts = sides.groupBy(key).agg(F.sum("rows").alias("rows"), F.sum("labels").alias("labels"))
    if not counts.filter(f"rows <> 1 or labels <> 1 or `{key}` is null").isEmpty():
        raise ValueError("rows and labels do not match one to one")
    return with_members(df.join(plain, key), threshold)


def reattach_all_rows(df: DataFrame, labels: DataFrame, threshold: float = 0.5, key: str = "row_id") -> DataFrame:
    """Left join: rows that were not clustered become noise with probability 0.

    A key that the labels repeat raises ValueError, as it would multiply rows.
    """
    if not labels.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError("labels repeat a key")
    joined = df.join(labels.select(key, "cluster", "prob"), key, "left")
    joined = joined.withColumns(
        {
            "cluster": F.coalesce("cluster", F.lit(-1)),
            "prob": F.coalesce("prob", F.lit(0.0)),
        }
    )
    return with_members(joined, threshold)


def filter_non_noise(df: DataFrame, label: str = "cluster") -> DataFrame:
    return df.filter(F.col(label) >= 0)


def filter_cluster(df: DataFrame, label: int, column: str = "cluster") -> DataFrame:
    """Rows of one cluster; a label nobody has is an error."""
    rows = df.filter(F.col(column) == label)
    if rows.isEmpty():
        raise ValueError(f"no rows in cluster {label}")
    return rows


def filter_finite_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.filter(finite(F.col(x)) & finite(F.col(y)))


def subset_members(df: DataFrame, members_only: bool = True) -> DataFrame:
    """Members if asked for and flagged, else everything."""
    return df.filter("is_member") if members_only and "is_member" in df.columns else df


def members_only_check(df: DataFrame) -> DataFrame:
    """One row: are all rows members, is any."""
    return df.agg(
        F.bool_and("is_member").alias("all_members"), F.bool_or("is_member").alias("any_member")
    )


def flag_target_cluster(df: DataFrame, selection: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add ``is_target``: in the chosen cluster and at or above the threshold."""
    chosen = selection.select("label").scalar()
    return df.withColumn(
        "is_target",
        F.coalesce((F.col("cluster") == chosen) & (clean(F.col("prob")) >= float(threshold)), F.lit(False)),
    )


def member_count(df: DataFrame) -> DataFrame:
    """One row: rows, members and, where flagged, rows of the target cluster."""
    flags = [c for c in ("is_member", "is_target") if c in df.columns]
    return df.agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(F.col(c)).alias(f"n_{c.removeprefix('is_')}") for c in flags],
    )


def export_members(df: DataFrame, flag: str = "is_member") -> DataFrame:
    return df.filter(F.col(flag))


def export_members_ranked(df: DataFrame, key: str = "row_id") -> DataFrame:
    """Members in fixed column order, most probable first."""
    columns = [c for c in dict.fromkeys((key, *MEMBER_COLUMNS)) if c in df.columns]
    return df.filter("is_member").select(*columns).orderBy(F.desc_nulls_last("prob"), key)
