"""Order without a one-task window: positions, top rows, reproducible samples."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clustercat.storage import keep

SLICES = 64


def positions(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Add the 0-based place of each row in a total order.

    Rows are range-partitioned on the order, numbered inside each partition, and
    shifted by the sizes of the partitions before; ``order`` should end in a
    unique column so that a heavy tie still spreads over partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    numbered = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumns({"_part": F.spark_partition_id(), "_local": local})
    )
    numbered = keep(numbered, "numbered")
    # One row per partition, so this window is as small as the cluster's parallelism.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("_part")
        .count()
        .select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    return numbered.join(offsets, "_part").withColumn(name, F.col("_offset") + F.col("_local")).drop(
        "_part", "_local", "_offset"
    )


def sample_rows(
    df: DataFrame, n: int, key: str = "row_id", seed: int = 0, by: str | None = None
) -> DataFrame:
    """At most ``n`` rows, overall or per group, the same ones every time.

    Rows are taken in the order of a hash of key and seed. Every partition sends on its
    first ``n`` at most, of each group too, and partitions meet in slices before their group does, so no task
    ranks a whole table or a whole large group.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    if by is None:
        return df.orderBy(draw, key).limit(n)
    ranked = df.withColumns({"_draw": draw, "_slice": F.pmod(F.spark_partition_id(), F.lit(SLICES))})
    for slices in ([by, "_slice"], [by]):
        order = Window.partitionBy(*slices).orderBy("_draw", key)
        ranked = ranked.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n)
    return ranked.drop("_draw", "_slice", "_rank")


def cluster_counts(df: DataFrame, label: str = "cluster") -> DataFrame:
    """Rows per label, noise included, in label order."""
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).orderBy(label)


def top_clusters(df: DataFrame, n: int = 6, label: str = "cluster") -> DataFrame:
    """The ``n`` largest clusters by size, then noise as the last row."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    top = counts.filter(F.col(label) >= 0).orderBy(F.desc("n"), label).limit(n)
    ranked = top.withColumn("is_noise", F.lit(False)).unionByName(
        counts.filter(F.col(label) == -1).withColumn("is_noise", F.lit(True))
    )
    return ranked.orderBy("is_noise", F.desc("n"), label)


def largest_cluster(df: DataFrame, label: str = "cluster") -> DataFrame:
    """One row: the non-noise label with most rows; ties go to the lowest label."""
    counts = df.filter(F.col(label) >= 0).groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg(F.max_by(label, F.struct(F.col("n"), -F.col(label))).alias(label), F.max("n").alias("n"))


def head(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of a stated order."""
    return df.orderBy(*order).limit(n)


def panel_labels(df: DataFrame, only: Iterable[int] | None = None, label: str = "cluster") -> DataFrame:
    """Distinct labels in order, optionally only those listed; noise included."""
    labels = df.select(label).filter(F.col(label).isNotNull()).distinct()
    if only is not None:
        labels = labels.filter(F.col(label).isin(list(only)))
    return labels.orderBy(label)
