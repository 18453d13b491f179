"""What several operators share: locators, positions in an order, word borders, samples."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clustercat.storage import keep

# White space between words: blank, and the controls from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def filed(df: DataFrame) -> DataFrame:
    """``df`` if it is read straight from files, else a copy of it in shared storage, the same one each time."""
    try:
        df.select(df.metadataColumn("_metadata")["row_index"])
        return df
    except PySparkException:
        if not hasattr(df, "_filed"):
            df._filed = keep(df, "filed")
        return df._filed


def located(df: DataFrame) -> DataFrame:
    """``df`` with ``_cc_file, _cc_row``: where each row lies in the files behind it.

    The pair names one row even where ids repeat or are null. What is joined by it
    must come from the same files, so pass frames through :func:`filed` first.
    """
    source = filed(df)
    meta = source.metadataColumn("_metadata")
    return source.withColumns({"_cc_file": F.xxhash64(meta["file_path"]), "_cc_row": meta["row_index"]})


def small_batches(df: DataFrame, size: str = "8m") -> None:
    """Let Arrow batches of long texts be small, unless the session sets their size.

    A worker holds a batch, and what it makes of it, at a time; so does the executor, outside its heap.
    """
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(name) in ("67108864", "67108864b", "64m"):  # Spark's own value
        conf.set(name, size)


def quoted(columns: list[str]) -> list[Column]:
    """Columns by names that may hold dots or backticks."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in columns]


def positions(df: DataFrame, group: list[str], order: list[str], size: str | None = None) -> DataFrame:
    """``df`` with ``_pos``, each row's place from 0 in its group, and the sum of ``size`` before it, ``_before``.

    ``group`` may be empty; its columns hold no nulls. ``order`` should not tie.
    A group is cut into the pieces of a range partitioning and each piece counts on
    its own; only the pieces' totals are added up, so one group may hold all rows.
    """
    cut = df.repartitionByRange(*group, *order).withColumn("_piece", F.spark_partition_id())
    cut = keep(cut, "pieces")  # the pieces must be the same for the totals and for the rows
    amount = F.col(size) if size else F.lit(0).cast("long")
    before = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(*group, "_piece")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(amount).alias("_s"))
        .select(
            *group,
            "_piece",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
            F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"),
        )
    )
    inside = Window.partitionBy(*group, "_piece").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.withColumns(
        {"_i": F.row_number().over(inside) - 1, "_s": F.coalesce(F.sum(amount).over(earlier), F.lit(0))}
    )
    return rows.join(starts, [*group, "_piece"]).select(
        *df.columns,
        (F.col("_n0") + F.col("_i")).cast("long").alias("_pos"),
        *([(F.col("_s0") + F.col("_s")).cast("long").alias("_before")] if size else []),
    )


def sampled(df: DataFrame, bound: int, *key: str, seed: int = 7) -> DataFrame:
    """About ``bound`` rows chosen by a hash of ``key``, all rows if there are no more; for fitting only."""
    total = df.count()
    share = min(1.0, bound / total) if total else 1.0
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1_000_000)) < int(share * 1_000_000) + 1)


def word_count(text: Column) -> Column:
    """Number of words of a text, null counting as empty."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.translate(marks, " \t\n\x0b\f\r", "")).cast("long")


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of ``data`` in order, as lists from about ``size`` bytes each, however long it is."""
    start, end = 0, len(data)
    while start < end:
        stop = min(start + size, end)
        while stop < end and data[stop] not in b" \t\n\x0b\f\r":
            stop += 1
        yield data[start:stop].split()
        start = stop
