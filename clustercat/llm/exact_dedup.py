"""Exact duplicates by a stream over keyed state that is kept on disk and never expires.

The stream's state holds, for each content digest, the smallest identifier seen,
the locator of that row's text and the number of rows. A hit is not believed
because its digest matches: the full normalised texts are compared, in salted
parts, and rows that differ form groups of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from clustercat.llm.common import SPACES, located
from clustercat.storage import keep, new_path

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    # A store is closed when its task has committed, so only running tasks hold files and memory.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@contextmanager
def _state_on_disk(spark: SparkSession):
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def first_rows(digests: DataFrame) -> DataFrame:
    """State of the deduplication: for each digest its first row and its number of rows.

    ``digests`` (streaming or not) has ``digest, id, _cc_file, _cc_row``. There is no
    watermark: a copy is found however late it comes.
    """
    row = F.struct(F.col("id").isNull().alias("no_id"), "id", "_cc_file", "_cc_row")
    return digests.groupBy("digest").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("copies"))


def run_stream(digests: DataFrame, checkpoint: str) -> StreamingQuery:
    """Feed all that the streaming frame ``digests`` has now into the state below ``checkpoint``.

    Run again with the same checkpoint it reads only what is new.
    """
    with _state_on_disk(digests.sparkSession):
        query = (
            first_rows(digests)
            .writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return query


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``digest, first, copies`` as the state holds them now."""
    with _state_on_disk(spark):
        state = spark.read.format("statestore").load(checkpoint)
        return keep(
            state.select(
                F.col("key.digest").alias("digest"),
                F.col("value.min").alias("first"),
                F.col("value.count").alias("copies"),
            ),
            "dedup-state",
        )


def _marked(hits: DataFrame, words: int) -> DataFrame:
    """``place, bits``: a hash filter of the hits' digests in at most ``words`` rows of 64 bits, whatever the number of hits."""
    mark = F.xxhash64("digest")
    return hits.groupBy(F.pmod(mark, F.lit(words)).cast("int").alias("place")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pmod(shiftright(xxhash64(digest), 40), 64) as int))")).alias("bits")
    )


def _maybe_hits(texts: DataFrame, hits: DataFrame, words: int) -> DataFrame:
    """``texts`` without those whose digest the filter rules out; none that is a hit is lost.

    The filter has a bounded size, so it is broadcast; with far more hits than bits it lets all rows pass.
    """
    marked = F.broadcast(keep(_marked(hits, words), "hit-filter"))
    bit = F.expr("getbit(bits, cast(pmod(shiftright(xxhash64(digest), 40), 64) as int)) = 1")
    return texts.withColumn("place", F.pmod(F.xxhash64("digest"), F.lit(words)).cast("int")).join(
        marked, "place"
    ).filter(bit).drop("place", "bits")


def exact_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    digest: Callable[[Column], Column] = sha256,
    batch_bytes: int = 16 << 30,
    salt_rows: int = 1024,
    filter_words: int = 1 << 19,
) -> DataFrame:
    """One row per row of ``docs``: ``id, digest, keep_id, group_size, kept`` and its locator.

    Texts are equal if they are the same after :func:`normalised`. Of equal texts
    the row with the smallest id stays (null ids last; of equal ids the first in
    the files). Null texts count as empty; an empty table gives no rows; other columns are
    ignored. ``batch_bytes`` of the digest table enter the state at a time; a group's
    texts are compared with its first one in parts of about ``salt_rows`` rows. Texts that no
    other equals are kept from the shuffle by a filter of ``filter_words`` rows of 64 bits.
    """
    spark = docs.sparkSession
    texts = located(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")))
    texts = texts.withColumn("text", normalised(F.col("text"))).withColumn("digest", digest(F.col("text")))
    rows = keep(texts.drop("text"), "digests")
    stream = (
        spark.readStream.schema(rows.schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(rows._kept_at)
    )
    checkpoint = new_path(spark, "dedup-checkpoint")
    run_stream(stream, checkpoint)
    state = read_state(spark, checkpoint) if not rows.isEmpty() else first_rows(rows)

    # Full comparison of the hits.
    hits = state.filter("copies > 1").select(
        "digest",
        F.col("first._cc_file").alias("at_file"),
        F.col("first._cc_row").alias("at_row"),
        F.ceil(F.col("copies") / salt_rows).cast("int").alias("parts"),
    )
    # There are as many hits as the corpus has groups of copies, so the join is planned as a shuffle at any
    # size; its result is kept so that texts move once.
    found = _maybe_hits(texts, hits, filter_words)
    copies = keep(found.join(hits.hint("shuffle_merge"), "digest"), "copies")
    leads = copies.filter("_cc_file = at_file and _cc_row = at_row").select(
        "digest", F.col("text").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    copies = copies.withColumn("part", F.pmod(F.xxhash64("_cc_file", "_cc_row"), "parts").cast("int"))
    different = keep(
        copies.join(leads, ["digest", "part"]).filter("text <> lead").select("digest", "text", "id", "_cc_file", "_cc_row"),
        "same-digest-other-text",
    )
    others = first_rows(different.withColumn("digest", F.struct("digest", "text"))).select(
        F.col("digest.digest").alias("digest"), F.col("digest.text").alias("text"),
        F.col("first").alias("other"), F.col("copies").alias("other_copies"),
    )
    placed = different.join(others, ["digest", "text"]).select("_cc_file", "_cc_row", "other", "other_copies")
    lost = different.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
    joined = (
        rows.join(state, "digest")
        .join(lost, "digest", "left")
        .join(placed, ["_cc_file", "_cc_row"], "left")
        .withColumn("lead", F.coalesce("other", "first"))
    )
    return joined.select(
        "id",
        "digest",
        F.col("lead.id").alias("keep_id"),
        F.coalesce("other_copies", F.col("copies") - F.coalesce("lost", F.lit(0))).alias("group_size"),
        ((F.col("lead._cc_file") == F.col("_cc_file")) & (F.col("lead._cc_row") == F.col("_cc_row"))).alias("kept"),
        "_cc_file",
        "_cc_row",
    )
