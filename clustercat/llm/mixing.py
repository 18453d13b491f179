"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are put in a seeded order and read round and round; block ``k``
of a source is words ``k * block`` up to ``(k + 1) * block`` of that reading. Slots
``t = 0, 1, 2, ...`` take the van der Corput points, which cumulative weights map to
sources; a slot's rank among its source's slots is the block that it plays. Any
stretch of the schedule thus holds the sources close to their weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clustercat.llm.common import filed, located, positions, quoted, word_count
from clustercat.storage import keep

WEIGHTS = (5, 2, 1)
POINT_BITS = 48


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """``has_source, source, source_id, source_size, weight, target`` from rows ``source, size``.

    Sources come by code point, null last, and weigh ``weights`` in turn. The targets
    sum to ``share`` times all sizes, split by weight; none is above ``repeats`` times
    its source's size, and what that leaves over is shared out again by weight.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sums = sums.withColumn("no_source", F.col("source").isNull().cast("int"))
    ranked = positions(sums, [], ["no_source", "source"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_pos") % len(weights) + 1).cast("int"))
    table = keep(
        ranked.select(
            "source", F.col("_pos").alias("source_id"), "source_size", weight.cast("double").alias("weight"),
            (F.col("source_size") * float(repeats)).alias("most"),
        ),
        "sources",
    )
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:  # each pass caps at least one source more, or is the last
        full = F.col("most") <= F.col("weight") * level
        now, fixed, rest = table.agg(
            F.count_if(full),
            F.sum(F.when(full, F.col("most")).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
        ).first()
        if now == capped or not rest:
            break
        capped, level = now, (share * total - fixed) / rest
    return table.withColumn("target", F.least("most", F.col("weight") * level)).drop("most")


def _point(slot: Column) -> Column:
    """Van der Corput point of a slot number: its binary digits mirrored at the point."""
    return F.conv(F.reverse(F.lpad(F.bin(slot), POINT_BITS, "0")), 2, 10).cast("double") / float(1 << POINT_BITS)


def slot_schedule(sources: DataFrame, block: int) -> DataFrame:
    """``slot, source_id, block_no``: the order in which all blocks that the targets ask for are played.

    A source gets exactly the blocks of its target: slots beyond are left out, and the few
    that the points fall short of close the schedule.
    """
    spark = sources.sparkSession
    need = F.ceil(F.floor("target") / block).cast("long")
    wanted = keep(sources.withColumn("need", need).filter("need > 0").select("source_id", "target", "need"), "wanted")
    slots, count, whole = wanted.agg(F.sum("need"), F.count(F.lit(1)), F.sum("target")).first()
    if not slots:
        return spark.createDataFrame([], "slot long, source_id long, block_no long")
    # Each source owns an interval of [0, 1); a grid turns the search for it into an equal join.
    cells = max(1024, 4 * count)
    share = positions(
        wanted.withColumn("part", F.round(F.col("target") / whole * float(1 << POINT_BITS)).cast("long")),
        [], ["source_id"], "part",
    ).select(
        "source_id", "need",
        (F.col("_before") / float(1 << POINT_BITS)).alias("low"),
        ((F.col("_before") + F.col("part")) / float(1 << POINT_BITS)).alias("high"),
    )
    first, last = F.floor(F.col("low") * cells), F.floor(F.col("high") * cells)
    grid = share.withColumn("cell", F.explode(F.sequence(first, last)))
    points = spark.range(slots).select(F.col("id").alias("slot"), _point(F.col("id")).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * cells))
    drawn = points.join(grid, "cell").filter("low <= u and u < high").select("source_id", "slot", "need")
    ranked = keep(positions(drawn, ["source_id"], ["slot"]), "slots")
    played = ranked.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    closing = (
        wanted.join(played, "source_id", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .filter("n < need")
        .select("source_id", F.explode(F.sequence("n", F.col("need") - 1)).alias("block_no"))
    )
    closing = positions(closing, [], ["block_no", "source_id"])
    closing = closing.select((F.col("_pos") + slots).alias("slot"), "source_id", "block_no")
    drawn = ranked.filter("_pos < need").select("slot", "source_id", F.col("_pos").alias("block_no"))
    return drawn.unionByName(closing)


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple = WEIGHTS,
    share: float = 1.5,
    repeats: int = 2,
    block: int = 2048,
    seed: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """The sizes and targets of all documents, and the schedule of the pieces that the mix plays.

    Sizes: ``id, size, source_size, target`` and the locator, one row per row of ``docs``.
    Pieces: ``slot, source_id, block_no, epoch, from_word, words`` and the locator, where ``from_word``
    counts inside the document and ``epoch`` is the round of its source. A source's pieces hold
    as many words as its target's whole part.

    Null and empty texts have size 0 and are never played; a null source is one source, last in order;
    repeated rows and ids are rows of their own; other columns are ignored; an empty table gives no rows.
    """
    rows = located(
        filed(docs).select(
            F.col(id_column).alias("id"), F.col(source_column).cast("string").alias("source"),
            word_count(F.col(text_column)).alias("size"),
        )
    )
    rows = keep(rows, "sizes")
    sources = keep(source_targets(rows, weights, share, repeats), "targets")
    rows = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).select(
        "id", "_cc_file", "_cc_row", "size", "source_id", "source_size", "target"
    )
    shuffled = rows.filter("size > 0").withColumn("mixed", F.xxhash64(F.lit(seed), "id"))
    # The locator only parts rows of one id and size, so the mix doesn't depend on where the files lie.
    read = positions(shuffled, ["source_id"], ["mixed", "id", "size", "_cc_file", "_cc_row"], "size")
    quota = F.floor("target")
    rounds = F.ceil(quota / F.col("source_size")).cast("long")
    turns = (
        read.filter(quota > 0)
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), rounds - 1)))
        .withColumn("start", F.col("epoch") * F.col("source_size") + F.col("_before"))
        .withColumn("stop", F.least(F.col("start") + F.col("size"), quota))
        .filter("stop > start")
    )
    first, last = F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block)
    pieces = (
        turns.withColumn("block_no", F.explode(F.sequence(first, last)))
        .withColumn("lo", F.greatest("start", F.col("block_no") * block))
        .withColumn("hi", F.least("stop", (F.col("block_no") + 1) * block))
        .select(
            "source_id", "block_no", "epoch", "_cc_file", "_cc_row",
            (F.col("lo") - F.col("start")).alias("from_word"), (F.col("hi") - F.col("lo")).alias("words"),
        )
    )
    schedule = slot_schedule(sources, block).join(pieces, ["source_id", "block_no"])
    return rows.select("id", "_cc_file", "_cc_row", "size", "source_size", "target"), schedule


def taken_words(rows: DataFrame, schedule: DataFrame) -> DataFrame:
    """``rows`` with ``taken``: the words that the schedule plays of each, repeats counted."""
    played = schedule.groupBy("_cc_file", "_cc_row").agg(F.sum("words").alias("taken"))
    return rows.join(played, ["_cc_file", "_cc_row"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


def mixed_documents(docs: DataFrame, schedule: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that the schedule plays, once for each round in which it does.

    A document that the end of its source's target cuts is its first words, joined by one space.
    """
    rounds = schedule.groupBy("_cc_file", "_cc_row", "epoch").agg(F.sum("words").alias("_cc_words"))
    rounds = rounds.select("_cc_file", "_cc_row", "_cc_words")
    source = located(filed(docs))
    # There are about as many rounds as documents, so the join is planned as a shuffle at any size.
    joined = source.join(rounds.hint("shuffle_merge"), ["_cc_file", "_cc_row"])
    words = F.filter(F.split(F.col(text_column), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.slice(words, 1, F.col("_cc_words").cast("int")), " ")
    text = F.when(F.col("_cc_words") < word_count(F.col(text_column)), cut).otherwise(F.col(text_column))
    return joined.withColumn(text_column, text).select(*quoted(docs.columns))
