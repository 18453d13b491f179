"""Near-duplicate groups by SimHash fingerprints that differ in few bits.

Candidates come from the pigeonring principle. A fingerprint is cut into
``max_distance + 1`` segments on a ring. If two fingerprints differ in at most
``max_distance`` bits, some segment starts a chain in which the first ``l``
segments together differ in at most ``l - 1`` bits, for each ``l``: none in the
first, at most one in the first two, and so on. The first two conditions are one
join key: the first segment as it is, the second as it is or with one zero bit
set. The longer chains are tested inside the bucket, and only what passes has all
its bits counted.

A bucket returns, instead of its linked pairs, a forest with the same components;
so a dense group gives about as many rows as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustercat.llm.common import located, small_batches, word_blocks
from clustercat.operators.density.components import connected_components
from clustercat.storage import keep

BITS = 64
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SMALL_GROUP = 32


def _shingles(text: bytes, width: int, block: int = 1 << 20) -> Iterator[list[bytes]]:
    """Space-joined word shingles, repeats included, in lists of bounded size."""
    tail: list[bytes] = []
    whole = True
    for words in word_blocks(text.translate(LOWER), block):
        words = tail + words
        if len(words) >= width:
            whole = False
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
            yield [line[a:b] for a, b in zip(starts, ends[width - 1 :].tolist())]
        tail = words[len(words) - width + 1 :] if len(words) >= width else words
    if whole and tail:
        yield [b" ".join(tail)]


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text: a bit is set if over half the shingles' hashes set it."""
    ones, total = np.zeros(BITS, np.int64), 0
    for part in _shingles((text or "").encode(), width):
        values = np.array([xxhash.xxh64_intdigest(s, 42) for s in part], "<u8")
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(part)
    return sum(1 << k for k in np.flatnonzero(2 * ones > total).tolist())


def fingerprints(docs: DataFrame, text: str, columns: list[str], width: int = 3) -> DataFrame:
    """``columns`` and ``fp`` (long holding the unsigned bits) of every row; null text counts as empty."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), width) for t in batch.column(0)], np.uint64)
            columns_out = [*batch.columns[1:], pa.array(values.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns_out, [*batch.schema.names[1:], "fp"])

    small_batches(docs)
    source = docs.select(F.col(text).cast("string").alias("_text"), *columns)
    schema = source.drop("_text").withColumn("fp", F.lit(0).cast("long")).schema
    return source.mapInArrow(convert, schema)


def _widths(distance: int) -> list[int]:
    parts = distance + 1
    return [BITS // parts + (i < BITS % parts) for i in range(parts)]


def _ring(distance: int) -> list[list[int]]:
    """For each starting segment, the masks of its first 1, 2, ... segments along the ring."""
    widths = _widths(distance)
    lows = [sum(widths[:i]) for i in range(len(widths))]
    masks = [((1 << w) - 1) << low for w, low in zip(widths, lows)]
    ring = []
    for i in range(len(widths)):
        chain, total = [], 0
        for step in range(len(widths)):
            total |= masks[(i + step) % len(widths)]
            chain.append(total)
        ring.append(chain)
    return ring


def _linked(x: np.ndarray, start: np.ndarray, ring: np.ndarray, distance: int) -> np.ndarray:
    """Places in ``x`` (differences of pairs) whose chain holds at every length, the whole ring last."""
    alive = np.arange(len(x))
    for step in range(ring.shape[1]):
        budget = min(step, distance)
        alive = alive[np.bitwise_count(x[alive] & ring[start[alive], step]) <= budget]
    return alive


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links but the roots, and its root."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        now = root.copy()
        np.minimum.at(now, u, low)
        np.minimum.at(now, v, low)
        np.minimum.at(now, root[u], low)
        np.minimum.at(now, root[v], low)
        now = now[now]
        if (now == root).all():
            break
        root = now
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _bucket_links(distance: int):
    """Function for ``mapInArrow`` over rows sorted by bucket, home rows first."""
    ring = np.array(_ring(distance), np.uint64)

    def pairs(bucket, start, home, fp) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        sizes = np.diff(np.append(first, len(bucket)))
        ends = np.repeat(first + sizes, sizes)
        place = np.arange(len(bucket))
        small = np.repeat(sizes <= SMALL_GROUP, sizes)
        rows = place[home & small]
        for shift in range(1, SMALL_GROUP):
            rows = rows[rows + shift < ends[rows]]
            if not len(rows):
                break
            x = fp[rows] ^ fp[rows + shift]
            hit = rows[_linked(x, start[rows], ring, distance)]
            yield fp[hit], fp[hit + shift]
        for k in np.flatnonzero(sizes > SMALL_GROUP):
            members = slice(first[k], first[k] + sizes[k])
            values = fp[members]
            homes = values[home[members]]
            for at in range(0, len(homes), 256):
                part = homes[at : at + 256]
                x = (part[:, None] ^ values[None, :]).ravel()
                hit = _linked(x, np.full(len(x), start[first[k]]), ring, distance)
                left, right = part[hit // len(values)], values[hit % len(values)]
                other = left != right
                if other.any():
                    yield _forest(left[other], right[other])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            start = batch.column(0).to_numpy()
            key = batch.column(1).to_numpy()
            block = batch.column(2).to_numpy()
            home = batch.column(3).to_numpy(zero_copy_only=False)
            fp = batch.column(4).to_numpy().view(np.uint64)
            if open_rows is not None:  # the homes of the bucket that the last batch broke off
                start, key, block, home, fp = (np.concatenate(p) for p in zip(open_rows, (start, key, block, home, fp)))
            change = (start[1:] != start[:-1]) | (key[1:] != key[:-1]) | (block[1:] != block[:-1])
            bucket = np.concatenate([[0], np.cumsum(change)])
            found = list(pairs(bucket, start, home, fp))
            last = (bucket == bucket[-1]) & home
            open_rows = [part[last] for part in (start, key, block, home, fp)]
            if found:
                a, b = (np.concatenate(side) for side in zip(*found))
                if len(a):
                    node, root = _forest(a, b)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node.view(np.int64)), pa.array(root.view(np.int64))], ["u", "v"]
                    )

    return links


def candidate_buckets(prints: DataFrame, distance: int, block_rows: int = 4096) -> DataFrame:
    """Rows ``start, key, block, home, fp`` of the distinct fingerprints ``fp``, by the first two chain conditions.

    A bucket with more than ``block_rows`` home rows is dealt out to blocks: a
    home row is at home in one block and visits the later ones, visitors go to all.
    """
    widths = _widths(distance)
    lows = [sum(widths[:i]) for i in range(len(widths))]
    parts = len(widths)

    def segment(i: int):
        return F.shiftrightunsigned("fp", lows[i]).bitwiseAND(F.lit((1 << widths[i]) - 1))

    def chain(i: int):
        then = (i + 1) % parts
        flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << j).cast("long") for j in range(widths[then])))
        return F.transform(
            F.filter(flips, lambda bit: segment(then).bitwiseAND(bit) == 0),
            lambda bit: F.struct(
                F.lit(i).alias("start"),
                F.shiftleft(segment(i), widths[then]).bitwiseOR(segment(then)).bitwiseOR(bit).alias("key"),
                (bit == 0).alias("home"),
            ),
        )

    rows = [chain(i) for i in range(parts)]
    every = prints.select("fp", F.explode(F.concat(*rows)).alias("r")).select("r.*", "fp")
    crowded = keep(
        every.filter("home").groupBy("start", "key").count().filter(F.col("count") > block_rows)
        .select("start", "key", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks")),
        "crowded",
    )
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = every.join(crowded, ["start", "key"], "left").withColumn(
        "block",
        F.explode(
            F.when(F.col("blocks").isNull(), F.array(F.lit(0)))
            .when(F.col("home"), F.sequence(own, F.col("blocks") - 1))
            .otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
        ),
    )
    at_home = F.col("home") & (F.col("blocks").isNull() | (F.col("block") == own))
    return dealt.select("start", "key", "block", at_home.alias("home"), "fp")


def components(prints: DataFrame, distance: int = 3, block_rows: int = 4096) -> DataFrame:
    """``fp, comp`` for the distinct ``fp`` that are linked to another; ``comp`` names the component."""
    if not 1 <= distance <= 15:
        raise ValueError("the distance goes from 1 to 15 bits")
    buckets = candidate_buckets(prints.select("fp").distinct(), distance, block_rows)
    sorted_rows = buckets.repartition("start", "key", "block").sortWithinPartitions(
        "start", "key", "block", F.desc("home"), "fp"
    )
    edges = keep(sorted_rows.mapInArrow(_bucket_links(distance), "u long, v long"), "simhash-links")
    return connected_components(edges).select(F.col("node").alias("fp"), "comp")


def simhash_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = 3,
    distance: int = 3,
    block_rows: int = 4096,
) -> DataFrame:
    """One row per row of ``docs``: ``id, fp, component_id, survivor`` and its locator.

    ``component_id`` is the smallest id reachable over links of at most ``distance``
    bits; ``survivor`` marks one row of each component, that with the smallest id
    (null ids last, equal ids by place in the files). Null and empty texts have
    fingerprint zero and link like any other; an empty table gives no rows; repeated rows
    are rows of their own; other columns are ignored. ``component_id`` is null
    only if no row of the component has an id.
    """
    source = located(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")))
    prints = keep(fingerprints(source, "text", ["id", "_cc_file", "_cc_row"], width), "fingerprints")
    key = F.struct(F.col("id").isNull().alias("no_id"), "id", "_cc_file", "_cc_row")
    classes = keep(prints.groupBy("fp").agg(F.min(key).alias("first")), "simhash-classes")
    linked = components(classes, distance, block_rows)
    named = classes.join(linked, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    best = named.groupBy("comp").agg(F.min("first").alias("best"))
    named = keep(named.join(best, "comp").select("fp", "best"), "simhash-components")
    return prints.join(named, "fp").select(
        "id",
        "fp",
        F.col("best.id").alias("component_id"),
        ((F.col("best._cc_file") == F.col("_cc_file")) & (F.col("best._cc_row") == F.col("_cc_row"))).alias("survivor"),
        "_cc_file",
        "_cc_row",
    )


def hex_fingerprint(column: str = "fp"):
    """Sixteen lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(column), BITS // 4, "0"))
