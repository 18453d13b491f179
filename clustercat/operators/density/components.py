"""Following pointers to their roots, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clustercat.storage import drop_kept, keep, unbroadcast

BLOCK_EDGES = 200_000


def roots(pointers: DataFrame) -> DataFrame:
    """``node, root``: where each pointer ``node -> parent`` ends, by pointer jumping.

    The pointers may not form a cycle. Each pass follows four times as far.
    """
    now = keep(pointers.select("node", F.col("parent").alias("root")), "pointers")
    while True:
        then = now
        for _ in range(3):
            ahead = now.select(F.col("node").alias("root"), F.col("root").alias("ahead"))
            then = then.select("node", "root").join(unbroadcast(ahead), "root", "left").select(
                "node", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moving")
            )
        then = keep(then, "pointers")
        drop_kept(now)
        if then.filter("moving").isEmpty():
            return then.select("node", "root")
        now = then


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for each node of the edges ``u, v``; ``comp`` is the smallest node.

    Every node points at its smallest neighbour, pointers are followed, edges are
    rewritten to their ends and merged; the number of edges falls at each round.
    Nodes may be of any ordered type.
    """
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    pairs = keep(edges.filter("u <> v").select("u", "v").distinct(), "pairs")
    found = None
    while not pairs.isEmpty():
        both = pairs.union(pairs.select("v", "u"))
        lower = both.groupBy("u").agg(F.min("v").alias("parent")).filter("parent < u")
        step = roots(lower.withColumnRenamed("u", "node"))
        if found is None:
            found = step
        else:
            moved = step.select(F.col("node").alias("root"), F.col("root").alias("to"))
            found = keep(
                found.join(unbroadcast(moved), "root", "left")
                .select("node", F.coalesce("to", "root").alias("root"))
                .unionByName(step),
                "components",
            )
        rest = pairs
        for end in ("u", "v"):
            moved = step.select(F.col("node").alias(end), F.col("root").alias("to"))
            rest = rest.join(unbroadcast(moved), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        rest = keep(rest.filter("u <> v").select("u", "v").distinct(), "pairs")
        drop_kept(pairs)
        pairs = rest
    if found is None:
        return nodes.withColumn("comp", F.col("node"))
    return nodes.join(unbroadcast(found), "node", "left").select("node", F.coalesce("root", "node").alias("comp"))


def _labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``label`` with the parts that the edges ``u, v`` join under the smaller label; every label is its own."""
    while True:
        a, b = label[u], label[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low != high
        if not apart.any():
            return label
        u, v = u[apart], v[apart]
        label = label.copy()
        np.minimum.at(label, high[apart], low[apart])
        while not np.array_equal(label, label[label]):
            label = label[label]


def _stars(cuts: list[float]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``cut, node, star`` for blocks of the edges as they are read: the smallest node that the block joins each to."""

    def joined(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = np.concatenate([p["w"].to_numpy() for p in parts])
        ends = np.concatenate([p[c].to_numpy() for c in "ab" for p in parts])
        ids, at = np.unique(ends, return_inverse=True)
        a, b = at[: len(w)], at[len(w) :]
        label, below = np.arange(len(ids)), -np.inf
        for cut in cuts:
            added = (w > below) & (w <= cut) if below > -np.inf else w <= cut
            label, below = _labels(label, a[added], b[added]), cut
            yield pd.DataFrame({"cut": cut, "node": ids, "star": ids[label]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) >= BLOCK_EDGES:
                yield from joined(held)
                held = []
        if sum(map(len, held)):
            yield from joined(held)

    return run


def components_at(edges: DataFrame, cuts: float | Iterable[float]) -> DataFrame:
    """Flat components ``row_id, component`` when edges ``a, b, w`` up to a cut are kept.

    For several cuts the result has ``cut`` too. All cuts share one pass: blocks of the edges, in the order in which they are
    stored, are joined first, each in its task. Only nodes of several blocks meet in the search for components after that, so it is
    small where neighbouring edges are stored together. A row all of whose edges are longer is a component of its own.
    """
    single = isinstance(cuts, (int, float))
    wanted = sorted({float(c) for c in ([cuts] if single else cuts)})
    ends = edges.select(F.col("a").alias("id")).union(edges.select("b"))
    kind = ends.schema["id"].dataType
    whole = F.col("a").isNotNull() & F.col("b").isNotNull()
    typed = edges.filter(whole).select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), F.col("w").cast("double").alias("w"))
    schema = StructType().add("cut", "double").add("node", kind).add("star", kind)
    stars = typed.mapInPandas(_stars(wanted), schema)
    # An edge without one of its ends joins nothing.
    lone = edges.filter(~whole).select(F.explode(F.array("a", "b")).alias("node"))
    lone = lone.select(F.explode(F.array(*map(F.lit, wanted))).alias("cut"), F.col("node").cast(kind).alias("node")) if wanted else None
    stars = stars if lone is None else stars.unionByName(lone.withColumn("star", F.col("node")))
    stars = keep(stars, "stars")
    met = stars.groupBy("cut", "node").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    links = stars.filter("node <> star").join(unbroadcast(met), ["cut", "node"], "left_semi")
    links = keep(links.select(F.struct("cut", "node").alias("u"), F.struct("cut", F.col("star").alias("node")).alias("v")), "links")
    found = connected_components(links).select("node.cut", F.col("node.node").alias("star"), F.col("comp.node").alias("component"))
    every = stars.join(unbroadcast(found), ["cut", "star"], "left").groupBy("cut", F.col("node").alias("row_id"))
    every = keep(every.agg(F.min(F.coalesce("component", "star")).alias("component")), "home")
    return every.drop("cut") if single else every
