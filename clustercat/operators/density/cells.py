"""Split space into cells of few thousand points, and find the cells near a point.

The cells are the leaves of a tree in which a node has up to ``FAN`` children. A level is made at a
time: every node's cuts come from a bounded sample of its points, each in a task of its own, and the points
go to their children. So there is no largest number of cells, and no table of all of them in any
process: cuts and boxes are tables that meet the points node by node. The tight box around what a
node holds tells which children a search has to enter, so a search is exact and goes to few cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clustercat.functions.geometry import matrix, norm
from clustercat.storage import keep

CELL_ROWS = 2048
FAN_BITS = 8
SAMPLE_PER_CHILD = 16
CHUNK_ROWS = 8192
BLOCK = 512


@dataclass
class Cells:
    """Number of bits each level adds to a cell's number, and the nodes of each level.

    ``nodes`` of a level have ``cell`` (the parent), ``child``, ``lo`` and ``hi``.
    """

    metric: str
    bits: list[int]
    nodes: list[DataFrame] = field(default_factory=list)

    @property
    def depth(self) -> int:
        return sum(self.bits)


def _levels(n: int, cell_rows: int) -> list[int]:
    """Bits of each level, about the same, that make cells of at most ``cell_rows`` if they are even."""
    depth = max(0, math.ceil(math.log2(max(n, 1) / cell_rows)))
    levels = math.ceil(depth / FAN_BITS)
    return [depth * (i + 1) // levels - depth * i // levels for i in range(levels)]


def _cut_sample(rows: np.ndarray) -> tuple[int, float]:
    """Axis and value that halve the rows: the widest axis whose median does not tie too much."""
    best = (1.0, 0, np.inf)
    if len(rows) > 1:
        for axis in np.argsort(-(rows.max(axis=0) - rows.min(axis=0)), kind="stable"):
            cut = float(np.partition(rows[:, axis], (len(rows) - 1) // 2)[(len(rows) - 1) // 2])
            uneven = abs(float((rows[:, axis] <= cut).mean()) - 0.5)
            if uneven < best[0]:
                best = (uneven, int(axis), cut)
            if uneven <= 0.25:
                break
    return best[1], best[2]


def _cuts(rows: np.ndarray, bits: int) -> tuple[list[int], list[float]]:
    """Axes and values of a binary tree of cuts, in heap order."""
    axis, cut, groups = [], [], [rows]
    for node in range(2**bits - 1):
        at, value = _cut_sample(groups[node])
        axis.append(at)
        cut.append(value)
        left = groups[node][:, at] <= value
        groups += [groups[node][left], groups[node][~left]]
        groups[node] = None
    return axis, cut


def _split(placed: DataFrame, bits: int, share: float) -> DataFrame:
    """``placed`` in the children of its nodes; ``clear`` is a distance nothing outside the cell comes closer than."""

    def cuts(pdf: pd.DataFrame) -> pd.DataFrame:
        axis, cut = _cuts(matrix(pdf["features"]), bits)
        return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "axis": [axis], "cut": [cut]})

    sample = placed.select("cell", "features").sample(share, seed=1)
    trees = keep(sample.groupBy("cell").applyInPandas(cuts, "cell bigint, axis array<int>, cut array<double>"), "cuts")

    columns = placed.columns

    def locate(points: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        points = points[columns]
        node = np.zeros(len(points), dtype="int64")
        clear = points["clear"].to_numpy()
        if len(tree) and len(points):  # a node of which no point was drawn keeps all in its first child
            axis, cut = np.array(tree["axis"].iloc[0]), np.array(tree["cut"].iloc[0])
            x, rows = matrix(points["features"]), np.arange(len(points))
            for _ in range(bits):
                offset = x[rows, axis[node]] - cut[node]
                clear = np.minimum(clear, np.abs(offset))
                node = 2 * node + 1 + (offset > 0)
            node -= 2**bits - 1
        return points.assign(cell=points["cell"] * 2**bits + node, clear=clear)

    schema = ", ".join(f"`{c}` {t}" for c, t in placed.dtypes)
    return keep(visit(placed, trees, locate, schema), "cells")


def build_cells(points: DataFrame, cell_rows: int = CELL_ROWS, metric: str = "euclidean") -> tuple[DataFrame, Cells]:
    """``points`` with their ``cell`` and ``clear`` distance, and the cells."""
    n = points.count()
    cells = Cells(metric, _levels(n, cell_rows))
    placed = points.withColumns({"cell": F.lit(0).cast("bigint"), "clear": F.lit(float("inf"))})
    done = 0
    for bits in cells.bits:
        done += bits
        placed = _split(placed, bits, min(1.0, SAMPLE_PER_CHILD * 2**done / n))
    if not cells.bits:
        return keep(placed, "cells"), cells
    width = placed.select(F.size("features")).first()[0]
    side = lambda f, column: F.array(*[f(F.col(column)[j]) for j in range(width)])
    boxes = placed.groupBy(F.col("cell").alias("child")).agg(side(F.min, "features").alias("lo"), side(F.max, "features").alias("hi"))
    for bits in reversed(cells.bits):
        nodes = keep(boxes.withColumn("cell", F.shiftright("child", bits)), "nodes")
        cells.nodes.insert(0, nodes)
        boxes = nodes.groupBy(F.col("cell").alias("child")).agg(side(F.min, "lo").alias("lo"), side(F.max, "hi").alias("hi"))
    return placed, cells


def within(x: np.ndarray, radius: np.ndarray, lo: np.ndarray, hi: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (point, box) no farther apart than the point's radius."""
    rows, boxes = [], []
    for start in range(0, len(x), BLOCK):
        part = x[start : start + BLOCK]
        gaps = (
            np.maximum(np.maximum(np.subtract.outer(-part[:, j], -lo[:, j]), np.subtract.outer(part[:, j], hi[:, j])), 0.0)
            for j in range(x.shape[1])
        )
        # The slack covers the rounding of the two distances being compared.
        row, box = np.nonzero(norm(gaps, metric) <= radius[start : start + BLOCK, None] * (1 + 1e-12))
        rows.append(row + start)
        boxes.append(box)
    return np.concatenate(rows), np.concatenate(boxes)


def descend(
    queries: DataFrame,
    cells: Cells,
    levels: list[DataFrame] | None = None,
    useful: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray] | None = None,
) -> DataFrame:
    """Each query once for every cell within its ``radius``, with that ``cell``; its own cell is left out.

    ``queries`` has ``point_id, features, radius, own`` (its cell) and what else a later step needs. ``levels``
    are the cells' nodes with further columns; ``useful(queries, nodes)`` may rule out pairs by them.
    """
    columns = [c for c in queries.columns if c != "cell"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in queries.select(*columns).dtypes), "cell bigint"])
    metric = cells.metric

    def enter(asked: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(nodes):
            return asked[columns].head(0).assign(cell=pd.Series([], dtype="int64"))
        row, at = within(matrix(asked["features"]), asked["radius"].to_numpy(), matrix(nodes["lo"]), matrix(nodes["hi"]), metric)
        sent, held = asked.iloc[row], nodes.iloc[at]
        if useful is not None:
            good = useful(sent, held)
            sent, held = sent[good], held[good]
        return sent[columns].assign(cell=held["child"].to_numpy())

    now = queries.select(*columns).withColumn("cell", F.lit(0).cast("bigint"))
    for nodes in levels or cells.nodes:
        now = visit(now, nodes, enter, schema)
    return now.filter("cell <> own")


def descend_blocks(
    queries: DataFrame, cells: Cells, levels: list[DataFrame], useful: Callable[..., np.ndarray] | None = None
) -> DataFrame:
    """As :func:`descend`, for queries that come as one row a cell, their columns as arrays of the same order.

    ``queries`` has ``own`` and arrays, among them ``features`` (end to end) and ``radius``. ``useful(comp, radius, nodes)``
    may rule out pairs of some queries, of an array ``comp``, and a node each. The result has a row for each cell with those that go there.
    """
    arrays = [c for c in queries.columns if c != "own"]
    others = [c for c in arrays if c != "features"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in queries.select("own", *arrays).dtypes), "cell bigint"])
    metric = cells.metric

    def enter(asked: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {c: [] for c in ("own", *arrays, "cell")}
        lo, hi = matrix(nodes["lo"]), matrix(nodes["hi"])
        for block in asked.itertuples(index=False):
            x = block.features.reshape(len(block.radius), -1)
            first, last, widest = x.min(axis=0), x.max(axis=0), block.radius.max()
            gaps = (np.maximum(np.maximum(lo[:, j] - last[j], first[j] - hi[:, j]), 0.0) for j in range(x.shape[1]))
            some = np.flatnonzero(norm(gaps, metric) <= widest * (1 + 1e-9))
            row, at = within(x, block.radius, lo[some], hi[some], metric)
            at = some[at]
            if useful is not None:
                good = useful(block.comp[row], block.radius[row], nodes.iloc[at])
                row, at = row[good], at[good]
            order = np.argsort(at, kind="stable")
            row, at = row[order], at[order]
            starts = np.flatnonzero(np.r_[True, np.diff(at) != 0]) if len(at) else []
            for start, rows in zip(starts, np.split(row, starts[1:]) if len(at) else []):
                out["own"].append(block.own)
                out["features"].append(x[rows].ravel())
                for c in others:
                    out[c].append(getattr(block, c)[rows])
                out["cell"].append(nodes["child"].iloc[at[start]])
        return pd.DataFrame(out, dtype="object")

    now = queries.select("own", *arrays).withColumn("cell", F.lit(0).cast("bigint"))
    for nodes in levels:
        now = visit(now, nodes, enter, schema, by="own", rows=F.size("radius"))
    return now.filter("cell <> own")


def visit(
    queries: DataFrame, points: DataFrame, task, schema: str, by: str = "point_id", rows: Column | None = None, arrow: bool = False
) -> DataFrame:
    """Run ``task(queries, points)`` once per target cell, on pandas frames or, if asked, on Arrow tables.

    A cell that many queries visit is served by several tasks, each with its
    share of the queries, dealt out ``by`` a column, and a copy of the cell's few points. A row of the queries
    may stand for several ``rows``.
    """
    queries = keep(queries, "queries")
    asked = F.count("*") if rows is None else F.sum(rows)
    chunks = queries.groupBy("cell").agg(F.ceil(asked / CHUNK_ROWS).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64(by), F.col("chunks")).cast("int")
    left = queries.join(chunks, "cell").withColumn("chunk", chunk).drop("chunks")
    right = points.join(chunks, "cell").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    ).drop("chunks")
    both = left.groupBy("cell", "chunk").cogroup(right.groupBy("cell", "chunk"))
    return both.applyInArrow(task, schema) if arrow else both.applyInPandas(task, schema)
