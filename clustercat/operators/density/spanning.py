"""Exact minimum spanning tree of the mutual reachability graph.

The graph is complete, so its edges are never listed. Each cell makes the least tree of its own points.
An edge of it that is no longer than the way out of the cell, for one of the parts it joins, belongs to the whole
tree; so most merges need no round at all. The other edges of a cell's tree are the only ones inside the cell that may yet be needed.
Each round every component but the largest finds its shortest edge to another one: among those edges, which also tells how far a better one
could be, then in the few cells within that distance. A cell whose points all belong to the asking component is not
visited. A cell's points travel as one row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustercat.functions.geometry import distances, matrix, norm, norm_of
from clustercat.operators.density.cells import Cells, descend_blocks, visit
from clustercat.operators.density.components import roots
from clustercat.storage import drop_kept, keep, unbroadcast

# Distances that exist at a time, few enough for a core's cache.
BLOCK_PAIRS = 1 << 15
PICK = "comp bigint, w double, to bigint, a bigint, b bigint"
# A row a cell: its points in the order of their ids, with the place of their fragment; the fragments, named by their
# smallest point; the edges made, and the others, between fragments u and v.
FOREST = (
    "cell bigint, ids array<bigint>, features array<double>, core array<double>, place array<int>, "
    "fragment array<bigint>, held array<bigint>, core_lo array<double>, core_hi array<double>, "
    "made array<struct<a: bigint, b: bigint, w: double>>, left array<struct<u: bigint, v: bigint, w: double, a: bigint, b: bigint>>"
)


def _reach(a, a_core, b, b_core, metric) -> np.ndarray:
    """Mutual reachability of two blocks of points."""
    return np.maximum(np.maximum(distances(a, b, metric), a_core[:, None]), b_core[None, :])


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = i = parent[parent[i]]
    return i


def _cell_tree(x: np.ndarray, core: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends and weights of a least spanning tree of some points, made by adding the nearest point to a growing set."""
    n = len(x)
    axes, rows = np.ascontiguousarray(x.T), np.arange(n)
    outside, core_left = rows[1:].copy(), core[1:].copy()
    axes = axes[:, 1:].copy()
    best, by = np.full(n - 1, np.inf), np.zeros(n - 1, dtype="int64")
    a, b, w = np.zeros(n - 1, dtype="int64"), np.zeros(n - 1, dtype="int64"), np.zeros(n - 1)
    at, last = 0, n - 1
    for step in range(n - 1):
        d = norm_of(axes[:, :last] - x[at][:, None], metric)
        np.maximum(d, core_left[:last], out=d)
        np.maximum(d, core[at], out=d)
        closer = d < best[:last]
        np.copyto(best[:last], d, where=closer)
        np.copyto(by[:last], at, where=closer)
        i = int(best[:last].argmin())
        a[step], b[step], w[step] = by[i], outside[i], best[i]
        at = int(outside[i])
        last -= 1  # the last one outside takes the place of the one that leaves
        outside[i], core_left[i], best[i], by[i] = outside[last], core_left[last], best[last], by[last]
        axes[:, i] = axes[:, last]
    return a, b, w


def _merge_in_cell(pdf: pd.DataFrame, metric: str) -> pd.DataFrame:
    """Merge the points of one cell to fragments while nothing outside can be nearer, as one row of ``FOREST``.

    The edges of the cell's tree come lightest first. What has been left once is longer than the way out of both its parts,
    and so is every later edge of a part it touches, unless the other part has a longer way out.
    """
    pdf = pdf.sort_values("point_id")
    x, core, ids = matrix(pdf["features"]), pdf["core"].to_numpy(), pdf["point_id"].to_numpy()
    parent = np.arange(len(pdf)).tolist()
    safe = np.maximum(core, pdf["clear"].to_numpy()).tolist()
    a, b, w = _cell_tree(x, core, metric)
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a, w))
    made = np.zeros(len(w), dtype=bool)
    for at, i, j, weight in zip(order.tolist(), a[order].tolist(), b[order].tolist(), w[order].tolist()):
        i, j = _find(parent, i), _find(parent, j)
        if weight < np.inf and (weight <= safe[i] or weight <= safe[j]):
            i, j = min(i, j), max(i, j)
            parent[j], safe[i] = i, min(safe[i], safe[j])
            made[at] = True
    part = np.array([_find(parent, i) for i in range(len(parent))])
    names, place = np.unique(part, return_inverse=True)
    lo, hi = np.full(len(names), np.inf), np.full(len(names), -np.inf)
    np.minimum.at(lo, place, core)
    np.maximum.at(hi, place, core)
    left = ~made & np.isfinite(w)
    edges = [{"a": i, "b": j, "w": d} for i, j, d in zip(ids[a[made]].tolist(), ids[b[made]].tolist(), w[made].tolist())]
    others = [
        {"u": u, "v": v, "w": d, "a": i, "b": j}
        for u, v, d, i, j in zip(*(c.tolist() for c in (ids[part[a[left]]], ids[part[b[left]]], w[left], ids[a[left]], ids[b[left]])))
    ]
    held = np.bincount(place, minlength=len(names))
    row = [pdf["cell"].iloc[0], ids, x.ravel(), core, place.astype("int32"), ids[names], held, lo, hi, edges, others]
    return pd.DataFrame(
        [row], columns=["cell", "ids", "features", "core", "place", "fragment", "held", "core_lo", "core_hi", "made", "left"]
    )


def _shortest(
    x: np.ndarray, core: np.ndarray, a: np.ndarray, y: np.ndarray, y_core: np.ndarray, b: np.ndarray, best: float, metric: str
) -> tuple[float, int, int]:
    """The least mutual reachability below ``best`` of a row of ``x`` and one of ``y``, by ids ``a`` and ``b`` where equal; or rows -1.

    Only what lies in the box within ``best`` around the other side is looked at. An edge is never shorter than either end's
    core distance, so rows come in the order of theirs, and those that can't improve on the best so far are left out.
    """
    reach, edge = best * (1 + 1e-9), (-1, -1)
    held = np.flatnonzero((y_core < best) & ((y >= np.fmin.reduce(x) - reach) & (y <= np.fmax.reduce(x) + reach)).all(axis=1))
    if not len(held):
        return best, *edge
    near = (x >= np.fmin.reduce(y[held]) - reach) & (x <= np.fmax.reduce(y[held]) + reach)
    asked = np.flatnonzero((core < best) & near.all(axis=1))
    asked, held = asked[np.argsort(core[asked], kind="stable")], held[np.argsort(y_core[held], kind="stable")]
    start = 0
    while start < len(asked) and core[asked[start]] < best:
        width = int(np.searchsorted(y_core[held], best))
        if not width:
            break
        rows, to = asked[start : start + max(1, BLOCK_PAIRS // width)], held[:width]
        start += len(rows)
        w = _reach(x[rows], core[rows], y[to], y_core[to], metric)
        least = np.nanmin(w, initial=np.inf)
        if least < best:
            i, j = np.nonzero(w == least)
            first = np.lexsort((b[to[j]], a[rows[i]]))[0]
            best, edge = float(least), (int(rows[i[first]]), int(to[j[first]]))
    return best, *edge


def _picks(asked: pd.DataFrame, found: pd.DataFrame, metric: str) -> pd.DataFrame:
    """The shortest edge from each component of the blocks ``asked`` to a point of another one in the block ``found``.

    Edges as long as the bound a component came with are left out.
    """
    core, a, comp, bound = (np.concatenate(asked[c].tolist()) for c in ("core", "ids", "comp", "radius"))
    x = np.concatenate(asked["features"].tolist()).reshape(len(core), -1)
    right = found.iloc[0]
    y, y_core, b = right["features"].reshape(len(right["ids"]), -1), right["core"], right["ids"]
    other = right["comp"][right["place"]]
    order = np.argsort(comp, kind="stable")
    picks = []
    for rows in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
        name = comp[rows[0]]
        foreign = np.flatnonzero(other != name)
        best, i, j = _shortest(x[rows], core[rows], a[rows], y[foreign], y_core[foreign], b[foreign], bound[rows[0]], metric)
        if i >= 0:
            i, j = rows[i], foreign[j]
            picks.append((name, best, other[j], min(a[i], b[j]), max(a[i], b[j])))
    return pd.DataFrame(picks, columns=["comp", "w", "to", "a", "b"]).astype({"w": "float64"})


FACTS = ["comp_lo", "comp_hi", "core_lo", "core_hi"]


def _node_facts(names: DataFrame, cells: Cells) -> list[DataFrame]:
    """The nodes of each level with the least and greatest component and core distance they hold."""

    def agg(low: str, high: str, core_low: str, core_high: str) -> list:
        sides = zip(FACTS, (F.min, F.max, F.min, F.max), (low, high, core_low, core_high))
        return [f(c).alias(name) for name, f, c in sides]

    facts = names.groupBy(F.col("cell").alias("child")).agg(*agg("comp", "comp", "core_lo", "core_hi"))
    levels: list[DataFrame] = []
    for nodes in reversed(cells.nodes):
        levels.insert(0, keep(nodes.join(facts, "child"), "facts"))
        facts = levels[0].groupBy(F.col("cell").alias("child")).agg(*agg(*FACTS))
    return levels


def _far_corners(nodes: pd.DataFrame, metric: str) -> pd.DataFrame:
    """An upper bound for each component that fills a whole node: the nearest far corner of a sibling with another.

    A component that fills a node has, at that level or one above, a sibling that it does not fill, so some
    level bounds it; a node's siblings are at most its parent's children.
    """
    comp, full = nodes["comp_lo"].to_numpy(), (nodes["comp_lo"] == nodes["comp_hi"]).to_numpy()
    lo, hi, core = matrix(nodes["lo"]), matrix(nodes["hi"]), nodes["core_hi"].to_numpy()
    at = np.flatnonzero(full)
    gaps = (
        np.maximum(np.subtract.outer(-lo[at, j], -hi[:, j]), np.subtract.outer(hi[at, j], lo[:, j])) for j in range(lo.shape[1])
    )
    far = np.maximum(norm(gaps, metric), np.maximum(core[at, None], core[None, :]))
    far[full[None, :] & (comp[at, None] == comp[None, :])] = np.inf
    # Just above, because the search looks for shorter edges only.
    out = pd.DataFrame({"comp": comp[at], "bound": far.min(axis=1, initial=np.inf) * (1 + 1e-9)})
    return out[np.isfinite(out["bound"])].groupby("comp", as_index=False).min()


def _round_picks(
    blocks: DataFrame, names: DataFrame, left: DataFrame, cells: Cells, levels: list[DataFrame], largest: int
) -> DataFrame:
    """The shortest way out of every component but the ``largest``: ``comp, w, to, a, b``."""
    metric = cells.metric
    asks = ~F.col("comp").eqNullSafe(F.lit(largest))
    least = F.min(F.struct("w", "to", "a", "b")).alias("p")
    ways = left.select(F.col("u").alias("comp"), "w", F.col("v").alias("to"), "a", "b")
    ways = ways.unionByName(left.select(F.col("v").alias("comp"), "w", F.col("u").alias("to"), "a", "b"))
    near = keep(ways.filter(asks).groupBy("comp").agg(least).select("comp", "p.*"), "picks")
    bounds = near.select("comp", F.col("w").alias("bound"))
    for nodes in levels:
        corners = nodes.groupBy("cell").applyInPandas(lambda pdf: _far_corners(pdf, metric), "comp bigint, bound double")
        bounds = bounds.unionByName(corners)
    bounds = bounds.filter(asks).groupBy("comp").agg(F.min("bound").alias("bound"))
    # The fragments' components and bounds, a row a cell.
    known = names.join(unbroadcast(bounds), "comp", "left").groupBy("cell").agg(
        F.array_sort(F.collect_list(F.struct("pos", "comp", F.coalesce("bound", F.lit(0.0)).alias("bound")))).alias("known")
    )
    known = keep(known.select("cell", F.col("known.comp").alias("comp"), F.col("known.bound").alias("bound")), "known")
    labelled = blocks.join(unbroadcast(known), "cell")

    def ask(batches):
        for pdf in batches:
            out = []
            for own, ids, features, core, place, comp, bound in pdf.itertuples(index=False):
                bound = bound[place]
                some = np.flatnonzero(core < bound)
                if len(some):
                    x = features.reshape(len(ids), -1)[some].ravel()
                    out.append([own, ids[some], x, core[some], comp[place[some]], bound[some]])
            yield pd.DataFrame(out, columns=["own", "ids", "features", "core", "comp", "radius"])

    asked = labelled.select("cell", "ids", "features", "core", "place", "comp", "bound").mapInPandas(
        ask, "own bigint, ids array<bigint>, features array<double>, core array<double>, comp array<bigint>, radius array<double>"
    )

    def useful(comp: np.ndarray, radius: np.ndarray, nodes: pd.DataFrame) -> np.ndarray:
        """Pairs whose node holds another component and a core distance below the bound."""
        ours = (nodes["comp_lo"].to_numpy() == comp) & (nodes["comp_hi"].to_numpy() == comp)
        return ~ours & (nodes["core_lo"].to_numpy() < radius)

    queries = descend_blocks(asked, cells, levels, useful)
    held = labelled.drop("bound")
    far = visit(queries, held, lambda asked, found: _picks(asked, found, metric), PICK, by="own", rows=F.size("ids"))
    picks = keep(near.unionByName(far).groupBy("comp").agg(least).select("comp", "p.*"), "picks")
    drop_kept(near)
    drop_kept(known)
    return picks


def min_span_tree(core: DataFrame, cells: Cells) -> DataFrame:
    """Edges ``a, b, w`` of a minimum spanning tree; ``core`` has ``clear`` and ``core`` per point.

    The points with the fragments they form inside their cells are written once. A round writes only
    the names of the fragments, each with the component it has come to belong to, and the edges left between them.
    """
    metric = cells.metric
    slim = core.select("point_id", "cell", "features", "core", "clear")
    forest = keep(slim.groupBy("cell").applyInPandas(lambda pdf: _merge_in_cell(pdf, metric), FOREST), "forest")
    edges = forest.select(F.inline("made"))
    if cells.depth == 0:
        return edges
    parts = [keep(edges, "edges")]
    blocks = forest.select("cell", "ids", "features", "core", "place")
    left = keep(forest.select(F.inline("left")), "left")
    names = forest.select("cell", F.posexplode(F.arrays_zip("fragment", "held", "core_lo", "core_hi")).alias("pos", "f"))
    names = keep(names.select("cell", "pos", "f.held", "f.core_lo", "f.core_hi", F.col("f.fragment").alias("comp")), "names")

    def largest_two() -> list:
        sizes = names.groupBy("comp").agg(F.sum("held").alias("held"))
        return sizes.orderBy(F.desc("held"), "comp").limit(2).collect()

    while len(top := largest_two()) == 2:
        levels = _node_facts(names, cells)
        # The largest component looks for no way out, which would be most of the work: the others' lead to it.
        picks = _round_picks(blocks, names, left, cells, levels, top[0]["comp"])
        # Hook on if the other's own way out is shorter, or equally long and its
        # name smaller, or if it has not looked: no chain of such hooks can return to where it began.
        other = picks.select(F.col("comp").alias("to"), F.col("w").alias("other_w"))
        falls = (F.col("w") > F.col("other_w")) | ((F.col("w") == F.col("other_w")) & (F.col("to") < F.col("comp")))
        hooks = keep(picks.join(unbroadcast(other), "to", "left").filter(falls | F.col("other_w").isNull()), "hooks")
        parts.append(hooks.select("a", "b", "w"))
        ends = roots(hooks.select(F.col("comp").alias("node"), F.col("to").alias("parent")))

        def renamed(df: DataFrame, column: str) -> DataFrame:
            named = unbroadcast(ends.select(F.col("node").alias(column), "root"))
            return df.join(named, column, "left").withColumn(column, F.coalesce("root", column)).drop("root")

        merged = keep(renamed(names, "comp"), "names")
        rest = keep(renamed(renamed(left, "u"), "v").filter("u <> v").select(*left.columns), "left")
        for old in [names, left, *levels]:
            drop_kept(old)
        names, left = merged, rest
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
