"""Condensed cluster hierarchy from spanning-tree edges.

Edges sorted by weight build the hierarchy bottom up: two parts that are both
large enough make a new cluster, a small part joining a large one falls out of
it there. Where there are many edges, blocks of neighbouring cells are swept first,
each in one task, as far as no edge out of the block has its turn before. What
is left is sorted and cut into segments of bounded size, each swept in one task. A segment must know what the lighter ones have joined, and is told by
halving: components of the lighter half are contracted in the heavier half, then
both halves are cut again; all halves of one size share one job. What a
segment cannot know, the cluster a contracted part belongs to, it leaves open as
a reference, and the references are followed at the end.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clustercat.operators.density.components import connected_components, roots
from clustercat.storage import keep, unbroadcast

SEGMENT_EDGES = 500_000
# kind: "link" small part id -> to; "shed" small part id falls out of a cluster;
# "born" cluster id is made; "child" cluster id ends in a larger one; "top" the
# cluster of the large part id at the segment's end. The cluster meant is `to`,
# or, if `to` is NULL, the one part `open` had before the segment. Blocks are segments
# below 0, and also report "rest" an edge id, to that has to wait, and "part" the part
# `to` that a point id with such edges is in.
EVENTS = "seg int, kind string, id bigint, id_open bigint, to bigint, open bigint, w double, size bigint"


def _sweep(pdf: pd.DataFrame, m: int) -> pd.DataFrame:
    """Join the parts of one segment, lightest edge first, and report what happens.

    An edge that is ``out`` leads from ``a`` out of the segment. From its weight on nothing can be joined to
    that part here, nor to a part that an edge which waits for this leads to.
    """
    pdf = pdf.sort_values(["w", "a", "b"])
    seg = int(pdf["seg"].iloc[0])
    waits: dict[int, float] = {}  # part -> least weight of an edge that has to wait
    ends: list[int] = []
    if "out" in pdf:
        out = pdf["out"].to_numpy(dtype=bool)
        ends = pdf["a"][out].tolist()
        for node, w in zip(ends, pdf["w"][out]):
            waits.setdefault(node, w)
    parent: dict[int, int] = {}
    size: dict[int, int] = {}
    cluster: dict[int, tuple] = {}  # part -> (cluster, open reference)
    events: list[tuple] = []
    for side in ("a", "b"):
        for node, n, large in zip(pdf[side], pdf[f"{side}_size"], pdf[f"{side}_large"]):
            parent[node], size[node] = node, n
            if large:
                cluster[node] = (None, node)

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def born(part, w):
        made = (seg << 32) + len(events)
        events.append(("born", made, None, None, None, w, size[part]))
        cluster[part] = (made, None)

    touched = set()
    inner = pdf[~out] if "out" in pdf else pdf
    for node_a, node_b, w in zip(inner["a"], inner["b"], inner["w"]):
        a, b = find(node_a), find(node_b)
        first = min(waits.get(a, math.inf), waits.get(b, math.inf))
        if first < w:
            waits[a], waits[b] = min(waits.get(a, w), w), min(waits.get(b, w), w)
            events.append(("rest", node_a, None, node_b, None, w, None))
            ends += [node_a, node_b]
            continue
        keep_part, gone = min(a, b), max(a, b)
        parts = [a] if a == b else [a, b]
        held = {p: cluster.pop(p) for p in parts if p in cluster}
        sizes = {p: size[p] for p in parts}
        total = sum(sizes.values())
        parent[gone], size[keep_part] = keep_part, total
        if first < math.inf:
            waits[keep_part] = first
        if len(held) == 1:
            cluster[keep_part] = next(iter(held.values()))
        elif len(held) == 2 or total >= m:
            born(keep_part, w)
        if keep_part in cluster:
            touched.add(keep_part)
            to, reference = cluster[keep_part]
            for p in parts:
                if p not in held:
                    events.append(("shed", p, None, to, reference, w, sizes[p]))
                elif len(held) == 2:
                    events.append(("child", held[p][0], held[p][1], to, reference, w, sizes[p]))
        elif a != b:
            events.append(("link", gone, None, keep_part, None, w, sizes[gone]))
    for part in touched:
        if part in cluster:
            events.append(("top", part, None, *cluster[part], None, size[part]))
    for node in dict.fromkeys(ends):
        part = find(node)
        events.append(("part", node, None, part, None, None, size[part]))
    columns = list(zip(*events)) or [()] * 7
    found = pd.DataFrame({"kind": columns[0]}, dtype="object")
    # By way of floats, identifiers beyond 2^53 would not survive.
    for c, values in zip(("id", "id_open", "to", "open", "w", "size"), columns[1:]):
        found[c] = pd.array(values, dtype="Float64" if c == "w" else "Int64")
    found["w"] = found["w"].astype("float64")
    found.insert(0, "seg", np.int32(seg))
    return found


def _swept_blocks(edges: DataFrame, m: int, segment_edges: int) -> tuple[DataFrame, DataFrame]:
    """Events of the blocks ``a_block, b_block`` of the edges' ends, and the edges left, between the parts made.

    Of equal weights the edges taken here are first, which is an order like any other. A block of more
    edges than a segment may have is not swept.
    """
    inside = F.col("a_block") == F.col("b_block")
    row = ["a", "b", "w", "a_size", "b_size", "a_large", "b_large"]
    rows = edges.filter(inside).select((-1 - F.col("a_block")).cast("int").alias("seg"), *row, F.lit(False).alias("out"))
    for c in "ab":
        end, no = F.col(c), F.lit(False)
        rows = rows.unionByName(
            edges.filter(~inside).select(
                (-1 - F.col(f"{c}_block")).cast("int").alias("seg"), end.alias("a"), end.alias("b"), "w",
                F.col(f"{c}_size").alias("a_size"), F.col(f"{c}_size").alias("b_size"),
                no.alias("a_large"), no.alias("b_large"), no.isNotNull().alias("out"),
            )
        )
    heavy = keep(rows.groupBy("seg").count().filter(F.col("count") > segment_edges).select("seg"), "heavy")
    events = rows.join(heavy, "seg", "left_anti").groupBy("seg").applyInPandas(lambda pdf: _sweep(pdf, m), EVENTS)
    events = keep(events, "block-events")
    unswept = rows.filter(~F.col("out")).join(heavy, "seg", "left_semi").select(*row)
    waiting = events.filter("kind = 'rest'").select(F.col("id").alias("a"), F.col("to").alias("b"), "w")
    rest = edges.filter(~inside).select(*row).unionByName(unswept).unionByName(waiting, allowMissingColumns=True)
    parts = events.filter("kind = 'part'")
    for c in "ab":
        named = parts.select(F.col("id").alias(c), F.col("to").alias("part"), F.col("size").alias("total"))
        rest = rest.join(unbroadcast(named), c, "left").withColumns(
            {
                c: F.coalesce("part", c),
                f"{c}_size": F.coalesce("total", f"{c}_size"),
                f"{c}_large": F.when(F.col("total").isNotNull(), F.col("total") >= m).otherwise(F.col(f"{c}_large")),
            }
        ).drop("part", "total")
    return events.filter("kind not in ('rest', 'part')"), keep(rest.select(*row), "rest")


def _segments(edges: DataFrame, m: int, segment_edges: int) -> tuple[DataFrame, int]:
    """Edges with their segment, lighter segments' components contracted in heavier ones."""
    n = edges.count()
    count = 2 ** max(0, math.ceil(math.log2(max(n, 1) / segment_edges)))
    if count == 1:
        return edges.withColumn("seg", F.lit(0)), 1
    # Equal weights are ordered by their ends, so a common weight spreads over segments too.
    edges = edges.repartitionByRange(count, "w", "a", "b").withColumn("seg", F.spark_partition_id())
    edges = keep(edges, "segments")
    width = count // 2
    while width:
        lighter = F.floor(F.col("seg") / width).cast("int") % 2 == 0
        placed = edges.withColumns({"block": F.floor(F.col("seg") / (2 * width)).cast("int"), "lighter": lighter})
        low = placed.filter("lighter")
        ends = [
            low.select(F.struct("block", F.col(c).alias("id")).alias("node"), F.col(f"{c}_size").alias("size"))
            for c in "ab"
        ]
        sizes = ends[0].union(ends[1]).distinct()
        found = connected_components(
            low.select(F.struct("block", F.col("a").alias("id")).alias("u"), F.struct("block", F.col("b").alias("id")).alias("v"))
        )
        found = keep(found, "parts")
        totals = found.join(unbroadcast(sizes), "node").groupBy("comp").agg(F.sum("size").alias("total"))
        moves = keep(
            found.join(totals, "comp").select(
                F.col("node.block").alias("block"), F.col("node.id").alias("id"), F.col("comp.id").alias("part"), "total"
            ),
            "moves",
        )
        high = placed.filter(~F.col("lighter"))
        for c in "ab":
            high = high.join(unbroadcast(moves.withColumnRenamed("id", c)), ["block", c], "left").withColumns(
                {
                    c: F.coalesce("part", c),
                    f"{c}_size": F.coalesce("total", f"{c}_size"),
                    f"{c}_large": F.when(F.col("total").isNotNull(), F.col("total") >= m).otherwise(F.col(f"{c}_large")),
                }
            ).drop("part", "total")
        edges = keep(low.unionByName(high).drop("block", "lighter"), "segments")
        width //= 2
    return edges, count


def _close_references(events: DataFrame) -> DataFrame:
    """Replace every open reference by the cluster it means."""
    tops = events.filter("kind = 'top'").select(
        F.struct(F.col("id").alias("part"), "seg").alias("node"), F.col("to").alias("cluster"), F.col("open").alias("part")
    )
    asked = events.select(F.col("open").alias("part"), "seg").union(events.select(F.col("id_open"), "seg"))
    asked = asked.filter("part is not null").distinct()
    # The part's state before a segment: its last appearance in a lighter one. A
    # part appears at most once per segment, which bounds the window.
    line = asked.withColumn("is_top", F.lit(False)).unionByName(
        tops.select("node.part", "node.seg").withColumn("is_top", F.lit(True))
    )
    before = Window.partitionBy("part").orderBy("seg").rangeBetween(Window.unboundedPreceding, -1)
    line = line.withColumn("last", F.max(F.when(F.col("is_top"), F.col("seg"))).over(before))
    asked = keep(
        line.filter(~F.col("is_top")).select("part", "seg", F.struct("part", F.col("last").alias("seg")).alias("node")),
        "asked",
    )
    open_tops = tops.filter("cluster is null").select("node", "part", "node.seg")
    pointers = open_tops.join(unbroadcast(asked.withColumnRenamed("node", "parent")), ["part", "seg"]).select("node", "parent")
    ends = roots(pointers)
    known = tops.filter("cluster is not null").select(F.col("node").alias("root"), "cluster")
    meaning = (
        asked.join(unbroadcast(ends), "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
        .join(unbroadcast(known), "root")
        .select("part", "seg", "cluster")
    )
    meaning = keep(meaning, "meaning")
    for reference, target in (("open", "to"), ("id_open", "id")):
        named = meaning.withColumnsRenamed({"part": reference, "cluster": "_c"})
        events = events.join(unbroadcast(named), [reference, "seg"], "left").withColumn(target, F.coalesce("_c", target)).drop("_c")
    return events


def condensed_tree(
    edges: DataFrame, points: DataFrame, min_cluster_size: int, segment_edges: int = SEGMENT_EDGES
) -> tuple[DataFrame, DataFrame]:
    """The hierarchy as two tables.

    Tree: ``parent, child, lambda_val, child_size, is_cluster``, one row per
    point and per cluster below the root; a point stands for all its copies.
    Clusters: ``cluster, parent, birth, born_w, size``, the root with parent NULL and birth 0.

    Lambda is one over the weight; a weight of zero counts as the smallest
    positive one.
    """
    m = int(min_cluster_size)
    large = points.filter(F.col("weight") >= m).select(
        F.col("point_id").alias("a"), F.col("point_id").alias("b"), F.col("core").alias("w")
    )
    # A position with enough copies is a cluster by itself from its core distance on.
    every = keep(edges.select("a", "b", "w").unionByName(large), "edges")
    floor = every.agg(F.min(F.when(F.col("w") > 0, F.col("w"))).alias("w")).first()["w"] or 1.0
    every = every.withColumn("w", F.greatest("w", F.lit(floor)))
    blocks = every.count() / segment_edges if "cell" in points.columns else 0
    if blocks > 1:
        deep, wanted = int(points.agg(F.max("cell")).first()[0]).bit_length(), math.ceil(math.log2(2 * blocks))
        block = F.shiftright("cell", max(0, deep - wanted))
    else:
        block = F.lit(0)
    for c in "ab":
        weights = points.select(F.col("point_id").alias(c), F.col("weight").alias(f"{c}_size"), block.alias(f"{c}_block"))
        every = every.join(unbroadcast(weights), c).withColumn(f"{c}_large", F.lit(False))
    every = keep(every, "sized")
    known = None
    if blocks > 1:
        known, every = _swept_blocks(every, m, segment_edges)
    cut, count = _segments(every.drop("a_block", "b_block"), m, segment_edges)
    events = keep(cut.groupBy("seg").applyInPandas(lambda pdf: _sweep(pdf, m), EVENTS), "events")
    if known is not None or count > 1:
        events = events if known is None else known.unionByName(events)
        events = keep(_close_references(events), "events")

    made = events.filter("kind = 'born'").select(F.col("id").alias("cluster"), F.col("w").alias("made_w"))
    ends = events.filter("kind = 'child'").select(
        F.col("id").alias("cluster"), F.col("to").alias("parent"), F.col("w").alias("born_w"), "size"
    )
    nodes = keep(made.join(unbroadcast(ends), "cluster", "left"), "nodes")
    same = keep(_same_cluster(nodes), "same")

    def merged(df: DataFrame, column: str) -> DataFrame:
        named = same.select(F.col("node").alias(column), "root")
        return df.join(unbroadcast(named), column, "left").withColumn(column, F.coalesce("root", column)).drop("root")

    clusters = merged(nodes.join(unbroadcast(same.select(F.col("node").alias("cluster"))), "cluster", "left_anti"), "parent")
    clusters = keep(clusters.select("cluster", "parent", "born_w", "size"), "clusters")

    links = events.filter("kind = 'link'").select(F.col("id").alias("node"), F.col("to").alias("parent"))
    last = roots(links).withColumnRenamed("node", "point_id")
    falls = events.filter("kind = 'shed'").select(F.col("id").alias("root"), F.col("to").alias("cluster"), "w")
    fallen = (
        points.select("point_id", "weight")
        .join(unbroadcast(last), "point_id", "left")
        .withColumn("root", F.coalesce("root", "point_id"))
        .join(unbroadcast(falls), "root")
        .drop("root")
    )
    # What joined a cluster at the very weight it ended at belongs to its parent.
    late = F.coalesce(F.col("w") >= F.col("born_w"), F.lit(False))
    fallen = keep(
        merged(fallen, "cluster")
        .join(unbroadcast(clusters.drop("size")), "cluster")
        .select("cluster", "point_id", "weight", "w", late.alias("late"), F.when(late, F.col("parent")).otherwise(F.col("cluster")).alias("parent")),
        "fallen",
    )
    left = fallen.filter("late").groupBy("cluster").agg(F.sum("weight").alias("left"))
    clusters = keep(
        clusters.join(unbroadcast(left), "cluster", "left").select(
            "cluster",
            "parent",
            F.when(F.col("parent").isNull(), 0.0).otherwise(1.0 / F.col("born_w")).alias("birth"),
            "born_w",
            F.coalesce(
                F.col("size") - F.coalesce("left", F.lit(0)), points.agg(F.sum("weight")).scalar()
            ).alias("size"),
        ),
        "clusters",
    )
    of_points = fallen.select(
        "parent",
        F.col("point_id").alias("child"),
        (1.0 / F.col("w")).alias("lambda_val"),
        F.col("weight").alias("child_size"),
        F.lit(False).alias("is_cluster"),
    )
    of_clusters = clusters.filter("parent is not null").select(
        "parent",
        F.col("cluster").alias("child"),
        F.col("birth").alias("lambda_val"),
        F.col("size").alias("child_size"),
        F.lit(True).alias("is_cluster"),
    )
    return keep(of_points.unionByName(of_clusters), "tree"), clusters


def _same_cluster(nodes: DataFrame) -> DataFrame:
    """``node, root``: clusters that exist only by the order in which equal weights were taken.

    One that ends at the weight it was made at is its parent. One left without a
    sibling after that has not been split off at all, and is its parent too.
    """
    instant = roots(nodes.filter("made_w = born_w").select(F.col("cluster").alias("node"), "parent"))
    real = nodes.filter("parent is not null and made_w < born_w").select("cluster", F.col("parent").alias("node"))
    real = real.join(unbroadcast(instant), "node", "left").select("cluster", F.coalesce("root", "node").alias("parent"))
    alone = real.groupBy("parent").agg(F.count("*").alias("n"), F.min("cluster").alias("node")).filter("n = 1")
    pointers = instant.select("node", F.col("root").alias("parent")).unionByName(alone.select("node", "parent"))
    return roots(pointers)


def cluster_stability(tree: DataFrame, clusters: DataFrame) -> DataFrame:
    """Clusters with ``stability``: child sizes times how long they stayed; and ``death``, the largest lambda below."""
    births = clusters.select(F.col("cluster").alias("parent"), "birth")
    sums = (
        tree.groupBy("parent")
        .agg(
            F.sum(F.col("child_size") * F.col("lambda_val")).alias("held"),
            F.sum("child_size").alias("n"),
            F.max("lambda_val").alias("death"),
        )
        .join(unbroadcast(births), "parent")
        .select(F.col("parent").alias("cluster"), (F.col("held") - F.col("n") * F.col("birth")).alias("stability"), "death")
    )
    return clusters.join(unbroadcast(sums), "cluster")
