"""The best choice below every node of a tree, by parallel tree contraction.

A node's best is the larger of its own weight and the sum of its children's bests. A round first
contracts blocks of nodes, each in a task, as far as parents and only children are in the block.
Then it rakes all leaves into their parents, and takes nodes with one child out of their
chains where a hash says so, never two neighbours. What a node passes to its parent is then a function
``y -> max(a, y + b)`` of its best, and such functions of one another are of that form again. So
a path of n nodes, or any other tree, is gone after some log n rounds at most, each a grouped sum and two
joins, and after one where a block holds it. The nodes taken out get their bests at the end, by
following the children they were left for, in steps that double.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clustercat.storage import drop_kept, keep, unbroadcast

# A node's best is max(own, below + its open child's part); its part for its parent is max(a, best + b).
STATE = ["node", "parent", "own", "below", "kids", "a", "b"]
# A node taken out waits for the best of another, whose part is by w_a and w_b; a raked one has its best.
ROW = "node bigint, parent bigint, own double, below double, kids bigint, a double, b double, waits bigint, w_a double, w_b double, best double"
BLOCK_ROWS = 100_000


def _order(node: Column, turn: int) -> Column:
    """A number that orders nodes anew each round; equal ones are settled by the node itself."""
    return F.struct(F.xxhash64(F.lit(turn), node).alias("h"), node.alias("node"))


def contract_block(rows: list[tuple]) -> list[tuple]:
    """``STATE`` rows of a block after all rakes and splices that need no other row, as rows of ``ROW``."""
    parent, own, below, kids, a, b = ({r[0]: r[k] for r in rows} for k in range(1, 7))
    inside: dict[int, set[int]] = {}
    for node, up in parent.items():
        if up in own:
            inside.setdefault(up, set()).add(node)
    best: dict[int, float] = {}
    leaves = [node for node in own if not kids[node]]
    while leaves:
        node = leaves.pop()
        up = parent[node]
        if up is not None and up not in own:
            continue  # its parent is raked elsewhere
        best[node] = max(own[node], below[node])
        if up is not None:
            below[up] += max(a[node], best[node] + b[node])
            kids[up] -= 1
            inside[up].remove(node)
            if not kids[up]:
                leaves.append(up)
    waits: dict[int, tuple] = {}
    for node in own:
        if node in best or kids[node] != 1 or parent[node] is None or not inside.get(node):
            continue
        child, up = inside[node].pop(), parent[node]
        waits[node] = (child, a[child], b[child])
        a[child] = max(a[node], max(own[node], below[node] + a[child]) + b[node])
        b[child] += below[node] + b[node]
        parent[child] = up
        if up in own:
            inside[up].remove(node)
            inside[up].add(child)
    return [
        (n, parent[n], own[n], below[n], kids[n], a[n], b[n], *waits.get(n, (None, 0.0, 0.0)), best.get(n)) for n in own
    ]


def _contracted(live: DataFrame, blocks: int) -> DataFrame:
    """``live`` in ``blocks`` ranges of nodes, each contracted in a task."""

    def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for pdf in batches:
            up = [None if x is None or x != x else int(x) for x in pdf["parent"].astype(object)]
            rows += zip(pdf["node"].tolist(), up, *(pdf[c].tolist() for c in STATE[2:]))
        if rows:
            out = pd.DataFrame(contract_block(rows), columns=[f.split()[0] for f in ROW.split(", ")])
            for c in ("parent", "waits"):
                out[c] = pd.array(out[c].tolist(), dtype="Int64") if len(out) else out[c]
            yield out.assign(best=out["best"].astype("float64"))

    # Identifiers beyond 2^53 don't survive as floats, which is how pandas holds a column with gaps.
    text = live.withColumn("parent", F.col("parent").cast("string"))
    return text.repartitionByRange(blocks, "node").mapInPandas(contract, ROW)


def _raked(live: DataFrame, turn: int) -> DataFrame:
    """``live`` after its leaves have been added to their parents, with the only child left where there is one."""
    leaf = F.col("kids") == 0
    part = F.greatest("a", F.greatest("own", "below") + F.col("b"))
    gone = live.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(
        F.sum(F.when(leaf, part).otherwise(0.0)).alias("more"),
        F.count_if(leaf).alias("gone"),
        F.max(F.when(~leaf, F.col("node"))).alias("only"),
    )
    rest = live.filter("kids > 0").join(unbroadcast(gone), "node").withColumns(
        {"kids": F.col("kids") - F.col("gone"), "below": F.col("below") + F.col("more")}
    )
    me = _order(F.col("node"), turn)
    out = (F.col("kids") == 1) & F.col("parent").isNotNull()
    out = out & (me < _order(F.col("parent"), turn)) & (me < _order(F.col("only"), turn))
    return rest.select(*STATE, "only", F.coalesce(out, F.lit(False)).alias("out"))


def _spliced(rest: DataFrame) -> DataFrame:
    """``rest`` with the parts of children of nodes taken out passed on to their new parents.

    A node taken out stays as a row, ``only`` naming the child whose best it waits for, with that child's part.
    """
    taken = rest.filter("out").select(
        F.col("node").alias("parent"), F.col("parent").alias("up"),
        *(F.col(c).alias(f"p_{c}") for c in ("own", "below", "a", "b")),
    )
    moved = rest.filter(~F.col("out")).join(unbroadcast(taken), "parent", "left")
    # Own part a, b; the old parent's best max(p_own, p_below + part) and its part of that.
    floor = F.greatest(F.col("p_a"), F.greatest(F.col("p_own"), F.col("p_below") + F.col("a")) + F.col("p_b"))
    there = F.col("p_own").isNotNull()
    stay = moved.select(
        "node", F.when(there, F.col("up")).otherwise(F.col("parent")).alias("parent"), "own", "below", "kids",
        F.when(there, floor).otherwise(F.col("a")).alias("a"),
        F.when(there, F.col("b") + F.col("p_below") + F.col("p_b")).otherwise(F.col("b")).alias("b"),
        F.lit(None).cast("bigint").alias("waits"), F.lit(0.0).alias("w_a"), F.lit(0.0).alias("w_b"),
    )
    ends = rest.select(F.col("node").alias("waits"), F.col("a").alias("w_a"), F.col("b").alias("w_b"))
    gone = rest.filter("out").withColumn("waits", F.col("only")).join(unbroadcast(ends), "waits")
    return stay.unionByName(gone.select(*STATE, "waits", "w_a", "w_b"))


def best_below(tree: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """``node, own, below``: for each row of ``node, parent, own`` the sum of its children's bests; and the rounds taken.

    A root's parent is NULL; there may be several trees. ``node`` is unique.
    """
    kids = tree.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"))
    live = tree.join(unbroadcast(kids), "node", "left").select(
        "node", "parent", F.col("own").cast("double").alias("own"), F.lit(0.0).alias("below"),
        F.coalesce("kids", F.lit(0)).alias("kids"), F.lit(float("-inf")).alias("a"), F.lit(0.0).alias("b"),
    )
    live = keep(live, "contraction")
    known, waiting, rounds = [], [], 0

    def settled(state: DataFrame) -> DataFrame:
        known.append(state.filter("best is not null").select("node", "best"))
        waiting.append(state.filter("waits is not null").select("node", "own", "below", "waits", "w_a", "w_b"))
        return state.filter("best is null and waits is null").select(*STATE)

    while number := live.count():
        rounds += 1
        live = settled(keep(_contracted(live, -(-number // block_rows)), "contraction"))
        if live.isEmpty():
            break
        known.append(live.filter("kids = 0").select("node", F.greatest("own", "below").alias("best")))
        # The nodes that remain are read three times below.
        rest = keep(_raked(live, rounds), "raked")
        live = settled(keep(_spliced(rest).withColumn("best", F.lit(None).cast("double")), "contraction"))
        drop_kept(rest)
    if not known:
        return tree.select("node", "own", F.lit(0.0).alias("below")), rounds
    return _resolved(tree, reduce(DataFrame.unionByName, known), reduce(DataFrame.unionByName, waiting)), rounds


def _resolved(tree: DataFrame, known: DataFrame, waiting: DataFrame) -> DataFrame:
    """Bests of nodes that wait for others, then the sums over children."""
    # best = max(low, best of ``waits`` + add)
    low = F.greatest("own", F.col("below") + F.col("w_a"))
    line = waiting.select("node", "waits", low.alias("low"), (F.col("below") + F.col("w_b")).alias("add"))
    while not line.isEmpty():
        known = keep(known, "bests")
        ends = known.select(F.col("node").alias("waits"), "best")
        links = line.select(
            F.col("node").alias("waits"), F.col("waits").alias("next"), F.col("low").alias("n_low"), F.col("add").alias("n_add")
        )
        step = keep(line.join(unbroadcast(ends), "waits", "left").join(unbroadcast(links), "waits", "left"), "waiting")
        done = step.filter("best is not null").select("node", F.greatest("low", F.col("best") + F.col("add")).alias("best"))
        known = known.unionByName(done)
        line = step.filter("best is null").select(
            "node", F.col("next").alias("waits"),
            F.greatest("low", F.col("n_low") + F.col("add")).alias("low"), (F.col("n_add") + F.col("add")).alias("add"),
        )
    sums = tree.filter("parent is not null").select("node", "parent").join(unbroadcast(known), "node")
    sums = sums.groupBy(F.col("parent").alias("node")).agg(F.sum("best").alias("below"))
    return tree.join(unbroadcast(sums), "node", "left").select("node", "own", F.coalesce("below", F.lit(0.0)).alias("below"))
