"""Exact nearest neighbours, core distances and mutual reachability.

Work is done on distinct points: copies are merged first, with their number as a
weight, so a position shared by a third of all rows is one point. A point's id
is the smallest row id among its copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clustercat.functions.geometry import boxed, check_metric, distances, flat_matrix, norm, on_sphere, real_distance
from clustercat.operators.density.cells import CELL_ROWS, Cells, build_cells, descend_blocks, visit
from clustercat.storage import keep, unbroadcast

# Distances that exist at a time, few enough for a core's cache.
BLOCK_PAIRS = 1 << 16


def distinct_points(df: DataFrame, key: str = "row_id") -> DataFrame:
    """``point_id, features, weight``: one row per position that occurs."""
    features = F.col("features").cast("array<double>").alias("features")
    return (
        df.filter(F.col("features").isNotNull())
        .select(key, features)
        .groupBy("features")
        .agg(F.min(key).alias("point_id"), F.count("*").alias("weight"))
    )


def _rough(a: np.ndarray, x: np.ndarray, metric: str):
    """A function from some rows of ``a`` to something that grows with their distances to ``x``, and how far that may be off.

    For the straight distance it is the square by a product of matrices, around the middle of ``x``.
    """
    if metric == "euclidean":
        middle = x.mean(axis=0)
        x, near = x - middle, a - middle
        xx, aa = (x * x).sum(axis=1), (near * near).sum(axis=1)
        reach = np.sqrt(xx.max()) + np.sqrt(aa.max())
        slack = 8 * (x.shape[1] + 8) * np.finfo("float64").eps * reach * reach
        if np.isfinite(slack):
            flat = np.ascontiguousarray(-2 * x.T)

            def squares(rows: slice) -> np.ndarray:
                found = near[rows] @ flat
                found += xx
                found += aa[rows, None]
                return found

            return squares, slack
    return None, 0.0


def _nearest(
    a: np.ndarray, x: np.ndarray, k: int, metric: str, radius: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``a`` and of ``x``, and their distances: for each of ``a`` its k nearest of ``x``, by distance, then as ``x`` stands.

    Without a ``radius`` the two are the same points, and a row isn't its own neighbour; with one, only what lies within it counts.
    Rough distances leave a short list for each point, whose distances are then worked out one by one.
    """
    squares, slack = _rough(a, x, metric) if len(a) and len(x) else (None, 0.0)
    rows, ends, lengths = [], [], []
    step = max(1, BLOCK_PAIRS // max(len(x), 1))
    for start in range(0, len(a) if len(x) else 0, step):
        part = a[start : start + step]
        if squares is None:
            d = distances(part, x, metric)
            d[np.isnan(d)] = np.inf
        else:
            d = squares(slice(start, start + step))
        every = np.arange(len(part))
        if radius is None:
            d[every, every + start] = np.inf
            limit = np.partition(d, k - 1, axis=1)[:, k - 1] if k < len(x) else np.full(len(part), np.inf)
            near = d <= (limit + slack)[:, None]
        else:
            limit = radius[start : start + step] if squares is None else radius[start : start + step] ** 2
            near = d <= (limit + slack)[:, None]
            many = np.flatnonzero(np.count_nonzero(near, axis=1) > 2 * k)
            if len(many) and k < len(x):
                closer = np.minimum(limit[many], np.partition(d[many], k - 1, axis=1)[:, k - 1])
                near[many] = d[many] <= (closer + slack)[:, None]
        row, to = np.divmod(np.flatnonzero(near), len(x))
        dist = norm((part[row, j] - x[to, j] for j in range(x.shape[1])), metric)
        good = np.isfinite(dist)
        good &= to != row + start if radius is None else dist <= radius[row + start]
        row, to, dist = row[good], to[good], dist[good]
        order = np.lexsort((dist, row))
        row, to, dist = row[order], to[order], dist[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        rows.append(row[first] + start)
        ends.append(to[first])
        lengths.append(dist[first])
    if not rows:
        return np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64"), np.zeros(0)
    return np.concatenate(rows), np.concatenate(ends), np.concatenate(lengths)


def _within_reach(a: np.ndarray, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Which of ``x`` lie in the box around all that is within their radius of ``a``."""
    reach = (radius * (1 + 1e-9))[:, None]
    lo, hi = np.fmin.reduce(a - reach), np.fmax.reduce(a + reach)
    return np.flatnonzero(((x >= lo) & (x <= hi)).all(axis=1))


def _lists(row: np.ndarray, n: int, **columns) -> dict[str, pa.Array]:
    """Arrow lists of what belongs to each of ``n`` rows, of columns in the order of ``row``."""
    offsets = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
    return {name: pa.ListArray.from_arrays(offsets, pa.array(values)) for name, values in columns.items()}


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Identifiers to order by; one that is missing comes last."""
    return column.fill_null(np.iinfo("int64").max).to_numpy()


def _core(row: np.ndarray, dist: np.ndarray, near_weight: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """The distance within which k other rows lie of each point, copies counted; with fewer than k, to the farthest."""
    ends = np.searchsorted(row, np.arange(len(weight) + 1))
    total = np.r_[0, np.cumsum(near_weight)]
    enough = np.flatnonzero(total[1:] - total[ends[row]] + weight[row] - 1 >= k)
    core = np.zeros(len(weight))
    some = ends[1:] > ends[:-1]
    core[some] = dist[ends[1:][some] - 1]
    at, first = np.unique(row[enough], return_index=True)
    core[at] = dist[enough[first]]
    core[weight - 1 >= k] = 0.0
    return core


def _zipped(lists: DataFrame) -> DataFrame:
    return lists.withColumn("neighbours", F.arrays_zip("dist", "id", "near_weight")).drop("dist", "id", "near_weight")


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for the points of each cell in a batch: ``own`` and the arrays ``spot, features`` (end to end), ``radius``."""
    for batch in batches:
        batch = batch.take(pa.array(np.argsort(batch["cell"].to_numpy(), kind="stable")))
        own, starts = np.unique(batch["cell"].to_numpy(), return_index=True)
        offsets = np.r_[starts, batch.num_rows]
        x = flat_matrix(batch["features"])
        parts = [("spot", offsets, batch["spot"]), ("features", offsets * x.shape[1], x.ravel()), ("radius", offsets, batch["radius"])]
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)) for _, ends, values in parts]
        yield pa.RecordBatch.from_arrays([pa.array(own), *lists], ["own", *(name for name, _, _ in parts)])


def neighbour_lists(placed: DataFrame, cells: Cells, k: int, core_only: bool = False) -> DataFrame:
    """``placed`` with ``core`` and, unless ``core_only``, ``neighbours``: the k nearest distinct points, nearest first.

    ``core`` is the distance within which k other rows lie, copies counted.

    First inside the own cell; the k-th distance found there bounds the search,
    and only cells whose box is that near are asked as well. They answer with what lies within the
    bound, since nothing farther can be among the k nearest. A cell's points ask together, as one row, and
    a cell puts its answers together in one task; ``spot`` is a point's place in its cell.
    """
    metric, columns = cells.metric, placed.columns
    found = "dist array<double>, id array<bigint>, near_weight array<bigint>"
    plain = [f"`{c}` {t}" for c, t in placed.dtypes]

    def listed(table: pa.Table, row: np.ndarray, dist: np.ndarray, ids: pa.Array, weights: pa.Array, lists: bool) -> pa.Table:
        core = _core(row, dist, weights.to_numpy(), table["weight"].to_numpy(), k)
        table = table.append_column("core", pa.array(core))
        if not lists:
            return table
        lists = _lists(row, table.num_rows, dist=dist, id=ids.cast(pa.int64()), near_weight=weights.cast(pa.int64()))
        for name, column in lists.items():
            table = table.append_column(name, column)
        return table

    def own(table: pa.Table) -> pa.Table:
        table = table.sort_by("point_id").combine_chunks()
        x = flat_matrix(table["features"])
        row, to, dist = _nearest(x, x, k, metric)
        count = np.bincount(row, minlength=len(x))
        radius = np.full(len(x), np.inf)
        radius[count == k] = dist[np.cumsum(count)[count == k] - 1]
        ids, weights = (table[c].combine_chunks().take(pa.array(to)) for c in ("point_id", "weight"))
        out = table.select(columns).append_column("spot", pa.array(np.arange(len(x)), pa.int32()))
        return listed(out.append_column("radius", pa.array(radius)), row, dist, ids, weights, True)

    schema = ", ".join([*plain, "spot int, radius double, core double", found])
    lists = keep(placed.groupBy("cell").applyInArrow(own, schema), "lists")
    if cells.depth == 0:
        return _zipped(lists.drop("spot", "radius")).select(*columns, "core", *([] if core_only else ["neighbours"]))
    arrays = "spot array<int>, features array<double>, radius array<double>"
    asked = lists.select("cell", "spot", "features", "radius").mapInArrow(_asked, f"own bigint, {arrays}")
    queries = descend_blocks(asked, cells, cells.nodes)

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        held = held.sort_by("point_id").combine_chunks()
        x, ids, weights = flat_matrix(held["features"]), held["point_id"].combine_chunks(), held["weight"].combine_chunks()
        columns: dict[str, list] = {"spot": [], "dist": [], "to": []}
        for at in range(asked.num_rows):
            spot, flat, radius = (asked[c][at].values.to_numpy(zero_copy_only=False) for c in ("spot", "features", "radius"))
            a = flat.reshape(len(spot), -1)
            some = _within_reach(a, x, radius)
            row, to, dist = _nearest(a, x[some], k, metric, radius)
            for column, values in zip(columns.values(), (spot[row], dist, some[to])):
                column.append(values)
        sizes = [len(values) for values in columns["to"]]
        spot, dist, to = (np.concatenate(parts) if parts else np.zeros(0) for parts in columns.values())
        block, to = np.repeat(np.arange(len(sizes)), sizes), pa.array(to.astype("int64"))
        near = {"dist": dist, "id": ids.take(to).cast(pa.int64()), "near_weight": weights.take(to).cast(pa.int64())}
        lists = _lists(block, len(sizes), spot=pa.array(spot, pa.int32()), **near)
        return pa.table({"cell": asked["own"].combine_chunks(), **lists})

    slim = placed.select("point_id", "cell", "features", "weight")
    far = visit(queries, slim, answer, f"cell bigint, spot array<int>, {found}", by="own", rows=F.size("spot"), arrow=True)
    far = keep(far, "far")

    def merged(mine: pa.Table, far: pa.Table) -> pa.Table:
        mine, n = mine.combine_chunks(), mine.num_rows
        place = np.zeros(n, dtype="int64")
        place[mine["spot"].to_numpy()] = np.arange(n)
        count = pc.list_value_length(mine["dist"]).to_numpy()
        row = np.r_[np.repeat(np.arange(n), count), place[pc.list_flatten(far["spot"]).to_numpy().astype("int64")]]
        dist, ids, weights = (
            pa.chunked_array([*pc.list_flatten(mine[c]).chunks, *pc.list_flatten(far[c]).chunks], mine.schema.field(c).type.value_type)
            for c in ("dist", "id", "near_weight")
        )
        order = np.lexsort((_numbers(ids), dist.to_numpy(), row))
        row = row[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, order = row[first], order[first]
        ids, weights = (column.take(pa.array(order)).combine_chunks() for column in (ids, weights))
        return listed(mine.select(columns), row, dist.to_numpy()[order], ids, weights, not core_only)

    together = lists.drop("radius", "core").groupBy("cell").cogroup(far.groupBy("cell"))
    if core_only:
        return keep(together.applyInArrow(merged, ", ".join([*plain, "core double"])), "core")
    return keep(_zipped(together.applyInArrow(merged, ", ".join([*plain, "core double", found]))), "lists")


def searchable(df: DataFrame, metric: str, key: str = "row_id") -> DataFrame:
    """Key and ``features`` as the metric's search takes them."""
    check_metric(metric)
    return df.select(key, on_sphere(F.col("features").cast("array<double>"), metric).alias("features"))


def prepare(df: DataFrame, k: int, metric: str, cell_rows: int, key: str, core_only: bool = False):
    """Points in their cells, the cells, and :func:`neighbour_lists`, of :func:`searchable` rows; distances as the search finds them."""
    points = keep(distinct_points(df, key), "points")
    placed, cells = build_cells(points, max(cell_rows, 4 * k), boxed(metric))
    return placed, cells, neighbour_lists(placed, cells, k, core_only)


def row_neighbours(
    df: DataFrame, placed: DataFrame, lists: DataFrame, k: int, key: str = "row_id", core: DataFrame | None = None
) -> DataFrame:
    """``row_id, rank, neighbor_id, dist`` for every row, from the neighbour lists of the positions.

    With the positions' ``core`` distances also ``core_a`` and ``core_b``, those of the row and of the neighbour. A row's copies are its neighbours at distance 0. A position offers its ``k + 1`` smallest
    row ids, more than any list can hold, so a position with many copies stays short.
    """
    rows = keep(to_rows(df, placed.select("features", "point_id"), key), "placed-rows")
    by_id = Window.partitionBy("point_id").orderBy(key)
    # The filter on the rank also runs before the exchange.
    offered = rows.withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k + 1)
    offered = offered.groupBy("point_id").agg(F.array_sort(F.collect_list(key)).alias("ids"))
    facts = [] if core is None else ["core"]
    if core is not None:
        offered = offered.join(unbroadcast(core.select("point_id", "core")), "point_id")
    near = lists.select("point_id", F.explode("neighbours").alias("n")).select(
        "point_id", F.col("n.id").alias("at"), F.col("n.dist").alias("dist")
    )
    own = placed.select("point_id", F.col("point_id").alias("at"), F.lit(0.0).alias("dist"))
    held = near.unionByName(own).join(unbroadcast(offered.withColumnRenamed("point_id", "at")), "at")
    entries = F.transform("ids", lambda i: F.struct(F.col("dist"), i.alias("id"), *facts))
    best = F.slice(F.array_sort(F.flatten(F.collect_list("e"))), 1, k + 1)
    of_own = [F.max(F.when(F.col("at") == F.col("point_id"), F.col(c))).alias(c) for c in facts]
    best = held.select("point_id", "at", entries.alias("e"), *facts).groupBy("point_id").agg(best.alias("best"), *of_own)
    mine = F.slice(F.filter("best", lambda e: e["id"] != F.col(key)), 1, k)
    return rows.join(unbroadcast(best), "point_id").select(key, *facts, F.posexplode(mine).alias("pos", "n")).select(
        key,
        (F.col("pos") + 1).alias("rank"),
        F.col("n.id").alias("neighbor_id"),
        F.col("n.dist").alias("dist"),
        *[F.col(c).alias(f"{c}_a") for c in facts],
        *[F.col(f"n.{c}").alias(f"{c}_b") for c in facts],
    )


def knn(df: DataFrame, k: int, metric: str = "euclidean", cell_rows: int = CELL_ROWS, key: str = "row_id") -> DataFrame:
    """``row_id, rank, neighbor_id, dist``: the k nearest other rows of every row, ties to the smaller id."""
    df = searchable(df, metric, key)
    placed, _, lists = prepare(df, k, metric, cell_rows, key)
    return row_neighbours(df, placed, lists, k, key).withColumn("dist", real_distance(F.col("dist"), metric))


def with_core(placed: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """``placed`` with ``core``, as :func:`neighbour_lists` with the same ``k`` left it."""
    return lists.select(*placed.columns, "core")


def core_distance(
    df: DataFrame, k: int, metric: str = "euclidean", cell_rows: int = CELL_ROWS, key: str = "row_id"
) -> DataFrame:
    """``row_id, core`` for every row; copies share their point's value."""
    df = searchable(df, metric, key)
    _, _, known = prepare(df, k, metric, cell_rows, key, core_only=True)
    return to_rows(df, known.select("features", real_distance(F.col("core"), metric).alias("core")), key)


def to_rows(df: DataFrame, per_point: DataFrame, key: str = "row_id") -> DataFrame:
    """Give every row its point's values; rows without features are left out."""
    rows = df.select(key, F.col("features").cast("array<double>").alias("features"))
    return rows.join(unbroadcast(per_point), "features").drop("features")


def mutual_reachability(
    df: DataFrame, k: int, metric: str = "euclidean", cell_rows: int = CELL_ROWS, key: str = "row_id"
) -> DataFrame:
    """``row_id, neighbor_id, weight`` of the neighbour pairs: the largest of both core distances and the distance."""
    df = searchable(df, metric, key)
    placed, _, lists = prepare(df, k, metric, cell_rows, key)
    known = with_core(placed, lists, k)
    if df.groupBy(key).count().filter("count > 1").isEmpty():
        pairs = row_neighbours(df, placed, lists, k, key, known).filter(F.col(key).isNotNull() & F.col("neighbor_id").isNotNull())
    else:  # a key that repeats stands for each of its rows
        core = keep(to_rows(df, known.select("features", "core"), key), "row-core")
        pairs = (
            row_neighbours(df, placed, lists, k, key)
            .join(unbroadcast(core.withColumnRenamed("core", "core_a")), key)
            .join(unbroadcast(core.select(F.col(key).alias("neighbor_id"), F.col("core").alias("core_b"))), "neighbor_id")
        )
    return pairs.select(key, "neighbor_id", F.greatest("core_a", "core_b", "dist").alias("weight"))
