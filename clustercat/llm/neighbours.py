"""Approximate nearest neighbours over several shifted Hilbert orderings.

Every curve has its own random projection and shift. The rows are range-partitioned by
their key on each curve and numbered along it; a window is a run of ``window`` rows.
A query is compared with its own window and those up to ``reach`` beside it on every curve,
and the nearest rows of all the curves are merged. Windows hold a fixed number of rows, so no
key value and no dense region makes one task larger than another.

How far to reach depends on the rows: the more of them and the less structure, the farther
neighbours lie apart on the curves. So some queries are compared with all rows first, and
the reach is the least at which the curves find the wanted share of those true neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clustercat.llm.common import positions, sampled
from clustercat.llm.hilbert import hilbert_keys
from clustercat.storage import keep


def usable(vector: Column) -> Column:
    """Whether a vector has components, all finite and not all zero."""
    double = vector.cast("array<double>")
    finite = F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(double, lambda x: x != 0), F.lit(False))


def common_size(rows: DataFrame) -> int:
    """The length that most vectors have, the greatest of several; 0 if there is none."""
    found = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return found["size"] if found else 0


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def fit_curves(points: DataFrame, size: int, curves: int, dims: int, bits: int, sample_rows: int, seed: int) -> list:
    """Projection, scale and shift of each curve, from a bounded sample of the points."""
    rows = sampled(points.select("vector"), sample_rows, "vector", seed=seed).collect()
    sample = np.array([r[0] for r in rows], float).reshape(-1, size)
    fitted = []
    for c in range(curves):
        draw = np.random.default_rng([seed, c])
        basis, _ = np.linalg.qr(draw.normal(size=(size, min(dims, size))))
        seen = sample @ basis if len(sample) else np.zeros((1, basis.shape[1]))
        spread = np.where(seen.std(0) > 0, seen.std(0), 1.0)
        shift = (draw.random(basis.shape[1]) - 0.5) / 4
        # Six deviations fill the grid; what lies beyond is put on its border.
        scale = (1 << bits) / (6 * spread)
        fitted.append((basis * scale, (0.5 + shift) * (1 << bits) - seen.mean(0) * scale))
    return fitted


def curve_keys(points: DataFrame, size: int, fitted: list, bits: int) -> DataFrame:
    """``point, curve, key`` for every point on every curve."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), size)
            for c, (matrix, offset) in enumerate(fitted):
                grid = np.clip(np.floor(x @ matrix + offset), 0, (1 << bits) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(x), c, np.int32)), pa.array(hilbert_keys(grid, bits))],
                    ["point", "curve", "key"],
                )

    return points.select("point", "vector").mapInArrow(convert, "point long, curve int, key long")


def true_neighbours(points: DataFrame, trial: dict[int, list[float]], size: int, k: int) -> dict[int, list[int]]:
    """The ``k`` other points nearest to each point of ``trial``, compared with all points; one pass, for few points."""
    names = np.array(list(trial), np.int64)
    y = np.array(list(trial.values()), float).reshape(-1, size)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, apart = np.zeros((len(y), 0), np.int64), np.zeros((len(y), 0))
        for batch in batches:
            own, x = batch.column(0).to_numpy(), _matrix(batch.column(1), size)
            for at in range(0, len(x), 1024):
                new, part = own[at : at + 1024], x[at : at + 1024]
                far = np.stack([((part - q) ** 2).sum(axis=1) for q in y])
                far[names[:, None] == new[None, :]] = np.inf
                apart = np.hstack([apart, far])
                ids = np.hstack([ids, np.broadcast_to(new, far.shape)])
                best = np.argsort(apart, axis=1, kind="stable")[:, :k]
                apart, ids = np.take_along_axis(apart, best, axis=1), np.take_along_axis(ids, best, axis=1)
        found = np.isfinite(apart)
        arrays = [np.repeat(names, ids.shape[1])[found.ravel()], ids[found], apart[found]]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["query", "point", "score"])

    found = points.select("point", "vector").mapInArrow(nearest, "query long, point long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "point"))
    truth: dict[int, list[int]] = {}
    for r in found.withColumn("n", rank).filter(F.col("n") <= k).collect():  # k rows for each point of the trial
        truth.setdefault(r["query"], []).append(r["point"])
    return truth


def fit_reach(points: DataFrame, ordered: DataFrame, seeds: DataFrame, size: int, k: int, recall: float, trials: int, seed: int) -> int:
    """The least reach, 1 or more, at which about ``trials`` of the asked points find the share ``recall`` of their neighbours."""
    trial = {r["point"]: r["vector"] for r in sampled(seeds.select("point", "vector"), trials, "point", seed=seed).collect()}
    truth = true_neighbours(points, trial, size, k) if trial else {}
    wanted = sorted(set(truth) | {p for found in truth.values() for p in found})
    places: dict[int, dict[int, int]] = {}
    for r in ordered.filter(F.col("point").isin(wanted)).collect() if wanted else []:  # bounded by the trial
        places.setdefault(r["point"], {})[r["curve"]] = r["win"]
    apart = [
        min(abs(win - places[p][curve]) for curve, win in places[query].items()) for query, found in truth.items() for p in found
    ]
    return max(1, sorted(apart)[int(np.ceil(recall * len(apart))) - 1]) if apart else 1


def _nearest_in_window(size: int, wanted: int):
    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        found_q, found_p, found_d = [], [], []
        if left.num_rows and right.num_rows:
            x = _matrix(left["vector"].combine_chunks(), size)
            ids = left["point"].to_numpy()
            queries = right["query"].to_numpy()
            y = _matrix(right["vector"].combine_chunks(), size)
            keep_n = min(wanted, len(ids))
            for at in range(0, len(y), 16):
                part = y[at : at + 16]
                apart = ((part[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
                # All points up to the last distance, so that equal ones are cut by their number.
                row, col = np.nonzero(apart <= np.partition(apart, keep_n - 1, axis=1)[:, keep_n - 1 : keep_n])
                order = np.lexsort((ids[col], apart[row, col], row))
                row, col = row[order], col[order]
                best = np.arange(len(row)) - np.searchsorted(row, row) < keep_n
                row, col = row[best], col[best]
                found_q.append(queries[at : at + 16][row])
                found_p.append(ids[col])
                found_d.append(np.sqrt(apart[row, col]))
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.array([], kind))
        return pa.table({"query": join(found_q, np.int64), "point": join(found_p, np.int64), "score": join(found_d, float)})

    return nearest


def nearest_neighbours(
    vectors: DataFrame,
    queries: Column,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    size: int | None = None,
    k: int = 10,
    curves: int = 20,
    window: int = 2048,
    dims: int = 10,
    bits: int = 6,
    sample_rows: int = 10_000,
    seed: int = 11,
    recall: float = 0.95,
    trials: int = 200,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows nearest to each row that ``queries`` selects, as far as found.

    Nearness is Euclidean distance in double precision on the vectors as given; ties
    go to the smaller id. A row is not its own neighbour: candidates are all other rows, also those that
    repeat its id or its vector. Vectors that are null, zero, or hold a null or non-finite component
    take no part, nor do null ids. Vectors of different lengths have no distance, so those
    of one length take part: ``size``, by default the length that most of them have. Rows that repeat an id are
    rows and queries of their own. An empty table gives no rows; other columns are ignored.

    The windows beside a query's own that are searched are as many as find the share ``recall`` of the
    true neighbours of about ``trials`` queries, at any number of rows (:func:`fit_reach`).

    Equal vectors are one point on the curves, carrying its ``k + 1`` first rows in order of id,
    which are all that any answer can need.
    """
    rows = vectors.filter(usable(F.col(vector_column)) & F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"),
        # Zero has one sign here, so equal vectors are equal keys.
        F.transform(F.col(vector_column).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vector"),
        F.coalesce(queries, F.lit(False)).alias("asked"),
    )
    size = size or common_size(rows)
    # An id may stand for several rows, so rows go by their number in order of id.
    rows = positions(rows.filter(F.size("vector") == size), [], ["id", "vector", "asked"]).withColumnRenamed("_pos", "row")
    rows = keep(rows.withColumn("mark", F.xxhash64("vector")), "vectors")
    by_row = Window.partitionBy("mark", "vector").orderBy("row")
    # The filter on the rank is applied before the exchange too, so a common vector sends few rows.
    least = rows.select("mark", "vector", "id", "row", F.row_number().over(by_row).alias("n")).filter(F.col("n") <= k + 1)
    members = keep(
        least.withColumn("point", F.min("row").over(Window.partitionBy("mark", "vector"))).select("point", "id", "row", "vector", "n"),
        "vector-members",
    )
    points = members.filter("n = 1").select("point", "vector")
    asked = rows.filter("asked").select(F.col("row").alias("query"), F.col("id").alias("query_id"), "mark", "vector")

    fitted = fit_curves(points, size, curves, dims, bits, sample_rows, seed)
    ordered = positions(curve_keys(points, size, fitted, bits), ["curve"], ["key", "point"])
    ordered = keep(ordered.select("point", "curve", F.floor(F.col("_pos") / window).alias("win")), "curve-windows")
    index = ordered.join(points, "point").select("curve", "win", "point", "vector")
    # A query may be a copy, so it finds its place through its vector's point.
    of = members.select("point", F.col("row").alias("query"))
    late = asked.join(of, "query", "left_anti")
    same = points.withColumn("mark", F.xxhash64("vector"))
    late = late.join(same, ["mark", "vector"]).select("point", "query", "query_id")
    places = asked.join(of, "query").select("point", "query", "query_id").unionByName(late)
    # Queries with one vector have one answer but for themselves: each asked point searches once.
    seeds = keep(places.select("point").distinct().join(points, "point"), "asked-points")
    reach = fit_reach(points, ordered, seeds, size, k, recall, trials, seed)
    last = ordered.agg(F.coalesce(F.max("win"), F.lit(0))).first()[0]
    first, final = F.greatest(F.col("win") - reach, F.lit(0)), F.least(F.col("win") + reach, F.lit(last))
    windows = F.explode(F.sequence(first, final)).alias("in_win")
    probes = seeds.join(ordered, "point").select(
        F.col("point").alias("query"), "vector", F.col("curve").alias("on_curve"), windows
    )
    found = (
        index.groupBy("curve", "win")
        .cogroup(probes.groupBy("on_curve", "in_win"))
        .applyInArrow(_nearest_in_window(size, k + 1), "query long, point long, score double")
        .distinct()
    )
    near = Window.partitionBy("query").orderBy("score", "point")
    found = found.withColumn("n", F.row_number().over(near)).filter(F.col("n") <= k + 1)
    answers = found.select("query", "point", "score").join(members.select("point", "id", "row"), "point")
    best = Window.partitionBy("query").orderBy("score", "row")
    answers = answers.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    answers = keep(answers.select(F.col("query").alias("point"), "id", "row", "score"), "point-neighbours")
    mine = places.join(answers, "point").filter("row <> query")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "row"))
    return (
        mine.withColumn("rank", rank)
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias("vec_id"), "score")
    )
