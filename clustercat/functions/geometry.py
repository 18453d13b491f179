"""Metrics, and distances between blocks of points, for use inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Metrics for which a box bounds the distance to what it holds.
BOXED = ("euclidean", "manhattan", "chebyshev")
# Metrics that grow with the straight line between two points of a sphere.
CHORDS = ("haversine", "cosine")
METRICS = BOXED + CHORDS


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"unsupported metric {metric!r}, use one of {METRICS}")
    return metric


def boxed(metric: str) -> str:
    """The metric that the search uses for ``metric``."""
    return "euclidean" if check_metric(metric) in CHORDS else metric


def on_sphere(features: Column, metric: str) -> Column:
    """Features as the search sees them; NULL where the metric has no place for them.

    "haversine" takes latitude and longitude in radians, "cosine" any vector but zero.
    """
    if metric == "haversine":
        latitude, longitude = features[0], features[1]
        return F.array(F.cos(latitude) * F.cos(longitude), F.cos(latitude) * F.sin(longitude), F.sin(latitude))
    if metric == "cosine":
        length = F.sqrt(F.aggregate(features, F.lit(0.0), lambda total, x: total + x * x))
        return F.when(length > 0, F.transform(features, lambda x: x / length))
    return features


def real_distance(found: Column, metric: str) -> Column:
    """The metric's distance from the one that the search found."""
    if metric == "haversine":
        return 2.0 * F.asin(F.least(found / 2.0, F.lit(1.0)))
    if metric == "cosine":
        return found * found / 2.0
    return found


def norm(gaps, metric: str = "euclidean") -> np.ndarray:
    """Length of a vector given as a sequence of per-axis arrays, added axis by axis."""
    total = 0.0
    for gap in gaps:
        if metric == "euclidean":
            total = total + gap * gap
        elif metric == "manhattan":
            total = total + np.abs(gap)
        else:
            total = np.maximum(total, np.abs(gap))
    return np.sqrt(total) if metric == "euclidean" else total


def norm_of(gaps: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """As :func:`norm`, to the last bit, of a matrix with a row for each axis."""
    if metric == "euclidean":
        return np.sqrt(np.add.reduce(gaps * gaps))
    return np.add.reduce(np.abs(gaps)) if metric == "manhattan" else np.maximum.reduce(np.abs(gaps))


def distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """All distances between the rows of two matrices."""
    return norm((np.subtract.outer(a[:, j], b[:, j]) for j in range(a.shape[1])), metric)


def matrix(column) -> np.ndarray:
    """Rows of an array column as a float matrix."""
    return np.array(column.tolist(), dtype="float64") if len(column) else np.zeros((0, 0))


def flat_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an Arrow column of arrays as a float matrix; a missing number is NaN."""
    widths = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(widths) > 1:
        raise ValueError(f"features of different lengths: {widths[:5]}")
    values = pc.list_flatten(column)
    values = values.to_numpy() if isinstance(values, pa.ChunkedArray) else values.to_numpy(zero_copy_only=False)
    return values.astype("float64", copy=False).reshape(len(column), widths[0] if widths else 0)
