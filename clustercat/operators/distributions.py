"""The tables behind the usual diagnostic views of a labelled catalogue."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clustercat.functions.numeric import bin_edge, bin_index, clean, finite, hex_lattice, hex_rows
from clustercat.functions.sky import angular_distance, pm_magnitude
from clustercat.operators.harmonise import has_columns, require_columns, with_pm_magnitude
from clustercat.operators.members import filter_finite_pairs, subset_members
from clustercat.operators.quantiles import group_profile, group_quantiles, median_mad
from clustercat.operators.ranking import positions, sample_rows
from clustercat.storage import keep

# Histograms


def _spread(lo: Column, hi: Column) -> tuple[Column, Column]:
    """A range of zero width is widened by a half on either side."""
    pad = F.when(lo == hi, 0.5).otherwise(0.0)
    return lo - pad, hi + pad


def histogram(
    df: DataFrame,
    column: str,
    bins: int = 30,
    by: str | Iterable[str] | None = None,
    limits: tuple[Column, Column] | None = None,
) -> DataFrame:
    """``[by,] bin, lo, hi, n`` with every bin present, each group over its own range.

    ``limits`` gives one range for all rows instead; rows outside it are dropped.
    """
    keys = [by] if isinstance(by, str) else list(by or [])
    rows = df.select(*keys, clean(F.col(column).cast("double")).alias("x")).dropna("any")
    if limits is None:
        lo, hi = _spread(F.min("x"), F.max("x"))
        ranges = rows.groupBy(*keys).agg(lo.alias("lo"), hi.alias("hi"))
        ranges = ranges.filter(F.col("lo").isNotNull())
    else:
        ranges = df.sparkSession.range(1).select(limits[0].alias("lo"), limits[1].alias("hi"))
    ranges = keep(ranges, "ranges")
    if keys:
        ranged = rows.join(ranges, keys)
    else:
        row = ranges.first() or (None, None)  # one range
        ranged = rows.withColumns({"lo": F.lit(row[0]), "hi": F.lit(row[1])})
    lo, hi = F.col("lo"), F.col("hi")
    counts = (
        ranged.filter((F.col("x") >= lo) & (F.col("x") <= hi))
        .groupBy(*keys, bin_index(F.col("x"), lo, hi, bins).alias("bin"))
        .count()
    )
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    i = F.col("bin")
    return grid.join(counts, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        bin_edge(lo, hi, bins, i).alias("lo"),
        bin_edge(lo, hi, bins, i + 1).alias("hi"),
        F.coalesce("count", F.lit(0)).alias("n"),
    )


def _long(df: DataFrame, features: Iterable[str], *others: str) -> DataFrame:
    """``feature, x`` and the other columns: all features in one pass over the rows."""
    pairs = [F.struct(F.lit(c).alias("feature"), clean(F.col(c).cast("double")).alias("x")) for c in features]
    return df.select(*others, F.inline(F.array(*pairs))).filter(F.col("x").isNotNull())


def histogram_by_cluster(
    df: DataFrame, feature: str | list[str], bins: int = 30, members_only: bool = False
) -> DataFrame:
    """One histogram per label, noise included; without labels one for all rows.

    For a list of features the result has a ``feature`` column too.
    """
    features = [feature] if isinstance(feature, str) else list(feature)
    require_columns(df, features)
    by = ["cluster"] if "cluster" in df.columns else []
    data = subset_members(df, members_only)
    if isinstance(feature, str):
        return histogram(data, feature, bins, by=by)
    return histogram(_long(data, features, *by), "x", bins, by=["feature", *by])


def prob_histogram(df: DataFrame, bins: int = 30, members_only: bool = False) -> DataFrame:
    require_columns(df, ["prob"])
    return histogram(subset_members(df, members_only), "prob", bins)


def prob_cdf(df: DataFrame, members_only: bool = False, key: str = "row_id") -> DataFrame:
    """``prob, cdf``: one step per row, from 0 for the first to 1 for the last."""
    require_columns(df, ["prob"])
    rows = subset_members(df, members_only).select(key, clean(F.col("prob").cast("double")).alias("prob"))
    placed = positions(rows.dropna("any"), F.col("prob"), F.col(key))
    last = placed.agg(F.max("position")).scalar()
    return placed.select(
        key, "prob", F.coalesce(F.try_divide(F.col("position"), last), F.lit(0.0)).alias("cdf")
    )


# Hexagonal density


def _nonsingular(lo: Column, hi: Column) -> tuple[Column, Column]:
    """A range of zero width grows by a tenth of its value, or by 0.1 around zero."""
    grow = F.when(lo != hi, 0.0).when(lo == 0, 0.1).otherwise(0.1 * F.greatest(F.abs(lo), F.abs(hi)))
    return lo - grow, hi + grow


def hexbin(df: DataFrame, x: str, y: str, gridsize: int) -> DataFrame:
    """``cell_x, cell_y, lattice, n, log10_n`` of the non-empty hexagons.

    Two lattices of rectangles, the second offset by half a cell; each point
    belongs to the nearer centre.
    """
    rows = filter_finite_pairs(
        df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "x", "y"
    )
    x_lo, x_hi = _nonsingular(F.min("x"), F.max("x"))
    y_lo, y_hi = _nonsingular(F.min("y"), F.max("y"))
    pad = 1e-9 * (x_hi - x_lo)
    frame = rows.agg(
        F.struct(
            (x_lo - pad).alias("x0"),
            (((x_hi + pad) - (x_lo - pad)) / gridsize).alias("sx"),
            y_lo.alias("y0"),
            ((y_hi - y_lo) / hex_rows(gridsize)).alias("sy"),
        )
    ).scalar()
    placed = rows.withColumn("f", frame).select(
        ((F.col("x") - F.col("f.x0")) / F.col("f.sx")).alias("u"),
        ((F.col("y") - F.col("f.y0")) / F.col("f.sy")).alias("v"),
    ).withColumn("lattice", hex_lattice(F.col("u"), F.col("v")))
    whole = F.col("lattice") == 1
    cells = placed.groupBy(
        "lattice",
        F.when(whole, F.rint("u")).otherwise(F.floor("u").cast("double")).alias("i"),
        F.when(whole, F.rint("v")).otherwise(F.floor("v").cast("double")).alias("j"),
    ).agg(F.count("*").alias("n"))
    half = F.when(whole, 0.0).otherwise(0.5)
    return cells.withColumn("f", frame).select(
        ((F.col("i") + half) * F.col("f.sx") + F.col("f.x0")).alias("cell_x"),
        ((F.col("j") + half) * F.col("f.sy") + F.col("f.y0")).alias("cell_y"),
        "lattice",
        "n",
        F.log10("n").alias("log10_n"),
    )


def _plane_hexbin(x: str, y: str, gridsize: int, members_only: bool):
    def build(df: DataFrame, members_only: bool = members_only, gridsize: int = gridsize) -> DataFrame:
        require_columns(df, (x, y))
        return hexbin(subset_members(df, members_only), x, y, gridsize)

    build.__doc__ = f"Hexagonal density of ({x}, {y})."
    return build


sky_hexbin = _plane_hexbin("ra", "dec", 80, False)
pm_hexbin = _plane_hexbin("pmra", "pmdec", 70, True)
cmd_hexbin = _plane_hexbin("color", "M_G", 60, True)


# Points and overlays


def _points(df: DataFrame, x: str, y: str, color_by: str | None, reference: DataFrame | None) -> DataFrame:
    require_columns(df, (x, y))
    colored = color_by is not None and color_by in df.columns
    shown = [x, y] + ([color_by] if colored else [])
    points = df.select(*shown, F.lit("catalog").alias("source"))
    if reference is None or not has_columns(reference, (x, y)):
        return points
    listed = reference.select(x, y, F.lit("reference").alias("source"))
    return points.unionByName(listed, allowMissingColumns=True)


def sky_points(df, members_only=False, color_by=None, reference=None) -> DataFrame:
    return _points(subset_members(df, members_only), "ra", "dec", color_by, reference)


def pm_points(df, members_only=False, color_by=None, reference=None) -> DataFrame:
    return _points(subset_members(df, members_only), "pmra", "pmdec", color_by, reference)


def cmd_points(df, members_only=True, color_by=None, reference=None) -> DataFrame:
    return _points(subset_members(df, members_only), "color", "M_G", color_by, reference)


def _overlay(df: DataFrame, reference: DataFrame, x: str, y: str) -> DataFrame:
    return _points(df, x, y, None, require_columns(reference, (x, y)))


def overlay_sky(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Catalogue and reference positions, told apart by ``source``."""
    return _overlay(df, reference, "ra", "dec")


def overlay_pm(df: DataFrame, reference: DataFrame) -> DataFrame:
    return _overlay(df, reference, "pmra", "pmdec")


def overlay_cmd(df: DataFrame, reference: DataFrame) -> DataFrame:
    return _overlay(df, reference, "color", "M_G")


def sky_vectors(df: DataFrame, members_only: bool = True, sample: int = 800, key: str = "row_id") -> DataFrame:
    """Position and motion of at most ``sample`` rows."""
    require_columns(df, ("ra", "dec", "pmra", "pmdec"))
    data = subset_members(df, members_only)
    data = sample_rows(data, sample, key) if sample else data
    return data.select(key, "ra", "dec", "pmra", "pmdec")


def ruwe_vs_g(df: DataFrame, members_only: bool = True) -> DataFrame | None:
    """Magnitude and ``ruwe``; None when a column is absent."""
    g = next((c for c in ("phot_g_mean_mag", "g", "gmag") if c in df.columns), None)
    if g is None or "ruwe" not in df.columns:
        return None
    return subset_members(df, members_only).select(F.col(g).alias("phot_g_mean_mag"), "ruwe")


def mg_vs_parallax(df: DataFrame) -> DataFrame:
    return require_columns(df, ("parallax", "M_G")).filter("is_member").select("parallax", "M_G")


def covariance_ellipse(df: DataFrame, x: str, y: str, n_sigma: float = 2.0) -> DataFrame:
    """One row: centre, full axes and direction of the covariance ellipse.

    The eigenvalues of a 2 x 2 matrix in closed form. The angle is that of the
    long axis, which has no sign, in (-90, 90]. Under five finite rows there is
    no ellipse: NULL centre, zero axes.
    """
    rows = filter_finite_pairs(df, x, y)
    m = rows.agg(
        F.count("*").alias("n"),
        F.avg(x).alias("mx"),
        F.avg(y).alias("my"),
        F.var_samp(x).alias("xx"),
        F.var_samp(y).alias("yy"),
        F.covar_samp(x, y).alias("xy"),
    )
    middle = (F.col("xx") + F.col("yy")) / 2
    radius = F.sqrt(F.pow((F.col("xx") - F.col("yy")) / 2, 2) + F.pow(F.col("xy"), 2))
    enough = F.col("n") >= 5
    angle = F.degrees(0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")))
    return m.select(
        "n",
        F.when(enough, F.col("mx")).alias("center_x"),
        F.when(enough, F.col("my")).alias("center_y"),
        F.when(enough, 2 * n_sigma * F.sqrt(middle + radius)).otherwise(0.0).alias("width"),
        F.when(enough, 2 * n_sigma * F.sqrt(F.greatest(middle - radius, F.lit(0.0)))).otherwise(0.0).alias("height"),
        F.when(enough, angle).otherwise(0.0).alias("angle"),
    )


# Shapes by cluster


def _side_by_side(df: DataFrame, features: list[str]) -> DataFrame:
    """``cluster, f0, f1, …``: the features by their places."""
    return df.select("cluster", *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)])


def _unpivoted(wide: DataFrame, features: list[str], columns: dict[str, str]) -> DataFrame:
    """``feature, cluster`` and ``columns``, each from the column of ``wide`` that its pattern names for the feature's place."""
    records = [
        F.struct(F.lit(c).alias("feature"), *[F.col(of.format(f"f{i}")).alias(name) for name, of in columns.items()])
        for i, c in enumerate(features)
    ]
    return wide.select("cluster", F.inline(F.array(*records)))


def member_shapes(df: DataFrame, feature: str | list[str]) -> DataFrame:
    """``feature, cluster, n, lo, hi, std, q1, med, q3`` of the members' values, all features side by side."""
    features = [feature] if isinstance(feature, str) else list(feature)
    require_columns(df, (*features, "cluster"))
    wide = _side_by_side(df.filter("is_member"), features)
    profile = group_profile(wide, ["cluster"], {f"f{i}": [0.25, 0.5, 0.75] for i in range(len(features))})
    named = {"n": "{}_n", "lo": "{}_min", "hi": "{}_max", "std": "{}_std", "q1": "{}_q0", "med": "{}_q1", "q3": "{}_q2"}
    return keep(_unpivoted(profile, features, named).filter("n > 0"), "shapes")


def _member_values(df: DataFrame, feature: str | list[str]) -> tuple[DataFrame, list[str]]:
    """Members' values as ``x`` and the columns they are grouped by."""
    features = [feature] if isinstance(feature, str) else list(feature)
    require_columns(df, (*features, "cluster"))
    rows = _long(df.filter("is_member"), features, "cluster")
    return (rows.drop("feature"), ["cluster"]) if isinstance(feature, str) else (rows, ["feature", "cluster"])


def box_stats(df: DataFrame, feature: str | list[str], shapes: DataFrame | None = None) -> DataFrame:
    """Members per cluster: quartiles, whiskers within 1.5 IQR, number of outliers.

    For a list of features the result has a ``feature`` column too. ``shapes`` is what
    :func:`member_shapes` found for the same features, if it is known already.
    """
    rows, by = _member_values(df, feature)
    shapes = member_shapes(df, feature) if shapes is None else shapes
    quartiles = shapes.select(*by, "q1", "med", "q3")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    low, high = F.col("q1") - reach, F.col("q3") + reach
    x = F.col("x")
    edges = (
        rows.join(quartiles, by)
        .groupBy(*by)
        .agg(
            F.min(F.when(x >= low, x)).alias("lo_in"),
            F.max(F.when(x <= high, x)).alias("hi_in"),
            F.count_if((x < low) | (x > high)).alias("n_outliers"),
        )
    )
    return quartiles.join(edges, by).select(
        *by,
        "q1",
        "med",
        "q3",
        F.least("lo_in", "q1").alias("whisker_lo"),
        F.greatest("hi_in", "q3").alias("whisker_hi"),
        "n_outliers",
    )


HELD_GROUPS = 1024


def _kernel_sums(rows: DataFrame, by: list[str], points: int) -> DataFrame:
    """``by, grid_i, s``: the kernels of all values at each place of their group's grid.

    ``rows`` has ``x`` and the group's ``lo, hi, h``. A task adds each batch up in one vector a group and sends on
    the vectors, those of ``HELD_GROUPS`` groups at a time.
    """
    spread = np.arange(points) / max(points - 1, 1)

    def add(batches):
        held: dict[tuple, np.ndarray] = {}

        def rest():
            keys = list(held)
            frame = pd.DataFrame(keys, columns=by)
            frame["s"] = [held[k] for k in keys]
            held.clear()
            return frame

        for pdf in batches:
            for key, part in pdf.groupby(by, sort=False):
                lo, hi, h = part[["lo", "hi", "h"]].iloc[0]
                grid = lo + spread * (hi - lo)
                grid[-1] = hi
                x = part["x"].to_numpy()
                total = held.setdefault(key, np.zeros(points))
                for start in range(0, len(x), 512):  # a block that stays in the processor's cache
                    z = grid[:, None] - x[None, start : start + 512]
                    z /= h
                    z *= z
                    z *= -0.5
                    total += np.exp(z, out=z).sum(axis=1)
            if len(held) >= HELD_GROUPS:
                yield rest()
        if held:
            yield rest()

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "s array<double>"])
    sums = rows.select(*by, "x", "lo", "hi", "h").mapInPandas(add, schema)
    return sums.select(*by, F.posexplode("s").alias("grid_i", "s")).groupBy(*by, "grid_i").agg(F.sum("s").alias("s"))


def violin_density(
    df: DataFrame, feature: str | list[str], points: int = 100, shapes: DataFrame | None = None
) -> DataFrame:
    """Members per cluster: Gaussian kernel density on an even grid, and the median.

    What is shuffled is one vector of the grid a group and task, not the rows. For a list of
    features the result has a ``feature`` column too. ``shapes`` is as in :func:`box_stats`.
    """
    rows, by = _member_values(df, feature)
    shapes = member_shapes(df, feature) if shapes is None else shapes
    h = F.col("std") * F.pow(F.col("n"), F.lit(-0.2))
    shape = shapes.select(*by, "n", "lo", "hi", h.alias("h"), F.col("med").alias("median"))
    sums = _kernel_sums(rows.join(shape.filter(F.col("lo") < F.col("hi")), by), by, points)
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    at = F.when(F.col("grid_i") == points - 1, F.col("hi")).otherwise(F.col("lo") + F.col("grid_i") * step)
    norm = F.col("n") * F.col("h") * math.sqrt(2 * math.pi)
    return (
        shape.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("grid_i"))
        .join(sums, [*by, "grid_i"], "left")
        .select(
            *by,
            "grid_i",
            at.alias("x"),
            # One value only: the density is drawn as 1 at that value.
            F.when(F.col("lo") == F.col("hi"), 1.0).otherwise(F.col("s") / norm).alias("density"),
            "median",
        )
    )


# Curves


def members_vs_threshold(df: DataFrame, thresholds: Iterable[float] | None = None) -> DataFrame:
    """``threshold, n``: clustered rows at or above each threshold, in one pass."""
    require_columns(df, ("prob", "cluster"))
    cuts = [i * 0.025 for i in range(41)] if thresholds is None else [float(t) for t in thresholds]
    clustered = df.filter(F.col("cluster") >= 0).select(clean(F.col("prob")).alias("prob"))
    counts = [
        F.struct(F.lit(t).alias("threshold"), F.count_if(F.col("prob") >= t).alias("n")) for t in cuts
    ]
    return clustered.agg(F.array(*counts).alias("a")).select(F.inline("a"))


def _circular_mean(angle: Column) -> Column:
    a = F.radians(angle)
    mean = F.degrees(F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a))))
    return F.when(mean < 0, mean + 360.0).otherwise(mean)


def radial_profile(
    df: DataFrame,
    members_only: bool = True,
    center: tuple[float, float] | str | None = None,
    n_bins: int = 25,
) -> DataFrame:
    """``bin, r_lo, r_hi, n, density`` around a centre, out to the 99.5th percentile.

    The centre is given, the median position, or with ``"circular"`` the mean
    position taken around the circle, for fields across 0/360 degrees.
    """
    require_columns(df, ("ra", "dec"))
    data = subset_members(df, members_only).select(clean(F.col("ra")).alias("ra"), clean(F.col("dec")).alias("dec"))
    if isinstance(center, tuple):
        ra0, dec0 = F.lit(float(center[0])), F.lit(float(center[1]))
    elif center == "circular":
        ra0, dec0 = map(F.lit, data.agg(_circular_mean(F.col("ra")), F.avg("dec")).first())
    else:
        medians = group_quantiles(data, [], {"ra": [0.5], "dec": [0.5]})
        ra0, dec0 = map(F.lit, medians.select("ra_q0", "dec_q0").first())
    r = data.select(angular_distance(F.col("ra"), F.col("dec"), ra0, dec0).alias("r"))
    reach = group_quantiles(r, [], {"r": [0.995]}).select("r_q0").scalar()
    bins = histogram(r, "r", n_bins, limits=(F.lit(0.0), reach))
    area = math.pi * (F.col("hi") * F.col("hi") - F.col("lo") * F.col("lo"))
    return bins.select(
        "bin", F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"), "n", F.try_divide(F.col("n"), area).alias("density")
    )


# Panels

PANEL_FEATURES = ("parallax", "_pm_mag", "ruwe", "color", "M_G")


def cluster_panel(df: DataFrame, labels: Iterable[int] | None = None, bins: int = 20) -> DataFrame:
    """``feature, cluster, bin, lo, hi, n, median, mad`` for all clusters at once."""
    df = with_pm_magnitude(df)
    if labels is not None:
        df = df.filter(F.col("cluster").isin(list(labels)))
    features = [c for c in PANEL_FEATURES if c in df.columns]
    wide = keep(_side_by_side(df.filter(F.col("cluster").isNotNull()), features), "panels")
    by, places = ["feature", "cluster"], [f"f{i}" for i in range(len(features))]
    notes = _unpivoted(median_mad(wide, ["cluster"], places), features, {"median": "{}_median", "mad": "{}_mad"})
    values = _long(wide.withColumnsRenamed(dict(zip(places, features))), features, "cluster")
    return histogram(values, "x", bins, by=by).join(notes, by)


def cluster_panel_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """Per cluster, noise included: two coordinates of its rows, with the probability where there is one."""
    shown = [c for c in ("cluster", x, y, "prob") if c in df.columns]
    return require_columns(df, ("cluster", x, y)).filter(F.col("cluster").isNotNull()).select(*shown)


def cluster_panel_centers(df: DataFrame, max_arrows: int = 500) -> DataFrame:
    """Per cluster, noise included: mean position, mean motion, number of arrows drawn."""
    means = [F.avg(c).alias(f"{c}_mean") for c in ("ra", "dec", "pmra", "pmdec") if c in df.columns]
    return (
        df.filter(F.col("cluster").isNotNull())
        .groupBy("cluster")
        .agg(F.least(F.count("*"), F.lit(max_arrows).cast("bigint")).alias("n_arrows"), *means)
    )


def cluster_panel_vectors(df: DataFrame, max_arrows: int = 500, key: str = "row_id") -> DataFrame:
    """Per cluster: position and motion of at most ``max_arrows`` rows."""
    return sample_rows(df, max_arrows, key, by="cluster").select("cluster", key, "ra", "dec", "pmra", "pmdec")
