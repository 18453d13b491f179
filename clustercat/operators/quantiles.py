"""Exact quantiles of groups of any size, and moments beside them, in three readings of the rows.

The built-in exact percentile holds every distinct value of a group in one
task. Here the first reading keeps, for all columns side by side, moments and mergeable
sketches, per slice of a group and then per group; they bracket each wanted rank within about a
hundredth of the group. The second reading counts, again for all columns from the row as it is, what lies
below the brackets; the third takes out the rows that are inside one and counts each distinct value.
Those few values are summed up in the pieces of a range partitioning, so neither a large group nor a
wide bracket makes one large task. The answer is read off the counts, so it is
exact; the sketch only decides how little has to be sorted.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clustercat.functions.numeric import clean
from clustercat.storage import keep

SKETCH = 4096  # its ranks are off by less than a part in a thousand
STEPS = 512
SLACK = 2  # steps on either side of the rank, four times what the sketch may be off
SLICES = 64


def _joined_moments(parts: Column) -> Column:
    """``n, mean, m2`` of all values from those of their parts, m2 being the squared deviations' sum."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def join(done, part):
        n = done["n"] + part["n"]
        apart = part["mean"] - done["mean"]
        return F.struct(
            n.alias("n"),
            (done["mean"] + apart * part["n"] / n).alias("mean"),
            (done["m2"] + part["m2"] + apart * apart * done["n"] * part["n"] / n).alias("m2"),
        )

    return F.aggregate(F.filter(parts, lambda p: p["n"] > 0), start, join)


def _profiled(values: DataFrame, by: list[str], sketched: list[bool], moments: bool) -> DataFrame:
    """``_rows`` per group; per column i ``_n{i}``, ``_grid{i}``, the values at even steps of rank, and moments."""
    first, then = [F.count(F.lit(1)).alias("_rows")], [F.sum("_rows").alias("_rows")]
    ranks = F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)])
    out = ["_rows"]
    for i, wanted in enumerate(sketched):
        x = f"_x{i}"
        first.append(F.count(x).alias(f"_n{i}"))
        then.append(F.sum(f"_n{i}").alias(f"_n{i}"))
        out.append(f"_n{i}")
        if wanted:
            first.append(F.kll_sketch_agg_double(x, F.lit(SKETCH)).alias(f"_s{i}"))
            then.append(F.kll_merge_agg_double(f"_s{i}", F.lit(SKETCH)).alias(f"_s{i}"))
            out.append(F.when(F.col(f"_n{i}") > 0, F.kll_sketch_get_quantile_double(f"_s{i}", ranks)).alias(f"_grid{i}"))
        if moments:
            first += [F.avg(x).alias(f"_m{i}"), F.var_pop(x).alias(f"_v{i}"), F.min(x).alias(f"_min{i}"), F.max(x).alias(f"_max{i}")]
            n = F.col(f"_n{i}").cast("double")
            part = F.struct(n.alias("n"), F.col(f"_m{i}").alias("mean"), (n * F.col(f"_v{i}")).alias("m2"))
            then += [F.collect_list(part).alias(f"_p{i}"), F.min(f"_min{i}").alias(f"_min{i}"), F.max(f"_max{i}").alias(f"_max{i}")]
            out += [_joined_moments(F.col(f"_p{i}")).alias(f"_p{i}"), f"_min{i}", f"_max{i}"]
    sliced = values.groupBy(*by, F.pmod(F.spark_partition_id(), F.lit(SLICES)).alias("_slice")).agg(*first)
    return sliced.groupBy(*by).agg(*then).select(*by, *out)


def _with(rows: DataFrame, facts: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """``rows`` with columns of their group's row of ``facts``; without groups there is one such row."""
    if by:
        return rows.join(facts.select(*by, *columns), by)
    row = facts.select(F.struct(*columns)).scalar()
    return rows.withColumn("_row", row).select(*rows.columns, *[F.col(f"_row.{c}").alias(c) for c in columns])


def _beside(rows: DataFrame, facts: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """As :func:`_with`, but the one row there is without groups is read now: a plan that names many of its values stays small."""
    if by:
        return rows.join(facts.select(*by, *columns), by)
    row = facts.select(*columns).first()
    return rows.select("*", *[F.lit(row[c] if row else None).cast(facts.schema[c].dataType).alias(c) for c in columns])


def _ranked(values: DataFrame, brackets: DataFrame, by: list[str], columns: list[int]) -> DataFrame:
    """``_target, _value``: NULL where a bracket does not hold its rank.

    ``brackets`` has, per group and for each target t, ``_low{t}, _high{t}, _place{t}``, or NULL if it
    isn't wanted there. ``columns`` are the targets' columns.
    """
    x = [F.col(f"_x{i}") for i in columns]
    every = range(len(columns))
    known = _beside(values, brackets, by, *[f"_{side}{t}" for t in every for side in ("low", "high")])
    under = known.groupBy(*by).agg(*[F.count_if(x[t] < F.col(f"_low{t}")).alias(f"_b{t}") for t in every])
    targets = F.array(*[F.struct(F.lit(t).alias("_target"), F.col(f"_place{t}").alias("_place"), F.col(f"_b{t}").alias("_below")) for t in every])
    targets = _beside(under, brackets, by, *[f"_place{t}" for t in every]).select(*by, F.inline(targets)).filter("_place is not null")
    # Most rows are in no bracket and go no further than this filter.
    inside = [x[t].between(F.col(f"_low{t}"), F.col(f"_high{t}")) for t in every]
    held = F.posexplode(F.array(*[F.when(inside[t], x[t]) for t in every]))
    some = known.filter(reduce(Column.__or__, inside)).select(*by, held.alias("_target", "_x")).filter("_x is not null")
    keys = [*by, "_target"]
    pieces = some.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_count"))
    pieces = keep(pieces.repartitionByRange(*keys, "_x").withColumn("_piece", F.spark_partition_id()), "pieces")
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.groupBy(*keys, "_piece").agg(F.sum("_count").alias("_sum"))
    starts = starts.select(*keys, "_piece", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, "_piece").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ends = pieces.withColumn("_end", F.sum("_count").over(within)).join(starts, [*keys, "_piece"])
    ends = ends.select(*keys, "_x", (F.col("_start") + F.col("_end")).alias("_end"))
    floor, ceil = F.floor("_place"), F.ceil("_place")
    end = F.col("_below") + F.col("_end")
    found = targets.join(ends, keys, "left").groupBy(*keys).agg(
        F.max("_place").alias("_place"),
        F.min(F.when((F.col("_below") <= floor) & (end > floor), F.struct("_end", "_x"))).alias("_a"),
        F.min(F.when((F.col("_below") <= floor) & (end > ceil), F.struct("_end", "_x"))).alias("_b"),
    )
    low, high = F.col("_a._x"), F.col("_b._x")
    return found.select(*keys, (low + (high - low) * (F.col("_place") - floor)).alias("_value"))


def group_profile(
    df: DataFrame, by: Iterable[str], columns: Mapping[str, Iterable[float]], moments: bool = True
) -> DataFrame:
    """Moments and linearly interpolated quantiles per group.

    ``columns`` maps a column to its probabilities, of which there may be none. The result has ``by``,
    ``_rows`` and, per column, ``{c}_n``, with ``moments`` ``{c}_mean``, ``{c}_std`` (of a sample), ``{c}_min`` and
    ``{c}_max``, and ``{c}_q0``, ``{c}_q1``, … in the order given. Missing values are skipped; a group without
    values gets NULL, and rows without a group are left out.
    """
    by = list(by)
    columns = {c: [float(p) for p in ps] for c, ps in columns.items()}
    df = df.dropna("any", subset=by) if by else df
    plain = df.select(*by, *[F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    values = plain.select(*by, *[clean(F.col(f"_x{i}")).alias(f"_x{i}") for i in range(len(columns))])
    wanted = [(i, p) for i, ps in enumerate(columns.values()) for p in ps]

    def bracket(t: int, whole: bool, when: Column) -> list[Column]:
        i, p = wanted[t]
        n, grid = F.col(f"_n{i}"), F.col(f"_grid{i}")
        # A rank of a small group lies between two of its values, which may be steps apart.
        spare = F.lit(STEPS) if whole else SLACK + F.ceil(2 * STEPS / n)
        at = lambda k: F.element_at(grid, (F.least(F.greatest(k, F.lit(0)), F.lit(STEPS)) + 1).cast("int"))
        low, high = at(F.floor(F.lit(p * STEPS)) - spare), at(F.ceil(F.lit(p * STEPS)) + spare)
        sides = {"low": low, "high": high, "place": p * (n - 1)}
        return [F.when(when & (n > 0), side).alias(f"_{name}{t}") for name, side in sides.items()]

    profile = _profiled(values, by, [bool(ps) for ps in columns.values()], moments)
    profile = keep(profile.select("*", *[side for t in range(len(wanted)) for side in bracket(t, False, F.lit(True))]), "profile")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    out = [count("_rows").alias("_rows")]
    for i, c in enumerate(columns):
        out.append(count(f"_n{i}").alias(f"{c}_n"))
        if moments:
            n, part = F.col(f"_n{i}"), F.col(f"_p{i}")
            out += [
                F.when(n > 0, part["mean"]).alias(f"{c}_mean"),
                F.when(n > 1, F.sqrt(part["m2"] / (n - 1))).alias(f"{c}_std"),
                F.col(f"_min{i}").alias(f"{c}_min"), F.col(f"_max{i}").alias(f"{c}_max"),
            ]
    if not wanted:
        return profile.select(*by, *out)

    of = [i for i, _ in wanted]
    found = keep(_ranked(plain, profile, by, of), "quantiles")  # NaN is above every bracket
    missed = found.filter("_value is null")
    if not missed.isEmpty():  # a sketch was off by more than it should be: these look at all values
        again = missed.groupBy(*by).agg(F.collect_list("_target").alias("_again"))
        all_values = [side for t in range(len(of)) for side in bracket(t, True, F.array_contains("_again", t))]
        whole = (profile.join(again, by) if by else _with(profile, again, by, "_again")).select(*by, *all_values)
        found = found.filter("_value is not null").unionByName(keep(_ranked(plain, whole, by, of), "quantiles"))
    names = [f"{c}_q{j}" for c, ps in columns.items() for j in range(len(ps))]
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("_target") == t, F.col("_value"))).alias(name) for t, name in enumerate(names)])
    if by:
        return profile.join(wide, by, "left").select(*by, *out, *names)
    return _with(profile, wide, by, *names).select(*out, *names)


def group_quantiles(df: DataFrame, by: Iterable[str], columns: Mapping[str, Iterable[float]]) -> DataFrame:
    """Linearly interpolated quantiles per group: ``by``, per column ``{c}_n`` and ``{c}_q0``, … (see :func:`group_profile`)."""
    return group_profile(df, by, columns, moments=False).drop("_rows")


def median_mad(df: DataFrame, by: Iterable[str], columns: Iterable[str]) -> DataFrame:
    """Per group and column: ``{c}_median`` and ``{c}_mad``, missing values skipped."""
    by, columns = list(by), list(columns)
    medians = group_quantiles(df, by, {c: [0.5] for c in columns})
    medians = keep(medians.select(*by, *[F.col(f"{c}_q0").alias(f"{c}_median") for c in columns]), "medians")
    slim = df.select(*by, *columns)
    if by:
        off = slim.join(medians, by).select(
            *by, *[F.abs(F.col(c) - F.col(f"{c}_median")).alias(c) for c in columns]
        )
    else:
        row = medians.first()  # one row of medians
        off = slim.select(*[F.abs(F.col(c) - F.lit(row[f"{c}_median"])).alias(c) for c in columns])
    mads = group_quantiles(off, by, {c: [0.5] for c in columns})
    mads = mads.select(*by, *[F.col(f"{c}_q0").alias(f"{c}_mad") for c in columns])
    if by:
        return medians.join(mads, by)
    return medians.withColumn("m", mads.select(F.struct("*")).scalar()).select(*medians.columns, "m.*")


def robust_limits(df: DataFrame, column: str, lo: float = 0.5, hi: float = 99.5) -> DataFrame:
    """One row ``lo, hi``: percentiles; equal ones widened by 1; (0, 1) without values."""
    q = group_quantiles(df, [], {column: [lo / 100, hi / 100]})
    low, high = F.col(f"{column}_q0"), F.col(f"{column}_q1")
    pad = F.when(low == high, 1.0).otherwise(0.0)
    return q.select(
        F.coalesce(low - pad, F.lit(0.0)).alias("lo"), F.coalesce(high + pad, F.lit(1.0)).alias("hi")
    )
