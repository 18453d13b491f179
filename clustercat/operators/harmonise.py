"""Map source columns to roles, filter on quality, derive features.

All of it is projection and filter: one stage, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustercat.functions.numeric import clean, coerce, strict
from clustercat.functions.sky import absolute_magnitude, color_index, pm_magnitude
from clustercat.operators.quantiles import group_quantiles

# Core roles, spellings of the same role in result files.
CORE = ("parallax", "pmra", "pmdec")
MAGNITUDES = ("g", "gmag")
ALIASES = (
    ("probability", "prob"),
    ("cluster_label", "cluster"),
    ("BP_RP", "color"),
    ("bp_rp", "color"),
    ("abs_g", "M_G"),
    ("RA", "ra"),
    ("DEC", "dec"),
)


def has_columns(df: DataFrame, columns: Iterable[str]) -> bool:
    return set(columns) <= set(df.columns)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Pass ``df`` through, or raise KeyError naming what is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df


def rename_exact(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Rename by exact spelling, whatever the session's case sensitivity."""
    return df.toDF(*[renames.get(c, c) for c in df.columns])


def rename_by_map(df: DataFrame, mapping: Mapping[str, str] | None) -> DataFrame:
    """Rename source columns that are present; ``mapping`` is role to source name."""
    renames = {source: role for role, source in (mapping or {}).items() if source in df.columns}
    return rename_exact(df, renames)


def rename_aliases(df: DataFrame) -> DataFrame:
    """Rename known spellings when the role itself is absent; the first spelling wins."""
    renames: dict[str, str] = {}
    for alias, role in ALIASES:
        if alias in df.columns and role not in df.columns and role not in renames.values():
            renames[alias] = role
    return rename_exact(df, renames)


def with_pm_magnitude(df: DataFrame) -> DataFrame:
    """Add ``_pm_mag`` unless it is there or a component is missing."""
    if "_pm_mag" in df.columns or not has_columns(df, ("pmra", "pmdec")):
        return df
    return df.withColumn("_pm_mag", pm_magnitude(F.col("pmra"), F.col("pmdec")))


def alias_harmonise(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Result table ready for reports: role names, ``_pm_mag`` and ``is_member``."""
    df = with_pm_magnitude(rename_aliases(df))
    if "is_member" in df.columns:
        return df
    tests = []
    if "cluster" in df.columns:
        tests.append(F.col("cluster") >= 0)
    if "prob" in df.columns:
        tests.append(clean(F.col("prob")) >= threshold)
    member = F.lit(bool(tests))
    for test in tests:
        member = member & F.coalesce(test, F.lit(False))
    return df.withColumn("is_member", member)


def coerce_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Columns to double; bad text becomes NULL."""
    return df.withColumns({c: coerce(F.col(c)) for c in columns if c in df.columns})


def strict_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Columns to double; bad text is an error."""
    return df.withColumns({c: strict(F.col(c)) for c in columns if c in df.columns})


def filter_positive_parallax(df: DataFrame) -> DataFrame:
    return df.filter(F.col("parallax") > 0)


def filter_quality(df: DataFrame, ruwe_max: float | None = 1.4) -> DataFrame:
    """Keep ``ruwe`` strictly below the limit; no limit or no column keeps all."""
    if ruwe_max is None or "ruwe" not in df.columns:
        return df
    return df.filter(F.col("ruwe") < float(ruwe_max))


def dropna_core(df: DataFrame) -> DataFrame:
    present = [c for c in CORE if c in df.columns]
    return df.dropna(subset=present) if present else df


def unit_rescale(df: DataFrame, factors: Mapping[str, float] | None) -> DataFrame:
    """Multiply parallax by ``factors['parallax']`` and both motions by ``factors['pm']``."""
    factors = factors or {}
    changes = {}
    if "parallax" in factors and "parallax" in df.columns:
        changes["parallax"] = F.col("parallax") * float(factors["parallax"])
    if "pm" in factors and has_columns(df, ("pmra", "pmdec")):
        for c in ("pmra", "pmdec"):
            changes[c] = F.col(c) * float(factors["pm"])
    return df.withColumns(changes) if changes else df


def add_color(df: DataFrame) -> DataFrame:
    if not has_columns(df, ("bp", "rp")):
        return df
    return df.withColumn("color", color_index(strict(F.col("bp")), strict(F.col("rp"))))


def add_absolute_magnitude(
    df: DataFrame,
    parallax: str = "parallax",
    magnitudes: Iterable[str] = MAGNITUDES,
    out: str = "M_G",
) -> DataFrame:
    """Add ``out`` from the first magnitude present; nothing to use, nothing added."""
    g = next((c for c in magnitudes if c in df.columns), None)
    if g is None or parallax not in df.columns:
        return df
    return df.withColumn(out, absolute_magnitude(strict(F.col(parallax)), strict(F.col(g))))


def harmonize_catalog(
    df: DataFrame,
    mapping: Mapping[str, str] | None = None,
    ruwe_max: float | None = 1.4,
    drop_missing: bool = False,
    rescale: Mapping[str, float] | None = None,
) -> DataFrame:
    """Rename, check the core, filter, rescale, derive ``color`` and ``M_G``."""
    df = require_columns(rename_by_map(df, mapping), CORE)
    numeric = [*CORE] + (["ruwe"] if ruwe_max is not None else [])
    df = strict_numeric(df, numeric)
    df = filter_quality(filter_positive_parallax(df), ruwe_max)
    df = add_absolute_magnitude(add_color(unit_rescale(df, rescale)))
    return dropna_core(df) if drop_missing else df


def harmonize_reference(
    df: DataFrame,
    mapping: Mapping[str, str] | None = None,
    ruwe_max: float | None = None,
    drop_missing: bool = False,
) -> DataFrame:
    """The same chain for the reference list; nothing is required, no colour is derived."""
    df = rename_by_map(df, mapping)
    if ruwe_max is not None:
        df = filter_quality(strict_numeric(df, ["ruwe"]), ruwe_max)
    if "parallax" in df.columns:
        df = filter_positive_parallax(strict_numeric(df, ["parallax"]))
    df = add_absolute_magnitude(df)
    return dropna_core(df) if drop_missing else df


def unit_medians(df: DataFrame) -> DataFrame:
    """One row: the medians of parallax and motion that the unit checks compare."""
    return group_quantiles(with_pm_magnitude(df), [], {"parallax": [0.5], "_pm_mag": [0.5]})


def unit_sanity(df: DataFrame, medians: DataFrame | None = None) -> DataFrame:
    """One row: median parallax and motion, and whether both look too small.

    ``medians`` are those of ``df``, if they are known already.
    """
    medians = unit_medians(df) if medians is None else medians
    return medians.select(
        F.col("parallax_q0").alias("median_parallax"),
        F.col("_pm_mag_q0").alias("median_pm"),
        F.coalesce((F.col("parallax_q0") < 2.0) & (F.col("_pm_mag_q0") < 10.0), F.lit(False)).alias("suspicious"),
    )


def unit_ratio_check(catalog: DataFrame, reference: DataFrame, medians: DataFrame | None = None) -> DataFrame:
    """One row: reference over catalogue medians; flagged when both lie in (2, 100).

    ``medians`` are the catalogue's, if they are known already.
    """
    ours = unit_medians(catalog) if medians is None else medians
    theirs = unit_medians(reference)
    ratios = ours.withColumn("r", theirs.select(F.struct("*")).scalar()).select(
        F.try_divide(F.col("r.parallax_q0"), F.col("parallax_q0")).alias("parallax_ratio"),
        F.try_divide(F.col("r._pm_mag_q0"), F.col("_pm_mag_q0")).alias("pm_ratio"),
    )
    inside = [(F.col(c) > 2) & (F.col(c) < 100) for c in ("parallax_ratio", "pm_ratio")]
    return ratios.withColumn("suspicious", F.coalesce(inside[0] & inside[1], F.lit(False)))
