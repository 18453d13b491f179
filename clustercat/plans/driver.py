"""The driver's tables seen as a catalogue, and one query per operator over them.

Each query runs over whole tables. Computed doubles are rounded to six digits,
because the last bits of a sum depend on the order of its terms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import cached_property, partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clustercat.functions import numeric, sky
from clustercat.operators.density import components, neighbours, selection
from clustercat.operators import compare, distributions, harmonise, members, ranking, scale, summary
from clustercat.plans import jobs
from clustercat.operators.quantiles import group_quantiles, median_mad, robust_limits
from clustercat.operators.silhouette import silhouette_exact, silhouette_sampled
from clustercat.sources import tables
from clustercat.storage import new_path, unbroadcast
from clustercat.together import together

CATALOG_MAP = {
    "ra": "ra", "dec": "dec", "parallax": "parallax", "pmra": "pmra", "pmdec": "pmdec",
    "g": "phot_g_mean_mag", "bp": "phot_bp_mean_mag", "rp": "phot_rp_mean_mag", "ruwe": "ruwe",
}
REFERENCE_MAP = {
    "ra": "RA_ICRS", "dec": "DE_ICRS", "parallax": "plx", "pmra": "pmRA", "pmdec": "pmDE",
    "gmag": "Gmag", "color": "Bp-Rp",
}
FEATURES = ["parallax", "pmra", "pmdec", "color", "M_G"]
SUMMARY_FEATURES = FEATURES + ["ruwe"]
CENTER = (55.0, 22.0)
GRID = 64.0

# The same text runs on both engines.
RAW_SQL = """
select event_id as row_id,
       50 + cast(event_id % 997 as double) / 100 as ra,
       20 + cast(event_id % 499 as double) / 100 as dec,
       case when event_id % 97 = 0 then null else value / 40 end as parallax,
       cast(user_id as double) / 5 as pmra,
       0 - cast(event_id % 613 as double) / 10 as pmdec,
       8 + cast(event_id % 1201 as double) / 100 as phot_g_mean_mag,
       9 + cast(event_id % 701 as double) / 200 as phot_bp_mean_mag,
       8 + cast(event_id % 409 as double) / 150 as phot_rp_mean_mag,
       cast(80 + event_id % 127 as double) / 100 as ruwe,
       case when event_id % 50 = 0 then 'abc' else cast(value as varchar(40)) end as reading,
       case event_type when 'click' then 0 when 'view' then 1 when 'purchase' then 2 else -1 end as label,
       cast(event_id % 1001 as double) / 1000 as probability
from events
"""
REF_RAW_SQL = """
select p_partkey as row_id,
       55 + cast(p_partkey % 211 as double) / 100 as RA_ICRS,
       22 + cast(p_size as double) / 50 as DE_ICRS,
       p_retailprice / 130 as plx,
       19 + cast(p_size as double) / 50 as pmRA,
       0 - 44 - cast(p_size as double) / 25 as pmDE,
       9 + cast(p_partkey % 300 as double) / 100 as Gmag,
       1 + cast(p_partkey % 90 as double) / 100 as color
from part
"""


class Tables:
    """The catalogue, its labelled form and the reference list for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def path(self, name: str) -> str:
        """A fresh folder on shared storage, and ``name`` inside it."""
        return f"{new_path(self.spark, 'query')}/{name}"

    @cached_property
    def raw(self) -> DataFrame:
        events = self.read("events")
        return numeric.clean_floats(self.spark.sql(RAW_SQL.replace("from events", "from {events}"), events=events))

    @cached_property
    def clean(self) -> DataFrame:
        return harmonise.harmonize_catalog(self.raw, CATALOG_MAP)

    @cached_property
    def labelled(self) -> DataFrame:
        named = self.clean.withColumnsRenamed({"label": "cluster"})
        return harmonise.alias_harmonise(named, 0.5)

    @cached_property
    def ref_raw(self) -> DataFrame:
        part = self.read("part")
        raw = self.spark.sql(REF_RAW_SQL.replace("from part", "from {part}"), part=part)
        return numeric.clean_floats(raw.withColumnRenamed("color", "Bp-Rp"))

    @cached_property
    def ref(self) -> DataFrame:
        return harmonise.harmonize_reference(self.ref_raw, REFERENCE_MAP)

    @cached_property
    def vectors(self) -> DataFrame:
        """``row_id`` and the catalogue's features, on a grid on which both engines compute equal distances."""
        features = F.array(*[F.floor(F.col(c) * GRID + 0.5) / GRID for c in FEATURES])
        return self.clean.dropna(subset=FEATURES).select("row_id", features.alias("features"))

    @cached_property
    def embeddings(self) -> DataFrame:
        """``row_id, cluster`` and the whole embedding as features."""
        return self.read("embeddings").select(
            F.col("vec_id").alias("row_id"),
            F.col("label").alias("cluster"),
            F.col("embedding").cast("array<double>").alias("features"),
        )


CTE = f"""
with recursive raw as ({RAW_SQL}),
clean as (
  select row_id, ra, dec, parallax, pmra, pmdec, phot_g_mean_mag as g, phot_bp_mean_mag as bp,
         phot_rp_mean_mag as rp, ruwe, reading, label, probability,
         phot_bp_mean_mag - phot_rp_mean_mag as color,
         phot_g_mean_mag + 5 * log10(parallax) - 10 as "M_G"
  from raw where parallax > 0 and ruwe < 1.4),
labelled as (
  select * exclude (label, probability), label as cluster, probability as prob,
         sqrt(pmra * pmra + pmdec * pmdec) as "_pm_mag",
         label >= 0 and probability >= 0.5 as is_member
  from clean),
member as (select * from labelled where is_member),
ref_raw as ({REF_RAW_SQL}),
ref as (
  select row_id, RA_ICRS as ra, DE_ICRS as dec, plx as parallax, pmRA as pmra, pmDE as pmdec,
         Gmag as gmag, color, Gmag + 5 * log10(plx) - 10 as "M_G",
         sqrt(pmRA * pmRA + pmDE * pmDE) as "_pm_mag"
  from ref_raw where plx > 0)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles; adding zero turns -0.0 into 0.0."""
    return df.select(
        [(F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes]
    )


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` as a query, with its SQL if there is one."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: rounded(build(Tables(spark, folder)))
        if sql is not None:
            ORACLE[name] = CTE + sql
        return build

    return register


def r(expression: str, name: str | None = None) -> str:
    """Oracle counterpart of :func:`rounded` for one expression."""
    return f'round({expression}, 6) + 0.0 as "{name or expression}"'


def rs(*columns: str) -> str:
    return ", ".join(r(f'"{c}"', c) for c in columns)


SKY = ("ra", "dec", "parallax", "pmra", "pmdec")
RAW_MAGNITUDES = ("phot_g_mean_mag", "phot_bp_mean_mag", "phot_rp_mean_mag")
REF_COLUMNS = ("ra", "dec", "parallax", "pmra", "pmdec", "gmag", "color")

# Sources and sinks


@query("scan_any", f"select row_id, reading, {rs(*SKY, 'ruwe')} from raw")
def _(t):
    path = t.path("raw.csv")
    columns = ["row_id", "reading", *SKY, "ruwe"]
    t.raw.select(columns).write.option("header", True).option("sep", ";").csv(path)
    return tables.scan_any(t.spark, path).withColumn("row_id", F.col("row_id").cast("bigint"))


@query("load_catalog", f"select row_id, {rs(*SKY, *RAW_MAGNITUDES, 'ruwe')} from raw")
def _(t):
    path = tables.save_table(t.raw, t.path("raw.parquet"))
    return tables.load_catalog(t.spark, path, CATALOG_MAP, key="row_id")


@query(
    "load_reference",
    f"select row_id, {r('RA_ICRS', 'ra')}, {r('DE_ICRS', 'dec')}, {r('plx', 'parallax')}, {r('pmRA', 'pmra')}, "
    f"{r('pmDE', 'pmdec')}, {r('Gmag', 'gmag')}, {rs('color')} from ref_raw",
)
def _(t):
    path = tables.save_table(t.ref_raw, t.path("valid.csv"))
    loaded = tables.load_reference(t.spark, path, REFERENCE_MAP)
    return loaded.withColumn("row_id", F.col("row_id").cast("bigint"))


@query("save_table", f"select row_id, cluster, {rs('prob', *SKY)}, is_member from labelled")
def _(t):
    path = tables.save_table(t.labelled.select("row_id", "cluster", "prob", *SKY, "is_member"), t.path("labelled"))
    return tables.scan_any(t.spark, path).withColumn("row_id", F.col("row_id").cast("bigint"))


@query("latest_output", f"select row_id, cluster, {rs('prob')} from labelled")
def _(t):
    folder = t.path("out")
    tables.save_table(t.clean.select("row_id"), f"{folder}/first.parquet")
    tables.save_table(t.labelled.select("row_id", "cluster", "prob"), f"{folder}/second_clustered.parquet")
    return tables.scan_any(t.spark, tables.latest_output(t.spark, folder))


@query("first_existing_reference", f"select row_id, {rs('ra', 'dec', 'parallax')} from ref")
def _(t):
    folder = t.path("processed")
    t.spark.range(0).write.parquet(folder)
    tables.save_table(t.ref.select("row_id", "ra", "dec", "parallax"), f"{folder}/../interim/valid_clean.parquet")
    return tables.scan_any(t.spark, tables.first_existing_reference(t.spark, folder))


@query("sink_clean", f"select row_id, {rs(*SKY, 'g', 'color', 'M_G', 'ruwe')} from clean")
def _(t):
    path = tables.save_table(t.clean, t.path("clean.parquet"))
    return t.spark.read.parquet(path).select("row_id", *SKY, "g", "color", "M_G", "ruwe")


@query("sink_labeled", f"select row_id, cluster, {rs('prob')}, is_member from labelled")
def _(t):
    path = tables.save_table(t.labelled, t.path("clustered.parquet"))
    return t.spark.read.parquet(path).select("row_id", "cluster", "prob", "is_member")


Z_SQL = """, used as (select row_id, parallax, pmra, pmdec, color, "M_G" from clean
  where parallax is not null and pmra is not null and pmdec is not null and color is not null and "M_G" is not null)"""


def _z(c: str) -> str:
    return f'round(("{c}" - avg("{c}") over ()) / stddev_pop("{c}") over (), 6) + 0.0 as "z_{c}"'


Z_SELECT = f"{Z_SQL} select row_id, {', '.join(_z(c) for c in FEATURES)} from used"


def _unpacked(df: DataFrame) -> DataFrame:
    return df.select(
        "row_id",
        *[F.col("features")[i].alias(f"z_{c}") for i, c in enumerate(FEATURES)],
    )


@query("sink_features", Z_SELECT)
def _(t):
    path = tables.save_table(scale.standardize(t.clean, FEATURES, float32=False), t.path("features.parquet"))
    return _unpacked(t.spark.read.parquet(path))


OVERVIEW_SQL = f"""
select count(*) as n_samples, count(distinct case when cluster >= 0 then cluster end) as n_clusters,
       {r("avg(case when cluster < 0 then 1.0::double else 0 end)", "frac_noise")},
       (select max(n) from (select count(*) as n from labelled where cluster >= 0 group by cluster)) as max_cluster_size,
       {r("avg(prob)", "prob_mean")}, {r("median(prob)", "prob_median")}
from labelled"""


@query("sink_metrics", OVERVIEW_SQL)
def _(t):
    path = tables.save_record(summary.cluster_overview(t.labelled), t.path("overview.json"))
    return t.spark.read.json(path)


CENTROID_MEANS = ", ".join(r(f'avg("{c}")', f"{c}_mean") for c in FEATURES)


@query("sink_summary", f"select cluster, {CENTROID_MEANS} from labelled where cluster >= 0 group by cluster")
def _(t):
    path = tables.save_table(summary.centroids_mean(t.labelled, FEATURES), t.path("centroids.csv"))
    return tables.scan_any(t.spark, path)


@query(
    "export_members",
    f"select row_id, cluster, {rs('prob')}, cluster = (select cluster from labelled where cluster >= 0 "
    "group by cluster order by count(*) desc, cluster limit 1) as is_target from member",
)
def _(t):
    flagged = members.flag_target_cluster(t.labelled, compare.choose_target_cluster(t.labelled))
    return members.export_members(flagged).select("row_id", "cluster", "prob", "is_target")


@query(
    "export_members_ranked",
    f"select row_id, {rs(*SKY, 'color', 'M_G', 'ruwe', 'prob')}, cluster from member",
)
def _(t):
    return members.export_members_ranked(t.labelled)


# Projections, renames, casts


@query(
    "rename_by_map",
    f"select row_id, {rs(*SKY)}, {r('phot_g_mean_mag', 'g')}, {r('phot_bp_mean_mag', 'bp')}, "
    f"{r('phot_rp_mean_mag', 'rp')}, {rs('ruwe')} from raw",
)
def _(t):
    return harmonise.rename_by_map(t.raw, CATALOG_MAP).drop("reading", "label", "probability")


@query("alias_harmonise", f"select row_id, cluster, {rs('prob', '_pm_mag', 'ra', 'dec', 'color', 'M_G')}, is_member from labelled")
def _(t):
    odd = t.clean.withColumnsRenamed(
        {"label": "cluster_label", "color": "BP_RP", "M_G": "abs_g", "ra": "RA", "dec": "DEC"}
    )
    out = harmonise.alias_harmonise(odd)
    return out.select("row_id", "cluster", "prob", "_pm_mag", "ra", "dec", "color", "M_G", "is_member")


@query("alias_reference", f"select row_id, {rs('color', 'M_G')} from ref")
def _(t):
    odd = t.ref.withColumnsRenamed({"color": "BP_RP", "M_G": "abs_g"})
    return harmonise.rename_aliases(odd).select("row_id", "color", "M_G")


@query("require_columns", f"select row_id, {rs('parallax', 'pmra', 'pmdec')} from raw")
def _(t):
    return harmonise.require_columns(t.raw, harmonise.CORE).select("row_id", *harmonise.CORE)


@query("has_columns", "select true as has_core, false as has_color, count(*) as n from raw")
def _(t):
    return t.raw.agg(
        F.lit(harmonise.has_columns(t.raw, harmonise.CORE)).alias("has_core"),
        F.lit(harmonise.has_columns(t.raw, ["color"])).alias("has_color"),
        F.count("*").alias("n"),
    )


@query("coerce_numeric", f"select row_id, {r('try_cast(reading as double)', 'reading')} from raw")
def _(t):
    return harmonise.coerce_numeric(t.raw, ["reading"]).select("row_id", "reading")


@query("strict_numeric", f"select row_id, {r('cast(reading as double)', 'reading')} from raw where reading <> 'abc'")
def _(t):
    return harmonise.strict_numeric(t.raw.filter(F.col("reading") != "abc"), ["reading"]).select("row_id", "reading")


@query("cast_float32", f"select row_id, round(cast(parallax as float)::double, 4) + 0.0 as x, round(cast(pmra as float)::double, 4) + 0.0 as y from clean")
def _(t):
    packed = scale.as_float32(t.clean.select("row_id", F.array("parallax", "pmra").alias("features")))
    return rounded(
        packed.select("row_id", *[F.col("features")[i].cast("double").alias(c) for i, c in enumerate("xy")]), 4
    )


@query("unit_rescale", f"select row_id, {r('parallax * 11.0', 'parallax')}, {r('pmra * 10.62', 'pmra')}, {r('pmdec * 10.62', 'pmdec')} from raw")
def _(t):
    return harmonise.unit_rescale(t.raw, {"parallax": 11.0, "pm": 10.62}).select("row_id", *harmonise.CORE)


@query(
    "select_features",
    f"select row_id, {rs('parallax')}, {r('try_cast(reading as double)', 'reading')} from raw "
    "where parallax is not null and try_cast(reading as double) is not null",
)
def _(t):
    return scale.select_features(t.raw, ["parallax", "reading", "no_such_column"])


@query("select_features_strict", f"{Z_SQL} select row_id, {rs(*FEATURES)} from used")
def _(t):
    return scale.select_features_strict(t.clean, FEATURES)


HARMONISED = (*SKY, "g", "bp", "rp", "ruwe", "color", "M_G")


@query("harmonize_catalog", f"select row_id, {rs(*HARMONISED)} from clean")
def _(t):
    return harmonise.harmonize_catalog(t.raw, CATALOG_MAP, 1.4).select("row_id", *HARMONISED)


@query("harmonize_reference", f"select row_id, {rs(*REF_COLUMNS, 'M_G')} from ref")
def _(t):
    return harmonise.harmonize_reference(t.ref_raw, REFERENCE_MAP)


# Filters


@query("filter_positive_parallax", f"select row_id, {rs('parallax')} from raw where parallax > 0")
def _(t):
    return harmonise.filter_positive_parallax(t.raw).select("row_id", "parallax")


@query("filter_quality", f"select row_id, {rs('ruwe')} from raw where ruwe < 1.4")
def _(t):
    return harmonise.filter_quality(t.raw).select("row_id", "ruwe")


@query("dropna_core", f"select row_id, {rs('parallax')} from raw where parallax is not null")
def _(t):
    return harmonise.dropna_core(t.raw).select("row_id", "parallax")


@query("filter_non_noise", "select row_id, cluster from labelled where cluster >= 0")
def _(t):
    return members.filter_non_noise(t.labelled).select("row_id", "cluster")


@query("choose_members", "select row_id, cluster >= 0 and prob >= 0.7 as is_member from labelled")
def _(t):
    chosen = members.choose_members(F.col("cluster"), F.col("prob"), 0.7)
    return t.labelled.select("row_id", chosen.alias("is_member"))


@query("subset_members", f"select row_id, cluster, {rs('prob')} from member")
def _(t):
    return members.subset_members(t.labelled).select("row_id", "cluster", "prob")


SCORES_SQL = """, own as (select cluster, count(*) as n, median(parallax) as plx_c, median("_pm_mag") as pm_c
                 from labelled where cluster >= 0 group by cluster),
theirs as (select median(parallax) as plx_v, median("_pm_mag") as pm_v from ref),
scores as (select *, abs(plx_c - plx_v) / plx_v + abs(pm_c - pm_v) / pm_v as score from own, theirs)"""


@query(
    "flag_target_cluster",
    f"{SCORES_SQL} select row_id, cluster, prob >= 0.5 and cluster = (select cluster from scores order by score, cluster limit 1) "
    "as is_target from labelled",
)
def _(t):
    selection = compare.choose_target_cluster(t.labelled, t.ref)
    return members.flag_target_cluster(t.labelled, selection).select("row_id", "cluster", "is_target")


@query("filter_finite_pairs", f"select row_id, {rs('parallax', 'M_G')} from (select row_id, parallax, case when parallax > 0 then phot_g_mean_mag / parallax else 'inf'::double end as \"M_G\" from raw) where isfinite(parallax) and isfinite(\"M_G\")")
def _(t):
    ratio = F.when(F.col("parallax") > 0, F.col("phot_g_mean_mag") / F.col("parallax")).otherwise(F.lit(float("inf")))
    pairs = t.raw.select("row_id", "parallax", ratio.alias("M_G"))
    return members.filter_finite_pairs(pairs, "parallax", "M_G")


@query("members_only_check", "select bool_and(is_member) as all_members, bool_or(is_member) as any_member from labelled")
def _(t):
    return members.members_only_check(t.labelled)


@query("filter_cluster", f"select row_id, cluster, {rs('prob')} from labelled where cluster = 1")
def _(t):
    return members.filter_cluster(t.labelled, 1).select("row_id", "cluster", "prob")


# Scalar functions


@query("color_index", f"select row_id, {r('phot_bp_mean_mag - phot_rp_mean_mag', 'color')} from raw")
def _(t):
    return t.raw.select("row_id", sky.color_index(F.col("phot_bp_mean_mag"), F.col("phot_rp_mean_mag")).alias("color"))


@query(
    "absolute_magnitude",
    f"select row_id, {r('case when parallax > 0 then phot_g_mean_mag + 5 * log10(parallax) - 10 end', 'M_G')} from raw",
)
def _(t):
    return t.raw.select("row_id", sky.absolute_magnitude(F.col("parallax"), F.col("phot_g_mean_mag")).alias("M_G"))


@query("pm_magnitude", f"select row_id, {r('sqrt(pmra * pmra + pmdec * pmdec)', 'pm')} from raw")
def _(t):
    return t.raw.select("row_id", sky.pm_magnitude(F.col("pmra"), F.col("pmdec")).alias("pm"))


@query("pm_angle_deg", f"select cluster, {r('degrees(atan2(avg(pmdec), avg(pmra)))', 'angle')} from labelled group by cluster")
def _(t):
    angle = sky.direction_deg(F.avg("pmra"), F.avg("pmdec"))
    return t.labelled.groupBy("cluster").agg(angle.alias("angle"))


@query(
    "angle_diff",
    ", d as (select row_id, abs(degrees(atan2(pmdec, pmra)) - 150) % 360 as d from raw) "
    f"select row_id, {r('least(d, 360 - d)', 'diff')} from d",
)
def _(t):
    angle = sky.direction_deg(F.col("pmra"), F.col("pmdec"))
    return t.raw.select("row_id", sky.angle_diff(angle, F.lit(150.0)).alias("diff"))


def haversine(ra0: str, dec0: str) -> str:
    return (
        f"degrees(2 * asin(least(1.0, sqrt(pow(sin((radians(dec) - radians({dec0})) / 2), 2) + cos(radians(dec)) * "
        f"cos(radians({dec0})) * pow(sin((radians(ra) - radians({ra0})) / 2), 2)))))"
    )


@query("angular_distance", f"select row_id, {r(haversine('55.0', '22.0'), 'r')} from raw")
def _(t):
    return t.raw.select(
        "row_id", sky.angular_distance(F.col("ra"), F.col("dec"), F.lit(CENTER[0]), F.lit(CENTER[1])).alias("r")
    )


@query("relative_distance_score", f"select row_id, {r('abs(parallax - 7.37) / 7.37 + abs(pmra - 19.5) / 19.5', 'score')} from raw")
def _(t):
    return t.raw.select(
        "row_id",
        sky.relative_distance(F.col("parallax"), F.col("pmra"), F.lit(7.37), F.lit(19.5)).alias("score"),
    )


# Scaling


@query("standardize", Z_SELECT)
def _(t):
    return _unpacked(scale.standardize(t.clean, FEATURES, float32=False))


@query(
    "scaler_params",
    Z_SQL + " " + " union all ".join(
        f"select '{c}' as feature, {r(f'avg({q})', 'mean')}, {r(f'stddev_pop({q})', 'scale')} from used"
        for c, q in ((c, f'"{c}"') for c in FEATURES)
    ),
)
def _(t):
    return scale.scaler_params(scale.select_features_strict(t.clean, FEATURES), FEATURES)


# Attach


@query("attach_cluster", "select row_id, cluster, cluster >= 0 and prob >= 0.5 as is_member from labelled")
def _(t):
    labels = t.clean.select("row_id", F.col("label").alias("cluster"), F.col("probability").alias("prob"))
    return members.attach_cluster(t.clean.select("row_id", "ra"), labels).select("row_id", "cluster", "is_member")


@query(
    "reattach_all_rows",
    f"select raw.row_id, coalesce(l.cluster, -1) as cluster, {r('coalesce(l.prob, 0)', 'prob')}, "
    "coalesce(l.is_member, false) as is_member from raw left join labelled l using (row_id)",
)
def _(t):
    labels = t.labelled.select("row_id", "cluster", "prob")
    return members.reattach_all_rows(t.raw.select("row_id"), labels)


# Aggregations


@query("clustering_overview", OVERVIEW_SQL)
def _(t):
    return summary.clustering_overview(t.labelled)


@query(
    "cluster_overview",
    OVERVIEW_SQL.replace("from labelled", "from (select l.*, label as cluster, probability as prob from clean l)"),
)
def _(t):
    return summary.cluster_overview(t.clean, "label", "probability")


@query(
    "run_meta",
    OVERVIEW_SQL.replace(
        "\nfrom labelled",
        ", 'parallax,pmra' as features, 30 as min_cluster_size, 0.5::double as prob_threshold, "
        "(select count(*) from clean) as n_used, (select count(*) from raw) as n_total\nfrom labelled",
    ),
)
def _(t):
    overview = summary.clustering_overview(t.labelled)
    meta = summary.run_meta(overview, ["parallax", "pmra"], 30, 0.5, t.clean, t.raw)
    return meta.withColumn("features", F.concat_ws(",", "features"))


def _stats(c: str) -> str:
    q = f'"{c}"'
    return ", ".join(
        [f'count({q}) as "{c}_count"']
        + [r(f"{f}({q})", f"{c}_{n}") for f, n in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("median", "median"), ("max", "max"))]
    )


NUMERIC_SUMMARY_SQL = (
    f"select cluster, {', '.join(_stats(c) for c in SUMMARY_FEATURES)} from labelled where cluster >= 0 group by cluster"
)


@query("numeric_summary", NUMERIC_SUMMARY_SQL)
def _(t):
    return summary.numeric_summary(t.labelled, SUMMARY_FEATURES)


CENTROIDS_SQL = (
    "select cluster, count(*) as n, "
    + ", ".join(
        ", ".join(r(f'{f}("{c}")', f"{c}_{n}") for f, n in (("avg", "mean"), ("stddev_samp", "std"), ("median", "median")))
        for c in FEATURES
    )
    + f", {r('avg(ra)', 'ra_mean')}, {r('avg(dec)', 'dec_mean')}, "
    + r('avg("_pm_mag")', "pm_mag_mean")
    + " from labelled where cluster >= 0 group by cluster"
)


@query("centroids_full", CENTROIDS_SQL)
def _(t):
    return summary.centroids_full(t.labelled, FEATURES)


@query("centroids_mean", f"select cluster, {CENTROID_MEANS} from labelled where cluster >= 0 group by cluster")
def _(t):
    return summary.centroids_mean(t.labelled, FEATURES)


@query(
    "cluster_stats_long",
    " union all ".join(
        f"select cluster, '{n}' as stat, "
        + ", ".join(r(f'{f}("{c}")', c) for c in FEATURES)
        + " from labelled where cluster >= 0 group by cluster"
        for f, n in (("avg", "mean"), ("stddev_samp", "std"), ("median", "median"))
    ),
)
def _(t):
    return summary.cluster_stats_long(t.labelled, FEATURES)


def _describe(c: str, table: str, percents: tuple[int, ...]) -> str:
    q = f'"{c}"'
    parts = ", ".join(r(f"quantile_cont({q}, {p / 100})", f"p{p:02d}") for p in percents)
    return (
        f"select '{c}' as \"column\", count({q}) as count, {r(f'avg({q})', 'mean')}, {r(f'stddev_samp({q})', 'std')}, "
        f"{r(f'min({q})', 'min')}, {parts}, {r(f'max({q})', 'max')} from {table}"
    )


@query("describe_table", " union all ".join(_describe(c, "clean", (25, 50, 75)) for c in SUMMARY_FEATURES))
def _(t):
    return summary.describe_table(t.clean, SUMMARY_FEATURES)


@query(
    "describe_tails",
    _describe("prob", "labelled", (5, 50, 95)) + " union all "
    + " union all ".join(_describe(c, "ref", (5, 50, 95)) for c in ("parallax", "color", "M_G")),
)
def _(t):
    tails = (0.05, 0.5, 0.95)
    return summary.describe_table(t.labelled, ["prob"], tails).unionByName(
        summary.describe_table(t.ref, ["parallax", "color", "M_G"], tails)
    )


@query("cluster_counts", "select cluster, count(*) as n from labelled group by cluster")
def _(t):
    return ranking.cluster_counts(t.labelled)


@query(
    "member_count",
    f"{SCORES_SQL} select count(*) as n_rows, count_if(is_member)::bigint as n_member, count_if(is_member and cluster = "
    "(select cluster from scores order by score, cluster limit 1))::bigint as n_target from labelled",
)
def _(t):
    flagged = members.flag_target_cluster(t.labelled, compare.choose_target_cluster(t.labelled, t.ref))
    return members.member_count(flagged)


@query(
    "unit_sanity",
    f"select {r('median(parallax)', 'median_parallax')}, {r('median(_pm_mag)', 'median_pm')}, "
    "median(parallax) < 2 and median(_pm_mag) < 10 as suspicious from labelled",
)
def _(t):
    return harmonise.unit_sanity(t.clean)


RATIO_SQL = """, q as (select (select median(parallax) from ref) / median(parallax) as a,
  (select median("_pm_mag") from ref) / median("_pm_mag") as b from labelled)"""


@query("unit_ratio_check", f"{RATIO_SQL} select {r('a', 'parallax_ratio')}, {r('b', 'pm_ratio')}, a > 2 and a < 100 and b > 2 and b < 100 as suspicious from q")
def _(t):
    return harmonise.unit_ratio_check(t.clean, t.ref)


@query(
    "choose_target_cluster",
    f"{SCORES_SQL} select cluster as label, 'closest_to_valid_median' as method, {rs('score', 'plx_c', 'pm_c')}, n, "
    f"{rs('plx_v', 'pm_v')} from scores order by score, cluster limit 1",
)
def _(t):
    return compare.choose_target_cluster(t.labelled, t.ref).select("label", "method", "score", "details.*")


@query(
    "choose_largest_cluster",
    "select cluster as label, 'largest_non_noise' as method, count(*) as n from labelled where cluster >= 0 "
    "group by cluster order by n desc, cluster limit 1",
)
def _(t):
    return compare.choose_target_cluster(t.labelled).select("label", "method", "details.n")


def _compare_sql(ours: str) -> str:
    means = []
    for c, name in (("parallax", "parallax"), ("_pm_mag", "pm_mag"), ("color", "color"), ("M_G", "M_G")):
        a, b = f'(select avg("{c}") from {ours})', f'(select avg("{c}") from ref)'
        means.append(f'{r(a, f"{name}_mean_cluster")}, {r(b, f"{name}_mean_valid")}, {r(f"{a} - {b}", f"{name}_mean_diff")}')
    angle = "(select degrees(atan2(avg(pmdec), avg(pmra))) from {})"
    d = f"abs({angle.format(ours)} - {angle.format('ref')})"
    return f"select {', '.join(means)}, {r(f'least({d}, 360 - {d})', 'pm_angle_diff_deg')}"


@query("compare_to_reference", _compare_sql("member"))
def _(t):
    return compare.compare_to_reference(t.labelled, t.ref)


@query("compare_to_reference_global", _compare_sql("member"))
def _(t):
    return compare.compare_to_reference_global(members.subset_members(t.labelled), t.ref)


@query("mad", f"select {r('mad(parallax)', 'parallax_mad')}, {r('median(parallax)', 'parallax_median')} from labelled")
def _(t):
    return median_mad(t.labelled, [], ["parallax"])


@query(
    "median_mad",
    "select cluster, " + ", ".join(f"{r(f'median({c})', f'{c}_median')}, {r(f'mad({c})', f'{c}_mad')}" for c in ("parallax", "ruwe", "color"))
    + " from labelled group by cluster",
)
def _(t):
    return median_mad(t.labelled, ["cluster"], ["parallax", "ruwe", "color"])


@query("robust_limits", f"select {r('quantile_cont(parallax, 0.005)', 'lo')}, {r('quantile_cont(parallax, 0.995)', 'hi')} from labelled")
def _(t):
    return robust_limits(t.labelled, "parallax")


ELLIPSE_SQL = """, m as (select count(*) as n, avg(pmra) as mx, avg(pmdec) as my, var_samp(pmra) as xx, var_samp(pmdec) as yy,
  covar_samp(pmra, pmdec) as xy from member), e as (select *, (xx + yy) / 2 as t, sqrt(pow((xx - yy) / 2, 2) + xy * xy) as d from m)"""


@query(
    "covariance_ellipse",
    f"{ELLIPSE_SQL} select n, {r('mx', 'center_x')}, {r('my', 'center_y')}, {r('4 * sqrt(t + d)', 'width')}, "
    f"{r('4 * sqrt(t - d)', 'height')}, {r('degrees(0.5 * atan2(2 * xy, xx - yy))', 'angle')} from e",
)
def _(t):
    return distributions.covariance_ellipse(members.subset_members(t.labelled), "pmra", "pmdec")


def _silhouette_sql(points: str) -> str:
    return f""", p as ({points}), sz as (select cluster, count(*) as n from p group by cluster),
sums as (select a.row_id, a.cluster, b.cluster as other, sum(list_distance(a.f, b.f)) as s from p a, p b group by all),
ab as (select row_id, sums.cluster, max(case when other = sums.cluster then sz.n end) as n,
  max(case when other = sums.cluster then s / nullif(sz.n - 1, 0) end) as a,
  min(case when other <> sums.cluster then s / sz.n end) as b from sums join sz on sz.cluster = other group by all)
select {r("avg(case when n = 1 then 0 else (b - a) / greatest(a, b) end)", "silhouette")} from ab"""


DIMENSIONS = 64


@query("silhouette_exact", _silhouette_sql("select vec_id as row_id, label as cluster, embedding::double[] as f from embeddings"))
def _(t):
    return silhouette_exact(t.embeddings)


@query("silhouette_alignment", f"{Z_SQL} select used.row_id, label as cluster from used join clean using (row_id) where label >= 0")
def _(t):
    scaled = scale.standardize(t.clean, FEATURES)
    labels = members.filter_non_noise(t.labelled).select("row_id", "cluster")
    return scaled.join(labels, "row_id").select("row_id", "cluster")


@query(
    "silhouette_sampled",
    _silhouette_sql(
        "select vec_id as row_id, label as cluster, ["
        + ", ".join(
            f"(embedding[{i}]::double - avg(embedding[{i}]::double) over ()) / stddev_pop(embedding[{i}]::double) over ()"
            for i in range(1, DIMENSIONS + 1)
        )
        + f"] as f from (select * from embeddings order by md5('0:' || vec_id) limit 20000)",
    ),
)
def _(t):
    names = [f"f{i}" for i in range(DIMENSIONS)]
    wide = t.embeddings.select("row_id", "cluster", *[F.col("features")[i].alias(c) for i, c in enumerate(names)])
    return silhouette_sampled(wide, names)


# Overlays, order, samples


def _overlay_sql(x: str, y: str, ours: str = "member") -> str:
    return f"select {rs(x, y)}, 'catalog' as source from {ours} union all select {rs(x, y)}, 'reference' from ref"


@query("overlay_sky", _overlay_sql("ra", "dec"))
def _(t):
    return distributions.overlay_sky(members.subset_members(t.labelled), t.ref)


@query("overlay_pm", _overlay_sql("pmra", "pmdec"))
def _(t):
    return distributions.overlay_pm(members.subset_members(t.labelled), t.ref)


@query("overlay_cmd", _overlay_sql("color", "M_G"))
def _(t):
    return distributions.overlay_cmd(members.subset_members(t.labelled), t.ref)


@query("head", f"select row_id, {rs('prob')} from member order by prob desc, row_id limit 10")
def _(t):
    return ranking.head(members.subset_members(t.labelled).select("row_id", "prob"), 10, F.desc("prob"), "row_id")


@query(
    "top_clusters",
    "select cluster, n, false as is_noise from (select cluster, count(*) as n from labelled where cluster >= 0 group by cluster "
    "order by n desc, cluster limit 6) union all select cluster, count(*), true from labelled where cluster = -1 group by cluster",
)
def _(t):
    return ranking.top_clusters(t.labelled)


@query("largest_cluster", "select cluster, count(*) as n from labelled where cluster >= 0 group by cluster order by n desc, cluster limit 1")
def _(t):
    return ranking.largest_cluster(t.labelled)


@query("sample_rows", f"select row_id, {rs('ra', 'dec')} from labelled order by md5('0:' || row_id), row_id limit 800")
def _(t):
    return ranking.sample_rows(t.labelled, 800).select("row_id", "ra", "dec")


@query("panel_labels", "select distinct cluster from labelled where cluster in (0, 2, -1)")
def _(t):
    return ranking.panel_labels(t.labelled, [0, 2, -1])


# Distribution tables


def _points_sql(x: str, y: str, ours: str, color: str = "prob") -> str:
    return (
        f"select {rs(x, y, color)}, 'catalog' as source from {ours} union all "
        f"select {rs(x, y)}, null, 'reference' from ref"
    )


@query("sky_points", _points_sql("ra", "dec", "labelled"))
def _(t):
    return distributions.sky_points(t.labelled, color_by="prob", reference=t.ref)


@query("pm_points", _points_sql("pmra", "pmdec", "labelled"))
def _(t):
    return distributions.pm_points(t.labelled, color_by="prob", reference=t.ref)


@query("cmd_points", _points_sql("color", "M_G", "member"))
def _(t):
    return distributions.cmd_points(t.labelled, color_by="prob", reference=t.ref)


def _hexbin_sql(x: str, y: str, gridsize: int, ours: str) -> str:
    rows = numeric.hex_rows(gridsize)
    return f""", p as (select "{x}" as x, "{y}" as y from {ours} where "{x}" is not null and "{y}" is not null),
f as (select min(x) - 1e-9::double * (max(x) - min(x)) as x0,
  ((max(x) + 1e-9::double * (max(x) - min(x))) - (min(x) - 1e-9::double * (max(x) - min(x)))) / {gridsize} as sx,
  min(y) as y0, (max(y) - min(y)) / {rows} as sy from p),
uv as (select (x - x0) / sx as u, (y - y0) / sy as v, x0, sx, y0, sy from p, f),
lat as (select *, case when pow(u - round_even(u, 0), 2) + 3 * pow(v - round_even(v, 0), 2)
  < pow(u - floor(u) - 0.5, 2) + 3 * pow(v - floor(v) - 0.5, 2) then 1 else 2 end as lattice from uv),
ij as (select lattice, case when lattice = 1 then round_even(u, 0) else floor(u) + 0.5 end as i,
  case when lattice = 1 then round_even(v, 0) else floor(v) + 0.5 end as j, x0, sx, y0, sy from lat)
select {r("i * sx + x0", "cell_x")}, {r("j * sy + y0", "cell_y")}, lattice, count(*) as n, {r("log10(count(*))", "log10_n")}
from ij group by lattice, i, j, x0, sx, y0, sy"""


@query("sky_hexbin", _hexbin_sql("ra", "dec", 80, "labelled"))
def _(t):
    return distributions.sky_hexbin(t.labelled)


@query("pm_hexbin", _hexbin_sql("pmra", "pmdec", 70, "member"))
def _(t):
    return distributions.pm_hexbin(t.labelled)


@query("cmd_hexbin", _hexbin_sql("color", "M_G", 60, "member"))
def _(t):
    return distributions.cmd_hexbin(t.labelled)


ARROWS = ("ra", "dec", "pmra", "pmdec")


@query("sky_vectors", f"select row_id, {rs(*ARROWS)} from member order by md5('0:' || row_id), row_id limit 800")
def _(t):
    return distributions.sky_vectors(t.labelled)


def _histogram_sql(source: str, bins: int, by: str = "", ranges: str = "") -> str:
    """Count by joining each value to the one bin whose edges hold it."""
    keys = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    same = " and ".join([f"g.{k} = v.{k}" for k in by.split(", ") if by] + ["v.x >= g.lo"])
    ranges = ranges or f"select {keys}min(x) as a, max(x) as b from v {group}"
    return f""", v as (select * from ({source}) where x is not null), ab as ({ranges}),
rg as (select {keys}case when a = b then a - 0.5 else a end as a, case when a = b then b + 0.5 else b end as b from ab where a is not null),
g as (select {keys}i::int as bin, a + i * ((b - a) / {bins}) as lo, case when i = {bins - 1} then b else a + (i + 1) * ((b - a) / {bins}) end as hi,
  i = {bins - 1} as last from rg, range({bins}) t(i)),
h as (select {"g." + by.replace(", ", ", g.") + ", " if by else ""}g.bin, g.lo, g.hi, count(v.x) as n from g left join v
  on {same} and (v.x < g.hi or (g.last and v.x = g.hi)) group by all)"""


@query("prob_histogram", _histogram_sql("select prob as x from labelled", 30) + f" select bin, {rs('lo', 'hi')}, n from h")
def _(t):
    return distributions.prob_histogram(t.labelled)


@query(
    "prob_cdf",
    f"select row_id, {rs('prob')}, "
    + r("(row_number() over (order by prob, row_id) - 1)::double / (count(*) over () - 1)", "cdf")
    + " from labelled",
)
def _(t):
    return distributions.prob_cdf(t.labelled)


@query(
    "histogram_by_cluster",
    _histogram_sql("select cluster, parallax as x from labelled", 30, "cluster") + f" select cluster, bin, {rs('lo', 'hi')}, n from h",
)
def _(t):
    return distributions.histogram_by_cluster(t.labelled, "parallax")


@query(
    "box_stats",
    """, q as (select cluster, quantile_cont(parallax, 0.25) as q1, median(parallax) as med, quantile_cont(parallax, 0.75) as q3
  from member group by cluster), w as (select q.*, min(case when parallax >= q1 - 1.5 * (q3 - q1) then parallax end) as lo,
  max(case when parallax <= q3 + 1.5 * (q3 - q1) then parallax end) as hi,
  count_if(parallax < q1 - 1.5 * (q3 - q1) or parallax > q3 + 1.5 * (q3 - q1))::bigint as n_outliers from member join q using (cluster) group by all)"""
    + f" select cluster, {rs('q1', 'med', 'q3')}, {r('least(lo, q1)', 'whisker_lo')}, {r('greatest(hi, q3)', 'whisker_hi')}, n_outliers from w",
)
def _(t):
    return distributions.box_stats(t.labelled, "parallax")


@query(
    "violin_density",
    """, s as (select cluster, count(*) as n, min(parallax) as lo, max(parallax) as hi, median(parallax) as median,
  stddev_samp(parallax) * pow(count(*), -0.2) as h from member group by cluster),
g as (select s.*, i::int as grid_i, case when i = 99 then hi else lo + i * ((hi - lo) / 99) end as x from s, range(100) t(i))"""
    + f" select cluster, grid_i, {rs('x')}, "
    + r("sum(exp(-0.5 * pow((x - parallax) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi()))", "density")
    + f", {rs('median')} from g join member m using (cluster) group by cluster, grid_i, x, median",
)
def _(t):
    return distributions.violin_density(t.labelled, "parallax")


@query(
    "members_vs_threshold",
    f"select {r('i * 0.025::double', 'threshold')}, count_if(cluster >= 0 and prob >= i * 0.025::double)::bigint as n "
    "from labelled, range(41) t(i) group by i",
)
def _(t):
    return distributions.members_vs_threshold(t.labelled)


@query(
    "radial_profile",
    ", c as (select median(ra) as ra0, median(dec) as dec0 from member), rr as (select "
    + haversine("ra0", "dec0")
    + " as x from member, c)"
    + _histogram_sql("select x from rr", 25, ranges="select 0.0::double as a, quantile_cont(x, 0.995) as b from rr")
    + f" select bin, {r('lo', 'r_lo')}, {r('hi', 'r_hi')}, n, {r('n / (pi() * (hi * hi - lo * lo))', 'density')} from h",
)
def _(t):
    return distributions.radial_profile(t.labelled)


@query("ruwe_vs_g", f"select {r('g', 'phot_g_mean_mag')}, {rs('ruwe')} from member")
def _(t):
    return distributions.ruwe_vs_g(t.labelled)


@query("mg_vs_parallax", f"select {rs('parallax', 'M_G')} from member")
def _(t):
    return distributions.mg_vs_parallax(t.labelled)


PANEL_SQL = " union all ".join(
    f"select '{c}' as feature, cluster, \"{c}\" as x from labelled" for c in distributions.PANEL_FEATURES
)


@query(
    "cluster_panel",
    _histogram_sql(PANEL_SQL, 20, "feature, cluster")
    + ", s as (select feature, cluster, median(x) as median, mad(x) as mad from v group by all) "
    + f"select feature, cluster, bin, {rs('lo', 'hi')}, n, {rs('median', 'mad')} from h join s using (feature, cluster)",
)
def _(t):
    return distributions.cluster_panel(t.labelled)


@query("cluster_panel_sky", f"select cluster, {rs('ra', 'dec', 'prob')} from labelled")
def _(t):
    return distributions.cluster_panel_points(t.labelled, "ra", "dec")


@query("cluster_panel_cmd", f"select cluster, {rs('color', 'M_G', 'prob')} from labelled")
def _(t):
    return distributions.cluster_panel_points(t.labelled, "color", "M_G")


@query(
    "cluster_panel_centers",
    "select cluster, least(count(*), 500) as n_arrows, "
    + ", ".join(r(f"avg({c})", f"{c}_mean") for c in ("ra", "dec", "pmra", "pmdec"))
    + " from labelled group by cluster",
)
def _(t):
    return distributions.cluster_panel_centers(t.labelled)


@query(
    "cluster_panel_vectors",
    f"select cluster, row_id, {rs(*ARROWS)} from labelled "
    "qualify row_number() over (partition by cluster order by md5('0:' || row_id), row_id) <= 500",
)
def _(t):
    return distributions.cluster_panel_vectors(t.labelled)


# Density clustering of the whole catalogue

K = 5
CUTS = [1.0, 1.5, 2.0]
VECTORS_SQL = "select row_id, " + ", ".join(
    f'floor("{c}" * {GRID} + 0.5) / {GRID} as f{i}' for i, c in enumerate(FEATURES, 1)
) + " from used"
SCALED_SQL = "select row_id, " + ", ".join(
    f'((("{c}" - avg("{c}") over ()) / stddev_pop("{c}") over ())::float)::double as f{i}' for i, c in enumerate(FEATURES, 1)
) + " from used"


def _near_sql(vectors: str, k: int) -> str:
    """``p`` rows with features, ``d`` all distances, ``nn`` the k nearest, ``core`` the distance of the k-th."""
    return f"""{Z_SQL}, p as ({vectors}),
d as (select a.row_id, b.row_id as neighbor_id, sqrt({" + ".join(f"(a.f{i} - b.f{i}) * (a.f{i} - b.f{i})" for i in range(1, 6))}) as dist
  from p a, p b where a.row_id <> b.row_id),
nn as (select *, row_number() over (partition by row_id order by dist, neighbor_id) as rank from d qualify rank <= {k}),
core as (select row_id, max(dist) as core from nn group by row_id)"""


PAIRS_SQL = _near_sql(VECTORS_SQL, K)


@query("knn", f"{PAIRS_SQL} select row_id, rank::int as rank, neighbor_id, {rs('dist')} from nn")
def _(t):
    return neighbours.knn(t.vectors, K)


@query("core_distance", f"{PAIRS_SQL} select row_id, {rs('core')} from core")
def _(t):
    return neighbours.core_distance(t.vectors, K)


@query(
    "mutual_reachability",
    f"{PAIRS_SQL} select nn.row_id, neighbor_id, {r('greatest(a.core, b.core, dist)', 'weight')} "
    "from nn join core a on a.row_id = nn.row_id join core b on b.row_id = neighbor_id",
)
def _(t):
    return neighbours.mutual_reachability(t.vectors, K)


def _hierarchy(t: Tables) -> dict[str, DataFrame]:
    return selection.hierarchy(t.vectors, min_cluster_size=K)


# The spanning tree by adding the nearest row to a growing set, one row a step. What is joined at some distance stands
# together in the order of adding, so the hierarchy cuts that order at its longest steps, all equal ones at once.
def _span_sql(vectors: str = VECTORS_SQL, k: int = K) -> str:
    return f"""{_near_sql(vectors, k)},
pts as (select row_number() over (order by row_id) as i, row_id, f1, f2, f3, f4, f5, core from p join core using (row_id)),
arr as (select list(core order by i) as c, {", ".join(f"list(f{j} order by i) as a{j}" for j in range(1, 6))}, count(*)::int as n from pts),
span as (
  select 1 as step, 1::bigint as cur, null::double as w, list_transform(range(1, n + 1), lambda j: case when j > 1 then 'inf'::double end) as best from arr
  union all
  select step + 1, nxt, nb[nxt], list_concat(nb[:nxt - 1], [null::double], nb[nxt + 1:]) from (
    select step, nb, list_position(nb, list_min(nb))::bigint as nxt from (
      select step, list_transform(best, lambda b, j: case when b is not null then least(b, greatest(c[j], c[cur], sqrt(
        {" + ".join(f"(a{j}[j] - a{j}[cur]) * (a{j}[j] - a{j}[cur])" for j in range(1, 6))}))) end) as nb
      from span, arr where step < n)))"""


def _tree_sql(vectors: str = VECTORS_SQL, m: int = K) -> str:
    return f"""{_span_sql(vectors, m)},
least_w as (select coalesce(min(w) filter (w > 0), 1.0) as f from span),
line as (select list(row_id order by step) as ids, list(greatest(w, f) order by step) as ws, count(*)::bigint as n
  from span join pts on i = cur, least_w),
walk as (
  select 'born' as kind, 1::bigint as lo, n as hi, n as cid, null::bigint as parent, null::double as w from line
  union all
  select case when e - s + 1 < {m} then 'shed' when n_big > 1 then 'born' else 'same' end, s, e,
    case when e - s + 1 >= {m} and n_big > 1 then s * 10000000 + e else cid end, cid, m
  from (
    select cid, m, unnest(starts) as s, unnest(ends) as e,
      len(list_filter(range(1, len(starts) + 1), lambda k: ends[k] - starts[k] + 1 >= {m})) as n_big
    from (
      select cid, m, list_concat([lo], cuts) as starts, list_concat(list_transform(cuts, lambda x: x - 1), [hi]) as ends
      from (
        select cid, lo, hi, m, list_filter(range(lo + 1, hi + 1), lambda x: ws[x] = m) as cuts
        from (select cid, lo, hi, ws, list_max(ws[lo + 1:hi]) as m from walk, line where kind <> 'shed' and hi > lo))))),
clusters as (select cid, parent, w as born_w, coalesce(1 / w, 0.0) as birth, hi - lo + 1 as size from walk where kind = 'born'),
fallen as (select cid as parent, unnest(ids[lo:hi]) as row_id, 1 / w as lambda_val from walk, line where kind = 'shed'),
tree as (
  select parent, row_id as child, lambda_val, 1::bigint as child_size, false as is_cluster from fallen
  union all select parent, null, birth, size, true from clusters where parent is not null),
stable as (
  select c.*, s.stability, s.death from clusters c join (
    select t.parent as cid, sum(child_size * lambda_val) - sum(child_size) * any_value(birth) as stability, max(lambda_val) as death
    from tree t join clusters k on k.cid = t.parent group by t.parent) s using (cid))"""


def _choice_sql(vectors: str = VECTORS_SQL, m: int = K) -> str:
    return f"""{_tree_sql(vectors, m)},
ranked as (select *, row_number() over (order by size, cid) as k from stable),
kids as (select p.k, list(c.k) as below from ranked p join ranked c on c.parent = p.cid group by p.k),
known as (select r.k, r.stability, coalesce(kids.below, []) as below from ranked r left join kids using (k)),
best as (
  select 0::bigint as k, []::double[] as b, null::boolean as wins
  union all
  select best.k + 1, list_append(b, greatest(stability, under)), stability >= under from (
    select best.k, b, stability, coalesce(list_sum(list_transform(below, lambda x: b[x])), 0.0) as under
    from best join known on known.k = best.k + 1) best),
chosen as (
  select cid, null::bigint as pick from clusters where parent is null
  union all
  select r.cid, coalesce(chosen.pick, case when best.wins then r.cid end)
  from chosen join ranked r on r.parent = chosen.cid join best on best.k = r.k),
fitted as (
  select row_id, pick, case when pick is null then 0.0 else least(lambda_val, death) / death end as prob
  from fallen join chosen on chosen.cid = fallen.parent left join stable on stable.cid = pick),
named as (
  select pick, (row_number() over (order by count(*) desc, min(row_id)) - 1)::int as cluster from fitted where pick is not null group by pick)"""


SPAN_SQL, TREE_SQL, CHOICE_SQL = _span_sql(), _tree_sql(), _choice_sql()


def _without_names(clusters: DataFrame, column: str, *facts: str) -> DataFrame:
    """Facts of the cluster that ``column`` names, as ``{column}_{fact}``, as clusters' names mean nothing outside a run."""
    return unbroadcast(clusters.select(F.col("cluster").alias(column), *[F.col(c).alias(f"{column}_{c}") for c in facts]))


@query("min_span_tree", f"{SPAN_SQL} select {r('w')}, count(*) as n from span where w is not null group by round(w, 6) + 0.0")
def _(t):
    """How many edges the tree has of each weight, which is the same for every least tree."""
    weight = (F.round("w", 6) + 0.0).alias("w")
    return _hierarchy(t)["edges"].groupBy(weight).agg(F.count("*").alias("n"))


@query(
    "components_at",
    PAIRS_SQL
    + f""", c as (select unnest({CUTS}::double[]) as cut),
e as (select cut, d.row_id as u, neighbor_id as v from d join core a on a.row_id = d.row_id
  join core b on b.row_id = neighbor_id join c on greatest(a.core, b.core, dist) <= cut),
reach as (select cut, row_id, row_id as via from p, c union
  select reach.cut, reach.row_id, e.v from reach join e on e.u = reach.via and e.cut = reach.cut)
select cut, row_id, min(via) as component from reach group by cut, row_id""",
)
def _(t):
    return components.components_at(_hierarchy(t)["edges"], CUTS)


@query(
    "condensed_tree",
    f"{TREE_SQL} select child, {rs('lambda_val')}, child_size, is_cluster, size as parent_size, {r('birth', 'parent_birth')} "
    "from tree join clusters on cid = tree.parent",
)
def _(t):
    tables = _hierarchy(t)
    tree = tables["tree"].join(_without_names(tables["clusters"], "parent", "size", "birth"), "parent").drop("parent")
    return tree.withColumn("child", F.when(~F.col("is_cluster"), F.col("child")))


@query("cluster_stability", f"{TREE_SQL} select {rs('birth', 'born_w')}, size, {rs('stability', 'death')} from stable")
def _(t):
    return _hierarchy(t)["clusters"].drop("cluster", "parent")


@query(
    "select_clusters",
    f"{CHOICE_SQL} select c.size as cluster_size, {r('c.birth', 'cluster_birth')}, d.size as chosen_size, {r('d.birth', 'chosen_birth')} "
    "from chosen join clusters c using (cid) left join clusters d on d.cid = pick",
)
def _(t):
    clusters = _hierarchy(t)["clusters"]
    picked = selection.select_clusters(clusters)
    picked = picked.join(_without_names(clusters, "cluster", "size", "birth"), "cluster")
    return picked.join(_without_names(clusters, "chosen", "size", "birth"), "chosen", "left").drop("cluster", "chosen")


@query(
    "membership_probability",
    f"{CHOICE_SQL} select row_id as point_id, {rs('prob')}, 1::bigint as weight, size as chosen_size "
    "from fitted left join clusters on cid = pick",
)
def _(t):
    tables = _hierarchy(t)
    chosen = selection.select_clusters(tables["clusters"])
    fitted = selection.membership_probability(tables["tree"], tables["clusters"], chosen)
    return fitted.join(_without_names(tables["clusters"], "chosen", "size"), "chosen", "left").drop("chosen")


@query("density_cluster", f"{CHOICE_SQL} select row_id, coalesce(cluster, -1) as cluster, {rs('prob')} from fitted left join named using (pick)")
def _(t):
    return selection.density_cluster(t.vectors, min_cluster_size=K)


# Jobs


def _prepared(t: Tables) -> tuple[str, dict[str, DataFrame]]:
    """Run the first job on the raw tables; its output folder and tables."""
    folder = t.path("job")
    raw = {
        "catalog": lambda: tables.save_table(t.raw, f"{folder}/raw/catalog.parquet"),
        "reference": lambda: tables.save_table(t.ref_raw, f"{folder}/raw/reference.csv"),
    }
    catalog, listed = together(t.spark, raw).values()
    return folder, jobs.job_preprocess(
        t.spark, catalog, listed, f"{folder}/interim", CATALOG_MAP, REFERENCE_MAP, key="row_id"
    )


def _saved(build: Callable[[], DataFrame], path: str) -> str:
    return tables.save_table(build(), path)


def _labelled(t: Tables) -> str:
    """The prepared catalogue with the driver's labels, as the second job leaves it."""
    folder, done = _prepared(t)
    labels = t.clean.select("row_id", F.col("label").alias("cluster"), F.col("probability").alias("prob"))
    outputs = {
        "clustered": lambda: members.reattach_all_rows(done["catalog"], labels),
        "features": lambda: scale.standardize(done["catalog"], FEATURES),
    }
    together(t.spark, {name: partial(_saved, build, f"{folder}/processed/{name}.parquet") for name, build in outputs.items()})
    return folder


@query("job_preprocess", " union all ".join(_describe(c, "clean", (25, 50, 75)) for c in SUMMARY_FEATURES))
def _(t):
    return _prepared(t)[1]["catalog_report"]


@query(
    "job_cluster",
    f"""{_choice_sql(SCALED_SQL, 30)}, found as (
  select row_id, coalesce(cluster, -1) as cluster, prob from fitted left join named using (pick))
select row_id, coalesce(cluster, -1) as cluster, {r("coalesce(prob, 0.0)", "prob")}, coalesce(cluster >= 0 and prob >= 0.5, false) as is_member
from clean left join found using (row_id)""",
)
def _(t):
    folder, done = _prepared(t)
    out = jobs.job_cluster(t.spark, f"{folder}/interim/catalog_clean.parquet", f"{folder}/processed")
    return out["labelled"].select("row_id", "cluster", "prob", "is_member")


@query(
    "job_validate",
    f"{SCORES_SQL} select row_id, cluster, {rs('prob')}, is_member, is_member and cluster = "
    "(select cluster from scores order by score, cluster limit 1) as is_target from labelled",
)
def _(t):
    folder = _labelled(t)
    done = jobs.job_validate(
        t.spark,
        f"{folder}/processed/clustered.parquet",
        f"{folder}/processed/features.parquet",
        f"{folder}/interim/valid_clean.parquet",
        f"{folder}/validated",
    )
    return done["labelled"].select("row_id", "cluster", "prob", "is_member", "is_target")


def _count_sql(of: str) -> str:
    return f"(select count(*) from ({of}))"


def _pairs_sql(features: Iterable[str], ours: str) -> str:
    """Number of features and labels that occur together."""
    return " + ".join(f'(select count(distinct cluster) from {ours} where "{c}" is not null)' for c in features)


ALL, MEMBERS, LISTED = (_count_sql(f"select 1 from {of}") for of in ("labelled", "member", "ref"))
FIGURE_COUNTS = {
    "sky_scatter_all": f"{ALL} + {LISTED}",
    "sky_scatter_members": f"{MEMBERS} + {LISTED}",
    "sky_scatter_prob_all": ALL,
    "sky_scatter_prob_members": MEMBERS,
    "sky_hexbin_all": _count_sql(ORACLE["sky_hexbin"]),
    "sky_quiver_members": f"least({MEMBERS}, 800)",
    "pm_plane_all": ALL,
    "pm_plane_all_ellipse": f"least({ALL} // 5, 1)",
    "pm_plane_prob_all": ALL,
    "pm_plane_members": MEMBERS,
    "pm_plane_members_ellipse": f"least({MEMBERS} // 5, 1)",
    "pm_plane_hexbin_members": _count_sql(ORACLE["pm_hexbin"]),
    "cmd_members": MEMBERS,
    "cmd_hexbin_members": _count_sql(ORACLE["cmd_hexbin"]),
    "cmd_members_vs_valid": f"{MEMBERS} + {LISTED}",
    "pm_plane_members_vs_valid": f"{MEMBERS} + {LISTED}",
    "mg_vs_parallax_members": MEMBERS,
    "hist_by_cluster": f"30 * ({_pairs_sql(jobs.HISTOGRAMS, 'labelled')})",
    "box_by_cluster_members": _pairs_sql(jobs.SHAPES, "member"),
    "violin_by_cluster_members": f"100 * ({_pairs_sql(jobs.SHAPES, 'member')})",
    "prob_hist": "30",
    "prob_cdf_all": _count_sql("select 1 from labelled where prob is not null"),
    "prob_cdf_members": _count_sql("select 1 from member where prob is not null"),
    "members_vs_threshold": "41",
    "radial_profile_members": "25",
    "ruwe_vs_g_members": MEMBERS,
    "panel_labels": "(select count(distinct cluster) from labelled)",
    "panel_cluster": f"20 * ({_pairs_sql(distributions.PANEL_FEATURES, 'labelled')})",
    "panel_cluster_sky": ALL,
    "panel_cluster_cmd": ALL,
    "panel_cluster_centers": "(select count(distinct cluster) from labelled)",
    "panel_cluster_vectors": "(select sum(least(n, 800)) from (select count(*) as n from labelled group by cluster))",
}


def _figures_sql(counts: dict[str, str]) -> str:
    return " union all ".join(f"select '{name}' as name, ({n})::bigint as n" for name, n in counts.items())


def _counted(found: dict[str, DataFrame]) -> DataFrame:
    counts = [table.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, table in found.items()]
    return reduce(DataFrame.unionByName, counts)


@query("job_report", _figures_sql(FIGURE_COUNTS | {"members_only_check": "1"}))
def _(t):
    """Row counts of all tables that the last job wrote, read back by its manifest."""
    folder = _labelled(t)
    manifest = jobs.job_report(
        t.spark,
        f"{folder}/processed/clustered.parquet",
        f"{folder}/figures",
        f"{folder}/interim/valid_clean.parquet",
    )
    written = manifest.collect()  # one row a view
    return _counted(together(t.spark, {r["name"]: partial(t.spark.read.parquet, r["path"]) for r in written}))


@query("figure_tables", _figures_sql(FIGURE_COUNTS))
def _(t):
    """Row counts of all distribution tables."""
    return _counted(jobs.figure_tables(t.labelled, t.ref))
