"""Catalogue files: CSV, TSV and Parquet, by suffix."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clustercat.functions.numeric import clean_floats

# Separators tried, sky-coordinate spellings always carried,
# names a reference list may be renamed to, places results are looked for.
SEPARATORS = (",", ";", "\t", "|")
SKY_SPELLINGS = ("ra", "RA", "ra_icrs", "Ra", "dec", "DE", "Dec", "dec_icrs")
REFERENCE_TARGETS = (
    "ra", "dec", "parallax", "pmra", "pmdec", "g", "gmag", "bp", "rp", "color", "ruwe",
)
RESULT_PATTERNS = (
    "*cluster*.parquet", "*label*.parquet", "*cluster*.csv*", "*label*.csv*", "*.parquet", "*.csv*",
)
REFERENCE_CANDIDATES = (
    "valid.parquet", "valid.csv.gz", "valid.csv",
    "../interim/valid_clean.parquet", "../interim/valid_clean.csv.gz", "../interim/valid_clean.csv",
)


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _file_system(spark, path)
    return fs.exists(hadoop_path)


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The separator that occurs most often in the first line, outside quotes."""
    first = spark.read.text(path).first()
    line = re.sub(r'"[^"]*"', "", first[0]) if first else ""
    return max(SEPARATORS, key=line.count)


def scan_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Read one table by suffix; NaN arrives as NULL.

    Without ``schema`` a CSV's types are inferred over the whole file, one
    extra pass; with it there is one pass, and a cell that does not fit is an
    error, not a silent NULL.
    """
    suffixes = [s.lower() for s in PurePosixPath(path).suffixes]
    if suffixes and suffixes[-1] in (".gz", ".bz2"):
        suffixes.pop()
    suffix = suffixes[-1] if suffixes else ""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    if suffix in (".parquet", ".pq"):
        return clean_floats(spark.read.parquet(path))
    if suffix not in (".csv", ".tsv"):
        raise ValueError(f"unsupported suffix: {suffix!r}")
    reader = (
        spark.read.option("header", True)
        .option("sep", sniff_separator(spark, path))
        .option("positiveInf", "inf")
        .option("negativeInf", "-inf")
    )
    if schema is None:
        reader = reader.option("inferSchema", True)
    else:
        reader = reader.schema(schema).option("mode", "FAILFAST")
    return clean_floats(reader.csv(path))


def load_catalog(
    spark: SparkSession,
    path: str,
    mapping: dict[str, str] | None = None,
    read_only_mapped: bool = True,
    key: str | None = None,
) -> DataFrame:
    """Read the catalogue with its own column names.

    Only mapped columns, sky coordinates and ``key`` are kept; the projection
    reaches the scan.
    """
    df = scan_any(spark, path)
    if not mapping or not read_only_mapped:
        return df
    wanted = list(mapping.values()) + [*SKY_SPELLINGS] + ([key] if key else [])
    columns = [c for c in dict.fromkeys(wanted) if c in df.columns]
    if spark.conf.get("spark.sql.caseSensitive") == "false":
        # Two spellings of one name cannot be told apart; the mapped one stays.
        columns = list({c.lower(): c for c in reversed(columns)}.values())[::-1]
    return df.select([F.col(f"`{c}`") for c in columns]) if columns else df


def load_reference(spark: SparkSession, path: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """Read the reference list and rename the known roles; other columns stay."""
    df = scan_any(spark, path)
    renames = {
        mapping[target]: target
        for target in REFERENCE_TARGETS
        if mapping and mapping.get(target) in df.columns
    }
    return df.toDF(*[renames.get(c, c) for c in df.columns])


def save_table(df: DataFrame, path: str) -> str:
    """Write Parquet for .parquet/.pq, else CSV with a header; return the path written."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix in (".parquet", ".pq"):
        df.write.mode("overwrite").parquet(path)
        return path
    if suffix == "":
        path = f"{path}.csv"
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def save_record(df: DataFrame, path: str) -> str:
    """Write metric records as JSON lines; missing values are written as null."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def latest_output(spark: SparkSession, directory: str, explicit: str | None = None) -> str:
    """The explicit file, else the newest table in ``directory`` under any known pattern."""
    if explicit is not None:
        whole = explicit.startswith("/") or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", explicit)
        path = explicit if whole else f"{directory}/{explicit}"
        if not path_exists(spark, path):
            raise FileNotFoundError(path)
        return path
    found: dict[str, int] = {}
    for pattern in RESULT_PATTERNS:
        hadoop_path, fs = _file_system(spark, f"{directory}/{pattern}")
        for status in fs.globStatus(hadoop_path) or []:
            found[status.getPath().toString()] = status.getModificationTime()
    if not found:
        raise FileNotFoundError(f"no table in {directory}")
    return max(found, key=found.get)


def first_existing_reference(spark: SparkSession, directory: str) -> str | None:
    """The first reference list that exists, in fixed priority."""
    paths = (f"{directory}/{candidate}" for candidate in REFERENCE_CANDIDATES)
    return next((p for p in paths if path_exists(spark, p)), None)
