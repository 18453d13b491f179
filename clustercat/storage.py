"""Shared storage for tables that are read more than once or that cut lineage.

A kept table is Parquet in the folder the cluster names in
``spark.checkpoint.dir``, so it outlives any executor, and reading it back
gives the optimiser true file sizes: small tables broadcast by themselves,
large ones join by shuffle. No code here forces a broadcast, and what grows with the
rows is kept from one by :func:`unbroadcast`.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for kept tables: ``spark.checkpoint.dir``, or a fresh one in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="clustercat-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


def _app_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/clustercat-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{_app_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to shared storage now and return the stored table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def unbroadcast(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled however small it is.

    For tables with a row for each point, edge or fragment: below the optimiser's threshold each would be collected
    in the driver, once a join, and an iteration has many. Tables with a row for each cell are left to the optimiser.
    """
    return df.hint("merge")


def _delete(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def drop_kept(df: DataFrame) -> None:
    """Delete a table made by :func:`keep` once nothing reads it any more."""
    _delete(df.sparkSession, df._kept_at)


def clear(spark: SparkSession) -> None:
    """Delete everything this application kept; results not yet written are lost."""
    _delete(spark, _app_dir(spark))
