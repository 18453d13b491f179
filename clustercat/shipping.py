"""Sending this package to the workers, which may not have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def archive(target: str) -> str:
    """Write the package's sources to the zip file ``target``."""
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    return target


def ship(spark: SparkSession) -> None:
    """Let the workers of this application import the package; Spark serves the archive to them."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        folder = tempfile.mkdtemp(prefix="clustercat-archive-")
        spark.sparkContext.addPyFile(archive(os.path.join(folder, "clustercat.zip")))
        _sent.add(app)
