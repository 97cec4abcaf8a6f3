"""Getting the package itself to the Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import lru_cache

from pyspark.sql import SparkSession


@lru_cache(maxsize=1)
def _archive() -> str:
    """A zip of the package, made once a process; Spark serves it to the executors, so it may lie with the driver."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="skyanchor-"), "skyanchor.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(os.path.join(root, "skyanchor")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    return path


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable in the workers of a session, whatever their working folder; once an application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        spark.sparkContext.addPyFile(_archive())
        _shipped.add(app)
    return spark
