"""What a machine needs before a run: a check that answers in rows."""

from __future__ import annotations

import importlib.metadata
import shutil
import sys

from pyspark.sql import DataFrame, SparkSession

NEEDED = {"pyspark": "4.0", "pyarrow": "15.0", "numpy": "1.26", "pandas": "2.0", "PyYAML": "5.0"}


def _at_least(found: str, least: str) -> bool:
    number = lambda v: [int("".join(c for c in x if c.isdigit()) or 0) for x in v.split(".")[:3]]
    return number(found) >= number(least)


def check(spark: SparkSession, free_gb: float = 1.0, folders: tuple[str, ...] = ()) -> DataFrame:
    """(name, ok, detail): Python, packages, the shared folder, free disk and folders that have to be there."""
    rows = [("python", sys.version_info >= (3, 11), sys.version.split()[0])]
    for name, least in NEEDED.items():
        try:
            found = importlib.metadata.version(name)
            rows.append((name, _at_least(found, least), f"{found}, {least} at least"))
        except importlib.metadata.PackageNotFoundError:
            rows.append((name, False, f"missing, {least} at least"))
    shared = spark.conf.get("spark.checkpoint.dir", None)
    rows.append(("shared folder", bool(shared) or spark.sparkContext.master.startswith("local["), shared or "spark.checkpoint.dir is not set"))
    free = shutil.disk_usage("/").free / 1e9
    rows.append(("disk", free >= free_gb, f"{free:.0f} GB free"))
    fs = lambda p: p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    rows += [(f"folder {p}", bool(fs(spark._jvm.org.apache.hadoop.fs.Path(p))), "") for p in folders]
    return spark.createDataFrame(rows, "name string, ok boolean, detail string")
