"""Terrain indexes as partitioned tables under content-addressed names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save(cells: DataFrame, path: str, model: DataFrame | None = None, cell_deg: float = 0.1) -> None:
    """Cells by Parquet, partitioned by a coarse latitude band so that a prior's disk prunes files, with the PCA model beside."""
    banded = cells.withColumn("band", F.floor(F.col("lat") / cell_deg).cast("int"))
    banded.repartitionByRange(F.col("band"), F.col("lon")).write.mode("overwrite").partitionBy("band").parquet(f"{path}/cells")
    if model is not None:
        model.coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    cells.sparkSession.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}/done")


def load(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """The cells of a saved index; with dim a different embedding size is an error."""
    cells = spark.read.parquet(f"{path}/cells")
    if dim is None:
        return cells
    size = F.size("embedding")
    checked = F.when(size == dim, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit(f"the index doesn't have {dim} dimensions but "), size.cast("string"))))
    return cells.withColumn("embedding", F.when(F.col("embedding").isNotNull(), checked))


def near(spark: SparkSession, path: str, lat: float, lon: float, radius_m: float, cell_deg: float = 0.1) -> DataFrame:
    """Cells of a saved index in a box about a place; whole bands are pruned."""
    d = radius_m / 111_320.0
    import math

    shrink = max(0.01, math.cos(math.radians(lat)))
    e = d / shrink
    bands = range(math.floor((lat - d) / cell_deg), math.floor((lat + d) / cell_deg) + 1)
    return load(spark, path).filter(F.col("band").isin(*bands) & F.col("lat").between(lat - d, lat + d) & F.col("lon").between(lon - e, lon + e))


def build_or_load(spark: SparkSession, root: str, key: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The index of a key and whether it was there; an unfinished build is built anew."""
    path = f"{root.rstrip('/')}/{key}"
    there = _exists(spark, f"{path}/done/_SUCCESS")
    if not there:
        save(build(), path)
    return load(spark, path), there
