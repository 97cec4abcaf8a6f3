"""The engine's relations drawn from the provided tables, in Spark and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import METRES_PER_DEGREE, offset_prior


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map cells on a grid of 25 columns."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("cell_id"),
        (F.lit(54.7) + F.lit(0.002) * F.expr("vec_id div 25").cast("double")).alias("lat"),
        (F.lit(55.9) + F.lit(0.003) * (F.col("vec_id") % 25).cast("double")).alias("lon"),
        F.lit(18).alias("zoom"),
        F.lit(350).alias("size_px"),
        (F.lit(45.0) * (F.col("label") % 8)).alias("rotation_deg"),
        "embedding",
        "label",
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames at every 23rd cell, with a prior half a sigma off the truth."""
    c = cells(spark, sf_dir).filter("cell_id % 23 = 0").withColumn("sigma_m", F.lit(500.0) * (1 + F.col("label") % 3))
    lat, lon = offset_prior(lat="lat", lon="lon", sigma_m="sigma_m", index=F.expr("cell_id div 23"))
    return c.select(F.col("cell_id").alias("frame_id"), F.col("lat").alias("true_lat"), F.col("lon").alias("true_lon"), lat.alias("prior_lat"), lon.alias("prior_lon"), "sigma_m", "embedding")


def correspondences(spark: SparkSession, sf_dir: str, outliers: bool = False) -> DataFrame:
    """Matched points of each frame under a planted scale of 1.1 and turn of 30 degrees, i numbering them within the frame."""
    rows = read(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_suppkey").alias("frame_id"), "l_orderkey", "l_partkey").distinct()
    q = rows.selectExpr(
        "frame_id", "l_orderkey", "l_partkey", "cast(l_partkey % 512 as double) qx", "cast(l_orderkey % 512 as double) qy",
        "((7 * l_orderkey + 3) % 11 - 5) / 10D nx", "((5 * l_partkey + 1) % 13 - 6) / 10D ny",
    )
    a, b = 1.1 * 0.8660254037844387, 1.1 * 0.5
    bad = F.when(F.col("l_partkey") % 4 == 0, 100.0).otherwise(0.0) if outliers else F.lit(0.0)
    return q.select(
        "frame_id",
        (F.expr("row_number() over (partition by frame_id order by l_orderkey, l_partkey)").cast("bigint") - 1).alias("i"),
        "qx",
        "qy",
        (F.lit(a) * F.col("qx") - F.lit(b) * F.col("qy") + 40 + F.col("nx") + bad).alias("rx"),
        (F.lit(b) * F.col("qx") + F.lit(a) * F.col("qy") - 25 + F.col("ny") + bad).alias("ry"),
    )


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows from orders; unverified where the truth is missing."""
    o = read(spark, sf_dir, "orders")
    pose = F.col("o_orderstatus") != "P"
    known = F.col("o_custkey") % 10 != 0
    return o.select(
        F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("case"),
        F.col("o_orderkey").alias("k"),
        F.when(F.col("o_orderstatus") == "F", "localized").when(F.col("o_orderstatus") == "O", "low_confidence").otherwise("not_localized").alias("status"),
        (F.col("o_orderstatus") == "F").cast("int").alias("accepted"),
        F.when(pose & known, (F.col("o_orderkey") % 200).cast("double")).alias("error_m"),
        F.when(F.col("o_custkey") % 4 == 0, "manual").otherwise("exif").alias("truth_source"),
        (F.col("o_custkey") % 600 + 50).cast("double").alias("footprint_m"),
        F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 60 + 1).cast("int")).alias("true_cell_rank"),
        (F.col("o_orderkey") % 300).cast("int").alias("n_inliers"),
        F.when(F.col("o_custkey") % 5 != 0, (F.col("o_orderkey") % 100) / 100.0).alias("photometric"),
        ((F.col("o_custkey") % 50) / 10.0).alias("ellipse_m"),
        F.col("o_orderpriority").alias("regime"),
    )


CELLS = """cells AS (SELECT vec_id AS cell_id, 54.7e0 + 0.002e0 * (vec_id // 25)::DOUBLE AS lat, 55.9e0 + 0.003e0 * (vec_id % 25)::DOUBLE AS lon,
  18 AS zoom, 350 AS size_px, 45.0e0 * (label % 8) AS rotation_deg, embedding::DOUBLE[] AS e, label FROM embeddings)"""
FRAMES = f"""{CELLS},
f0 AS (SELECT cell_id AS frame_id, lat AS true_lat, lon AS true_lon, 500.0e0 * (1 + label % 3) AS sigma_m, e, ((cell_id // 23) % 4) AS dir FROM cells WHERE cell_id % 23 = 0),
frames AS (SELECT frame_id, true_lat, true_lon, sigma_m, e,
  round_even(true_lat + [1, 0, -1, 0][dir + 1] * (sigma_m * 0.5e0) / {METRES_PER_DEGREE}e0, 5) AS prior_lat,
  round_even(true_lon + [0, 1, 0, -1][dir + 1] * ((sigma_m * 0.5e0) / ({METRES_PER_DEGREE}e0 * greatest(cos(radians(true_lat)), 0.01e0))), 5) AS prior_lon FROM f0)"""


def corr_sql(outliers: bool = False) -> str:
    bad = "CASE WHEN l_partkey % 4 = 0 THEN 100.0e0 ELSE 0.0e0 END" if outliers else "0.0e0"
    a, b = repr(1.1 * 0.8660254037844387), repr(1.1 * 0.5)
    return f"""d0 AS (SELECT DISTINCT l_suppkey AS frame_id, l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 1),
d1 AS (SELECT *, (l_partkey % 512)::DOUBLE AS qx, (l_orderkey % 512)::DOUBLE AS qy, ((7 * l_orderkey + 3) % 11 - 5) / 10.0e0 AS nx, ((5 * l_partkey + 1) % 13 - 6) / 10.0e0 AS ny FROM d0),
corr AS (SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY l_orderkey, l_partkey) - 1 AS i, qx, qy,
  {a}::DOUBLE * qx - {b}::DOUBLE * qy + 40 + nx + {bad} AS rx, {b}::DOUBLE * qx + {a}::DOUBLE * qy - 25 + ny + {bad} AS ry FROM d1)"""


EVAL = """ev AS (SELECT 'c' || o_orderkey AS "case", o_orderkey AS k,
  CASE o_orderstatus WHEN 'F' THEN 'localized' WHEN 'O' THEN 'low_confidence' ELSE 'not_localized' END AS status, (o_orderstatus = 'F')::INT AS accepted,
  CASE WHEN o_orderstatus <> 'P' AND o_custkey % 10 <> 0 THEN (o_orderkey % 200)::DOUBLE END AS error_m,
  CASE WHEN o_custkey % 4 = 0 THEN 'manual' ELSE 'exif' END AS truth_source, (o_custkey % 600 + 50)::DOUBLE AS footprint_m,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 60 + 1 END AS true_cell_rank, o_orderkey % 300 AS n_inliers,
  CASE WHEN o_custkey % 5 <> 0 THEN (o_orderkey % 100) / 100.0e0 END AS photometric, (o_custkey % 50) / 10.0e0 AS ellipse_m, o_orderpriority AS regime FROM orders)"""


def haversine_sql(a: str, b: str, c: str, d: str) -> str:
    return f"(12742017.6e0 * asin(sqrt(least(1.0e0, greatest(0.0e0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))))))"
