"""Manifests, frozen tables and evaluation rows as files."""

from __future__ import annotations

import json

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE = "name string, path string, truth_lat double, truth_lon double, regime string, gsd_m double, altitude_m double, prior_lat double, prior_lon double, sigma_m double, altitude_sigma_m double, trust_yaw boolean, truth_source string, notes string"
EVAL = (
    "case string, matcher string, truth_source string, trust_yaw int, gsd_m double, footprint_m int, cells int, rotations int, overlap double, status string, accepted int, error_m double, tolerance_m int, correct int, blame string, "
    "true_cell_rank int, true_cell_m double, top1_to_truth_m double, uniqueness double, n_inliers int, photometric double, photometric_kind string, certainty_mean double, certainty_cover double, ellipse_m double, "
    "found_lat double, found_lon double, heading_deg double, offline_s double, online_s double, reason string"
)
GOLDEN = "case string, outcome string, error_m double, true_cell_rank int, n_inliers int, ncc double, note string"


def _pair(v) -> tuple[float | None, float | None]:
    if v is None:
        return None, None
    if isinstance(v, str):
        a, b = v.split(",")
        return float(a), float(b)
    return float(v["lat"]), float(v["lon"])


ENTRY = "name string, path string, regime string, notes string, prior_lat double, prior_lon double, sigma_m double, altitude_sigma_m double"


def cases_from_shots(entries: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases of ENTRY rows whose path is among metadata.full_shots(), and (name, reason) of the others.

    Camera, height, heading and truth are the shot's, so the heading is trusted; the
    prior stands at the truth unless the entry says otherwise.
    """
    s = found.select("path", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), F.col("altitude_m").alias("s_m"), (2 * F.col("altitude_m") * F.tan(F.radians("fov_deg") / 2) / F.col("width")).alias("s_gsd"))
    j = entries.join(s, "path", "left")
    ok = j.filter("s_lat is not null and s_gsd > 0").select(
        "name", "path", F.col("s_lat").alias("truth_lat"), F.col("s_lon").alias("truth_lon"), F.coalesce("regime", F.lit("in_season")).alias("regime"), F.col("s_gsd").alias("gsd_m"), F.col("s_m").alias("altitude_m"),
        F.coalesce("prior_lat", "s_lat").alias("prior_lat"), F.coalesce("prior_lon", "s_lon").alias("prior_lon"), "sigma_m", "altitude_sigma_m", F.lit(True).alias("trust_yaw"), F.lit("exif").alias("truth_source"), "notes",
    )
    return ok, j.filter("s_lat is null or s_gsd is null or s_gsd <= 0").select("name", F.lit("no usable metadata").alias("reason"))


def load_manifest(spark: SparkSession, text: str, shots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Cases and (name, reason) of entries left out, of YAML with a list 'cases'; a bad entry never spoils the others.

    Without metadata the scale comes from gsd_m, the heading isn't trusted and a
    truth is hand-set.  Defaults: altitude 500 m, sigma 2000 m, altitude sigma 50 m.
    An entry without gsd_m is made from its shot, of metadata.full_shots(), where those are given.
    """
    good, out, asked = [], [], []
    for i, e in enumerate((yaml.safe_load(text) or {}).get("cases") or []):
        name = e.get("name", f"#{i}") if isinstance(e, dict) else f"#{i}"
        try:
            if e.get("exclude"):
                out.append((name, str(e["exclude"])))
                continue
            truth, prior = _pair(e.get("truth")), e.get("prior") or {}
            if e.get("gsd_m") is None and shots is not None:
                at = _pair(prior) if prior.get("lat") is not None else (None, None)
                asked.append((name, e["path"], e.get("regime"), e.get("notes"), *at, float(prior.get("sigma_m", 2000.0)), float(prior.get("altitude_sigma_m", 50.0))))
                continue
            at = _pair(prior) if prior.get("lat") is not None else truth
            if at[0] is None:
                raise ValueError("neither prior nor truth")
            if e.get("gsd_m") is None or float(e["gsd_m"]) <= 0:
                raise ValueError("no scale")
            good.append(
                (name, e["path"], *truth, e.get("regime"), float(e["gsd_m"]), float(e.get("altitude_m", 500.0)), *at, float(prior.get("sigma_m", 2000.0)), float(prior.get("altitude_sigma_m", 50.0)), False, "manual" if truth[0] is not None else None, e.get("notes"))
            )
        except (AttributeError, KeyError, TypeError, ValueError) as x:
            out.append((str(name), f"{type(x).__name__}: {x}"))
    cases, left = spark.createDataFrame(good, CASE), spark.createDataFrame(out, "name string, reason string")
    if asked:
        made, missing = cases_from_shots(spark.createDataFrame(asked, ENTRY), shots)
        cases, left = cases.unionByName(made), left.unionByName(missing)
    return cases, left


def present(cases: DataFrame, files: DataFrame) -> DataFrame:
    """cases with found, whether their path is among files (path)."""
    return cases.join(files.select("path", F.lit(True).alias("found")).distinct(), "path", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def _part(data: dict, name: str):
    return (data.get(name) or {}).items()


def load_golden(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(case, outcome, …) and (key, value) of a frozen table in YAML: mappings 'cases' and 'config'."""
    data = yaml.safe_load(text) or {}
    num = lambda v, t: None if v is None else t(v)
    rows = [
        (k, v.get("outcome"), num(v.get("error_m"), float), num(v.get("true_cell_rank"), int), num(v.get("n_inliers"), int), num(v.get("ncc"), float), v.get("note"))
        for k, v in _part(data, "cases")
    ]
    config = [(k, None if v is None else str(v)) for k, v in _part(data, "config")]
    return spark.createDataFrame(rows, GOLDEN), spark.createDataFrame(config, "key string, value string")


def save_golden(golden: DataFrame, config: DataFrame) -> str:
    """The YAML of load_golden; a frozen table is as small as what a person reads, so it is gathered."""
    cases = {r["case"]: {k: v for k, v in r.asDict().items() if k != "case" and v is not None} for r in golden.orderBy("case").collect()}
    return yaml.safe_dump({"config": {r.key: r.value for r in config.orderBy("key").collect()}, "cases": cases}, sort_keys=False, allow_unicode=True)


def write_eval(rows: DataFrame, path: str, config: dict | None = None) -> None:
    """Evaluation rows as CSV with a header, nulls as empty cells, and the run's configuration as JSON beside them."""
    rows.write.mode("overwrite").option("header", "true").option("nullValue", "").option("emptyValue", "").csv(path)
    if config is not None:
        spark = rows.sparkSession
        spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.config.json")


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation rows; an empty cell is null, never 0."""
    text = ", ".join(f"{c.split()[0]} string" for c in EVAL.split(", "))
    raw = spark.read.schema(text).option("header", "true").csv(path)
    cols = []
    for c in EVAL.split(", "):
        name, kind = c.split()
        v = F.nullif(F.trim(F.col(name)), F.lit(""))
        cols.append((v if kind == "string" else v.try_cast("double").cast(kind) if kind == "int" else v.try_cast(kind)).alias(name))
    return raw.select(*cols)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the JSON beside evaluation rows."""
    m = F.from_json(F.col("value"), "map<string,string>")
    return spark.read.text(f"{path}.config.json").select(F.explode(m).alias("key", "value"))


def shot_index(found: DataFrame, sigma_m: float = 2000.0) -> DataFrame:
    """(path, taken, model, usable, problems, command) of metadata.shots(): a text index of a folder with a ready command for each usable shot."""
    usable = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("gsd_m").isNotNull()
    c = F.concat(
        F.format_string("locate %s --lat %.5f --lon %.5f --sigma-m %.0f --gsd %.4f", F.col("path"), F.col("lat"), F.col("lon"), F.lit(float(sigma_m)), F.col("gsd_m")),
        F.when(F.col("yaw_deg").isNotNull(), F.format_string(" --yaw %.1f", F.col("yaw_deg"))).otherwise(""),
    )
    return found.select("path", "taken", "model", usable.alias("usable"), F.array_join("problems", "; ").alias("problems"), F.when(usable, c).alias("command"))


def exif_index(cases: DataFrame) -> DataFrame:
    """(name, command): a ready command line for each case."""
    c = F.concat(
        F.format_string("locate %s --lat %.5f --lon %.5f --sigma-m %.0f", F.col("path"), F.col("prior_lat"), F.col("prior_lon"), F.col("sigma_m")),
        F.when(F.col("gsd_m").isNotNull(), F.format_string(" --gsd %.4f", F.col("gsd_m"))).otherwise(""),
    )
    return cases.select("name", c.alias("command"))
