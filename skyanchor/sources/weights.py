"""Checkpoints: their catalogue and how much of a model a state covers."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOGUE = "kernel string, file string, url string, sha256 string"


def coverage(model: DataFrame, state: DataFrame, renames: dict[str, str] | None = None, least: float = 0.9) -> DataFrame:
    """(model, tensors, loaded, coverage, ok) of model (model, name, shape) by state (name, shape), matched by name and shape after renaming."""
    name = F.col("name")
    for pattern, to in (renames or {}).items():
        name = F.regexp_replace(name, pattern, to)
    s = state.select(name.alias("name"), "shape", F.lit(1).alias("hit")).distinct()
    g = model.join(s, ["name", "shape"], "left").groupBy("model").agg(F.count("*").alias("tensors"), F.count("hit").alias("loaded"))
    share = F.col("loaded") / F.col("tensors")
    return g.select("model", "tensors", "loaded", share.alias("coverage"), (share >= least).alias("ok"))


def located(catalogue: DataFrame, folder: str, files: DataFrame) -> DataFrame:
    """catalogue (kernel, file, …) with path and found: where each kernel's file should lie in folder and whether it is among files (path)."""
    c = catalogue.withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), F.col("file")))
    there = files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.lit(True).alias("found")).distinct()
    return c.join(there, "path", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """(name, shape, dtype, begin, end) of the tensors of a safetensors file, from its header alone; offsets count from the header's end."""
    with open(path, "rb") as f:
        size = int.from_bytes(f.read(8), "little")
        if not 0 < size <= os.path.getsize(path) - 8:
            raise ValueError(f"{path} is not a safetensors file")
        head = json.loads(f.read(size))
    rows = [(k, json.dumps(v["shape"]), v["dtype"], *v["data_offsets"]) for k, v in head.items() if k != "__metadata__"]
    return spark.createDataFrame(rows, "name string, shape string, dtype string, begin bigint, end bigint")


def load_verified(model: DataFrame, path: str, renames: dict[str, str] | None = None, least: float = 0.9) -> DataFrame:
    """The tensors of a file that fit model (model, name, shape) by name and shape, after renaming; too small a share is an error, as the model would run on noise."""
    state = read_state(model.sparkSession, path)
    bad = coverage(model, state, renames, least).filter("not ok").collect()
    if bad:
        raise ValueError("; ".join(f"{r.model}: {r.loaded} of {r.tensors} tensors" for r in bad))
    name = F.col("name")
    for pattern, to in (renames or {}).items():
        name = F.regexp_replace(name, pattern, to)
    return model.join(state.withColumn("name", name), ["name", "shape"])
