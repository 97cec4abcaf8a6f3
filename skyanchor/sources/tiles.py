"""Tile caches, providers and raster sources."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.geo import _c
from .shared import cut, make_folder

#: Providers up to which the registry is broadcast.
BROADCAST_PROVIDERS = 10_000
PROVIDER_SCHEMA = "provider string, template string, max_zoom int"
TILE_SCHEMA = "provider string, zoom int, tx bigint, ty bigint, length bigint, bytes binary"


def providers(spark: SparkSession, rows: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """The registry (provider, template, max_zoom) as a dimension."""
    return spark.createDataFrame(rows or [("demo", "https://tiles.example/{z}/{y}/{x}", 19)], PROVIDER_SCHEMA)


def with_provider(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """rows (provider, …) with their provider's columns; an unknown provider fails the query, by name."""
    if registry.count() <= BROADCAST_PROVIDERS:
        registry = F.broadcast(registry)
    j = rows.join(registry, "provider", "left")
    return j.withColumn("template", F.when(F.col("template").isNull(), F.raise_error(F.concat(F.lit("unknown provider "), F.coalesce("provider", F.lit("null"))))).otherwise(F.col("template")))


def read_cache(spark: SparkSession, root: str) -> DataFrame:
    """TILE_SCHEMA of files root/provider/z/x/y.ext; empty files are misses and left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    part = lambda i: F.regexp_extract("path", r"([^/]+)/(\d+)/(\d+)/(\d+)\.\w+$", i)
    rows = raw.filter("length > 0").select(part(1).alias("provider"), part(2).cast("int").alias("zoom"), part(3).cast("bigint").alias("tx"), part(4).cast("bigint").alias("ty"), "length", F.col("content").alias("bytes"))
    return rows.filter("provider <> ''")


def write_store(tiles: DataFrame, path: str) -> None:
    """Add tiles to a Parquet store, partitioned by provider and zoom; those already there and empty ones are left alone.

    Spark's committer makes each file appear whole or not at all.
    """
    spark = tiles.sparkSession
    key = ["provider", "zoom", "tx", "ty"]
    new = tiles.filter("length > 0 and bytes is not null").dropDuplicates(key)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        new = new.join(read_store(spark, path).select(*key), key, "left_anti")
    else:
        make_folder(spark, path)
    new.write.mode("append").partitionBy("provider", "zoom").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TILE_SCHEMA).parquet(path)


#: Threads that fetch in a task, further tries of a failed request, and what such requests call themselves.
FETCHERS, RETRIES, AGENT = 8, 2, "skyanchor"


def http_get(url: str, timeout: float = 15.0, retries: int = RETRIES, pause: float = 0.5) -> bytes:
    """The body of a GET, tried again after growing pauses where the network fails."""
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as answer:
                return answer.read()
        except OSError:
            if attempt == retries:
                raise
            time.sleep(pause * (attempt + 1))
    raise AssertionError


def fetch_from(templates: dict[str, str], get: Callable[[str], bytes] = http_get) -> Callable[[str, int, int, int], bytes | None]:
    """A fetch function for load_tiles() and prefetch() from the providers' URL templates."""

    def fetch(provider: str, zoom: int, x: int, y: int) -> bytes | None:
        url = templates[provider]
        for mark, v in (("{z}", zoom), ("{x}", x), ("{y}", y)):
            url = url.replace(mark, str(v))
        return get(url)

    return fetch


def prefetch(wanted: DataFrame, path: str, fetch: Callable[[str, int, int, int], bytes | None], partitions: int = 8) -> int:
    """Fetch those of wanted (provider, zoom, tx, ty) that the store at path lacks, FETCHERS at a time in each task, and add them to it; how many came.

    What fails is left out and stays missing; nothing that is there is fetched or written again.
    """
    spark, key = wanted.sparkSession, ["provider", "zoom", "tx", "ty"]
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    new = wanted.select(*key).distinct()
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        new = new.join(read_store(spark, path).select(*key), key, "left_anti")

    def one(r: dict) -> bytes | None:
        try:
            return fetch(*(r[k] for k in key)) or None
        except Exception:  # noqa: BLE001  (best effort, tile by tile)
            return None

    def run(batches):
        schema = pa.schema([("provider", pa.string()), ("zoom", pa.int32()), ("tx", pa.int64()), ("ty", pa.int64()), ("length", pa.int64()), ("bytes", pa.binary())])
        with ThreadPoolExecutor(FETCHERS) as pool:
            for batch in batches:
                rows = batch.to_pylist()
                out = [{**r, "length": len(x), "bytes": x} for r, x in zip(rows, pool.map(one, rows)) if x]
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    got = cut(new.repartition(partitions).mapInArrow(run, TILE_SCHEMA))
    write_store(got, path)
    return got.count()


def load_tiles(wanted: DataFrame, cached: DataFrame, fetch: Callable[[str, int, int, int], bytes | None], decodes: Callable[[bytes], bool], partitions: int = 8) -> DataFrame:
    """TILE_SCHEMA plus state of each wanted (provider, zoom, tx, ty): 'cached', 'fetched', 'refetched' or 'missing'.

    A cached tile that doesn't decode is fetched anew once.  fetch runs in Python
    workers over partitions tasks and may give None; no failure of one tile
    fails the others.
    """
    key = ["provider", "zoom", "tx", "ty"]
    j = wanted.select(*key).distinct().join(cached.filter("length > 0").select(*key, "bytes"), key, "left").repartition(partitions)

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                data, state = r["bytes"], "cached"
                if data is None or not decodes(data):
                    state = "fetched" if data is None else "refetched"
                    try:
                        data = fetch(r["provider"], r["zoom"], r["tx"], r["ty"])
                    except Exception:  # noqa: BLE001  (best effort, tile by tile)
                        data = None
                    if not data or not decodes(data):
                        data, state = None, "missing"
                out.append({**{k: r[k] for k in key}, "length": len(data) if data else None, "bytes": data, "state": state})
            schema = pa.schema([("provider", pa.string()), ("zoom", pa.int32()), ("tx", pa.int64()), ("ty", pa.int64()), ("length", pa.int64()), ("bytes", pa.binary()), ("state", pa.string())])
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return j.mapInArrow(run, TILE_SCHEMA + ", state string")


def decode_images(spark: SparkSession, root: str, side: int | None = None) -> DataFrame:
    """(path, height, width, channels, pixels) of image files by the JVM's decoder; files that it can't read are left out.

    With side, an image of another size fails the query, by its path: a provider's tiles are all alike.
    """
    raw = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(root)
    if side is not None:
        wrong = F.concat(F.lit("not a tile of "), F.lit(f"{side} x {side}: "), F.col("image.origin"))
        raw = raw.withColumn("image", F.when((F.col("image.height") == side) & (F.col("image.width") == side), F.col("image")).otherwise(F.raise_error(wrong).cast(raw.schema["image"].dataType)))
    return raw.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"))


class SceneReader(DataSourceReader):
    def __init__(self, options):
        self.size, self.seed, self.rows = int(options.get("size", "256")), int(options.get("seed", "0")), int(options.get("rows", "64"))

    def partitions(self):
        return [InputPartition(y) for y in range(0, self.size, self.rows)]

    def read(self, partition):
        for y in range(partition.value, min(self.size, partition.value + self.rows)):
            for x in range(self.size):
                yield y, x, float((x * 7 + y * 13 + (x * y) % 11 + self.seed * 31) % 256)


class SceneSource(DataSource):
    """A synthetic raster as a source: spark.read.format('scene').option('size', …).option('seed', …).load()."""

    @classmethod
    def name(cls):
        return "scene"

    def schema(self):
        return "y int, x int, v double"

    def reader(self, schema):
        return SceneReader(self.options)


def scene(spark: SparkSession, size: int = 256, seed: int = 0) -> DataFrame:
    spark.dataSource.register(SceneSource)
    return spark.read.format("scene").option("size", str(size)).option("seed", str(seed)).load()


def scene_at(pixels: DataFrame, native_zoom: int, zoom: int) -> DataFrame:
    """A scene (y, x, v) at its native zoom or coarser by block means; finer than native is an error."""
    if zoom > native_zoom:
        raise ValueError(f"zoom {zoom} is finer than the scene's {native_zoom}")
    f = 1 << (native_zoom - zoom)
    return pixels.groupBy(F.floor(F.col("y") / f).alias("y"), F.floor(F.col("x") / f).alias("x")).agg(F.avg("v").alias("v"))


def normalise(pixels: DataFrame, by: str = "image_id") -> DataFrame:
    """Pixels (by, y, x, v) stretched to 0..255 over each image's range; a flat image becomes 0."""
    ends = pixels.groupBy(by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    v = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255).otherwise(0.0)
    return pixels.join(ends, by).select(by, "y", "x", v.alias("v"))


def elevation(points: DataFrame, dem: DataFrame, step_deg: float = 0.01) -> DataFrame:
    """points (lat, lon, …) with ground_m of the DEM cell (gy, gx, ground_m) that they fall in, null off the DEM."""
    g = lambda c: F.floor(_c(c) / step_deg)
    return points.withColumn("gy", g("lat")).withColumn("gx", g("lon")).join(dem, ["gy", "gx"], "left").drop("gy", "gx")


def known(provider) -> Column:
    return _c(provider).isNotNull() & (F.trim(_c(provider)) != "")
