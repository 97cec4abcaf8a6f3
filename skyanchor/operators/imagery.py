"""Tiles and rasters: covering, prefetching, probing, stitching, generating cells, perturbing."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import TILE, Georef, _c

MIN_TILE_STD, PROBE_TILES = 8.0, 9


def tile_url(template, zoom, x, y) -> Column:
    """A provider's template with {z}, {x} and {y}, in whatever order it has them, filled in."""
    out = _c(template)
    for mark, v in (("{z}", zoom), ("{x}", x), ("{y}", y)):
        out = F.replace(out, F.lit(mark), _c(v).cast("string"))
    return out


def tile_cover(windows: DataFrame) -> DataFrame:
    """windows (…, center_lon, center_lat, zoom, width, height) with a row for each tile (tx, ty) that they touch.

    The top-left pixel of a window is rounded half to even.  Rows of the world's
    other side are left out; columns wrap around.
    """
    g = Georef(*(F.col(c) for c in ("center_lon", "center_lat", "zoom", "width", "height")))
    ox, oy = g.origin
    x0, y0 = F.bround(ox).cast("bigint"), F.bround(oy).cast("bigint")
    n = F.pow(F.lit(2), F.col("zoom")).cast("bigint")
    w = windows.withColumn("x0", x0).withColumn("y0", y0)
    span = lambda a, size: F.sequence(F.floor(F.col(a) / TILE), F.floor((F.col(a) + F.col(size) - 1) / TILE))
    t = w.withColumn("ty", F.explode(span("y0", "height"))).withColumn("tx", F.explode(span("x0", "width"))).filter((F.col("ty") >= 0) & (F.col("ty") < n))
    return t.withColumn("tx", F.pmod(F.col("tx"), n)).drop("x0", "y0")


def missing_tiles(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Distinct wanted (zoom, tx, ty) that the cache (zoom, tx, ty, length) lacks; an empty file is a miss."""
    key = ["zoom", "tx", "ty"]
    return wanted.select(*key).distinct().join(cached.filter("length > 0").select(*key), key, "left_anti")


def probe(tiles: DataFrame, by: list[str], least_std: float = MIN_TILE_STD) -> DataFrame:
    """(by..., tiles, structured, identical, has_imagery) of probed tiles (by..., std, bytes).

    All tiles of the same bytes are a placeholder; otherwise one structured tile suffices.
    """
    g = tiles.groupBy(*by).agg(
        F.count("*").alias("tiles"), F.count_if(F.col("std") >= least_std).alias("structured"), ((F.countDistinct(F.sha2("bytes", 256)) == 1) & (F.count("*") > 1)).alias("identical")
    )
    return g.withColumn("has_imagery", ~F.col("identical") & (F.col("structured") > 0))


def deepest_zoom(probes: DataFrame, by: list[str], least: int = 14) -> DataFrame:
    """(by..., zoom): the greatest zoom with imagery, null if none from least on."""
    return probes.groupBy(*by).agg(F.max(F.when(F.col("has_imagery") & (F.col("zoom") >= least), F.col("zoom"))).alias("zoom"))


def generate_cells(regions: DataFrame) -> DataFrame:
    """The cells of regions (region_id, center_lon, center_lat, zoom, region_px, cell_px, overlap, rotations array<double>).

    Centres run from half a cell to the region less half a cell, rows outermost,
    rotations innermost; cell_no numbers a region's cells in that order from 0.
    """
    step = F.greatest(F.lit(1), F.bround(F.col("cell_px") * (1 - F.col("overlap"))).cast("int"))
    r = regions.withColumn("step", step).withColumn("half", F.col("cell_px") / 2)
    n = F.floor((F.col("region_px") - 2 * F.col("half") + 1e-6) / F.col("step")).cast("int")
    r = r.withColumn("n", n).filter("n >= 0")
    r = r.withColumn("iy", F.explode(F.sequence(F.lit(0), F.col("n")))).withColumn("ix", F.explode(F.sequence(F.lit(0), F.col("n"))))
    r = r.select("*", F.posexplode("rotations").alias("ir", "rotation_deg"))
    g = Georef(F.col("center_lon"), F.col("center_lat"), F.col("zoom"), F.col("region_px"), F.col("region_px"))
    lon, lat = g.to_lonlat(F.col("half") + F.col("ix") * F.col("step") - 0.5, F.col("half") + F.col("iy") * F.col("step") - 0.5)
    no = (F.col("iy").cast("bigint") * (F.col("n") + 1) + F.col("ix")) * F.size("rotations") + F.col("ir")
    return r.select("region_id", no.alias("cell_no"), lon.alias("lon"), lat.alias("lat"), "zoom", F.col("cell_px").alias("size_px"), "rotation_deg")


def stitch(placed: DataFrame) -> DataFrame:
    """(window_id, height, width, pixels): the mosaic of tiles (window_id, dx, dy, width, height, tile) of 256 x 256 bytes.

    dx, dy place a tile's corner in the window, possibly outside; missing parts stay
    0.  A tile of another size is an error, and so is a window without any tile's
    part: it lies outside the world.
    """

    def run(key, table):
        rows = table.to_pylist()
        w, h = rows[0]["width"], rows[0]["height"]
        out, met = np.zeros((h, w), np.uint8), False
        for r in rows:
            x, y = r["dx"], r["dy"]
            met |= x < w and y < h and x > -TILE and y > -TILE
            if r["tile"] is None:
                continue
            if len(r["tile"]) != TILE * TILE:
                raise ValueError(f"window {key[0].as_py()}: a tile of {len(r['tile'])} bytes is not {TILE} x {TILE}")
            z = np.frombuffer(r["tile"], np.uint8).reshape(TILE, TILE)
            x0, y0, x1, y1 = max(0, x), max(0, y), min(w, x + TILE), min(h, y + TILE)
            if x1 > x0 and y1 > y0:
                out[y0:y1, x0:x1] = z[y0 - y : y1 - y, x0 - x : x1 - x]
        if not met:
            raise ValueError(f"window {key[0].as_py()} lies outside the world")
        return pa.table({"window_id": pa.array([key[0].as_py()], pa.int64()), "height": pa.array([h], pa.int32()), "width": pa.array([w], pa.int32()), "pixels": pa.array([out.tobytes()], pa.binary())})

    return placed.groupBy("window_id").applyInArrow(run, "window_id bigint, height int, width int, pixels binary")


def luma(r, g, b) -> Column:
    return 0.299 * _c(r) + 0.587 * _c(g) + 0.114 * _c(b)


def block_mean(pixels: DataFrame, factor: int) -> DataFrame:
    """Pixels (image_id, y, x, v) downsampled by a whole factor."""
    return pixels.groupBy("image_id", F.floor(F.col("y") / factor).alias("y"), F.floor(F.col("x") / factor).alias("x")).agg(F.avg("v").alias("v"))


def exposed(v, gamma, contrast, brightness) -> Column:
    """Bytes under another exposure: a power of the light, a contrast about black and a shift, clipped."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), _c(contrast) * 255 * F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(v) / 255)), _c(gamma)) + _c(brightness)))


def remapped(v, strength) -> Column:
    """Bytes as another season or sensor shows them: a remap of tones that turns some gradients round, clipped."""
    x = _c(v) / 255
    return 255 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), x + _c(strength) * 0.35 * F.sin(3 * math.pi * x)))


def appearance_seed(*, yaw_deg, altitude_ratio, prior_offset_m, level, strength) -> Column:
    """The seed of a sample's appearance, from what the sample is."""
    raw = _c(yaw_deg) * 1000.0 + _c(altitude_ratio) * 733.0 + _c(prior_offset_m) * 13.0 + _c(level) * 7919.0 + _c(strength) * 131.0
    return F.floor(F.abs(raw)).cast("bigint").bitwiseAND(F.lit((1 << 32) - 1))


def perturbed(rasters: DataFrame) -> DataFrame:
    """rasters (image_id, height, width, pixels, level, strength, seed) with pixels as raster.appearance() leaves them."""
    from ..functions.raster import appearance

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("pixels")
            out = []
            for r in batch.to_pylist():
                z = None if r["pixels"] is None else np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"])
                out.append(None if z is None else appearance(z, r["level"], r["strength"], r["seed"]).tobytes())
            yield batch.set_column(at, "pixels", pa.array(out, pa.binary()))

    return rasters.mapInArrow(run, rasters.schema)


def rotate(z: np.ndarray, degrees: float) -> np.ndarray:
    """A raster turned about its centre, bilinear, its border reflected."""
    h, w = z.shape
    t = np.radians(degrees)
    yy, xx = np.mgrid[0:h, 0:w].astype(float)
    cx, cy = (w - 1) / 2, (h - 1) / 2
    sx = np.cos(t) * (xx - cx) - np.sin(t) * (yy - cy) + cx
    sy = np.sin(t) * (xx - cx) + np.cos(t) * (yy - cy) + cy

    def reflect(v, n):
        if n == 1:
            return np.zeros_like(v)
        v = np.mod(np.abs(v), 2 * (n - 1))
        return np.minimum(v, 2 * (n - 1) - v)

    sx, sy = reflect(sx, w), reflect(sy, h)
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = sx - x0, sy - y0
    return (z[y0, x0] * (1 - fx) + z[y0, x1] * fx) * (1 - fy) + (z[y1, x0] * (1 - fx) + z[y1, x1] * fx) * fy


def north_up_side(width, height) -> Column:
    """Side of the square that fits at any turn: the shorter side over root two, even."""
    return (F.floor(F.least(_c(width), _c(height)) / (2**0.5) / 2) * 2).cast("int")


def north_up(rasters: DataFrame) -> DataFrame:
    """rasters (image_id, height, width, pixels, yaw_deg) turned north and cut to the square of north_up_side(), with side and pixels."""
    from ..functions.raster import north_up_crop

    def run(batches):
        for batch in batches:
            rows = [(r["image_id"], north_up_crop(np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"]), r["yaw_deg"])) for r in batch.to_pylist() if r["pixels"] is not None]
            pixels = [np.clip(np.round(z), 0, 255).astype(np.uint8).tobytes() for _, z in rows]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([len(z) for _, z in rows], pa.int32()), pa.array(pixels, pa.binary())], names=["image_id", "side", "pixels"])

    return rasters.select(F.col("image_id").cast("bigint").alias("image_id"), "height", "width", "pixels", "yaw_deg").mapInArrow(run, "image_id bigint, side int, pixels binary")


def equalised(rasters: DataFrame, clip: float = 2.0, tiles: int = 8) -> DataFrame:
    """rasters (image_id, height, width, pixels) with their light evened out by clipped histograms of tiles."""
    from ..functions.raster import clahe

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("pixels")
            out = [None if r["pixels"] is None else clahe(np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"]), clip, tiles).tobytes() for r in batch.to_pylist()]
            yield batch.set_column(at, "pixels", pa.array(out, pa.binary()))

    return rasters.mapInArrow(run, rasters.schema)
