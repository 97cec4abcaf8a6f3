"""Storey one: which cells of the map a frame may show."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.geo import R_MEAN, _c, haversine
from ..sources.shared import cut
from .ordered import running_sums

FRAME_BLOCK, CELL_BLOCK, DESCRIPTOR_BLOCK = 256, 4096, 1024


def _blocks(df: DataFrame, key: str, rows: int, prefix: str, numbers: tuple[str, ...] = ()) -> DataFrame:
    """Rows packed as (ids, matrix of float32, and float64 of each of numbers), all binary, so that a pair of blocks is one matrix product."""
    names = [f"{prefix}_ids", f"{prefix}_m", *(f"{prefix}_{c}" for c in numbers)]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in _packed(batch.slice(at, rows))], names=names)

    some = df.filter(F.col("embedding").isNotNull()).select(F.col(key).cast("bigint").alias(key), F.col("embedding").cast("array<float>"), *(F.col(c).cast("double").alias(c) for c in numbers))
    return some.mapInArrow(run, ", ".join(f"{n} binary" for n in names))


def _packed(part) -> list[bytes]:
    """The columns of a batch or table of ids, vectors and numbers, null as NaN, as bytes."""
    ids, v, *numbers = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in part.columns)
    if len(set(np.asarray(v.value_lengths()).tolist())) > 1:
        raise ValueError("embeddings differ in dimension")
    return [np.asarray(ids).astype("<i8").tobytes(), np.asarray(v.flatten()).astype("<f4").tobytes(), *(c.to_numpy(zero_copy_only=False).astype("<f8").tobytes() for c in numbers)]


def _each(batches, *names: str):
    """The named binaries of the rows, one row at a time, as arrays of ids, matrix or numbers."""
    kinds = {"ids": "<i8", "m": "<f4"}
    for batch in batches:
        columns = [(batch.column(n), kinds.get(n.split("_", 1)[1], "<f8")) for n in names]
        for i in range(batch.num_rows):
            yield [np.frombuffer(c[i].as_buffer(), t) for c, t in columns]


def _aims(df: DataFrame, frames: int, numbers: tuple[str, ...]) -> DataFrame:
    """df (frame_id, embedding, numbers...) of so many rows in blocks as of _blocks(), with the prefix f, of FRAME_BLOCK rows at most."""
    names = ["f_ids", "f_m", *(f"f_{c}" for c in numbers)]

    def run(table: pa.Table) -> pa.Table:
        rest = table.drop_columns(["g"])
        parts = [_packed(rest.slice(at, FRAME_BLOCK)) for at in range(0, rest.num_rows, FRAME_BLOCK)]
        return pa.table([pa.array(c, pa.binary()) for c in zip(*parts)], names=names)

    g = F.pmod(F.xxhash64("frame_id"), F.lit(max(1, -(-frames // FRAME_BLOCK)))).alias("g")
    some = df.filter("embedding is not null").select(g, F.col("frame_id").cast("bigint").alias("frame_id"), F.col("embedding").cast("array<float>").alias("embedding"), *(F.col(c).cast("double").alias(c) for c in numbers))
    return some.groupBy("g").applyInArrow(run, ", ".join(f"{n} binary" for n in names))


def _matrix(m: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return m.reshape(len(ids), -1).astype(float)


def _dots(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Each row's dot product with v, or v's row, the same for equal rows wherever they stand."""
    return (m * v).sum(axis=1)


def _pair_dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """_dots() of the rows i of a with the rows j of b, so many at a time that memory is bounded."""
    step = max(1, (1 << 20) // max(1, a.shape[1]))
    return np.concatenate([_dots(b[j[at : at + step]], a[i[at : at + step]]) for at in range(0, len(i), step)] or [np.zeros(0)])


def _firsts(i: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k greatest v of each i, ties by the lesser id."""
    order = np.lexsort((ids, -v, i))
    n = i[order]
    return order[np.arange(len(n)) - np.searchsorted(n, n) < k]


def topk_join(frames: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """(frame_id, cell_id, similarity, rank): the k cells of greatest dot product for each frame, exactly.

    Ties go to the lesser cell_id.  Each pair of blocks gives no more than k rows
    a frame before the ranking, so what is shuffled is frames x cell blocks x k.
    A task holds one batch of pairs of blocks and works on one pair at a time, so its
    memory doesn't grow with the tables.  Null embeddings take no part.
    """

    def run(batches):
        for f_ids, f_m, c_ids, c_m in _each(batches, "f_ids", "f_m", "c_ids", "c_m"):
            a, b = _matrix(f_m, f_ids), _matrix(c_m, c_ids)
            s = a @ b.T
            n = min(k, len(c_ids))
            # all that reach the n-th value, so that ties at the edge are settled by cell_id
            edge = np.partition(s, len(c_ids) - n, axis=1)[:, len(c_ids) - n, None]
            i, j = np.nonzero(s >= edge - 1e-12)
            v = _pair_dots(a, b, i, j)
            some = _firsts(i, v, c_ids[j], n)
            yield pa.RecordBatch.from_arrays([pa.array(f_ids[i[some]]), pa.array(c_ids[j[some]]), pa.array(v[some])], names=["frame_id", "cell_id", "similarity"])

    pairs = _blocks(cells, "cell_id", CELL_BLOCK, "c").crossJoin(_blocks(frames, "frame_id", FRAME_BLOCK, "f"))
    scored = pairs.mapInArrow(run, "frame_id bigint, cell_id bigint, similarity double")
    ranked = scored.selectExpr("*", "row_number() over (partition by frame_id order by similarity desc, cell_id) as rank")
    return ranked.filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def nearest_from(frames: DataFrame, cells: DataFrame, guesses: DataFrame) -> DataFrame:
    """(frame_id, cell_id, similarity): topk_join()'s first of each frame, given guesses (frame_id, similarity) of some cell's similarity for all or some frames.

    Blocks meet in single precision, and only cells that may reach the guess and the
    block's best are looked at exactly, so a good guess costs one product a pair of
    blocks and a poor one gives no wrong result.
    """

    def run(batches):
        for f_ids, f_m, guess, c_ids, c_m in _each(batches, "f_ids", "f_m", "f_guess", "c_ids", "c_m"):
            a, b = f_m.reshape(len(f_ids), -1), c_m.reshape(len(c_ids), -1)
            s = a @ b.T
            # what rounding of single precision may hide
            slack = 2.0**-23 * (a.shape[1] + 8) * np.linalg.norm(a.astype(float), axis=1) * np.linalg.norm(b.astype(float), axis=1).max() + 1e-12
            best = s.max(axis=1)
            least = np.fmax(guess, best) - 2 * slack
            rows = np.flatnonzero(best >= least)
            i, j = np.nonzero(s[rows] >= least[rows, None])
            i = rows[i]
            v = _pair_dots(a.astype(float), b.astype(float), i, j)
            some = _firsts(i, v, c_ids[j], 1)
            yield pa.RecordBatch.from_arrays([pa.array(f_ids[i[some]]), pa.array(c_ids[j[some]]), pa.array(v[some])], names=["frame_id", "cell_id", "similarity"])

    guessed = frames.select("frame_id", "embedding").join(guesses.select("frame_id", F.col("similarity").alias("guess")), "frame_id", "left")
    pairs = _blocks(cells, "cell_id", CELL_BLOCK, "c").crossJoin(_aims(guessed, frames.count(), ("guess",)))
    best = pairs.mapInArrow(run, "frame_id bigint, cell_id bigint, similarity double").groupBy("frame_id").agg(F.max(F.struct("similarity", (-F.col("cell_id")).alias("m"))).alias("w"))
    return best.select("frame_id", (-F.col("w.m")).alias("cell_id"), "w.similarity")


def _unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Points on the unit sphere of latitudes and longitudes in degrees."""
    p, q = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)], axis=1)


def true_cell_rank(frames: DataFrame, cells: DataFrame) -> DataFrame:
    """(frame_id, true_cell_rank, true_cell_m): the cell nearest to the truth among all, and its rank among all by (similarity, -cell_id).

    Cells equally far, to 6 digits, give the best of their ranks.  Cells of null
    embeddings take no part; a frame of a null embedding has no row.  Blocks of frames
    meet blocks of cells twice: for those that may be nearest, whose distance is then
    taken exactly, and for the count of those ahead of it.
    """
    f = frames.select("frame_id", "true_lat", "true_lon", F.col("embedding").cast("array<float>").alias("embedding")).filter("embedding is not null")
    c = cells.select("cell_id", "lat", "lon", F.col("embedding").cast("array<float>").alias("embedding")).filter("embedding is not null")
    n_frames = frames.count()
    spot = F.array().cast("array<float>").alias("embedding")

    def close(batches):
        for f_ids, f_lat, f_lon, c_ids, c_lat, c_lon in _each(batches, "f_ids", "f_true_lat", "f_true_lon", "c_ids", "c_lat", "c_lon"):
            cos = _unit(f_lat, f_lon) @ _unit(c_lat, c_lon).T
            # rounding of the products is some 1e-15, of the square of a chord; 1e-13 are some metres next to a point
            i, j = np.nonzero(cos >= cos.max(axis=1, keepdims=True) - 1e-13)
            cols = (f_ids[i], f_lat[i], f_lon[i], c_ids[j], c_lat[j], c_lon[j])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["frame_id", "true_lat", "true_lon", "cell_id", "lat", "lon"])

    placed_f, placed_c = f.filter("true_lat is not null and true_lon is not null"), c.filter("lat is not null and lon is not null")
    places = _blocks(placed_c.select("cell_id", "lat", "lon", spot), "cell_id", CELL_BLOCK, "c", ("lat", "lon")).crossJoin(_aims(placed_f.select("frame_id", "true_lat", "true_lon", spot), n_frames, ("true_lat", "true_lon")))
    far = places.mapInArrow(close, "frame_id bigint, true_lat double, true_lon double, cell_id bigint, lat double, lon double")
    far = far.select("frame_id", "cell_id", haversine(lat1="true_lat", lon1="true_lon", lat2="lat", lon2="lon").alias("m")).withColumn("d", F.round("m", 6))
    near = cut(far.selectExpr("*", "min(d) over (partition by frame_id) as least", "min(m) over (partition by frame_id) as true_cell_m").filter("d = least").select("frame_id", "cell_id", "true_cell_m"))
    least = near.groupBy("frame_id").agg(F.min("true_cell_m").alias("true_cell_m"))
    both = near.select("frame_id", "cell_id").join(c.select("cell_id", F.col("embedding").alias("ce")), "cell_id").join(f.select("frame_id", F.col("embedding").alias("fe")), "frame_id")

    def own(batches):
        for b in batches:
            fe, ce = (np.asarray(b.column(x).flatten()).astype(float).reshape(b.num_rows, -1) for x in ("fe", "ce"))
            yield pa.RecordBatch.from_arrays([b.column("frame_id"), b.column("cell_id"), pa.array(_dots(ce, fe))], names=["frame_id", "cell_id", "s"])

    best = both.select("frame_id", "cell_id", "ce", "fe").mapInArrow(own, "frame_id bigint, cell_id bigint, s double")
    best = best.groupBy("frame_id").agg(F.max(F.struct("s", (-F.col("cell_id")).alias("m"))).alias("w")).select("frame_id", "w.s", (-F.col("w.m")).alias("cell_id"))
    # an id as a number of two halves, as not every id is a double
    halves = (F.shiftright("cell_id", 32).alias("high"), F.col("cell_id").bitwiseAND((1 << 32) - 1).alias("low"))
    aimed = f.select("frame_id", "embedding").join(best.select("frame_id", "s", *halves), "frame_id")

    def above(batches):
        for f_ids, f_m, at, high, low, c_ids, c_m in _each(batches, "f_ids", "f_m", "f_s", "f_high", "f_low", "c_ids", "c_m"):
            a, b = _matrix(f_m, f_ids), _matrix(c_m, c_ids)
            s = a @ b.T
            mine = (high.astype(np.int64) << 32) + low.astype(np.int64)
            slack = 1e-15 * (a.shape[1] + 8) * np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1).max()
            n = (s > (at + slack)[:, None]).sum(axis=1)
            # whatever rounding of the product may hide is looked at exactly
            i, j = np.nonzero(np.abs(s - at[:, None]) <= slack[:, None])
            v = _pair_dots(a, b, i, j)
            n += np.bincount(i[(v > at[i]) | ((v == at[i]) & (c_ids[j] < mine[i]))], minlength=len(n))
            yield pa.RecordBatch.from_arrays([pa.array(f_ids), pa.array(n, pa.int64())], names=["frame_id", "n"])

    ahead = _blocks(cells, "cell_id", CELL_BLOCK, "c").crossJoin(_aims(aimed, n_frames, ("s", "high", "low"))).mapInArrow(above, "frame_id bigint, n bigint")
    ranks = ahead.groupBy("frame_id").agg((F.sum("n") + 1).cast("bigint").alias("true_cell_rank"))
    return ranks.join(least, "frame_id")


def uniqueness(frames: DataFrame, cells: DataFrame, radius_m: float) -> DataFrame:
    """(frame_id, cell_id, similarity, uniqueness): the best cell's lead over the best of all cells farther than radius_m from it; 1 without any.

    Blocks of frames meet blocks of cells, and each pair of blocks gives one rival a
    frame; a task works on one pair at a time, so its memory doesn't grow with the tables.
    """
    top = topk_join(frames, cells, 1).select("frame_id", "cell_id", "similarity")
    at = top.join(cells.select("cell_id", F.col("lat").alias("top_lat"), F.col("lon").alias("top_lon")), "cell_id")
    aimed = frames.select("frame_id", "embedding").join(at, "frame_id")

    def rival(batches):
        for f_ids, f_m, p, q, c_ids, c_m, lat, lon in _each(batches, "f_ids", "f_m", "f_top_lat", "f_top_lon", "c_ids", "c_m", "c_lat", "c_lon"):
            a, b = _matrix(f_m, f_ids), _matrix(c_m, c_ids)
            far = _distance(np.radians(p)[:, None], np.radians(q)[:, None], np.radians(lat), np.radians(lon)) > radius_m
            best = np.where(far, a @ b.T, -np.inf).max(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(f_ids), pa.array(best, mask=~np.isfinite(best))], names=["frame_id", "rival"])

    pairs = _blocks(cells, "cell_id", CELL_BLOCK, "c", ("lat", "lon")).crossJoin(_aims(aimed, frames.count(), ("top_lat", "top_lon")))
    rivals = pairs.mapInArrow(rival, "frame_id bigint, rival double").groupBy("frame_id").agg(F.max("rival").alias("rival"))
    return top.join(rivals, "frame_id", "left").select("frame_id", "cell_id", "similarity", F.coalesce(F.col("similarity") - F.col("rival"), F.lit(1.0)).alias("uniqueness"))


def unique_enough(uniqueness_: Column | str, least: float = 0.0) -> Column:
    """Whether a frame's best cell leads far enough to go on."""
    return _c(uniqueness_) >= least


def within_prior(candidates: DataFrame, gate_sigma: float = 3.0) -> Column:
    """Whether a candidate (lat, lon) lies in its frame's prior disk; beyond it nothing is kept."""
    return haversine(lat1="prior_lat", lon1="prior_lon", lat2="lat", lon2="lon") <= gate_sigma * F.col("sigma_m")


def globe_buckets(radius_m):
    """(band, places, bucket): functions of columns that deal the globe into bands of latitude and each band into buckets of longitude.

    Neither side of a bucket is shorter than radius_m as seen from the band or the
    ones beside it, so that two points within the radius are in buckets that touch;
    buckets go round the date line, and a polar band is one bucket.
    """
    r = _c(radius_m) / R_MEAN
    dlat = F.degrees(r) * 1.0000001

    def band(lat) -> Column:
        return F.floor(_c(lat) / dlat)

    def places(of: Column) -> Column:
        most = F.least(F.lit(90.0), F.greatest(F.abs(of * dlat), F.abs((of + 1) * dlat)) + dlat)
        half = F.sin(F.least(r, F.lit(math.pi)) / 2) / F.greatest(F.cos(F.radians(most)), F.lit(1e-9))
        dlon = F.degrees(2 * F.asin(F.least(F.lit(1.0), half))) * 1.0000001
        return F.greatest(F.lit(1), F.floor(360.0 / dlon)).cast("bigint")

    def bucket(lon, of: Column) -> Column:
        n = places(of)
        return F.pmod(F.floor((_c(lon) + 180) / 360 * n), n)

    return band, places, bucket


def around(df: DataFrame, lat: str, lon: str, radius_m, gy: str = "gy", gx: str = "gx") -> DataFrame:
    """df with a row for each bucket that may hold points within radius_m of (lat, lon), at most nine."""
    band, places, bucket = globe_buckets(radius_m)
    near = df.withColumn(gy, F.explode(F.array(*(band(lat) + i for i in (-1, 0, 1)))))
    of = F.col(gy)
    return near.withColumn(gx, F.explode(F.array_distinct(F.array(*(F.pmod(bucket(lon, of) + i, places(of)) for i in (-1, 0, 1))))))


def radius_join(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of left (l_id, l_lat, l_lon) and right (r_id, r_lat, r_lon) within radius_m, by buckets of the globe, across the date line and at the poles too.

    The join is an equi-join on buckets; each right row goes to at most nine.
    """
    band, _, bucket = globe_buckets(float(radius_m))
    a = left.withColumn("gy", band("l_lat"))
    a = a.withColumn("gx", bucket("l_lon", F.col("gy")))
    b = around(right, "r_lat", "r_lon", float(radius_m))
    d = haversine(lat1="l_lat", lon1="l_lon", lat2="r_lat", lon2="r_lon")
    return a.join(b, ["gy", "gx"]).withColumn("distance_m", d).filter(F.col("distance_m") <= radius_m).drop("gy", "gx")


def _distance(p, q, lat, lon) -> np.ndarray:
    """Great-circle metres from points p, q (a column) to lat, lon (a row), in radians."""
    h = np.sin((lat - p) / 2) ** 2 + np.cos(p) * np.cos(lat) * np.sin((lon - q) / 2) ** 2
    return 2 * R_MEAN * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def _meet_near(frames: DataFrame, cells: DataFrame, gate_sigma: float, extra: tuple[str, ...], pick, out: str) -> DataFrame:
    """pick(frame table, cell ids, cell lat, cell lon, similarities) of each block of frames with the cells of each bucket of the globe that their disks touch.

    Similarities are -inf for cells farther than gate_sigma sigmas from a frame's
    prior.  A bucket is one matrix product a block, so that a frame costs what lies
    near it and not the whole map.  Null embeddings take no part.
    """
    wide = frames.agg(F.max("sigma_m").alias("sigma")).first()["sigma"]
    radius = max(1.0, gate_sigma * float(wide or 0.0))
    band, _, bucket = globe_buckets(radius)
    number = lambda c, kind, name: F.col(c).cast(kind).alias(name)
    f = frames.filter("embedding is not null").select(
        number("frame_id", "bigint", "frame_id"), number("prior_lat", "double", "lat"), number("prior_lon", "double", "lon"), (F.col("sigma_m") * gate_sigma).cast("double").alias("reach"), number("embedding", "array<float>", "e"),
        *(number(c, "double", c) for c in extra),
    )
    f = around(f, "lat", "lon", radius)
    c = cells.filter("embedding is not null").select(number("cell_id", "bigint", "cell_id"), number("lat", "double", "lat"), number("lon", "double", "lon"), number("embedding", "array<float>", "e")).withColumn("gy", band("lat"))
    c = c.withColumn("gx", bucket("lon", F.col("gy")))
    schema = to_arrow_schema(StructType.fromDDL(out))

    def matrix(table: pa.Table) -> np.ndarray:
        return np.asarray(table.column("e").combine_chunks().flatten()).astype(float).reshape(table.num_rows, -1)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            ids, b, a = np.asarray(right.column("cell_id")), matrix(right), matrix(left)
            order = np.argsort(ids, kind="stable")
            ids, b = ids[order], b[order]
            lat, lon = (np.radians(np.asarray(right.column(x))[order]) for x in ("lat", "lon"))
            for at in range(0, left.num_rows, FRAME_BLOCK):
                part = left.slice(at, FRAME_BLOCK)
                p, q = (np.radians(np.asarray(part.column(x)))[:, None] for x in ("lat", "lon"))
                near = _distance(p, q, lat, lon) <= np.asarray(part.column("reach"))[:, None]
                parts.append(pick(part, ids, lat, lon, np.where(near, a[at : at + FRAME_BLOCK] @ b.T, -np.inf)))
        cols = zip(*parts) if parts else [[] for _ in schema.names]
        return pa.table([pa.array(np.concatenate(x) if len(x) else [], t) for x, t in zip(cols, schema.types)], names=schema.names)

    return f.groupBy("gy", "gx").cogroup(c.groupBy("gy", "gx")).applyInArrow(meet, out)


def topk_within(frames: DataFrame, cells: DataFrame, k: int, gate_sigma: float = 3.0) -> DataFrame:
    """(frame_id, cell_id, similarity, rank): the k best cells of those within gate_sigma sigmas of each frame's prior, exactly.

    frames (frame_id, prior_lat, prior_lon, sigma_m, embedding), cells (cell_id, lat,
    lon, embedding).  Ties go to the lesser cell_id; null embeddings take no part.
    """

    def pick(part, ids, lat, lon, s):
        n = min(k, s.shape[1])
        edge = -np.partition(-s, n - 1, axis=1)[:, n - 1 : n]
        i, j = np.nonzero((s >= edge - 1e-12) & np.isfinite(s))
        return np.asarray(part.column("frame_id"))[i], ids[j], s[i, j]

    scored = _meet_near(frames, cells, gate_sigma, (), pick, "frame_id bigint, cell_id bigint, similarity double")
    ranked = scored.selectExpr("*", "row_number() over (partition by frame_id order by similarity desc, cell_id) as rank")
    return ranked.filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def uniqueness_within(frames: DataFrame, cells: DataFrame, radius_m: float, gate_sigma: float = 3.0) -> DataFrame:
    """uniqueness() among the cells within gate_sigma sigmas of each frame's prior; a frame without any has no row."""
    top = topk_within(frames, cells, 1, gate_sigma).select("frame_id", "cell_id", "similarity")
    placed = frames.join(top.join(cells.select("cell_id", F.col("lat").alias("top_lat"), F.col("lon").alias("top_lon")), "cell_id").select("frame_id", "top_lat", "top_lon"), "frame_id")

    def pick(part, ids, lat, lon, s):
        p, q = (np.radians(np.asarray(part.column(c)))[:, None] for c in ("top_lat", "top_lon"))
        best = np.where(_distance(p, q, lat, lon) > radius_m, s, -np.inf).max(axis=1)
        some = np.isfinite(best)
        return np.asarray(part.column("frame_id"))[some], best[some]

    rivals = _meet_near(placed, cells, gate_sigma, ("top_lat", "top_lon"), pick, "frame_id bigint, rival double").groupBy("frame_id").agg(F.max("rival").alias("rival"))
    return top.join(rivals, "frame_id", "left").select("frame_id", "cell_id", "similarity", F.coalesce(F.col("similarity") - F.col("rival"), F.lit(1.0)).alias("uniqueness"))


def youden(scores: DataFrame, score: str = "score", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """(by…, threshold, j): the least score of greatest TPR - FPR for 'score >= threshold'; (0, 0) where a class is empty.

    Scores are first counted by value, and the ordered pass over distinct values runs by buckets of them.
    """
    by = by or []
    counted = scores.groupBy(*by, F.col(score).alias("t")).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.sum(1 - F.col(label).cast("bigint")).alias("n"))
    total = counted.groupBy(*by).agg(F.sum("p").alias("pp"), F.sum("n").alias("nn"))
    run = running_sums(counted, "t", ["p", "n"], by, descending=True).withColumnsRenamed({"run_p": "tp", "run_n": "fp"})
    run = run.join(total, by) if by else run.crossJoin(total)
    j = F.when((F.col("pp") > 0) & (F.col("nn") > 0), F.col("tp") / F.col("pp") - F.col("fp") / F.col("nn"))
    best = run.withColumn("j", j).groupBy(*by).agg(F.max(F.when(F.col("j").isNotNull(), F.struct(F.round("j", 12).alias("j"), (-F.col("t")).alias("m")))).alias("b"))
    return best.select(*by, F.coalesce(-F.col("b.m"), F.lit(0.0)).alias("threshold"), F.coalesce("b.j", F.lit(0.0)).alias("j"))


def signals_by_youden(scores: DataFrame, by: str = "signal") -> DataFrame:
    """(by, threshold, j) of labelled scores (by, score, label), the best signal first."""
    return youden(scores, by=[by]).orderBy(F.desc("j"), by)


def _by_image(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """Descriptors of one image packed as (image, ids, matrix of float32) blocks of at most DESCRIPTOR_BLOCK rows."""

    def run(batches):
        for batch in batches:
            image = np.asarray(batch.column(0))
            edge = np.concatenate([[0], np.flatnonzero(image[1:] != image[:-1]) + 1, [len(image)]])
            for lo, hi in zip(edge[:-1], edge[1:]):
                for at in range(lo, hi, DESCRIPTOR_BLOCK):
                    part = batch.slice(at, min(DESCRIPTOR_BLOCK, hi - at))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([image[at]]), pa.array([part.column(1).to_pylist()], pa.list_(pa.int64())), pa.array([np.asarray(part.column(2).flatten()).astype("<f4").tobytes()], pa.binary())],
                        names=["image", f"{prefix}_ids", f"{prefix}_m"],
                    )

    some = df.filter("image is not null and embedding is not null").select(F.col("image").cast("bigint").alias("image"), F.col(key).cast("bigint").alias(key), F.col("embedding").cast("array<float>").alias("embedding"))
    return some.repartition("image").sortWithinPartitions("image").mapInArrow(run, f"image bigint, {prefix}_ids array<bigint>, {prefix}_m binary")


def ratio_test(queries: DataFrame, references: DataFrame, ratio: float = 0.8, max_matches: int | None = None) -> DataFrame:
    """(image, q_id, r_id, conf) of descriptors' nearest partners in the same image that pass Lowe's ratio test.

    queries (image, q_id, embedding), references (image, r_id, embedding).  A query
    needs two partners, the second not at distance 0; conf = 1 - d1/d2.  An image's
    descriptors meet block by block in matrix products, each of which keeps two
    partners a query; ties go to the lesser r_id, and an id is no partner of itself.
    """

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, r_ids = np.array(r["q_ids"], np.int64), np.array(r["r_ids"], np.int64)
                a, b = np.frombuffer(r["q_m"], "<f4").reshape(len(q_ids), -1).astype(float), np.frombuffer(r["r_m"], "<f4").reshape(len(r_ids), -1).astype(float)
                aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
                d2 = aa[:, None] + bb[None, :] - 2 * (a @ b.T)
                d2[q_ids[:, None] == r_ids[None, :]] = np.inf
                n = min(2, len(r_ids))
                edge = np.partition(d2, n - 1, axis=1)[:, n - 1]
                # whatever rounding of the product may hide is looked at exactly
                i, j = np.nonzero((d2 <= (edge + 1e-9 * (aa + bb.max()))[:, None]) & np.isfinite(d2))
                d = np.round(np.sqrt(((a[i] - b[j]) ** 2).sum(axis=1)), 9)
                order = np.lexsort((r_ids[j], d, i))
                i, j, d = i[order], j[order], d[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                i, j, d = i[place < 2], j[place < 2], d[place < 2]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), r["image"])), pa.array(q_ids[i]), pa.array(r_ids[j]), pa.array(d)], names=["image", "q_id", "r_id", "d"])

    pairs = _by_image(queries, "q_id", "q").join(_by_image(references, "r_id", "r"), "image")
    d = pairs.select("image", "q_ids", "q_m", "r_ids", "r_m").mapInArrow(run, "image bigint, q_id bigint, r_id bigint, d double")
    w = "over (partition by image, q_id order by d, r_id)"
    best = d.selectExpr("image", "q_id", "r_id", "d", f"lead(d) {w} as second", f"row_number() {w} as n").filter("n = 1 and second > 0").filter(F.col("d") < ratio * F.col("second"))
    out = best.select("image", "q_id", "r_id", (1 - F.col("d") / F.col("second")).alias("conf"))
    if max_matches is None:
        return out
    return out.selectExpr("*", "row_number() over (partition by image order by conf desc, q_id) as m").filter(F.col("m") <= max_matches).drop("m")
