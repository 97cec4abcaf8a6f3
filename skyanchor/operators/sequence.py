"""Trajectories: dead reckoning, a Kalman filter folded in time order, drift, as-of fixes, sessions."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.geo import R_MEAN, _c, ground_mpp, lonlat, world_px, wrap_deg


def vo_step(*, a, b, tx, ty, cx, cy, gsd_m, prev_heading_deg) -> dict[str, Column]:
    """A frame-to-frame transform as metres east and north, turn and scale; north is against y."""
    from .pose import apply, rotation_deg, scale

    x, y = apply(_c(cx), _c(cy), a, b, tx, ty)
    dx, dy, t = x - _c(cx), y - _c(cy), F.radians(_c(prev_heading_deg))
    g = _c(gsd_m)
    return {
        "delta_east_m": g * (F.cos(t) * dx - F.sin(t) * dy), "delta_north_m": -g * (F.sin(t) * dx + F.cos(t) * dy),
        "delta_yaw_deg": rotation_deg(a, b), "scale": scale(a, b),
    }


def dead_reckoning(steps: DataFrame, seq: str, order: str) -> DataFrame:
    """steps with east_m and north_m summed from each sequence's start; order is a comma-separated total order."""
    w = f"over (partition by {seq} order by {order} rows unbounded preceding)"
    return steps.selectExpr("*", f"sum(delta_east_m) {w} as east_m", f"sum(delta_north_m) {w} as north_m")


FIELDS = ("i", "delta_east_m", "delta_north_m", "delta_yaw_deg", "step_sigma_m", "missing", "fix_east_m", "fix_north_m", "fix_heading_deg", "fix_sigma_m", "fix_heading_sigma_deg")
STATE = "i bigint, east_m double, north_m double, heading_deg double, var_m2 double, var_heading double"
STARTED = (-1, 0.0, 0.0, 0.0, 1.0, 1.0)


def _wrap(x: float) -> float:
    return (x + 180) % 360 - 180


def advance(s: tuple, x: tuple, drift_m: float, yaw_sigma_deg: float) -> tuple:
    """State (i, east, north, heading, position variance, heading variance) after the step x of FIELDS.

    Predict, or inflate where the frame is missing, then correct where there is a
    fix.  With a diagonal covariance to start from, the filter is three scalar ones.
    """
    _, e, n, h, p, ph = s
    i, de, dn, dy, sigma, missing, fe, fn, fh, fs, fhs = x
    if missing:
        p += drift_m**2
    else:
        e, n, h = e + de, n + dn, h + dy
        p += sigma**2
    h, ph = _wrap(h), ph + yaw_sigma_deg**2
    if fe is not None:
        k = p / (p + fs**2)
        e, n, p = e + k * (fe - e), n + k * (fn - n), (1 - k) * p
        if fh is not None:
            k = ph / (ph + fhs**2)
            h, ph = _wrap(h + k * _wrap(fh - h)), (1 - k) * ph
    return i, e, n, h, p, ph


def ekf(steps: DataFrame, seq: str, drift_m: float = 50.0, yaw_sigma_deg: float = 1.0, start_var_m2: float = 1.0, start_var_heading: float = 1.0, every: bool = True) -> DataFrame:
    """(seq, i, east_m, north_m, heading_deg, var_m2, var_heading): the filtered state at each step, or at the last.

    steps have seq and FIELDS; each sequence starts at the origin.  A sequence is
    folded in one pass of one task, sorted by i, as the order of steps matters.
    """
    start = (-1, 0.0, 0.0, 0.0, float(start_var_m2), float(start_var_heading))
    kind = steps.schema[seq].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        s, out = start, []
        for x in zip(*(table.column(c).to_pylist() for c in FIELDS)):
            s = advance(s, x, drift_m, yaw_sigma_deg)
            if every:
                out.append(s)
        out = out or [s]
        keys = pa.array(table.column(seq).slice(0, 1).to_pylist() * len(out), types[0])
        return pa.table([keys, *(pa.array(v, t) for v, t in zip(zip(*out), types[1:]))], names=[seq, *(c.split()[0] for c in STATE.split(", "))])

    types = to_arrow_schema(StructType.fromDDL(f"`{seq}` {kind}, {STATE}")).types
    numbers = [F.col("i").cast("bigint").alias("i"), *(F.col(c).cast("boolean" if c == "missing" else "double").alias(c) for c in FIELDS[1:])]
    return steps.select(seq, *numbers).groupBy(seq).applyInArrow(run, f"`{seq}` {kind}, {STATE}")


def trajectory(waypoints: DataFrame, *, lat, lon, zoom) -> DataFrame:
    """waypoints (…, offset_x_px, offset_y_px, yaw_deg) about a scene's centre with east_m, north_m, true_lat, true_lon and heading_deg of the frame at each.

    Offsets are pixels of the map at zoom, y pointing south.
    """
    mpp = ground_mpp(lat=lat, zoom=zoom)
    x, y = world_px(lon=lon, lat=lat, zoom=zoom)
    true_lon, true_lat = lonlat(x=x + F.col("offset_x_px"), y=y + F.col("offset_y_px"), zoom=zoom)
    return waypoints.select(
        "*", (F.col("offset_x_px") * mpp).alias("east_m"), (-F.col("offset_y_px") * mpp).alias("north_m"), true_lat.alias("true_lat"), true_lon.alias("true_lon"), F.pmod(F.col("yaw_deg"), F.lit(360.0)).alias("heading_deg")
    )


def first_duplicates(rows: DataFrame, id_: str, content: list[str]) -> DataFrame:
    """(id, first, duplicate): for each row the least id of the same content, and whether that is another row; null contents are no duplicates."""
    same = ", ".join(content)
    void = " or ".join(f"{c} is null" for c in content)
    first = f"case when {void} then {id_} else min({id_}) over (partition by {same}) end"
    return rows.selectExpr(id_, f"{first} as first").withColumn("duplicate", F.col(id_) != F.col("first"))


def with_poses(frames: DataFrame, poses: DataFrame, key: str = "frame_id") -> DataFrame:
    """frames with the columns of their poses and placed, whether there is one."""
    return frames.join(poses.withColumn("placed", F.lit(True)), key, "left").withColumn("placed", F.coalesce("placed", F.lit(False)))


def drift(track: DataFrame, seq: str, order: str) -> DataFrame:
    """(seq, path_m, final_m, final_pct, max_m, median_m) of tracks with east_m, north_m against true_east_m, true_north_m."""
    w = f"over (partition by {seq} order by {order})"
    t = track.selectExpr("*", f"row_number() over (partition by {seq} order by {order} desc) last", f"hypot(true_east_m - lag(true_east_m) {w}, true_north_m - lag(true_north_m) {w}) leg")
    t = t.withColumn("err", F.hypot(F.col("east_m") - F.col("true_east_m"), F.col("north_m") - F.col("true_north_m")))
    g = t.groupBy(seq).agg(
        F.coalesce(F.sum("leg"), F.lit(0.0)).alias("path_m"), F.max(F.when(F.col("last") == 1, F.col("err"))).alias("final_m"), F.max("err").alias("max_m"), F.percentile("err", 0.5).alias("median_m")
    )
    return g.select(seq, "path_m", "final_m", F.when(F.col("path_m") > 0, 100 * F.col("final_m") / F.col("path_m")).alias("final_pct"), "max_m", "median_m")


def asof(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """left (key, time, ...) with the last non-null value of right at or before its time, by one window over both."""
    marked = left.withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(dict(right.dtypes)[value]))
    other = right.select(key, time, F.lit(0).alias("__side"), F.col(value).alias("__v"))
    both = marked.unionByName(other, allowMissingColumns=True)
    w = f"last(__v, true) over (partition by {key} order by {time}, __side rows unbounded preceding)"
    return both.selectExpr(*[f"`{c}`" for c in left.columns], f"{w} as {value}", "__side").filter("__side = 1").drop("__side")


def running_clusters(points: DataFrame, group: str, order: str, max_km: float) -> DataFrame:
    """(group, i, cluster): each point joins the first cluster whose running centroid is nearer than max_km, else opens one.

    The result hangs on the order by definition, so a group is folded in one task;
    centroids are kept by bands of latitude no narrower than max_km, and a point
    looks at those of its own and the two beside it.
    """
    reach = max_km * 1000.0
    width = math.degrees(reach / R_MEAN) * 1.0000001

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        lat, lon, n, bands, out = [], [], [], {}, []
        for a, b in zip(table.column("lat").to_pylist(), table.column("lon").to_pylist()):
            at = math.floor(a / width)
            p, cp = math.radians(a), math.cos(math.radians(a))
            best = None
            for c in (c for k in (at - 1, at, at + 1) for c in bands.get(k, ())):
                if best is not None and c > best:
                    continue
                q = math.radians(lat[c])
                h = math.sin((p - q) / 2) ** 2 + math.cos(q) * cp * math.sin(math.radians(b - lon[c]) / 2) ** 2
                if 2 * R_MEAN * math.asin(math.sqrt(min(1.0, h))) < reach:
                    best = c
            if best is None:
                best = len(lat)
                lat.append(a), lon.append(b), n.append(1)
                bands.setdefault(at, set()).add(best)
            else:
                old = math.floor(lat[best] / width)
                lat[best], lon[best], n[best] = (lat[best] * n[best] + a) / (n[best] + 1), (lon[best] * n[best] + b) / (n[best] + 1), n[best] + 1
                new = math.floor(lat[best] / width)
                if new != old:
                    bands[old].discard(best)
                    bands.setdefault(new, set()).add(best)
            out.append(best)
        return pa.table({group: table.column(group), "i": table.column(order), "cluster": pa.array(out, pa.int64())})

    some = points.filter("lat is not null and lon is not null").select(F.col(group).cast("bigint").alias(group), F.col(order).cast("bigint").alias(order), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    return some.groupBy(group).applyInArrow(fold, f"`{group}` bigint, i bigint, cluster bigint")


def centroids(points: DataFrame, by: str) -> DataFrame:
    """(by, n, lat, lon): the mean position of each group's points."""
    return points.groupBy(by).agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
