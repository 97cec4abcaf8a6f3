"""Sources, sinks, rasters and the small arithmetic that the other modules' queries leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import imagery, pose, report, sequence
from ..sources import index, manifest, metadata, shared, tiles
from .adapters import CELLS, EVAL, cells, correspondences, eval_rows, haversine_sql, read
from .pose_queries import _C, _FITTED, _K
from .registry import d6, query, r6
from .retrieval_queries import lat_sql, lon_sql, wx_sql, wy_sql

_SCENE = "px AS (SELECT y, x, ((x * 7 + y * 13 + (x * y) % 11 + 62) % 256)::DOUBLE AS v FROM range(96) a(y), range(96) b(x))"


def _scene(spark):
    return spark.range(96 * 96).selectExpr("id div 96 y", "id % 96 x").withColumn("v", F.expr("cast((x * 7 + y * 13 + (x * y) % 11 + 62) % 256 as double)"))


@query(f"WITH {_SCENE} SELECT y // 4 AS y, x // 4 AS x, {d6('AVG(v)')} AS v FROM px GROUP BY ALL")
def raster_scene_coarser(spark, sf_dir):
    return tiles.scene_at(tiles.scene(spark, 96, 2), 18, 16).select("y", "x", r6(F.col("v")).alias("v"))


_SIN = "sin(v / 255 * 3.141592653589793e0 * (1 + 2 * 0.5e0) - 1.5707963267948966e0)"


@query(f"""WITH px AS (SELECT vec_id, i - 1 AS i, greatest(0.0e0, least(255.0e0, 128 + 300 * (embedding::DOUBLE[])[i])) AS v, (vec_id % 7) / 6.0e0 AS s FROM embeddings, range(1, 65) t(i))
SELECT vec_id, i, {d6('greatest(0, least(255, (1 + 0.35e0 * s) * 255 * pow(v / 255, pow(2, 0.7e0 * s)) - 30 * s))')} AS exposed, {d6('255 * greatest(0, least(1, v / 255 + s * 0.35e0 * sin(3 * pi() * v / 255)))')} AS remapped FROM px""")
def raster_perturb_levels(spark, sf_dir):
    """Each embedding as a raster of bytes under another exposure and as another season shows it, in strengths from 0 to 1."""
    px = read(spark, sf_dir, "embeddings").select("vec_id", ((F.col("vec_id") % 7) / 6.0).alias("s"), F.posexplode("embedding").alias("i", "e"))
    v = F.greatest(F.lit(0.0), F.least(F.lit(255.0), 128 + 300 * F.col("e").cast("double")))
    return px.select("vec_id", F.col("i").cast("bigint").alias("i"), r6(imagery.exposed(v, F.pow(F.lit(2.0), 0.7 * F.col("s")), 1 + 0.35 * F.col("s"), -30 * F.col("s"))).alias("exposed"), r6(imagery.remapped(v, "s")).alias("remapped"))


@query(f"WITH {_SCENE}, g AS (SELECT y, x, 0.299e0 * v + 0.587e0 * (255 - v) + 0.114e0 * (v / 2) AS v FROM px) SELECT y, x, {d6('(v - MIN(v) OVER ()) / (MAX(v) OVER () - MIN(v) OVER ()) * 255')} AS v FROM g")
def raster_luma_normalised(spark, sf_dir):
    g = _scene(spark).select(F.lit(1).alias("image_id"), "y", "x", imagery.luma("v", 255 - F.col("v"), F.col("v") / 2).alias("v"))
    return tiles.normalise(g).select("y", "x", r6(F.col("v")).alias("v"))


@query("""WITH p AS (SELECT w, dx, dy, y, x, ((x * 3 + y * 5 + w) % 251) AS v FROM range(6) a(w), (VALUES (-40, -30), (216, -30), (-40, 226), (216, 226)) o(dx, dy), range(256) r(y), range(256) c(x))
SELECT w AS window_id, SUM(v)::BIGINT AS total, COUNT(*) FILTER (v > 0) AS lit FROM p WHERE x + dx BETWEEN 0 AND 299 AND y + dy BETWEEN 0 AND 199 GROUP BY w""")
def tile_stitch_mosaic(spark, sf_dir):
    import numpy as np

    yy, xx = np.mgrid[0:256, 0:256]
    rows = [(w, dx, dy, 300, 200, ((xx * 3 + yy * 5 + w) % 251).astype(np.uint8).tobytes()) for w in range(6) for dx, dy in ((-40, -30), (216, -30), (-40, 226), (216, 226))]
    placed = spark.createDataFrame(rows, "window_id bigint, dx int, dy int, width int, height int, tile binary")

    def sums(batches):
        import pyarrow as pa

        for b in batches:
            px = [np.frombuffer(v, np.uint8) for v in b.column("pixels").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("window_id"), pa.array([int(v.sum(dtype=np.int64)) for v in px], pa.int64()), pa.array([int((v > 0).sum()) for v in px], pa.int64())], names=["window_id", "total", "lit"])

    return imagery.stitch(placed).mapInArrow(sums, "window_id bigint, total bigint, lit bigint")


@query(f"""WITH {CELLS}, d AS (SELECT gy, gx, (gy * 3 + gx) % 400 + 0.5e0 AS ground_m FROM range(5465, 5600) a(gy), range(5585, 5600) b(gx)),
j AS (SELECT c.cell_id, d.ground_m, CASE WHEN cell_id % 3 = 0 THEN 120.0e0 END AS rel, CASE WHEN cell_id % 5 = 0 THEN 90.0e0 END AS ovr FROM cells c LEFT JOIN d ON d.gy = floor(c.lat / 0.01e0) AND d.gx = floor(c.lon / 0.01e0))
SELECT cell_id, ground_m, CASE WHEN coalesce(rel, ovr, 300 - ground_m) > 0 THEN coalesce(rel, ovr, 300 - ground_m) END AS agl_m FROM j""")
def elevation_and_altitude(spark, sf_dir):
    d = spark.range(5465, 5600).withColumnRenamed("id", "gy").crossJoin(spark.range(5585, 5600).withColumnRenamed("id", "gx")).withColumn("ground_m", (F.col("gy") * 3 + F.col("gx")) % 400 + F.lit(0.5))
    p = tiles.elevation(cells(spark, sf_dir).select("cell_id", "lat", "lon"), d)
    h = metadata.altitude_above_ground(relative_m=F.when(F.col("cell_id") % 3 == 0, 120.0), override_m=F.when(F.col("cell_id") % 5 == 0, 90.0), absolute_m=F.lit(300.0), ground_m="ground_m")
    return p.select("cell_id", "ground_m", h.alias("agl_m"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS provider, (CASE WHEN c_custkey % 2 = 0 THEN 19 ELSE 17 END)::BIGINT AS max_zoom, least(CASE WHEN c_custkey % 2 = 0 THEN 19 ELSE 17 END, c_nationkey)::BIGINT AS zoom FROM customer")
def provider_registry(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("b").alias("provider"))
    j = tiles.with_provider(c, tiles.providers(spark, [("a", "{z}/{x}/{y}", 19), ("b", "{z}/{y}/{x}", 17)])).filter("template is not null")
    return j.select("c_custkey", "provider", F.col("max_zoom").cast("bigint").alias("max_zoom"), F.least("max_zoom", "c_nationkey").cast("bigint").alias("zoom"))


@query(f"WITH {CELLS} SELECT cell_id, floor(lat / 0.1e0)::BIGINT AS band FROM cells WHERE lat BETWEEN 54.74e0 - 500 / 111320.0e0 AND 54.74e0 + 500 / 111320.0e0 AND lon BETWEEN 55.93e0 - 500 / 111320.0e0 / cos(radians(54.74e0)) AND 55.93e0 + 500 / 111320.0e0 / cos(radians(54.74e0))")
def index_save_and_prune(spark, sf_dir):
    root = shared.shared_folder(spark, "index")
    index.build_or_load(spark, root, "k", lambda: cells(spark, sf_dir))
    return index.near(spark, f"{root}/k", 54.74, 55.93, 500.0).select("cell_id", F.col("band").cast("bigint").alias("band"))


@query(f'WITH {EVAL} SELECT "case", status, accepted::BIGINT AS accepted, error_m, true_cell_rank::BIGINT AS true_cell_rank, photometric FROM ev WHERE k % 50 = 0')
def eval_csv_round_trip(spark, sf_dir):
    path = f"{shared.shared_folder(spark, 'eval')}/rows"
    e = eval_rows(spark, sf_dir).filter("k % 50 = 0")
    names = [c.split()[0] for c in manifest.EVAL.split(", ")]
    manifest.write_eval(e.select(*(F.col(n) if n in e.columns else F.lit(None).cast("string").alias(n) for n in names)), path, {"top_k": 15})
    r = manifest.read_eval(spark, path)
    return r.select("case", "status", F.col("accepted").cast("bigint").alias("accepted"), "error_m", F.col("true_cell_rank").cast("bigint").alias("true_cell_rank"), "photometric")


@query("SELECT o_orderkey AS id, round(((o_orderkey * 7.25e0 - 900) + 180) - 360 * floor(((o_orderkey * 7.25e0 - 900) + 180) / 360) - 180, 6) + 0.0e0 AS wrapped FROM orders")
def angle_wrap(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), r6(geo.wrap_deg(F.col("o_orderkey") * 7.25 - 900)).alias("wrapped"))


@query(f"""WITH {_FITTED}, v AS (SELECT frame_id, a, b, tx, ty, a / (a * a + b * b) AS ia, -b / (a * a + b * b) AS ib, -(a * tx + b * ty) / (a * a + b * b) AS ix, -(a * ty - b * tx) / (a * a + b * b) AS iy FROM fit)
SELECT frame_id, {d6('ia')} AS ia, {d6('ib')} AS ib, {d6('ia * (a * 3 - b * 4 + tx) - ib * (b * 3 + a * 4 + ty) + ix', 5)} AS x, {d6('ib * (a * 3 - b * 4 + tx) + ia * (b * 3 + a * 4 + ty) + iy', 5)} AS y FROM v""")
def pose_inverse_round_trip(spark, sf_dir):
    f = pose.fit_similarity(correspondences(spark, sf_dir))
    ia, ib, ix, iy = pose.inverse()
    x, y = pose.apply(*pose.apply(F.lit(3.0), F.lit(4.0)), ia, ib, ix, iy)
    return f.select("frame_id", r6(ia).alias("ia"), r6(ib).alias("ib"), r6(x, 5).alias("x"), r6(y, 5).alias("y"))


@query(f"""WITH n AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: CASE WHEN vec_id % 10 = 0 THEN 0 ELSE x * 3 END) AS e FROM embeddings), s AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM n)
SELECT vec_id, {d6('CASE WHEN n > 0 THEN e[1] / n ELSE 0 END')} AS first, {d6('CASE WHEN n > 0 THEN 1 ELSE 0 END')} AS norm FROM s""")
def vectors_l2_normalised(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.when(F.col("vec_id") % 10 == 0, 0.0).otherwise(x.cast("double") * 3)).alias("e"))
    from ..operators.vectors import normalised

    n = e.withColumn("u", normalised("e"))
    return n.select("vec_id", r6(F.get("u", F.lit(0))).alias("first"), r6(F.sqrt(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x))).alias("norm"))


@query("""WITH n AS (SELECT * FROM (VALUES (0.0e0, 100.0e0, 500.0e0, 500.0e0), (100, 300, 500, 2000), (300, 600, 2000, 5000), (600, 1e9, 5000, 5000)) t(h0, h1, s0, s1)), o AS (SELECT o_orderkey, (o_orderkey % 900)::DOUBLE AS h FROM orders)
SELECT o_orderkey, round(CASE WHEN s0 = s1 THEN s0 ELSE s0 + (h - h0) / (h1 - h0) * (s1 - s0) END, 6) AS sigma_m FROM o JOIN n ON h >= h0 AND h < h1""")
def prior_envelope_interval_join(spark, sf_dir):
    from ..operators.intervals import envelope_sigma

    n = spark.createDataFrame([(0.0, 100.0, 500.0, 500.0), (100.0, 300.0, 500.0, 2000.0), (300.0, 600.0, 2000.0, 5000.0), (600.0, 1e9, 5000.0, 5000.0)], "h0 double, h1 double, s0 double, s1 double")
    o = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 900).cast("double").alias("h"))
    return envelope_sigma(o, "h", n).select("o_orderkey", F.round("sigma_m", 6).alias("sigma_m"))



@query("""SELECT time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL (k * 10) MINUTE AS start, event_type, COUNT(*) AS n, round(AVG(value), 6) AS mean FROM events, range(3) t(k) GROUP BY ALL""")
def events_sliding_window(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("t", "30 minutes", "10 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "mean")


@query("SELECT '<html><head><title>Regions</title></head><body><table><tr><th>r_regionkey</th><th>r_name</th></tr>' || chr(10) || string_agg('<tr><td>' || r_regionkey || '</td><td>' || r_name || '</td></tr>', chr(10) ORDER BY r_regionkey) || chr(10) || '</table></body></html>' AS html FROM region")
def report_html(spark, sf_dir):
    return report.html_report(read(spark, sf_dir, "region").select("r_regionkey", "r_name"), "Regions")


@query(f"WITH {_FITTED} SELECT frame_id, (frame_id % 4 <> 0) AS placed, CASE WHEN frame_id % 4 <> 0 THEN {d6(_K[1][0], 5)} END AS second_lon, CASE WHEN frame_id % 4 <> 0 THEN {d6(_C[1], 5)} END AS lat, 'frame ' || frame_id AS name FROM fit")
def report_kml(spark, sf_dir):
    f = pose.fit_similarity(correspondences(spark, sf_dir))
    g = geo.Georef(F.lit(37.6), F.lit(55.7), F.lit(18), F.lit(600), F.lit(600))
    corners = [g.to_lonlat(*pose.apply(F.lit(x), F.lit(y))) for x, y in ((0.0, 0.0), (511.0, 0.0), (511.0, 511.0), (0.0, 511.0))]
    lon, lat = g.to_lonlat(*pose.apply(F.lit(255.5), F.lit(255.5)))
    rows = f.select(
        "frame_id", F.concat(F.lit("frame "), F.col("frame_id").cast("string")).alias("name"), F.when(F.col("frame_id") % 4 == 0, "not_localized").otherwise("localized").alias("status"), lon.alias("lon"), lat.alias("lat"),
        F.array(*(F.struct(x.alias("lon"), y.alias("lat")) for x, y in corners)).alias("ring"),
    )
    k = rows.select("frame_id", report.footprint_kml().alias("k"))
    second = F.regexp_extract("k", r"coordinates>\S+ ([-\d.]+),", 1).try_cast("double")
    point = F.regexp_extract("k", r"Point><coordinates>[-\d.]+,([-\d.]+),", 1).try_cast("double")
    return k.select("frame_id", F.col("k").contains("Placemark").alias("placed"), r6(second, 5).alias("second_lon"), r6(point, 5).alias("lat"), F.regexp_extract("k", "<name>([^<]*)<", 1).alias("name"))


@query(f"""WITH {CELLS}, p AS (SELECT cell_id, lat, lon, CASE WHEN cell_id % 4 = 0 THEN 'n/a' WHEN cell_id % 4 = 1 THEN '' ELSE (lat + 0.0005e0)::VARCHAR END AS pose_lat FROM cells), j AS (SELECT *, TRY_CAST(pose_lat AS DOUBLE) AS pl FROM p)
SELECT cell_id, CASE WHEN pl IS NULL THEN 'no pose' ELSE 'pose' END AS state, {d6(haversine_sql('lat', 'lon', 'pl', 'lon'), 3)} AS drift_m FROM j""")
def poses_left_join(spark, sf_dir):
    c = cells(spark, sf_dir).select("cell_id", "lat", "lon")
    text = F.when(F.col("cell_id") % 4 == 0, "n/a").when(F.col("cell_id") % 4 == 1, "").otherwise((F.col("lat") + 0.0005).cast("string"))
    poses = c.select("cell_id", text.try_cast("double").alias("pl")).filter("pl is not null")
    j = sequence.with_poses(c, poses, "cell_id")
    return j.select("cell_id", F.when(F.col("placed"), "pose").otherwise("no pose").alias("state"), r6(geo.haversine(lat1="lat", lon1="lon", lat2="pl", lon2="lon"), 3).alias("drift_m"))



_WX, _WY = wx_sql("37.6e0", "18"), wy_sql("55.7e0", "18")


@query(f"""WITH w AS (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, (event_id * 37 % 401 - 200)::DOUBLE AS ox, (event_id * 53 % 301 - 150)::DOUBLE AS oy, (event_id * 7 % 720 - 360)::DOUBLE AS yaw FROM events)
SELECT track_id, i, {d6(f"ox * (2 * pi() * 6378137.0e0 / 256 * cos(radians(55.7e0)) / 262144)", 4)} AS east_m, {d6(f"-oy * (2 * pi() * 6378137.0e0 / 256 * cos(radians(55.7e0)) / 262144)", 4)} AS north_m,
  {d6(lat_sql(f"({_WY} + oy)", "18"), 7)} AS true_lat, {d6(lon_sql(f"({_WX} + ox)", "18"), 7)} AS true_lon, yaw - 360 * floor(yaw / 360) AS heading_deg FROM w""")
def trajectory_waypoints(spark, sf_dir):
    """Every user's events as waypoints of a flight over one scene."""
    w = read(spark, sf_dir, "events").selectExpr(
        "user_id track_id", "cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) i", "cast(event_id * 37 % 401 - 200 as double) offset_x_px", "cast(event_id * 53 % 301 - 150 as double) offset_y_px",
        "cast(event_id * 7 % 720 - 360 as double) yaw_deg",
    )
    t = sequence.trajectory(w, lat=F.lit(55.7), lon=F.lit(37.6), zoom=F.lit(18))
    return t.select("track_id", "i", r6(F.col("east_m"), 4).alias("east_m"), r6(F.col("north_m"), 4).alias("north_m"), r6(F.col("true_lat"), 7).alias("true_lat"), r6(F.col("true_lon"), 7).alias("true_lon"), "heading_deg")


@query(f"""WITH h AS (SELECT c_custkey AS k, (c_custkey * 7919 % 1700) / 10.0e0 - 85 AS lat, (c_custkey * 104729 % 3590) / 10.0e0 - 179 AS lon, 20 + c_custkey % 80 AS f, 1000 + c_custkey % 4000 AS w, 50.5e0 + c_custkey % 300 AS up, (c_custkey % 25 - 100)::DOUBLE AS pitch, c_custkey % 5 = 0 AS blank FROM customer),
s AS (SELECT *, degrees(2 * atan(18.0e0 / f)) AS fov FROM h)
SELECT k, CASE WHEN NOT blank THEN {d6('lat', 5)} END AS lat, CASE WHEN NOT blank THEN {d6('lon', 5)} END AS lon, {d6('fov')} AS fov_deg, w AS width, CASE WHEN k % 7 <> 0 THEN up END AS relative_m, CASE WHEN k % 7 <> 0 THEN pitch + 90 END AS pitch_deg,
  CASE WHEN k % 7 <> 0 THEN {d6('2 * up * tan(radians(fov) / 2) / w')} END AS gsd_m, CASE WHEN NOT blank THEN {d6('(k % 500) - 100.25e0', 3)} END AS absolute_m,
  array_to_string(list_filter([CASE WHEN blank THEN 'no position' END, CASE WHEN k % 7 = 0 THEN 'no XMP' END, CASE WHEN k % 7 = 0 THEN 'no orientation' END, CASE WHEN k % 7 = 0 THEN 'no height above ground' END, CASE WHEN k % 11 = 0 THEN 'no time' END,
    CASE WHEN k % 7 <> 0 AND abs(pitch + 90) > 10 THEN printf('tilted by %.0f degrees', abs(pitch + 90)) END], lambda x: x IS NOT NULL), '; ') AS problems FROM s""")
def metadata_exif_read(spark, sf_dir):
    """Heads of image files, written with each customer's made-up position, lens and packet in either byte order, and read back as shots."""
    import pyarrow as pa

    from ..sources import exif

    def files(batches):
        for batch in batches:
            out = []
            for k in batch.column(0).to_pylist():
                packet = f'<x:xmpmeta drone-dji:GimbalYawDegree="{k % 360}.5" drone-dji:GimbalPitchDegree="{k % 25 - 100}.0" drone-dji:GimbalRollDegree="0.0" drone-dji:RelativeAltitude="+{50 + k % 300}.5"></x:xmpmeta>'
                at = {} if k % 5 == 0 else {"lat": k * 7919 % 1700 / 10 - 85, "lon": k * 104729 % 3590 / 10 - 179, "absolute_m": k % 500 - 100.25}
                taken = "" if k % 11 == 0 else "2024:05:06 07:08:09"
                out.append(exif.write(1000 + k % 4000, 900, model="M", taken=taken, focal_35mm=20 + k % 80, packet="" if k % 7 == 0 else packet, order="<>"[k % 2], **at))
            yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in batch.column(0).to_pylist()]), pa.array([len(x) for x in out], pa.int64()), pa.array(out, pa.binary())], names=["path", "length", "content"])

    # a small table is read by few tasks, and files are made and read where it is
    keys = read(spark, sf_dir, "customer").select("c_custkey").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey")
    heads = keys.mapInArrow(files, "path string, length bigint, content binary")
    s = metadata.shots(metadata.headers(heads))
    return s.select(
        F.col("path").cast("bigint").alias("k"), r6(F.col("lat"), 5).alias("lat"), r6(F.col("lon"), 5).alias("lon"), r6(F.col("fov_deg")).alias("fov_deg"), F.col("width").cast("bigint").alias("width"), "relative_m", "pitch_deg",
        r6(F.col("gsd_m")).alias("gsd_m"), r6(F.col("absolute_m"), 3).alias("absolute_m"), F.array_join("problems", "; ").alias("problems"),
    )


@query(f"""WITH {CELLS}, o AS (SELECT cell_id, lat, lon, 54.75e0 AS la, 55.93e0 AS lo FROM cells)
SELECT cell_id, {d6(f"{haversine_sql('la', 'lo', 'la', 'lon')} * sign(lon - lo)", 4)} AS east_m, {d6(f"{haversine_sql('la', 'lo', 'lat', 'lo')} * sign(lat - la)", 4)} AS north_m FROM o""")
def geo_local_metres(spark, sf_dir):
    """Cells in metres east and north of one of them."""
    e, n = geo.enu(lat0=F.lit(54.75), lon0=F.lit(55.93), lat="lat", lon="lon")
    return cells(spark, sf_dir).select("cell_id", r6(e, 4).alias("east_m"), r6(n, 4).alias("north_m"))
