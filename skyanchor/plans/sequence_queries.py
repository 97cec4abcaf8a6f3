"""Sequence, streaming, metadata and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pose, report, sequence
from ..sources import metadata, weights
from .adapters import CELLS, cells, correspondences, haversine_sql, read
from .pose_queries import _C, _FITTED, _K
from .registry import d6, query, r6

_TEL = """tel AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, ts, event_id, event_type, value, value * cos(radians((event_id % 360)::DOUBLE)) AS de, value * sin(radians((event_id % 360)::DOUBLE)) AS dn,
  ((event_id % 21) - 10)::DOUBLE AS dy, 1.0e0 + (event_id % 5) AS sg, event_type = 'error' AS missing FROM events)"""


def telemetry(spark, sf_dir):
    """Steps of each user's events; errors are missing frames, purchases absolute fixes."""
    e = read(spark, sf_dir, "events")
    t = F.radians((F.col("event_id") % 360).cast("double"))
    fix = F.col("event_type") == "purchase"
    return e.select(
        "user_id", (F.expr("row_number() over (partition by user_id order by ts, event_id)") - 1).cast("bigint").alias("i"), "ts", "event_id", "event_type", "value", (F.col("value") * F.cos(t)).alias("delta_east_m"),
        (F.col("value") * F.sin(t)).alias("delta_north_m"), ((F.col("event_id") % 21) - 10).cast("double").alias("delta_yaw_deg"), (F.lit(1.0) + F.col("event_id") % 5).alias("step_sigma_m"),
        (F.col("event_type") == "error").alias("missing"), F.when(fix, (F.col("event_id") % 100).cast("double")).alias("fix_east_m"), F.when(fix, (F.col("event_id") % 70).cast("double")).alias("fix_north_m"),
        F.when(fix, (F.col("event_id") % 360 - 180).cast("double")).alias("fix_heading_deg"), F.when(fix, 5.0).alias("fix_sigma_m"), F.when(fix, 3.0).alias("fix_heading_sigma_deg"),
    )


@query(f"WITH {_TEL} SELECT user_id, i, {d6('SUM(de) OVER w', 4)} AS east_m, {d6('SUM(dn) OVER w', 4)} AS north_m, dy - coalesce(lag(dy) OVER (PARTITION BY user_id ORDER BY i), 0) AS turn FROM tel WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING)")
def sequence_dead_reckoning(spark, sf_dir):
    t = sequence.dead_reckoning(telemetry(spark, sf_dir), "user_id", "i").selectExpr("*", "delta_yaw_deg - coalesce(lag(delta_yaw_deg) over (partition by user_id order by i), 0) turn")
    return t.select("user_id", "i", r6(F.col("east_m"), 4).alias("east_m"), r6(F.col("north_m"), 4).alias("north_m"), "turn")


def _w(x: str) -> str:
    return f"(({x}) + 180 - 360 * floor((({x}) + 180) / 360) - 180)"


_PV = "(s.v + CASE WHEN t.missing THEN 2500.0e0 ELSE t.sg * t.sg END)"
_PH = "(s.vh + 1.0e0)"
_E0, _N0, _H0 = "(s.e + CASE WHEN t.missing THEN 0 ELSE t.de END)", "(s.n + CASE WHEN t.missing THEN 0 ELSE t.dn END)", _w("s.h + CASE WHEN t.missing THEN 0 ELSE t.dy END")
_FIX = "t.event_type = 'purchase'"


_FOLD = f"""WITH RECURSIVE {_TEL}, s AS (SELECT user_id, -1::BIGINT AS i, 0.0e0 AS e, 0.0e0 AS n, 0.0e0 AS h, 1.0e0 AS v, 1.0e0 AS vh FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT t.user_id, t.i, CASE WHEN {_FIX} THEN {_E0} + {_PV} / ({_PV} + 25) * (t.event_id % 100 - {_E0}) ELSE {_E0} END, CASE WHEN {_FIX} THEN {_N0} + {_PV} / ({_PV} + 25) * (t.event_id % 70 - {_N0}) ELSE {_N0} END,
  CASE WHEN {_FIX} THEN {_w(f"{_H0} + {_PH} / ({_PH} + 9) * {_w(f'(t.event_id % 360 - 180) - {_H0}')}")} ELSE {_H0} END, CASE WHEN {_FIX} THEN (1 - {_PV} / ({_PV} + 25)) * {_PV} ELSE {_PV} END, CASE WHEN {_FIX} THEN (1 - {_PH} / ({_PH} + 9)) * {_PH} ELSE {_PH} END
  FROM s JOIN tel t ON t.user_id = s.user_id AND t.i = s.i + 1)"""


@query(f"""{_FOLD}
SELECT user_id, i, {d6('e', 4)} AS east_m, {d6('n', 4)} AS north_m, {d6('h', 4)} AS heading_deg, {d6('v', 4)} AS var_m2, {d6('vh', 4)} AS var_heading FROM s WHERE i >= 0""")
def sequence_ekf(spark, sf_dir):
    s = sequence.ekf(telemetry(spark, sf_dir), "user_id")
    return s.select("user_id", "i", *(r6(F.col(c), 4).alias(c) for c in ("east_m", "north_m", "heading_deg", "var_m2", "var_heading")))


@query(f"""WITH {_TEL}, p AS (SELECT user_id, i, SUM(de) OVER w AS e, SUM(dn) OVER w AS n, SUM(de + 0.3e0) OVER w AS ve, SUM(dn - 0.1e0) OVER w AS vn FROM tel WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, sqrt(pow(ve - e, 2) + pow(vn - n, 2)) AS err, sqrt(pow(e - lag(e) OVER x, 2) + pow(n - lag(n) OVER x, 2)) AS leg FROM p WINDOW x AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, {d6('coalesce(SUM(leg), 0)', 4)} AS path_m, {d6('arg_max(err, i)', 4)} AS final_m, {d6('CASE WHEN SUM(leg) > 0 THEN 100 * arg_max(err, i) / SUM(leg) END', 4)} AS final_pct, {d6('MAX(err)', 4)} AS max_m, {d6('quantile_cont(err, 0.5)', 4)} AS median_m FROM d GROUP BY user_id""")
def sequence_drift_metrics(spark, sf_dir):
    w = "over (partition by user_id order by i rows unbounded preceding)"
    t = telemetry(spark, sf_dir).selectExpr(
        "user_id", "i", f"sum(delta_east_m) {w} true_east_m", f"sum(delta_north_m) {w} true_north_m", f"sum(delta_east_m + 0.3D) {w} east_m", f"sum(delta_north_m - 0.1D) {w} north_m"
    )
    return sequence.drift(t, "user_id", "i").select("user_id", *(r6(F.col(c), 4).alias(c) for c in ("path_m", "final_m", "final_pct", "max_m", "median_m")))


@query("""SELECT v.user_id, v.event_id, v.ts, last_value(f.value ORDER BY f.ts, f.event_id) AS fix FROM events v LEFT JOIN events f ON f.user_id = v.user_id AND f.event_type = 'purchase' AND f.ts <= v.ts WHERE v.event_type = 'view' GROUP BY ALL""".replace("last_value(f.value ORDER BY f.ts, f.event_id)", "arg_max(f.value, f.ts)"))
def sequence_asof_fix(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    left = e.filter("event_type = 'view'").select("user_id", "event_id", "ts")
    right = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("fix"))
    return sequence.asof(left, right, "user_id", "ts", "fix")


@query(f"""{_FOLD} SELECT user_id, MAX(i) AS i, {d6('arg_max(e, i)', 4)} AS east_m, {d6('arg_max(n, i)', 4)} AS north_m, TRUE AS same FROM s WHERE i >= 0 GROUP BY user_id""")
def sequence_stream_equals_batch(spark, sf_dir):
    """Final filter state of each user from the streamed fold next to that of the batch fold."""
    from ..streaming.ekf import stream_final_states

    batch = sequence.ekf(telemetry(spark, sf_dir), "user_id", every=False)
    stream = stream_final_states(spark, telemetry(spark, sf_dir)).select("user_id", F.col("i").alias("si"), F.col("east_m").alias("se"), F.col("north_m").alias("sn"))
    j = batch.join(stream, "user_id", "full_outer")
    same = (F.col("i") == F.col("si")) & (F.abs(F.col("east_m") - F.col("se")) < 1e-6) & (F.abs(F.col("north_m") - F.col("sn")) < 1e-6)
    return j.select("user_id", "i", r6(F.col("east_m"), 4).alias("east_m"), r6(F.col("north_m"), 4).alias("north_m"), F.coalesce(same, F.lit(False)).alias("same"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, MIN(ts) AS start, MAX(ts) + INTERVAL 30 MINUTE AS stop, COUNT(*) AS n, round(SUM(value), 4) AS total FROM s GROUP BY user_id, sid""")
def events_session_window(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("t", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), "n", "total")


@query("SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS start, event_type, COUNT(*) AS n, round(AVG(value), 6) AS mean FROM events GROUP BY ALL")
def events_tumbling_window(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("t", "15 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "mean")


@query("""WITH x AS (SELECT page_id, '<x:xmpmeta drone:RelativeAltitude="+' || (page_id % 400) || '.5" drone:GimbalPitchDegree="' || (page_id % 30 - 95) || '.0"><drone:GpsLatitude>' || (40 + page_id % 15) || '.25</drone:GpsLatitude></x:xmpmeta>' AS x, html, url FROM pages)
SELECT page_id, (400 * 0 + page_id % 400 + 0.5)::DOUBLE AS relative_m, (page_id % 30 - 95 + 90)::DOUBLE AS pitch_deg, (40 + page_id % 15 + 0.25)::DOUBLE AS lat, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
  abs(page_id % 30 - 95 + 90) <= 10 AS nadir, round((CASE WHEN page_id % 2 = 0 THEN -1 ELSE 1 END) * (page_id % 90 + (page_id % 60) / 60.0e0 + (page_id % 50) / 3600.0e0), 6) + 0.0 AS deg FROM x""")
def metadata_xmp_extract(spark, sf_dir):
    from ..functions.camera import is_nadir
    from ..functions.geo import dms_to_deg

    p = read(spark, sf_dir, "pages")
    k = F.col("page_id")
    packet = F.concat(
        F.lit('<x:xmpmeta drone:RelativeAltitude="+'), (k % 400).cast("string"), F.lit('.5" drone:GimbalPitchDegree="'), (k % 30 - 95).cast("string"), F.lit('.0"><drone:GpsLatitude>'),
        (k % 15 + 40).cast("string"), F.lit(".25</drone:GpsLatitude></x:xmpmeta>"),
    )
    p = p.withColumn("packet", packet).withColumn("pitch_deg", metadata.xmp_number("packet", "GimbalPitchDegree") + 90)
    return p.select(
        "page_id", metadata.xmp_number("packet", "RelativeAltitude").alias("relative_m"), "pitch_deg", metadata.xmp_number("packet", "GpsLatitude").alias("lat"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
        is_nadir("pitch_deg").alias("nadir"), r6(dms_to_deg(degrees=k % 90, minutes=k % 60, seconds=k % 50, ref=F.when(k % 2 == 0, "S").otherwise("N"))).alias("deg"),
    )


@query("SELECT event_type, (json_extract_string(props, '$.k')::BIGINT) % 10 AS k, COUNT(*) AS n, COUNT(json_extract_string(props, '$.absent')) AS absent FROM events GROUP BY ALL")
def metadata_json_props(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k bigint, absent string"))
    return e.groupBy("event_type", (F.col("p.k") % 10).alias("k")).agg(F.count("*").alias("n"), F.count("p.absent").alias("absent"))


@query("SELECT doc_id, first_value(doc_id) OVER (PARTITION BY n_chars, lang ORDER BY doc_id) AS first_id, first_value(doc_id) OVER (PARTITION BY n_chars, lang ORDER BY doc_id) <> doc_id AS duplicate FROM documents")
def duplicate_shots(spark, sf_dir):
    return sequence.first_duplicates(read(spark, sf_dir, "documents"), "doc_id", ["n_chars", "lang"]).withColumnRenamed("first", "first_id")


@query(f"""WITH RECURSIVE {CELLS}, p AS (SELECT cell_id % 5 AS g, cell_id AS id, row_number() OVER (PARTITION BY cell_id % 5 ORDER BY cell_id) AS i, lat, lon FROM cells WHERE cell_id < 250),
r AS (SELECT g, id, i, [lat] AS la, [lon] AS lo, [1::BIGINT] AS n, 0::BIGINT AS c FROM p WHERE i = 1
UNION ALL SELECT g, id, i, CASE WHEN k < 0 THEN list_append(la, lat) ELSE list_transform(la, lambda v, j: CASE WHEN j = k + 1 THEN (v * n[j] + lat) / (n[j] + 1) ELSE v END) END,
  CASE WHEN k < 0 THEN list_append(lo, lon) ELSE list_transform(lo, lambda v, j: CASE WHEN j = k + 1 THEN (v * n[j] + lon) / (n[j] + 1) ELSE v END) END,
  CASE WHEN k < 0 THEN list_append(n, 1) ELSE list_transform(n, lambda v, j: CASE WHEN j = k + 1 THEN v + 1 ELSE v END) END, CASE WHEN k < 0 THEN len(la) ELSE k END
  FROM (SELECT p.g, p.id, p.i, p.lat, p.lon, r.la, r.lo, r.n, coalesce(list_position(list_transform(la, lambda v, j: {haversine_sql('v', 'lo[j]', 'p.lat', 'p.lon')} < 800), TRUE), 0) - 1 AS k FROM r JOIN p ON p.g = r.g AND p.i = r.i + 1))
SELECT g, id AS i, c AS cluster FROM r""")
def cluster_running_centroid(spark, sf_dir):
    p = cells(spark, sf_dir).filter("cell_id < 250").select((F.col("cell_id") % 5).alias("g"), F.col("cell_id").alias("id"), "lat", "lon")
    return sequence.running_clusters(p, "g", "id", 0.8)


@query(f"""WITH RECURSIVE {CELLS}, p AS (SELECT cell_id // 250 * 5 + cell_id % 5 AS g, cell_id AS id, row_number() OVER (PARTITION BY cell_id // 250 * 5 + cell_id % 5 ORDER BY cell_id) AS i, lat, lon FROM cells),
r AS (SELECT g, id, i, [lat] AS la, [lon] AS lo, [1::BIGINT] AS n, 0::BIGINT AS c FROM p WHERE i = 1
UNION ALL SELECT g, id, i, CASE WHEN k < 0 THEN list_append(la, lat) ELSE list_transform(la, lambda v, j: CASE WHEN j = k + 1 THEN (v * n[j] + lat) / (n[j] + 1) ELSE v END) END,
  CASE WHEN k < 0 THEN list_append(lo, lon) ELSE list_transform(lo, lambda v, j: CASE WHEN j = k + 1 THEN (v * n[j] + lon) / (n[j] + 1) ELSE v END) END,
  CASE WHEN k < 0 THEN list_append(n, 1) ELSE list_transform(n, lambda v, j: CASE WHEN j = k + 1 THEN v + 1 ELSE v END) END, CASE WHEN k < 0 THEN len(la) ELSE k END
  FROM (SELECT p.g, p.id, p.i, p.lat, p.lon, r.la, r.lo, r.n, coalesce(list_position(list_transform(la, lambda v, j: {haversine_sql('v', 'lo[j]', 'p.lat', 'p.lon')} < 800), TRUE), 0) - 1 AS k FROM r JOIN p ON p.g = r.g AND p.i = r.i + 1))
SELECT g, id AS i, c AS cluster FROM r""")
def cluster_running_centroid_all(spark, sf_dir):
    """All cells, in groups of at most 50 whose number grows with the table; the first five are those of cluster_running_centroid."""
    p = cells(spark, sf_dir).select(F.expr("cell_id div 250 * 5 + cell_id % 5").alias("g"), F.col("cell_id").alias("id"), "lat", "lon")
    return sequence.running_clusters(p, "g", "id", 0.8)


def _ring():
    return ", ".join(f"[round({x}, 7), round({y}, 7)]" for x, y in [*_K, _K[0]])


@query(f"""WITH {_FITTED} SELECT frame_id, {d6(_C[0], 5)} AS lon, {d6(_C[1], 5)} AS lat, 5::BIGINT AS ring_points, 2::BIGINT AS features, {d6(_K[0][0], 5)} AS first_lon, {d6(_K[0][0], 5)} AS last_lon FROM fit WHERE frame_id % 5 <> 0
UNION ALL SELECT frame_id, NULL, NULL, NULL, 0, NULL, NULL FROM fit WHERE frame_id % 5 = 0""")
def report_geojson(spark, sf_dir):
    from ..functions.geo import Georef

    f = pose.fit_similarity(correspondences(spark, sf_dir))
    g = Georef(F.lit(37.6), F.lit(55.7), F.lit(18), F.lit(600), F.lit(600))
    corners = [g.to_lonlat(*pose.apply(F.lit(x), F.lit(y))) for x, y in ((0.0, 0.0), (511.0, 0.0), (511.0, 511.0), (0.0, 511.0))]
    lon, lat = g.to_lonlat(*pose.apply(F.lit(255.5), F.lit(255.5)))
    ring = F.array(*(F.struct(x.alias("lon"), y.alias("lat")) for x, y in corners))
    rows = f.select("frame_id", F.when(F.col("frame_id") % 5 == 0, "not_localized").otherwise("localized").alias("status"), lon.alias("lon"), lat.alias("lat"), ring.alias("ring"))
    schema = "features array<struct<type string, geometry struct<type string, coordinates string>>>"
    j = rows.select("frame_id", F.from_json(report.footprint_geojson(), schema)["features"].alias("fs"))
    polygon = F.from_json(F.get(F.col("fs"), F.lit(0))["geometry"]["coordinates"], "array<array<array<double>>>")[0]
    point = F.from_json(F.get(F.col("fs"), F.lit(1))["geometry"]["coordinates"], "array<double>")
    j = j.select("frame_id", F.size("fs").cast("bigint").alias("features"), polygon.alias("polygon"), point.alias("point"))
    points = F.when(F.col("polygon").isNotNull(), F.size("polygon")).cast("bigint")
    return j.select(
        "frame_id", r6(F.get("point", F.lit(0)), 5).alias("lon"), r6(F.get("point", F.lit(1)), 5).alias("lat"), points.alias("ring_points"), "features",
        r6(F.get(F.get("polygon", F.lit(0)), F.lit(0)), 5).alias("first_lon"), r6(F.get(F.get("polygon", F.lit(4)), F.lit(0)), 5).alias("last_lon"),
    )


@query(f"""WITH m AS (SELECT 'layer.' || i || '.w' AS name, '[' || i || ', 4]' AS shape, 'a' AS model FROM range(20) t(i) UNION ALL SELECT 'layer.' || i || '.w', '[' || i || ', 8]', 'b' FROM range(10) t(i)),
s AS (SELECT 'module.layer.' || i || '.w' AS name, CASE WHEN i = 3 THEN '[9, 9]' ELSE '[' || i || ', 4]' END AS shape FROM range(1, 20) t(i))
SELECT model, COUNT(*) AS tensors, COUNT(s.name) AS loaded, {d6('COUNT(s.name) / COUNT(*)::DOUBLE')} AS coverage, COUNT(s.name) / COUNT(*)::DOUBLE >= 0.9 AS ok FROM m LEFT JOIN s ON replace(s.name, 'module.', '') = m.name AND s.shape = m.shape GROUP BY model""")
def weights_coverage(spark, sf_dir):
    model = spark.createDataFrame([("a", f"layer.{i}.w", f"[{i}, 4]") for i in range(20)] + [("b", f"layer.{i}.w", f"[{i}, 8]") for i in range(10)], "model string, name string, shape string")
    state = spark.createDataFrame([(f"module.layer.{i}.w", "[9, 9]" if i == 3 else f"[{i}, 4]") for i in range(1, 20)], "name string, shape string")
    c = weights.coverage(model, state, {r"^module\.": ""})
    return c.withColumn("coverage", r6(F.col("coverage")))
