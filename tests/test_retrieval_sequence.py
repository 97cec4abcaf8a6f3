"""Search, thresholds, trajectories, signals and tiles on small cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyanchor.operators import evaluation, imagery, report, retrieval, sequence, signals, vectors
from skyanchor.sources import metadata


def vecs(spark, n, d=16, seed=0, name="cell_id"):
    x = np.random.default_rng(seed).normal(size=(n, d))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    return spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)], f"{name} bigint, embedding array<float>"), x.astype(np.float32).astype(float)


def test_topk_equals_brute_force_with_ties_and_nulls(spark):
    f, a = vecs(spark, 7, seed=1, name="frame_id")
    c, b = vecs(spark, 50)
    c = c.union(c.filter("cell_id < 10").selectExpr("cell_id + 100", "embedding")).union(spark.createDataFrame([(999, None)], c.schema))
    got = {(r.frame_id, r["rank"]): r.cell_id for r in retrieval.topk_join(f, c, 4).collect()}
    ids = np.array([*range(50), *range(100, 110)])
    s = a @ np.concatenate([b, b[:10]]).T
    for i in range(7):
        want = sorted(range(60), key=lambda j: (-round(s[i, j], 12), ids[j]))[:4]
        assert [got[i, k + 1] for k in range(4)] == [ids[j] for j in want]
    assert retrieval.topk_join(f, c.limit(0), 4).count() == 0


def test_lsh_recall(spark):
    c, _ = vecs(spark, 400, d=32)
    f = c.filter("cell_id < 40").withColumnRenamed("cell_id", "frame_id")
    exact, near = retrieval.topk_join(f, c, 3), vectors.lsh_topk(f, c, 3)
    assert near.join(exact, ["frame_id", "cell_id"], "left_semi").count() / exact.count() > 0.8


def test_pca(spark):
    x = np.random.default_rng(0).normal(size=(300, 6)) * [5, 3, 1, 0.5, 0.2, 0.1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id bigint, embedding array<double>")
    m = vectors.pca_fit(df, 3)
    got = m.orderBy("component").toPandas()
    want = np.linalg.eigvalsh(np.cov(x.T))[::-1][:3]
    assert np.allclose(got.variance, want, rtol=1e-4)
    y = vectors.pca_apply(df, m).toPandas()
    assert np.allclose([np.linalg.norm(v) for v in y.embedding], 1, atol=1e-5)
    assert vectors.pca_fit(df.limit(0), 3).count() == 0


@pytest.mark.parametrize("rows,want", [([(0.9, 1), (0.8, 1), (0.3, 0), (0.1, 0)], (0.8, 1.0)), ([(0.5, 1), (0.4, 1)], (0.0, 0.0)), ([], (0.0, 0.0))])
def test_youden(spark, rows, want):
    r = retrieval.youden(spark.createDataFrame(rows, "score double, label int")).first()
    assert (r.threshold, r.j) == pytest.approx(want)


def test_radius_join_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    p = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(50, 50.05, 120), rng.uniform(10, 10.08, 120)))]
    a, b = spark.createDataFrame(p, "l_id bigint, l_lat double, l_lon double"), spark.createDataFrame(p, "r_id bigint, r_lat double, r_lon double")
    from skyanchor.functions.geo import haversine

    want = a.crossJoin(b).filter(haversine(lat1="l_lat", lon1="l_lon", lat2="r_lat", lon2="r_lon") <= 700).count()
    assert retrieval.radius_join(a, b, 700.0).count() == want > 120


@pytest.mark.parametrize("radius", [300.0, 40_000.0, 900_000.0, 15_000_000.0])
def test_radius_join_all_over_the_globe(spark, radius):
    rng = np.random.default_rng(8)
    lat = np.concatenate([np.degrees(np.arcsin(rng.uniform(-1, 1, 150))), [90, -90, 89.9999, 89.9999, 0, 0, 60, 60]])
    lon = np.concatenate([rng.uniform(-180, 180, 150), [0, 0, 10, -170, 179.999, -179.999, 180, -180]])
    lat = np.concatenate([lat, np.clip(lat + rng.normal(0, 0.1, len(lat)), -90, 90)])
    lon = np.concatenate([lon, (lon + rng.normal(0, 0.1, len(lon)) + 180) % 360 - 180])
    p = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))]
    a, b = spark.createDataFrame(p, "l_id bigint, l_lat double, l_lon double"), spark.createDataFrame(p, "r_id bigint, r_lat double, r_lon double")
    la, lo = np.radians(lat)[:, None], np.radians(lon)[:, None]
    h = np.sin((la - la.T) / 2) ** 2 + np.cos(la) * np.cos(la.T) * np.sin((lo - lo.T) / 2) ** 2
    want = (2 * 6371008.8 * np.arcsin(np.sqrt(np.clip(h, 0, 1))) <= radius).sum()
    got = retrieval.radius_join(a, b, radius).select("l_id", "r_id")
    assert got.count() == got.distinct().count() and abs(got.count() - want) <= 2


def test_topk_within_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    c, x = vecs(spark, 300)
    f, y = vecs(spark, 12, seed=9, name="frame_id")
    at = lambda n, k: spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(59.9, 60.1, n), (rng.uniform(179.8, 180.2, n) + 180) % 360 - 180))], f"{k} bigint, lat double, lon double")
    c = c.join(at(300, "cell_id"), "cell_id").cache()
    f = f.join(at(12, "frame_id"), "frame_id").selectExpr("frame_id", "embedding", "lat prior_lat", "lon prior_lon", "case when frame_id = 3 then 0.001D else 1000D + 100 * frame_id end sigma_m").cache()
    cells, frames = c.toPandas(), f.toPandas()
    want = set()
    for r in frames.itertuples():
        p, q = np.radians(cells.lat.to_numpy()), np.radians(cells.lon.to_numpy())
        h = np.sin((p - np.radians(r.prior_lat)) / 2) ** 2 + np.cos(p) * np.cos(np.radians(r.prior_lat)) * np.sin((q - np.radians(r.prior_lon)) / 2) ** 2
        near = cells[2 * 6371008.8 * np.arcsin(np.sqrt(h)) <= 3 * r.sigma_m]
        s = sorted(((-float(x[i] @ y[r.frame_id]), i) for i in near.cell_id))[:4]
        want |= {(r.frame_id, i, k + 1) for k, (_, i) in enumerate(s)}
    got = {(r.frame_id, r.cell_id, r["rank"]) for r in retrieval.topk_within(f, c, 4).collect()}
    assert got == want and len({g[0] for g in got}) < 12
    assert retrieval.topk_within(f.limit(0), c, 4).count() == 0 and retrieval.topk_within(f, c.limit(0), 4).count() == 0


def test_uniqueness_over_all_cells(spark):
    """200 copies of the best cell lie beside it, and one rival far off: no pool of candidates would hold the rival."""
    e = lambda a, b: [float(a), float(b)]
    rows = [(i, 50.0 + i * 1e-6, 10.0, e(1, 0)) for i in range(200)] + [(999, 51.0, 10.0, e(0.6, 0.8))]
    c = spark.createDataFrame(rows, "cell_id bigint, lat double, lon double, embedding array<float>")
    f = spark.createDataFrame([(1, e(1, 0)), (2, None)], "frame_id bigint, embedding array<float>")
    got = {r.frame_id: (r.cell_id, round(r.uniqueness, 5)) for r in retrieval.uniqueness(f, c, 500.0).collect()}
    assert got == {1: (0, 0.4)}
    assert retrieval.uniqueness(f, c.filter("cell_id < 200"), 500.0).first().uniqueness == 1.0


def test_lsh_finds_near_vectors_among_few_candidates(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x[:200] * 0.8 + 0.6 * x[200:400]
    mk = lambda v, n: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], f"{n} bigint, embedding array<double>")
    got = {r.frame_id: r.cell_id for r in vectors.lsh_topk(mk(y, "frame_id"), mk(x, "cell_id"), 1).collect()}
    assert np.mean([got.get(i) == i for i in range(200)]) > 0.95
    # what the frames' buckets hold, of all pairs
    bits = int(np.clip(np.ceil(np.log2(4000 / vectors.BUCKET_CELLS)), 6, 24))
    assert 32 * (1 + bits) / 2**bits < 0.7
    planes = np.random.default_rng(1).normal(size=(48, 32 * bits))
    a, b = ((v @ planes > 0).reshape(len(v), 32, bits) for v in (y, x))
    met = np.mean([((r[None] != b).sum(axis=2).min(axis=1) <= 1).mean() for r in a[:40]])
    assert met < 0.6


def test_search_backends(spark):
    from skyanchor.functions import plugins

    c, _ = vecs(spark, 60)
    f = c.filter("cell_id < 5").withColumnRenamed("cell_id", "frame_id")
    for name in ("exact", "lsh"):
        assert {(r.frame_id, r.cell_id) for r in vectors.search(f, c, 1, name).collect()} == {(i, i) for i in range(5)}
    plugins.register("ann", "first", lambda: lambda frames, cells, k: frames.selectExpr("frame_id", "0L as cell_id", "1D as similarity", "1L as rank"))
    assert vectors.search(f, c, 1, "first").count() == 5
    with pytest.raises(KeyError):
        vectors.search(f, c, 1, "none")


def test_ratio_test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "DESCRIPTOR_BLOCK", 7)
    rng = np.random.default_rng(6)
    x = rng.integers(0, 4, (90, 6)).astype(float)
    rows = [(i % 3, i, v.tolist()) for i, v in enumerate(x)] + [(None, 500, x[0].tolist()), (1, 501, None)]
    q = spark.createDataFrame(rows, "image int, q_id bigint, embedding array<double>")
    r = q.withColumnRenamed("q_id", "r_id")
    want = set()
    for i in range(90):
        d = sorted((round(float(np.linalg.norm(x[i] - x[j])), 9), j) for j in range(90) if j % 3 == i % 3 and j != i)
        if d[1][0] > 0 and d[0][0] < 0.9 * d[1][0]:
            want.add((i % 3, i, d[0][1], round(1 - d[0][0] / d[1][0], 9)))
    got = {(m.image, m.q_id, m.r_id, round(m.conf, 9)) for m in retrieval.ratio_test(q, r, 0.9).collect()}
    assert got == want and want
    assert retrieval.ratio_test(q, r, 0.9, 1).count() <= 3


def test_a_hundred_thousand_steps_fold_in_linear_time(spark):
    import time

    one = spark.range(100_000).selectExpr("0L u", "id + 1 i", "1D delta_east_m", "0D delta_north_m", "0D delta_yaw_deg", "0.5D step_sigma_m", "false missing", *(f"cast(null as double) {c}" for c in ("fix_east_m", "fix_north_m", "fix_heading_deg", "fix_sigma_m", "fix_heading_sigma_deg")))
    began = time.time()
    r = sequence.ekf(one, "u").agg(F.count("*").alias("n"), F.max("east_m").alias("e")).first()
    assert (r.n, r.e) == (100_000, 100_000) and time.time() - began < 40


def test_running_clusters_equal_a_plain_fold(spark):
    rng = np.random.default_rng(1)
    p = [(int(g), i, float(a), float(b)) for i, (g, a, b) in enumerate(zip(rng.integers(0, 2, 300), rng.uniform(50, 50.3, 300), rng.uniform(10, 10.3, 300)))]
    want = set()
    for g in (0, 1):
        c = []
        for _, i, a, b in (r for r in p if r[0] == g):
            for k, (x, y, n) in enumerate(c):
                h = math.sin(math.radians(a - x) / 2) ** 2 + math.cos(math.radians(x)) * math.cos(math.radians(a)) * math.sin(math.radians(b - y) / 2) ** 2
                if 2 * 6371008.8 * math.asin(math.sqrt(h)) < 5000:
                    c[k] = ((x * n + a) / (n + 1), (y * n + b) / (n + 1), n + 1)
                    break
            else:
                k = len(c)
                c.append((a, b, 1))
            want.add((g, i, k))
    df = spark.createDataFrame(p, "g bigint, i bigint, lat double, lon double")
    assert {tuple(r) for r in sequence.running_clusters(df, "g", "i", 5.0).collect()} == want


def test_silent_users_are_lost_by_event_time(spark, tmp_path):
    from skyanchor.streaming.ekf import presence, to_folder

    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "user_id bigint, ts timestamp"
    spark.createDataFrame([], schema).write.parquet(path)
    q = presence(spark.readStream.schema(schema).parquet(path), "30 minutes", "0 seconds").writeStream.outputMode("update").foreachBatch(to_folder(out)).option("checkpointLocation", str(tmp_path / "c")).start()
    for user, at in ((1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:10:00"), (2, "2024-01-01 00:50:00"), (2, "2024-01-01 00:55:00")):
        spark.sql(f"select {user}L user_id, timestamp'{at}' ts").write.mode("append").parquet(path)
        q.processAllAvailable()
    q.stop()
    got = {(r.user_id, str(r.last_ts)[11:16], r.n) for r in spark.read.parquet(out).filter("lost").collect()}
    assert (1, "00:00", 1) in got and all(g[0] == 1 or g[2] < 3 for g in got)


def test_duplicates_within_the_watermark(spark, tmp_path):
    from skyanchor.streaming.ekf import to_folder, unique_events, windows

    path = str(tmp_path / "in")
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a", 1.0), (1, "2024-01-01 00:01:00", "a", 2.0), (2, "2024-01-01 00:20:00", "a", 3.0)], "event_id bigint, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(path)
    stream = lambda: spark.readStream.schema(e.schema).parquet(path)
    for name, df in (("u", unique_events(stream())), ("w", windows(stream(), "15 minutes", "5 minutes", "0 seconds"))):
        q = df.writeStream.outputMode("append").foreachBatch(to_folder(str(tmp_path / name))).option("checkpointLocation", str(tmp_path / f"{name}c")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "u")).collect()) == [1, 2]
    w = spark.read.parquet(str(tmp_path / "w"))
    assert {str(r.start)[11:16]: r.n for r in w.collect()} == {"23:50": 2, "23:55": 2, "00:00": 2}


def test_intervals_few_and_many(spark, monkeypatch):
    from skyanchor.operators import intervals

    i = spark.createDataFrame([(float(k), float(k + 1 + k % 3), k) for k in range(50)], "h0 double, h1 double, k int")
    v = spark.createDataFrame([(x / 4,) for x in range(-4, 220)] + [(None,)], "h double")
    want = sorted((x / 4, k) for x in range(-4, 220) for k in range(50) if k <= x / 4 < k + 1 + k % 3)
    for most in (10_000, 0):
        monkeypatch.setattr(intervals, "BROADCAST_ROWS", most)
        assert sorted((r.h, r.k) for r in intervals.interval_join(v, "h", i).collect()) == want


def steps(spark, rows):
    return spark.createDataFrame(
        rows, "u bigint, i bigint, delta_east_m double, delta_north_m double, delta_yaw_deg double, step_sigma_m double, missing boolean, fix_east_m double, fix_north_m double, fix_heading_deg double, fix_sigma_m double, fix_heading_sigma_deg double"
    )


def test_anchors_bound_drift(spark):
    free = [(0, i, 1.3, 0.0, 0.0, 0.5, False, None, None, None, None, None) for i in range(1, 21)]
    held = [(1, i, 1.3, 0.0, 0.0, 0.5, False, *((float(i), 0.0, 0.0, 0.3, 1.0) if i % 4 == 0 else (None,) * 5)) for i in range(1, 21)]
    got = {r.u: r for r in sequence.ekf(steps(spark, free + held), "u", every=False).collect()}
    assert got[0].east_m - 20 == pytest.approx(6, rel=0.2) and abs(got[1].east_m - 20) < 1


def test_missing_frame_inflates_without_moving(spark):
    got = sequence.ekf(steps(spark, [(0, 1, 5.0, 5.0, 9.0, 1.0, True, None, None, None, None, None)]), "u").first()
    assert (got.east_m, got.north_m, got.heading_deg) == (0, 0, 0) and got.var_m2 == 1 + 50**2


def test_heading_wraps(spark):
    rows = [(0, 1, 0.0, 0.0, 350.0, 1.0, False, 0.0, 0.0, 10.0, 1.0, 1.0)]
    assert -10 <= sequence.ekf(steps(spark, rows), "u").first().heading_deg <= 30


def test_stream_equals_batch(spark):
    from skyanchor.plans.sequence_queries import sequence_stream_equals_batch

    got = sequence_stream_equals_batch(spark, "/root/testdata/sf0.001")
    assert got.filter("same").count() == got.count() > 0


def test_streamed_sessions_are_the_closed_ones(spark, tmp_path):
    from skyanchor.streaming.ekf import sessions

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    q = sessions(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("s").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    from skyanchor.plans.sequence_queries import events_session_window

    batch = events_session_window(spark, "/root/testdata/sf0.001").select("user_id", "n")
    assert 0 < spark.table("s").count() <= batch.count() and spark.table("s").select("user_id", "n").exceptAll(batch).count() == 0


def pixels(spark, a, b):
    n = a.shape[1]
    return spark.createDataFrame([(0, int(i // n), int(i % n), float(x), float(y)) for i, (x, y) in enumerate(zip(a.ravel(), b.ravel()))], "pair_id bigint, y int, x int, a double, b double")


def test_signals_of_equal_and_inverted_rasters(spark):
    z = imagery.rotate(np.random.default_rng(0).uniform(0, 255, (64, 64)), 10).round()
    assert signals.nmi(pixels(spark, z, z)).first().nmi == pytest.approx(2)
    assert signals.ncc(pixels(spark, z, 255 - z)).first().ncc == pytest.approx(-1)
    assert signals.ncc(pixels(spark, z, z * 0)).first().ncc == 0
    for f in signals.MEASURES.values():
        assert f(z, z) == pytest.approx(1, abs=1e-6) and f(z, 255 - z) > 0.9
    assert signals.ngf(z * 0, z) == 0.5 and signals.edge_dice(z * 0, z) == 0
    assert signals.structural(z, z, np.zeros(z.shape, bool)) == -1 and signals.structural(z, z, np.ones(z.shape, bool)) == pytest.approx(1)


def test_auc_with_ties(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 0), ("a", 2.0, 1), ("a", 0.0, 0), ("b", 1.0, 1)], "g string, s double, y int")
    got = {r.g: r.auc for r in evaluation.auc(df, "s", "y", "g").collect()}
    assert got == {"a": 0.875, "b": None}


def test_rotation_keeps_a_flat_raster():
    assert np.allclose(imagery.rotate(np.full((9, 9), 4.0), 33), 4) and np.allclose(imagery.rotate(np.arange(25.0).reshape(5, 5), 0), np.arange(25.0).reshape(5, 5))


def test_stitch(spark):
    t = np.arange(65536, dtype=np.uint32).astype(np.uint8).tobytes()
    df = spark.createDataFrame([(1, -200, -200, 100, 60, t), (1, 56, -200, 100, 60, None)], "window_id bigint, dx int, dy int, width int, height int, tile binary")
    with pytest.raises(Exception, match="not 256 x 256"):
        imagery.stitch(df.withColumn("tile", F.lit(b"short"))).collect()
    with pytest.raises(Exception, match="outside the world"):
        imagery.stitch(df.withColumn("dx", F.lit(400))).collect()
    got = np.frombuffer(imagery.stitch(df).first().pixels, np.uint8).reshape(60, 100)
    assert (got[:56, :56] == np.frombuffer(t, np.uint8).reshape(256, 256)[200:, 200:]).all() and not got[56:].any() and not got[:, 56:].any()


def test_refused_results_have_no_geometry(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]
    df = spark.createDataFrame([("a&b", "localized", 0.5, 0.5, ring), ("c", "not_localized", None, None, None)], "name string, status string, lon double, lat double, ring array<struct<lon:double,lat:double>>")
    import json

    a, b = (json.loads(r[0]) for r in df.select(report.footprint_geojson()).collect())
    assert len(a["features"]) == 2 and a["features"][0]["geometry"]["coordinates"][0][0] == a["features"][0]["geometry"]["coordinates"][0][-1] and b["features"] == []
    k = [r[0] for r in df.select(report.footprint_kml()).collect()]
    assert "a&amp;b" in k[0] and "Placemark" in k[0] and "Placemark" not in k[1]
    html = report.html_report(df.select("name", "status")).first().html
    assert "<td>c</td>" in html and "\n".join(r.line for r in report.html_lines(df.select("name", "status")).collect()) == html
    assert json.loads(df.select(report.result_json("name", "lat")).first()[0]) == {"name": "a&b", "lat": 0.5}


DJI = '<x:xmpmeta a:GimbalYawDegree="-90.5" a:GimbalPitchDegree="-88.0" a:GimbalRollDegree="1.0" a:RelativeAltitude="+120.0"/></x:xmpmeta>'


def test_metadata_scan(spark, tmp_path):
    from skyanchor.sources import exif

    whole = {"model": "Cam", "taken": "2024:05:06 07:08:09", "focal_35mm": 24, "lat": 55.5, "lon": -37.25, "absolute_m": 300.5}
    files = {
        "a": exif.write(4000, 3000, packet=DJI, **whole), "b": b"x", "c": b"", "d": exif.write(4000, 3000, packet=DJI.replace("Gimbal", "G").replace("GYaw", "Yaw").replace("GPitchDegree", "Pitch").replace("YawDegree", "Yaw"), order=">", **whole),
        "e": exif.write(4000, 3000, packet=DJI.replace("-88", "-60"), **whole), "f": exif.write(4000, 3000, packet=DJI, **whole)[:60],
    }
    for name, data in files.items():
        (tmp_path / f"{name}.jpg").write_bytes(data)
    got = {r.path[-5]: r for r in metadata.scan(spark, str(tmp_path)).collect()}
    a, d = got["a"], got["d"]
    assert set(got) == set("abdef")  # an empty file is no shot
    assert (a.width, a.height, a.model, a.yaw_deg, a.pitch_deg, a.relative_m, a.problems) == (4000, 3000, "Cam", -90.5, 2.0, 120.0, [])
    assert (a.lat, a.lon, a.absolute_m) == pytest.approx((55.5, -37.25, 300.5), abs=1e-6) and a.taken.year == 2024
    assert a.fov_deg == pytest.approx(2 * math.degrees(math.atan(18 / 24))) and a.gsd_m == pytest.approx(2 * 120 * 0.75 / 4000)
    assert (d.yaw_deg, d.relative_m, d.lat) == (-90.5, None, pytest.approx(55.5, abs=1e-6)) and d.problems[0] == "no height above ground"
    assert got["b"].problems == ["metadata incomplete", "no focal length", "no position", "no XMP", "no orientation", "no height above ground", "no time"]
    assert got["e"].problems == ["tilted by 30 degrees"] and "metadata incomplete" in got["f"].problems
    dem = spark.createDataFrame([(5550, -3725, 200.0)], "gy bigint, gx bigint, ground_m double")
    full = {r.path[-5]: (round(r.altitude_m, 3), r.heading_deg) for r in metadata.full_shots(metadata.scan(spark, str(tmp_path)), dem, 10.0).collect()}
    assert full == {"a": (120.0, -80.5), "d": (100.5, -80.5), "e": (120.0, -80.5)}
    assert set(r.path[-5] for r in metadata.full_shots(metadata.scan(spark, str(tmp_path))).collect()) == {"a", "e"}
    from skyanchor.sources import manifest

    index = {r.path[-5]: r for r in manifest.shot_index(metadata.scan(spark, str(tmp_path))).collect()}
    assert index["a"].usable and index["a"].command.endswith("--lat 55.50000 --lon -37.25000 --sigma-m 2000 --gsd 0.0450 --yaw -90.5") and index["b"].command is None
    s = metadata.full_shots(metadata.scan(spark, str(tmp_path))).withColumn("path", F.regexp_extract("path", "[^/]+$", 0))
    text = "cases:\n - {name: x, path: a.jpg, prior: {lat: 55.6, lon: -37.0, sigma_m: 300}}\n - {name: y, path: nope.jpg}\n - {name: z, path: e.jpg, regime: winter}\n"
    good, out = manifest.load_manifest(spark, text, s)
    x, z = good.orderBy("name").collect()
    assert (x.prior_lat, x.sigma_m, x.truth_source, x.trust_yaw, x.altitude_m) == (55.6, 300, "exif", True, 120) and x.truth_lat == pytest.approx(55.5, abs=1e-6) and x.gsd_m == pytest.approx(0.045)
    assert (z.regime, z.prior_lat) == ("winter", pytest.approx(55.5, abs=1e-6)) and [(r.name, r.reason) for r in out.collect()] == [("y", "no usable metadata")]


def test_asof_takes_the_last_value_at_or_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 3, 30.0), (1, 5, 50.0), (1, 7, 70.0)], "k int, t int, v double")
    assert sorted(map(tuple, sequence.asof(left, right, "k", "t", "v").collect()), key=str) == [(1, 1, None), (1, 5, 50.0), (2, 9, None)]
    assert math.isclose(left.agg(F.sum("t")).first()[0], 15)


def test_clusters_cover_all_cells(spark):
    from skyanchor.catalogue import QUERIES

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    got = QUERIES["cluster_running_centroid_all"](spark, sf).toPandas()
    assert n > 250 and len(got) == got.i.nunique() == n and got.groupby("g").size().max() <= 50
    first = QUERIES["cluster_running_centroid"](spark, sf).toPandas()
    assert first.merge(got, on=["g", "i", "cluster"]).shape[0] == len(first)


def test_true_cell_ranks_below_64(spark):
    cells = spark.createDataFrame([(i, 55.0 + i * 0.01, 37.0, [1.0, 0.0] if i < 100 else [0.5, 0.5]) for i in range(120)], "cell_id bigint, lat double, lon double, embedding array<float>")
    f = spark.createDataFrame([(7, 56.1, 37.0, [1.0, 0.0]), (8, 55.9, 37.0, [1.0, 0.0])], "frame_id bigint, true_lat double, true_lon double, embedding array<float>")
    got = {r.frame_id: (r.true_cell_rank, round(r.true_cell_m)) for r in retrieval.true_cell_rank(f, cells).collect()}
    assert got == {7: (111, 0), 8: (91, 0)}
