"""Stores, manifests, plug-ins, and localization from end to end."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyanchor.functions import plugins, request
from skyanchor.operators import imagery, retrieval
from skyanchor.plans import localize as loc
from skyanchor.sources import index, manifest, metadata, shared, tiles, weights


def test_acceptance_grid(spark):
    pairs, corr = loc.sample_grid(spark)
    m = loc.sample_metrics(loc.against_reference(pairs, corr, width=1024, height=1024, window_px=1280, focal_px=3000.0), pairs).toPandas()
    assert len(m) == 30 and m.localized.all()
    assert m.center_error_px.median() < 1 and m.center_error_m.max() < 1 and m.heading_error_deg.max() < 0.5 and m.scale_error_pct.abs().max() < 1


def test_refusals_are_rows_without_geometry(spark):
    pairs, corr = loc.sample_grid(spark)
    pairs = pairs.withColumn("sigma_m", F.when(F.col("frame_id") == 1, 0.0001).otherwise(F.col("sigma_m"))).withColumn("altitude_m", F.when(F.col("frame_id") == 2, 2000.0).otherwise(F.col("altitude_m")))
    pairs = pairs.withColumn("prior_lon", F.when(F.col("frame_id") == 1, F.col("prior_lon") + 0.01).otherwise(F.col("prior_lon")))
    corr = corr.filter("frame_id <> 0 or i < 2").filter("frame_id <> 3")
    r = {x.frame_id: x for x in loc.against_reference(pairs, corr, width=1024, height=1024, window_px=1280, focal_px=3000.0).collect()}
    assert len(r) == 30
    assert [r[i].reason for i in range(4)] == ["few correspondences", "outside prior", "scale out of bounds", "few correspondences"]
    for x in r.values():
        assert (x.status == "not_localized") == (x.lat is None) == (x.ring is None) == (x.confidence is None)


def test_localize_picks_the_right_cell(spark):
    from skyanchor.plans.more_queries import localize_pipeline

    r = localize_pipeline(spark, "/root/testdata/sf0.001").collect()
    assert len({x.frame_id for x in r}) == len(r)
    found = [x for x in r if x.status != "not_localized"]
    assert found and all(x.cell_id == x.frame_id for x in found) and all(x.reason for x in r if x.status == "not_localized") and {x.z_fine for x in found} == {18, 19}


CAMERA = {"width": 1000, "height": 800, "focal_px": 3000.0}


def flight(spark, altitude, yaw=40.0, lat=54.7, lon=55.9):
    c = spark.createDataFrame([(7, 1, lat, lon + 0.0003, 10.0, 600.0, 150.0, 19, None, None)], "frame_id bigint, cell_id bigint, lat double, lon double, coarse_mpp double, altitude_m double, altitude_sigma_m double, z_fine int, expected_deg double, prerotation_deg double")
    truth = spark.createDataFrame([(7, lat, lon, float(altitude), float(yaw))], "frame_id bigint, true_lat double, true_lon double, true_altitude_m double, true_yaw_deg double")
    return c, truth


def test_the_scale_loop_tries_another_zoom_only_once(spark):
    for altitude, zoom, tried in ((600, 19, 0), (1000, 18, 1), (420, 19, 0)):
        c, truth = flight(spark, altitude)
        r = loc.fine_with_scale_loop(c, loc.exact_matcher(truth, **CAMERA), **CAMERA).first()
        assert (r.status, r.z_fine, r.scale_iters_done) == ("localized", zoom, tried), altitude
        assert (r.lat, r.lon, r.altitude_m, r.heading_deg) == pytest.approx((54.7, 55.9, altitude, 40.0), abs=1e-5)
    c, truth = flight(spark, 1000)
    assert loc.fine_with_scale_loop(c, loc.exact_matcher(truth, **CAMERA), scale_iters=0, **CAMERA).first().z_fine == 19
    # a pass at the new zoom that gains no inliers doesn't count
    exact = loc.exact_matcher(truth, **CAMERA)
    poor = lambda w: exact(w).join(w.select("frame_id", "cell_id", "z_fine"), ["frame_id", "cell_id"]).filter("z_fine = 19 or i < 12").drop("z_fine")
    r = loc.fine_with_scale_loop(c, poor, **CAMERA).first()
    assert (r.z_fine, r.scale_iters_done, r.zooms) == (19, 1, [19, 18])


def test_a_trusted_heading_gates_the_transform(spark):
    c, truth = flight(spark, 600, yaw=40.0)
    for expected, status in ((40.0, "localized"), (52.0, "localized"), (70.0, "not_localized"), (None, "localized")):
        r = loc.fine_pass(c.withColumn("expected_deg", F.lit(expected).cast("double")), loc.exact_matcher(truth, **CAMERA), **CAMERA).first()
        assert r.status == status and (status == "localized" or (r.reason, r.lat) == ("turned otherwise than expected", None))


def test_the_measure_is_part_of_the_gate(spark):
    pairs, corr = loc.sample_grid(spark, yaws=(0,), ratios=(1.0,))
    for measure, kind, status in ((0.5, "ncc", "localized"), (0.1, "ncc", "low_confidence"), (0.3, "dino", "low_confidence"), (None, "dino", "localized")):
        r = loc.against_reference(pairs.withColumn("measure", F.lit(measure).cast("double")), corr, width=1024, height=1024, window_px=1280, focal_px=3000.0, measure_kind=kind).collect()
        assert {x.status for x in r} == {status}


def test_a_map_that_looks_alike_everywhere_is_refused(spark):
    e = [1.0, 0.0]
    cells = spark.createDataFrame([(i, 55.0 + i * 0.005, 37.0, 18, 350, 0.0, e) for i in range(5)], "cell_id bigint, lat double, lon double, zoom int, size_px int, rotation_deg double, embedding array<float>")
    f = spark.createDataFrame([(1, e, 55.0, 37.0, 500.0), (2, e, 10.0, 10.0, 500.0), (3, None, 55.0, 37.0, 500.0)], "frame_id bigint, embedding array<float>, prior_lat double, prior_lon double, sigma_m double")
    found, none = loc.retrieval_candidates(f, cells, min_uniqueness=0.05)
    assert found.count() == 0 and {r.frame_id: r.reason for r in none.collect()} == {1: "not unique", 2: "all cells outside prior", 3: "no candidates"}
    assert {r.frame_id: r.uniqueness for r in retrieval.uniqueness_within(f, cells, 500.0).collect()} == {1: 0.0}
    assert {r.frame_id: r.uniqueness for r in retrieval.uniqueness_within(f, cells, 1200.0).collect()} == {1: 1.0}
    found, none = loc.retrieval_candidates(f, cells)
    assert {r.frame_id for r in found.collect()} == {1} and {r.frame_id: r.reason for r in none.collect()} == {2: "all cells outside prior", 3: "no candidates"}


def test_prerotation_and_resizing(spark):
    df = spark.createDataFrame([(True, 30.0, 90.0), (False, None, 90.0), (None, None, 0.0)], "t boolean, y double, c double")
    assert [r[0] for r in df.select(loc.prerotation(trust_yaw="t", yaw_deg="y", cell_rotation_deg="c")).collect()] == [-30.0, -90.0, 0.0]
    assert [r[0] for r in df.select(loc.prerotation(trust_yaw="t", yaw_deg="y", cell_rotation_deg="c", wanted=False)).collect()] == [0.0] * 3
    s = spark.range(1).select(*(c.alias(n) for n, c in loc.resized(width=4000, height=3000, max_side=1000).items())).first()
    assert tuple(s) == (0.25, 1000, 750, 1000, 752)
    p = spark.createDataFrame([(0, 9.5, 4.5, 0.0, 0.0, 0.5, 20, 10), (0, 25.0, 0.0, 0.0, 0.0, 0.5, 20, 10)], "i int, qx double, qy double, rx double, ry double, factor double, width int, height int")
    r = loc.restored(p).collect()
    assert len(r) == 1 and (r[0].qx, r[0].qy, r[0].rx) == (19.5, 9.5, 0.5)


def test_tile_store_never_overwrites(spark):
    path = shared.shared_folder(spark, "tiles")
    t = spark.createDataFrame([("p", 3, 1, 1, 2, b"ab"), ("p", 3, 1, 2, 0, b""), ("p", 3, 1, 3, None, None)], tiles.TILE_SCHEMA)
    tiles.write_store(t, path)
    tiles.write_store(spark.createDataFrame([("p", 3, 1, 1, 2, b"zz"), ("p", 4, 9, 9, 1, b"x")], tiles.TILE_SCHEMA), path)
    assert sorted((r.zoom, bytes(r.bytes)) for r in tiles.read_store(spark, path).collect()) == [(3, b"ab"), (4, b"x")]


def test_load_refetches_what_does_not_decode(spark):
    want = spark.createDataFrame([("p", 3, i, 0) for i in range(4)], "provider string, zoom int, tx bigint, ty bigint")
    have = spark.createDataFrame([("p", 3, 0, 0, 2, b"ok"), ("p", 3, 1, 0, 3, b"bad")], tiles.TILE_SCHEMA)

    def fetch(provider, zoom, x, y):
        if x == 3:
            raise OSError("no network")
        return b"ok!"

    got = {r.tx: (r.state, r.length) for r in tiles.load_tiles(want, have, fetch, lambda b: b.startswith(b"ok"), 2).collect()}
    assert got == {0: ("cached", 2), 1: ("refetched", 3), 2: ("fetched", 3), 3: ("missing", None)}


def test_cache_files_and_providers(spark, tmp_path):
    (tmp_path / "demo" / "3" / "5").mkdir(parents=True)
    (tmp_path / "demo" / "3" / "5" / "6.jpg").write_bytes(b"tile")
    (tmp_path / "demo" / "3" / "5" / "7.jpg").write_bytes(b"")
    c = tiles.read_cache(spark, str(tmp_path))
    assert [tuple(r)[:5] for r in c.collect()] == [("demo", 3, 5, 6, 4)]
    assert tiles.with_provider(c, tiles.providers(spark)).first().max_zoom == 19
    with pytest.raises(Exception, match="unknown provider"):
        tiles.with_provider(c.withColumn("provider", F.lit("odd")), tiles.providers(spark)).collect()


def test_scene_source(spark):
    s = tiles.scene(spark, 64, 2)
    assert s.count() == 4096 and s.filter("y = 3 and x = 5").first().v == (35 + 39 + 15 % 11 + 62) % 256
    assert tiles.scene_at(s, 18, 17).count() == 1024
    with pytest.raises(ValueError):
        tiles.scene_at(s, 18, 19)
    n = tiles.normalise(s.withColumn("image_id", F.lit(1))).agg(F.min("v"), F.max("v")).first()
    assert tuple(n) == (0, 255)


def test_images_decode_in_the_jvm(spark, tmp_path):
    image = spark._jvm.java.awt.image.BufferedImage(2, 3, 1)
    image.setRGB(1, 2, 0x102030)
    spark._jvm.javax.imageio.ImageIO.write(image, "png", spark._jvm.java.io.File(str(tmp_path / "a.png")))
    (tmp_path / "b.png").write_bytes(b"junk")
    r = tiles.decode_images(spark, str(tmp_path)).collect()
    assert len(r) == 1 and (r[0].height, r[0].width) == (3, 2) and list(r[0].pixels[-3:]) == [0x30, 0x20, 0x10]


MANIFEST = """
cases:
  - {name: a, path: a.jpg, gsd_m: 0.1, truth: "55.5, 37.5", regime: summer}
  - {name: b, path: b.jpg, exclude: blurred}
  - {name: c, path: c.jpg, gsd_m: 0.2, prior: {lat: 1, lon: 2, sigma_m: 300}}
  - {name: d, path: d.jpg, truth: "1, 2"}
  - nonsense
"""


def test_manifest(spark):
    good, out = manifest.load_manifest(spark, MANIFEST)
    a, c = good.orderBy("name").collect()
    assert (a.truth_lat, a.prior_lat, a.sigma_m, a.truth_source, a.trust_yaw) == (55.5, 55.5, 2000, "manual", False) and (c.truth_lat, c.sigma_m, c.altitude_m) == (None, 300, 500)
    assert {r.name for r in out.collect()} == {"b", "d", "#4"}
    files = spark.createDataFrame([("a.jpg",)], "path string")
    assert {r.name: r.found for r in manifest.present(good, files).collect()} == {"a": True, "c": False}
    assert manifest.exif_index(good).filter("name = 'a'").first().command == "locate a.jpg --lat 55.50000 --lon 37.50000 --sigma-m 2000 --gsd 0.1000"
    empty = manifest.load_manifest(spark, "")
    assert empty[0].count() == empty[1].count() == 0


def test_golden_round_trip(spark):
    text = "config: {matcher: x, top_k: 15, note: null}\ncases:\n  a: {outcome: accepted_correct, error_m: 4.5, n_inliers: 30}\n  b: {outcome: refused}\n"
    g, c = manifest.load_golden(spark, text)
    again = manifest.load_golden(spark, manifest.save_golden(g, c))
    assert sorted(map(tuple, g.collect())) == sorted(map(tuple, again[0].collect())) and c.exceptAll(again[1]).count() == 0


def test_empty_cells_of_eval_rows_are_null(spark, tmp_path):
    names = [c.split()[0] for c in manifest.EVAL.split(", ")]
    row = {"case": "a", "accepted": 1, "error_m": 2.5, "n_inliers": 30, "reason": None}
    df = spark.createDataFrame([tuple(row.get(n) for n in names)], manifest.EVAL)
    manifest.write_eval(df, str(tmp_path / "e"), {"top_k": 15})
    got = manifest.read_eval(spark, str(tmp_path / "e")).first()
    assert (got["case"], got.accepted, got.error_m, got.true_cell_rank, got.reason, got.correct) == ("a", 1, 2.5, None, None, None)
    assert [tuple(r) for r in manifest.read_config(spark, str(tmp_path / "e")).collect()] == [("top_k", "15")]


def test_index_is_built_once_and_pruned(spark):
    root = shared.shared_folder(spark, "index")
    made = []

    def build():
        made.append(1)
        return spark.range(400).select(F.col("id").alias("cell_id"), (50 + F.col("id") / 1000).alias("lat"), F.lit(10.0).alias("lon"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding"))

    for there in (False, True):
        df, was = index.build_or_load(spark, root, "k1", build)
        assert was == there and df.count() == 400
    assert len(made) == 1 and index.near(spark, f"{root}/k1", 50.2, 10.0, 1500.0).count() in (26, 27)
    assert index.load(spark, f"{root}/k1", 2).count() == 400
    with pytest.raises(Exception, match="dimensions"):
        index.load(spark, f"{root}/k1", 3).agg(F.max("embedding")).collect()


def test_plugins(spark):
    with pytest.raises(plugins.MissingKernel):
        plugins.get("matcher", "loftr")
    with pytest.raises(KeyError):
        plugins.get("matcher", "nope")
    assert plugins.is_dense("roma") and not plugins.is_dense("sift")
    plugins.register("matcher", "toy", lambda: lambda q, r: [(len(q), 0, len(r), 0, 1)] * 2)
    plugins.register("encoder", "toy", lambda: lambda images: [[3.0, 4.0] if x else [0.0, 0.0] for x in images])
    p = spark.createDataFrame([(7, b"ab", b"abc"), (8, None, b"x")], "frame_id bigint, query binary, reference binary")
    assert [tuple(r) for r in plugins.match(p, "toy").collect()] == [(7, 0, 2.0, 0.0, 3.0, 0.0, 1.0), (7, 1, 2.0, 0.0, 3.0, 0.0, 1.0)]
    e = plugins.encode(spark.createDataFrame([(1, b"x"), (2, b"")], "id bigint, image binary"), "toy").orderBy("id").collect()
    assert np.allclose(e[0].embedding, [0.6, 0.8]) and e[1].embedding == [0, 0]


def test_weights(spark):
    m = spark.createDataFrame([("m", "a", "[1]"), ("m", "b", "[2]")], "model string, name string, shape string")
    r = weights.coverage(m, spark.createDataFrame([("x.a", "[1]"), ("x.b", "[3]")], "name string, shape string"), {"^x\\.": ""}).first()
    assert (r.tensors, r.loaded, r.coverage, r.ok) == (2, 1, 0.5, False)


def test_resized_and_turned_points(spark):
    df = spark.createDataFrame([(0, 0, 20.0, 10.0, 0.0, 0.0)], "frame_id int, i int, qx double, qy double, rx double, ry double")
    r = loc.match_points(df, shared_scale=2.0).first()
    assert (r.qx, r.qy) == (10, 5)
    t = loc.match_points(df, turn_deg=90.0, cx=10.0, cy=10.0).first()
    assert (t.qx, t.qy) == pytest.approx((10, 0))


def test_altitude_rules(spark):
    n = F.lit(None).cast("double")
    h = lambda *a: spark.range(1).select(metadata.altitude_above_ground(relative_m=a[0], override_m=a[1], absolute_m=a[2], ground_m=a[3])).first()[0]
    assert h(F.lit(50.0), F.lit(60.0), n, n) == 50 and h(n, F.lit(60.0), n, n) == 60 and h(n, n, F.lit(200.0), F.lit(150.0)) == 50 and h(n, n, F.lit(100.0), F.lit(150.0)) is None


def test_elevation(spark):
    d = spark.createDataFrame([(5000, 1000, 120.0)], "gy bigint, gx bigint, ground_m double")
    p = spark.createDataFrame([(50.005, 10.005), (60.0, 10.0)], "lat double, lon double")
    assert {r.lat: r.ground_m for r in tiles.elevation(p, d).collect()} == {50.005: 120.0, 60.0: None}


def test_evidence_of_nothing(spark):
    r = request.evidence(spark.createDataFrame([(1, None)], "p int, conf double"), "p").first()
    assert r.n_matches == 0 and math.isnan(r.conf_p10) and math.isnan(r.conf_max) and r.conf_frac_gt010 == 0


def test_cells_match_the_exact_count(spark):
    df = spark.createDataFrame([(1, 10.0, 50.0, 16, 1000, 350, 0.5, [0.0, 45.0])], "region_id bigint, center_lon double, center_lat double, zoom int, region_px int, cell_px int, overlap double, rotations array<double>")
    n = len(np.arange(175, 1000 - 175 + 1e-6, round(350 * 0.5)))
    assert imagery.generate_cells(df).count() == n * n * 2


def test_prior_gate_is_a_constraint(spark):
    df = spark.createDataFrame([(50.0, 10.0, 100.0, 50.002, 10.0), (50.0, 10.0, 100.0, 50.004, 10.0)], "prior_lat double, prior_lon double, sigma_m double, lat double, lon double")
    assert [r[0] for r in df.select(retrieval.within_prior(df)).collect()] == [True, False]


# network, kernels, pictures


def test_http_tries_again(monkeypatch):
    import urllib.error

    tries = []

    class Answer:
        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

        def read(self):
            return b"ok"

    def opened(request, timeout):
        tries.append(request.full_url)
        if len(tries) < 3:
            raise urllib.error.URLError("reset")
        return Answer()

    monkeypatch.setattr(tiles.urllib.request, "urlopen", opened)
    monkeypatch.setattr(tiles.time, "sleep", tries.append)
    assert tiles.fetch_from({"p": "http://x/{z}/{y}/{x}"})("p", 3, 5, 6) == b"ok"
    assert tries == ["http://x/3/6/5", 0.5, "http://x/3/6/5"] or tries == ["http://x/3/6/5", 0.5, "http://x/3/6/5", 1.0, "http://x/3/6/5"]
    tries.clear()
    with pytest.raises(urllib.error.URLError):
        tiles.http_get("http://x", retries=0)


def test_prefetch_adds_what_is_missing(spark):
    path = shared.shared_folder(spark, "prefetch")
    want = spark.createDataFrame([("p", 3, i, 0) for i in range(6)] * 2, "provider string, zoom int, tx bigint, ty bigint")

    def fetch(provider, zoom, x, y):
        if x == 5:
            raise OSError("no network")
        return b"" if x == 4 else b"tile%d" % x

    assert tiles.prefetch(want.filter("tx < 2"), path, fetch, 2) == 2
    assert tiles.prefetch(want, path, fetch, 2) == 2
    assert sorted(bytes(r.bytes) for r in tiles.read_store(spark, path).collect()) == [b"tile0", b"tile1", b"tile2", b"tile3"]


def test_tiles_of_another_size_are_refused(spark, tmp_path):
    image = spark._jvm.java.awt.image.BufferedImage(2, 3, 1)
    spark._jvm.javax.imageio.ImageIO.write(image, "png", spark._jvm.java.io.File(str(tmp_path / "a.png")))
    with pytest.raises(Exception, match="not a tile of 256"):
        tiles.decode_images(spark, str(tmp_path), side=256).collect()


def scene_pair(seed=0, turn=0.5, scale=1.1):
    from skyanchor.functions import raster
    from skyanchor.operators import pose

    rng = np.random.default_rng(seed)
    ref = raster.stretched(sum(raster.gaussian(rng.normal(size=(240, 260)), s) * s for s in (1.5, 3, 6)))
    a, b, tx, ty = scale * np.cos(turn), scale * np.sin(turn), 110.0, 40.0
    y, x = np.mgrid[0:110, 0:120].astype(float)
    q = pose._sample(ref.astype(float), a * x - b * y + tx, b * x + a * y + ty)[0]
    return np.clip(q * 0.8 + 20, 0, 255).astype(np.uint8), ref, (float(a), float(b), tx, ty)


RASTERS = "frame_id bigint, a double, b double, tx double, ty double, height int, width int, query binary, ref_height int, ref_width int, reference binary"


def raster_rows(spark, extra=()):
    q, ref, t = scene_pair()
    return spark.createDataFrame([(0, *t, *q.shape, bytearray(q), *ref.shape, bytearray(ref)), *extra], RASTERS), q, ref, t


def test_features_place_a_turned_frame(spark):
    from skyanchor.operators import pose

    df, q, ref, (a, b, tx, ty) = raster_rows(spark, [(1, 1.0, 0.0, 0.0, 0.0, 110, 120, None, 240, 260, None), (2, 1.0, 0.0, 0.0, 0.0, 110, 120, bytearray(110 * 120), 240, 260, bytearray(240 * 260))])
    for side in (None, 200):
        m = plugins.match_rasters(df, "sift", side)
        r = pose.ransac(m).collect()
        assert [x.frame_id for x in r] == [0] and r[0].n_inliers >= 12 and r[0].n_inliers > 0.5 * r[0].n_points
        x, y = (r[0].a * 60 - r[0].b * 55 + r[0].tx, r[0].b * 60 + r[0].a * 55 + r[0].ty)
        assert math.hypot(x - (a * 60 - b * 55 + tx), y - (b * 60 + a * 55 + ty)) < 1.0
    with pytest.raises(KeyError):
        plugins.match_rasters(df, "nope")


def test_each_row_has_its_own_measure(spark):
    from skyanchor.operators import signals

    df, q, ref, t = raster_rows(spark)
    kinds = ("ncc", "nmi", "grad_ncc", "cfog", "ngf", "edge_dice")
    rows = df.withColumn("kind", F.explode(F.array(*(F.lit(k) for k in kinds))))
    right = {r.kind: r.measure for r in signals.aligned(rows).collect()}
    wrong = {r.kind: r.measure for r in signals.aligned(rows.withColumn("tx", F.col("tx") - 25)).collect()}
    assert set(right) == set(kinds) and all(right[k] > wrong[k] + 0.05 for k in kinds if k != "edge_dice") and right["ncc"] > 0.99 and right["edge_dice"] > 0.9
    assert signals.aligned(rows.withColumn("tx", F.lit(5000.0)).filter("kind = 'ncc'")).first().measure == -1
    assert signals.aligned(rows.withColumn("query", F.lit(None).cast("binary"))).filter("measure is not null").count() == 0
    with pytest.raises(Exception, match="no measure 'odd'"):
        signals.aligned(rows.withColumn("kind", F.lit("odd"))).collect()
    plugins.register("dense", "dino", lambda: lambda z: z.reshape(-1, 10)[:20] + 1.0)
    assert signals.aligned(rows.limit(1).withColumn("kind", F.lit("dino"))).first().measure > 0.9


def test_measures_at_their_floors():
    from skyanchor.operators import signals

    rng = np.random.default_rng(0)
    a, b = rng.uniform(0, 255, (2, 96, 96))
    assert abs(signals.plain_ncc(a, b)) < 0.05 and abs(signals.ngf(a, b) - 0.5) < 0.05 and abs(signals.cfog(a, b)) < 0.15 and 1 <= signals.plain_nmi(a, b) < 1.2
    assert signals.cfog(a * 0, b * 0) == 0 and signals.ngf(a * 0, b) == 0.5 and signals.edge_dice(a * 0, b * 0) == 0
    flip = 255 - a
    assert signals.plain_ncc(a, flip) == pytest.approx(-1) and signals.cfog(a, flip) == pytest.approx(1) and signals.ngf(a, flip) == pytest.approx(1) and signals.edge_dice(a, flip) > 0.95


def test_edges_of_a_square():
    from skyanchor.functions import raster

    z = np.zeros((40, 40), np.uint8)
    z[10:30, 12:28] = 200
    e = raster.canny(z)
    assert 60 <= e.sum() <= 90 and not e[15:25, 16:24].any() and not e[:7].any() and e[9:11, 15:25].any(axis=0).all()
    assert not raster.canny(np.full((20, 20), 77, np.uint8)).any()
    faint = z // 10
    assert not raster.canny(faint).any()


def test_rasters_evened_cropped_and_perturbed(spark):
    from skyanchor.functions import raster

    y, x = np.mgrid[0:64, 0:80]
    dark = (x / 80 * 40 + (x + y) % 7).astype(np.uint8)
    e = raster.clahe(dark)
    assert e.shape == dark.shape and e.std() > 1.2 * dark.std() and raster.clahe(np.full((16, 16), 9, np.uint8)).std() == 0
    df = spark.createDataFrame([(1, 64, 80, bytearray(dark), 30.0)], "image_id bigint, height int, width int, pixels binary, yaw_deg double")
    assert bytes(imagery.equalised(df.drop("yaw_deg")).first().pixels) == e.tobytes()
    n = imagery.north_up(df).first()
    assert n.side == 44 == df.select(imagery.north_up_side("width", "height")).first()[0] and len(n.pixels) == 44 * 44
    flat = imagery.north_up(df.withColumn("yaw_deg", F.lit(0.0))).first()
    assert (np.frombuffer(flat.pixels, np.uint8).reshape(44, 44) == dark[10:54, 18:62]).all()
    z = scene_pair()[0]
    rows = [(k, *z.shape, bytearray(z), level, s, 11) for k, (level, s) in enumerate((lv, s) for lv in range(5) for s in (0.0, 0.5, 1.0))]
    p = spark.createDataFrame(rows, "image_id bigint, height int, width int, pixels binary, level int, strength double, seed bigint")
    off = {}
    for r in imagery.perturbed(p).collect():
        off[r.level, r.strength] = np.abs(np.frombuffer(r.pixels, np.uint8).astype(int) - z.reshape(-1)).mean()
    assert all(v == 0 for (level, s), v in off.items() if level == 0 or s == 0) and all(0 < off[level, 0.5] for level in (1, 2, 3, 4)) and all(off[k, 0.5] < off[k, 1.0] for k in (2, 3))
    with pytest.raises(ValueError):
        raster.appearance(z, 5, 1.0, 0)
    assert np.abs(raster.jpeg_loss(z, 95).astype(int) - z).mean() < np.abs(raster.jpeg_loss(z, 12).astype(int) - z).mean() < 30
    seeds = spark.createDataFrame([(10.0, 1.0, 20.0, 2, 0.5)], "y double, r double, o double, l int, s double")
    assert seeds.select(imagery.appearance_seed(yaw_deg="y", altitude_ratio="r", prior_offset_m="o", level="l", strength="s")).first()[0] == int(10000 + 733 + 260 + 15838 + 65.5)
    assert np.allclose(raster.area_resize(np.arange(16.0).reshape(4, 4), 2, 2), [[2.5, 4.5], [10.5, 12.5]])


def test_overlay_is_a_picture(spark, tmp_path):
    from skyanchor.operators import report

    df, q, ref, t = raster_rows(spark, [(1, None, None, None, None, 2, 2, bytearray(4), 2, 2, bytearray(4))])
    m = spark.createDataFrame([(0, 5.0, 6.0, 120.0, 50.0)] * 3, "frame_id bigint, qx double, qy double, rx double, ry double")
    got = {r.frame_id: r.png for r in report.overlays(df, m).collect()}
    assert got[1] is None
    (tmp_path / "o.png").write_bytes(bytes(got[0]))
    r = tiles.decode_images(spark, str(tmp_path)).first()
    assert (r.height, r.width) == (240, 120 + 260 + 120 + (120 + 260) + 12)
    z = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, -1)[..., :3]
    assert (z[:110, :120, 0] == q).all() and (z == (64, 64, 255)).all(axis=2).any() and (z == (64, 255, 64)).all(axis=2).any()
    assert report.overlays(df).count() == 2


def test_weights_are_loaded_only_if_they_fit(spark, tmp_path):
    import json

    head = {"__metadata__": {"a": "b"}, "net.a": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}, "net.b": {"dtype": "F32", "shape": [4], "data_offsets": [24, 40]}}
    raw = json.dumps(head).encode()
    path = str(tmp_path / "w.safetensors")
    with open(path, "wb") as f:
        f.write(len(raw).to_bytes(8, "little") + raw + bytes(40))
    m = spark.createDataFrame([("m", "a", "[2, 3]"), ("m", "b", "[4]")], "model string, name string, shape string")
    got = weights.load_verified(m, path, {"^net\\.": ""}).orderBy("name").collect()
    assert [(r.name, r.begin, r.end) for r in got] == [("a", 0, 24), ("b", 24, 40)]
    with pytest.raises(ValueError, match="0 of 2"):
        weights.load_verified(m, path)
    (tmp_path / "bad").write_bytes(b"12345678xx")
    with pytest.raises(ValueError, match="not a safetensors"):
        weights.read_state(spark, str(tmp_path / "bad"))
    c = spark.createDataFrame([("k", "w.safetensors", "u", None), ("l", "x", "u", None)], weights.CATALOGUE)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path")
    assert {r.kernel: r.found for r in weights.located(c, str(tmp_path), files).collect()} == {"k": True, "l": False}


def test_environment(spark, tmp_path):
    from skyanchor.sources import environment

    got = {r.name: r.ok for r in environment.check(spark, 0.001, (str(tmp_path), "/no/such")).collect()}
    assert got["python"] and got["numpy"] and got["disk"] and got[f"folder {tmp_path}"] and not got["folder /no/such"]
    assert not environment._at_least("1.9.3", "1.26") and environment._at_least("2.0", "1.26")


def test_sweeps_number_every_combination(spark):
    s = loc.sweep(spark, a=[1, 2], b=["x", "y", "z"], c=[0.5]).collect()
    assert [(r.run, r.a, r.b, r.c) for r in sorted(s)] == [(k, 1 + k // 3, "xyz"[k % 3], 0.5) for k in range(6)]
    df = spark.createDataFrame([("p", True, 10.0), ("p", True, 90.0), ("p", False, None), ("q", False, None)], "k string, localized boolean, error_m double")
    got = {r.k: (r.n, r.localized, round(r.share, 3), r.median_error, r.correct) for r in loc.sweep_summary(df, ["k"]).collect()}
    assert got == {"p": (3, 2, 0.667, 50.0, 1), "q": (1, 0, 0.0, None, 0)}


def test_a_folder_that_executors_cannot_share_is_refused():
    class Fake:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_folder(Fake, "x")
