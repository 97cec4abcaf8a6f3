"""Closed-form fixtures of geodesy and cameras."""

import math

import pytest
from pyspark.sql import functions as F

from skyanchor.functions import camera, geo


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


EQUATOR_MPP = {20: 0.14929107086948487, 18: 0.5971642834779395, 10: 152.8740565703525, 1: 78271.51696402048, 0: 156543.03392804097}
CITY = {
    "Moscow": "55.7558 37.6173", "Petersburg": "59.9311 30.3609", "London": "51.5074 -0.1278", "Paris": "48.8566 2.3522",
    "New York": "40.7128 -74.0060", "Sydney": "-33.8688 151.2093", "Melbourne": "-37.8136 144.9631",
}
TRIPS = [("Sydney", "Melbourne", 713, 6), ("New York", "London", 5570, 30), ("London", "Paris", 343.5, 3), ("Moscow", "Petersburg", 634.0, 5)]


@pytest.mark.parametrize("zoom,mpp", EQUATOR_MPP.items())
def test_mpp(spark, zoom, mpp):
    assert one(spark, geo.ground_mpp(lat=0.0, zoom=zoom))[0] == pytest.approx(mpp, rel=1e-12)


@pytest.mark.parametrize("start,stop,km,tol", TRIPS)
def test_haversine(spark, start, stop, km, tol):
    a, b = ([float(v) for v in CITY[n].split()] for n in (start, stop))
    assert abs(one(spark, geo.haversine(lat1=a[0], lon1=a[1], lat2=b[0], lon2=b[1]))[0] / 1000 - km) < tol


def test_haversine_ends(spark):
    r = one(spark, geo.haversine(lat1=0.0, lon1=0.0, lat2=1.0, lon2=0.0), geo.haversine(lat1=0.0, lon1=0.0, lat2=90.0, lon2=0.0), geo.haversine(lat1=5.0, lon1=5.0, lat2=5.0, lon2=5.0))
    assert abs(r[0] - 111194.9) < 1 and r[1] == pytest.approx(geo.R_MEAN * math.pi / 2) and r[2] == 0


def test_wrap(spark):
    assert list(one(spark, *(geo.wrap_deg(float(x)) for x in (180, -180, 190, 540, -30.16)))) == pytest.approx([-180, -180, -170, -180, -30.16])


def test_rounding_is_half_even(spark):
    assert one(spark, camera.resampled(size=F.lit(40), gsd_m=F.lit(1.0), target_mpp=F.lit(16 / 10 * 1.0)))[0] == 25
    assert one(spark, camera.even_ceil(F.lit(7)), camera.even_ceil(F.lit(8)))[:] == (8, 8)


def test_pixels_round_trip(spark):
    g = geo.Georef(F.lit(37.6), F.lit(55.75), F.lit(17), F.lit(800), F.lit(600))
    px, py = g.to_pixel(lon=g.to_lonlat(12.25, 599.0)[0], lat=g.to_lonlat(12.25, 599.0)[1])
    lon, lat = g.to_lonlat(399.5, 299.5)
    r = one(spark, px, py, lon, lat)
    assert r[0] == pytest.approx(12.25, abs=1e-6) and r[1] == pytest.approx(599, abs=1e-6) and r[2] == pytest.approx(37.6) and r[3] == pytest.approx(55.75)


@pytest.mark.parametrize("altitude,foot,gsd", [(600, 205, 0.20), (250, 85, 0.083), (150, 51, 0.05), (100, 34, 0.033)])
def test_camera_table(spark, altitude, foot, gsd):
    c = camera.Camera(F.lit(1024), F.lit(768), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(math.degrees(2 * math.atan(512 / 3000))))
    r = one(spark, c.footprint(float(altitude))[0], c.gsd(float(altitude)), c.focal_px)
    assert abs(r[0] - foot) < 0.5 and abs(r[1] - gsd) < 1e-3 and r[2] == pytest.approx(3000)


def test_tilt(spark):
    c = camera.Camera(F.lit(1000), F.lit(800), F.lit(30.0), F.lit(10.0), F.lit(None).cast("double"))
    flat = one(spark, *c.tilt_homography(0.0, 0.0))
    assert list(flat) == pytest.approx([1, 0, 0, 0, 1, 0, 0, 0, 1], abs=1e-9)
    for pitch, roll in ((5.0, 0.0), (0.0, 7.0)):
        h = one(spark, *c.tilt_homography(pitch, roll))
        w = h[6] * 499.5 + h[7] * 399.5 + h[8]
        x, y = (h[0] * 499.5 + h[1] * 399.5 + h[2]) / w, (h[3] * 499.5 + h[4] * 399.5 + h[5]) / w
        assert x == pytest.approx(499.5 + 3000 * math.tan(math.radians(roll))) and y == pytest.approx(399.5 - 3000 * math.tan(math.radians(pitch)))


def test_envelope(spark):
    assert list(one(spark, *(camera.recommended_sigma(float(h)) for h in (900, 600, 450, 300, 200, 100, 50)))) == [5000, 5000, 3500, 2000, 1250, 500, 500]


def test_human_time(spark):
    assert list(one(spark, *(camera.human_time(float(s)) for s in (12, 240, 4800, 6000)))) == ["12 s", "4 min", "80 min", "1 h 40 min"]


def test_null_inputs_give_null(spark):
    n = F.lit(None).cast("double")
    assert one(spark, geo.ground_mpp(lat=n, zoom=F.lit(3)), geo.exact_zoom(mpp=F.lit(-1.0), lat=F.lit(0.0)), camera.recommended_sigma(n))[:] == (None, None, None)


def test_zoom_of_no_resolution(spark):
    df = spark.createDataFrame([(0.5,), (0.0,), (-1.0,), (None,)], "m double")
    assert [r[0] is None for r in df.select(geo.exact_zoom(mpp="m", lat=F.lit(50.0))).collect()] == [False, True, True, True]
    assert df.limit(1).select(geo.exact_zoom(mpp="m", lat=F.lit(50.0), strict=True)).first()[0] > 0
    with pytest.raises(Exception, match="must be positive"):
        df.select(geo.exact_zoom(mpp="m", lat=F.lit(50.0), strict=True)).collect()
