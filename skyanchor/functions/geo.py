"""Web-Mercator geometry, distances and angles as column expressions.

Two radii on purpose: the projection's 6378137 m and the mean 6371008.8 m for
distances.  Local pixel (0, 0) is the centre of the top-left pixel, while world
pixels count from corners, so that the half pixel appears in `to_world` and
`from_world` alone.  Rounding is half to even throughout.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

R_PROJECTION = 6378137.0
R_MEAN = 6371008.8
TILE = 256
MAX_LAT = math.degrees(2 * math.atan(math.exp(math.pi)) - math.pi / 2)
METRES_PER_DEGREE = 111_320.0
MAX_ZOOM = 19


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if isinstance(x, (int, float)) else F.col(x)


def world_size(zoom) -> Column:
    return F.lit(float(TILE)) * F.pow(F.lit(2.0), _c(zoom))


def world_px(*, lon, lat, zoom) -> tuple[Column, Column]:
    n = world_size(zoom)
    s = F.sin(F.radians(F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), _c(lat)))))
    return (_c(lon) + 180) / 360 * n, (F.lit(0.5) - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * n


def lonlat(*, x, y, zoom) -> tuple[Column, Column]:
    n = world_size(zoom)
    return _c(x) / n * 360 - 180, F.degrees(F.asin(F.tanh((F.lit(0.5) - _c(y) / n) * (2 * math.pi))))


def ground_mpp(*, lat, zoom) -> Column:
    """Metres a pixel at a latitude."""
    return F.lit(2 * math.pi * R_PROJECTION / TILE) * F.cos(F.radians(_c(lat))) / F.pow(F.lit(2.0), _c(zoom))


def exact_zoom(*, mpp, lat, strict: bool = False) -> Column:
    """The real zoom of so many metres a pixel; null, or with strict an error, where mpp isn't positive."""
    m = _c(mpp)
    if strict:
        m = F.when(m > 0, m).otherwise(F.raise_error(F.concat(F.lit("metres a pixel must be positive: "), F.coalesce(m.cast("string"), F.lit("null")))).cast("double"))
    return F.when(m > 0, F.log2(F.lit(2 * math.pi * R_PROJECTION / TILE) * F.cos(F.radians(_c(lat))) / m))


def zoom_for(*, mpp, lat, mode: str = "nearest", max_zoom: int = MAX_ZOOM) -> Column:
    """A whole zoom from 0 to max_zoom; 'finer' has at most mpp, 'coarser' at least."""
    z = exact_zoom(mpp=mpp, lat=lat)
    whole = {"nearest": F.bround(z), "finer": F.ceil(z - 1e-6), "coarser": F.floor(z + 1e-6)}[mode]
    return F.greatest(F.lit(0), F.least(F.lit(max_zoom), whole.cast("int")))


def haversine(*, lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres."""
    a, b, c, d = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return F.lit(2 * R_MEAN) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def wrap_deg(x) -> Column:
    """To [-180, 180)."""
    return F.pmod(_c(x) + 180, F.lit(360.0)) - 180


def offset(*, lat, lon, distance_m, bearing_deg) -> tuple[Column, Column]:
    """Latitude and longitude after a flat-earth step."""
    b, d, la = F.radians(_c(bearing_deg)), _c(distance_m), _c(lat)
    return la + d * F.cos(b) / METRES_PER_DEGREE, _c(lon) + d * F.sin(b) / (F.lit(METRES_PER_DEGREE) * F.cos(F.radians(la)))


def offset_prior(*, lat, lon, sigma_m, index, fraction: float = 0.5) -> tuple[Column, Column]:
    """A truth moved by a fraction of sigma north, east, south or west in turn, to five places."""
    la, d, i = _c(lat), _c(sigma_m) * fraction, F.pmod(_c(index), F.lit(4)).cast("int") + 1
    north, east = (F.element_at(F.array(*(F.lit(v) for v in s)), i) for s in ((1, 0, -1, 0), (0, 1, 0, -1)))
    dlon = d / (F.lit(METRES_PER_DEGREE) * F.greatest(F.cos(F.radians(la)), F.lit(0.01)))
    return F.bround(la + north * d / METRES_PER_DEGREE, 5), F.bround(_c(lon) + east * dlon, 5)


def enu(*, lat0, lon0, lat, lon) -> tuple[Column, Column]:
    """Metres east and north of a reference, along its parallel and meridian."""
    east = haversine(lat1=lat0, lon1=lon0, lat2=lat0, lon2=lon) * F.signum(_c(lon) - _c(lon0))
    north = haversine(lat1=lat0, lon1=lon0, lat2=lat, lon2=lon0) * F.signum(_c(lat) - _c(lat0))
    return east, north


def dms_to_deg(*, degrees, minutes, seconds, ref) -> Column:
    """Degrees from sexagesimal parts; S and W are negative."""
    v = _c(degrees) + _c(minutes) / 60 + _c(seconds) / 3600
    return F.when(F.upper(_c(ref)).isin("S", "W"), -v).otherwise(v)


@dataclass(frozen=True)
class Georef:
    """A raster window of width x height about a centre, the only bridge of pixels and coordinates."""

    center_lon: Column
    center_lat: Column
    zoom: Column
    width: Column
    height: Column

    @property
    def origin(self) -> tuple[Column, Column]:
        x, y = world_px(lon=self.center_lon, lat=self.center_lat, zoom=self.zoom)
        return x - self.width / 2, y - self.height / 2

    @property
    def mpp(self) -> Column:
        return ground_mpp(lat=self.center_lat, zoom=self.zoom)

    def to_lonlat(self, px, py) -> tuple[Column, Column]:
        ox, oy = self.origin
        return lonlat(x=_c(px) + ox + 0.5, y=_c(py) + oy + 0.5, zoom=self.zoom)

    def to_pixel(self, *, lon, lat) -> tuple[Column, Column]:
        x, y = world_px(lon=lon, lat=lat, zoom=self.zoom)
        ox, oy = self.origin
        return x - ox - 0.5, y - oy - 0.5

    def bounds(self) -> tuple[Column, Column, Column, Column]:
        """West, south, east, north of the outer corners."""
        ox, oy = self.origin
        west, north = lonlat(x=ox, y=oy, zoom=self.zoom)
        east, south = lonlat(x=ox + self.width, y=oy + self.height, zoom=self.zoom)
        return west, south, east, north

    def contains_pixel(self, px, py) -> Column:
        return _c(px).between(-0.5, self.width - 0.5) & _c(py).between(-0.5, self.height - 0.5)

    def crop(self, x0, y0, width, height) -> Georef:
        """The window whose top-left pixel is (x0, y0)."""
        lon, lat = self.to_lonlat(_c(x0) + (_c(width) - 1) / 2, _c(y0) + (_c(height) - 1) / 2)
        return Georef(lon, lat, self.zoom, _c(width), _c(height))

    def crop_around(self, px, py, width, height) -> Georef:
        """The window of whole pixels that is centred nearest to (px, py)."""
        return self.crop(F.bround(_c(px) - (_c(width) - 1) / 2), F.bround(_c(py) - (_c(height) - 1) / 2), width, height)
