"""Nadir cameras, altitude priors and region plans as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _c, ground_mpp, zoom_for

#: (altitude_m, sigma_m): the position uncertainty up to which retrieval is trusted.
ENVELOPE = tuple(zip((100.0, 300.0, 600.0), (500.0, 2000.0, 5000.0)))
DENSE_INLIERS, SPARSE_INLIERS = 185, 8
MAX_WINDOW_PX = 4000
PCA_DIM = 1024


@dataclass(frozen=True)
class Camera:
    width: Column
    height: Column
    focal_mm: Column
    sensor_width_mm: Column
    fov_deg: Column

    @property
    def focal_px(self) -> Column:
        """The physical focal length where known, else that of the field of view."""
        return F.coalesce(self.focal_mm * self.width / self.sensor_width_mm, self.width / 2 / F.tan(F.radians(self.fov_deg) / 2))

    @property
    def hfov_deg(self) -> Column:
        return 2 * F.degrees(F.atan(self.width / (2 * self.focal_px)))

    @property
    def vfov_deg(self) -> Column:
        return 2 * F.degrees(F.atan(self.height / (2 * self.focal_px)))

    @property
    def principal_point(self) -> tuple[Column, Column]:
        return (self.width - 1) / 2, (self.height - 1) / 2

    def gsd(self, altitude_m) -> Column:
        return _c(altitude_m) / self.focal_px

    def footprint(self, altitude_m) -> tuple[Column, Column]:
        g = self.gsd(altitude_m)
        return g * self.width, g * self.height

    def altitude(self, gsd_m) -> Column:
        return _c(gsd_m) * self.focal_px

    def tilt_homography(self, pitch_deg, roll_deg) -> list[Column]:
        """Nine entries, by rows, of K Rx Ry K^-1 over its last."""
        f, (cx, cy) = self.focal_px, self.principal_point
        p, r = F.radians(_c(pitch_deg)), F.radians(_c(roll_deg))
        sp, cp, sr, cr = F.sin(p), F.cos(p), F.sin(r), F.cos(r)
        zero = F.lit(0.0)
        rot = [[cr, zero, sr], [sp * sr, cp, -sp * cr], [-cp * sr, sp, cp * cr]]
        # K R, then K R K^-1 with K^-1 = [[1/f, 0, -cx/f], [0, 1/f, -cy/f], [0, 0, 1]]
        kr = [[f * rot[0][j] + cx * rot[2][j] for j in range(3)], [f * rot[1][j] + cy * rot[2][j] for j in range(3)], rot[2]]
        h = [[a / f, b / f, c - (a * cx + b * cy) / f] for a, b, c in kr]
        return [x / h[2][2] for row in h for x in row]


def fov_from_gsd(*, width, gsd_m, altitude_m) -> Column:
    return 2 * F.degrees(F.atan(_c(width) / 2 / (_c(altitude_m) / _c(gsd_m))))


def resampled(*, size, gsd_m, target_mpp) -> Column:
    """Pixels of a side after resampling, 16 at least."""
    return F.greatest(F.lit(16), F.bround(_c(size) * (_c(gsd_m) / _c(target_mpp))).cast("int"))


def scale_bounds(*, altitude_m, altitude_sigma_m, gate: float = 3.0) -> tuple[Column, Column]:
    h, s = _c(altitude_m), _c(altitude_sigma_m) * gate
    return F.greatest(h - s, F.lit(1e-6)) / h, (h + s) / h


def recommended_sigma(altitude_m) -> Column:
    """Linear between the nodes of ENVELOPE and constant beyond them."""
    h = _c(altitude_m)
    out = F.when(h <= ENVELOPE[0][0], ENVELOPE[0][1])
    for (h0, s0), (h1, s1) in zip(ENVELOPE, ENVELOPE[1:]):
        out = out.when(h <= h1, F.lit(s0) + (h - h0) / (h1 - h0) * (s1 - s0))
    return out.when(h.isNotNull(), ENVELOPE[-1][1])


def is_nadir(pitch_deg, most: float = 10.0) -> Column:
    return F.coalesce(F.abs(_c(pitch_deg)) <= most, F.lit(True))


def hard_inliers(is_dense) -> Column:
    return F.when(_c(is_dense), DENSE_INLIERS).otherwise(SPARSE_INLIERS)


def fine_margin(*, coarse_mpp, footprint_m, mpp, max_window_px: int = MAX_WINDOW_PX) -> Column:
    fp = _c(footprint_m)
    asked = F.greatest(6 * _c(coarse_mpp), 0.15 * fp)
    return F.least(asked, F.greatest(F.lit(0.0), (max_window_px * _c(mpp) - fp) / 2))


def cell_overlap(*, footprint_m, mpp, max_window_px: int = MAX_WINDOW_PX) -> Column:
    """0.75 where the window binds, else what the margin asks, within 0.5 and 0.85."""
    fp = _c(footprint_m)
    asked = F.greatest(6 * (fp / 12), 0.15 * fp)
    room = F.greatest(F.lit(0.0), (max_window_px * _c(mpp) - fp) / 2)
    return F.when(asked > room, 0.75).otherwise(F.least(F.lit(0.85), F.greatest(F.lit(0.5), 1 - asked / (0.707 * fp) + 0.05)))


def region_radius(sigma_m, times: float = 1.5, least: float = 500.0, most: float = 5000.0) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), _c(sigma_m) * times))


def even_ceil(x) -> Column:
    return (F.ceil(_c(x) / 2) * 2).cast("int")


def plan_region(*, lat, lon, footprint_m, radius_m, fine_zoom, trust_yaw, cell_px: int = 350, rotation_step: int = 45, max_zoom: int = 19) -> dict[str, Column]:
    """Zoom, cell and region pixels, overlap, rotations and content-addressed key of a map region."""
    fp = _c(footprint_m)
    zoom = zoom_for(mpp=fp / cell_px, lat=lat, mode="coarser", max_zoom=max_zoom)
    mpp = ground_mpp(lat=lat, zoom=zoom)
    cell = F.greatest(F.lit(32), F.bround(fp / mpp).cast("int"))
    region = F.floor(2 * _c(radius_m) / mpp).cast("int")
    overlap = cell_overlap(footprint_m=fp, mpp=ground_mpp(lat=lat, zoom=fine_zoom))
    rotations = F.when(_c(trust_yaw), 1).otherwise(math.ceil(360 / rotation_step))
    key = F.format_string(
        "%.4f_%.4f_z%d_r%d_c%d_o%d_rot%d_pca%d", _c(lat), _c(lon), zoom, F.floor(_c(radius_m)).cast("int"), cell, F.floor(overlap * 100).cast("int"), rotations, F.lit(PCA_DIM)
    )
    return {"zoom": zoom, "mpp_index": mpp, "cell_px": cell, "region_px": region, "overlap": overlap, "n_rotations": rotations, "region_key": key}


def estimated_cells(*, region_px, cell_px, overlap, n_rotations) -> Column:
    """The planner's estimate, which is not the exact count of generated cells."""
    step = F.greatest(F.lit(1), F.bround(_c(cell_px) * (1 - _c(overlap))).cast("int"))
    across = F.greatest(F.lit(1), F.floor(_c(region_px) / step).cast("int"))
    return (across * across * _c(n_rotations)).cast("bigint")


def human_time(seconds) -> Column:
    s = _c(seconds)
    m = s / 60
    return (
        F.when(s < 90, F.concat(F.bround(s).cast("bigint").cast("string"), F.lit(" s")))
        .when(m < 90, F.concat(F.bround(m).cast("bigint").cast("string"), F.lit(" min")))
        .otherwise(F.concat(F.floor(m / 60).cast("string"), F.lit(" h "), F.floor(F.pmod(m, F.lit(60.0))).cast("string"), F.lit(" min")))
    )


def sigma_for_cells(*, sigma_m, cells, target: int = 500) -> Column:
    """The sigma that would leave about target cells."""
    return _c(sigma_m) * F.sqrt(F.lit(float(target)) / _c(cells))
