"""Requests and oracle alignments as column expressions: what wins where several sources tell the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geo import _c, haversine

ASSUMED_ALTITUDE_M = 500.0


def build_request(rows: DataFrame) -> DataFrame:
    """rows of inputs with gsd_m_used, gsd_source, altitude_used, prior_source, trust_yaw, notes and problems.

    Inputs: width, gsd_m, altitude_m, fov_deg, focal_mm, sensor_mm, lat, lon,
    sigma_m, yaw_deg, and of the metadata exif_gsd_m, exif_altitude_m, exif_lat,
    exif_lon, exif_yaw_deg, exif_pitch_deg, from_exif; any may be null.  A scale given
    outranks one from altitude and lens, which outranks the metadata's.  What is
    wrong is listed in problems, and such a row has no scale.
    """
    c = F.col
    focal = F.coalesce(c("focal_mm") * c("width") / c("sensor_mm"), c("width") / 2 / F.tan(F.radians(c("fov_deg")) / 2))
    lens = c("fov_deg").isNotNull() | c("focal_mm").isNotNull()
    given, from_lens, from_meta = c("gsd_m").isNotNull(), c("altitude_m").isNotNull() & lens, c("exif_gsd_m").isNotNull()
    source = F.when(given, "given").when(from_lens, "altitude and lens").when(from_meta, "metadata")
    gsd = F.when(given, c("gsd_m")).when(from_lens, c("altitude_m") / focal).when(from_meta, c("exif_gsd_m"))
    height = F.when(given, F.coalesce(c("altitude_m"), F.lit(ASSUMED_ALTITUDE_M))).otherwise(F.coalesce(c("altitude_m"), c("exif_altitude_m")))
    typed = c("lat").isNotNull() & c("lon").isNotNull()
    meta = F.coalesce(c("from_exif"), F.lit(False)) & c("exif_lat").isNotNull()
    prior = F.when(typed, "given").when(meta, "metadata, no independent check")
    yaw = F.coalesce(c("yaw_deg"), c("exif_yaw_deg"))
    notes = F.array_compact(
        F.array(
            F.when(given & c("altitude_m").isNull(), "altitude assumed"), F.when(given & lens, "scale outranks the lens"), F.when((source == "metadata") & (F.abs("exif_pitch_deg") > 10), "tilted"),
            F.when(typed & c("exif_lat").isNotNull() & ~F.coalesce(c("from_exif"), F.lit(False)), "metadata position not used"), F.when(~typed & meta, "prior from the frame itself"), F.when(yaw.isNull(), "heading unknown"),
        )
    )
    problems = F.array_compact(
        F.array(
            F.when(c("gsd_m") <= 0, "scale not positive"), F.when(~given & from_lens & focal.isNull(), "lens incomplete"), F.when(source.isNull(), "no scale"), F.when(prior.isNull(), "no prior"),
            F.when(c("sigma_m").isNull(), "no sigma"), F.when(c("sigma_m") <= 0, "sigma not positive"),
        )
    )
    out = rows.withColumns({"gsd_source": source, "altitude_used": height, "prior_source": prior, "trust_yaw": yaw.isNotNull(), "notes": notes, "problems": problems})
    return out.withColumn("gsd_m_used", F.when(F.size("problems") == 0, gsd))


def alignment(*, true_lat, true_lon, trust_yaw, yaw_deg, pose_lat, pose_lon, pose_yaw, tolerance_m: float = 150.0) -> Column:
    """struct(lat, lon, yaw, source, drift_m) of the oracle pose: the metadata's, else a found pose near the truth, else null."""
    drift = haversine(lat1=true_lat, lon1=true_lon, lat2=pose_lat, lon2=pose_lon)
    known = _c(true_lat).isNotNull()
    own = F.struct(_c(true_lat).alias("lat"), _c(true_lon).alias("lon"), _c(yaw_deg).alias("yaw"), F.lit("exif").alias("source"), F.lit(0.0).alias("drift_m"))
    found = F.struct(_c(pose_lat).alias("lat"), _c(pose_lon).alias("lon"), _c(pose_yaw).alias("yaw"), F.lit("pose").alias("source"), drift.alias("drift_m"))
    return F.when(known & F.coalesce(_c(trust_yaw), F.lit(False)), own).when(known & (drift <= tolerance_m), found)


def evidence(df: DataFrame, by: str, conf: str = "conf") -> DataFrame:
    """(by, n_matches, conf_p10 … conf_max, conf_frac_gt010, conf_frac_gt050) of matches; by left-joining, a pair without any has NaN and 0."""
    q = F.percentile(conf, [p / 100 for p in (10, 50, 90, 99)])
    g = df.groupBy(by).agg(F.count(conf).alias("n_matches"), q.alias("q"), F.max(conf).alias("conf_max"), F.avg((F.col(conf) > 0.1).cast("double")).alias("f1"), F.avg((F.col(conf) > 0.5).cast("double")).alias("f5"))
    nan = F.lit(float("nan"))
    names = ("conf_p10", "conf_p50", "conf_p90", "conf_p99")
    return g.select(by, "n_matches", *(F.coalesce(F.get("q", F.lit(i)), nan).alias(n) for i, n in enumerate(names)), F.coalesce("conf_max", nan).alias("conf_max"), F.coalesce("f1", F.lit(0.0)).alias("conf_frac_gt010"), F.coalesce("f5", F.lit(0.0)).alias("conf_frac_gt050"))


def summary_line(*, status="status", lat="lat", lon="lon", heading="heading_deg", ellipse="ellipse", reason="reason") -> Column:
    placed = F.format_string("%s  %.6f %.6f  heading %.0f", _c(status), _c(lat), _c(lon), _c(heading))
    tail = F.when(_c(ellipse) != "-", F.concat(F.lit(", ellipse "), _c(ellipse))).otherwise("")
    return F.when(_c(lat).isNotNull(), F.concat(placed, tail)).otherwise(F.concat(_c(status), F.lit("  "), F.coalesce(_c(reason), F.lit(""))))
