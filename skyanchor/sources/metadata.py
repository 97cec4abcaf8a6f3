"""Shots' metadata without decoding pixels: XMP packets, orientation, altitude rules."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.geo import _c, wrap_deg
from . import exif


def xmp(packet, name: str) -> Column:
    """A property of any namespace, as attribute or element; null where it isn't there."""
    value = F.coalesce(
        F.nullif(F.regexp_extract(_c(packet), rf'[\w.-]+:{name}="([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract(_c(packet), rf"<[\w.-]+:{name}>([^<]*)</", 1), F.lit(""))
    )
    return F.trim(value)


def xmp_number(packet, name: str) -> Column:
    return xmp(packet, name).try_cast("double")


def pitch_roll(packet) -> tuple[Column, Column]:
    """Angles off nadir: a gimbal's pitch counts from the horizon, a survey camera's own tags from nadir."""
    return F.coalesce(xmp_number(packet, "GimbalPitchDegree") + 90, xmp_number(packet, "Pitch")), F.coalesce(xmp_number(packet, "GimbalRollDegree"), xmp_number(packet, "Roll"))


#: Bytes of a file's head that are looked at: a JPEG's metadata come before its pixels.
HEAD_BYTES = 1 << 20
_FIELDS = "width int, height int, model string, taken string, focal_35mm double, fov_deg double, lat double, lon double, absolute_m double, packet string, complete boolean"


def headers(files: DataFrame) -> DataFrame:
    """files (path, length, content) with the fields of their heads in place of content, by exif.read()."""

    def run(batches):
        for batch in batches:
            got = [exif.read(x or b"") for x in batch.column("head").to_pylist()]
            kept = [batch.column(c) for c in ("path", "length")]
            cols = [pa.array([g[f.name] for g in got], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([*kept, *cols], names=["path", "length", *schema.names])

    schema = to_arrow_schema(StructType.fromDDL(_FIELDS))
    heads = files.select("path", "length", F.substring("content", 1, HEAD_BYTES).alias("head"))
    return heads.mapInArrow(run, f"path string, length bigint, {_FIELDS}")


def shots(heads: DataFrame) -> DataFrame:
    """headers()' rows with what the packet says (yaw_deg, pitch_deg, roll_deg, relative_m), gsd_m and a list of problems.

    A shot that lacks something has its row with the problem named; a tilt of more than 10 degrees is one.
    """
    gimbal = xmp_number("packet", "GimbalYawDegree").isNotNull()
    pitch, roll = pitch_roll("packet")
    known = gimbal | xmp_number("packet", "Yaw").isNotNull()
    h = heads.withColumns(
        {
            "yaw_deg": F.coalesce(xmp_number("packet", "GimbalYawDegree"), xmp_number("packet", "Yaw")), "pitch_deg": F.when(known, F.coalesce(pitch, F.lit(0.0))), "roll_deg": F.when(known, F.coalesce(roll, F.lit(0.0))),
            "relative_m": F.when(gimbal, xmp_number("packet", "RelativeAltitude")), "taken": F.try_to_timestamp("taken", F.lit("yyyy:MM:dd HH:mm:ss")),
        }
    )
    width_m = 2 * F.col("relative_m") * F.tan(F.radians("fov_deg") / 2)
    h = h.withColumn("gsd_m", F.when((F.col("relative_m") > 0) & (F.col("width") > 0), width_m / F.col("width")))
    problems = F.array_compact(
        F.array(
            F.when(~F.col("complete"), "metadata incomplete"), F.when(F.col("fov_deg").isNull(), "no focal length"), F.when(F.col("lat").isNull() | F.col("lon").isNull(), "no position"), F.when(F.col("packet").isNull(), "no XMP"),
            F.when(~known, "no orientation"), F.when(F.col("relative_m").isNull(), "no height above ground"), F.when(F.col("taken").isNull(), "no time"), F.when(F.abs("pitch_deg") > 10, F.format_string("tilted by %.0f degrees", F.abs("pitch_deg"))),
        )
    )
    return h.withColumn("problems", problems)


def scan(spark: SparkSession, path: str, glob: str = "*.jpg") -> DataFrame:
    """The shots of a folder's image files; empty files have no row."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return shots(headers(raw.filter("length > 0")))


def full_shots(found: DataFrame, dem: DataFrame | None = None, declination_deg: float = 0.0) -> DataFrame:
    """shots() that can be located, with altitude_m above ground and heading_deg from true north.

    The height is the relative one, else an override_m, else the absolute one less the
    ground's from dem (gy, gx, ground_m).  Without a position, a lens, a heading or a height
    a shot has no row.
    """
    from .tiles import elevation

    s = found.filter("lat is not null and lon is not null and fov_deg is not null and yaw_deg is not null")
    s = elevation(s, dem) if dem is not None else s.withColumn("ground_m", F.lit(None).cast("double"))
    override = F.col("override_m") if "override_m" in found.columns else F.lit(None).cast("double")
    h = altitude_above_ground(relative_m="relative_m", override_m=override, absolute_m="absolute_m", ground_m="ground_m")
    return s.withColumn("altitude_m", h).withColumn("heading_deg", true_heading(yaw_deg="yaw_deg", declination_deg=declination_deg)).filter("altitude_m is not null")


def altitude_above_ground(*, relative_m, override_m, absolute_m, ground_m) -> Column:
    """Relative altitude, else an override, else absolute less ground; null where none is positive."""
    h = F.coalesce(_c(relative_m), _c(override_m), _c(absolute_m) - _c(ground_m))
    return F.when(h > 0, h)


def true_heading(*, yaw_deg, declination_deg) -> Column:
    return wrap_deg(_c(yaw_deg) + F.coalesce(_c(declination_deg), F.lit(0.0)))
