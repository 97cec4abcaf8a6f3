"""Reports of results: advice, ellipse wording, JSON, GeoJSON and KML as column expressions, and HTML text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import _c


def advice(*, status="status", reason="reason", trust_yaw="trust_yaw") -> Column:
    """What to change in the input, from the reason of a refusal; codes, empty for a localized result."""
    r = F.coalesce(_c(reason), F.lit(""))
    stuck = r.contains("no fine convergence") | r.contains("few correspondences")
    tips = F.array_compact(
        F.array(
            F.when(r.contains("uniqueness"), "narrow the prior or fly higher"),
            F.when(r.contains("outside prior"), "widen sigma or correct the prior"),
            F.when(stuck, "check the ground sampling distance"),
            F.when(stuck & ~F.coalesce(_c(trust_yaw), F.lit(False)), "give the heading"),
            F.when(stuck, "mind the season of the imagery"),
            F.when(r.contains("no candidates"), "widen the map's radius"),
            F.when(r.contains("no imagery"), "no imagery at this place"),
            F.when(_c(status) == "low_confidence", "look at the overlay"),
        )
    )
    some = F.when(F.size(tips) > 0, tips).otherwise(F.array(F.concat(F.lit("reason: "), F.when(r == "", "none given").otherwise(r))))
    return F.when(_c(status) == "localized", F.array().cast("array<string>")).otherwise(some)


def ellipse_words(*, status="status", semi_major_m="semi_major_m", semi_minor_m="semi_minor_m") -> Column:
    """Axes in words, for localized results only."""
    return F.when(_c(status) == "localized", F.concat(F.format_number(_c(semi_major_m), 2), F.lit(" x "), F.format_number(_c(semi_minor_m), 2), F.lit(" m"))).otherwise("-")


def footprint_geojson(*, ring="ring", lon="lon", lat="lat", status="status") -> Column:
    """A feature collection of the closed footprint and the centre; empty for a refusal.  ring is array<struct<lon,lat>>."""
    number = lambda v: F.round(v, 7)
    closed = F.concat(_c(ring), F.slice(_c(ring), 1, 1))
    coords = F.transform(closed, lambda p: F.array(number(p["lon"]), number(p["lat"])))
    empty_props = F.map_from_arrays(F.array(F.lit("status")), F.array(_c(status)))
    polygon = F.to_json(F.struct(F.lit("Feature").alias("type"), empty_props.alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(coords).alias("coordinates")).alias("geometry")))
    point = F.to_json(F.struct(F.lit("Feature").alias("type"), empty_props.alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(number(_c(lon)), number(_c(lat))).alias("coordinates")).alias("geometry")))
    some = (_c(status) != "not_localized") & _c(ring).isNotNull()
    return F.concat(F.lit('{"type":"FeatureCollection","features":['), F.when(some, F.concat(polygon, F.lit(","), point)).otherwise(""), F.lit("]}"))


XML_HEAD = "<?xml version='1.0' encoding='utf-8'?>"
KML_SPACE = "/".join(("http:", "", "www.opengis.net", "kml", "2.2"))


def _nested(inner: Column, tags: str) -> Column:
    """inner inside elements of the given names, the first outermost."""
    names = tags.split()
    return F.concat(F.lit("".join(f"<{n}>" for n in names)), inner, F.lit("".join(f"</{n}>" for n in reversed(names))))


def footprint_kml(*, name="name", ring="ring", lon="lon", lat="lat", status="status") -> Column:
    """A KML document of the footprint and the centre; without placemarks for a refusal."""
    pair = lambda x, y: F.concat(F.format_string("%.7f", x), F.lit(","), F.format_string("%.7f", y), F.lit(",0"))
    closed = F.concat(_c(ring), F.slice(_c(ring), 1, 1))
    coords = F.array_join(F.transform(closed, lambda p: pair(p["lon"], p["lat"])), " ")
    marks = F.concat(_nested(coords, "Placemark Polygon outerBoundaryIs LinearRing coordinates"), _nested(pair(_c(lon), _c(lat)), "Placemark Point coordinates"))
    some = (_c(status) != "not_localized") & _c(ring).isNotNull()
    title = F.regexp_replace(F.regexp_replace(_c(name), "&", "&amp;"), "<", "&lt;")
    body = _nested(F.concat(_nested(title, "name"), F.when(some, marks).otherwise("")), "Document")
    return F.concat(F.lit(f"{XML_HEAD}<kml xmlns='{KML_SPACE}'>"), body, F.lit("</kml>"))


def result_json(*names: str) -> Column:
    """A result's columns as one JSON object, doubles to seven places."""
    return F.to_json(F.struct(*(F.col(n) for n in names)))


def _row(columns: list[str]) -> Column:
    cell = lambda c: F.concat(F.lit("<td>"), F.coalesce(F.regexp_replace(F.regexp_replace(F.col(f"`{c}`").cast("string"), "&", "&amp;"), "<", "&lt;"), F.lit("")), F.lit("</td>"))
    return F.concat(F.lit("<tr>"), *(cell(c) for c in columns), F.lit("</tr>"))


def _ends(columns: list[str], title: str) -> tuple[str, str]:
    head = "".join(f"<th>{c}</th>" for c in columns)
    return f"<html><head><title>{title}</title></head><body><table><tr>{head}</tr>", "</table></body></html>"


def html_lines(rows: DataFrame, title: str = "Results") -> DataFrame:
    """(line) of an HTML table of all rows in order of their first column, in as many ordered parts as there are partitions: written as text they make the page, however long."""
    first, last = _ends(rows.columns, title)
    body = rows.select(F.lit(1).alias("part"), F.col(f"`{rows.columns[0]}`").cast("string").alias("k"), _row(rows.columns).alias("line"))
    ends = rows.sparkSession.createDataFrame([(0, None, first), (2, None, last)], "part int, k string, line string")
    return body.unionByName(ends).orderBy("part", "k", "line").select("line")


def html_report(rows: DataFrame, title: str = "Results") -> DataFrame:
    """One row (html) of html_lines() put together: for as many rows as a person reads; html_lines() is for more."""
    first, last = _ends(rows.columns, title)
    lines = rows.select(F.struct(F.col(f"`{rows.columns[0]}`").cast("string").alias("k"), _row(rows.columns).alias("h")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"]), "\n")
    return lines.agg(F.concat(F.lit(first + "\n"), body, F.lit("\n" + last)).alias("html"))


def overlays(pairs: DataFrame, matches: DataFrame | None = None, most: int = 200) -> DataFrame:
    """(frame_id, png) of pairs (frame_id, a, b, tx, ty, height, width, query, ref_height, ref_width, reference): four panels, the frame, its outline on the map, a chessboard of both, and up to most of its matches drawn.

    matches (frame_id, qx, qy, rx, ry).  Without a raster or a transform png is null.
    """
    import numpy as np
    import pyarrow as pa

    from ..functions.raster import overlay

    if matches is None:
        drawn = pairs.withColumn("lines", F.lit(None).cast("array<struct<qx:double,qy:double,rx:double,ry:double>>"))
    else:
        some = matches.selectExpr("frame_id", "struct(qx, qy, rx, ry) p", "row_number() over (partition by frame_id order by qx, qy, rx, ry) n").filter(F.col("n") <= most)
        drawn = pairs.join(some.groupBy("frame_id").agg(F.array_sort(F.collect_list("p")).alias("lines")), "frame_id", "left")
    kind = pairs.schema["frame_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["query"] is None or r["reference"] is None or r["a"] is None:
                    out.append(None)
                    continue
                q = np.frombuffer(r["query"], np.uint8).reshape(r["height"], r["width"])
                z = np.frombuffer(r["reference"], np.uint8).reshape(r["ref_height"], r["ref_width"])
                out.append(overlay(q, z, r["a"], r["b"], r["tx"], r["ty"], np.array([(p["qx"], p["qy"], p["rx"], p["ry"]) for p in r["lines"] or []])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["frame_id", "png"])

    cols = ("frame_id", "a", "b", "tx", "ty", "height", "width", "query", "ref_height", "ref_width", "reference", "lines")
    return drawn.select(*cols).mapInArrow(run, f"frame_id {kind}, png binary")
