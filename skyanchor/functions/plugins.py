"""Kernels that other packages may supply: matchers, encoders, raster and search backends, all by name."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import features
from .raster import area_resize

MATCHERS = ("sift", "akaze", "superpoint_lightglue", "gim_lightglue", "minima_lightglue", "loftr", "minima_loftr", "roma", "minima_roma", "romav2")
#: Kernels of this package: from two rasters of bytes to rows (qx, qy, rx, ry, conf).
BUILT_IN = {"sift": features.match}
DENSE = frozenset({"loftr", "minima_loftr", "roma", "minima_roma", "romav2"})
ENCODERS = ("average_pool", "dinov2", "megaloc")


class MissingKernel(RuntimeError):
    """A kernel of that name exists but nothing supplies it here."""


_made: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str, make: Callable) -> None:
    """Supply a kernel; make() is called in the Python worker, once a batch of images."""
    _made[kind, name] = make


def registered(kind: str, name: str) -> Callable | None:
    return _made.get((kind, name))


def get(kind: str, name: str) -> Callable:
    known = {"matcher": MATCHERS, "encoder": ENCODERS}.get(kind, ())
    if (kind, name) in _made:
        return _made[kind, name]
    if name in known:
        raise MissingKernel(f"{kind} '{name}' needs a backend: register('{kind}', '{name}', make)")
    raise KeyError(f"no {kind} '{name}'; known are {', '.join(sorted({*known, *(n for k, n in _made if k == kind)}))}")


def is_dense(matcher: str) -> bool:
    return matcher in DENSE


def match(pairs: DataFrame, matcher: str) -> DataFrame:
    """(frame_id, i, qx, qy, rx, ry, conf) of image pairs (frame_id, query binary, reference binary) by a registered matcher.

    The kernel takes two byte strings and gives rows (qx, qy, rx, ry, conf).
    """
    make = get("matcher", matcher)

    def run(batches):
        kernel = make()
        for batch in batches:
            out = []
            for f, q, r in zip(*(batch.column(i).to_pylist() for i in range(3))):
                out += [(f, i, *map(float, m)) for i, m in enumerate(kernel(q, r))] if q is not None and r is not None else []
            cols = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["frame_id", "i", "qx", "qy", "rx", "ry", "conf"])

    return pairs.select("frame_id", "query", "reference").mapInArrow(run, "frame_id bigint, i bigint, qx double, qy double, rx double, ry double, conf double")


def with_max_side(kernel: Callable, max_side: int | None, multiple: int = 8) -> Callable:
    """A raster kernel that sees both rasters resized by the one factor that brings the longer side to max_side at most, and padded to a multiple; its points are those of the originals."""

    def run(query: np.ndarray, reference: np.ndarray) -> np.ndarray:
        longest = max(*query.shape, *reference.shape)
        f = 1.0 if max_side is None else min(1.0, max_side / longest)
        small = []
        for z in (query, reference):
            h, w = (max(1, round(n * f)) for n in z.shape)
            r = np.clip(np.round(area_resize(z, h, w)), 0, 255).astype(np.uint8) if f < 1 else z
            small.append(np.pad(r, ((0, -h % multiple), (0, -w % multiple))))
        m = np.array(kernel(*small), float).reshape(-1, 5)
        m[:, :4] = (m[:, :4] + 0.5) / f - 0.5
        ok = (m[:, 0] < query.shape[1]) & (m[:, 1] < query.shape[0]) & (m[:, 2] < reference.shape[1]) & (m[:, 3] < reference.shape[0])
        return m[ok]

    return run


def match_rasters(pairs: DataFrame, matcher: str = "sift", max_side: int | None = None) -> DataFrame:
    """(frame_id, i, qx, qy, rx, ry, conf) of pairs (frame_id, height, width, query, ref_height, ref_width, reference) of byte rasters.

    matcher is built in or registered as a 'raster_matcher'; with max_side larger rasters are matched smaller.
    """
    kernel = BUILT_IN[matcher] if matcher in BUILT_IN else None
    make = (lambda: kernel) if kernel else get("raster_matcher", matcher)
    kind = pairs.schema["frame_id"].dataType.simpleString()

    def run(batches):
        f = with_max_side(make(), max_side)
        for batch in batches:
            for k, r in enumerate(batch.to_pylist()):
                if r["query"] is None or r["reference"] is None:
                    continue
                q = np.frombuffer(r["query"], np.uint8).reshape(r["height"], r["width"])
                m = f(q, np.frombuffer(r["reference"], np.uint8).reshape(r["ref_height"], r["ref_width"]))
                ids = batch.column(0).take(pa.array(np.full(len(m), k)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(len(m))), *(pa.array(m[:, c].astype(float)) for c in range(5))], names=["frame_id", "i", "qx", "qy", "rx", "ry", "conf"])

    cols = ("frame_id", "height", "width", "query", "ref_height", "ref_width", "reference")
    return pairs.select(*cols).mapInArrow(run, f"frame_id {kind}, i bigint, qx double, qy double, rx double, ry double, conf double")


def encode(images: DataFrame, encoder: str) -> DataFrame:
    """(id, embedding) of images (id, image binary), of unit length, by a registered encoder from a list of byte strings to rows of floats; zero stays zero."""
    import numpy as np

    make = get("encoder", encoder)

    def run(batches):
        kernel = make()
        for batch in batches:
            x = np.asarray(kernel(batch.column(1).to_pylist()), np.float32).reshape(batch.num_rows, -1)
            n = np.sqrt((x * x).sum(axis=1))[:, None]
            x = np.where(n > 0, x / np.maximum(n, 1e-12), 0).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float32()))], names=["id", "embedding"])

    return images.select("id", "image").mapInArrow(run, "id bigint, embedding array<float>")
