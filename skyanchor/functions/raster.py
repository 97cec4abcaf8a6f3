"""Rasters as numpy arrays of grey values: smoothing, equalising, edges, resizing, appearance, features, pictures."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from numpy import ndarray as Arr


def convolve(z: Arr, kernel: Arr, axis: int) -> Arr:
    """Correlation with a symmetric kernel along an axis, the border reflected without repeating its pixel."""
    half = len(kernel) // 2
    pad = [(0, 0)] * z.ndim
    pad[axis] = (half, half)
    p = np.pad(z, pad, mode="reflect" if z.shape[axis] > half else "symmetric")
    n = z.shape[axis]
    return sum(k * np.take(p, np.arange(i, i + n), axis) for i, k in enumerate(kernel))


def gaussian(z: Arr, sigma: float) -> Arr:
    """Gaussian smoothing by a kernel of four sigmas to each side."""
    if sigma <= 0:
        return z.astype(float)
    half = int(round(sigma * 8 + 1) | 1) // 2
    k = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    k /= k.sum()
    return convolve(convolve(z.astype(float), k, 0), k, 1)


def sobel(z: Arr, edge: str = "reflect") -> tuple[Arr, Arr]:
    p = np.pad(z.astype(float), 1, mode=edge)
    dx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    dy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    return dx, dy


def stretched(z: Arr) -> Arr:
    """Values stretched to whole numbers from 0 to 255; a flat raster becomes 0."""
    lo, hi = float(z.min()), float(z.max())
    return np.zeros(z.shape, np.uint8) if hi <= lo else np.clip(np.floor((z - lo) / (hi - lo) * 255), 0, 255).astype(np.uint8)


def canny(z: Arr, low: float = 50, high: float = 150) -> Arr:
    """Edges by Canny's method on bytes: thinned maxima of |dx| + |dy| above low that hang together with one above high."""
    dx, dy = sobel(z, "edge")
    m = np.abs(dx) + np.abs(dy)
    p = np.pad(m, 1)
    at = lambda j, i: p[1 + j : p.shape[0] - 1 + j, 1 + i : p.shape[1] - 1 + i]
    xs, ys = np.abs(dx), np.abs(dy)
    flat, steep = ys < xs * np.tan(np.pi / 8), ys > xs * np.tan(3 * np.pi / 8)
    across = (m > at(0, -1)) & (m >= at(0, 1))
    down = (m > at(-1, 0)) & (m >= at(1, 0))
    falling = np.where(dx * dy < 0, (m > at(-1, 1)) & (m > at(1, -1)), (m > at(-1, -1)) & (m > at(1, 1)))
    thin = (m > low) & np.where(flat, across, np.where(steep, down, falling))
    edge = thin & (m > high)
    while True:
        q = np.pad(edge, 1)
        grown = thin & np.any([q[1 + j : q.shape[0] - 1 + j, 1 + i : q.shape[1] - 1 + i] for j in (-1, 0, 1) for i in (-1, 0, 1)], axis=0)
        if (grown == edge).all():
            return edge
        edge = grown


def clahe(z: Arr, clip: float = 2.0, tiles: int = 8) -> Arr:
    """Bytes equalised by tiles of tiles x tiles with clipped histograms, blended between the tiles' centres."""
    h, w = z.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    p = np.pad(z, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > max(th * tiles - h, tw * tiles - w) else "symmetric")
    lut = np.empty((tiles, tiles, 256))
    most = max(1, int(clip * th * tw / 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(p[i * th : (i + 1) * th, j * tw : (j + 1) * tw].reshape(-1), minlength=256)
            over = int(np.maximum(n - most, 0).sum())
            n = np.minimum(n, most) + over // 256
            rest = over % 256
            if rest:
                n[:: max(1, 256 // rest)][:rest] += 1
            lut[i, j] = np.clip(np.round(np.cumsum(n) * (255 / (th * tw))), 0, 255)
    y, x = (np.arange(h) / th - 0.5)[:, None], (np.arange(w) / tw - 0.5)[None, :]
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - y0, x - x0
    a, b = np.clip(y0, 0, tiles - 1), np.clip(y0 + 1, 0, tiles - 1)
    c, d = np.clip(x0, 0, tiles - 1), np.clip(x0 + 1, 0, tiles - 1)
    out = (lut[a, c, z] * (1 - fx) + lut[a, d, z] * fx) * (1 - fy) + (lut[b, c, z] * (1 - fx) + lut[b, d, z] * fx) * fy
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def area_resize(z: Arr, height: int, width: int) -> Arr:
    """A raster at another size, each pixel the mean of the area that it covers."""

    def weights(n: int, m: int) -> Arr:
        edge = np.arange(m + 1) * n / m
        lo, hi = edge[:-1, None], edge[1:, None]
        k = np.arange(n)[None, :]
        return np.clip(np.minimum(hi, k + 1) - np.maximum(lo, k), 0, None) / (n / m)

    return weights(z.shape[0], height) @ z.astype(float) @ weights(z.shape[1], width).T


def north_up_crop(z: Arr, yaw_deg: float) -> Arr:
    """The even square about the centre that holds only the frame's own pixels once it is turned north: its side is the shorter one over root two."""
    from ..operators.imagery import rotate

    side = int(min(z.shape) / 2**0.5 / 2) * 2
    turned = rotate(z.astype(float), -yaw_deg)
    y, x = (z.shape[0] - side) // 2, (z.shape[1] - side) // 2
    return turned[y : y + side, x : x + side]


#: Quantiser of luminance at quality 50, as in the standard's annex K.
LUMINANCE = np.array(
    [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101,
     72, 92, 95, 98, 112, 100, 103, 99], float
).reshape(8, 8)


def jpeg_loss(z: Arr, quality: float) -> Arr:
    """Bytes as JPEG of a quality from 1 to 100 would give them back: blocks transformed, quantised, transformed back."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    q = np.clip(np.floor((LUMINANCE * scale + 50) / 100), 1, 255)
    k, n = np.arange(8)[:, None], np.arange(8)[None, :]
    dct = np.where(k == 0, np.sqrt(1 / 8), 0.5 * np.cos((2 * n + 1) * k * np.pi / 16))
    h, w = z.shape
    p = np.pad(z.astype(float), ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
    b = p.reshape(p.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3)
    b = dct.T @ (np.round(dct @ b @ dct.T / q) * q) @ dct + 128
    return np.clip(np.round(b.transpose(0, 2, 1, 3).reshape(p.shape)[:h, :w]), 0, 255).astype(np.uint8)


def appearance(z: Arr, level: int, strength: float, seed: int) -> Arr:
    """Bytes with a difference of appearance, none where strength is 0: 1 exposure, 2 optics, sensor and compression, 3 another season or sensor, 4 objects come and gone."""
    if level not in range(5):
        raise ValueError(f"no level {level} of appearance; there are 0 to 4")
    if level == 0 or strength <= 0:
        return z
    rng, out = np.random.default_rng(seed), z.astype(float)
    if level == 1:
        u = [2 * rng.random() - 1 for _ in range(3)]
        out = (1 + 0.35 * strength * u[1]) * (255 * (out / 255) ** 2 ** (0.7 * strength * u[0])) + 30 * strength * u[2]
    elif level == 2:
        if 1.8 * strength > 0.3:
            out = gaussian(out, 1.8 * strength)
        out = np.clip(out + rng.normal(0, 14 * strength, out.shape), 0, 255).astype(np.uint8)
        out = jpeg_loss(out, float(np.clip(95 - 75 * strength, 12, 95))).astype(float)
    elif level == 3:
        x = out / 255
        out = 255 * np.clip(x + 0.35 * strength * np.sin(3 * np.pi * x), 0, 1)
    else:
        h, w = out.shape
        for count, most, fill in ((6, 6, True), (4, 8, False)):
            for _ in range(round(count * strength)):
                x, y = int(rng.integers(0, w)), int(rng.integers(0, h))
                bw, bh = (int(rng.integers(max(1, n // 20), max(2, n // most))) for n in (w, h))
                part = out[y : y + bh, x : x + bw]
                part[:] = rng.uniform(0, 255) if fill else part.mean()
    return np.clip(out, 0, 255).astype(np.uint8)


def png(z: Arr) -> bytes:
    """A PNG file of height x width (grey) or height x width x 3 (RGB) bytes."""
    h, w = z.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(z, np.uint8).reshape(h, -1)], axis=1).tobytes()
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if z.ndim == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows, 6)) + part(b"IEND", b"")


def line(canvas: Arr, x0: float, y0: float, x1: float, y1: float, colour: tuple[int, int, int]) -> None:
    """Draw a line on RGB bytes, as far as it is on them."""
    n = int(max(abs(x1 - x0), abs(y1 - y0), 1)) + 1
    x, y = np.round(np.linspace(x0, x1, n)).astype(int), np.round(np.linspace(y0, y1, n)).astype(int)
    ok = (x >= 0) & (y >= 0) & (x < canvas.shape[1]) & (y < canvas.shape[0])
    canvas[y[ok], x[ok]] = colour


def overlay(query: Arr, reference: Arr, a: float, b: float, tx: float, ty: float, points: Arr | None = None) -> bytes:
    """A PNG of four panels: the frame, the map with the frame's outline, a chessboard of both, and their matches (qx, qy, rx, ry)."""
    from ..operators.pose import _sample

    h, w = query.shape
    yy, xx = np.mgrid[0:h, 0:w].astype(float)
    warped, inside = _sample(reference.astype(float), a * xx - b * yy + tx, b * xx + a * yy + ty)
    rgb = lambda z: np.repeat(np.clip(z, 0, 255).astype(np.uint8)[..., None], 3, axis=2)
    board = np.where(((yy // max(1, h // 8) + xx // max(1, w // 8)) % 2 == 0) & inside, warped, query)
    outline = rgb(reference)
    corners = [(a * x - b * y + tx, b * x + a * y + ty) for x, y in ((0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1))]
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1]):
        line(outline, x0, y0, x1, y1, (255, 64, 64))
    side = np.zeros((max(h, reference.shape[0]), w + reference.shape[1], 3), np.uint8)
    side[:h, :w], side[: reference.shape[0], w:] = rgb(query), rgb(reference)
    for qx, qy, rx, ry in points if points is not None else ():
        line(side, qx, qy, rx + w, ry, (64, 255, 64))
    panels = [rgb(query), outline, rgb(board), side]
    height, gap = max(p.shape[0] for p in panels), 4
    sheet = np.full((height, sum(p.shape[1] for p in panels) + gap * 3, 3), 24, np.uint8)
    x = 0
    for p in panels:
        sheet[: p.shape[0], x : x + p.shape[1]] = p
        x += p.shape[1] + gap
    return png(sheet)
