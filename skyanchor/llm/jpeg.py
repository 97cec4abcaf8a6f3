"""Progressive JPEG to RGB tensors.

All scans accumulate into arrays of quantised coefficients: spectral selection
picks the band, successive approximation adds a bit at a time.  The inverse
transform of all blocks of a component is one pair of matrix products; chroma is
upsampled with a triangle filter where it is halved and by repetition otherwise.
Sequential Huffman files, which are a single approximation, decode as well.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import without

ZIGZAG = np.array(
    [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36,
     29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
)
_k, _n = np.arange(8)[:, None], np.arange(8)[None, :]
#: DCT[k, n]: orthonormal, so that its transpose inverts it.
DCT = np.where(_k == 0, np.sqrt(1 / 8), 0.5 * np.cos((2 * _n + 1) * _k * np.pi / 16))


#: Bytes of tensors to an Arrow batch, and pixels transformed at a time.
FLUSH_BYTES, BAND_PIXELS = 64 << 20, 1 << 21
#: A value of a binary column, a JVM array, holds no more.
MOST_BYTES = (1 << 31) - 64


class Damaged(ValueError):
    """Not a JPEG that can be decoded whole."""


@lru_cache(maxsize=256)
def _lookup(spec: bytes) -> list[int]:
    """For each 16 bits: symbol << 5 | length of the code that they begin with, or 0."""
    out = np.zeros(1 << 16, np.int64)
    code, at = 0, 16
    for length in range(1, 17):
        for _ in range(spec[length - 1]):
            lo = code << (16 - length)
            if lo + (1 << (16 - length)) > 1 << 16:
                raise Damaged("a Huffman table overflows")
            out[lo : lo + (1 << (16 - length))] = spec[at] << 5 | length
            at += 1
            code += 1
        code <<= 1
    return out.tolist()


def _window(data: bytes) -> array:
    """The 24 bits from each byte of an entropy-coded segment on; zeros follow its end, and reading past them is an IndexError."""
    raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + bytes(8), np.uint8).astype(np.uint32)
    return array("I", ((raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]).tobytes())


def _first(window, tables, coef, units, al: int, progressive: bool) -> None:
    """A first DC scan, or a sequential one; units are (component of the scan, block's place) pairs."""
    at, pred = 0, [0] * len(tables)
    for c, base in units:
        dc, ac = tables[c]
        got = dc[(window[at >> 3] >> (8 - (at & 7))) & 0xFFFF]
        s = got >> 5
        if not got or s > 16:
            raise Damaged("a code is not in the Huffman table" if not got else "a value of more than 16 bits")
        at += got & 31
        if s:
            v = ((window[at >> 3] >> (8 - (at & 7))) & 0xFFFF) >> (16 - s)
            at += s
            pred[c] += v if v >> (s - 1) else v - (1 << s) + 1
        coef[c][base] = pred[c] << al
        if progressive:
            continue
        k, stop, of = base + 1, base + 63, coef[c]
        while k <= stop:
            got = ac[(window[at >> 3] >> (8 - (at & 7))) & 0xFFFF]
            if not got:
                raise Damaged("a code is not in the Huffman table")
            at += got & 31
            s, r = got >> 5 & 15, got >> 9
            if not s:
                if r != 15:
                    break
                k += 16
                continue
            k += r
            if k > stop:
                raise Damaged("a run passes the block's end")
            v = ((window[at >> 3] >> (8 - (at & 7))) & 0xFFFF) >> (16 - s)
            at += s
            of[k] = v if v >> (s - 1) else v - (1 << s) + 1
            k += 1


def _ac_first_scan(window, table, coef, bases, ss: int, se: int, al: int) -> None:
    at, i, n = 0, 0, len(bases)
    while i < n:
        k, stop = bases[i] + ss, bases[i] + se
        i += 1
        while k <= stop:
            got = table[(window[at >> 3] >> (8 - (at & 7))) & 0xFFFF]
            if not got:
                raise Damaged("a code is not in the Huffman table")
            at += got & 31
            s, r = got >> 5 & 15, got >> 9
            if s:
                k += r
                if k > stop:
                    raise Damaged("a run passes the band's end")
                v = ((window[at >> 3] >> (8 - (at & 7))) & 0xFFFF) >> (16 - s)
                at += s
                coef[k] = (v if v >> (s - 1) else v - (1 << s) + 1) << al
                k += 1
            elif r == 15:
                k += 16
            else:
                if r:
                    i += (1 << r) - 1 + (((window[at >> 3] >> (8 - (at & 7))) & 0xFFFF) >> (16 - r))
                    at += r
                break


def _ac_refine_scan(window, table, coef, bases, ss: int, se: int, al: int) -> None:
    at, eob, plus = 0, 0, 1 << al
    for base in bases:
        k, stop = base + ss, base + se
        if not eob:
            while k <= stop:
                got = table[(window[at >> 3] >> (8 - (at & 7))) & 0xFFFF]
                if not got:
                    raise Damaged("a code is not in the Huffman table")
                at += got & 31
                s, r = got >> 5 & 15, got >> 9
                new = 0
                if s:
                    new = plus if window[at >> 3] >> (23 - (at & 7)) & 1 else -plus
                    at += 1
                elif r != 15:
                    eob = 1 << r
                    if r:
                        eob += ((window[at >> 3] >> (8 - (at & 7))) & 0xFFFF) >> (16 - r)
                        at += r
                    break
                while k <= stop:
                    v = coef[k]
                    if v:
                        if window[at >> 3] >> (23 - (at & 7)) & 1 and not abs(v) & plus:
                            coef[k] = v + plus if v > 0 else v - plus
                        at += 1
                    elif r:
                        r -= 1
                    else:
                        if new:
                            coef[k] = new
                        k += 1
                        break
                    k += 1
        if eob:
            while k <= stop:
                v = coef[k]
                if v:
                    if window[at >> 3] >> (23 - (at & 7)) & 1 and not abs(v) & plus:
                        coef[k] = v + plus if v > 0 else v - plus
                    at += 1
                k += 1
            eob -= 1


def _scan(segments: list[bytes], comps: list[dict], mx: int, my: int, tables, ss, se, ah, al, restart: int, progressive: bool) -> None:
    """Decode one scan into the components' coefficients, segment by segment."""
    coef = [c["coef"] for c in comps]
    if len(comps) == 1:
        c = comps[0]
        bases = (np.add.outer(np.arange(c["bh"]) * c["cols"], np.arange(c["bw"])) * 64).reshape(-1)
        which, mcu = np.zeros(len(bases), np.int64), 1
    else:
        mcu, at, of = sum(c["h"] * c["v"] for c in comps), [], []
        for i, c in enumerate(comps):
            inner = np.add.outer(np.arange(c["v"]) * c["cols"], np.arange(c["h"])).reshape(-1)
            outer = np.add.outer(np.arange(my) * c["v"] * c["cols"], np.arange(mx) * c["h"]).reshape(-1, 1)
            at.append((outer + inner) * 64)
            of.append(np.full(len(inner), i))
        bases, which = np.concatenate(at, axis=1).reshape(-1), np.tile(np.concatenate(of), mx * my)
    per = (restart or len(bases)) * mcu
    for part, data in enumerate(segments):
        here, own = bases[part * per : (part + 1) * per], which[part * per : (part + 1) * per]
        if not len(here):
            break
        if progressive and ss == 0 and ah:
            bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
            if len(bits) < len(here):
                raise Damaged("a scan ends early")
            for i, x in enumerate(coef):
                x = np.frombuffer(x, np.int16)
                x[here[own == i]] |= (bits[: len(here)][own == i].astype(np.int16) << al)
        elif not progressive or ss == 0:
            _first(_window(data), tables, coef, zip(own.tolist(), here.tolist()), al if progressive else 0, progressive)
        else:
            (_ac_refine_scan if ah else _ac_first_scan)(_window(data), tables[0][1], coef[0], array("q", here.astype(np.int64).tobytes()), ss, se, al)


def coefficients(data: bytes):
    """Frame (width, height, components) of a JPEG, with each component's coefficients accumulated over its scans.

    A component is a dict of id, h, v, quantiser, and blocks as rows x columns x 64 in zigzag order.
    """
    if data[:2] != b"\xff\xd8":
        raise Damaged("no start of image")
    at, n = 2, len(data)
    quant, dct, act = {}, {}, {}
    frame, restart, adobe, scans = None, 0, None, 0
    while True:
        while at < n and data[at] != 0xFF:
            at += 1
        while at < n and data[at] == 0xFF:
            at += 1
        if at >= n:
            raise Damaged("no end of image")
        marker = data[at]
        at += 1
        if marker == 0xD9:
            break
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            continue
        if at + 2 > n:
            raise Damaged("a segment ends early")
        size = int.from_bytes(data[at : at + 2], "big")
        body = data[at + 2 : at + size]
        if size < 2 or len(body) < size - 2:
            raise Damaged("a segment ends early")
        at += size
        if marker == 0xDB:
            p = 0
            while p < len(body):
                wide, which = body[p] >> 4, body[p] & 15
                step = 128 if wide else 64
                quant[which] = np.frombuffer(body[p + 1 : p + 1 + step], ">u2" if wide else "u1").astype(np.int64)
                if len(quant[which]) != 64:
                    raise Damaged("a quantisation table ends early")
                p += 1 + step
        elif marker == 0xC4:
            p = 0
            while p + 17 <= len(body):
                count = sum(body[p + 1 : p + 17])
                spec = bytes(body[p + 1 : p + 17 + count])
                if len(spec) != 16 + count:
                    raise Damaged("a Huffman table ends early")
                (act if body[p] >> 4 else dct)[body[p] & 15] = _lookup(spec)
                p += 17 + count
        elif marker in (0xC0, 0xC1, 0xC2):
            if body[0] != 8:
                raise Damaged("not 8 bits a sample")
            h, w = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            comps = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "tq": body[8 + 3 * i]} for i in range(body[5])]
            if not (w and h and comps) or any(not (1 <= c["h"] <= 4 and 1 <= c["v"] <= 4) for c in comps):
                raise Damaged("a frame without size")
            if 3 * w * h > MOST_BYTES:
                raise Damaged(f"{w} x {h} pixels are more than a binary value holds")
            hm, vm = max(c["h"] for c in comps), max(c["v"] for c in comps)
            mx, my = -(-w // (8 * hm)), -(-h // (8 * vm))
            for c in comps:
                c["cols"], c["rows"] = mx * c["h"], my * c["v"]
                c["bw"], c["bh"] = -(-(-(-w * c["h"] // hm)) // 8), -(-(-(-h * c["v"] // vm)) // 8)
            # each block takes a bit at least, so a header can't ask for more than the file can fill
            if sum(c["bw"] * c["bh"] for c in comps) > 8 * n:
                raise Damaged("the file is too short for its size")
            for c in comps:
                c["coef"] = array("h", bytes(128 * c["cols"] * c["rows"]))
            frame = (w, h, comps, hm, vm, mx, my, marker == 0xC2)
        elif 0xC3 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise Damaged("a kind of JPEG that isn't decoded")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            adobe = body[11]
        elif marker == 0xDA:
            if frame is None:
                raise Damaged("a scan before the frame")
            w, h, comps, hm, vm, mx, my, progressive = frame
            ns = body[0]
            chosen = [next((c for c in comps if c["id"] == body[1 + 2 * i]), None) for i in range(ns)]
            if None in chosen or not chosen:
                raise Damaged("a scan of an unknown component")
            tables = [body[2 + 2 * i] for i in range(ns)]
            ss, se, a = body[1 + 2 * ns], body[2 + 2 * ns], body[3 + 2 * ns]
            end = at
            segments, begin = [], at
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= n:
                    raise Damaged("no end of image")
                m = data[end + 1]
                if m == 0 or m == 0xFF:
                    end += 2 if m == 0 else 1
                elif 0xD0 <= m <= 0xD7:
                    segments.append(data[begin:end])
                    end += 2
                    begin = end
                else:
                    segments.append(data[begin:end])
                    break
            at = end
            need_dc, need_ac = (not progressive or (ss == 0 and a >> 4 == 0)), (not progressive or ss > 0)
            dcs, acs = [dct.get(t >> 4) for t in tables], [act.get(t & 15) for t in tables]
            if (need_dc and None in dcs) or (need_ac and None in acs) or se > 63 or ss > se or (progressive and ss and ns > 1) or a & 15 > 13:
                raise Damaged("a scan without its tables")
            try:
                _scan(segments, chosen, mx, my, list(zip(dcs, acs)), ss, se, a >> 4, a & 15, restart, progressive)
            except OverflowError as e:
                raise Damaged("a value of more than 16 bits") from e
            scans += 1
    if frame is None or not scans:
        raise Damaged("no image")
    w, h, comps, hm, vm, *_ = frame
    for c in comps:
        if c["tq"] not in quant:
            raise Damaged("no quantisation table")
        c["quantiser"] = quant[c["tq"]]
        c["blocks"] = np.frombuffer(c.pop("coef"), np.int16).reshape(c["rows"], c["cols"], 64)
    return w, h, comps, hm, vm, adobe


def _inverse(c: dict) -> np.ndarray:
    """Samples of a component as bytes, rows x columns, of whole blocks."""
    out = np.empty((8 * c["rows"], 8 * c["cols"]), np.uint8)
    step = max(1, BAND_PIXELS // (64 * c["cols"]))
    for at in range(0, c["rows"], step):
        blocks = c["blocks"][at : at + step]
        natural = np.zeros(blocks.shape)
        natural[..., ZIGZAG] = blocks * c["quantiser"]
        x = natural.reshape(*natural.shape[:2], 8, 8)
        y = DCT.T @ x @ DCT + 128
        out[8 * at : 8 * (at + len(blocks))] = np.clip(np.round(y), 0, 255).transpose(0, 2, 1, 3).reshape(8 * len(blocks), -1)
    return out


def _double(x: np.ndarray) -> np.ndarray:
    """Twice the columns, each 3/4 of its own and 1/4 of the nearer neighbour."""
    before, after = np.concatenate([x[:, :1], x[:, :-1]], axis=1), np.concatenate([x[:, 1:], x[:, -1:]], axis=1)
    out = np.empty((len(x), 2 * x.shape[1]))
    out[:, 0::2], out[:, 1::2] = (3 * x + before) / 4, (3 * x + after) / 4
    return out


def _band(x: np.ndarray, c: dict, hm: int, vm: int, w: int, h: int, lo: int, hi: int) -> np.ndarray:
    """Rows lo to hi of a component at the image's size."""
    x = x[: -(-h * c["v"] // vm), : -(-w * c["h"] // hm)]
    rows = np.arange(lo, hi)
    if vm == 2 * c["v"]:
        own = rows >> 1
        x = (3.0 * x[own] + x[np.clip(own + np.where(rows & 1, 1, -1), 0, len(x) - 1)]) / 4
    else:
        x = x[np.minimum(rows * c["v"] // vm, len(x) - 1)].astype(float)
    if hm == 2 * c["h"]:
        x = _double(x)
    elif hm != c["h"]:
        x = x[:, np.minimum(np.arange(w) * c["h"] // hm, x.shape[1] - 1)]
    return x[:, :w]


def decode(data: bytes) -> np.ndarray:
    """The image as height x width x 3 bytes of RGB; Damaged where it can't be had whole.

    Of four components the last is black; Adobe's files hold them inverted.
    """
    w, h, comps, hm, vm, adobe = coefficients(data)
    if len(comps) not in (1, 3, 4):
        raise Damaged(f"{len(comps)} components")
    planes = []
    for c in comps:
        planes.append(_inverse(c))
        del c["blocks"]
    out = np.empty((h, w, 3), np.uint8)
    step = max(1, BAND_PIXELS // w)
    for lo in range(0, h, step):
        hi = min(h, lo + step)
        band = [_band(x, c, hm, vm, w, h, lo, hi) for x, c in zip(planes, comps)]
        if len(band) == 1:
            rgb = np.stack(band * 3, axis=-1)
        else:
            rgb = np.stack(band[:3], axis=-1)
            if adobe != 0 and not (len(band) == 4 and adobe is None):
                y, cb, cr = band[0], band[1] - 128, band[2] - 128
                rgb = np.stack([y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb], axis=-1)
                if len(band) == 4:
                    rgb = 255 - np.clip(rgb, 0, 255)
            if len(band) == 4:
                black = band[3][..., None]
                rgb = (255 - rgb) * (255 - black) / 255 if adobe is None else rgb * black / 255
        out[lo:hi] = np.clip(np.round(rgb), 0, 255)
    return out


def decode_media(media: DataFrame, column: str = "jpeg") -> DataFrame:
    """media with width, height, tensor (height x width x 3 bytes of RGB) and error in place of the column of files.

    A null file has nulls in all four.  A file that is empty, damaged or of a
    kind not decoded (lossless, arithmetic, 12 bits) has its error and nulls, and so
    has one whose tensor is more than a binary value holds, 2 GB or 715 megapixels.
    Any other is decoded whole, however large; batches are cut by their bytes.  Other
    columns come through, whatever their names, but those of the four names, which
    are replaced; repeated rows are decoded alike; an empty table gives one.
    """
    base = without(media, "width", "height", "tensor", "error")
    if column not in base.columns:
        raise ValueError(f"the column of files must not be named {column}")

    def run(batches):
        for batch in batches:
            files = batch.column(batch.schema.get_field_index(column))
            out: list = []
            held = began = 0

            def flush(stop, batch=batch):
                part = batch.slice(began, stop - began)
                w, h, t, e = zip(*out)
                rest = [(c, name) for c, name in zip(part.columns, part.schema.names) if name != column]
                cols = [pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(t, pa.binary()), pa.array(e, pa.string())]
                return pa.RecordBatch.from_arrays([*(c for c, _ in rest), *cols], names=[*(name for _, name in rest), "width", "height", "tensor", "error"])

            for i in range(batch.num_rows):
                x = files[i].as_py()
                try:
                    row = (None, None, None, None)
                    if x is not None:
                        rgb = decode(x)
                        row = (rgb.shape[1], rgb.shape[0], rgb.tobytes(), None)
                except Damaged as e:
                    row = (None, None, None, f"{e}")
                except IndexError:
                    row = (None, None, None, "the file ends early")
                more = len(row[2] or b"")
                if out and held + more > FLUSH_BYTES:
                    yield flush(i)
                    out, held, began = [], 0, i
                out.append(row)
                held += more
            if out:
                yield flush(batch.num_rows)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != column)
    return base.mapInArrow(run, f"{ddl}{', ' if ddl else ''}width int, height int, tensor binary, error string")


# Files for tests and for the query over a table that holds no media of its own.

QUANT = np.clip(np.round(np.add.outer(np.arange(8), np.arange(8)) * 3 + 6), 1, 255).astype(np.int64).reshape(-1)[ZIGZAG]
_FLAT = bytes([0] * 7 + [254, 2] + [0] * 7) + bytes(range(256))
_FLAT_DC = bytes([0, 0, 0, 0, 16] + [0] * 11) + bytes(range(16))
_CODES = [(s, 8) if s < 254 else (508 + s - 254, 9) for s in range(256)]


class _Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, v: int, n: int) -> None:
        self.value, self.n = (self.value << n) | (v & ((1 << n) - 1)), self.n + n

    def symbol(self, s: int) -> None:
        self.put(*_CODES[s])

    def done(self) -> bytes:
        self.put((1 << (pad := -self.n % 8)) - 1, pad)
        return self.value.to_bytes(self.n // 8, "big").replace(b"\xff", b"\xff\x00")


def _magnitude(w: _Writer, v: int, n: int) -> None:
    w.put(v if v > 0 else v + (1 << n) - 1, n)


def _ac_first(blocks, ss, se, al) -> bytes:
    w = _Writer()
    for b in blocks:
        run = 0
        for k in range(ss, se + 1):
            v = int(b[k])
            v = (abs(v) >> al) * (1 if v > 0 else -1)
            if not v:
                run += 1
                continue
            while run > 15:
                w.symbol(0xF0)
                run -= 16
            n = abs(v).bit_length()
            w.symbol(run << 4 | n)
            _magnitude(w, v, n)
            run = 0
        if run:
            w.symbol(0)
    return w.done()


def _ac_refine(blocks, ss, se, al) -> bytes:
    w = _Writer()
    for b in blocks:
        mag = [abs(int(b[k])) >> al for k in range(64)]
        last = max((k for k in range(ss, se + 1) if mag[k] == 1), default=-1)
        run, held = 0, []
        for k in range(ss, se + 1):
            if not mag[k]:
                run += 1
                continue
            while run > 15 and k <= last:
                w.symbol(0xF0)
                for x in held:
                    w.put(x, 1)
                run, held = run - 16, []
            if mag[k] > 1:
                held.append(mag[k] & 1)
                continue
            w.symbol(run << 4 | 1)
            w.put(int(b[k] > 0), 1)
            for x in held:
                w.put(x, 1)
            run, held = 0, []
        if run or held:
            w.symbol(0)
            for x in held:
                w.put(x, 1)
    return w.done()


def encode_progressive(rgb: np.ndarray) -> bytes:
    """A progressive file of nine scans with chroma halved both ways."""
    h, w = rgb.shape[:2]
    r, g, b = (rgb[..., i].astype(float) for i in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = [y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128]
    hh, ww = -(-h // 16) * 16, -(-w // 16) * 16
    comps = []
    for i, p in enumerate(planes):
        p = np.pad(p, ((0, hh - h), (0, ww - w)), mode="edge")
        if i:
            p = p.reshape(hh // 2, 2, ww // 2, 2).mean(axis=(1, 3))
        x = (p - 128).reshape(p.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3)
        q = np.round((DCT @ x @ DCT.T).reshape(*x.shape[:2], 64)[..., ZIGZAG] / QUANT).astype(int)
        comps.append(q)
    real = [q[: -(-(-(-h // s)) // 8), : -(-(-(-w // s)) // 8)].reshape(-1, 64).tolist() for q, s in zip(comps, (1, 2, 2))]
    seg = lambda m, body: bytes([0xFF, m]) + (len(body) + 2).to_bytes(2, "big") + body
    out = b"\xff\xd8" + seg(0xDB, b"\0" + QUANT.astype(np.uint8).tobytes())
    out += seg(0xC2, bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    out += seg(0xC4, b"\x00" + _FLAT_DC) + seg(0xC4, b"\x10" + _FLAT)
    order = [
        (i, q) for my in range(hh // 16) for mx in range(ww // 16)
        for i, q in [(0, comps[0][2 * my + v, 2 * mx + u]) for v in (0, 1) for u in (0, 1)] + [(1, comps[1][my, mx]), (2, comps[2][my, mx])]
    ]
    first, again, pred = _Writer(), _Writer(), [0, 0, 0]
    for i, q in order:
        v = int(q[0]) >> 1
        d, pred[i] = v - pred[i], v
        n = abs(d).bit_length()
        first.put(n, 5)
        if n:
            _magnitude(first, d, n)
        again.put(int(q[0]) & 1, 1)
    sos = lambda ids, ss, se, a: seg(0xDA, bytes([len(ids), *(x for i in ids for x in (i, 0)), ss, se, a]))
    out += sos((1, 2, 3), 0, 0, 0x01) + first.done()
    out += sos((1,), 1, 5, 0x02) + _ac_first(real[0], 1, 5, 2)
    out += sos((3,), 1, 63, 0x01) + _ac_first(real[2], 1, 63, 1) + sos((2,), 1, 63, 0x01) + _ac_first(real[1], 1, 63, 1)
    out += sos((1,), 6, 63, 0x02) + _ac_first(real[0], 6, 63, 2) + sos((1,), 1, 63, 0x21) + _ac_refine(real[0], 1, 63, 1)
    out += sos((1, 2, 3), 0, 0, 0x10) + again.done()
    for i in (3, 2, 1):
        out += sos((i,), 1, 63, 0x10) + _ac_refine(real[i - 1], 1, 63, 0)
    return out + b"\xff\xd9"


def rendered(vectors: DataFrame) -> DataFrame:
    """(vec_id, jpeg): a 24 x 16 progressive file drawn from each embedding and its label."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("label").cast("int").alias("label"))

    def run(batches):
        for batch in batches:
            out = []
            for e, label in zip(batch.column("embedding").to_pylist(), batch.column("label").to_pylist()):
                out.append(None if e is None else encode_progressive(picture(e, label)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "jpeg"])

    return rows.mapInArrow(run, "vec_id bigint, jpeg binary")


def picture(vector: list[float], label: int | None) -> np.ndarray:
    v = np.resize(np.nan_to_num(np.array([0 if x is None else x for x in vector] or [0], float)), 64).reshape(8, 8)
    grey = np.clip(128 + 300 * v, 0, 255).repeat(2, axis=0).repeat(3, axis=1)
    tint = np.array([(label or 0) * 37 % 96, (label or 0) * 61 % 96, (label or 0) * 17 % 96]) - 48
    ramp = np.linspace(0, 1, 24)[None, :, None]
    return np.clip(np.round(grey[..., None] + tint * ramp), 0, 255).astype(np.uint8)
