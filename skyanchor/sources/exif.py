"""Reading JPEG metadata from the head of a file: size, EXIF directories, XMP packet; pixels are never decoded."""

from __future__ import annotations

import math
import struct

FILM_WIDTH_MM = 36.0
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
MAKE, MODEL, DATETIME, EXIF_AT, GPS_AT, ORIGINAL, FOCAL_35 = 0x010F, 0x0110, 0x0132, 0x8769, 0x8825, 0x9003, 0xA405


def directory(tiff: bytes, at: int, order: str) -> dict[int, object]:
    """The entries of the image file directory at a place: tag -> text, number or tuple of numbers; broken ones are left out."""
    out: dict[int, object] = {}
    if at + 2 > len(tiff):
        return out
    for k in range(struct.unpack_from(order + "H", tiff, at)[0]):
        p = at + 2 + 12 * k
        if p + 12 > len(tiff):
            break
        tag, kind, count = struct.unpack_from(order + "HHI", tiff, p)
        size = _SIZES.get(kind, 0) * count
        start = p + 8 if size <= 4 else struct.unpack_from(order + "I", tiff, p + 8)[0]
        if not size or start + size > len(tiff):
            continue
        if kind in (2, 7):
            out[tag] = tiff[start : start + size].split(b"\0")[0].decode("utf-8", "replace").strip()
            continue
        if kind in (5, 10):
            parts = struct.unpack_from(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", tiff, start)
            values = tuple(n / d if d else None for n, d in zip(parts[::2], parts[1::2]))
        else:
            values = struct.unpack_from(f"{order}{count}{_CODES[kind]}", tiff, start)
        out[tag] = values[0] if count == 1 else values
    return out


def _degrees(parts, ref) -> float | None:
    if not isinstance(parts, tuple) or len(parts) != 3 or None in parts:
        return None
    v = parts[0] + parts[1] / 60 + parts[2] / 3600
    return -v if ref in ("S", "W") else v


def read(head: bytes) -> dict[str, object]:
    """What the head of a JPEG file tells: width, height, model, taken, focal_35mm, fov_deg, lat, lon, absolute_m, packet, and whether its metadata is complete."""
    out: dict[str, object] = dict.fromkeys(("width", "height", "model", "taken", "focal_35mm", "fov_deg", "lat", "lon", "absolute_m", "packet"))
    out["complete"] = False
    if head[:2] != b"\xff\xd8":
        return out
    at = 2
    while at + 4 <= len(head) and head[at] == 0xFF:
        marker, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        if marker == 0xFF:
            at += 1
            continue
        body = head[at + 4 : at + 2 + size]
        if marker == 0xDA:
            out["complete"] = True
            break
        if len(body) < size - 2:
            break
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
            out["height"], out["width"] = struct.unpack_from(">HH", body, 1)
        elif marker == 0xE1 and body[:6] == b"Exif\0\0":
            _exif(body[6:], out)
        elif marker == 0xE1 and b"<x:xmpmeta" in body and b"</x:xmpmeta>" in body:
            out["packet"] = body[body.index(b"<x:xmpmeta") : body.index(b"</x:xmpmeta>") + 12].decode("utf-8", "replace")
        at += 2 + size
    return out


def _exif(tiff: bytes, out: dict[str, object]) -> None:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return
    main = directory(tiff, struct.unpack_from(order + "I", tiff, 4)[0], order)
    own = directory(tiff, main[EXIF_AT], order) if isinstance(main.get(EXIF_AT), int) else {}
    gps = directory(tiff, main[GPS_AT], order) if isinstance(main.get(GPS_AT), int) else {}
    out["model"] = main.get(MODEL) or None
    out["taken"] = own.get(ORIGINAL) or main.get(DATETIME) or None
    focal = own.get(FOCAL_35)
    if isinstance(focal, (int, float)) and focal > 0:
        out["focal_35mm"], out["fov_deg"] = float(focal), 2 * math.degrees(math.atan(FILM_WIDTH_MM / 2 / focal))
    out["lat"], out["lon"] = _degrees(gps.get(2), gps.get(1)), _degrees(gps.get(4), gps.get(3))
    if isinstance(gps.get(6), float):
        out["absolute_m"] = -gps[6] if gps.get(5) in (1, "\x01") else gps[6]


def write(width: int, height: int, *, model: str = "", taken: str = "", focal_35mm: int | None = None, lat: float | None = None, lon: float | None = None, absolute_m: float | None = None, packet: str = "", order: str = "<") -> bytes:
    """The head of a JPEG file with such metadata, up to where its pixels would begin."""

    def dms(v: float):
        v = abs(v)
        d, m = int(v), int(v % 1 * 60)
        return (5, [(d, 1), (m, 1), (round(((v - d) * 60 - m) * 60 * 10**6), 10**6)])

    def pack(entries, base: int, pointers: dict[int, int]) -> bytes:
        entries = sorted(entries.items())
        body, tail = struct.pack(order + "H", len(entries)), b""
        at = base + 2 + 12 * len(entries) + 4
        for tag, (kind, value) in entries:
            if kind == 2:
                raw, n = value.encode() + b"\0", len(value.encode()) + 1
            elif kind == 5:
                raw, n = b"".join(struct.pack(order + "II", *v) for v in value), len(value)
            else:
                raw, n = struct.pack(order + _CODES[kind], pointers.get(tag, value)), 1
            if len(raw) > 4:
                body += struct.pack(order + "HHII", tag, kind, n, at + len(tail))
                tail += raw + b"\0" * (len(raw) % 2)
            else:
                body += struct.pack(order + "HHI", tag, kind, n) + raw.ljust(4, b"\0")
        return body + struct.pack(order + "I", 0) + tail

    own = {FOCAL_35: (3, focal_35mm)} if focal_35mm else {}
    if taken:
        own[ORIGINAL] = (2, taken)
    gps = {}
    if lat is not None and lon is not None:
        gps = {1: (2, "N" if lat >= 0 else "S"), 2: dms(lat), 3: (2, "E" if lon >= 0 else "W"), 4: dms(lon)}
    if absolute_m is not None:
        gps |= {5: (1, int(absolute_m < 0)), 6: (5, [(round(abs(absolute_m) * 1000), 1000)])}
    main = {MODEL: (2, model), EXIF_AT: (4, 0), GPS_AT: (4, 0)}
    first = len(pack(main, 8, {}))
    second = len(pack(own, 8 + first, {}))
    pointers = {EXIF_AT: 8 + first, GPS_AT: 8 + first + second}
    tiff = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + pack(main, 8, pointers) + pack(own, 8 + first, {}) + pack(gps, 8 + first + second, {})
    seg = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
    out = b"\xff\xd8" + seg(0xE1, b"Exif\0\0" + tiff)
    if packet:
        out += seg(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + packet.encode())
    return out + seg(0xC0, bytes([8]) + struct.pack(">HH", height, width) + bytes([1, 1, 0x11, 0])) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + b"\xff\xd9"
