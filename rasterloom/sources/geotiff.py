"""GeoTIFF in numpy: strips and tiles, no compression, deflate or PackBits, horizontal prediction, and the tags that place a raster.

What a file can hold beyond that (BigTIFF, LZW, JPEG, floating-point prediction) is refused by name, and a damaged file raises
Damaged; neither gives wrong pixels.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np


class Damaged(ValueError):
    """Not a TIFF file, or one that is cut off or contradicts itself."""


@dataclass
class Raster:
    """Pixels (height, width, bands) and what places them: transform (x0, dx, rx, y0, ry, dy), EPSG code, nodata, GDAL metadata, GCPs
    (line, sample, x, y)."""

    pixels: np.ndarray
    transform: tuple | None = None
    epsg: int | None = None
    nodata: float | None = None
    metadata: str | None = None
    gcps: list = field(default_factory=list)


# Fixed values of the TIFF 6.0 and GeoTIFF formats: tag numbers, bytes and codes of field types, sample formats.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, SIZES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, FORMAT = 317, 322, 323, 324, 325, 339
SCALE, TIEPOINTS, MATRIX, KEYS, METADATA, NODATA = 33550, 33922, 34264, 34735, 42112, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
NONE, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 8, 32946, 32773
KINDS = {1: "u", 2: "i", 3: "f"}
GEOGRAPHIC, PROJECTED = 2048, 3072


def _unpacked(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            out += b"" if n == 128 else data[i + 1 : i + 2] * (257 - n)
            i += 1 if n == 128 else 2
    return bytes(out)


def _tags(content: bytes) -> tuple[str, dict]:
    if len(content) < 8 or content[:2] not in (b"II", b"MM"):
        raise Damaged("no TIFF header")
    order = "<" if content[:2] == b"II" else ">"
    magic, at = struct.unpack_from(f"{order}HI", content, 2)
    if magic == 43:
        raise NotImplementedError("BigTIFF")
    if magic != 42:
        raise Damaged("no TIFF header")
    tags = {}
    try:
        (n,) = struct.unpack_from(f"{order}H", content, at)
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", content, at + 2 + 12 * k)
            if kind not in TYPES:
                continue
            size = struct.calcsize(f"{order}{TYPES[kind]}") * count
            place = at + 10 + 12 * k
            if size > 4:
                (place,) = struct.unpack_from(f"{order}I", content, place)
            if place + size > len(content):
                raise Damaged(f"tag {tag} lies outside the file")
            tags[tag] = content[place : place + size].rstrip(b"\0").decode("latin-1") if kind == 2 else struct.unpack_from(f"{order}{TYPES[kind] * count}", content, place)
    except struct.error as e:
        raise Damaged(str(e)) from e
    return order, tags


def decode(content: bytes) -> Raster:
    """The first image of a file."""
    order, tags = _tags(content)
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    if WIDTH not in tags or HEIGHT not in tags:
        raise Damaged("no image size")
    width, height, bands = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits = set(tags.get(BITS, (1,)))
    if len(bits) > 1 or bits & {1, 2, 4}:
        raise NotImplementedError(f"samples of {sorted(bits)} bits")
    try:
        dtype = np.dtype(f"{order}{KINDS[one(FORMAT, 1)]}{bits.pop() // 8}")
    except (KeyError, TypeError) as e:
        raise NotImplementedError("sample format") from e
    compression, predictor, apart = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1) == 2
    if compression not in (NONE, DEFLATE, OLD_DEFLATE, PACKBITS):
        raise NotImplementedError(f"compression {compression}")
    if predictor not in (1, 2) or predictor == 2 and dtype.kind == "f":
        raise NotImplementedError(f"predictor {predictor}")
    tiled = TILE_OFFSETS in tags
    w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS, height), height))
    offsets, sizes = (tags.get(TILE_OFFSETS), tags.get(TILE_SIZES)) if tiled else (tags.get(OFFSETS), tags.get(SIZES))
    if not w or not h or not offsets or not sizes:
        raise Damaged("no strips or tiles")
    across, down = -(-width // w), -(-height // h)
    if len(offsets) != across * down * (bands if apart else 1) or len(sizes) != len(offsets):
        raise Damaged("strips or tiles are missing")
    out = np.zeros((height, width, bands), dtype.newbyteorder("="))
    for k, (at, size) in enumerate(zip(offsets, sizes)):
        data = content[at : at + size]
        if len(data) < size:
            raise Damaged("the file is cut off")
        try:
            data = zlib.decompress(data) if compression in (DEFLATE, OLD_DEFLATE) else _unpacked(data) if compression == PACKBITS else data
        except zlib.error as e:
            raise Damaged(str(e)) from e
        band, place = divmod(k, across * down) if apart else (None, k)
        y, x = place // across * h, place % across * w
        lines, each = h if tiled else min(h, height - y), 1 if apart else bands
        if len(data) < lines * w * each * dtype.itemsize:
            raise Damaged("a strip or tile is too short")
        block = np.frombuffer(data, dtype, lines * w * each).reshape(lines, w, each)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=dtype.newbyteorder("="))
        block = block[: height - y, : width - x]
        part = out[y : y + block.shape[0], x : x + block.shape[1]]
        if apart:
            part[:, :, band] = block[:, :, 0]
        else:
            part[:] = block
    keys = tags.get(KEYS, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    points = [tags[TIEPOINTS][i : i + 6] for i in range(0, len(tags.get(TIEPOINTS, ())) - 5, 6)]
    transform = None
    if MATRIX in tags:
        m = tags[MATRIX]
        transform = (m[3], m[0], m[1], m[7], m[4], m[5])
    elif SCALE in tags and points:
        (px, py, _, x, y, _), (sx, sy, *_) = points[0], tags[SCALE]
        transform = (x - px * sx, sx, 0.0, y + py * sy, 0.0, -sy)
    try:
        nodata = float(tags[NODATA]) if NODATA in tags else None
    except ValueError:
        nodata = None
    gcps = [] if transform else [(p[1], p[0], p[3], p[4]) for p in points]
    return Raster(out, transform, codes.get(PROJECTED, codes.get(GEOGRAPHIC)), nodata, tags.get(METADATA), gcps)


def encode(r: Raster, rows: int = 64, geographic: bool = True) -> bytes:
    """A little-endian file of deflated strips."""
    a = np.ascontiguousarray(r.pixels if r.pixels.ndim == 3 else r.pixels[:, :, None])
    a = a.astype(a.dtype.newbyteorder("<"))
    height, width, bands = a.shape
    strips = [zlib.compress(a[y : y + rows].tobytes(), 6) for y in range(0, height, rows)]
    kind = {v: k for k, v in KINDS.items()}[a.dtype.kind]
    tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8 * a.dtype.itemsize] * bands), (COMPRESSION, 3, [DEFLATE]), (PHOTOMETRIC, 3, [1]),
            (SAMPLES, 3, [bands]), (ROWS, 4, [rows]), (PLANAR, 3, [1]), (FORMAT, 3, [kind] * bands), (SIZES, 4, [len(s) for s in strips])]
    if r.transform:
        x0, dx, rx, y0, ry, dy = r.transform
        tags.append((MATRIX, 12, [dx, rx, 0.0, x0, ry, dy, 0.0, y0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]))
    elif r.gcps:
        tags.append((TIEPOINTS, 12, [float(v) for line, sample, x, y in r.gcps for v in (sample, line, 0, x, y, 0)]))
    if r.epsg:
        key, model = (GEOGRAPHIC, 2) if geographic else (PROJECTED, 1)
        tags.append((KEYS, 3, [1, 1, 0, 3, 1024, 0, 1, model, 1025, 0, 1, 1, key, 0, 1, r.epsg]))
    for tag, text in ((METADATA, r.metadata), (NODATA, None if r.nodata is None else repr(float(r.nodata)))):
        if text is not None:
            tags.append((tag, 2, text.encode("latin-1") + b"\0"))
    tags.append((OFFSETS, 4, [0] * len(strips)))
    tags.sort()
    entries, extra = [], bytearray()
    base = 8 + 2 + 12 * len(tags) + 4
    pack = lambda kind, v: bytes(v) if kind == 2 else struct.pack(f"<{TYPES[kind] * len(v)}", *v)
    after = base + sum(len(b) + len(b) % 2 for b in (pack(k, v) for _, k, v in tags) if len(b) > 4)
    starts = np.cumsum([0, *(len(s) for s in strips[:-1])]) + after
    for tag, k, v in tags:
        b = pack(k, [int(s) for s in starts] if tag == OFFSETS else v)
        if len(b) > 4:
            value = struct.pack("<I", base + len(extra))
            extra += b + b"\0" * (len(b) % 2)
        else:
            value = b.ljust(4, b"\0")
        entries.append(struct.pack("<HHI", tag, k, len(v)) + value)
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + b"".join(entries) + b"\0\0\0\0" + bytes(extra) + b"".join(strips)
