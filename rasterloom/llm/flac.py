"""Operator 10: FLAC columns. Bytes are kept as 8-bit mono samples (byte - 128) in the format of RFC 9639.

The decoder follows the seek table, so that frames from all texts of a batch are decoded side by side, one sample of
every frame at a time, in numpy: Rice residuals, fixed and linear predictors, constant and verbatim blocks. It checks
the CRC-8 of each frame header, the CRC-16 of each frame and the MD5 of the samples, and gives PCM blocks with the sample
offsets at which they start. The encoder picks the shortest of these forms for each block.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Samples of a block; frames and bytes of payload that are handled at once.
BLOCK = 192
FRAMES = 16_384
BYTES = 6 << 20
RATE = 8000
#: Order and coefficient bits of the encoder's linear predictor.
ORDER, PRECISION = 4, 9
#: Samples in a PCM block of the decoder's output.
PCM = 1 << 14


def _table(poly: int, width: int) -> np.ndarray:
    t, top = np.arange(256, dtype=np.uint32) << (width - 8), 1 << (width - 1)
    for _ in range(8):
        t = np.where(t & top, (t << 1) ^ poly, t << 1) & ((1 << width) - 1)
    return t


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)
#: Zeros before the first one in 16 bits.
_ZEROS = np.array([16, *(16 - x.bit_length() for x in range(1, 1 << 16))], np.int64)


class Corrupt(ValueError):
    """A checksum or a field of a stream is wrong."""


def crc(data: np.ndarray, start: np.ndarray, length: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """Checksums of the byte ranges, all ranges at once."""
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    c, mask, shift = np.zeros(len(start), np.uint32), np.uint32((1 << width) - 1), np.uint32(width - 8)
    upto = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")
    for i, n in enumerate(upto):
        c[:n] = ((c[:n] << np.uint32(8)) & mask) ^ table[(c[:n] >> shift) ^ data[start[:n] + i]]
    out = np.empty_like(c)
    out[order] = c
    return out


def _number(n: int) -> bytes:
    """A frame number as the format codes it."""
    if n < 128:
        return bytes([n])
    k = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    return bytes([(0xFF << (8 - k)) & 0xFF | n >> (6 * (k - 1)), *(0x80 | n >> (6 * j) & 63 for j in range(k - 2, -1, -1))])


def _levinson(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictor coefficients (frames, ORDER) and the shift of each frame."""
    x = s.astype(np.float32)
    x = x - x.mean(1, keepdims=True)
    r = np.stack([(x[:, j:] * x[:, : BLOCK - j]).sum(1) for j in range(ORDER + 1)], 1).astype(float)
    r[:, 0] = r[:, 0] * 1.0001 + 1
    a, e = np.zeros((len(s), ORDER)), r[:, 0].copy()
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / e
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        e *= 1 - k * k
    most = np.maximum(np.abs(a).max(1), 1e-3)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(most)).astype(int), 0, 15)
    top = (1 << (PRECISION - 1)) - 1
    return np.clip(np.round(a * (1 << shift)[:, None]), -top - 1, top).astype(np.int32), shift


def _frames(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The frames of blocks x (frames, BLOCK) as bytes end to end, and their lengths."""
    f = len(x)
    s = x.astype(np.int32) - 128
    coefs, shift = _levinson(s)
    guess = sum(coefs[:, j, None] * s[:, ORDER - 1 - j : BLOCK - 1 - j] for j in range(ORDER)) >> shift[:, None]
    residuals = [s, np.diff(s, axis=1), np.diff(s, 2, axis=1), s[:, ORDER:] - guess]
    orders, extra = (0, 1, 2, ORDER), (0, 0, 0, 9 + ORDER * PRECISION)
    folded, param, cost = [], [], []
    for r, o, e in zip(residuals, orders, extra):
        u = (r << 1) ^ (r >> 31)
        k0 = np.clip(np.log2(np.maximum(u.mean(1), 1)).astype(np.int32), 0, 14)
        bits = [((u >> k[:, None]).sum(1) + (1 + k) * u.shape[1]) for k in (k0, np.maximum(k0 - 1, 0))]
        folded.append(u)
        param.append(np.where(bits[1] < bits[0], np.maximum(k0 - 1, 0), k0))
        cost.append(np.minimum(*bits) + 8 * o + e + 10)
    cost += [np.full(f, 8 * BLOCK), np.where((s == s[:, :1]).all(1), 8, 1 << 30)]
    kind = np.argmin(np.stack(cost), 0)
    coded = [_number(int(n)) for n in numbers]
    heads = [b"\xff\xf8\x14\x02" + c for c in coded]  # 192 samples, 8 kHz, mono, 8 bits
    hl = np.array([len(h) for h in heads])
    flat = np.frombuffer(b"".join(heads), np.uint8)
    at = np.cumsum(hl) - hl
    c8 = crc(flat, at, hl, CRC8, 8)
    body = 8 + np.stack(cost)[kind, np.arange(f)]
    size = hl + 1 + (body + 7) // 8 + 2
    base = np.cumsum(size) - size
    bits = np.zeros(int(size.sum()) * 8, np.uint8)

    def put(pos, value, n):
        for b in range(n):
            bits[pos + b] = (value >> (n - 1 - b)) & 1

    for o, (u, k) in enumerate(zip(folded, param)):
        i = np.flatnonzero(kind == o)
        if not len(i):
            continue
        pos = (base[i] + hl[i] + 1) * 8
        put(pos, np.full(len(i), (8 + o) << 1 if o < 3 else (32 + ORDER - 1) << 1), 8)
        pos = pos + 8
        for j in range(orders[o]):
            put(pos, s[i, j], 8)
            pos = pos + 8
        if o == 3:
            put(pos, np.full(len(i), PRECISION - 1), 4)
            put(pos + 4, shift[i], 5)
            pos = pos + 9
            for j in range(ORDER):
                put(pos, coefs[i, j], PRECISION)
                pos = pos + PRECISION
        put(pos + 6, k[i], 4)  # method 0 and partition order 0 are six zero bits
        u, k = u[i], k[i][:, None]
        q = u >> k
        length = q + 1 + k
        p = (pos + 10)[:, None] + np.cumsum(length, 1) - length + q
        bits[p] = 1
        for b in range(int(k.max())):
            rows = np.flatnonzero(k[:, 0] > b)
            bits[p[rows] + k[rows] - b] = (u[rows] >> b) & 1
    i = np.flatnonzero(kind == 4)
    put((base[i] + hl[i] + 1) * 8, np.full(len(i), 2), 8)
    if len(i):
        bits[((base[i] + hl[i] + 2) * 8)[:, None] + np.arange(8 * BLOCK)] = np.unpackbits((s[i] & 255).astype(np.uint8), axis=1)
    i = np.flatnonzero(kind == 5)
    put((base[i] + hl[i] + 2) * 8, s[i, 0], 8)
    out = np.packbits(bits)
    within = np.arange(len(flat)) - np.repeat(at, hl)
    out[np.repeat(base, hl) + within] = flat
    out[base + hl] = c8
    c16 = crc(out, base, size - 2, CRC16, 16)
    out[base + size - 2], out[base + size - 1] = c16 >> 8, c16 & 255
    return out, size


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose length is a positive multiple of BLOCK. Each frame has a seek point."""
    n = np.array([len(p) // BLOCK for p in payloads])
    if any(len(p) % BLOCK or not p for p in payloads):
        raise ValueError(f"a payload must be a positive multiple of {BLOCK} bytes")
    x = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    numbers = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
    parts = [_frames(x[a : a + FRAMES], numbers[a : a + FRAMES]) for a in range(0, len(x), FRAMES)]
    data = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint8)
    size = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, int)
    ends = np.cumsum(size)
    out, f = [], 0
    for p, k in zip(payloads, n.tolist()):
        own = size[f : f + k]
        start = int(ends[f] - size[f])
        signed = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (RATE << 44 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        # A seek table holds 932,067 points at most; beyond, one point stands for several frames.
        step = -(-k // 900_000)
        seek = np.zeros((-(-k // step)), [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
        seek["sample"], seek["offset"], seek["n"] = np.arange(0, k, step) * BLOCK, (np.cumsum(own) - own)[::step], BLOCK
        seek = seek.tobytes()
        out.append(b"fLaC" + b"\0" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + data[start : start + int(own.sum())].tobytes())
        f += k
    return out


def _head(b: bytes):
    """Total samples, MD5, seek points (sample, offset) and the place of the first frame."""
    if b[:4] != b"fLaC":
        raise Corrupt("no FLAC stream")
    at, last, total, md5, seek = 4, False, 0, b"", np.zeros((0, 2), np.int64)
    while not last:
        last, kind, n = bool(b[at] & 128), b[at] & 127, int.from_bytes(b[at + 1 : at + 4], "big")
        own = b[at + 4 : at + 4 + n]
        if kind == 0:
            word = int.from_bytes(own[10:18], "big")
            total, md5 = word & (1 << 36) - 1, own[18:34]
            if word >> 41 & 7 or (word >> 36 & 31) != 7:
                raise Corrupt("only mono streams of 8 bits are kept here")
        elif kind == 3:
            t = np.frombuffer(own, [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
            t = t[t["sample"] != np.uint64((1 << 64) - 1)]  # placeholders
            seek = np.stack([t["sample"].astype(np.int64), t["offset"].astype(np.int64)], 1)
        at += 4 + n
    if not len(seek) or seek[0, 0]:
        seek = np.concatenate([np.zeros((1, 2), np.int64), seek])
    return total, md5, seek, at


class _Bits:
    """Big-endian bit fields at any places of a buffer, many places at once."""

    def __init__(self, data: np.ndarray):
        d = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
        self.word = (d[:-4] << 24) | (d[1:-3] << 16) | (d[2:-2] << 8) | d[3:-1]

    def ahead(self, pos):
        """32 bits from each place, the last up to seven of them zero."""
        return self.word[np.minimum(pos >> 3, len(self.word) - 1)] << (pos & 7).astype(np.uint32)

    def get(self, pos, n):
        """Unsigned fields of n bits (0 to 25; a number or an array)."""
        return ((self.ahead(pos) >> np.uint32(1)) >> np.asarray(31 - n).astype(np.uint32)).astype(np.int64)

    def signed(self, pos, n):
        v = self.get(pos, n)
        return v - ((v >> (n - 1)) << n)

    def unary(self, pos):
        """Zeros before the next one."""
        q = _ZEROS[self.ahead(pos) >> np.uint32(16)]
        more = np.flatnonzero(q == 16)
        limit = len(self.word) * 8
        while len(more):
            if (pos[more] + q[more]).max() > limit:
                raise Corrupt("a code runs over the end")
            z = _ZEROS[self.ahead(pos[more] + q[more]) >> np.uint32(16)]
            q[more] += z
            more = more[z == 16]
        return q


_SIZES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}
_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _decode(data: np.ndarray, bits: _Bits, start: np.ndarray):
    """Decodes the frames that start at these bytes: samples of each, and the byte after each."""
    def byte(at):
        return data[np.minimum(at, len(data) - 1)].astype(np.int64)

    if ((byte(start) != 0xFF) | (byte(start + 1) != 0xF8)).any():
        raise Corrupt("no frame where one should start")
    code, rate = byte(start + 2) >> 4, byte(start + 2) & 15
    if (byte(start + 3) & 0xF0).any() or (~np.isin(byte(start + 3) & 0x0F, (0, 2))).any():
        raise Corrupt("only mono frames of 8 bits are kept here")
    lead = byte(start + 4)
    ones = 8 - np.floor(np.log2(np.maximum(255 - lead.astype(int), 0.5))).astype(int) - 1  # leading ones of the frame number
    at = start + 4 + np.maximum(ones, 1)
    n = np.array([_SIZES.get(int(c), 0) for c in range(16)])[code]
    n = np.where(code == 6, byte(at).astype(int) + 1, np.where(code == 7, byte(at) * 256 + byte(at + 1).astype(int) + 1, n))
    at = at + (code == 6) + 2 * (code == 7) + (rate == 12) + 2 * ((rate == 13) | (rate == 14))
    if (n == 0).any() or (crc(data, start, at - start, CRC8, 8) != byte(at)).any():
        raise Corrupt("a frame header fails its CRC-8")
    kind = byte(at + 1) >> 1
    if (byte(at + 1) & 0x81).any():
        raise Corrupt("wasted bits or padding set in a subframe header")
    pos = (at + 2) * 8
    samples: list = [None] * len(start)
    end = np.zeros(len(start), np.int64)
    for k, size in {*zip(kind.tolist(), n.tolist())}:
        i = np.flatnonzero((kind == k) & (n == size))
        p, out = pos[i], np.zeros((size, len(i)), np.int64)
        if k == 0:
            out[:] = bits.signed(p, 8)
            p = p + 8
        elif k == 1:
            for t in range(size):
                out[t] = bits.signed(p, 8)
                p = p + 8
        elif 8 <= k <= 12 or k >= 32:
            order = k - 8 if k < 32 else k - 31
            for t in range(order):
                out[t] = bits.signed(p, 8)
                p = p + 8
            if k < 32:
                c, shift = [np.int64(x) for x in _FIXED[order]], 0
            else:
                precision, shift = bits.get(p, 4) + 1, bits.signed(p + 4, 5)
                p, c = p + 9, []
                for _ in range(order):
                    c.append(bits.signed(p, precision))
                    p = p + precision
                if (shift < 0).any():
                    raise Corrupt("a negative shift")
            wide = 4 + bits.get(p, 2)
            parts = bits.get(p + 2, 4)
            if (wide > 5).any() or (parts != parts[0]).any() and len(set(parts.tolist())) > 1:
                p = _mixed(bits, p, out, order, wide, parts, size)
            else:
                p = _residual(bits, p + 6, out, order, wide, int(parts[0]), size)
            for t in range(order, size):
                if order:
                    out[t] += sum(c[j] * out[t - 1 - j] for j in range(order)) >> shift
        else:
            raise Corrupt("a reserved kind of subframe")
        if (np.abs(out * 2 + 1) > 255).any():
            raise Corrupt("a sample outside 8 bits")
        own = (out.T + 128).astype(np.uint8)
        for row, j in enumerate(i.tolist()):
            samples[j] = own[row]
        end[i] = (p + 7) >> 3
    if (crc(data, start, end - start, CRC16, 16) != byte(end) * np.uint32(256) + byte(end + 1)).any() or (end + 2 > len(data)).any():
        raise Corrupt("a frame fails its CRC-16")
    return samples, end + 2


def _residual(bits, p, out, order, wide, parts: int, size: int):
    """Rice residuals of frames with equally many partitions, into out from row ``order`` on."""
    if size % (1 << parts) or size >> parts < order:
        raise Corrupt("partitions that don't fit the block")
    t = order
    for part in range(1 << parts):
        k = bits.get(p, wide)
        p = p + wide
        escaped = k == (1 << wide) - 1
        raw = np.where(escaped, bits.get(p, 5), 0)
        p = p + 5 * escaped
        for _ in range((size >> parts) - order * (part == 0)):
            if escaped.any():
                i, e = np.flatnonzero(~escaped), np.flatnonzero(escaped)
                q = np.zeros_like(p)
                q[i] = bits.unary(p[i])
                u = (q << np.where(escaped, 0, k)) | bits.get(p + q + 1, np.where(escaped, 0, k))
                out[t] = (u >> 1) ^ -(u & 1)
                out[t, e] = np.where(raw[e] > 0, bits.signed(p[e], np.maximum(raw[e], 1)), 0)
                p = p + np.where(escaped, raw, q + 1 + k)
            else:
                q = bits.unary(p)
                p = p + q + 1
                u = (q << k) | bits.get(p, k)
                out[t] = (u >> 1) ^ -(u & 1)
                p = p + k
            t += 1
    return p


def _mixed(bits, p, out, order, wide, parts, size):
    """As _residual, for frames that differ in their numbers of partitions."""
    if (wide > 5).any():
        raise Corrupt("a reserved residual method")
    end = np.zeros_like(p)
    for x in {*parts.tolist()}:
        i = np.flatnonzero(parts == x)
        own = out[:, i]
        end[i] = _residual(bits, p[i] + 6, own, order, wide[i], x, size)
        out[:, i] = own
    return end


def decode(streams: list[bytes]) -> list[bytes]:
    """The samples of each stream as bytes (sample + 128). Raises Corrupt where a checksum or a field is wrong."""
    heads = [_head(b) for b in streams]
    data = np.frombuffer(b"".join(streams), np.uint8)
    bits = _Bits(data)
    at = np.cumsum([0, *map(len, streams)])[:-1]
    # A lane decodes from one seek point to the next.
    owner = np.repeat(np.arange(len(heads)), [len(h[2]) for h in heads])
    first = np.array([h[3] for h in heads], np.int64) + at
    begin = np.concatenate([h[2][:, 1] for h in heads]) + first[owner] if heads else np.zeros(0, np.int64)
    stop = np.append(begin[1:], len(data))
    ends = np.array([a + len(b) for a, b in zip(at, streams)], np.int64)
    stop = np.where(np.append(owner[1:] != owner[:-1], True), ends[owner], stop) if len(owner) else stop
    got: list[list] = [[] for _ in begin]
    lanes, pos = np.flatnonzero(begin < stop), begin.copy()
    while len(lanes):
        for a in range(0, len(lanes), FRAMES):
            own = lanes[a : a + FRAMES]
            samples, pos[own] = _decode(data, bits, pos[own])
            for j, s in zip(own.tolist(), samples):
                got[j].append(s)
        if (pos[lanes] > stop[lanes]).any():
            raise Corrupt("a frame runs over its seek point")
        lanes = lanes[pos[lanes] < stop[lanes]]
    out, lane = [], 0
    for (total, md5, seek, _), _ in zip(heads, streams):
        own = [s for j in range(lane, lane + len(seek)) for s in got[j]]
        lane += len(seek)
        x = np.concatenate(own) if own else np.zeros(0, np.uint8)
        if total and len(x) != total:
            raise Corrupt(f"{len(x)} samples, not {total}")
        if any(md5) and hashlib.md5((x ^ 0x80).tobytes()).digest() != md5:
            raise Corrupt("the samples fail their MD5")
        out.append(x.tobytes())
    return out


def pcm_blocks(samples: bytes, size: int = PCM) -> list[tuple[int, int, bytes]]:
    """(sample offset, samples, PCM bytes) of each block."""
    return [(a, len(samples[a : a + size]), samples[a : a + size]) for a in range(0, len(samples), size)]


def feature(samples: bytes) -> str:
    """Whole numbers of the signal: samples, sum, energy, sign changes, peak."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    return f"n={len(x)};sum={x.sum()};energy={(x * x).sum()};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};peak={int(np.abs(x).max(initial=0))}"


def payload(text: str | None) -> tuple[int, bytes]:
    """Unpadded length, and the UTF-8 bytes with spaces up to a positive multiple of BLOCK."""
    b = (text or "").encode()
    return len(b), b.ljust(max(BLOCK, -(-len(b) // BLOCK) * BLOCK))


def _pieces(texts):
    """Rows in turn, as many as fit BYTES, one at least."""
    a, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) * 2 if t else 0
        if i > a and held + n > BYTES:
            yield a, i
            a, held = i, 0
        held += n
    if a < len(texts):
        yield a, len(texts)


def encode_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and flac, the stream of each text. Null text counts as empty: one block of spaces."""

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for a, z in _pieces(texts):
                p = [payload(t) for t in texts[a:z]]
                yield pa.RecordBatch.from_arrays([ids.slice(a, z - a), pa.array([x[0] for x in p], pa.int64()), pa.array(encode([x[1] for x in p]), pa.binary())], names=["doc_id", "n_bytes", "flac"])

    return common.take(docs).select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, flac binary")


def decode_column(media: DataFrame, size: int = PCM) -> DataFrame:
    """(doc_id, sample_offset, n_samples, pcm): a row for each PCM block of each stream in media (doc_id, flac).

    A reader seeks to a sample by the block with the largest sample_offset that isn't above it. A null stream gives no row.
    """

    def run(batches):
        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                blocks = pcm_blocks(decode([x])[0], size) if x is not None else []
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(blocks), pa.int64()), pa.array([k[0] for k in blocks], pa.int64()), pa.array([k[1] for k in blocks], pa.int64()), pa.array([k[2] for k in blocks], pa.binary())], names=["doc_id", "sample_offset", "n_samples", "pcm"])

    return media.select("doc_id", "flac").mapInArrow(run, "doc_id bigint, sample_offset bigint, n_samples bigint, pcm binary")


def round_trip(docs: DataFrame) -> DataFrame:
    """Stores each text as FLAC, reads it back block by block and describes what was read; one row for each row of docs.

    Encoding and decoding share a task, so that the streams of a corpus needn't be shuffled or kept twice.
    """
    kinds = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_blocks bigint"
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for a, z in _pieces(texts):
                p = [payload(t) for t in texts[a:z]]
                streams = encode([x[1] for x in p])
                cols: list[list] = [[] for _ in names]
                for d, (n, _), flac, read in zip(ids[a:z], p, streams, decode(streams)):
                    blocks = pcm_blocks(read)
                    sha, last = hashlib.sha256(), b""
                    for _, _, pcm in blocks:
                        sha.update(pcm)
                        last = (last + pcm[-16:])[-16:]
                    size = blocks[-1][0] + blocks[-1][1]
                    row = (d, n, size, sha.hexdigest(), zlib.crc32(last), len(flac), hashlib.sha256(flac).hexdigest(), feature(read), len(blocks))
                    for c, v in zip(cols, row):
                        c.append(v)
                yield pa.RecordBatch.from_pydict({k: pa.array(c, pa.string() if k in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for k, c in zip(names, cols)})

    return common.take(docs).select("doc_id", "text").mapInArrow(run, kinds)
