"""Operator 5: line dedup with two Bloom filters.

Each scan task adds the hashes of its line keys to a once-seen and a twice-seen filter; the filters of all tasks are
merged slice by slice. Only lines that the twice-seen filter suspects are shuffled, to confirm by exact counts of
their keys' digests (128 bits of SHA-256) and to choose the first occurrence; all others, most lines of a corpus, never leave their task.

The filters have one hash function over BITS bits at most, cut into slices that different tasks merge. A false positive
costs one shuffled row and never changes a result. Beyond some BITS lines everything is suspected: the operator then
shuffles a digest and an id a line, 24 bytes whatever its length, and stays exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bits of the twice-seen filter that is broadcast, at most (16 MB; fewer for small inputs), and slices that are merged apart.
BITS = 1 << 27
SLICES = 64
#: Neighbouring positions that share a bit of the filter of hot ones.
FOLD = 16
#: Positions that a scan task holds before it writes them out, and rows that it hashes at once.
FLUSH = 1_000_000
ROWS = 1_000
#: Keys that may be broadcast (16 bytes each, in a worker too).
BAD_KEYS = 1_000_000


def key(line: bytes) -> bytes:
    """Stripped of ASCII white space at both ends, A-Z in lower case."""
    return line.strip(common.SPACE_BYTES).lower()


def keys_of(text: str | None, least: int) -> list[bytes]:
    """The line keys of a text in order; those of fewer than ``least`` code points are empty."""
    out = [key(x) for x in (text or "").encode().split(b"\n")]
    if least > 1:
        out = [k if len(k) >= least and len(k.decode()) >= least else b"" for k in out]
    return out


def sized(keys: float, most: int = BITS, each: int = 5) -> int:
    """Bits of a filter for that many keys, so many for each, up to ``most``; a multiple of what slices and folds need."""
    unit = 8 * SLICES * FOLD
    return min(most, unit * max(1, math.ceil(each * keys / unit)))


def bits_for(docs: DataFrame) -> int:
    """Bits of a filter for the lines of docs, at 32 bytes a line: one scan of lengths."""
    return sized((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 32)


def positions(hashes, bits: int) -> np.ndarray:
    return (((np.asarray(hashes, np.uint64) >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def packed(pos: np.ndarray, bits: int, counted: bool = False):
    """(slice, positions, counts of 2 or more as flags) for each slice that has any. pos: one entry a document and key.

    counted: the counts themselves in place of flags, as 16 bits that stop at their greatest.
    """
    pos, n = np.unique(pos, return_counts=True)
    width = bits // SLICES
    at = np.searchsorted(pos, np.arange(SLICES + 1, dtype=np.int64) * width)
    for s in range(SLICES):
        a, b = at[s], at[s + 1]
        if b > a:
            more = np.minimum(n[a:b], 0xFFFF).astype("<u2") if counted else np.packbits(n[a:b] > 1)
            yield s, (pos[a:b] - np.uint32(s * width)).tobytes(), more.tobytes()


def merged(rows, bits: int) -> bytes:
    """The twice-seen bits of one slice: seen twice by a task, or once by two tasks."""
    once, twice = np.zeros(bits // SLICES, bool), np.zeros(bits // SLICES, bool)
    for pos, more in rows:
        p = np.frombuffer(pos, np.uint32)
        twice[p] |= once[p] | np.unpackbits(np.frombuffer(more, np.uint8), count=len(p)).astype(bool)
        once[p] = True
    return np.packbits(twice).tobytes()


def merged_counts(rows, bits: int, hot: int) -> bytes:
    """The twice-seen bits of one slice, and after them those of positions seen more than ``hot`` times, FOLD positions a bit."""
    total = np.zeros(bits // SLICES, np.uint32)
    for pos, more in rows:
        p, n = np.frombuffer(pos, np.uint32), np.frombuffer(more, "<u2")
        total[p] += np.minimum(n, np.uint32(0xFFFFFFFF) - total[p])
    return np.packbits(total > 1).tobytes() + np.packbits((total > hot).reshape(-1, FOLD).any(1)).tobytes()


def twice_filter(df: DataFrame, hashes_of, bits: int = BITS, hot: int | None = None) -> bytearray | tuple[bytearray, bytearray]:
    """The merged filter of a frame with one column, so many bits: bounded, so it may go through the driver.

    hashes_of(values) gives the 64-bit hashes of an Arrow array of the column, as often as they are to be counted.
    hot: also the filter of positions seen more than that often, bits / FOLD bits.
    """

    def scan(batches):
        held, n = [], 0

        def out():
            rows = list(packed(np.concatenate(held), bits, hot is not None)) if held else []
            return pa.RecordBatch.from_pydict({"s": pa.array([r[0] for r in rows], pa.int32()), "pos": pa.array([r[1] for r in rows], pa.binary()), "more": pa.array([r[2] for r in rows], pa.binary())})

        for b in batches:
            for a in range(0, b.num_rows, ROWS):
                p = positions(hashes_of(b.column(0).slice(a, ROWS)), bits)
                held.append(p)
                n += len(p)
                if n >= FLUSH:
                    yield out()
                    held, n = [], 0
        yield out()

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                yield from zip(b.column("pos").to_pylist(), b.column("more").to_pylist())

        got = merged(rows(), bits) if hot is None else merged_counts(rows(), bits, hot)
        yield pa.RecordBatch.from_pydict({"s": pa.array([key[0].as_py()], pa.int32()), "twice": pa.array([got], pa.binary())})

    parts = df.mapInArrow(scan, "s int, pos binary, more binary")
    found = parts.groupBy("s").applyInArrow(merge, "s int, twice binary").collect()  # SLICES rows at most, that many bits in all
    size = bits // 8 // SLICES
    out, often = bytearray(size * SLICES), bytearray(size // FOLD * SLICES)
    while found:
        r = found.pop()
        out[r.s * size : (r.s + 1) * size] = r.twice[:size]
        if hot is not None:
            often[r.s * size // FOLD : (r.s + 1) * size // FOLD] = r.twice[size:]
    return out if hot is None else (out, often)


def seen_twice(bitmap: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return (bitmap[pos >> np.uint32(3)] >> (np.uint32(7) - (pos & np.uint32(7))).astype(np.uint8)) & np.uint8(1) > 0


def digest(k: bytes) -> bytes:
    return hashlib.sha256(k).digest()[:16]


def text_hash(docs: DataFrame):
    """The row's text as 64 bits: equal texts have equal lines, so rows meet their own keys by it, with or without an id."""
    return F.xxhash64(F.coalesce(common.column(docs, "text", "string"), F.lit("")))


def suspects(docs: DataFrame, least: int, bits: int) -> DataFrame:
    """(digest, doc_id, text_hash) of the line keys that the twice-seen filter suspects: one row a document and key."""
    spark = docs.sparkSession
    own = docs.select(column_text(docs), common.column(docs, "doc_id", "bigint").alias("doc_id"), text_hash(docs).alias("text_hash"))
    hashes = lambda texts: [xxhash.xxh3_64_intdigest(k) for t in texts for k in {*keys_of(t.as_py(), least)} - {b""}]
    twice = spark.sparkContext.broadcast(twice_filter(own.select("text"), hashes, bits))

    def scan(batches):
        bitmap = np.frombuffer(twice.value, np.uint8)
        for b in common.sliced(batches):
            at, found = [], []
            for i, t in enumerate(b.column(0)):
                ks = list({*keys_of(t.as_py(), least)} - {b""})
                if ks:
                    hit = seen_twice(bitmap, positions([xxhash.xxh3_64_intdigest(k) for k in ks], bits))
                    more = [digest(k) for k, h in zip(ks, hit) if h]
                    found += more
                    at += [i] * len(more)
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), b.column(1).take(at), b.column(2).take(at)], names=["digest", "doc_id", "text_hash"])

    return own.mapInArrow(scan, "digest binary, doc_id bigint, text_hash bigint")


def repeated_keys(docs: DataFrame, min_docs: int, least: int = 1, bits: int | None = None) -> DataFrame:
    """digest, n_docs and first_doc of the keys in at least min_docs rows of docs, counted exactly."""
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more: a key in one document is no repeat")
    sus = suspects(docs, least, bits or bits_for(docs))
    # Partial counts run in each scan task before the shuffle, so a line that a third of the documents hold is no hot key.
    return sus.groupBy("digest").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc")).where(F.col("n_docs") >= min_docs)


def table_of(digests: list[bytes]) -> bytes:
    """Digests in order, 16 bytes each: what is broadcast, and searched by halves."""
    return b"".join(sorted(digests))


def among(digests: list[bytes], table: np.ndarray) -> np.ndarray:
    """Which of the digests are in the table, as rows of two big-endian words."""
    d = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
    if not len(table) or not len(d):
        return np.zeros(len(d), bool)
    lo, hi = (np.searchsorted(table[:, 0], d[:, 0], side=s) for s in ("left", "right"))
    found = np.zeros(len(d), bool)
    # Digests that share their first half, by chance hardly ever, are tried one after the other.
    while (open_ := (lo < hi) & ~found).any():
        found[open_] = table[lo[open_], 1] == d[open_, 1]
        lo = lo + 1
    return found


def _cut(text: str | None, bad, least: int):
    lines = (text or "").encode().split(b"\n")
    keys = keys_of(text, least)
    some = [i for i, k in enumerate(keys) if k]
    gone = {i for i, hit in zip(some, bad([digest(keys[i]) for i in some])) if hit}
    keep = [x for i, x in enumerate(lines) if i not in gone] if gone else lines
    return len(lines), len(gone), b"\n".join(keep)


def dedup_lines(docs: DataFrame, min_docs: int = 10, least: int = 1, bits: int | None = None, bad_keys: int = BAD_KEYS) -> DataFrame:
    """All columns of docs with text replaced by the lines that stay, and n_lines, n_dropped (long).

    Keys of at least ``least`` code points in min_docs or more rows of docs lose all their lines. Null or empty text is
    one empty line, which always stays; a text that loses all its lines becomes empty. Each row counts as a document
    of its own, also where doc_ids repeat or are null. An empty table gives an empty table. Columns named n_lines or n_dropped are
    replaced.
    """
    spark = docs.sparkSession
    bits = bits or bits_for(docs)
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    bad = common.written(repeated_keys(docs, min_docs, least, bits).select("digest"), "lines")
    n = bad.count()
    plain = F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest")
    schema = "n_lines bigint, n_dropped bigint, text string"
    left = docs.select(plain, column_text(docs), text_hash(docs).alias("text_hash"))
    if n <= bad_keys:
        table = spark.sparkContext.broadcast(table_of([bytes(r.digest) for r in bad.collect()]))  # n was checked
        src = left.select("rest", "text")
    else:
        # Too many for a broadcast: each text gets the bad keys among its own suspects, partial sets first.
        sus = suspects(docs, least, bits).select("text_hash", "digest")
        own = sus.join(bad, "digest", "left_semi").groupBy(F.col("text_hash").alias("of")).agg(F.collect_set("digest").alias("own"))
        table = None
        src = left.join(own.hint("merge"), F.col("text_hash") == F.col("of"), "left").select("rest", "text", "own")

    def cut(batches):
        every = None if table is None else np.frombuffer(table.value, ">u8").reshape(-1, 2).astype(np.uint64)
        for b in common.sliced(batches):
            got = []
            for i, t in enumerate(b.column(1)):
                if every is None:
                    own = set(b.column(2)[i].as_py() or ())
                    bad = lambda ds, own=own: [d in own for d in ds]
                else:
                    bad = lambda ds: among(ds, every)
                got.append(_cut(t.as_py(), bad, least))
            cols = [b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2].decode() for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["rest", "n_lines", "n_dropped", "text"])

    kind = src.schema["rest"].dataType.simpleString()
    out = src.mapInArrow(cut, f"rest {kind}, {schema}")
    order = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*(F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in order), "n_lines", "n_dropped")


def column_text(docs: DataFrame):
    return common.column(docs, "text", "string").alias("text")
