"""Operator 7: removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A string of ``length`` bytes is a window. Each window picks an anchor in it, the K-byte string with the least hash (leftmost
on ties), so equal windows pick equal anchors; windows in a row with one anchor are a run. Anchors that occur once
in the corpus, by the two filters of ``lines``, can't belong to a repeated window. The other runs, with the bytes they
cover, are dealt out by anchor: all equal windows come to one task, which sorts its windows as suffixes.

A task joins the texts of its runs to blocks of BLOCK bytes, always with all runs of an anchor. In a block it ranks the suffixes
at the places of a difference cover modulo V, by doubling, as deep as windows are long; then it sorts one bucket of suffixes
at a time: by the first V bytes, and where these tie by the ranks of the cover places that the two suffixes reach at a
common distance below V. Neighbours in this order with ``length`` bytes in common are equal windows; all but the earliest are
removed. Sorting space is a few times a block, however long the texts, the windows or the ties are.

A block holds BLOCK bytes and one anchor's runs at most, and these are bounded too: an anchor that occurs more than HOT times
(or 8 times the mean of a filter position, where that is more) deals out its windows one by one, each under its own hash, so a
string of many documents with as many surroundings is spread over all tasks.

The work is linear: each text is read three times and shuffled once where it has suspected anchors. Beyond some 2**28
anchors the filters suspect more and more; in the end each run is shuffled, some 3.4 bytes a byte of text at length 100.

Skew: equal documents are collapsed to their first before anything else, and each scan task collapses equal runs before
the shuffle, so that a passage in very many documents reaches its sorting task about once a scan task, where it is collapsed again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, lines

#: Bytes of an anchor.
K = 16
#: Period of the cover and its residues: every difference modulo V is one of two residues.
V = 31
COVER = (0, 1, 3, 8, 12, 18)
#: Bytes of text that are hashed at once (positions must fit POS_BITS), and that are sorted as a block.
POS_BITS = 20
CHUNK = (1 << POS_BITS) - 4096
BLOCK = 2 << 20
BUCKETS = 8
#: Texts that are cut into runs at once, and bytes of distinct runs that a scan task holds to find equal ones.
ROWS = 256
HELD = 24 << 20
#: Runs that a scan task hands on at once.
PART = 20_000
#: Bits of the filters, at most (32 MB; a false positive costs a run of bytes here). Occurrences above which an anchor is hot.
BITS = 1 << 28
HOT = 4096

_M = 0x9E3779B97F4A7C15


def _shift_table() -> np.ndarray:
    """For residues a and b, the least d with a + d and b + d both in the cover."""
    out = np.full((V, V), -1, np.int64)
    for d in range(V - 1, -1, -1):
        hit = np.array([(r + d) % V in COVER for r in range(V)])
        out[np.ix_(hit, hit)] = d
    assert (out >= 0).all()
    return out


SHIFT = _shift_table()


def kmer_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the K-byte strings at each place, by doubling."""
    h, step, power = b.astype(np.uint64) + np.uint64(1), 1, _M
    with np.errstate(over="ignore"):
        while step < K:
            h = h[:-step] * np.uint64(power) + h[step:]
            power, step = power * power % (1 << 64), step * 2
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    step = 1
    while step * 2 <= w:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (w - step)], x[w - step :]) if w > step else x


def runs(texts: list[bytes], length: int):
    """Of the texts, taken together: text index, first window, last window (places in that text), anchor hash."""
    joined, owner, base = [], [], []
    size = 0
    out = []

    def flush():
        nonlocal joined, owner, base, size
        if joined:
            out.append(_runs(b"".join(joined), np.array(owner), np.array(base), np.array([len(x) for x in joined]), length))
        joined, owner, base, size = [], [], [], 0

    for i, t in enumerate(texts):
        # A long text goes in parts that overlap by length - 1: each window is in one part.
        for a in range(0, max(1, len(t) - length + 1), CHUNK - length + 1):
            part = t[a : a + CHUNK]
            if len(part) < length:
                continue
            if size + len(part) > CHUNK:
                flush()
            joined.append(part)
            owner.append(i)
            base.append(a)
            size += len(part)
    flush()
    return [np.concatenate([o[k] for o in out]) for k in range(4)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]


def _runs(data: bytes, owner, base, sizes, length: int):
    b = np.frombuffer(data, np.uint8)
    h = kmer_hashes(b)
    low = np.uint64((1 << POS_BITS) - 1)
    anchor = (sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - K + 1) & low).astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    part = np.repeat(np.arange(len(sizes)), sizes)[: len(anchor)]
    whole = np.arange(len(anchor)) <= ends[part] - length
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])
    first = np.flatnonzero(new & whole)
    stop = np.flatnonzero(whole & np.append(new[1:] | ~whole[1:], True))
    p = part[first]
    return owner[p], first - starts[p] + base[p], stop - starts[p] + base[p], h[anchor[first]]


def _dense(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 on, along an order by these keys: equal keys, equal ranks."""
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return np.cumsum(new).astype(np.int32)


def cover_ranks(text: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Of each cover place below n: its suffix' rank by ``depth`` bytes at least; 0 elsewhere. text: n bytes and spare ones.

    Ranks by V bytes come first. A place V * h further is a cover place as well, so pairs of ranks by V * h bytes give
    the ranks by twice as many.
    """
    word = np.lib.stride_tricks.sliding_window_view
    residue = np.zeros(V, bool)
    residue[list(COVER)] = True
    cover = np.flatnonzero(residue[np.arange(n) % V])
    # V bytes: three words of eight, and a last one of which V - 24 count.
    keys = [np.ascontiguousarray(word(text, 8)[cover + 8 * j]).view(">u8").ravel().astype(np.uint64) for j in range(4)]
    keys[3] >>= np.uint64(8 * (32 - V))
    rank = np.zeros(n + 1, np.int32)
    o = np.lexsort(keys[::-1])
    rank[cover[o]] = _dense(o, *keys)
    h = 1
    while V * h < depth and len(cover) and rank[cover].max() < len(cover):
        near, far = rank[cover], rank[np.minimum(cover + V * h, n)]
        o = np.lexsort((far, near))
        rank[cover[o]] = _dense(o, near, far)
        h *= 2
    return rank


def spare(length: int) -> int:
    """Bytes of zeros that follow a block, so that all places the sort looks at exist."""
    return length + 4 * V


def _order(text: np.ndarray, at: np.ndarray, length: int, bucket_of: int = BUCKETS):
    """Windows' places in the order of their suffixes, by ``length`` bytes at least. text ends in spare(length) zeros."""
    word = np.lib.stride_tricks.sliding_window_view
    n = len(text) - 64
    rank = cover_ranks(text, n, length)
    # Buckets of suffixes by their first eight bytes, each sorted on its own.
    eight = lambda p: np.ascontiguousarray(word(text, 8)[p]).view(">u8").ravel().astype(np.uint64)
    lead = eight(at)
    cuts = np.quantile(lead.astype(np.float64), np.linspace(0, 1, bucket_of + 1)[1:-1]) if len(at) > 50_000 else []
    which = np.searchsorted(np.asarray(cuts), lead.astype(np.float64), side="right")
    done = []
    for k in range(len(cuts) + 1):
        own = at[which == k]
        words = [eight(own + 8 * j) for j in range(4)]  # 32 bytes: V and one more
        s = np.lexsort(words[::-1])
        own = own[s]
        tie = np.zeros(len(own), bool)
        if len(own):
            tie[1:] = np.logical_and.reduce([w[s][1:] == w[s][:-1] for w in words])
        done.append(_by_ranks(own, np.cumsum(~tie), rank))
    return np.concatenate(done) if done else at


def _by_ranks(own: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Sorts within groups of suffixes that share V bytes: a three-way partition around a pivot, in all groups at once."""
    place = np.arange(len(own))  # where each suffix stands; group: in non-decreasing order along the places
    live = place
    own, group = own.copy(), group.copy()
    while len(live):
        g = group[live]
        head = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        count = np.diff(np.append(head, len(live)))
        keep = np.repeat(count > 1, count)
        live, g = live[keep], g[keep]
        if not len(live):
            break
        head = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        count = np.diff(np.append(head, len(live)))
        p = own[live]
        pivot = np.repeat(p[head + count // 2], count)
        d = SHIFT[p % V, pivot % V]
        side = np.sign(rank[p + d].astype(np.int64) - rank[pivot + d])
        seg = np.repeat(np.arange(len(head)), count)
        o = np.lexsort((side, seg))
        own[live] = p[o]
        # New groups: (segment, side); the middle one is all equal and done.
        new = seg * 3 + side[o]
        group[live] = new
        live = live[side[o] != 0]
    return own


def repeats(block: list[tuple], length: int):
    """block: (doc, tie-break, first window, bytes) of runs. Ranges of windows that an earlier equal one precedes:
    doc, tie-break, first, last."""
    size = np.array([len(r[3]) for r in block])
    base = np.cumsum(size) - size
    text = np.frombuffer(b"".join(r[3] for r in block) + bytes(spare(length)), np.uint8)
    n = size - length + 1
    of = np.repeat(np.arange(len(block)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + base[of]
    doc, tie, first = (np.array([r[k] for r in block], np.int64) for k in range(3))
    # Order of documents as dense ranks, then of places in them.
    o = np.lexsort((tie, doc))
    dense = np.zeros(len(block), np.int64)
    dense[o] = np.cumsum(np.append(False, (doc[o][1:] != doc[o][:-1]) | (tie[o][1:] != tie[o][:-1])))
    when = np.zeros(len(text), np.int64)
    run_of = np.zeros(len(text), np.int64)
    when[at] = dense[of] << 36 | (first[of] + at - base[of])
    run_of[at] = of
    s = _order(text, at, length)
    same = np.ones(max(0, len(s) - 1), bool)
    word = np.lib.stride_tricks.sliding_window_view
    for j in [*range(0, length - 7, 8), length - 8]:
        w = np.ascontiguousarray(word(text, 8)[s + j]).view(np.uint64).ravel()
        same &= w[1:] == w[:-1]
    start = np.flatnonzero(np.append(True, ~same))
    earliest = np.repeat(np.minimum.reduceat(when[s], start), np.diff(np.append(start, len(s)))) if len(s) else s
    gone = np.zeros(len(text), bool)
    gone[s] = when[s] > earliest
    # Ranges of removed windows within a run.
    g = np.flatnonzero(gone)
    if not len(g):
        return [np.zeros(0, np.int64)] * 4
    brk = np.append(True, (g[1:] != g[:-1] + 1) | (run_of[g[1:]] != run_of[g[:-1]]))
    a, z = g[brk], g[np.append(np.flatnonzero(brk)[1:] - 1, len(g) - 1)]
    r = run_of[a]
    return doc[r], tie[r], first[r] + a - base[r], first[r] + z - base[r]


def _texts(column) -> list[bytes]:
    return [(t.as_py() or "").encode() for t in column]


_SPAN = "doc bigint, tie bigint, first bigint, last bigint"


def _singles(who: tuple, body: bytes, length: int):
    """The windows of a run one by one: who, key, body."""
    doc, tie, first, _ = who
    for k in range(len(body) - length + 1):
        w = body[k : k + length]
        yield (doc, tie, first + k, first + k), xxhash.xxh3_64_intdigest(w) - (1 << 63), w


def removed_windows(docs: DataFrame, length: int, bits: int, hot: int) -> DataFrame:
    """Ranges of removed windows (doc, tie, first, last). docs: doc, tie, text, without equal texts."""
    spark = docs.sparkSession

    def anchors(texts):
        own = _texts(texts)
        found = [runs(own[a : a + ROWS], length)[3] for a in range(0, len(own), ROWS)]
        return _spread(np.concatenate(found)) if found else np.zeros(0, np.uint64)

    table = spark.sparkContext.broadcast(lines.twice_filter(docs.select("text"), anchors, bits, hot))

    def emit(batches):
        """Runs of suspected anchors. Of those with equal bytes that a task holds at once only the first keeps its bytes; the
        others have an earlier equal run, so their windows all go, and they travel as bare ranges under a key of their own."""
        twice, often = (np.frombuffer(x, np.uint8) for x in table.value)
        held: dict[tuple, tuple] = {}
        bare: list[tuple] = []
        size = 0

        def out():
            rows = [(*who, who[0] ^ who[2], None) for who in bare]
            for (a, _, many), (who, body) in held.items():
                rows += [(*w, key, x) for w, key, x in _singles(who, body, length)] if many else [(*who, a, body)]
            kinds = [pa.int64()] * 5 + [pa.binary()]
            for lo in range(0, len(rows), PART):
                part = rows[lo : lo + PART]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], kinds[k]) for k in range(6)], names=["doc", "tie", "first", "last", "anchor", "body"])

        for b in batches:
            doc, tie = b.column(0).to_pylist(), b.column(1).to_pylist()
            texts = _texts(b.column(2))
            for lo in range(0, len(texts), ROWS):
                own = texts[lo : lo + ROWS]
                i, first, last, h = runs(own, length)
                pos = lines.positions(_spread(h), bits)
                hit = lines.seen_twice(twice, pos)
                many = lines.seen_twice(often, pos[hit] // np.uint32(lines.FOLD))
                for x, f, z, a, m in zip(i[hit].tolist(), first[hit].tolist(), last[hit].tolist(), h[hit].view(np.int64).tolist(), many.tolist()):
                    body = own[x][f : z + length]
                    who = (doc[lo + x], tie[lo + x], f, z)
                    key = (a, xxhash.xxh3_128_digest(body), m)
                    got = held.get(key)
                    if got is None:
                        held[key] = (who, body)
                        size += len(body) * (length if m else 1)
                    elif got[0] != who:  # a row that repeats a document is no earlier one
                        bare.append(max(got[0], who))
                        held[key] = (min(got[0], who), body)
                if size >= HELD or len(bare) >= HELD // 100:
                    yield from out()
                    held, bare, size = {}, [], 0
        yield from out()

    def sort(batches):
        """Within an anchor, equal runs of other tasks are collapsed like those of one. A run holds no window twice, since its
        windows have the anchor at different places, so an anchor with one run left has nothing to sort."""
        held: list[tuple] = []
        group: dict[bytes, tuple] = {}
        gone: list[tuple] = []
        size, last = 0, None

        def ranges(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["doc", "tie", "first", "last"])

        def close():
            nonlocal size
            if len(group) > 1:
                held.extend((*who[:3], body) for body, who in group.items())
                size += sum(map(len, group))
            group.clear()

        for b in batches:
            alone = pa.compute.is_null(b.column(5))
            yield b.filter(alone).select([0, 1, 2, 3])
            b = b.filter(pa.compute.invert(alone))
            for *who, a, body in zip(*(b.column(k).to_pylist() for k in range(6))):
                who = tuple(who)
                if a != last:
                    close()
                    if size >= BLOCK:
                        yield ranges(repeats(held, length))
                        held, size = [], 0
                    last = a
                got = group.get(body)
                if got is not None and got != who:
                    gone.append(max(got, who))
                group[body] = who if got is None else min(got, who)
            if gone:
                yield ranges(zip(*gone))
                gone = []
        close()
        if held:
            yield ranges(repeats(held, length))

    found = docs.select("doc", "tie", "text").mapInArrow(emit, _SPAN + ", anchor bigint, body binary")
    dealt = found.repartition("anchor").sortWithinPartitions("anchor")
    return common.written(dealt.mapInArrow(sort, _SPAN), "removed")


def _spread(h: np.ndarray) -> np.ndarray:
    """Anchors are least hashes, so their top bits are low: spread them again for the filters."""
    with np.errstate(over="ignore"):
        return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _cut(text: bytes, spans, length: int, copy: bool) -> tuple[int, int, int, bytes]:
    if copy and len(text) >= length:
        return len(text), len(text), 1, b""
    if not spans:
        return len(text), 0, 0, text
    edge = np.zeros(len(text) + 1, np.int32)
    np.add.at(edge, [s["first"] for s in spans], 1)
    np.add.at(edge, [s["last"] + length for s in spans], -1)
    gone = np.cumsum(edge[:-1]) > 0
    starts = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return len(text), int(gone.sum()), starts, np.frombuffer(text, np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame, length: int = 100, hot: int | None = None, id_rows: int = common.BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary: the bytes that stay, maybe no UTF-8) for each row of docs.

    A byte goes if a string of ``length`` bytes covers it that also starts earlier: in a row with a smaller doc_id, or
    earlier in its text. Matches never cross rows. Null text counts as empty; texts shorter than ``length`` stay whole. Rows
    with one doc_id and equal texts are one document; different texts under one doc_id are ordered by their digests. A
    null doc_id comes before all others. An empty table gives no row.
    """
    if length < K + 16:
        raise ValueError(f"length must be {K + 16} or more")
    text = F.coalesce(common.column(docs, "text", "string"), F.lit(""))
    sha = F.sha2(text, 256)
    tie = F.conv(F.substring(sha, 1, 15), 16, 10).cast("bigint")
    doc = F.coalesce(common.column(docs, "doc_id", "bigint"), F.lit(-(2**63)).cast("bigint"))
    keyed = docs.select(doc.alias("doc"), tie.alias("tie"), text.alias("text"), common.column(docs, "doc_id", "bigint").alias("doc_id"))
    ids = common.written(docs.select(doc.alias("doc"), tie.alias("tie"), F.unhex(sha).alias("digest"), F.octet_length(text).cast("bigint").alias("size")), "text-ids")
    firsts = ids.groupBy("digest").agg(F.min("doc").alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1").select("digest", "f")
    copies = common.written(ids.join(firsts.hint("merge"), "digest").where("doc <> f").select("doc", "tie").distinct(), "text-copies")
    n_copies = copies.count()
    total = ids.agg(F.sum("size")).first()[0] or 0
    own = common.joined_by_size(keyed.where(F.octet_length("text") >= length), copies, ["doc", "tie"], "left_anti", n_copies).select("doc", "tie", "text")
    n_anchors = total / 40  # an anchor for some 40 bytes
    bits = lines.sized(n_anchors, BITS, 8)
    removed = removed_windows(own, length, bits, hot or max(HOT, int(8 * n_anchors / bits)))
    spans = removed.groupBy("doc", "tie").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    marked = spans.withColumn("copy", F.lit(False)).unionByName(copies.select("doc", "tie", F.lit(None).cast("array<struct<first:bigint,last:bigint>>").alias("spans"), F.lit(True).alias("copy")))
    marked = common.written(marked, "marked")
    n_marked = marked.count()
    # Only texts that lose something meet their spans; the others stay where they are, as long as their ids are few enough to tell.
    ids = marked.select("doc", "tie").distinct()
    m = marked.select(F.col("doc").alias("d"), F.col("tie").alias("t"), "spans", "copy")
    on = (F.col("doc") == F.col("d")) & (F.col("tie") == F.col("t"))
    names = ["doc_id", "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy")]
    if n_marked <= id_rows:
        some = keyed.join(F.broadcast(ids), ["doc", "tie"], "left_semi").join(m.hint("merge"), on).select(*names)
        rest = keyed.join(F.broadcast(ids), ["doc", "tie"], "left_anti").withColumn("spans", F.lit(None).cast(m.schema["spans"].dataType)).withColumn("copy", F.lit(False))
        joined = some.unionByName(rest.select(*names))
    else:
        joined = keyed.join(m.hint("merge"), on, "left").select(*names)

    def cut(batches):
        for b in common.sliced(batches):
            got = [_cut(t.as_py().encode(), s.as_py(), length, c) for t, s, c in zip(b.column(1), b.column(2), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[k] for g in got], pa.int64()) for k in range(3)), pa.array([g[3] for g in got], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def brute_force(texts: list[bytes], length: int) -> list[bytes]:
    """For tests: the kept bytes of texts in document order."""
    seen: set[bytes] = set()
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            w = hashlib.sha256(t[i : i + length]).digest()
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        out.append(bytes(x for x, g in zip(t, gone) if not g))
    return out
