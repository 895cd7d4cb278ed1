"""Operator 6: n-gram Jaccard join by rare-first prefix filtering.

A document is its set of word 5-gram hashes (64 bits). All sets are ordered alike, rare n-grams first, by a table of
hashed counts. Two sets as similar as the threshold share one of their first n - ceil(t * n) + 1 n-grams, so documents meet
on these only; n-grams that the two filters of ``lines`` know to be in one prefix alone aren't shuffled. Of those that meet, the length filter, the positional filter (what can still be shared after the
meeting places) and the suffix filter (what can be shared at most, by hash range) leave the pairs that are verified,
each once, against the whole sets.

Equal sets are one class from the start. Links matter up to components, so that a group of near copies is not expanded into
its pairs: documents are first verified against one partner each, then against the first document of each of their
n-grams, and last against all they meet that is in another component by then. A pair that is left out is always one whose
two documents are in one component already; nothing is capped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph, lines

#: Words of an n-gram; hashed counters of the frequency table (one byte each when broadcast), and slices that are summed apart.
WORDS = 5
COUNTERS = 1 << 22
SLICES = 32
#: Hash ranges of the suffix filter, and bits of the parity sketch that bounds it inside a join.
RANGES = 64
SKETCH = 512
#: Star steps of the components between rounds: they needn't be whole there, since they only spare pairs within one.
STEPS = 2

_K = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; of the whole sequence where there are fewer words; none for none."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=len(w))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = len(w) - words + 1
    with np.errstate(over="ignore"):
        s = h[:n].copy()
        for j in range(1, words):
            s = s * _K + h[j : n + j]
        s ^= s >> np.uint64(33)
        s *= np.uint64(0xFF51AFD7ED558CCD)
        s ^= s >> np.uint64(33)
    return np.unique(s)


def needed(n: int, percent: int) -> int:
    """n-grams that a set of n must share with any similar set: ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def sketch(s: np.ndarray) -> bytes:
    """SKETCH parities: whether an odd number of the set's hashes falls into each of as many hash ranges.

    Each n-gram that only one of two sets has flips one bit, so the bits in which two sketches differ are no more than
    the n-grams in which the sets do.
    """
    return np.packbits(np.bincount((s >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64), minlength=SKETCH) & 1).tobytes()


def scan(docs: DataFrame, words: int) -> DataFrame:
    """One pass: a row (doc_id, n, digest, ranges, sketch) for each document, and slices of n-gram counts.

    A task adds its counts up in one array of COUNTERS numbers, however many documents it reads.
    """
    width = COUNTERS // SLICES
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.binary()]

    def batch(k, *columns):
        return pa.RecordBatch.from_arrays([pa.nulls(k, kind) if c is None else pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)

    def run(batches):
        total = np.zeros(COUNTERS, np.uint32)
        for b in common.sliced(batches):
            n, digests, ranges, sketches = [], [], [], []
            for t in b.column(1):
                s = shingles(t.as_py(), words)
                np.add.at(total, s & np.uint64(COUNTERS - 1), np.uint32(1))
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                ranges.append(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=RANGES).astype("<u4").tobytes())
                sketches.append(np.frombuffer(sketch(s), np.int64))
            yield batch(len(n), b.column(0), n, digests, ranges, sketches, None, None)
        used = [k for k in range(SLICES) if total[k * width : (k + 1) * width].any()]
        yield batch(len(used), None, None, None, None, None, used, [zlib.compress(total[k * width : (k + 1) * width].tobytes(), 1) for k in used])

    names = ["doc_id", "n", "digest", "ranges", "sketch", "s", "counts"]
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n int, digest binary, ranges binary, sketch array<bigint>, s int, counts binary")


def rarity(scanned: DataFrame) -> np.ndarray:
    """The frequency table: for each counter, the bit length of its count. COUNTERS bytes, whatever the corpus."""
    width = COUNTERS // SLICES

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.uint64)
        for b in batches:
            for c in b.column("counts"):
                total += np.frombuffer(zlib.decompress(c.as_py()), np.uint32)
        level = np.ceil(np.log2(total + 1.0)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["s", "level"])

    parts = scanned.where("s is not null").select("s", "counts").groupBy("s").applyInArrow(merge, "s int, level binary")
    got = {r.s: bytes(r.level) for r in parts.collect()}  # SLICES rows
    return np.frombuffer(b"".join(got.get(s, bytes(width)) for s in range(SLICES)), np.uint8)


def prefixes(docs: DataFrame, level: np.ndarray, percent: int, words: int) -> DataFrame:
    """(token, doc_id, n, pos): the prefix n-grams of each document, rare first."""
    table = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        level = table.value
        for b in common.sliced(batches):
            tokens, ids, sizes, places = [], [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                s = shingles(t.as_py(), words)
                k = len(s) - needed(len(s), percent) + 1
                if not len(s):
                    continue
                own = level[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]
                first = np.argsort(own, kind="stable")[:k]  # s is sorted, so equal levels go by hash
                tokens.append(s[first].view(np.int64))
                ids.append(np.full(k, d, np.int64))
                sizes.append(np.full(k, len(s), np.int32))
                places.append(np.arange(k, dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, ids, sizes, places)], names=["token", "doc_id", "n", "pos"])

    return docs.select("doc_id", "text").mapInArrow(run, "token bigint, doc_id bigint, n int, pos int")


def overlap_needed(na, nb, percent: int):
    """n-grams that sets of these sizes share at least if they are similar: ceil(p * (na + nb) / (100 + p))."""
    return F.ceil(percent * (na + nb) / F.lit(100 + percent))


def may_link(na, ia, nb, ib, percent: int):
    """Length and positional filters of two sets that share the n-gram at places ia and ib.

    At the first n-gram that two sets share, all they share lies from there on. At later ones less does, so a pair
    whose first one fails this test fails it at all, and one that passes is met at its first.
    """
    length = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    return length & (F.least(na - ia, nb - ib) >= overlap_needed(na, nb, percent))


def may_share(sa, sb, na, nb, percent: int):
    """The suffix filter on two parity sketches: whether the sets differ in few enough n-grams, as far as these tell."""
    differ = sum((F.bit_count(sa[i].bitwiseXOR(sb[i])) for i in range(1, SKETCH // 64)), F.bit_count(sa[0].bitwiseXOR(sb[0])))
    return differ <= na + nb - 2 * overlap_needed(na, nb, percent)


def repeated_tokens(tok: DataFrame) -> DataFrame:
    """Rows of tok whose n-gram the two filters of ``lines`` suspect of occurring twice. The others meet nothing."""
    bits = lines.sized(tok.count())
    spread = lambda t: t.to_numpy().view(np.uint64) * _K
    twice = tok.sparkSession.sparkContext.broadcast(lines.twice_filter(tok.select("token"), spread, bits))

    def run(batches):
        bitmap = np.frombuffer(twice.value, np.uint8)
        for b in batches:
            yield b.filter(pa.array(lines.seen_twice(bitmap, lines.positions(spread(b.column(0)), bits))))

    return tok.mapInArrow(run, tok.schema)


def verified(pairs: DataFrame, docs: DataFrame, ranges: DataFrame, percent: int, words: int) -> DataFrame:
    """The links among pairs (a, b), compared on whole sets. ranges: doc_id, n, ranges."""
    def suffix(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = [np.frombuffer(b"".join(b.column(i).to_pylist()), "<u4").reshape(-1, RANGES).astype(np.int64) for i in (2, 3)]
            both, total = np.minimum(x[0], x[1]).sum(1), x[0].sum(1) + x[1].sum(1)
            ok = (100 + percent) * both >= percent * total
            yield b.select([0, 1]).filter(pa.array(ok))

    r = ranges.select("doc_id", "ranges")
    p = pairs.select("a", "b").join(r.select(F.col("doc_id").alias("b"), F.col("ranges").alias("rb")), "b")
    p = p.join(r.select(F.col("doc_id").alias("a"), F.col("ranges").alias("ra")), "a").select("a", "b", "ra", "rb")
    p = common.written(p.mapInArrow(suffix, "a bigint, b bigint").distinct(), "pairs")
    ids = common.written(p.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "pair-ids")

    def sets(batches):
        for b in common.sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), words).tobytes() for t in b.column(1)], pa.binary())], names=["doc_id", "own"])

    own = common.joined_by_size(docs, ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(sets, "doc_id bigint, own binary")
    own = common.written(own, "sets")

    def compare(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    q = p.join(own.select(F.col("doc_id").alias("b"), F.col("own").alias("ob")).hint("merge"), "b")
    q = q.join(own.select(F.col("doc_id").alias("a"), F.col("own").alias("oa")).hint("merge"), "a").select("a", "b", "oa", "ob")
    out = common.written(q.mapInArrow(compare, "a bigint, b bigint").distinct(), "verified")
    common.dropped(p, ids, own)
    return out


def placed(df: DataFrame, comp: DataFrame, node: str, name: str) -> DataFrame:
    """df with the component of a node: itself where it has no link."""
    c = comp.select(F.col("node").alias("_node"), F.col("component").alias("_c"))
    return df.join(c, F.col(node) == F.col("_node"), "left").withColumn(name, F.coalesce("_c", F.col(node))).drop("_node", "_c")


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) for each row of docs.

    Documents link when 100 * intersection >= percent * union of their sets. Null or empty texts, and those without words, have
    an empty set and link with nothing. Rows that repeat a doc_id are one node, with the links of each. A null doc_id
    is no node: its component is null. An empty table gives no row.
    """
    docs = common.take(docs)
    scanned = common.written(scan(docs, words), "shingles")
    rows = scanned.where("s is null").select("doc_id", "n", "digest", "ranges", "sketch")
    # Equal sets are one class; its first document stands for it.
    some = rows.where("n > 0 and doc_id is not null")
    same = some.groupBy("digest").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1").select("digest", "a")
    copies = common.written(some.select("digest", F.col("doc_id").alias("b")).join(same.hint("merge"), "digest").where("a <> b").select("a", "b").distinct(), "copies")
    repeated = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    others = copies.select(F.col("b").alias("doc_id")).distinct().join(repeated.select("doc_id").hint("merge"), "doc_id", "left_anti")
    first = common.without(docs.where("doc_id is not null"), common.written(others, "others"))
    every = common.written(prefixes(first, rarity(scanned), percent, words), "prefixes")
    tok = common.written(repeated_tokens(every), "repeated-prefixes")
    common.dropped(every)

    # The first document of each n-gram that two or more have.
    hubs = tok.groupBy("token").agg(F.min(F.struct("doc_id", "n", "pos")).alias("h"), F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = tok.join(hubs.select("token", "h").hint("merge"), "token")
    shared = common.written(shared.select("token", "doc_id", "n", "pos", "h"), "shared")
    common.dropped(tok)
    h = shared.where(F.col("doc_id") != F.col("h.doc_id"))
    met = h.where(may_link(F.col("h.n"), F.col("h.pos"), F.col("n"), F.col("pos"), percent)).groupBy(F.col("h.doc_id").alias("a"), F.col("doc_id").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    met = common.written(met, "met")
    # First each document with the one partner that it meets most often.
    best = met.groupBy("b").agg(F.max(F.struct("c", (-F.col("a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b")
    links = common.written(verified(best, docs, rows, percent, words), "links")
    comp = graph.components(links, steps=STEPS)
    # Then with the other first documents, where that can still join two components.
    rest = placed(placed(met.join(best.hint("merge"), ["a", "b"], "left_anti"), comp, "a", "ca"), comp, "b", "cb").where("ca <> cb")
    links = links.unionByName(verified(rest, docs, rows, percent, words))
    comp = graph.components(links, steps=STEPS)
    # Last, n-grams whose documents are in several components still: those outside the largest meet all others.
    tokc = common.written(placed(shared.select("token", "doc_id", "n", "pos"), comp, "doc_id", "comp"), "token-components")
    common.dropped(shared)
    sizes = tokc.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("m"), F.count(F.lit(1)).alias("k")).where("k > 1").select("token", F.col("m.comp").alias("main"))
    open_ = tokc.join(main.hint("merge"), "token").join(rows.select(F.col("doc_id").alias("of"), "sketch"), F.col("doc_id") == F.col("of")).drop("of")
    open_ = common.written(open_, "open")
    x = open_.where("comp <> main").alias("x")
    y = open_.alias("y")
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.main")) | (F.col("x.doc_id") < F.col("y.doc_id")))
    on = on & may_link(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), percent)
    on = on & may_share(F.col("x.sketch"), F.col("y.sketch"), F.col("x.n"), F.col("y.n"), percent)
    pairs = x.hint("merge").join(y, on).select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
    pairs = common.written(pairs.join(met.select("a", "b").hint("merge"), ["a", "b"], "left_anti"), "last-pairs")
    links = links.unionByName(verified(pairs, docs, rows, percent, words)).unionByName(copies)
    comp = graph.components(links)
    common.dropped(met, tokc, open_, pairs)
    out = placed(rows.select("doc_id", "n"), comp, "doc_id", "component_id")
    return out.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id")
