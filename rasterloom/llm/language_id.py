"""Operator 1: language identification by multinomial naive Bayes over hashed character n-grams.

Training sums the n-gram counts of a bounded sample of labelled documents by language, in the scan tasks first. The
log-probability matrix (languages x buckets, some MB) is broadcast; whole texts are scored batch by batch as sparse
count vectors times that matrix, in numpy.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Buckets of hashed n-grams, their orders, and the smoothing count.
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
ALPHA = 0.5
#: Labelled documents that training reads, expected: the bound of the training sample. They are drawn by a hash of the id.
TRAIN_DOCS = 20_000
#: A prediction's score, not the prediction, is tempered: it is the posterior of this many n-grams of evidence at most, so that
#: long texts don't all score 1.
EVIDENCE = 200.0
#: Matrix cells that are broadcast at most (4 bytes each): with more languages there are fewer buckets, never fewer languages.
CELLS = 1 << 26
#: Characters that are turned into n-grams at once; longer texts go piece by piece, whole.
CHUNK = 1 << 20

_LETTER = re.compile(r"[^\W\d_]")
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def buckets(points: np.ndarray) -> np.ndarray:
    """Bucket ids of all n-grams of a text, given as code points in uint32."""
    out = []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(points) < n:
                continue
            h = np.full(len(points) - n + 1, n, np.uint32)
            for j in range(n):
                h = (h ^ points[j : len(points) - n + 1 + j]) * _MIX[j % 3]
                h ^= h >> np.uint32(15)
            out.append(h >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def points(text: str) -> np.ndarray:
    """Lower case, digits as one class, each run of non-letters as one space, a space at both ends."""
    words = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
    return np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sparse count vector of a whole text: bucket ids and counts."""
    p = points(text)
    total = None
    for a in range(0, len(p), CHUNK):
        n = np.bincount(buckets(p[a : a + CHUNK + max(ORDERS) - 1]), minlength=BUCKETS)
        total = n if total is None else total + n
        # n-grams that start in the overlap are counted with the next piece
        if a + CHUNK < len(p):
            for k in range(max(ORDERS) - 1):
                tail = p[a + CHUNK + k : a + CHUNK + max(ORDERS) - 1]
                total -= np.bincount(buckets_at(tail), minlength=BUCKETS)
    ids = np.flatnonzero(total) if total is not None else np.zeros(0, int)
    return ids, (total[ids] if total is not None else ids)


def buckets_at(points: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams that start at the first point."""
    return np.concatenate([buckets(points[:n])[-1:] for n in ORDERS if len(points) >= n]) if len(points) else np.zeros(0, np.uint32)


def train(labelled: DataFrame, most: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities (languages, 1 + BUCKETS): the prior, then each bucket's.

    labelled: doc_id, text, lang, lang not null. About ``most`` of its rows are read for counts, drawn by a hash of doc_id.
    """
    n = labelled.count()
    share = min(1.0, most / max(1, n))
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + (share == 1.0))

    def scan(batches):
        total: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for b in batches:
            for t, lang in zip(b.column(0), b.column(1).to_pylist()):
                t = t.as_py()
                if t and _LETTER.search(t):
                    ids, c = counts(t)
                    row = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    row[ids] += c
                    docs[lang] = docs.get(lang, 0) + 1
        langs, at, cs, ds = [], [], [], []
        for lang, row in total.items():
            ids = np.flatnonzero(row)
            langs.append(lang)
            at.append(ids.astype(np.int32).tobytes())
            cs.append(row[ids].tobytes())
            ds.append(docs[lang])
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(at, pa.binary()), pa.array(cs, pa.binary()), pa.array(ds, pa.int64())], names=["lang", "ids", "counts", "docs"])

    parts = drawn.select("text", "lang").mapInArrow(scan, "lang string, ids binary, counts binary, docs bigint")
    total: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    # A row a task and language, bounded by the training sample.
    for r in parts.toLocalIterator():
        row = total.setdefault(r.lang, np.zeros(BUCKETS, np.int64))
        row[np.frombuffer(r.ids, np.int32)] += np.frombuffer(r.counts, np.int64)
        docs[r.lang] = docs.get(r.lang, 0) + r.docs
    langs = sorted(total)
    if not langs:
        return [], np.zeros((0, 1 + BUCKETS), np.float32)
    # Neighbouring buckets are added up while the matrix would be too large: the first bits of a hash are a hash.
    width = BUCKETS
    while width * len(langs) > CELLS and width > 1:
        width //= 2
    c = np.stack([total[k].reshape(width, -1).sum(1) for k in langs]) + ALPHA
    logp = np.log(c) - np.log(c.sum(1, keepdims=True))
    prior = np.log(np.array([docs[k] for k in langs], float)) - np.log(sum(docs[k] for k in langs))
    return langs, np.concatenate([prior[:, None], logp], 1).astype(np.float32)


def score(texts, langs: list[str], logp: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and posterior probability of each text."""
    best, value = ["und"] * len(texts), [0.0] * len(texts)
    if not langs:
        return best, value
    by_bucket = np.ascontiguousarray(logp[:, 1:].T)
    each = BUCKETS // len(by_bucket)
    for i, t in enumerate(texts):
        if not t or not _LETTER.search(t):
            continue
        ids, c = counts(t)
        likely = c.astype(np.float64) @ by_bucket[ids // each]
        k = int((likely + logp[:, 0]).argmax())
        s = likely * min(1.0, EVIDENCE / c.sum()) + logp[:, 0]
        best[i], value[i] = langs[k], float(np.exp(s[k] - s.max()) / np.exp(s - s.max()).sum())
    return best, value


def identify(docs: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs, from its whole text alone.

    ``und`` with score 0 where the text is null, empty or has no letter, or nothing was learned. Ties go to the first
    language by name.
    """
    model = docs.sparkSession.sparkContext.broadcast((langs, logp))

    def run(batches):
        for b in common.sliced(batches):
            best, value = score([x.as_py() for x in b.column(1)], *model.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.string()), pa.array(value, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return common.take(docs).select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def held_out(doc_id):
    """Whether the document's fold is the held-out one. A null id is in the fold of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def language_id(docs: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the folds that aren't held out, applied to all rows of docs."""
    labelled = common.take(docs, "lang").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    out = identify(docs, *train(labelled, most))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
