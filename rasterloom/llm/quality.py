"""Operator 4: quality rules with robust multivariate outliers.

Base rules reject documents with too few words or too much repetition. The rest are judged by language and source: a
minimum-covariance-determinant estimate of five transformed statistics gives a centre and scatter that junk can't pull
towards itself, and documents far from the centre by Mahalanobis distance, on either side, go.

The estimates cover all documents. Concentration steps run from three deterministic starts until the determinant stops
falling, and the fit of the least determinant counts. A step is one aggregate over the table of statistics: moments by group,
start and bin of distance; the bins with the smallest distances, the last one in part, hold the wanted share and give the next
centre and scatter. Statistics are fixed-point integers, so sums don't depend on the order of rows and reruns agree.
No group's rows come together in one task; a group's moments are one row a bin.

There is no least size of a group: a source's fit is drawn towards its language's as if PRIOR documents more had that,
a language's scatter towards a wide one (its centre stays its own), and no scatter is narrower than the floors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
#: Fixed point of the transformed statistics.
SCALE = 1024
#: The transformed statistics, in order; their least standard deviations, in any direction (below, a statistic that hardly
#: varies in a group would turn any deviation into an outlier); and the wide ones that a language starts from.
STATS = ("x_len", "x_word", "x_symbols", "x_lines", "x_repeat")
#: By the floors alone, a mean word length a third off and the share of repeated words that the base rules allow are no outliers.
FLOOR = (0.5, 0.05, 0.06, 0.06, 0.12)
WIDE = (1.5, 0.35, 0.12, 0.2, 0.3)
#: Documents that the wider fit counts as.
PRIOR = 30
#: Share of a group's documents that an estimate concentrates on; fall of the determinant's logarithm that goes on.
HALF = 0.75
FALL = 0.01
#: Chance that a normal document's squared distance is above the cutoff.
TAIL = 1e-6
#: Groups whose fits may be broadcast (some 300 bytes each).
GROUP_ROWS = 100_000
#: Histogram bins of the logarithm of the squared distance.
BINS = 64


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; null has no words."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode()
    words = data.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            seen: dict = {}
            again = np.zeros(n, bool)
            for i, w in enumerate(windows):
                j = seen.setdefault(w, i)
                if j != i:
                    again[i : i + 3] = True
                    again[j : j + 3] = True
            repeat = int(again.sum())
    return n, chars, symbols, dup, repeat


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_statistics(docs: DataFrame, inside: str | None = None) -> DataFrame:
    """Adds the five statistics of text as longs, in place of text; of that struct's text, which stays, if one is named."""
    rest = [c for c in docs.columns if c != "text"]

    def run(batches):
        for b in common.sliced(batches):
            texts = b.column("text") if inside is None else b.column(inside).field("text")
            got = [statistics(x.as_py()) for x in texts]
            cols = [pa.array([g[k] for g in got], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *cols], names=[*rest, *COUNTS])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema)
    return docs.mapInArrow(run, f"{kinds}, {', '.join(f'{c} bigint' for c in COUNTS)}")


def base_failed(min_words: int = 50, max_repeat: int = 50):
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))


def transformed():
    """Logarithms and bounded ratios of the statistics, in fixed point."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    xs = (
        F.log(n),
        F.log(F.greatest(F.col("word_chars") / n, F.lit(0.25))),
        F.sqrt(F.least(F.col("n_symbols") / n, F.lit(16.0))),
        F.sqrt(F.col("n_dup_lines") / n),
        F.sqrt(F.col("n_repeat_words") / n),
    )
    return [F.round(x * SCALE).cast("bigint").alias(k) for x, k in zip(xs, STATS)]


_PAIRS = [(i, j) for i in range(5) for j in range(i, 5)]


def moments(*by: str):
    """Count, sums and sums of products of the statistics by group: exact integers, partial sums before the shuffle."""
    sums = [F.sum(k).alias(f"s{i}") for i, k in enumerate(STATS)]
    products = [F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"p{i}{j}") for i, j in _PAIRS]
    return lambda df: df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def _below(x: float, d: int) -> float:
    """Chance that chi-squared with d (odd) degrees of freedom is below x, by recurrence from the normal."""
    p, term = math.erf(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(3, d + 1, 2):
        p -= term
        term *= x / k
    return p


def quantile(share: float, dims: int = 5) -> float:
    """The share's quantile of chi-squared with dims (odd) degrees of freedom."""
    lo, hi = 0.0, 100.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _below(mid, dims) < share else (lo, mid)
    return lo


def consistency(share: float, dims: int = 5) -> float:
    """Factor that makes the scatter of the central ``share`` of a normal sample consistent: share over the chance that
    chi-squared with two more degrees of freedom is below the share's quantile."""
    return share / _below(quantile(share, dims), dims + 2)


#: Squared distance above which a document goes.
CUTOFF = quantile(1 - TAIL)


#: A fit: centre, inverse and scatter (rows of 5 x 5) of a group of n documents, and the logarithm of its determinant.
FIT = "g string, start int, n bigint, centre array<double>, inverse array<double>, scatter array<double>, logdet double"


def bounded(cov: np.ndarray) -> np.ndarray:
    """The covariance with a standard deviation of a floor at least in each direction."""
    unit = np.outer(FLOOR, FLOOR)
    w, v = np.linalg.eigh(cov / unit)
    return (v * np.maximum(w, 1)) @ v.T * unit


def _fit_row(g: str, start: int, n: int, centre: np.ndarray, cov: np.ndarray, logdet: float | None = None) -> tuple:
    cov = bounded(cov)
    return g, start, n, centre.tolist(), np.linalg.inv(cov).ravel().tolist(), cov.ravel().tolist(), float(np.linalg.slogdet(cov)[1]) if logdet is None else logdet


def _fit_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.list_(pa.float64())] * 3, pa.float64()]
    return pa.table([pa.array([r[k] for r in rows], kinds[k]) for k in range(7)], names=["g", "start", "n", "centre", "inverse", "scatter", "logdet"])


def concentrated(count: np.ndarray, sums: np.ndarray, products: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of the nearest ``half`` from moments by distance bin, nearest first; the last bin in part."""
    share = half * count.sum()
    before = np.cumsum(count) - count
    w = np.clip((share - before) / count, 0, 1)
    mean = w @ sums / share
    cov = np.zeros((5, 5))
    for k, (i, j) in enumerate(_PAIRS):
        cov[i, j] = cov[j, i] = w @ products[:, k] / share - mean[i] * mean[j]
    return mean / SCALE, cov * consistency(half) / SCALE**2


def _concentrated(half: float):
    """The next fit of a group and start from its moments by distance bin."""
    def run(t: pa.Table) -> pa.Table:
        o = np.argsort(t.column("bin").to_numpy())
        of = lambda name: t.column(name).to_numpy()[o].astype(float)
        count = of("n")
        mean, cov = concentrated(count, np.stack([of(f"s{i}") for i in range(5)], 1), np.stack([of(f"p{i}{j}") for i, j in _PAIRS], 1), half)
        return _fit_table([_fit_row(t.column("g")[0].as_py(), t.column("start")[0].as_py(), int(count.sum()), mean, cov)])

    return run


def distance():
    """Squared Mahalanobis distance of the statistics from the joined centre."""
    x = [F.col(k) / SCALE - F.col("centre")[i] for i, k in enumerate(STATS)]
    return sum((x[i] * x[j] * F.col("inverse")[5 * i + j] * (1 if i == j else 2) for i, j in _PAIRS), F.lit(0.0))


def _bin(d2):
    """Eight bins for each doubling, from 2**-4 on."""
    return F.least(F.lit(8 * BINS), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(d2, F.lit(1e-9))) * 8).cast("int") + 32))


def _medians(t: pa.Table) -> pa.Table:
    """The median and median deviation of each statistic of a group, from its histograms."""
    k, b, n = (t.column(c).to_numpy() for c in ("k", "b", "n"))
    centre, spread = np.zeros(5), np.zeros(5)

    def middle(values, weights):
        o = np.argsort(values, kind="stable")
        return values[o][np.searchsorted(weights[o].cumsum(), weights.sum() / 2)]

    for i in range(5):
        own = k == i
        v = (b[own] + 0.5) * 16 / SCALE
        centre[i] = middle(v, n[own])
        spread[i] = max(1.4826 * middle(np.abs(v - centre[i]), n[own]), FLOOR[i])
    return pa.table({"g": t.column("g").slice(0, 1), "n": pa.array([int(n[k == 0].sum())], pa.int64()), "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "spread": pa.array([spread.tolist()], pa.list_(pa.float64()))})


def _starts(t: pa.Table) -> pa.Table:
    """Three first fits of a group: by medians and deviations alone, and with the correlations of bounded scores and of directions."""
    r = t.to_pylist()[0]
    d = np.array(r["spread"])
    rows = [_fit_row(r["g"], 0, r["n"], np.array(r["centre"]), np.diag(d**2), math.inf)]
    for k, name in ((1, "t"), (2, "u")):
        c = np.zeros((5, 5))
        for i, j in _PAIRS:
            c[i, j] = c[j, i] = r[f"{name}{i}{j}"]
        size = np.sqrt(np.maximum(np.diag(c), 1))
        c = c / np.outer(size, size)
        np.fill_diagonal(c, 1)
        rows.append(_fit_row(r["g"], k, r["n"], np.array(r["centre"]), c * np.outer(d, d), math.inf))
    return _fit_table(rows)


def start(df: DataFrame, rows: int) -> DataFrame:
    """First fits of each group, from exact histograms of each statistic and sums of products of transformed scores."""
    long = df.select("g", F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.floor(F.col(c) / 16).cast("int").alias("b")) for i, c in enumerate(STATS)))).alias("e"))
    hist = long.groupBy("g", F.col("e.k").alias("k"), F.col("e.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    mid = common.written(hist.groupBy("g").applyInArrow(_medians, "g string, n bigint, centre array<double>, spread array<double>"), "medians")
    z = df.join(small(mid.withColumnRenamed("g", "_g"), rows), F.col("g") == F.col("_g"))
    z = z.select("g", *(((F.col(k) / SCALE - F.col("centre")[i]) / F.col("spread")[i]).alias(f"z{i}") for i, k in enumerate(STATS)))
    size = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(5)), F.lit(1e-12)))
    # In fixed point, so that sums don't depend on the order of rows.
    whole = lambda x: F.round(x * SCALE).cast("bigint")
    z = z.select("g", *(whole(F.tanh(f"z{i}")).alias(f"t{i}") for i in range(5)), *(whole(F.col(f"z{i}") / size).alias(f"u{i}") for i in range(5)))
    sums = z.groupBy("g").agg(*(F.sum(F.col(f"{k}{i}") * F.col(f"{k}{j}")).alias(f"{k}{i}{j}") for k in "tu" for i, j in _PAIRS))
    return sums.join(mid, "g").groupBy("g").applyInArrow(_starts, FIT)


def small(df: DataFrame, rows: int) -> DataFrame:
    """One row a group: broadcast up to GROUP_ROWS, else joined by shuffle."""
    return F.broadcast(df) if rows <= GROUP_ROWS else df


def with_fit(df: DataFrame, fits: DataFrame, rows: int, how: str = "inner") -> DataFrame:
    f = fits.select(F.col("g").alias("_g"), *(c for c in ("start", "centre", "inverse") if c in fits.columns))
    return df.join(small(f, rows), F.col("g") == F.col("_g"), how).drop("_g")


def estimates(stats: DataFrame, rows: int, half: float = HALF) -> DataFrame:
    """The fit of each group with the least determinant. rows: how many groups there are.

    A step is one pass: moments by group, start and distance bin, at most 8 * BINS + 1 rows each, then one fit each. Fits
    whose determinant doesn't fall any more stand still; when all do, the least of a group's three is its estimate.
    """
    fits = common.written(start(stats, rows).withColumn("moved", F.lit(True)), "mcd")
    while True:
        d = with_fit(stats, fits.where("moved"), 3 * rows).withColumn("bin", _bin(distance()))
        new = moments("g", "start", "bin")(d).groupBy("g", "start").applyInArrow(_concentrated(half), FIT).alias("new")
        old = fits.alias("old")
        on = (F.col("old.g") == F.col("new.g")) & (F.col("old.start") == F.col("new.start"))
        falls = F.coalesce(F.col("new.logdet") < F.col("old.logdet") - FALL, F.lit(False))
        pick = [F.when(falls, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in fits.columns if c != "moved"]
        nxt = common.written(old.join(new, on, "left").select(*pick, falls.alias("moved")), "mcd")
        common.dropped(fits)
        fits = nxt
        if fits.where("moved").isEmpty():
            break
    names = [c for c in fits.columns if c not in ("g", "moved")]
    return fits.groupBy("g").agg(F.min(F.struct("logdet", *(c for c in names if c != "logdet"))).alias("f")).select("g", *(f"f.{c}" for c in names))


FINAL = "g string, centre array<double>, inverse array<double>"


def _drawn(t: pa.Table) -> pa.Table:
    """A source's fit, drawn towards its language's, and that towards the wide scatter."""
    r = t.to_pylist()[0]
    mix = lambda n, own, other: (n * np.array(own) + PRIOR * np.array(other)) / (n + PRIOR)
    wide = mix(r["lang_n"], r["lang_scatter"], np.diag(np.array(WIDE) ** 2).ravel())
    cov = bounded(mix(r["n"], r["scatter"], wide).reshape(5, 5))
    centre = mix(r["n"], r["centre"], r["lang_centre"])
    return pa.table({"g": t.column("g").slice(0, 1), "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "inverse": pa.array([np.linalg.inv(cov).ravel().tolist()], pa.list_(pa.float64()))})


def fitted(stats: DataFrame) -> tuple[DataFrame, int]:
    """g, centre, inverse of each language and source of stats (lang, source, STATS), and how many there are."""
    groups = common.written(stats.select("lang", "source").distinct().select(_group().alias("g"), _language().alias("l")), "groups")
    n = groups.count()
    both = F.explode(F.array(_group(), _language())).alias("g")
    fits = common.written(estimates(stats.select(both, *STATS), 2 * n), "mcd")
    lang = fits.select(F.col("g").alias("l"), F.col("n").alias("lang_n"), F.col("centre").alias("lang_centre"), F.col("scatter").alias("lang_scatter"))
    drawn = groups.join(fits, "g").join(lang, "l").groupBy("g").applyInArrow(_drawn, FINAL)
    return common.written(drawn, "fits"), n


def _group():
    return F.to_json(F.struct("lang", "source"))


def _language():
    return F.concat(F.lit("lang"), F.to_json(F.struct("lang")))


NAMES = (*COUNTS, "base_failed", "distance2", "kept")


def _own(docs: DataFrame) -> DataFrame:
    """rest (the columns but text and NAMES, as a struct), text, lang, source."""
    rest = [c for c in docs.columns if c not in (*NAMES, "text")]
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(None).cast("int").alias("_")).alias("rest"), *_named(docs))


def _named(docs: DataFrame) -> list:
    return [common.column(docs, c, "string").alias(c) for c in ("text", "lang", "source")]


def _verdict(s: DataFrame, fits: DataFrame, rows: int, cutoff: float) -> DataFrame:
    out = with_fit(s.select("*", _group().alias("g"), *transformed()), fits, rows, "left")
    out = out.withColumn("distance2", F.when(F.col("centre").isNotNull(), distance()))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= cutoff))


def _statistics(docs: DataFrame) -> DataFrame:
    return common.written(with_statistics(_own(docs)).withColumn("base_failed", base_failed()), "quality")


def judged(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """All columns of docs but text, with the statistics, base_failed, distance2 and kept, for each row.

    A document is judged in its language and source. Null languages and sources are groups of their own, as is every row's
    where docs has no such column. Null and empty texts fail the base rules; documents that do are no part of an
    estimate, and their distance is null where no document of their group passes. Equal rows get equal verdicts. An empty table gives no
    row. Columns of docs named like one of NAMES are replaced.
    """
    s = _statistics(docs)
    fits, n = fitted(s.where(~F.col("base_failed")).select("lang", "source", *transformed()))
    names = [c for c in docs.columns if c not in (*NAMES, "text")]
    return _verdict(s, fits, n, cutoff).select(*(F.col(f"rest.`{c}`").alias(c) for c in names), *NAMES)


def kept_rows(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs, all columns as they are, that judged() keeps.

    The verdict is taken on each row itself, not fetched by its id: rows without an id, or with another row's, are judged by
    their own text.
    """
    fits, n = fitted(_statistics(docs).where(~F.col("base_failed")).select("lang", "source", *transformed()))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"), common.column(docs, "text", "string").alias("text"))
    s = with_statistics(docs.select(row.alias("row"), *_named(docs)[1:]), "row")
    out = _verdict(s.withColumn("base_failed", base_failed()), fits, n, cutoff)
    return out.where("kept").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
