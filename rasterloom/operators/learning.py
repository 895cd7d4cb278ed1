"""Encoders, clusterings and classifiers on Spark ML and distributed moments; GPU models plug in as batch functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions.scalars import clipped_log


#: Groups in which the sums of tasks are added first.
SALTS = 512


def moments(df: DataFrame, features: str = "features") -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and covariance of an array column. Tasks make sums first; these are added on the executors, a row of the matrix at a time and
    in two steps, so the driver sees one row a dimension whatever the number of tasks."""
    def run(frames):
        n, s, p = 0, 0.0, 0.0
        for f in frames:
            x = np.stack(f[features].to_numpy()).astype(float) if len(f) else np.zeros((0, 1))
            if len(x):
                n, s, p = n + len(x), s + x.sum(0), p + x.T @ x
        if n:
            yield pd.DataFrame({"i": range(len(s)), "n": n, "s": s, "p": list(p)})

    def add(key, f):
        return pd.DataFrame({"i": [key[0]], "n": [f.n.sum()], "s": [f.s.sum()], "p": [np.stack(f.p.to_numpy()).sum(0)]})

    kinds = "i int, n bigint, s double, p array<double>"
    part = df.select(features).mapInPandas(run, kinds).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    rows = part.groupBy("i", "salt").applyInPandas(add, kinds).groupBy("i").applyInPandas(add, kinds).orderBy("i").collect()  # a row a dimension
    if not rows:
        raise ValueError("moments of no rows")
    n, mean = rows[0].n, np.array([r.s for r in rows]) / rows[0].n
    return mean, np.array([r.p for r in rows]) / n - np.outer(mean, mean), n


def pca_fit(df: DataFrame, keep: float = 0.99, features: str = "features") -> tuple[np.ndarray, np.ndarray]:
    """Mean, and the leading components that hold ``keep`` of the variance; signs make each one's largest entry positive."""
    mean, cov, _ = moments(df, features)
    w, v = np.linalg.eigh(cov)
    w, v = w[::-1].clip(0), v[:, ::-1]
    k = int(np.searchsorted(np.cumsum(w) / max(w.sum(), 1e-300), keep) + 1)
    v = v[:, :k] * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])][:k])
    return mean, v


def encode(df: DataFrame, model: Callable[[np.ndarray], np.ndarray], features: str = "features", out: str = "embedding") -> DataFrame:
    """Applies a batch function (rows, features) -> (rows, k) in Arrow batches: the hook for any encoder or head."""
    def run(frames):
        for f in frames:
            z = model(np.stack(f[features].to_numpy()).astype(float)) if len(f) else np.zeros((0, 1))
            yield f.drop(columns=[out], errors="ignore").assign(**{out: list(z)})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out)
    return df.mapInPandas(run, f"{kinds}, {out} array<double>")


def fuse_embeddings(frames: Sequence[DataFrame], key: Sequence[str], name: str = "embedding") -> DataFrame:
    """Late fusion: embeddings of the same key, one after the other in one array."""
    out = frames[0].select(*key, F.col(name).alias("_0"))
    for i, f in enumerate(frames[1:], 1):
        out = out.join(f.select(*key, F.col(name).alias(f"_{i}")), list(key))
    return out.select(*key, F.concat(*(F.col(f"_{i}") for i in range(len(frames)))).alias(name))


def iic_joint(df: DataFrame, a: str, b: str) -> DataFrame:
    """(i, j, p): the symmetric joint distribution of two soft assignments, summed over rows and normalised."""
    d = df.select(F.posexplode(a).alias("i", "pa"), F.col(b).alias("_b")).select("i", "pa", F.posexplode("_b").alias("j", "pb"))
    s = d.groupBy("i", "j").agg(F.sum(F.col("pa").cast("double") * F.col("pb").cast("double")).alias("s"))
    t = s.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("s").alias("t"))
    total = s.agg(F.sum("s").alias("total"))
    return s.join(t, ["i", "j"]).crossJoin(F.broadcast(total)).select("i", "j", ((F.col("s") + F.col("t")) / 2 / F.col("total")).alias("p"))


def iic_loss(joint: DataFrame, lam: float = 1.0) -> DataFrame:
    """Minus the mutual information of the joint, marginal terms weighted by lam."""
    pi = joint.groupBy("i").agg(F.sum("p").alias("pi"))
    pj = joint.groupBy("j").agg(F.sum("p").alias("pj"))
    d = joint.join(pi, "i").join(pj, "j")
    p = F.col("p")
    return d.agg(F.sum(-p * (clipped_log(p, 1e-12) - lam * clipped_log(F.col("pi"), 1e-12) - lam * clipped_log(F.col("pj"), 1e-12))).alias("loss"))


def kmeans(df: DataFrame, k: int, features: str = "features", seed: int = 1, iterations: int = 50) -> DataFrame:
    """Adds label, by Spark ML's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    d = df.withColumn("_v", array_to_vector(F.transform(features, lambda x: x.cast("double"))))
    return KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="_v", predictionCol="label").fit(d).transform(d).drop("_v")


#: Parents whose centres may be broadcast.
PARENT_ROWS = 10_000


def _sums(parent: str, features: str):
    """Rows and sum of the features by parent and child: a row each a task, or more where a task has many."""
    def run(frames):
        held: dict = {}
        flat = lambda: pd.DataFrame([(p, c, n, v.tolist()) for (p, c), (n, v) in held.items()], columns=["p", "child", "n", "s"])
        for f in frames:
            for k, g in f.groupby([parent, "child"]):
                n, v = held.get(k, (0, 0.0))
                held[k] = n + len(g), v + np.stack(g[features].to_numpy()).astype(float).sum(0)
            if len(held) > PARENT_ROWS:
                yield flat()
                held.clear()
        if held:
            yield flat()

    return run


def cluster_tree(df: DataFrame, children: int, least: int, key: str, features: str = "features", parent: str = "label", iterations: int = 20) -> DataFrame:
    """Adds child and cluster = parent * children + child: every parent with ``least`` rows or more gets a k-means of its own
    over all its rows, started from rows drawn by hash. Smaller parents have child 0.

    A step is one aggregate by (parent, nearest centre): tasks send sums, and no parent's rows come together in one task.
    """
    n = df.groupBy(F.col(parent).alias("p")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("p")
    n = storage.written(n, "cluster-tree")
    rows = n.count()
    small = (lambda c: F.broadcast(c)) if rows <= PARENT_ROWS else (lambda c: c)
    d = df.where(F.col(parent).isNotNull()).select(F.col(parent).alias("p"), F.col(features).alias("x"), F.xxhash64(key).alias("h"), F.col(key).alias("k")).join(small(n), "p")
    # The least hash of each of many classes, then the first of these: rows that are drawn without a sort of a parent.
    first = d.groupBy("p", F.pmod("h", F.lit(64 * children)).alias("c")).agg(F.min(F.struct("h", "k", "x")).alias("m"))
    first = first.groupBy("p").agg(F.slice(F.sort_array(F.collect_list("m")), 1, children).alias("m"))
    centres = storage.written(first.select("p", F.transform("m", lambda m: F.transform(m["x"], lambda v: v.cast("double"))).alias("centres")), "cluster-tree")
    dist = lambda x: lambda c: F.aggregate(F.zip_with(c, F.col(x), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)

    def nearest(x: str):
        ds = F.transform("centres", dist(x))
        return (F.array_position(ds, F.array_min(ds)) - 1).cast("int")

    kind = d.schema["p"].dataType.simpleString()
    for _ in range(iterations):
        part = d.join(small(centres), "p").select("p", "x", nearest("x").alias("child")).mapInPandas(_sums("p", "x"), f"p {kind}, child int, n bigint, s array<double>")
        total = part.select("p", "child", "n", F.posexplode("s").alias("i", "v")).groupBy("p", "child", "i").agg((F.sum("v") / F.sum("n")).alias("v"))
        mean = total.groupBy("p", "child").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("mean"))
        # Centres without rows stay where they are.
        old = centres.select("p", F.posexplode("centres").alias("child", "old")).join(mean, ["p", "child"], "left").withColumn("new", F.coalesce("mean", "old"))
        far = F.exists(F.zip_with("old", "new", lambda a, b: F.abs(a - b) > 1e-8 + 1e-5 * F.abs(b)), lambda e: e)
        new = old.groupBy("p").agg(F.transform(F.sort_array(F.collect_list(F.struct("child", "new"))), lambda e: e["new"]).alias("centres"), F.max(far).alias("moved"))
        new = storage.written(new, "cluster-tree")
        storage.dropped(centres)
        centres = new.select("p", "centres")
        centres.__dict__["_own_path"] = new.__dict__["_own_path"]
        if not new.where("moved").limit(1).count():
            break
    out = df.join(small(centres), F.col(parent) == F.col("p"), "left").withColumn("child", F.when(F.col("p").isNull(), 0).otherwise(nearest(features)))
    return out.withColumn("cluster", (F.col(parent) * children + F.col("child")).cast("int")).drop("p", "centres")


#: Rows of a block of vectors: a task scores one block against one other.
BLOCK_ROWS = 4096


def knn(df: DataFrame, key: str, k: int, features: str = "features", block: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, dist, rank): the k nearest by cosine distance, self excluded, exact. Ties: the smaller key. Vectors that are null or zero have
    no distance and no neighbours.

    The number of blocks comes from the number of rows, so a task holds two blocks of about ``block`` rows however many rows there are.
    Each pair of blocks is scored once, for both sides. The work is that of all pairs; ``approximate_knn`` is the way for more rows.
    """
    return _nearest(df.select(F.lit(0).alias("bucket"), F.col(key).alias("id"), F.col(features).alias("v")), k, block)


def approximate_knn(df: DataFrame, key: str, k: int, features: str = "features", tables: int = 8, rows: int = 1024, seed: int = 1, block: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, dist, rank) as ``knn``, with neighbours sought only among rows that share a bucket in one of ``tables`` hash tables.

    A bucket is the side of random hyperplanes through the mean, as many as leave about ``rows`` rows a bucket. All rows are indexed.
    A bucket of more than ``block`` rows is scored block against block, so none is held whole; equal pairs of two tables count once.
    """
    mean, _, n = moments(df.where(F.col(features).isNotNull()), features)
    bits = max(0, int(np.ceil(np.log2(max(n / rows, 1)))))
    planes = np.random.default_rng(seed).standard_normal((len(mean), tables * bits))

    def run(frames):
        for f in frames:
            side = ((np.stack(f.v.to_numpy()).astype(float) - mean) @ planes > 0).reshape(len(f), tables, bits) if len(f) else np.zeros((0, tables, bits), bool)
            code = (side * 2 ** np.arange(bits)).sum(2) + np.arange(tables) * 2**bits
            yield pd.DataFrame({"id": f.id, "v": f.v, "buckets": list(code.astype("int64"))})

    d = df.where(F.col(features).isNotNull()).select(F.col(key).alias("id"), F.col(features).alias("v"))
    kinds = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in d.schema)
    return _nearest(d.mapInPandas(run, f"{kinds}, buckets array<bigint>").select(F.explode("buckets").alias("bucket"), "id", "v"), k, block)


def _nearest(x: DataFrame, k: int, block: int) -> DataFrame:
    """The k nearest of each id among the rows of its buckets: (bucket, id, v) to (a, b, dist, rank)."""
    from pyspark.sql import Window

    x = x.where(F.col("id").isNotNull() & F.col("v").isNotNull())
    n = x.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    x = x.join(storage.counted(n, "buckets"), "bucket").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    # Block i meets block j once, as the pair (min, max): a row goes to every pair that its block is in.
    x = x.select("bucket", "own", "id", "v", other).select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "v")

    def best(ia, xa, ib, xb):
        d = 1 - xa @ xb.T
        d[(ia[:, None] == ib[None]) | np.isnan(d)] = np.inf
        order = np.argsort(ib, kind="stable")  # ties: the smaller key
        pick = order[np.argsort(d[:, order], axis=1, kind="stable")[:, : min(k, d.shape[1])]]
        rows = np.repeat(np.arange(len(ia)), pick.shape[1])
        return pd.DataFrame({"a": ia[rows], "b": ib[pick.ravel()], "dist": d[rows, pick.ravel()]})

    def run(key, f):
        at = f.own.to_numpy() == key[1]
        ids, v = f.id.to_numpy(), np.stack(f.v.to_numpy()).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            v = v / np.linalg.norm(v, axis=1, keepdims=True)
        if key[1] == key[2]:
            return best(ids, v, ids, v)
        return pd.concat([best(ids[at], v[at], ids[~at], v[~at]), best(ids[~at], v[~at], ids[at], v[at])]) if at.any() and not at.all() else pd.DataFrame({"a": ids[:0], "b": ids[:0], "dist": v[:0, 0]})

    kind = x.schema["id"].dataType.simpleString()
    c = x.groupBy("bucket", "lo", "hi").applyInPandas(run, f"a {kind}, b {kind}, dist double").where(F.col("dist") < float("inf"))
    c = c.groupBy("a", "b").agg(F.min("dist").alias("dist"))
    w = Window.partitionBy("a").orderBy("dist", "b")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def classifiers(features: Sequence[str], label: str = "label", weight: str = "weight", trees: int = 100):
    """Pipelines by name: median imputation, then logistic regression (scaled), tree, forest."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    def pre():
        return [Imputer(strategy="median", inputCols=list(features), outputCols=[f"{c}_i" for c in features]), VectorAssembler(inputCols=[f"{c}_i" for c in features], outputCol="raw_features")]

    return {
        "logistic": Pipeline(stages=[*pre(), StandardScaler(inputCol="raw_features", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", labelCol=label, weightCol=weight, maxIter=200)]),
        "tree": Pipeline(stages=[*pre(), DecisionTreeClassifier(featuresCol="raw_features", labelCol=label, weightCol=weight, maxDepth=5, minInstancesPerNode=20, seed=1)]),
        "forest": Pipeline(stages=[*pre(), RandomForestClassifier(featuresCol="raw_features", labelCol=label, weightCol=weight, numTrees=trees, maxDepth=8, minInstancesPerNode=10, seed=1)]),
    }


def cross_validated(df: DataFrame, make, n: int, fold: str = "fold") -> DataFrame:
    """df with prediction, each row by a model of the other folds (0 to n - 1). make: gives a new unfitted pipeline."""
    parts = [make().fit(df.where(F.col(fold) != k)).transform(df.where(F.col(fold) == k)).select(*df.columns, "prediction") for k in range(n)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """label, precision, recall, f1, support of each class that occurs in truth or prediction; 0 where a ratio has no base.

    Each row counts once for its truth and once for its prediction, so one aggregate does it.
    """
    right = F.when(F.col(label) == F.col(prediction), 1).otherwise(0)
    both = F.explode(F.array(F.struct(F.col(label).alias("c"), right.alias("tp"), F.lit(1).alias("s"), F.lit(0).alias("g")), F.struct(F.col(prediction).cast(dict(df.dtypes)[label]).alias("c"), F.lit(0).alias("tp"), F.lit(0).alias("s"), F.lit(1).alias("g")))).alias("e")
    n = df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull()).select(both).groupBy(F.col("e.c").alias("label")).agg(F.sum("e.tp").alias("tp"), F.sum("e.s").alias("support"), F.sum("e.g").alias("given"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, s, g = F.col("tp"), F.col("support"), F.col("given")
    return n.select("label", ratio(tp, g).alias("precision"), ratio(tp, s).alias("recall"), ratio(2 * tp, s + g).alias("f1"), "support")


def member_probabilities(model, df: DataFrame, key: str, positive: int = 1) -> DataFrame:
    """key, member, probability of the positive class by each tree of a fitted forest pipeline. All trees index classes by label,
    so their orders agree."""
    from pyspark.ml.functions import vector_to_array

    d = df
    for stage in model.stages[:-1]:
        d = stage.transform(d)
    rows = []
    for i, tree in enumerate(model.stages[-1].trees):
        d = tree.setPredictionCol("").setProbabilityCol("").setRawPredictionCol(f"_raw{i}").transform(d)
        a = vector_to_array(F.col(f"_raw{i}"))
        rows.append(F.struct(F.lit(i).alias("member"), (a[positive] / F.aggregate(a, F.lit(0.0), lambda s, v: s + v)).alias("probability")))
    return d.select(key, F.explode(F.array(*rows)).alias("m")).select(key, "m.member", "m.probability")


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds weight: n / (classes * n of the class)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    total = n.agg(F.sum("_c").alias("_t"), F.count(F.lit(1)).alias("_k"))
    return df.join(storage.counted(n, "classes"), label).crossJoin(F.broadcast(total)).withColumn("weight", F.col("_t") / (F.col("_k") * F.col("_c"))).drop("_c", "_t", "_k")


def quantile_distance(a: DataFrame, b: DataFrame, value: str, quantiles: int = 101) -> DataFrame:
    """Mean absolute difference of the quantile functions of two samples, on an even grid of exact quantiles."""
    q = F.array(*(F.lit(i / (quantiles - 1)) for i in range(quantiles)))
    pa = a.agg(F.percentile(value, q).alias("qa"))
    pb = b.agg(F.percentile(value, q).alias("qb"))
    return pa.crossJoin(pb).select((F.aggregate(F.zip_with("qa", "qb", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v) / quantiles).alias("distance"))


def wasserstein_1d(a: DataFrame, b: DataFrame, value: str, buckets: int = 200) -> DataFrame:
    """The 1-D Wasserstein distance of two samples: the integral of |F_a - F_b| over all their values; nulls don't count.
    NULL if a sample is empty.

    Counts by distinct value, then cumulative shares bucket by bucket: bounds of buckets only spread the work, so that
    rounded quantiles do, and any choice gives the same result.
    """
    from pyspark.sql import Window

    one = lambda df, na, nb: df.select(F.col(value).cast("double").alias("v"), F.lit(na).alias("a"), F.lit(nb).alias("b")).where(F.col("v").isNotNull())
    counts = storage.written(one(a, 1, 0).unionByName(one(b, 0, 1)).groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "wasserstein")
    bounds = counts.agg(F.percentile_approx("v", [i / buckets for i in range(1, buckets)]).alias("q")).first().q or []
    bounds = F.array(*map(F.lit, sorted(set(bounds)))).cast("array<double>")
    c = counts.withColumn("k", F.size(F.filter(bounds, lambda q: q <= F.col("v"))))
    # One row a bucket: what comes before it, and where the next begins.
    w = Window.orderBy("k")
    each = c.groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.min("v").alias("low"))
    before = each.select("k", (F.sum("a").over(w) - F.col("a")).alias("a0"), (F.sum("b").over(w) - F.col("b")).alias("b0"), F.lead("low").over(w).alias("next"))
    total = each.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    u = Window.partitionBy("k").orderBy("v")
    steps = c.join(F.broadcast(before), "k").select("v", (F.sum("a").over(u) + F.col("a0")).alias("a"), (F.sum("b").over(u) + F.col("b0")).alias("b"), F.coalesce(F.lead("v").over(u), F.col("next"), F.col("v")).alias("to"))
    share = lambda x, t: F.col(x) / F.nullif(F.col(t), F.lit(0))
    return steps.crossJoin(F.broadcast(total)).agg(F.sum(F.abs(share("a", "ta") - share("b", "tb")) * (F.col("to") - F.col("v"))).alias("distance"))
