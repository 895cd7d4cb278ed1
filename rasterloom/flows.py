"""Whole jobs composed of the operators: each takes and returns DataFrames, so that Catalyst plans a job as one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .operators import grid, learning, matchup, merging, metrics


def class_sets(pixels: DataFrame, by: Sequence[str], label: str, klass: str, t: float) -> DataFrame:
    """(by..., label, bin): the most frequent class (ties: the least) of each label of a group, where its share is t or more.
    Labels and classes below 0, or null, don't count."""
    d = pixels.where((F.col(label) >= 0) & (F.col(klass) >= 0)).groupBy(*by, F.col(label).alias("label"), F.col(klass).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    m = d.groupBy(*by, "label").agg(F.max(F.struct("n", (-F.col("bin")).alias("k"))).alias("m"), F.sum("n").alias("total"))
    return m.where(F.col("m.n") / F.col("total") >= t).select(*by, "label", (-F.col("m.k")).alias("bin"))


def classed(pixels: DataFrame, sets: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """Adds value: the bin of the pixel's label, 0 where it is in no set, -1 where there is no label."""
    s = storage.counted(sets.withColumnsRenamed({"label": "_label", "bin": "_bin", **{c: f"_s_{c}" for c in by}}), "class-sets")
    on = F.col(label) == F.col("_label")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    out = pixels.join(s, on, "left").withColumn("value", F.when(F.col(label) >= 0, F.coalesce("_bin", F.lit(0))).otherwise(-1).cast("int"))
    return out.drop("_label", "_bin", *(f"_s_{c}" for c in by))


def post_inference(pixels: DataFrame, stream: str, place: Sequence[str], label: str = "label", klass: str = "klass", t: float = 0.5, child: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Class sets (stream, label, bin) and the merged product (place..., value, dqi) of several streams of cluster labels.

    First pass: labels get classes from ``klass``, and the streams' maps are merged, the least ``stream`` first. Second pass: labels (``child``, where
    clusters have children) are compared with that merged map instead. Both passes' sets are merged, the higher bin wins, and the
    maps are merged again from the result. With children the second pass's sets stand alone, as labels of the two passes differ.
    """
    merge = lambda d: merging.daily_merge(d.select(*place, F.col(stream).alias("prio"), "value"), place, veto=False)
    first = class_sets(pixels, [stream], label, klass, t)
    product = merge(classed(pixels, first, [stream], label))
    seen = pixels.join(product.select(*place, F.col("value").alias("_seen")), list(place))
    second = class_sets(seen, [stream], child or label, "_seen", t)
    sets = second if child else first.unionByName(second).groupBy(stream, "label").agg(F.max("bin").alias("bin"))
    return sets, merge(classed(pixels, sets, [stream], child or label))


def matched_validation(targets: DataFrame, families: Sequence[tuple[DataFrame, int, float]], by: Sequence[str], key: str, path: str, maps: DataFrame, truths: DataFrame) -> dict[str, DataFrame]:
    """Matchup, then comparison. targets: (key, by..., ts); maps: (key, y, x, pred); truths: (path, y, x, truth), both 0 or 1.

    scenes: confusion counts and metrics of each matched target; summary: over scenes; audit: every target's status.
    """
    m = storage.written(matchup.asof_families(targets, families, by, [key], path), "matchup")
    both = maps.join(m.select(key, path), key).join(truths, [path, "y", "x"])
    counts = metrics.confusion(both, "truth", "pred", [key])
    return {"scenes": counts.withColumns(metrics.binary_metrics()), "summary": metrics.summary(counts), "audit": matchup.audit(targets, m, [key])}


def located_labels(pixels: DataFrame, model: Callable[[np.ndarray], np.ndarray], transform: Sequence[float], features: str = "features") -> DataFrame:
    """Adds label, the place of the largest output of a batch function (rows, features) -> (rows, k), and the pixel centre's map
    coordinates mx, my by an affine transform as ``grid.affine`` takes it."""
    best = lambda x: np.asarray(model(x)).argmax(1)[:, None]
    out = learning.encode(pixels, best, features, "_best").withColumn("label", F.col("_best")[0].cast("int")).drop("_best")
    mx, my = grid.affine(F.col("x"), F.col("y"), transform)
    return out.withColumns({"mx": mx, "my": my})


def trained_clusters(df: DataFrame, key: str, features: str, k: int, children: int, least: int, keep: float = 0.99) -> DataFrame:
    """(key, label, child, cluster): an encoder of the leading components, k-means on its output, and k-means inside each cluster."""
    mean, parts = learning.pca_fit(df, keep, features)
    z = learning.encode(df.select(key, features), lambda x: (x - mean) @ parts, features, "z").select(key, "z")
    z = storage.written(learning.kmeans(z, k, "z"), "trained")
    return learning.cluster_tree(z, children, least, key, "z").select(key, "label", "child", "cluster")


def split_files(files: DataFrame, train: str, day: str, cutoff: str, path: str = "path") -> DataFrame:
    """Adds part to a catalog: train where the name matches the pattern and the day is before the cutoff, test where it matches from
    that day on, unused elsewhere."""
    ok = F.coalesce(F.col(path).rlike(train) & F.col(day).isNotNull(), F.lit(False))
    return files.withColumn("part", F.when(~ok, "unused").when(F.col(day) < F.lit(cutoff).cast("date"), "train").otherwise("test"))


def tile_features(pixels: DataFrame, side: int, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(scene, ty, tx, features): shares of a tile's valid pixels in even bins from low to high; what lies outside counts in the
    first or last bin."""
    b = F.least(F.greatest(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1)).cast("int")
    tile = [F.col("scene"), F.floor(F.col("y") / side).cast("int").alias("ty"), F.floor(F.col("x") / side).cast("int").alias("tx")]
    d = pixels.where(F.col(value).isNotNull()).select(*tile, b.alias("b"))
    n = d.groupBy("scene", "ty", "tx").agg(*(F.count_if(F.col("b") == i).alias(f"_{i}") for i in range(bins)), F.count(F.lit(1)).alias("_n"))
    return n.select("scene", "ty", "tx", F.array(*(F.col(f"_{i}") / F.col("_n") for i in range(bins))).alias("features"))


def tile_clusters(pixels: DataFrame, side: int, value: str, low: float, high: float, bins: int, k: int) -> DataFrame:
    """(scene, y, x, cluster): tiles clustered by their features, and painted back on their pixels."""
    t = learning.kmeans(tile_features(pixels, side, value, low, high, bins), k).select("scene", "ty", "tx", F.col("label").alias("cluster"))
    p = pixels.withColumns({"ty": F.floor(F.col("y") / side).cast("int"), "tx": F.floor(F.col("x") / side).cast("int")})
    return p.join(t, ["scene", "ty", "tx"]).select("scene", "y", "x", "cluster")


#: Items of a distance matrix that one machine solves.
MDS_ITEMS = 5_000


def distance_rows(pairs: DataFrame) -> DataFrame:
    """(a, features): each item's distances to all items, in their order, from unordered pairs (a, b, dist); 0 to itself."""
    both = pairs.select("a", "b", "dist").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "dist"))
    own = both.select("a").distinct().select("a", F.col("a").alias("b"), F.lit(0.0).alias("dist"))
    d = both.unionByName(own).groupBy("a", "b").agg(F.max("dist").alias("dist"))
    return d.groupBy("a").agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "dist"))), lambda e: e["dist"]).alias("features"))


def scaled_distances(pairs: DataFrame, k: int) -> DataFrame:
    """(a, features): classical scaling of a full distance matrix to k coordinates. One machine solves it: more than MDS_ITEMS items are an error."""
    rows = distance_rows(pairs).orderBy("a").limit(MDS_ITEMS + 1).collect()
    if len(rows) > MDS_ITEMS:
        raise ValueError(f"more than {MDS_ITEMS} items")
    if not rows or any(len(r.features) != len(rows) for r in rows):
        raise ValueError("not all pairs have a distance")
    d2 = np.array([r.features for r in rows]) ** 2
    centred = d2 - d2.mean(0) - d2.mean(1)[:, None] + d2.mean()
    w, v = np.linalg.eigh(-centred / 2)
    w, v = w[::-1][:k].clip(0), v[:, ::-1][:, :k]
    z = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])]) * np.sqrt(w)
    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.sparkSession.createDataFrame([(r.a, x.tolist()) for r, x in zip(rows, z)], f"a {kind}, features array<double>")
