"""Connected regions of binary rasters: labels, sizes, hole filling, centroids, distances.

Regions are labelled in two steps. Each block of a scene is labelled on its own, in one task and one pass over its
pixels; then the labels that touch across block borders are joined by alternating star steps on the border pairs alone,
which are few. Scenes of any size work: no task holds more than a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import haversine_km
from ..storage import counted, dropped, written

BLOCK = 256


def _local(y: np.ndarray, x: np.ndarray, eight: bool) -> np.ndarray:
    """Region of each pixel in a block, as the index of its first pixel in (y, x) order."""
    at = {p: i for i, p in enumerate(zip(y.tolist(), x.tolist()))}
    parent = list(range(len(y)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    back = ((-1, 0), (0, -1), *(((-1, -1), (-1, 1)) if eight else ()))
    for (py, px), i in at.items():
        for dy, dx in back:
            j = at.get((py + dy, px + dx))
            if j is not None:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(len(y))], np.int64)


def labelled(df: DataFrame, eight: bool = True, block: int = BLOCK) -> DataFrame:
    """(scene, y, x, region): regions of the pixels in df; region is the least y * 2**31 + x of its pixels."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["y", "x"], ignore_index=True)
        own = _local(f.y.to_numpy(), f.x.to_numpy(), eight)
        code = f.y.to_numpy().astype(np.int64) * 2**31 + f.x.to_numpy()
        return pd.DataFrame({"scene": f.scene, "y": f.y, "x": f.x, "part": code[own]})

    b = df.select(F.col("scene").cast("bigint").alias("scene"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    b = b.withColumns({"_by": F.floor(F.col("y") / block), "_bx": F.floor(F.col("x") / block)})
    parts = written(b.groupBy("scene", "_by", "_bx").applyInPandas(run, "scene bigint, y int, x int, part bigint"), "parts")
    # Pixels at block borders, joined to their neighbours in other blocks.
    edge = parts.where((F.col("y") % block).isin(0, block - 1) | (F.col("x") % block).isin(0, block - 1))
    steps = [(0, 1), (1, 0), *(((1, 1), (1, -1)) if eight else ())]
    to = F.explode(F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in steps)))
    out = edge.select("scene", F.col("part").alias("a"), to.alias("p")).select("scene", "a", "p.y", "p.x")
    links = out.join(edge.withColumnRenamed("part", "b"), ["scene", "y", "x"]).where("a <> b").select("scene", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    roots = _roots(links)
    joined = parts.join(roots, ["scene", "part"], "left")
    return joined.select("scene", "y", "x", F.coalesce("root", "part").alias("region"))


def _roots(links: DataFrame) -> DataFrame:
    """(scene, part, root) of parts linked across borders: labels take the least neighbouring label until none changes."""
    both = written(links.select("scene", "a", "b").unionByName(links.select("scene", F.col("b").alias("a"), F.col("a").alias("b"))), "part-links")
    label = written(both.groupBy("scene", F.col("a").alias("part")).agg(F.least(F.min("b"), F.min("a")).alias("root")), "roots")
    while True:
        seen = both.join(label.select("scene", F.col("part").alias("b"), "root"), ["scene", "b"]).groupBy("scene", F.col("a").alias("part")).agg(F.min("root").alias("near"))
        new = label.join(seen, ["scene", "part"]).select("scene", "part", F.least("root", "near").alias("root"), (F.col("near") < F.col("root")).alias("changed"))
        # Pointer jumping: a label's own label.
        jump = label.select("scene", F.col("part").alias("root"), F.col("root").alias("further"))
        new = written(new.join(jump, ["scene", "root"], "left").select("scene", "part", F.least("root", F.coalesce("further", "root")).alias("root"), "changed"), "roots")
        more = new.agg(F.max(F.col("changed").cast("int"))).first()[0]
        dropped(label)
        label = new.select("scene", "part", "root")
        if not more:
            return label


def sizes(regions: DataFrame) -> DataFrame:
    return regions.groupBy("scene", "region").agg(F.count(F.lit(1)).alias("size"), F.avg("y").alias("cy"), F.avg("x").alias("cx"))


def filled(df: DataFrame, meta: DataFrame, value: str = "value") -> DataFrame:
    """Adds filled: 1 also in holes, the background regions (joined by sides) that don't touch the scene's border."""
    from .grid import dense

    ones = df.where(F.col(value) == 1).select("scene", "y", "x")
    back = labelled(dense(meta).join(ones, ["scene", "y", "x"], "left_anti"), eight=False)
    edge = back.join(counted(meta, "scenes"), "scene").where((F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == F.col("height") - 1) | (F.col("x") == F.col("width") - 1)).select("scene", "region").distinct()
    holes = back.join(edge, ["scene", "region"], "left_anti").select("scene", "y", "x")
    return dense(meta).join(ones.unionByName(holes).withColumn("filled", F.lit(1)), ["scene", "y", "x"], "left").withColumn("filled", F.coalesce("filled", F.lit(0)))


def large_regions(df: DataFrame, least: int, value: str = "value") -> DataFrame:
    """Pixels of the regions of ones that have ``least`` pixels or more, with region and size."""
    r = labelled(df.where(F.col(value) == 1))
    return r.join(sizes(r).where(F.col("size") >= least).select("scene", "region", "size"), ["scene", "region"])


def largest_region(df: DataFrame, value: str = "value") -> DataFrame:
    r = labelled(df.where(F.col(value) == 1))
    best = sizes(r).groupBy("scene").agg(F.max(F.struct("size", (-F.col("region")).alias("k"))).alias("m")).select("scene", (-F.col("m.k")).alias("region"))
    return r.join(best, ["scene", "region"], "left_semi")


def centroid_distances(points: DataFrame) -> DataFrame:
    """Great-circle distances between the centroids (id, lat, lon) of each pair of instances, a few rows by nature."""
    a, b = points.select(F.col("id").alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1")), points.select(F.col("id").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("km"))
