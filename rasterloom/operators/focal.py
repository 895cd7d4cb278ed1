"""Neighbourhoods of pixels.

A pixel is copied to the places whose neighbourhood it is in, and one aggregate by place does the rest: partial sums run
before the shuffle, and no join is needed. Sums and extremes over boxes scatter along samples, then along lines, so that their
work grows with the radius and not with its square.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions.scalars import binary_entropy


def offsets(r: int) -> Column:
    return F.sequence(F.lit(-r), F.lit(r))


def scattered(df: DataFrame, r: int, *values: str) -> DataFrame:
    """(scene, y, x, dy, dx, values): each pixel as the neighbour (dy, dx) of the places around it."""
    d = df.select("scene", "y", "x", *values).withColumn("dy", F.explode(offsets(r))).withColumn("dx", F.explode(offsets(r)))
    return d.withColumns({"y": F.col("y") - F.col("dy"), "x": F.col("x") - F.col("dx")})


def neighbourhood(df: DataFrame, p: int, value: str = "value") -> DataFrame:
    """(scene, y, x, features): the (2p + 1)^2 values around each pixel, by line then sample; only complete ones."""
    d = scattered(df, p, value).groupBy("scene", "y", "x").agg(F.sort_array(F.collect_list(F.struct("dy", "dx", value))).alias("n"))
    return d.where(F.size("n") == (2 * p + 1) ** 2).select("scene", "y", "x", F.transform("n", lambda e: e[value]).alias("features"))


def shift(df: DataFrame, dy: int, dx: int, value: str, fill: float) -> DataFrame:
    """Adds shifted: the value at (y + dy, x + dx), fill where there is none."""
    other = df.select("scene", (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col(value).alias("shifted"))
    return df.join(other, ["scene", "y", "x"], "left").withColumn("shifted", F.coalesce("shifted", F.lit(fill)))


def class_stats(df: DataFrame, r: int, label: str = "label") -> DataFrame:
    """Focal statistics of labels: share equal to the centre (which counts), neighbours that are valid, distinct values
    (outside the raster, or without a label, counts as one more), and the entropy of the share. Only at pixels that exist: one
    without a label equals none of its neighbours; without valid neighbours as well its share and distinct values are 0, its entropy NULL."""
    d = scattered(df, r, label)
    own = (F.col("dy") == 0) & (F.col("dx") == 0)
    centre, here = F.max(F.when(own, F.col(label))), F.max(F.when(own, F.lit(True)))
    g = d.groupBy("scene", "y", "x").agg(centre.alias("centre"), here.alias("here"), F.count(label).alias("n_valid"), F.collect_list(label).alias("l"))
    same = F.when(F.col("centre").isNull(), 0).otherwise(F.size(F.filter("l", lambda v: v == F.col("centre"))))
    g = g.where("here").withColumn("frac_same", same / F.greatest(F.col("n_valid"), F.lit(1)))
    distinct = F.when(F.col("n_valid") == 0, 0).otherwise(F.size(F.array_distinct("l")) + F.when(F.col("n_valid") < (2 * r + 1) ** 2, 1).otherwise(0))
    return g.select("scene", "y", "x", F.col("centre").alias(label), "frac_same", "n_valid", distinct.alias("n_distinct"), F.when(F.col("n_valid") > 0, binary_entropy(F.col("frac_same"))).alias("entropy"))


def class_fractions(df: DataFrame, r: int, classes: Sequence[int], klass: Column) -> DataFrame:
    """Share of each class among the valid neighbours (the centre included); frac_<k> columns."""
    d = scattered(df.withColumn("_k", klass), r, "_k")
    here = F.max(F.when((F.col("dy") == 0) & (F.col("dx") == 0), F.lit(True)))
    g = d.groupBy("scene", "y", "x").agg(here.alias("here"), *((F.count_if(F.col("_k") == k) / F.count("_k")).alias(f"frac_{k}") for k in classes))
    return g.where("here").drop("here")


def scale_deltas(stats: Sequence[tuple[int, DataFrame]], columns: Sequence[str]) -> DataFrame:
    """Statistics at several radii side by side, and each less that of the next smaller radius."""
    out = None
    for r, s in stats:
        s = s.select("scene", "y", "x", *(F.col(c).alias(f"{c}_r{r}") for c in columns))
        out = s if out is None else out.join(s, ["scene", "y", "x"])
    radii = [r for r, _ in stats]
    return out.withColumns({f"{c}_delta_r{b}_r{a}": F.col(f"{c}_r{b}") - F.col(f"{c}_r{a}") for a, b in zip(radii, radii[1:]) for c in columns})


def scattered_lines(df: DataFrame, r: int, value: str) -> DataFrame:
    """Box sums by scattering along samples, then along lines: 2 (2r + 1) copies in place of (2r + 1)^2."""
    a = df.select("scene", "y", F.explode(F.sequence(F.col("x") - r, F.col("x") + r)).alias("x"), F.col(value).alias("v"))
    a = a.groupBy("scene", "y", "x").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count("v").alias("n"))
    b = a.select("scene", F.explode(F.sequence(F.col("y") - r, F.col("y") + r)).alias("y"), "x", "s", "q", "n")
    return b.groupBy("scene", "y", "x").agg(F.sum("s").alias("box_sum"), F.sum("q").alias("box_sq"), F.sum("n").alias("box_n"))


def focal_mean(df: DataFrame, r: int, value: str = "value") -> DataFrame:
    """Mean of the valid pixels in the box around each pixel."""
    s = scattered_lines(df, r, value)
    return df.join(s, ["scene", "y", "x"]).withColumn("focal_mean", F.col("box_sum") / F.col("box_n")).drop("box_sum", "box_sq", "box_n")


def lee_filter(df: DataFrame, r: int, value: str = "value") -> DataFrame:
    """Speckle filter: local mean plus the deviation weighted by local variance over local and overall variance."""
    overall = df.groupBy("scene").agg(F.var_pop(value).alias("_all"))
    s = df.join(scattered_lines(df, r, value), ["scene", "y", "x"]).join(storage.counted(overall, "scenes"), "scene")
    mean = F.col("box_sum") / F.col("box_n")
    var = F.greatest(F.col("box_sq") / F.col("box_n") - mean * mean, F.lit(0.0))
    w = F.coalesce(F.try_divide(var, var + F.col("_all")), F.lit(0.0))
    return s.withColumn("filtered", mean + w * (F.col(value) - mean)).drop("box_sum", "box_sq", "box_n", "_all")


def dependency_filter(df: DataFrame, label: str, clusters: Sequence[int], half: int = 20, more_than: int = 20) -> DataFrame:
    """Pixels with more than ``more_than`` pixels of the given clusters in [y - half, y + half) x [x - half, x + half).

    Only pixels of those clusters are scattered, first along samples and then along lines.
    """
    own = df.where(F.col(label).isin(*clusters)).select("scene", "y", "x")
    a = own.select("scene", "y", F.explode(F.sequence(F.col("x") - half + 1, F.col("x") + half)).alias("x")).groupBy("scene", "y", "x").agg(F.count(F.lit(1)).alias("n"))
    b = a.select("scene", F.explode(F.sequence(F.col("y") - half + 1, F.col("y") + half)).alias("y"), "x", "n").groupBy("scene", "y", "x").agg(F.sum("n").alias("n"))
    return df.join(b.where(F.col("n") > more_than).withColumnRenamed("n", "n_near"), ["scene", "y", "x"])


def morph(df: DataFrame, how: str, times: int = 1, value: str = "value") -> DataFrame:
    """dilate or erode by 3 x 3, ``times`` over: the extreme over the (2 times + 1)^2 box around each pixel, in one step."""
    agg = F.max if how == "dilate" else F.min
    r = times
    a = df.select("scene", "y", F.explode(F.sequence(F.col("x") - r, F.col("x") + r)).alias("x"), F.col(value).alias("v")).groupBy("scene", "y", "x").agg(agg("v").alias("v"))
    b = a.select("scene", F.explode(F.sequence(F.col("y") - r, F.col("y") + r)).alias("y"), "x", "v").groupBy("scene", "y", "x").agg(agg("v").alias("morphed"))
    return df.join(b, ["scene", "y", "x"])


def remove_singles(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds cleaned: 1 where the pixel is 1 and has another 1 among its eight neighbours."""
    near = scattered(df.where(F.col(value) == 1), 1).where((F.col("dy") != 0) | (F.col("dx") != 0)).groupBy("scene", "y", "x").agg(F.count(F.lit(1)).alias("_n"))
    d = df.join(near, ["scene", "y", "x"], "left")
    return d.withColumn("cleaned", ((F.col(value) == 1) & F.col("_n").isNotNull()).cast("int")).drop("_n")


def majority_vote(df: DataFrame, r: int, value: str = "value") -> DataFrame:
    """Adds voted: 1 where more than half of the valid pixels in the box are 1."""
    s = scattered_lines(df, r, value).select("scene", "y", "x", (2 * F.col("box_sum") > F.col("box_n")).cast("int").alias("voted"))
    return df.join(s, ["scene", "y", "x"])


#: The 5-tap binomial kernel, as fractions of 16.
GAUSS = (1, 4, 6, 4, 1)


def gaussian_blur(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds blurred: 5 x 5 binomial blur over the valid pixels, separable, weights renormalised at edges."""
    w = F.array(*map(F.lit, GAUSS))
    a = df.select("scene", "y", "x", F.col(value).alias("v"), F.posexplode(w).alias("k", "w")).withColumn("x", F.col("x") + F.col("k") - 2)
    a = a.groupBy("scene", "y", "x").agg(F.sum(F.col("v") * F.col("w")).alias("v"), F.sum(F.when(F.col("v").isNotNull(), F.col("w"))).alias("n"))
    b = a.select("scene", "y", "x", "v", "n", F.posexplode(w).alias("k", "w")).withColumn("y", F.col("y") + F.col("k") - 2)
    b = b.groupBy("scene", "y", "x").agg((F.sum(F.col("v") * F.col("w")) / F.sum(F.col("n") * F.col("w"))).alias("blurred"))
    return df.join(b, ["scene", "y", "x"])
