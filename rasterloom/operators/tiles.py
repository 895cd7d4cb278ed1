"""Tiles: sliding windows, block statistics, tile labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def covering(v: Column, size: int, step: int, extent: int) -> Column:
    """Indexes k of the tiles [k * step, k * step + size) that hold v and lie whole inside the extent."""
    first = F.greatest(F.lit(0), F.ceil((v - size + 1) / F.lit(step)))
    last = F.least(F.floor(v / F.lit(step)), F.lit((extent - size) // step))
    return F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))


def sliding(df: DataFrame, size: int, step: int, height: int, width: int) -> DataFrame:
    """Each pixel with each tile (tile_y, tile_x) that covers it. Incomplete tiles at the far edges don't exist."""
    d = df.withColumn("tile_y", F.explode(covering(F.col("y"), size, step, height)))
    return d.withColumn("tile_x", F.explode(covering(F.col("x"), size, step, width)))


def packed(tiled: DataFrame, size: int, step: int, value: str = "value") -> DataFrame:
    """(scene, tile_y, tile_x, y0, x0, data) of full tiles, data by line then sample."""
    g = tiled.groupBy("scene", "tile_y", "tile_x").agg(F.sort_array(F.collect_list(F.struct("y", "x", value))).alias("l"))
    g = g.where(F.size("l") == size * size)
    return g.select("scene", "tile_y", "tile_x", (F.col("tile_y") * step).alias("y0"), (F.col("tile_x") * step).alias("x0"), F.transform("l", lambda e: e[value]).alias("data"))


def stats(tiled: DataFrame, value: str = "value") -> DataFrame:
    return tiled.groupBy("scene", "tile_y", "tile_x").agg(F.count(value).alias("n"), F.max(value).alias("v_max"), F.min(value).alias("v_min"), F.avg(value).alias("v_mean"), F.stddev_pop(value).alias("v_std"))


def useful(tile_stats: DataFrame, least: float = 1e-7) -> DataFrame:
    """Tiles with a valid value that aren't constant."""
    return tile_stats.where(F.col("v_max").isNotNull() & (F.col("v_std") >= least))


def edge_tiles(df: DataFrame, size: int, height: int, width: int) -> DataFrame:
    """Non-overlapping tiles counted from the far corner, for the lines and samples that whole tiles leave out."""
    ty, tx = F.floor((height - 1 - F.col("y")) / F.lit(size)).cast("int"), F.floor((width - 1 - F.col("x")) / F.lit(size)).cast("int")
    rest_y, rest_x = height % size, width % size
    in_rest = (F.col("y") >= height - rest_y) | (F.col("x") >= width - rest_x)
    d = df.withColumns({"tile_y": ty, "tile_x": tx})
    touched = d.where(in_rest).select("scene", "tile_y", "tile_x").distinct()
    whole = (F.col("tile_y") < height // size) & (F.col("tile_x") < width // size)
    return d.join(touched, ["scene", "tile_y", "tile_x"], "left_semi").where(whole)


def block_mean(df: DataFrame, n: int, value: str = "value") -> DataFrame:
    """Mean of the valid pixels of each n x n block."""
    return df.groupBy("scene", F.floor(F.col("y") / n).cast("int").alias("y"), F.floor(F.col("x") / n).cast("int").alias("x")).agg(F.avg(value).alias("mean"))


def tile_label(tiled: DataFrame, label: str) -> DataFrame:
    """The largest label in each tile."""
    return tiled.groupBy("scene", "tile_y", "tile_x").agg(F.max(label).alias("label"))
