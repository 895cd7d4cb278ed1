"""Grids: overlays, resampling, dense grids, coordinates.

Searches within a radius are equi-joins on cells of the radius' size, never nested loops: one side is copied to the
cells around it, and the exact distance decides.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions.scalars import EARTH_KM, haversine_km


def overlay(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Pixels that both rasters have, by place."""
    return a.join(b, list(on), how)


def affine(x: Column, y: Column, gt: Sequence[float]) -> tuple[Column, Column]:
    """Map coordinates of pixel centres."""
    cx, cy = x + 0.5, y + 0.5
    return gt[0] + cx * gt[1] + cy * gt[2], gt[3] + cx * gt[4] + cy * gt[5]


def affine_inverse(mx: Column, my: Column, gt: Sequence[float]) -> tuple[Column, Column]:
    """The pixel that holds a map coordinate."""
    det = gt[1] * gt[5] - gt[2] * gt[4]
    dx, dy = mx - gt[0], my - gt[3]
    return F.floor((dx * gt[5] - dy * gt[2]) / det).cast("int"), F.floor((dy * gt[1] - dx * gt[4]) / det).cast("int")


def scaled_transform(gt: Column, width: int, ref_width: int, height: int, ref_height: int) -> Column:
    """Geotransform of a raster of another size over the same extent."""
    return F.array(gt[0], gt[1] * ref_width / width, gt[2], gt[3], gt[4], gt[5] * ref_height / height)


def extent_transform(df: DataFrame, lon: str = "lon", lat: str = "lat", by: Sequence[str] = ()) -> DataFrame:
    """Geotransform from the extremes of the coordinates and the size of the grid."""
    m = df.groupBy(*by).agg(F.min(lon).alias("w"), F.max(lon).alias("e"), F.min(lat).alias("s"), F.max(lat).alias("n"), (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return m.select(*by, F.col("w").alias("x0"), ((F.col("e") - F.col("w")) / F.col("width")).alias("dx"), F.col("n").alias("y0"), (-(F.col("n") - F.col("s")) / F.col("height")).alias("dy"), "width", "height")


def dense(meta: DataFrame) -> DataFrame:
    """All pixels (scene, y, x) of scenes given by (scene, height, width)."""
    return meta.select("scene", "width", F.explode(F.sequence(F.lit(0), F.col("height").cast("int") - 1)).alias("y")).select("scene", "y", F.explode(F.sequence(F.lit(0), F.col("width").cast("int") - 1)).alias("x"))


def reconstruct(df: DataFrame, meta: DataFrame, fills: dict[str, float]) -> DataFrame:
    """The dense raster of sparse pixels: absent ones get the column's fill."""
    out = dense(meta).join(df, ["scene", "y", "x"], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def paste(df: DataFrame, y0: int, x0: int) -> DataFrame:
    """Coordinates of a sub-scene in its full grid."""
    return df.withColumns({"y": F.col("y") + y0, "x": F.col("x") + x0})


def paste_last(parts: DataFrame, seq: str, value: str = "value") -> DataFrame:
    """One value a pixel from overlapping tiles: the last by sequence."""
    return parts.groupBy("scene", "y", "x").agg(F.max_by(value, seq).alias(value))


def nearest_resize(df: DataFrame, height: int, width: int, to_height: int, to_width: int) -> DataFrame:
    """Resampled to another size: target (r, c) takes the source pixel (floor(r * h / H), floor(c * w / W)).

    Each source pixel is copied to the target places that read it, so no join is needed.
    """
    def places(v, size, to):
        # r with floor(r * size / to) = v: r * size in [v * to, v * to + to - 1]
        lo, hi = F.ceil(v * F.lit(to) / F.lit(size)), F.least(F.ceil((v + 1) * F.lit(to) / F.lit(size)) - 1, F.lit(to - 1))
        return F.when(lo <= hi, F.sequence(lo.cast("int"), hi.cast("int"))).otherwise(F.array().cast("array<int>"))

    rest = [c for c in df.columns if c not in ("y", "x")]
    d = df.select(*rest, "x", F.explode(places(F.col("y"), height, to_height)).alias("y"))
    return d.select(*rest, "y", F.explode(places(F.col("x"), width, to_width)).alias("x"))




def within_radius(points: DataFrame, targets: DataFrame, km: float, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of points and targets (both with lat, lon; targets as t_lat, t_lon) up to km apart, with their distance.

    Cells: cubes around places on the sphere in three dimensions, of the chord's length, so that poles and the 180 degree
    meridian are like any other place. Targets are copied to the 27 cells around them. ``by``: further equality columns,
    such as the date.
    """
    cells = ("_cx", "_cy", "_cz")
    side = 2 * math.sin(min(km / (2 * EARTH_KM), math.pi / 2)) * (1 + 1e-6)

    def cell(lat: str, lon: str) -> list[Column]:
        la, lo = F.radians(lat), F.radians(lon)
        return [F.floor(v / side) for v in (F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))]

    p = points.withColumns(dict(zip(cells, cell("lat", "lon"))))
    t = targets.withColumns(dict(zip(cells, cell("t_lat", "t_lon"))))
    for c in cells:
        t = t.withColumn(c, F.explode(F.array(*(F.col(c) + d for d in (-1, 0, 1)))))
    out = p.join(t, [*by, *cells]).drop(*cells)
    return out.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"))).where(F.col("km") <= km)


def resample_nearest(source: DataFrame, targets: DataFrame, km: float, key: Sequence[str], value: str, tie: str) -> DataFrame:
    """Each target's value of the nearest source within km (ties: the least ``tie``); targets without one are absent.

    An aggregate with a minimum of (distance, tie, value), combined before the shuffle: no sort.
    """
    m = within_radius(source, targets, km)
    return m.groupBy(*key).agg(F.min(F.struct(F.round("km", 9).alias("km"), F.col(tie), F.col(value))).alias("m")).select(*key, f"m.{value}", "m.km")


def bucket_max(points: DataFrame, west: float, north: float, res: float, value: str = "value") -> DataFrame:
    """Largest value of the points in each cell of a grid."""
    x, y = F.floor((F.col("lon") - west) / res).cast("int"), F.floor((F.lit(north) - F.col("lat")) / res).cast("int")
    return points.groupBy(y.alias("y"), x.alias("x")).agg(F.max(value).alias(value))


def swath_to_grid(points: DataFrame, box: Sequence[float], res: float, how: str = "max", value: str = "value") -> DataFrame:
    """Points of a swath onto the grid of a box (west, south, east, north). Points on its east and south edges fall out."""
    west, south, east, north = box
    w, h = (math.ceil(round((b - a) / res, 9)) for a, b in ((west, east), (south, north)))
    x, y = F.floor((F.col("lon") - west) / res).cast("int"), F.floor((F.lit(north) - F.col("lat")) / res).cast("int")
    agg = {"max": F.max, "sum": F.sum, "mean": F.avg}[how]
    return points.select(y.alias("y"), x.alias("x"), value).where(F.col("x").between(0, w - 1) & F.col("y").between(0, h - 1)).groupBy("y", "x").agg(agg(value).alias(value))


def bilinear(source: DataFrame, targets: DataFrame, km: float, key: Sequence[str], value: str = "value") -> DataFrame:
    """Each target's value from the nearest source in each of the four quadrants around it, within km, weighted by the
    inverse of the distance; NULL unless all four have one. An exact hit takes its source."""
    m = within_radius(source, targets, km)
    east = F.col("lon") - F.col("t_lon")
    east = F.when(F.abs(east) <= 180, east).otherwise(F.pmod(east + 180, F.lit(360.0)) - 180)  # across the 180 degree meridian
    quadrant = (F.col("lat") >= F.col("t_lat")).cast("int") * 2 + (east >= 0).cast("int")
    q = m.groupBy(*key, quadrant.alias("q")).agg(F.min(F.struct("km", value)).alias("m"))
    w = 1 / F.greatest(F.col("m.km"), F.lit(1e-9))
    out = q.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), (F.sum(w * F.col(f"m.{value}")) / F.sum(w)).alias("v"), F.min(F.col("m.km")).alias("least"), F.min_by(f"m.{value}", "m.km").alias("hit"))
    return out.select(*key, F.when(F.col("least") < 1e-6, F.col("hit")).when(F.col("n") == 4, F.col("v")).alias(value))


def extent_tile(v: Column, n: int, size: int) -> Column:
    """Index of the tile, of n over the size, that a line or sample is in."""
    return F.floor(v * n / F.lit(size)).cast("int")


def axis_subset(spark: SparkSession, lats: DataFrame, lons: DataFrame, box: Sequence[float]) -> DataFrame:
    """Grid places (y, x) of the axis values inside a box: the product of two short axis tables."""
    west, south, east, north = box
    return lats.where(F.col("lat").between(south, north)).crossJoin(storage.counted(lons.where(F.col("lon").between(west, east)), "axis"))


def reproject_nearest(df: DataFrame, source_gt: Sequence[float], target_gt: Sequence[float], height: int, width: int, source_crs: str, target_crs: str) -> DataFrame:
    """Categorical resampling onto another grid of the same CRS: each target pixel takes the source pixel at its centre.

    Grids that are equal are left alone. Other CRSs would need a projection library and are refused.
    """
    if source_crs != target_crs:
        raise ValueError(f"no reprojection from {source_crs} to {target_crs}")
    if tuple(source_gt) == tuple(target_gt):
        return df.where((F.col("y") < height) & (F.col("x") < width))
    meta = df.select("scene").distinct().withColumns({"height": F.lit(height), "width": F.lit(width)})
    grid = dense(meta)
    mx, my = affine(F.col("x"), F.col("y"), target_gt)
    sx, sy = affine_inverse(mx, my, source_gt)
    t = grid.select("scene", F.col("y").alias("ty"), F.col("x").alias("tx"), sy.alias("y"), sx.alias("x"))
    return t.join(df, ["scene", "y", "x"]).drop("y", "x").withColumnsRenamed({"ty": "y", "tx": "x"})


def fuse(high: DataFrame, low: DataFrame, on: Sequence[str], n_high: int, n_low: int) -> DataFrame:
    """Bands of two sensors side by side, those of the finer first; NULLs where one has no pixel."""
    empty = lambda n: F.array_repeat(F.lit(None).cast("float"), n)
    j = high.select(*on, F.col("bands").alias("_h")).join(low.select(*on, F.col("bands").alias("_l")), list(on), "full_outer")
    return j.select(*on, F.concat(F.coalesce("_h", empty(n_high)), F.coalesce("_l", empty(n_low))).alias("bands"))


def inside_polygons(polygons: DataFrame, grid: DataFrame, cell: float) -> DataFrame:
    """Rows of the grid (lon, lat) beside the polygons (ring: array of (x, y), of any length) that hold them.

    Polygons are copied to the coarse cells that their boxes touch, the grid joins by coarse cell, and ray casting over the
    ring decides, all as Column expressions.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    p = polygons.withColumns({"_w": F.array_min(xs), "_e": F.array_max(xs), "_s": F.array_min(ys), "_n": F.array_max(ys)})
    p = p.withColumn("_c", F.explode(F.sequence(F.floor(F.col("_w") / cell).cast("int"), F.floor(F.col("_e") / cell).cast("int"))))
    p = p.withColumn("_r", F.explode(F.sequence(F.floor(F.col("_s") / cell).cast("int"), F.floor(F.col("_n") / cell).cast("int"))))
    g = grid.withColumns({"_c": F.floor(F.col("lon") / cell).cast("int"), "_r": F.floor(F.col("lat") / cell).cast("int")})
    j = g.join(p, ["_c", "_r"]).where(F.col("lon").between(F.col("_w"), F.col("_e")) & F.col("lat").between(F.col("_s"), F.col("_n")))
    # Crossings of the edges (ring[i], ring[i + 1]) with the ray to the east.
    edges = F.zip_with("ring", F.concat(F.slice("ring", F.lit(2), F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1)), lambda a, b: F.when(
        (a["y"] > F.col("lat")) != (b["y"] > F.col("lat")), (F.col("lon") < (b["x"] - a["x"]) * (F.col("lat") - a["y"]) / (b["y"] - a["y"]) + a["x"]).cast("int")).otherwise(0))
    inside = F.pmod(F.aggregate(edges, F.lit(0), lambda s, e: s + e), F.lit(2)) == 1
    return j.where(inside).drop("_c", "_r", "_w", "_e", "_s", "_n")


def burn_polygons(polygons: DataFrame, grid: DataFrame, cell: float, value: str = "value") -> DataFrame:
    """(y, x, value) of grid cells (y, x, lon, lat) whose centre is inside a polygon; the largest value wins."""
    return inside_polygons(polygons, grid, cell).groupBy("y", "x").agg(F.max(value).alias(value))


def polygon_stats(polygons: DataFrame, grid: DataFrame, cell: float, key: str, value: str = "value") -> DataFrame:
    """Least, greatest and mean value and number of the grid rows inside each polygon; polygons without any keep a row."""
    found = inside_polygons(polygons.select(key, "ring"), grid.select("lon", "lat", value), cell)
    stats = found.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.count(value).alias("n"))
    return polygons.select(key).join(stats, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def clipped_rings(polygons: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Polygons cut to a box, edge by edge; those that nothing is left of go. Rings that lie inside stay as they are."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    near = polygons.where((F.array_max(xs) >= west) & (F.array_min(xs) <= east) & (F.array_max(ys) >= south) & (F.array_min(ys) <= north))
    ring = F.col("ring")
    for axis, other, bound, sign in (("x", "y", west, 1), ("x", "y", east, -1), ("y", "x", south, 1), ("y", "x", north, -1)):
        ring = _half_plane(ring, axis, other, bound, sign)
    return near.withColumn("ring", ring).where(F.size("ring") >= 3)


def _half_plane(ring, axis: str, other: str, bound: float, sign: int):
    """Of a ring, what lies on one side of a line: each edge gives its crossing, if it has one, and its end, if that stays."""
    after = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))

    def edge(a, b):
        here, there = sign * (a[axis] - bound), sign * (b[axis] - bound)
        t = here / F.when(here == there, 1.0).otherwise(here - there)
        at = a[other] + t * (b[other] - a[other])
        parts = {axis: F.lit(float(bound)), other: at}
        cross = F.struct(parts["x"].alias("x"), parts["y"].alias("y"))
        end = F.struct(b["x"].alias("x"), b["y"].alias("y"))
        return F.filter(F.array(F.when((here < 0) != (there < 0), cross), F.when(there >= 0, end)), lambda p: p.isNotNull())

    return F.flatten(F.zip_with(ring, after, edge))


def healpix(lon, lat, nside: int):
    """Ring-ordered HEALPix cell of a place in degrees, as a Column expression."""
    z = F.sin(F.radians(lat))
    t = F.pmod(lon, F.lit(360.0)) / 90.0
    flat = z * (nside * 0.75)
    jp, jm = F.floor(nside * (t + 0.5) - flat), F.floor(nside * (t + 0.5) + flat)
    ring = nside + 1 + jp - jm
    place = F.pmod(F.floor((jp + jm - nside + 2 - F.pmod(ring, F.lit(2))) / 2), F.lit(4 * nside))
    belt = 2 * nside * (nside - 1) + (ring - 1) * (4 * nside) + place
    part, near = t - F.floor(t), nside * F.sqrt(3 * (1 - F.abs(z)))
    ring = F.floor(part * near) + F.floor((1 - part) * near) + 1
    place = F.pmod(F.floor(t * ring), 4 * ring)
    cap = F.when(z > 0, 2 * ring * (ring - 1) + place).otherwise(12 * nside * nside - 2 * ring * (ring + 1) + place)
    return F.when(F.abs(z) <= 2 / 3, belt).otherwise(cap).cast("bigint")


def healpix_last(df: DataFrame, nside: int, value: str, *order: str) -> DataFrame:
    """(cell, value): the last value of each HEALPix cell in that order, from rows with lon and lat."""
    return df.groupBy(healpix(F.col("lon"), F.col("lat"), nside).alias("cell")).agg(F.max_by(value, F.struct(*order)).alias(value))
