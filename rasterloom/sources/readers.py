"""Sources: a registry of named readers, each giving a DataFrame. Configurations name readers; they never name code."""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import first_pattern, name_time
from . import geotiff

Reader = Callable[..., DataFrame]
_READERS: dict[str, Reader] = {}


def register(name: str) -> Callable[[Reader], Reader]:
    def put(f: Reader) -> Reader:
        if name in _READERS:
            raise ValueError(f"a reader named {name} is there already")
        _READERS[name] = f
        return f

    return put


def reader(name: str) -> Reader:
    if name not in _READERS:
        raise KeyError(f"no reader named {name}; there are {sorted(_READERS)}")
    return _READERS[name]


@register("parquet")
def parquet(spark: SparkSession, path: str | Sequence[str], **options) -> DataFrame:
    return spark.read.options(**options).parquet(*([path] if isinstance(path, str) else path))


@register("csv")
def csv(spark: SparkSession, path: str | Sequence[str], schema: str | None = None, **options) -> DataFrame:
    r = spark.read.options(header=True, **options)
    return (r.schema(schema) if schema else r).csv([path] if isinstance(path, str) else list(path))


@register("json")
def json(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    r = spark.read.options(**options)
    return (r.schema(schema) if schema else r).json(path)


def _pixels(batches: Iterator[pd.DataFrame], load=lambda content: np.load(io.BytesIO(content), allow_pickle=False)) -> Iterator[pd.DataFrame]:
    for f in batches:
        for path, content in zip(f.path, f.content):
            a = load(content)
            a = a[:, :, None] if a.ndim == 2 else a
            h, w, c = a.shape
            for y0 in range(0, h, max(1, 200_000 // max(w, 1))):  # some lines at a time
                own = a[y0 : y0 + max(1, 200_000 // max(w, 1))]
                yy, xx = np.mgrid[y0 : y0 + own.shape[0], 0:w]
                yield pd.DataFrame({"path": path, "y": yy.ravel().astype("int32"), "x": xx.ravel().astype("int32"), "bands": list(own.reshape(-1, c).astype("float32"))})


@register("numpy")
def npy(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, y, x, bands) of .npy scenes, H x W or H x W x C, read where the files are by Spark's own reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(path)
    return files.select("path", "content").mapInPandas(_pixels, "path string, y int, x int, bands array<float>")


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content")


@register("geotiff")
def tiff(spark: SparkSession, path: str, pattern: str = "*.tif*", **options) -> DataFrame:
    """(path, y, x, bands) of GeoTIFF files. A damaged file raises; see geotiff for what is read."""
    def run(batches):
        yield from _pixels(batches, lambda content: geotiff.decode(content).pixels)

    return _files(spark, path, pattern).mapInPandas(run, "path string, y int, x int, bands array<float>")


@register("geotiff_profile")
def tiff_profile(spark: SparkSession, path: str, pattern: str = "*.tif*", **options) -> DataFrame:
    """One row a GeoTIFF file: its size, type, transform, EPSG code, nodata, metadata and ground control points."""
    def run(batches):
        for f in batches:
            rows = [(p, geotiff.decode(c)) for p, c in zip(f.path, f.content)]
            yield pd.DataFrame([{"path": p, "height": r.pixels.shape[0], "width": r.pixels.shape[1], "n_bands": r.pixels.shape[2], "dtype": r.pixels.dtype.name, "transform": None if r.transform is None else [float(v) for v in r.transform], "epsg": r.epsg, "nodata": r.nodata, "metadata": r.metadata, "gcps": [dict(zip(("line", "sample", "x", "y"), map(float, g))) for g in r.gcps]} for p, r in rows], columns=names).astype({"epsg": "Int32"})

    names = ["path", "height", "width", "n_bands", "dtype", "transform", "epsg", "nodata", "metadata", "gcps"]
    return _files(spark, path, pattern).mapInPandas(run, "path string, height int, width int, n_bands int, dtype string, transform array<double>, epsg int, nodata double, metadata string, gcps array<struct<line: double, sample: double, x: double, y: double>>")


@register("preprocessed")
def preprocessed(spark: SparkSession, path: str, **options) -> DataFrame:
    """Samples and their indices from <name>.npy (N x F) and <name>.indices.npy (N x 3: scene, y, x)."""
    def rows(f: pd.DataFrame) -> pd.DataFrame:
        by = {bool(re.search(r"\.indices\.npy$", p)): np.load(io.BytesIO(c), allow_pickle=False) for p, c in zip(f.path, f.content)}
        if set(by) != {True, False}:
            raise ValueError(f"{f.path.iloc[0]} has no partner")
        i, x = by[True], by[False]
        return pd.DataFrame({"scene": i[:, 0].astype("int64"), "y": i[:, 1].astype("int32"), "x": i[:, 2].astype("int32"), "features": list(x.astype("float32"))})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.groupBy(F.regexp_replace("path", r"(\.indices)?\.npy$", "").alias("stem")).applyInPandas(rows, "scene bigint, y int, x int, features array<float>")


def listing(spark: SparkSession, path: str, suffix: str = "*") -> DataFrame:
    """(path, size, modified) of all files below a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def catalog(names: DataFrame, products: dict[str, Sequence[str]], start: str | None = None, end: str | None = None, policy: str = "midday", name: str = "path") -> DataFrame:
    """Adds product, ts and day from file names; rows without a product or time go, as do those outside [start, end]."""
    d = names.withColumns({"product": first_pattern(F.col(name), products), "ts": name_time(F.element_at(F.split(F.col(name), "/"), -1), policy)})
    d = d.where("product is not null and ts is not null").withColumn("day", F.to_date("ts"))
    if start:
        d = d.where(F.col("day") >= F.lit(start).cast("date"))
    return d.where(F.col("day") <= F.lit(end).cast("date")) if end else d


def union_files(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of several tables, by column name; columns that one lacks are NULL there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def scenes_with_geo(scene: DataFrame, geo: DataFrame, fill: str = "mean", constant: float = 0.0, value: str = "value") -> DataFrame:
    """Scene pixels with their lat and lon; missing values become a constant or their scene's mean."""
    j = scene.join(geo, ["scene", "y", "x"], "left")
    if fill == "constant":
        return j.withColumn(value, F.coalesce(value, F.lit(constant)))
    mean = scene.groupBy("scene").agg(F.avg(value).alias("_mean"))
    return j.join(mean, "scene").withColumn(value, F.coalesce(value, "_mean")).drop("_mean")
