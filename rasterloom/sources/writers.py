"""Sinks: partitioned Parquet tables, CSV and JSON reports, scene metadata."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geotiff


def raster(df: DataFrame, path: str, by: Sequence[str] = ("scene",), mode: str = "error") -> None:
    """Pixels in files by scene, sorted by place within them, so that readers skip by line."""
    df.repartition(*by).sortWithinPartitions(*by, "y", "x").write.mode(mode).partitionBy(*by).parquet(path)


def bands(df: DataFrame, path: str, mode: str = "error") -> None:
    """One folder for each band of an array column."""
    rest = [c for c in df.columns if c != "bands"]
    df.select(*rest, F.posexplode("bands").alias("band", "value")).write.mode(mode).partitionBy("band").parquet(path)


def stack(df: DataFrame, meta: DataFrame, columns: Sequence[str], path: str, fill: float = -9999.0, mode: str = "error") -> None:
    """Dense rasters of several value columns, one folder each, absent pixels filled."""
    from ..operators.grid import reconstruct

    dense = reconstruct(df, meta, {c: fill for c in columns})
    dense.unpivot(["scene", "y", "x"], list(columns), "name", "value").write.mode(mode).partitionBy("name").parquet(path)


def geotiffs(df: DataFrame, meta: DataFrame, columns: Sequence[str], kind: str = "float32", fill: float = -999999.0) -> DataFrame:
    """(scene, content): a GeoTIFF file a scene, with the columns as bands. meta: scene, height, width and, if known, transform
    (x0, dx, rx, y0, ry, dy) and epsg. Absent pixels and NULLs become the fill, which is the file's nodata. A scene is one
    task's work, as it is one file."""
    names = list(columns)

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        m = f.iloc[0]
        a = np.full((int(m.height), int(m.width), len(names)), fill, kind)
        here = f[f.y.notna()]
        own = here[names].to_numpy(float)
        a[here.y.astype(int), here.x.astype(int)] = np.where(np.isnan(own), fill, own).astype(kind)
        transform = None if m["transform"] is None else tuple(m["transform"])
        return pd.DataFrame({"scene": [key[0]], "content": [geotiff.encode(geotiff.Raster(a, transform, None if pd.isna(m.epsg) else int(m.epsg), fill))]})

    more = [F.col("transform") if "transform" in meta.columns else F.lit(None).cast("array<double>").alias("transform"), (F.col("epsg") if "epsg" in meta.columns else F.lit(None)).cast("int").alias("epsg")]
    j = meta.select("scene", "height", "width", *more).join(df.select("scene", "y", "x", *(F.col(c).cast("double").alias(c) for c in names)), "scene", "left")
    return j.groupBy("scene").applyInPandas(run, f"scene {dict(df.dtypes)['scene']}, content binary")


def files(df: DataFrame, path: str, name: Column) -> None:
    """Writes content of each row as a file of that name below a folder that all executors reach (a mount, or a store that Arrow
    knows): first under a passing name, so a task that runs again leaves whole files."""
    def run(batches):
        from pyarrow import fs

        for f in batches:
            store, top = fs.FileSystem.from_uri(path)
            store.create_dir(top, recursive=True)
            for n, content in zip(f.name, f.content):
                part = f"{top}/.{n}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, f"{top}/{n}")
            yield pd.DataFrame({"n": [len(f)]})

    df.select(name.alias("name"), "content").mapInPandas(run, "n int").agg(F.sum("n")).collect()


def batch_jobs(rasters: DataFrame, shapes: DataFrame, parameters: dict[str, str]) -> DataFrame:
    """(job): a JSON line for each raster and shape file, for a batch tool. Every pair is a job by definition."""
    inputs = F.struct(F.col("raster").alias("INPUT_RASTER"), F.col("shape").alias("INPUT_VECTOR"), *(F.lit(v).alias(k) for k, v in parameters.items()))
    outputs = F.struct(F.concat_ws("_", F.regexp_replace("raster", r"\.[^.]*$", ""), F.regexp_replace("shape", r"^.*/|\.[^.]*$", "")).alias("OUTPUT"))
    return rasters.select("raster").crossJoin(shapes.select("shape")).select(F.to_json(F.struct(inputs.alias("PARAMETERS"), outputs.alias("OUTPUTS"))).alias("job"))


def report(df: DataFrame, path: str, kind: str = "csv", mode: str = "error") -> None:
    """A small table as one CSV file with a header, or as JSON lines. An empty table gives a file with the header alone."""
    w = df.coalesce(1).write.mode(mode)
    w.csv(path, header=True) if kind == "csv" else w.json(path)


def renamed(day_number: Column, start: str, label: Column) -> Column:
    """Output name from a day offset and a class name."""
    return F.concat_ws("_", F.date_format(F.date_add(F.lit(start).cast("date"), day_number), "yyyyMMdd"), label)
