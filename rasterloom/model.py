"""Data model: rasters as long tables.

A raster is a DataFrame ``pixel(scene, y, x, value...)``: one row for each valid pixel, keyed by scene, line and sample.
No-data is NULL inside the engine; sentinels come back only on export. Ids stay integers (a label that an export shows
divided by 1000 is the integer label here).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("scene", "y", "x")

SCHEMAS = {
    "pixel": "scene bigint, y int, x int, value double",
    "bands": "scene bigint, y int, x int, bands array<float>",
    "sample": "scene bigint, y int, x int, features array<float>",
    "tile": "scene bigint, tile_y int, tile_x int, y0 int, x0 int, data array<float>",
    "label_map": "scene bigint, y int, x int, label int, proba double",
    "scene_meta": "scene bigint, gt array<double>, crs string, height int, width int, nodata double, tags map<string,string>",
    "series": "trial bigint, t int, features array<double>",
    "zonal_hist": "zone int, value double, cnt bigint",
    "assignment": "cluster int, class int, status string",
    "catalog": "path string, product string, ts timestamp, day date, source string, start timestamp, end timestamp",
    "scores": "product string, instrument string, day date, level int, tp bigint, fp bigint, fn bigint, f1 double, support bigint",
}

#: No-data sentinels found in inputs and restored on export.
SENTINELS = (-999999.0, -9999.0)


def from_sentinel(value: Column, *fills: float) -> Column:
    """NULL for the given fills, NaN and infinities."""
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    for f in fills or SENTINELS:
        bad = bad | (value == F.lit(f))
    return F.when(~bad, value)


def to_sentinel(value: Column, fill: float) -> Column:
    return F.coalesce(value, F.lit(fill))


def div(a: Column, b) -> Column:
    """Whole-number division towards minus infinity for non-negative a."""
    return F.floor(a / F.lit(b)).cast("int")


def keyed(df: DataFrame, keys: Sequence[str] = KEY) -> Sequence[str]:
    """Those of the keys that df has: operators work on one scene or many."""
    return [k for k in keys if k in df.columns]
