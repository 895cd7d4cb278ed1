"""Merges of streams of rasters, composites over time, and incremental updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_merge(streams: DataFrame, by: Sequence[str], veto: bool = True) -> DataFrame:
    """(by..., value, dqi) from (by..., prio, value): the first valid value by priority, and which stream it is from.

    veto: a -1 in any stream makes the pixel -1 (as the written products have it); else -1 only where none is valid.
    """
    ok = F.col("value") >= 0
    out = streams.groupBy(*by).agg(F.min(F.when(ok, F.struct("prio", "value"))).alias("m"), F.bool_or(F.col("value") == -1).alias("bad"))
    kept = F.col("m").isNotNull() & ~F.col("bad") if veto else F.col("m").isNotNull()
    return out.select(*by, F.when(kept, F.col("m.value")).otherwise(-1).alias("value"), F.when(kept, F.col("m.prio")).otherwise(-1).alias("dqi"))


def composite(daily: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Mean over the valid days, half to even, -1 if there is none; and the number of valid days."""
    v = F.when(F.col(value) >= 0, F.col(value))
    return daily.groupBy(*by).agg(F.coalesce(F.rint(F.avg(v)), F.lit(-1.0)).cast("int").alias("value"), F.count(v).alias("days"))


def slice_combine(df: DataFrame, by: Sequence[str], value: str = "value", positive_count: bool = True) -> DataFrame:
    """max, sum, count and mean over time slices; count of values above 0 or of those that aren't 0; the mean skips 0."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.max(v).alias("v_max"), F.sum(v).alias("v_sum"), F.count_if(v > 0 if positive_count else v != 0).alias("v_count"), F.avg(F.nullif(v, F.lit(0))).alias("v_mean"))


def any_presence(df: DataFrame, by: Sequence[str], flag: str) -> DataFrame:
    """1 where the flag shows in any scene."""
    return df.groupBy(*by).agg(F.max(F.when(F.col(flag), 1).otherwise(0)).alias("present"))


def incremental(old: DataFrame, new: DataFrame, by: Sequence[str]) -> DataFrame:
    """A product (by..., prio, value) filled further: for each pixel the valid value of the best priority so far."""
    both = old.unionByName(new).where(F.col("value") >= 0)
    return both.groupBy(*by).agg(F.min(F.struct("prio", "value")).alias("m")).select(*by, "m.prio", "m.value")
