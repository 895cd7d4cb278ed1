"""Reports over fact tables: distribution grids, box statistics, frequency tables, file lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ecdf(df: DataFrame, value: str, points: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Share of values up to each point of a fixed grid: one aggregate, a row a point."""
    cells = F.array(*(F.struct(F.lit(float(p)).alias("at"), F.avg((F.col(value) <= p).cast("double")).alias("share")) for p in points))
    return df.groupBy(*by).agg(cells.alias("c")).select(*by, F.explode("c").alias("c")).select(*by, "c.at", "c.share")


def box_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Exact quartiles, extremes and mean of each group."""
    q = F.percentile(value, F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    g = df.groupBy(*by).agg(q.alias("q"), F.avg(value).alias("mean"), F.count(value).alias("n"))
    return g.select(*by, *(F.col("q")[i].alias(c) for i, c in enumerate(("low", "q1", "median", "q3", "high"))), "mean", "n")


def frequencies(df: DataFrame, value: str, top: int | None = None) -> DataFrame:
    """Values by falling frequency, ties by value."""
    out = df.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), value)
    return out.limit(top) if top else out


def clipped_names(files: DataFrame, name: str, pattern: str) -> DataFrame:
    """Distinct names after removing a pattern."""
    return files.select(F.regexp_replace(name, pattern, "").alias(name)).distinct()


def common_names(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    return a.select(name).intersect(b.select(name))


def bootstrap_p(stats: DataFrame, null: DataFrame, node: str, value: str) -> DataFrame:
    """Share of a node's null draws above its statistic."""
    return stats.join(null.select(node, F.col(value).alias("_null")), node).groupBy(node).agg(F.avg((F.col(value) < F.col("_null")).cast("double")).alias("p"))


def by_day(a: DataFrame, b: DataFrame, day: str) -> DataFrame:
    """Files of two instruments of the same day."""
    return a.join(b, day)
