"""Zonal histograms, contingency tables and the assignment of clusters to classes.

A histogram is one hash aggregate; everything after works on its few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zonal_histogram(df: DataFrame, zone: str, value: str, digits: int = 3, min_count: int = 0) -> DataFrame:
    """(zone, value, cnt): counts of values rounded half to even by zone; pixels outside any zone (NULL) count under -1.

    All zones come from one pass. Cells with fewer than min_count pixels go.
    """
    z = F.coalesce(F.col(zone), F.lit(-1)) if df.schema[zone].dataType.simpleString() != "string" else F.coalesce(F.col(zone), F.lit("-1"))
    out = df.select(z.alias("zone"), F.bround(value, digits).alias("value")).groupBy("zone", "value").agg(F.count(F.lit(1)).alias("cnt"))
    return out.where(F.col("cnt") >= min_count) if min_count else out


def contingency(df: DataFrame, cluster: str, klass: str) -> DataFrame:
    """(cluster, class, cnt) with cluster totals (class NULL), class totals (cluster NULL) and the grand total."""
    d = df.select(F.col(cluster).alias("cluster"), F.col(klass).alias("class"))
    return d.groupingSets([[F.col("cluster"), F.col("class")], [F.col("cluster")], [F.col("class")], []], F.col("cluster"), F.col("class")).agg(
        F.count(F.lit(1)).alias("cnt"), F.grouping_id().cast("int").alias("level"))


def shares(counts: DataFrame) -> DataFrame:
    """Adds each cell's share of its cluster and of its class; 0 where the total is 0."""
    by = lambda c: F.coalesce(F.try_divide(F.col("cnt"), F.sum("cnt").over(Window.partitionBy(c))), F.lit(0.0))
    return counts.withColumn("cluster_share", by("cluster")).withColumn("class_share", by("class"))


def agreement(counts: DataFrame) -> DataFrame:
    """cluster -> its classes by falling count (ties by class), as parallel arrays."""
    lists = counts.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct((-F.col("cnt")).alias("n"), F.col("class")))).alias("l"))
    return lists.select("cluster", F.transform("l", lambda e: e["class"]).alias("classes"), F.transform("l", lambda e: -e["n"]).alias("counts"))


def majority(counts: DataFrame, t: float) -> DataFrame:
    """(cluster, class, share, status): each cluster's most frequent class (ties: the least), assigned from share t on.

    Clusters below 0 are no clusters. One aggregate, no sort: the largest (count, -class).
    """
    c = counts.where(F.col("cluster") >= 0).groupBy("cluster").agg(F.max(F.struct("cnt", (-F.col("class")).alias("k"))).alias("m"), F.sum("cnt").alias("total"))
    share = F.col("m.cnt") / F.col("total")
    return c.select("cluster", (-F.col("m.k")).alias("class"), share.alias("share"), F.when(share >= t, "assigned").otherwise("uncertain").alias("status"))


def ranked_classes(counts: DataFrame) -> DataFrame:
    w = Window.partitionBy("cluster").orderBy(F.col("cnt").desc(), "class")
    return counts.withColumn("rank", F.row_number().over(w))


def counted_pairs(df: DataFrame, a: str, b: str, valid: Sequence[str] = ()) -> DataFrame:
    """Pairs of labels where neither is missing and each of the flag columns is non-zero."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    for v in valid:
        d = d.where(F.col(v) != 0)
    return d.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("cnt"))


def long_counts(wide: DataFrame, file: str) -> DataFrame:
    """A wide table with one column a cluster to (file, cluster, cnt): only columns whose name is a number are clusters."""
    def number(name: str) -> bool:
        try:
            float(name)
            return True
        except ValueError:
            return False

    names = [c for c in wide.columns if number(c)]
    cast = wide.select(file, *(F.col(f"`{c}`").cast("bigint").alias(c) for c in names))
    return cast.unpivot([file], [F.col(f"`{c}`") for c in names], "name", "cnt").select(file, F.col("name").cast("double").alias("cluster"), "cnt")
