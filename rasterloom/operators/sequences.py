"""Fixed-length sequences of time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def causal(df: DataFrame, length: int, feature: str = "value", trial: str = "trial", t: str = "t") -> DataFrame:
    """(trial, t, seq): the last ``length`` features up to each step, never across trials; none with a NULL in it."""
    w = Window.partitionBy(trial).orderBy(t).rowsBetween(-(length - 1), 0)
    d = df.withColumns({"seq": F.collect_list(F.struct(F.col(feature).alias("v"))).over(w)})
    d = d.where(F.size("seq") == length).withColumn("seq", F.transform("seq", lambda e: e["v"]))
    return d.where(~F.exists("seq", lambda v: v.isNull())).select(trial, t, "seq")


def subset(df: DataFrame, every: int, t: str = "t") -> DataFrame:
    """Every n-th sequence of a trial, from the first."""
    return df.where(F.col(t) % every == 0)
