"""Connected components of a link table, by alternating large-star and small-star steps.

Links stay in DataFrames; every step's minima are pre-aggregated before the shuffle, and its joins are plain equi-joins,
which Spark splits where a node has very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _both(e: DataFrame) -> DataFrame:
    return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(e: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the smallest node it knows."""
    both = _both(e)
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b")


def _small(e: DataFrame) -> DataFrame:
    """Each node sends its smaller neighbours and itself to the smallest of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    sent = down.join(low, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b")
    return sent.unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b")))


def components(links: DataFrame, steps: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of links (a, b). Ids without links don't appear.

    steps: stop after so many. Nodes with one component are then connected, but not all that are connected have one.
    """
    e = common.written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    state, done = None, 0
    while done != steps:
        new = common.written(_small(_large(e)).where("a <> b").distinct(), "links")
        common.dropped(e)
        e, done = new, done + 1
        # Done when every larger node hangs on one node and no such node hangs on another: the edges repeat.
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() if done != steps else state
        if now == state:
            break
        state = now
    # A node that hangs on several takes the least of them; one that hangs on none is its own.
    up = e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    top = e.select(F.col("a").alias("node")).distinct().join(e.select("b"), F.col("node") == F.col("b"), "left_anti")
    out = common.written(up.unionByName(top.select("node", F.col("node").alias("component"))), "components")
    common.dropped(e)
    return out
