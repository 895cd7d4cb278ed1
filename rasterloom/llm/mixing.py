"""Operator 9: mixing sources to target weights, by hash-threshold histograms.

Sizes are summed by source and hash bucket; the bucket in which a source's budget runs out is refined by the next
bits of the hash, level by level, and the documents below the threshold are found with a filter. Nothing is sorted.
A larger budget takes a superset of what a smaller one takes, since all budgets cut the same hash.

Everything is DataFrame code: per-document rows are only filtered, joined to one row a source, and pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Hash bits that one histogram level resolves, and the number of levels: 3 levels of 10 bits leave a boundary of 2**-30.
LEVEL_BITS = 10
LEVELS = 3
#: Sources whose summary may be broadcast to the documents.
SOURCE_ROWS = 100_000


def words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD_CLASS)), F.lit(0)).cast("bigint")


def hash30(doc_id: Column) -> Column:
    """30 bits of the MD5 of the document's id, the same in any SQL engine. A null id hashes as the empty string."""
    return F.shiftright(F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint"), 2)


def targets(sources: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources: (source, source_size), one row each. Adds target: the share of all sizes dealt by weight, at most
    ``most`` times a source's size, the excess dealt again by weight until no source is above. Weights repeat in the
    order of the sources by code point, null last.

    The level L solves sum(min(most * size, weight * L)) = share * sum(size): with sources in order of
    most * size / weight, a source is at its cap exactly if the level that remains for it and those after it is above
    that; from the first that isn't on, the levels only fall, so the largest of them is L.
    """
    # One row a source comes here, pre-aggregated: the only unpartitioned windows, over the sources and never the documents.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(by_name) - 1) % len(weights)
    s = sources.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (k + 1).cast("int")))
    s = s.withColumn("cap", most * F.col("source_size")).withColumn("r", F.col("cap") / F.col("w"))
    up = Window.orderBy("r", F.col("source").asc_nulls_last())
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    s = s.withColumn("level", level).withColumn("capped", F.col("level") > F.col("r"))
    base = F.max(F.when(~F.col("capped"), F.col("level"))).over(Window.partitionBy())
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * base)).alias("target"))


def small(df: DataFrame, rows: int) -> DataFrame:
    """One row a source: broadcast up to SOURCE_ROWS, else joined by shuffle."""
    return F.broadcast(df) if rows <= SOURCE_ROWS else df


def thresholds(sized: DataFrame, budgets: DataFrame, rows: int) -> DataFrame:
    """The hash threshold of each (source, budget): documents with h below it hold about that many words.

    Each level sums sizes by bucket inside the boundary bucket of the level before: partial sums run before the
    shuffle, and no more than 2**LEVEL_BITS rows a budget come out of it.
    """
    span = 1 << LEVEL_BITS
    state = budgets.select("source", "budget", F.lit(0).cast("bigint").alias("prefix"), F.col("budget").alias("rest"))
    for level in range(LEVELS):
        low = LEVEL_BITS * (LEVELS - 1 - level)
        d = sized.select(F.col("source").alias("s"), F.shiftright("h", low + LEVEL_BITS).alias("p"), F.shiftright("h", low).alias("bucket"), "size")
        on = F.col("s").eqNullSafe(F.col("source")) & (F.col("p") == F.col("prefix"))
        hist = d.join(small(state, rows), on).groupBy("source", "budget", "prefix", "rest", "bucket").agg(F.sum("size").alias("n"))
        w = Window.partitionBy("source", "budget").orderBy("bucket")
        runs = hist.withColumn("upto", F.sum("n").over(w)).withColumn("under", F.col("upto") - F.col("n"))
        # The boundary bucket: the last that starts within the budget.
        edge = runs.where(F.col("under") <= F.col("rest")).groupBy("source", "budget").agg(
            F.max(F.struct("bucket", F.col("under"), F.col("upto"), "rest")).alias("e"))
        state = edge.select("source", "budget", F.col("e.bucket").alias("prefix"), (F.col("e.rest") - F.col("e.under")).alias("rest"),
                            F.col("e.upto").alias("upto"), F.col("e.under").alias("under"), F.col("e.rest").alias("was"))
        if level < LEVELS - 1:
            state = common.written(state.select("source", "budget", "prefix", "rest"), "mix")
    # The last bucket goes in if that brings the sum nearer to the budget.
    take = (F.col("upto") - F.col("was")) <= (F.col("was") - F.col("under"))
    return common.written(state.select("source", "budget", (F.col("prefix") + F.when(take, 1).otherwise(0)).alias("cut")), "mix")


def plan(sized: DataFrame, weights, share: float, most: int) -> tuple[DataFrame, int]:
    """of, source_size, target, whole, cut of each source of sized (source, size, h), and how many there are: each document is
    taken ``whole`` times, and once more if its hash is below ``cut``."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = common.written(targets(sums, weights, share, float(most)), "mix")
    n = goal.count()
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    goal = goal.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    cut = thresholds(sized, goal.where("budget > 0").select("source", "budget"), n)
    out = goal.alias("g").join(small(cut, n).alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")), "left").select(
        F.col("g.source").alias("of"), "source_size", "target", "whole", F.coalesce("cut", F.lit(0)).alias("cut"))
    return common.written(out, "mix-plan"), n


def copies(h: Column, most: int) -> Column:
    """How often the joined plan takes a document of that hash."""
    return F.least(F.lit(most).cast("bigint"), F.col("whole") + F.when(h < F.col("cut"), 1).otherwise(0))


def _sized(docs: DataFrame) -> DataFrame:
    d = common.take(docs, "source")
    return common.written(d.select("doc_id", "source", words(F.col("text")).alias("size"), hash30(F.col("doc_id")).alias("h")), "mix")


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken = copies * size for each row of docs.

    A source whose target is q whole sizes and a rest gives every document q times and those under its hash threshold
    once more. Null text: size 0. An empty table gives no row; a source of size 0 has target 0 and takes nothing.
    Rows that repeat a doc_id hash alike and are taken alike. Null sources are one source, the last.
    """
    sized = _sized(docs)
    goal, n = plan(sized, weights, share, most)
    out = sized.join(small(goal, n), F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", copies(F.col("h"), most))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """The rows of docs, all columns as they are, each as often as mix() takes it. Decided on each row itself, so rows without
    an id are mixed like any other."""
    goal, n = plan(_sized(docs), weights, share, most)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    d = docs.select(row, common.column(docs, "source", "string").alias("source"), hash30(common.column(docs, "doc_id", "bigint")).alias("h"))
    out = d.join(small(goal, n), F.col("source").eqNullSafe(F.col("of"))).select("row", F.explode(F.array_repeat(F.lit(True), copies(F.col("h"), most).cast("int"))))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
