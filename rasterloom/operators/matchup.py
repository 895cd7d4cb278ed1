"""Matchups: nearest in time, points to intervals, audits, name-based joins.

Time searches are equi-joins on buckets as wide as the tolerance: one side is copied to the neighbouring buckets, the exact
predicate follows, and the best match is a minimum, not a sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import micros, midpoint_distance, seconds_between, seconds_to_interval


def _bucket(ts, seconds: float):
    return F.floor(micros(ts) / F.lit(int(seconds * 1_000_000)))


def candidates(targets: DataFrame, others: DataFrame, by: Sequence[str], seconds: float) -> DataFrame:
    """Pairs with equal ``by`` columns and times (ts, o_ts) up to ``seconds`` apart; adds dt, signed."""
    t = targets.withColumn("_b", _bucket(F.col("ts"), seconds))
    near = F.explode(F.array(*(_bucket(F.col("o_ts"), seconds) + d for d in (-1, 0, 1))))
    o = others.withColumn("_b", near)
    return t.join(o, [*by, "_b"]).drop("_b").withColumn("dt", seconds_between(F.col("ts"), F.col("o_ts"))).where(F.abs("dt") <= seconds)


def asof_nearest(targets: DataFrame, others: DataFrame, by: Sequence[str], seconds: float, key: Sequence[str], path: str, slices: int = 16) -> DataFrame:
    """Each target (``key``) with its nearest other in either direction; ties: the smaller path. Others may be reused.

    Linear in both sides: no pairs are made. Rows meet in slices of time, ``slices`` of them a tolerance, so that a hot key spreads; inside one the last
    other before and the first after a target are windows, and beyond it they are the ends of the nearest slices that hold others.
    """
    wide = seconds / slices
    o = others.where(F.col("o_ts").isNotNull()).select(*by, F.col("o_ts").alias("_t"), F.col(path).alias("_p"))
    o = o.withColumn("_b", _bucket(F.col("_t"), wide))
    t = targets.where(F.col("ts").isNotNull()).select(*by, *(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col("ts").alias("_t"))
    t = t.withColumn("_b", _bucket(F.col("_t"), wide))
    for c in by:
        o, t = o.where(F.col(c).isNotNull()), t.where(F.col(c).isNotNull())
    # Ends of each slice with others or targets, a row a slice: the last other before it, the first after it.
    ends = o.groupBy(*by, "_b", "_t").agg(F.min("_p").alias("_p")).groupBy(*by, "_b").agg(F.min(F.struct("_t", "_p")).alias("first"), F.max_by(F.struct("_t", "_p"), "_t").alias("last"))
    slots = t.select(*by, "_b").distinct().join(ends, [*by, "_b"], "full_outer")
    w = Window.partitionBy(*by).orderBy("_b")
    before = F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_far_before")
    after = F.first("first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_far_after")
    slots = slots.select(*by, "_b", before, after)
    # Targets after others of the same time going up, and again going down; of equal times the smaller path comes next to the target.
    u = t.withColumn("_o", F.lit(0)).unionByName(o.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    other = F.when(F.col("_o") == 1, F.struct("_t", "_p"))
    up = Window.partitionBy(*by, "_b").orderBy("_t", F.col("_o").desc(), F.col("_p").desc())
    down = Window.partitionBy(*by, "_b").orderBy(F.col("_t").desc(), F.col("_o").desc(), F.col("_p").desc())
    near = u.withColumn("_before", F.last(other, ignorenulls=True).over(up)).withColumn("_after", F.last(other, ignorenulls=True).over(down))
    near = near.where(F.col("_o") == 0).drop("_o", "_p").join(slots, [*by, "_b"], "left")
    near = near.withColumn("_c", F.explode(F.array(F.coalesce("_before", "_far_before"), F.coalesce("_after", "_far_after"))))
    near = near.withColumn("dt", seconds_between(F.col("_t"), F.col("_c._t"))).where(F.abs("dt") <= seconds)
    m = F.min(F.struct(F.abs("dt").alias("adt"), F.col("_c._p").alias("_p"), F.col("dt"))).alias("m")
    names = [F.col(f"_k{i}").alias(k) for i, k in enumerate(key)]
    return near.groupBy(*names).agg(m).select(*key, F.col("m._p").alias(path), "m.dt")


def asof_families(targets: DataFrame, families: Sequence[tuple[DataFrame, int, float]], by: Sequence[str], key: Sequence[str], path: str) -> DataFrame:
    """The best of several families of others, each with its priority and tolerance: least |dt|, then priority, then path.
    The best of a family is its nearest, so one row a target and family remains to be compared."""
    parts = [asof_nearest(targets, o, by, s, key, path).withColumn("priority", F.lit(p)) for o, p, s in families]
    c = reduce(DataFrame.unionByName, parts)
    return c.groupBy(*key).agg(F.min(F.struct(F.abs("dt").alias("adt"), F.col("priority"), F.col(path), F.col("dt"))).alias("m")).select(*key, "m.priority", f"m.{path}", "m.dt")


def exclusive(cands: DataFrame, product: str, target: str, path: str) -> DataFrame:
    """One-to-one matches: targets in order of (ts, target) each take the nearest path that none before took.

    The order of taking is the semantics, so a product's candidates meet in one task; candidates are within a tolerance of
    their targets, so days far apart could be separate products (split by gaps larger than the tolerance).
    """
    def greedy(f: pd.DataFrame) -> pd.DataFrame:
        f = f.assign(adt=f.dt.abs()).sort_values(["ts", target, "adt", path])
        used, out = set(), []
        for t, own in f.groupby(["ts", target], sort=True):
            free = own[~own[path].isin(used)]
            if len(free):
                used.add(free[path].iloc[0])
                out.append((own[product].iloc[0], t[1], free[path].iloc[0], free.dt.iloc[0]))
        return pd.DataFrame(out, columns=[product, target, path, "dt"])

    kinds = {n: cands.schema[n].dataType.simpleString() for n in (product, target, path)}
    d = cands.select(product, target, path, "ts", "dt")
    return d.groupBy(product).applyInPandas(greedy, f"{product} {kinds[product]}, {target} {kinds[target]}, {path} {kinds[path]}, dt double")


def gap_islands(cands: DataFrame, product: str, seconds: float) -> DataFrame:
    """Adds island: runs of target times of a product without a gap above twice the tolerance. No path can serve two islands."""
    w = Window.partitionBy(product).orderBy("ts")
    gap = seconds_between(F.lag("ts").over(w), F.col("ts")) > 2 * seconds
    return cands.withColumn("island", F.sum(F.coalesce(gap.cast("int"), F.lit(0))).over(w.rangeBetween(Window.unboundedPreceding, 0)))


def interval_match(points: DataFrame, intervals: DataFrame, key: Sequence[str], by: Sequence[str], path: str, most: float, span: float = 86400.0) -> DataFrame:
    """Each point (ts) with an interval (start, end): one that contains it, by (distance to the midpoint, duration, path),
    else the nearest closed interval up to ``most`` seconds away, by (distance, midpoint distance, path).

    An interval without ends is its whole day. Intervals are copied to the buckets of ``span`` seconds that they and their
    margin touch; one join serves both cases, since containing intervals are those at distance 0.
    """
    day = F.col("day").cast("timestamp")
    i = intervals.withColumn("start", F.coalesce(F.col("start").cast("timestamp"), day)).withColumn("end", F.col("end").cast("timestamp"))
    i = i.withColumn("end", F.coalesce("end", F.col("start") + F.expr("INTERVAL 86400 SECONDS")))
    micro = int(span * 1_000_000)
    lo, hi = F.floor((micros(F.col("start")) - F.lit(int(most * 1e6))) / micro), F.floor((micros(F.col("end")) + F.lit(int(most * 1e6))) / micro)
    i = i.withColumn("_b", F.explode(F.sequence(lo, hi)))
    p = points.withColumn("_b", F.floor(micros(F.col("ts")) / micro))
    c = p.join(i.drop("day"), [*by, "_b"]).withColumn("away", seconds_to_interval(F.col("ts"), F.col("start"), F.col("end"))).where(F.col("away") <= most)
    mid = midpoint_distance(F.col("ts"), F.col("start"), F.col("end"))
    order = F.struct("away", mid.alias("mid"), seconds_between(F.col("start"), F.col("end")).alias("duration"), F.col(path))
    m = c.groupBy(*key).agg(F.min(order).alias("m"))
    return m.select(*key, f"m.{path}", F.when(F.col("m.away") == 0, "contained").otherwise("nearest").alias("method"), F.col("m.away").alias("away"))


def audit(points: DataFrame, matched: DataFrame, key: Sequence[str], valid=None) -> DataFrame:
    """Status of every point: matched, no_interval_match, or skipped_invalid where ``valid`` doesn't hold."""
    m = matched.select(*key, F.lit(True).alias("_m"))
    ok = valid if valid is not None else F.lit(True)
    return points.join(m, list(key), "left").withColumn("status", F.when(~ok, "skipped_invalid").when(F.col("_m"), "matched").otherwise("no_interval_match")).drop("_m")


def name_pairs(files: DataFrame, sensor: str, on: Sequence[str], pairwise: bool = True) -> DataFrame:
    """Files of the same name from two sensors: each pair once, or each sensor against all others."""
    a = files.select(*on, F.col(sensor).alias("a"))
    b = files.select(*on, F.col(sensor).alias("b"))
    return a.join(b, list(on)).where(F.col("a") < F.col("b") if pairwise else F.col("a") != F.col("b"))


def outer_merge(frames: Sequence[DataFrame], key: str, default: float = -1) -> DataFrame:
    """Full outer merge of (key, value columns) with a default for what is absent. All have the same key, so one
    partitioning serves every join."""
    out = reduce(lambda a, b: a.join(b, key, "full_outer"), frames)
    return out.select(key, *(F.coalesce(F.col(c), F.lit(default)).alias(c) for c in out.columns if c != key))


def missing_days(files: DataFrame, day: str, start: str, end: str) -> DataFrame:
    """Dates from start to end for which there is no file."""
    days = files.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    return days.join(files.select(F.col(day).alias("day")).distinct(), "day", "left_anti")


def complete_groups(df: DataFrame, by: Sequence[str], member: str, n: int) -> DataFrame:
    """Groups that hold n different members."""
    return df.groupBy(*by).agg(F.count_distinct(member).alias("n")).where(F.col("n") == n)


def exactly(df: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Names seen exactly n times."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n)


def station_match(stations: DataFrame, pixels: DataFrame, degrees: float, key: Sequence[str]) -> DataFrame:
    """Pixels (lat, lon, day) within ``degrees`` of a station (s_lat, s_lon, day) on its date, by cells of that size."""
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    p = pixels.withColumns({"_r": F.floor(F.col("lat") / degrees).cast("int"), "_c": F.floor(F.col("lon") / degrees).cast("int")})
    s = stations.withColumn("_r", F.explode(F.transform(near, lambda d: (F.floor(F.col("s_lat") / degrees) + d).cast("int"))))
    s = s.withColumn("_c", F.explode(F.transform(near, lambda d: (F.floor(F.col("s_lon") / degrees) + d).cast("int"))))
    on = ["_r", "_c"] + (["day"] if "day" in stations.columns else [])
    d2 = F.pow(F.col("lat") - F.col("s_lat"), 2) + F.pow(F.col("lon") - F.col("s_lon"), 2)
    return p.join(s, on).where(d2 <= degrees**2).drop("_r", "_c")
