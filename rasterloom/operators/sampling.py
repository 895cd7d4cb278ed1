"""Samples, quotas, caps and splits. Order comes from a hash of the key, so reruns agree and nothing is shuffled but ranks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampType

from .. import storage


def hash_order(*keys: str, seed: int = 0) -> list[Column]:
    return [F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(str(seed)))), *map(F.col, keys)]


def capped(df: DataFrame, strata: Sequence[str], key: Sequence[str], cap: int, seed: int = 0) -> DataFrame:
    """At most ``cap`` rows of each stratum, by hash order. Spark prunes each task's rows to the cap before the shuffle."""
    w = Window.partitionBy(*strata).orderBy(*hash_order(*key, seed=seed))
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= cap).drop("_rank")


def quotas(counts: DataFrame, total: int, n: str = "n", key: str = "stratum") -> DataFrame:
    """Adds quota: shares of ``total`` in proportion to n, whole numbers by largest remainder, never above n."""
    everything = Window.partitionBy()
    share = F.least(F.lit(float(total)), F.sum(n).over(everything).cast("double")) * F.col(n) / F.sum(n).over(everything)
    c = counts.withColumn("_share", share).withColumn("_floor", F.floor("_share"))
    c = c.withColumn("_rest", (F.least(F.lit(total), F.sum(n).over(everything)) - F.sum("_floor").over(everything)))
    w = Window.partitionBy(F.lit(0)).orderBy((F.col("_share") - F.col("_floor")).desc(), key)
    c = c.withColumn("quota", (F.col("_floor") + F.when(F.row_number().over(w) <= F.col("_rest"), 1).otherwise(0)).cast("bigint"))
    return c.drop("_share", "_floor", "_rest")


def quota_sample(df: DataFrame, stratum: str, key: Sequence[str], total: int, seed: int = 0) -> DataFrame:
    """A proportional sample of ``total`` rows in all, by hash order within strata; all strata take part."""
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    q = quotas(counts, total, key=stratum).select(F.col(stratum).alias("_s"), "quota")
    w = Window.partitionBy(stratum).orderBy(*hash_order(*key, seed=seed))
    # No quota is above total: with this constant bound Spark prunes each task's rows of a stratum before the shuffle.
    d = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= total).join(storage.counted(q, "quotas"), F.col(stratum).eqNullSafe(F.col("_s")))
    return d.where(F.col("_rank") <= F.col("quota")).drop("_rank", "_s", "quota")


def balanced_sample(df: DataFrame, group: str, key: Sequence[str], total: int, seed: int = 0) -> DataFrame:
    """``total`` rows in all (or all rows, if fewer): the same budget for each group, what is left over from the division one each to the
    first groups by name, and what small groups leave open filled up from the rest, all by hash order."""
    groups = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))  # a row a group
    everything = Window.partitionBy()
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(group)) - 1
    n = F.count(F.lit(1)).over(everything)
    budget = F.floor(F.lit(total) / n) + F.when(place < F.pmod(F.lit(total), n), 1).otherwise(0)
    b = groups.select(F.col(group).alias("_g"), "_n", budget.cast("bigint").alias("_budget"))
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*hash_order(*key, seed=seed))))
    # Beyond rank total no row can be taken: the rows before it in its group fill all that is open.
    ranked = ranked.where(F.col("_rank") <= total).join(storage.counted(b, "budgets"), F.col(group).eqNullSafe(F.col("_g")))
    taken = ranked.where(F.col("_rank") <= F.col("_budget"))
    open_ = total - int(b.agg(F.sum(F.least("_n", "_budget"))).first()[0] or 0)
    more = ranked.where(F.col("_rank") > F.col("_budget")).orderBy(*hash_order(*key, seed=seed)).limit(open_)
    return taken.unionByName(more).drop("_g", "_n", "_budget", "_rank")


def kmeans_sample(df: DataFrame, features: str, key: Sequence[str], k: int, total: int, seed: int = 0) -> DataFrame:
    """A proportional sample over the strata that k-means finds; adds stratum."""
    from .learning import kmeans

    return quota_sample(kmeans(df, k, features).withColumnRenamed("label", "stratum"), "stratum", key, total, seed)


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], need: Column, share: float, flag: str, margin: float = 0.0083) -> DataFrame:
    """Adds ``flag``: whether a row is among the first ``need`` (an expression of the group's count _n) of its group in order, nulls first.

    No group is sorted whole. Two quantiles of an order column, on both sides of ``share``, cut a group into five parts: the two values and what lies
    before, between and after them. Counts find the part where the cut falls, and only its rows go on: to the next column if it is a single value,
    which may hold most rows, else to a rank. A rough share or quantile only makes that part larger. Columns that aren't numbers or times are ranked.
    """
    keys = list(by) or ["_all"]
    rest = df if by else df.withColumn("_all", F.lit(0))
    own, names = [F.col(c).alias(f"_{i}") for i, c in enumerate(keys)], [f"_{i}" for i in range(len(keys))]
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(keys)))
    state = [F.count(F.lit(1)).alias("_n")]
    sides, done = [max(share - margin, 0.0), min(share + margin, 1.0)], []
    fits = [isinstance(df.schema[c].dataType, (NumericType, TimestampType, DateType)) for c in order]
    for i, c in enumerate(order):
        if i and not fits[i]:
            break
        q = F.percentile_approx(c, sides) if fits[i] else F.lit(None).cast("array<int>")
        cut = rest.groupBy(*own).agg(*state, q.alias("_q"))
        if not i:
            cut = cut.select(*names, need.cast("bigint").alias("_need"), (F.lit(not fits[0])).alias("_gap"), "_q")
        state = [F.first("_need").alias("_need"), F.first("_gap").alias("_gap")]
        rest = (rest.drop("_need", "_gap") if i else rest).join(storage.counted(cut, "cut"), same).drop(*names)
        if not fits[i]:
            break
        v, lo, hi = F.col(c), F.col("_q")[0], F.col("_q")[1]
        place = F.when(F.col("_gap"), 0).when(v.isNull(), -1).when(v < lo, 0).when(v == lo, 1).when(v < hi, 2).when(v == hi, 3).otherwise(4)
        rest = rest.withColumn("_k", place).drop("_q")
        hist = rest.groupBy(*own, "_k", "_need", "_gap").agg(F.count(F.lit(1)).alias("_c"))
        w = Window.partitionBy(*names).orderBy("_k")
        hist = hist.withColumn("_before", F.sum("_c").over(w) - F.col("_c"))  # six rows a group at most
        edge = hist.where((F.col("_before") <= F.col("_need")) & (F.col("_need") < F.col("_before") + F.col("_c")))
        gap = F.col("_gap") | F.col("_k").isin(0, 2, 4)
        edge = storage.written(edge.select(*names, F.col("_k").alias("_edge"), (F.col("_need") - F.col("_before")).alias("_open"), gap.alias("_g")), "cut")
        single = edge.where(~F.col("_g")).limit(1).count()
        # A group without an edge takes all its rows.
        rest = rest.join(storage.checked(edge), same, "left").drop(*names)
        done.append(rest.where(F.col("_edge").isNull() | (F.col("_k") != F.col("_edge"))).withColumn(flag, F.col("_edge").isNull() | (F.col("_k") < F.col("_edge"))).select(*df.columns, flag))
        rest = rest.where(F.col("_k") == F.col("_edge")).drop("_need", "_gap", "_k", "_edge").withColumnsRenamed({"_open": "_need", "_g": "_gap"})
        if not single:
            break
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    done.append(rest.withColumn(flag, rank <= F.col("_need")).select(*df.columns, flag))
    return reduce(DataFrame.unionByName, done)


def lowest_decile(df: DataFrame, by: Sequence[str], value: str, *tie: str) -> DataFrame:
    """The lowest tenth of each group: rows with rank up to floor(n / 10)."""
    return first_rows(df, by, [value, *tie], F.floor(F.col("_n") / 10), 0.1, "_in").where("_in").drop("_in")


def split_by_position(df: DataFrame, order: Sequence[str], validation: float) -> DataFrame:
    """Adds part: train for the first int(n * (1 - validation)) rows in order, else val."""
    d = first_rows(df, [], order, F.floor(F.col("_n") * F.lit(1 - validation)), 1 - validation, "_in")
    return d.withColumn("part", F.when(F.col("_in"), "train").otherwise("val")).drop("_in")


def holdout(df: DataFrame, mode: str, group: str | None = None, date: str | None = None, fraction: float = 0.2, cutoff: str | None = None, ranges: Sequence[tuple[str, str]] = (), seed: int = 0) -> DataFrame:
    """Adds is_test. none; grouped_random and grouped_date: whole groups by hash; date_cutoff: from the date on;
    date_ranges: in any of the closed ranges, whose last days count whole."""
    if mode == "none":
        test = F.lit(False)
    elif mode in ("grouped_random", "grouped_date"):
        key = F.col(group).cast("string") if mode == "grouped_random" else F.to_date(date).cast("string")
        test = F.conv(F.substring(F.md5(F.concat_ws("|", key, F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint") < int(fraction * 2**32)
    elif mode == "date_cutoff":
        test = F.to_date(date) >= F.lit(cutoff).cast("date")
    elif mode == "date_ranges":
        test = F.lit(False)
        for a, b in ranges:
            test = test | F.to_date(date).between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    else:
        raise ValueError(f"no holdout mode {mode}")
    return df.withColumn("is_test", test)


def folds(df: DataFrame, group: str, n: int, seed: int = 0) -> DataFrame:
    """Adds fold, 0 to n - 1, the same for all rows of a group."""
    return df.withColumn("fold", F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.col(group).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int"))


def bootstrap_groups(df: DataFrame, group: str, members: int, seed: int = 0) -> DataFrame:
    """A row for each draw: each of ``members`` resamples draws as many groups as there are, with replacement.

    Draw d of a member takes the group whose place is a hash of (member, d), so groups are ranked once and rows joined.
    """
    groups = df.select(group).distinct()
    n = groups.count()
    placed = groups.withColumn("_place", F.row_number().over(Window.orderBy(group)) - 1)
    draws = df.sparkSession.range(members * n).select(F.floor(F.col("id") / n).cast("int").alias("member"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int").alias("_place"))
    picks = draws.join(placed, "_place").groupBy("member", group).agg(F.count(F.lit(1)).alias("times"))
    return df.join(picks, group).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("_copy", "times")
