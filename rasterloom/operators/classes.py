"""Class maps: contexts from clusters, class sets, ordinal combinations and priority masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("or_presence", "and_presence", "max", "sum_capped", "mean", "mean_ceil", "mean_floor")


def context_apply(labels: DataFrame, sets: DataFrame, background: int = 0, label: str = "label") -> DataFrame:
    """Adds context: j + 1 where the label is in set j (the last such j), background elsewhere, -1 where there is no label;
    and full: the label where it matched. sets: (cluster, j), a row for each member, a dimension table."""
    top = sets.groupBy("cluster").agg(F.max("j").alias("j"))
    out = labels.join(top, labels[label] == top["cluster"], "left")
    has = F.col(label).isNotNull() & (F.col(label) >= 0)
    out = out.withColumn("context", F.when(~has, -1).otherwise(F.coalesce(F.col("j") + 1, F.lit(background))).cast("int"))
    return out.withColumn("full", F.when(has & F.col("j").isNotNull(), F.col(label)).otherwise(-1).cast("int")).drop("cluster", "j")


def one_hot(df: DataFrame, value: str, classes: Sequence[int]) -> DataFrame:
    """A column class_<k> for each class: 1 there, 0 at other valid pixels, -1 at invalid ones."""
    v = F.col(value)
    return df.select(*df.columns, *(F.when(v.isNull() | (v < 0), -1).when(v == k, 1).otherwise(0).alias(f"class_{k}") for k in classes))


def max_bin(sets: DataFrame) -> DataFrame:
    """label -> its highest bin."""
    return sets.groupBy("label").agg(F.max("bin").alias("bin"))


def merge_sets(*sets: DataFrame) -> DataFrame:
    """Merges class sets (label, bin): the higher bin wins; a label that a set lacks counts as -1 there."""
    out = sets[0].select("label", "bin")
    for s in sets[1:]:
        out = out.unionByName(s.select("label", "bin"))
    return max_bin(out)


def add_missing(current: DataFrame, more: DataFrame) -> DataFrame:
    """Labels of ``more`` that no bin of ``current`` has join one bin lower; those of bin 0 have no lower bin and stay out."""
    new = more.where(F.col("bin") > 0).join(current.select("label").distinct(), "label", "left_anti")
    return current.select("label", "bin").unionByName(new.select("label", (F.col("bin") - 1).alias("bin")))


def positives(assignment: DataFrame, accept_uncertain: bool = False) -> DataFrame:
    """Clusters of a two-class problem that count as positive."""
    ok = F.col("class") == 1
    if accept_uncertain:
        ok = ok | (F.col("status") == "uncertain")
    return assignment.where(ok).select("cluster")


def ordinal_combine(a: Column, b: Column, mode: str, top: int = 6) -> Column:
    """One severity from two; -1 if either is."""
    mean = (a + b) / F.lit(2)
    out = {
        "or_presence": ((a > 0) | (b > 0)).cast("int"),
        "and_presence": ((a > 0) & (b > 0)).cast("int"),
        "max": F.greatest(a, b),
        "sum_capped": F.least(a + b, F.lit(top)),
        "mean": F.rint(mean).cast("int"),
        "mean_ceil": F.ceil(mean).cast("int"),
        "mean_floor": F.floor(mean).cast("int"),
    }[mode]
    return F.when((a == -1) | (b == -1), -1).otherwise(out).cast("int")


def priority_mask(products: Sequence[tuple[Column, int]]) -> Column:
    """The class of the first product that is set; NULL for none."""
    return F.coalesce(*(F.when(hit, F.lit(k)) for hit, k in products))


def glint_mask(products: Sequence[tuple[Column, int]], aerosol: Column, aerosol_class: int, glint: Column) -> Column:
    """priority_mask, overwritten by aerosol where it is set and there is no glint."""
    return F.when(aerosol & (glint == 0), F.lit(aerosol_class)).otherwise(priority_mask(products))


def replacing_mask(products: Sequence[tuple[Column, int]], first: Column) -> Column:
    """priority_mask in which the first class takes pixels back from classes 2 and up."""
    k = priority_mask(products)
    return F.when(first & (F.coalesce(k, F.lit(2)) >= 2), F.lit(1)).otherwise(k)
