"""Agreement of maps: confusion counts and what follows from them.

Counts come from one aggregate over the pixels; every metric is an expression over those counts, NULL where undefined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_div


def confusion(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """tp, tn, fp, fn over rows where both 0/1 columns are valid."""
    t, p = F.col(truth), F.col(pred)
    n = lambda a, b: F.count_if((t == a) & (p == b))
    return df.groupBy(*by).agg(n(1, 1).alias("tp"), n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"))


def nan_mean(*xs: Column) -> Column:
    """Mean of the values that are there."""
    n = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in xs), F.lit(0))
    return safe_div(sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0)), n)


def binary_metrics() -> dict[str, Column]:
    """Metrics of a table with tp, tn, fp, fn."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    recall, specificity = safe_div(tp, tp + fn), safe_div(tn, tn + fp)
    return {
        "precision": safe_div(tp, tp + fp),
        "recall": recall,
        "specificity": specificity,
        "f1": safe_div(2 * tp, 2 * tp + fp + fn),
        "iou": safe_div(tp, tp + fp + fn),
        "balanced_accuracy": nan_mean(recall, specificity),
        "mcc": safe_div(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)),
        "prevalence": safe_div(tp + fn, n),
        "predicted_rate": safe_div(tp + fp, n),
        "dice": safe_div(2 * tp, 2 * tp + fp + fn),
        "n": n.cast("bigint"),
    }


def weighted_mean(value: Column, weight: Column) -> Column:
    """Over rows with a value and a weight above 0."""
    ok = value.isNotNull() & ~F.isnan(value) & (weight > 0)
    return safe_div(F.sum(F.when(ok, value * weight)), F.sum(F.when(ok, weight)))


def summary(scenes: DataFrame) -> DataFrame:
    """Micro metrics of the summed counts, and the plain and pixel-weighted mean of dice over scenes."""
    m = scenes.withColumns({k: v for k, v in binary_metrics().items() if k in ("dice", "n")})
    total = m.agg(*(F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")), F.avg("dice").alias("mean_dice"), weighted_mean(F.col("dice"), F.col("n")).alias("weighted_dice"))
    return total.withColumns({k: binary_metrics()[k] for k in ("precision", "recall", "f1", "iou", "mcc", "n")})


def trivial_baselines(counts: DataFrame) -> DataFrame:
    """Counts of the predictors that always say 0 and always say 1, from totals."""
    pos, neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    zero = F.lit(0).cast("bigint")
    a = counts.select(F.lit("all_zero").alias("predictor"), zero.alias("tp"), neg.alias("tn"), zero.alias("fp"), pos.alias("fn"))
    return a.unionByName(counts.select(F.lit("all_one").alias("predictor"), pos.alias("tp"), zero.alias("tn"), neg.alias("fp"), zero.alias("fn")))


def confusion_matrix(df: DataFrame, truth: str, pred: str, labels: Sequence[int]) -> DataFrame:
    """(truth, pred, cnt, share of the truth's row) for every pair of the labels, 0 where none occurs."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "truth int, pred int")
    n = df.groupBy(F.col(truth).cast("int").alias("truth"), F.col(pred).cast("int").alias("pred")).agg(F.count(F.lit(1)).alias("cnt"))
    out = grid.join(n, ["truth", "pred"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0).cast("bigint")))
    totals = out.groupBy("truth").agg(F.sum("cnt").alias("total"))
    return out.join(totals, "truth").select("truth", "pred", "cnt", safe_div(F.col("cnt"), F.col("total")).alias("row_share"))


def per_class(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """(class, tp, fp, fn, precision, recall, f1, support) of each class that the truth has.

    precision is 1 where nothing was predicted, recall likewise; f1 is 0 where both are 0. Each pixel is counted
    once as truth and once as prediction, in one aggregate.
    """
    t, p = F.col(truth), F.col(pred)
    side = F.explode(F.array(F.struct(t.alias("class"), F.lit(1).alias("is_truth")), F.struct(p.alias("class"), F.lit(0).alias("is_truth"))))
    d = df.where(t.isNotNull() & p.isNotNull()).select(*by, (t == p).alias("hit"), side.alias("e"))
    c = d.groupBy(*by, F.col("e.class").alias("class")).agg(
        F.count_if(F.col("hit") & (F.col("e.is_truth") == 1)).alias("tp"),
        F.count_if(~F.col("hit") & (F.col("e.is_truth") == 0)).alias("fp"),
        F.count_if(~F.col("hit") & (F.col("e.is_truth") == 1)).alias("fn"),
    )
    return scored(c.where(F.col("tp") + F.col("fn") > 0))


def scored(c: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    c = c.withColumn("precision", F.coalesce(safe_div(tp, tp + fp), F.lit(1.0))).withColumn("recall", F.coalesce(safe_div(tp, tp + fn), F.lit(1.0)))
    f1 = F.coalesce(safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return c.withColumn("f1", f1).withColumn("support", tp + fn)


def accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Accuracy, and the mean over classes of the recall."""
    t, p = F.col(truth), F.col(pred)
    rec = df.where(t.isNotNull() & p.isNotNull()).groupBy(t.alias("class")).agg(F.count_if(t == p).alias("hit"), F.count(F.lit(1)).alias("n"))
    return rec.agg((F.sum("hit") / F.sum("n")).alias("accuracy"), F.avg(F.col("hit") / F.col("n")).alias("balanced_accuracy"))


def grouped_scores(facts: DataFrame, sets: Sequence[Sequence[str]], keys: Sequence[str], value: str = "f1", weight: str = "support") -> DataFrame:
    """Weighted mean score for several groupings at once, in one pass over the fact table."""
    v, w = F.col(value), F.col(weight)
    total = F.sum(F.when(v.isNotNull() & (w > 0), w))
    return facts.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, keys)).agg(
        safe_div(F.sum(F.when(w > 0, v * w)), total).alias("weighted_f1"), F.sum(w).alias("support"), F.grouping_id().cast("int").alias("level"))


def disagreement(df: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """Share of compared scenes in which the two maps differ, NULL where none was compared."""
    ok = F.col(a).isNotNull() & F.col(b).isNotNull()
    return df.groupBy(*by).agg(F.count_if(ok & (F.col(a) != F.col(b))).alias("differ"), F.count_if(ok).alias("compared")).withColumn("share", safe_div(F.col("differ"), F.col("compared")))


def matrix_from_rows(rows: DataFrame, offset: int = 0) -> DataFrame:
    """(bin, pos, cnt) of a matrix given as row vectors (sev, counts): vectors of one bin add up."""
    return rows.select((F.col("sev") + offset).alias("bin"), F.posexplode("counts").alias("pos", "n")).groupBy("bin", "pos").agg(F.sum("n").alias("cnt"))


def bin_scores(matrix: DataFrame) -> DataFrame:
    """(bin, f1, support) of each truth bin of a confusion matrix (bin, pos, cnt); 0 where nothing hits."""
    side = F.explode(F.array(F.struct(F.col("bin").alias("k"), F.lit(1).alias("is_truth")), F.struct(F.col("pos").alias("k"), F.lit(0).alias("is_truth"))))
    d = matrix.select("cnt", (F.col("bin") == F.col("pos")).alias("hit"), side.alias("e"))
    s = lambda c: F.coalesce(F.sum(F.when(c, F.col("cnt"))), F.lit(0))
    is_truth = F.col("e.is_truth") == 1
    c = d.groupBy(F.col("e.k").alias("bin")).agg(s(F.col("hit") & is_truth).alias("tp"), s(~F.col("hit") & ~is_truth).alias("fp"), s(~F.col("hit") & is_truth).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.where(tp + fn > 0).select("bin", F.coalesce(safe_div(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"), (tp + fn).alias("support"))


def macro_weighted(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg("f1").alias("macro_f1"), safe_div(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"), F.sum("support").alias("support"))


def quadratic_kappa(matrix: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """1 - sum(w * observed) / sum(w * expected) of a matrix (truth, pred, cnt), w = (i - j)^2 / (k - 1)^2.

    The expected sum needs only row and column moments: sum over i, j of (i - j)^2 r_i c_j / n
    = R2 + C2 - 2 R1 C1 / n. One aggregate, no self-join.
    """
    i, j, n = F.col("truth"), F.col("pred"), F.col("cnt")
    m = matrix.groupBy(*by).agg(F.sum((i - j) * (i - j) * n).alias("o"), F.sum(i * i * n).alias("r2"), F.sum(j * j * n).alias("c2"), F.sum(i * n).alias("r1"), F.sum(j * n).alias("c1"), F.sum(n).alias("n"))
    e = F.col("r2") + F.col("c2") - 2 * safe_div(F.col("r1") * F.col("c1").cast("double"), F.col("n"))
    return m.select(*by, (1 - safe_div(F.col("o"), e)).alias("kappa"), "n")


def global_ssim(df: DataFrame, a: str, b: str, value_range: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """Structural similarity with one window over the whole image, from sample moments."""
    c1, c2 = (0.01 * value_range) ** 2, (0.03 * value_range) ** 2
    m = df.groupBy(*by).agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.covar_samp(a, b).alias("vab"))
    x = (2 * F.col("ma") * F.col("mb") + c1) * (2 * F.col("vab") + c2) / ((F.col("ma") ** 2 + F.col("mb") ** 2 + c1) * (F.col("va") + F.col("vb") + c2))
    return m.select(*by, x.alias("ssim"))
