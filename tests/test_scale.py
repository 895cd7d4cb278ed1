"""Forms without whole groups in a task, against plain versions."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import storage
from rasterloom.operators import learning, matchup, sampling


def plain_knn(ids, v, k):
    with np.errstate(all="ignore"):
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = set()
    for i, a in enumerate(ids):
        d = sorted((round(1 - float(u[i] @ u[j]), 9), b) for j, b in enumerate(ids) if b != a and not np.isnan(u[i] @ u[j]))
        out |= {(a, b, r + 1) for r, (_, b) in enumerate(d[:k])}
    return out


@pytest.mark.parametrize("block", [7, 50, 4096])
def test_knn_whatever_the_blocks(spark, block):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((60, 4))
    v[3] = 0  # no direction
    ids = [f"r{i:02d}" for i in range(60)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)] + [("null", None)], "id string, features array<double>")
    got = learning.knn(df, "id", 3, block=block).collect()
    assert {(r.a, r.b, r["rank"]) for r in got} == plain_knn(ids, v, 3)


def test_knn_of_equal_vectors_takes_smaller_keys(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(12)], "id int, features array<double>")
    got = {(r.a, r.b) for r in learning.knn(df, "id", 2, block=5).where(F.abs("dist") < 1e-9).collect()}
    assert len(got) == 24
    assert learning.knn(df.limit(0), "id", 2).count() == 0


def test_approximate_knn_recall(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 16))
    v = centres[rng.integers(0, 40, 1500)] + 0.15 * rng.standard_normal((1500, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, features array<double>")
    exact = {(r.a, r.b) for r in learning.knn(df, "id", 5).collect()}
    near = {(r.a, r.b) for r in learning.approximate_knn(df, "id", 5, rows=200, block=64).collect()}
    assert len(exact) == len(near) == 7500
    assert len(exact & near) / 7500 >= 0.9


def test_moments_by_rows_of_the_matrix(spark):
    v = np.random.default_rng(7).standard_normal((200, 5))
    df = spark.createDataFrame([(x.tolist(),) for x in v], "features array<double>").repartition(9)
    mean, cov, n = learning.moments(df)
    assert n == 200 and np.allclose(mean, v.mean(0)) and np.allclose(cov, np.cov(v.T, bias=True))
    with pytest.raises(ValueError):
        learning.moments(df.limit(0))


def plain_first(rows, need):
    out = set()
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        out |= set(own[: need(len(own))])
    return out


@pytest.mark.parametrize("share, hint", [(0.0, 0.0), (0.1, 0.1), (0.5, 0.5), (0.5, 0.2), (0.9, 0.9), (1.0, 1.0)])
def test_first_rows_with_hot_values_and_nulls(spark, share, hint):
    rnd = random.Random(8)
    rows = [("hot", 1.0 if rnd.random() < 0.6 else rnd.random() * 3, i) for i in range(700)]
    rows += [("nulls", None if rnd.random() < 0.3 else float(rnd.randint(0, 3)), i) for i in range(90)] + [("one", 2.0, 0), (None, 5.0, 1), (None, 4.0, 2)]
    df = spark.createDataFrame(rows, "g string, v double, id int")
    out = sampling.first_rows(df, ["g"], ["v", "id"], F.floor(F.col("_n") * F.lit(share)), hint, "first")
    got = out.collect()
    assert sorted(map(repr, ((r.g, r.v, r.id) for r in got))) == sorted(map(repr, rows))
    assert {(r.g, r.v, r.id) for r in got if r["first"]} == plain_first(rows, lambda n: int(n * share))


def test_first_rows_of_names_and_of_nothing(spark):
    df = spark.createDataFrame([(f"n{i:03d}",) for i in range(50)], "name string")
    parts = sampling.split_by_position(df, ["name"], 0.2)
    assert {r.name for r in parts.where("part = 'val'").collect()} == {f"n{i:03d}" for i in range(40, 50)}
    assert sampling.split_by_position(df.limit(0), ["name"], 0.2).count() == 0
    assert sampling.lowest_decile(df.withColumn("g", F.lit(1)).limit(0), ["g"], "name").count() == 0


def test_quota_and_balanced_samples_stay_exact(spark):
    df = spark.createDataFrame([("a" if i % 10 else "b", i) for i in range(500)], "s string, id int")
    n = {r.s: r["count"] for r in sampling.quota_sample(df, "s", ["id"], 20).groupBy("s").count().collect()}
    assert n == {"a": 18, "b": 2}
    n = {r.s: r["count"] for r in sampling.balanced_sample(df, "s", ["id"], 140).groupBy("s").count().collect()}
    assert n == {"a": 90, "b": 50}


@pytest.mark.parametrize("slices", [1, 4, 16])
def test_asof_against_all_pairs(spark, slices):
    rnd = random.Random(9)
    start = dt.datetime(2024, 1, 1)
    at = lambda s: start + dt.timedelta(seconds=s)
    t = [(i, "hot" if rnd.random() < 0.7 else rnd.choice("xyz"), rnd.randint(0, 3000)) for i in range(200)] + [(900, "hot", None), (901, None, 5)]
    o = [("hot" if rnd.random() < 0.7 else rnd.choice("xyz"), rnd.randint(-200, 3000), f"p{rnd.randint(0, 80)}") for _ in range(120)] + [("hot", None, "p0"), (None, 5, "p1")]
    td = spark.createDataFrame([(i, g, None if s is None else at(s)) for i, g, s in t], "target int, grp string, ts timestamp")
    od = spark.createDataFrame([(g, None if s is None else at(s), p) for g, s, p in o], "grp string, o_ts timestamp, path string")
    want = {}
    for i, g, s in t:
        c = [(abs(b - s), p, b - s) for h, b, p in o if s is not None and g is not None and h == g and b is not None and abs(b - s) <= 60]
        if c:
            want[i] = min((a, p, abs(d)) for a, p, d in c)[:2]
    got = {r.target: (abs(r["dt"]), r.path) for r in matchup.asof_nearest(td, od, ["grp"], 60, ["target"], "path", slices).collect()}
    assert got == want
    assert matchup.asof_nearest(td, od.limit(0), ["grp"], 60, ["target"], "path").count() == 0


def test_tables_beyond_the_bound_are_not_broadcast(spark, monkeypatch):
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    small = storage.counted(spark.range(5).withColumnRenamed("id", "k"))
    assert "broadcast" in plan(spark.range(9).join(small, F.col("id") == F.col("k")))
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 4)
    large = storage.counted(spark.range(5).withColumnRenamed("id", "k"))
    assert "broadcast" not in plan(spark.range(9).join(large, F.col("id") == F.col("k")))
