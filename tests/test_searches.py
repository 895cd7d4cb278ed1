"""Searches and fits over all rows, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import grid, learning


def plain_km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h)))


def test_radius_at_poles_and_across_the_dateline(spark):
    rng = np.random.default_rng(5)
    places = [(90.0, 0.0), (-90.0, 10.0), (89.9, 170.0), (89.9, -10.0), (10.0, 179.99), (10.0, -179.99), (10.0, 180.0), (10.0, -180.0)]
    places += [(float(a), float(b)) for a, b in zip(rng.uniform(86, 90, 60), rng.uniform(-180, 180, 60))]
    places += [(float(a), float(b - 360 * (b > 180))) for a, b in zip(rng.uniform(-3, 3, 60), rng.uniform(178, 182, 60))]
    pts = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id int, lat double, lon double")
    tgt = pts.select(F.col("id").alias("tid"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    for km in (50, 300):
        got = sorted((r.id, r.tid) for r in grid.within_radius(pts, tgt, km).collect())
        assert got == sorted((i, j) for i, a in enumerate(places) for j, b in enumerate(places) if plain_km(*a, *b) <= km)


def test_bilinear_across_the_dateline(spark):
    src = spark.createDataFrame([(0.1, 179.9, 1.0), (-0.1, 179.9, 1.0), (0.1, -179.9, 3.0), (-0.1, -179.9, 3.0)], "lat double, lon double, value double")
    tgt = spark.createDataFrame([("k", 0.0, 180.0)], "k string, t_lat double, t_lon double")
    assert grid.bilinear(src, tgt, 60, ["k"]).first().value == pytest.approx(2.0)


@pytest.mark.parametrize("buckets", [1, 3, 200])
def test_wasserstein_counts_every_row(spark, buckets):
    rng = np.random.default_rng(7)
    x, y = np.exp(rng.normal(size=700) * 2).round(2), np.append(np.exp(rng.normal(size=450)).round(2), 1e6)
    v = np.sort(np.concatenate([x, y]))
    shares = [np.searchsorted(np.sort(s), v[:-1], "right") / len(s) for s in (x, y)]
    a, b = (spark.createDataFrame([(float(e),) for e in s] + [(None,)], "value double") for s in (x, y))
    assert learning.wasserstein_1d(a, b, "value", buckets).first().distance == pytest.approx(float((np.abs(shares[0] - shares[1]) * np.diff(v)).sum()))
    assert learning.wasserstein_1d(a, b.where("value < 0"), "value", buckets).first().distance is None


def test_cluster_tree_fits_all_rows(spark):
    # 24,000 rows of one parent: the centres are the means of all rows that they get.
    rng = np.random.default_rng(9)
    x = rng.normal(size=(24_000, 2)) * 0.1 + rng.integers(0, 2, (24_000, 1)) * 5
    rows = [(i, 1, v.tolist()) for i, v in enumerate(x)] + [(90_000 + i, 2, [0.0, float(i)]) for i in range(3)] + [(99_999, None, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, label int, features array<double>")
    out = {r.id: r for r in learning.cluster_tree(df, 2, 10, "id").collect()}
    assert len(out) == len(rows)
    child = np.array([out[i].child for i in range(24_000)])
    centres = np.stack([x[child == c].mean(0) for c in (0, 1)])
    assert (((x[:, None] - centres[None]) ** 2).sum(2).argmin(1) == child).all()
    assert (np.array([out[i].cluster for i in range(24_000)]) == 2 + child).all()
    assert all(out[90_000 + i].child == 0 and out[90_000 + i].cluster == 4 for i in range(3))
