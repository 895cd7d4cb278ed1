"""Whole jobs against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import flows


def test_second_pass_raises_bins(spark):
    # Stream 1 never sees class 2 in the truth, but its label lies where stream 0's product has it.
    a = [(0, i, 0, 5, 2) for i in range(10)]
    b = [(1, i, 0, 7, 0 if i < 6 else 2) for i in range(10)]
    p = spark.createDataFrame(a + b + [(1, 50, 0, -1, 2), (1, 51, 0, None, 2), (1, 52, 0, 9, None)], "prio int, x int, y int, label int, klass int")
    sets, product = flows.post_inference(p, "prio", ["y", "x"], t=0.5)
    assert {tuple(r) for r in sets.collect()} == {(0, 5, 2), (1, 7, 2), (1, 9, 0)}
    got = {r.x: (r.value, r.dqi) for r in product.collect()}
    assert got == {i: (2, 0) for i in range(10)} | {50: (-1, -1), 51: (-1, -1), 52: (0, 1)}
    assert flows.post_inference(p.limit(0), "prio", ["y", "x"])[1].count() == 0


def test_children_get_sets_of_their_own(spark):
    rows = [(0, i, 3, 30 + i % 2, 1 if i % 2 else 0) for i in range(8)]
    p = spark.createDataFrame(rows, "prio int, x int, label int, child int, klass int")
    sets, _ = flows.post_inference(p, "prio", ["x"], t=0.5, child="child")
    assert {tuple(r) for r in sets.collect()} == {(0, 30, 0), (0, 31, 0)}


def test_split_files_without_name_or_day(spark):
    df = spark.createDataFrame([("a1", "2024-01-01"), ("a2", "2024-03-01"), ("b", "2024-01-01"), (None, "2024-01-01"), ("a3", None)], "path string, d string")
    out = flows.split_files(df.withColumn("day", F.to_date("d")), "^a", "day", "2024-02-01")
    assert {(r.path, r.d): r.part for r in out.collect()} == {("a1", "2024-01-01"): "train", ("a2", "2024-03-01"): "test", ("b", "2024-01-01"): "unused", (None, "2024-01-01"): "unused", ("a3", None): "unused"}


def test_tiles_of_two_textures_are_two_clusters(spark):
    rows = [(0, y, x, float((y // 4 + x // 4) % 2 * 8 + (x * y) % 2)) for y in range(16) for x in range(16)]
    p = spark.createDataFrame(rows, "scene int, y int, x int, value double")
    got = {(r.y, r.x): r.cluster for r in flows.tile_clusters(p, 4, "value", 0.0, 10.0, 5, 2).collect()}
    assert len(got) == 256 and len(set(got.values())) == 2
    assert all((got[y, x] == got[0, 0]) == ((y // 4 + x // 4) % 2 == 0) for y, x in got)


def test_scaled_distances_give_the_distances_back(spark):
    z = np.random.default_rng(3).standard_normal((12, 2))
    pairs = spark.createDataFrame([(i, j, float(np.linalg.norm(z[i] - z[j]))) for i in range(12) for j in range(i)], "a int, b int, dist double")
    out = {r.a: np.array(r.features) for r in flows.scaled_distances(pairs, 2).collect()}
    assert all(abs(np.linalg.norm(out[i] - out[j]) - np.linalg.norm(z[i] - z[j])) < 1e-9 for i in range(12) for j in range(i))
    with pytest.raises(ValueError):
        flows.scaled_distances(pairs.where("a <> 5 or b <> 4"), 2)
    with pytest.raises(ValueError):
        flows.scaled_distances(pairs.limit(0), 2)
