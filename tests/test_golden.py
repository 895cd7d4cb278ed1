"""Operators against numpy on tiny arrays, and one test for each decision on unclear semantics."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import scalars as S
from rasterloom.operators import classes, focal, grid, learning, masking, matchup, merging, metrics, regions, sampling, sequences, tiles, zonal


def raster(spark, a, name="value", scene=0):
    rows = [(scene, int(y), int(x), None if a[y, x] is None or a[y, x] != a[y, x] else float(a[y, x])) for y, x in np.ndindex(a.shape)]
    return spark.createDataFrame(rows, f"scene bigint, y int, x int, {name} double")


def array(df, name, shape, fill=np.nan):
    out = np.full(shape, fill)
    for r in df.collect():
        out[r.y, r.x] = np.nan if r[name] is None else r[name]
    return out


def labels(seed, shape, k):
    return np.random.default_rng(seed).integers(0, k, shape).astype(float)


def test_valid_range_excludes_its_upper_end(spark):
    got = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0, 2.5, float("nan"), float("inf"), -999999.0, None)], "v double").select(masking.valid_range(F.col("v"), 0, 2, -999999.0)).collect()
    assert [r[0] for r in got] == [0.0, 1.0, None, None, None, None, None, None]


def test_complete_samples_and_channel_delete(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1.0, None, 3.0],)], "features array<double>")
    assert masking.complete_samples(df).count() == 1
    assert df.select(masking.delete_channels(F.col("features"), [0, 2]).alias("f")).first().f == [2.0]


def test_neighbourhood_order(spark):
    a = np.arange(25.0).reshape(5, 5)
    got = {(r.y, r.x): r.features for r in focal.neighbourhood(raster(spark, a), 1).collect()}
    want = {(y, x): a[y - 1 : y + 2, x - 1 : x + 2].ravel().tolist() for y in range(1, 4) for x in range(1, 4)}
    assert got == want


@pytest.mark.parametrize("r", [1, 2])
def test_focal_class_stats(spark, r):
    a = labels(1, (6, 7), 3)
    got = {(x.y, x.x): x for x in focal.class_stats(raster(spark, a, "label"), r).collect()}
    for y, x in np.ndindex(a.shape):
        box = a[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].ravel()
        g = got[y, x]
        p = np.clip((box == a[y, x]).mean(), 1e-8, 1 - 1e-8)
        assert g.n_valid == len(box)
        assert g.frac_same == pytest.approx((box == a[y, x]).mean())
        assert g.n_distinct == len(set(box)) + (len(box) < (2 * r + 1) ** 2)
        assert g.entropy == pytest.approx(-(p * np.log(p) + (1 - p) * np.log(1 - p)), abs=1e-9)


def test_morphology_and_singles(spark):
    a = np.zeros((8, 8))
    a[1:4, 1:4] = 1
    a[2, 2] = 0
    a[6, 6] = 1
    df = raster(spark, a)
    box = lambda f: np.array([[f(a[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]) for x in range(8)] for y in range(8)])
    assert (array(focal.morph(df, "dilate"), "morphed", (8, 8)) == box(np.max)).all()
    assert (array(focal.morph(df, "erode"), "morphed", (8, 8)) == box(np.min)).all()
    singles = array(focal.remove_singles(df), "cleaned", (8, 8))
    assert singles[6, 6] == 0 and singles.sum() == 8


def test_regions_holes_and_blocks(spark):
    a = np.zeros((8, 8))
    a[1:4, 1:4] = 1
    a[2, 2] = 0
    a[6, 6] = 1
    a[0, 7] = 1
    df = raster(spark, a)
    meta = spark.createDataFrame([(0, 8, 8)], "scene bigint, height int, width int")
    filled = array(regions.filled(df, meta), "filled", (8, 8))
    want = a.copy()
    want[2, 2] = 1
    assert (filled == want).all()
    for block in (2, 3, 256):  # regions that cross blocks are joined
        sizes = sorted(r.size for r in regions.sizes(regions.labelled(df.where("value = 1"), block=block)).collect())
        assert sizes == [1, 1, 8]
    assert regions.large_regions(df, 8).count() == 8
    assert regions.largest_region(df).count() == 8


def test_long_snake_is_one_region(spark):
    rows = [(0, y, x) for y in range(0, 12) for x in range(12) if y % 2 == 0 or x == (11 if y % 4 == 1 else 0)]
    df = spark.createDataFrame(rows, "scene bigint, y int, x int")
    assert regions.sizes(regions.labelled(df, eight=False, block=3)).count() == 1


def test_sliding_tiles_drop_incomplete_ones(spark):
    a = np.arange(49.0).reshape(7, 7)
    t = tiles.packed(tiles.sliding(raster(spark, a), 3, 2, 7, 7), 3, 2).collect()
    assert len(t) == 9
    for r in t:
        assert r.data == a[r.y0 : r.y0 + 3, r.x0 : r.x0 + 3].ravel().tolist()


def test_constant_tiles_really_go(spark):
    a = np.zeros((4, 4))
    a[2:, 2:] = [[1, 2], [3, 4]]
    s = tiles.useful(tiles.stats(tiles.sliding(raster(spark, a), 2, 2, 4, 4)))
    assert [(r.tile_y, r.tile_x) for r in s.collect()] == [(1, 1)]


def test_edge_tiles(spark):
    a = np.arange(25.0).reshape(5, 5)
    e = tiles.edge_tiles(raster(spark, a), 2, 5, 5).groupBy("tile_y", "tile_x").count().collect()
    assert all(r["count"] == 4 for r in e) and (0, 0) in {(r.tile_y, r.tile_x) for r in e}


def test_sequences_never_cross_trials_or_gaps(spark):
    rows = [(1, t, float(t)) for t in range(6)] + [(2, t, float(t)) for t in range(3)] + [(3, t, None if t == 2 else float(t)) for t in range(7)]
    got = sequences.causal(spark.createDataFrame(rows, "trial int, t int, value double"), 4).collect()
    assert {(r.trial, r.t) for r in got} == {(1, 3), (1, 4), (1, 5), (3, 6)}
    assert [r.seq for r in got if (r.trial, r.t) == (1, 4)] == [[1.0, 2.0, 3.0, 4.0]]


def test_zonal_histogram_conserves_pixels(spark):
    df = spark.createDataFrame([(0, 0.12345), (0, 0.1235), (1, 2.0), (None, 3.0)], "zone int, value double")
    got = {(r.zone, r.value): r.cnt for r in zonal.zonal_histogram(df, "zone", "value").collect()}
    assert sum(got.values()) == 4 and got[-1, 3.0] == 1


def test_majority_ties_and_negative_clusters(spark):
    c = spark.createDataFrame([(1, 2, 5), (1, 0, 5), (2, 1, 9), (2, 0, 1), (-1, 0, 50)], "cluster int, class int, cnt bigint")
    got = {r.cluster: (r["class"], r.status) for r in zonal.majority(c, 0.6).collect()}
    assert got == {1: (0, "uncertain"), 2: (1, "assigned")}


def test_confusion_sums_and_identity(spark):
    a = raster(spark, labels(3, (6, 6), 2), "t").withColumn("p", F.col("t"))
    c = metrics.confusion(a, "t", "p").first()
    assert c.tp + c.tn == 36 and c.fp == c.fn == 0
    m = spark.createDataFrame([(i, i, 3 + i) for i in range(4)], "truth int, pred int, cnt bigint")
    assert metrics.quadratic_kappa(m, 4).first().kappa == pytest.approx(1.0)


def test_kappa_against_its_definition(spark):
    o = np.random.default_rng(5).integers(0, 20, (5, 5))
    m = spark.createDataFrame([(i, j, int(o[i, j])) for i, j in np.ndindex(5, 5)], "truth int, pred int, cnt bigint")
    w = (np.subtract.outer(np.arange(5), np.arange(5)) / 4) ** 2
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    assert metrics.quadratic_kappa(m, 5).first().kappa == pytest.approx(1 - (w * o).sum() / (w * e).sum())


def test_classes_without_hits_score_zero_and_count(spark):
    m = spark.createDataFrame([(0, 0, 4), (1, 0, 3), (2, 2, 0)], "bin int, pos int, cnt bigint")
    got = {r.bin: (r.f1, r.support) for r in metrics.bin_scores(m).collect()}
    assert got[1] == (0.0, 3) and 2 not in got
    assert got[0][0] == pytest.approx(2 * 4 / (2 * 4 + 3))


def test_per_class_conventions(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 1)], "t int, p int")
    got = {r["class"]: r for r in metrics.per_class(df, "t", "p").collect()}
    assert got[0].precision == 1.0 and got[0].recall == 0.0 and got[0].f1 == 0.0
    assert got[1].fp == 2 and got[1].support == 1


def test_daily_merge_veto_and_fill(spark):
    rows = [(0, 0, 5), (0, 1, 7), (1, 0, -1), (1, 1, 7), (2, 0, -1), (2, 1, -1)]
    df = spark.createDataFrame(rows, "x int, prio int, value int")
    veto = {r.x: (r.value, r.dqi) for r in merging.daily_merge(df, ["x"], True).collect()}
    fill = {r.x: (r.value, r.dqi) for r in merging.daily_merge(df, ["x"], False).collect()}
    assert veto == {0: (5, 0), 1: (-1, -1), 2: (-1, -1)}
    assert fill == {0: (5, 0), 1: (7, 1), 2: (-1, -1)}


def test_composite_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0, 2), (0, 3), (1, 3), (1, 4), (2, -1)], "x int, value int")
    assert {r.x: r.value for r in merging.composite(df, ["x"]).collect()} == {0: 2, 1: 4, 2: -1}


def test_merge_is_commutative_and_bin_zero_stays_out(spark):
    a = spark.createDataFrame([(1, 0), (2, 3)], "label int, bin int")
    b = spark.createDataFrame([(1, 2), (3, 0), (4, 5)], "label int, bin int")
    ab, ba = (sorted(map(tuple, classes.merge_sets(*s).collect())) for s in ((a, b), (b, a)))
    assert ab == ba == [(1, 2), (2, 3), (3, 0), (4, 5)]
    assert sorted(map(tuple, classes.add_missing(a, b).collect())) == [(1, 0), (2, 3), (4, 4)]


@pytest.mark.parametrize("mode", classes.MODES)
def test_ordinal_modes(spark, mode):
    pairs = list(itertools.product(range(-1, 7), repeat=2))
    got = spark.createDataFrame(pairs, "a int, b int").select("a", "b", classes.ordinal_combine(F.col("a"), F.col("b"), mode).alias("v")).collect()
    f = {"or_presence": lambda a, b: int(a > 0 or b > 0), "and_presence": lambda a, b: int(a > 0 and b > 0), "max": max, "sum_capped": lambda a, b: min(a + b, 6),
         "mean": lambda a, b: int(np.rint((a + b) / 2)), "mean_ceil": lambda a, b: int(np.ceil((a + b) / 2)), "mean_floor": lambda a, b: (a + b) // 2}[mode]
    assert all(r.v == (-1 if -1 in (r.a, r.b) else f(r.a, r.b)) for r in got)


def test_background_and_later_sets(spark):
    lab = spark.createDataFrame([(1,), (2,), (9,), (None,), (-1,)], "label int")
    sets = spark.createDataFrame([(1, 0), (2, 0), (2, 1)], "cluster int, j int")
    got = [(r.label, r.context) for r in classes.context_apply(lab, sets, background=7).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 2), (9, 7), (None, -1), (-1, -1)], key=str)


def test_resample_onto_itself_is_identity(spark):
    df = raster(spark, np.arange(20.0).reshape(4, 5))
    got = grid.nearest_resize(df, 4, 5, 4, 5)
    assert (array(got, "value", (4, 5)) == np.arange(20.0).reshape(4, 5)).all()
    gt = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)
    assert grid.reproject_nearest(df, gt, gt, 4, 5, "a", "a").count() == 20
    with pytest.raises(ValueError):
        grid.reproject_nearest(df, gt, gt, 4, 5, "a", "b")


def test_radius_search_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    p = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-2, 2, 80), rng.uniform(-2, 2, 80)))]
    t = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-2, 2, 30), rng.uniform(-2, 2, 30)))]
    pts = spark.createDataFrame(p, "id int, lat double, lon double")
    tgt = spark.createDataFrame(t, "tid int, t_lat double, t_lon double")
    got = {(r.id, r.tid) for r in grid.within_radius(pts, tgt, 60).collect()}

    def km(a, b, c, d):
        a, b, c, d = map(np.radians, (a, b, c, d))
        return 2 * 6371.0088 * np.arcsin(np.sqrt(np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2))

    assert got == {(i, j) for i, a, b in p for j, c, d in t if km(a, b, c, d) <= 60}


def test_points_on_the_far_edges_fall_out(spark):
    df = spark.createDataFrame([(0.0, 1.0, 5.0), (1.0, 1.0, 6.0), (0.5, 0.0, 7.0)], "lon double, lat double, value double")
    assert [(r.y, r.x, r.value) for r in grid.swath_to_grid(df, (0, 0, 1, 1), 0.5).collect()] == [(0, 0, 5.0)]


def test_polygon_burn(spark):
    ring = [(0.5, 0.5), (3.5, 0.5), (3.5, 3.5), (0.5, 3.5)]
    poly = spark.createDataFrame([([{"x": x, "y": y} for x, y in ring], 2.0)], "ring array<struct<x:double,y:double>>, value double")
    cells = spark.createDataFrame([(y, x, float(x), float(y)) for y in range(5) for x in range(5)], "y int, x int, lon double, lat double")
    got = {(r.y, r.x) for r in grid.burn_polygons(poly, cells, 2.0).collect()}
    assert got == {(y, x) for y in range(1, 4) for x in range(1, 4)}


def test_bilinear_needs_four_quadrants(spark):
    src = spark.createDataFrame([(0.1, 0.1, 1.0), (0.1, -0.1, 2.0), (-0.1, 0.1, 3.0), (-0.1, -0.1, 4.0)], "lat double, lon double, value double")
    tgt = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.3, 0.3)], "k int, t_lat double, t_lon double")
    got = {r.k: r.value for r in grid.bilinear(src, tgt, 60, ["k"]).collect()}
    assert got[1] == pytest.approx(2.5) and got[2] is None


def test_exclusive_matching_takes_in_order(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    rows = [("p", "t1", "a", t0, 10.0), ("p", "t1", "b", t0, 20.0), ("p", "t2", "a", t0 + timedelta(seconds=5), 5.0)]
    c = spark.createDataFrame(rows, "product string, target string, path string, ts timestamp, dt double")
    assert [(r.target, r.path) for r in matchup.exclusive(c, "product", "target", "path").collect()] == [("t1", "a")]


def test_quotas_sum_and_bound(spark):
    c = spark.createDataFrame([("a", 5), ("b", 3), ("c", 1)], "stratum string, n bigint")
    q = {r.stratum: r.quota for r in sampling.quotas(c, 4).collect()}
    assert sum(q.values()) == 4 and q["a"] >= q["b"] >= q["c"]
    assert {r.stratum: r.quota for r in sampling.quotas(c, 100).collect()} == {"a": 5, "b": 3, "c": 1}


def test_last_stratum_takes_part_and_reruns_agree(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 4).alias("s"))
    a, b = (sampling.quota_sample(df, "s", ["id"], 20).orderBy("id").collect() for _ in range(2))
    assert a == b and len(a) == 20 and {r.s for r in a} == {0, 1, 2, 3}


def test_position_split_and_bootstrap(spark):
    df = spark.range(101).select("id", (F.col("id") % 7).alias("g"))
    parts = {r.part: r["count"] for r in sampling.split_by_position(df, ["id"], 0.2).groupBy("part").count().collect()}
    assert parts == {"train": 80, "val": 21}
    boot = sampling.bootstrap_groups(df, "g", 3).groupBy("member").agg(F.count_distinct("g").alias("k")).collect()
    assert len(boot) == 3 and all(r.k <= 7 for r in boot)


def test_nearest_neighbours_are_the_nearest(spark):
    x = np.random.default_rng(7).normal(size=(30, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, features array<double>")
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - n @ n.T
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(30) for j in np.argsort(d[i], kind="stable")[:4]}
    assert {(r.a, r.b) for r in learning.knn(df, "id", 4).collect()} == want


def test_pca_against_numpy(spark):
    x = np.random.default_rng(8).normal(size=(50, 4)) * [5, 2, 1, 0.1]
    df = spark.createDataFrame([(v.tolist(),) for v in x], "features array<double>")
    mean, comps = learning.pca_fit(df, 0.99)
    assert mean == pytest.approx(x.mean(0))
    w = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    k = int(np.searchsorted(np.cumsum(w) / w.sum(), 0.99) + 1)
    assert comps.shape == (4, k)
    assert np.var((x - mean) @ comps, axis=0) == pytest.approx(w[:k])


def test_uncertainties(spark):
    m = [[0.7, 0.3], [0.1, 0.9], [0.5, 0.5]]
    r = spark.createDataFrame([(m,)], "m array<array<double>>").select(S.epistemic_variance(F.col("m")).alias("v"), S.mutual_information(F.col("m")).alias("i"), S.softmax(F.array(F.lit(0.0), F.lit(1.0))).alias("s")).first()
    a = np.array(m)
    h = lambda p: -(p * np.log(p)).sum(-1)
    assert r.v == pytest.approx(a.var(0).mean()) and r.i == pytest.approx(h(a.mean(0)) - h(a).mean())
    assert r.s == pytest.approx(np.exp([0, 1]) / np.exp([0, 1]).sum())


def test_rounding_and_names(spark):
    r = spark.range(1).select(S.round_even(F.lit(2.5)).alias("a"), S.first_pattern(F.lit("x_TERRA_modis.tif"), {"viirs": ["viirs"], "modis": ["terra_modis"]}).alias("p"), S.severity(F.lit(0.0)).alias("z"), S.severity(F.lit(1e3)).alias("k"), S.lon_wrap(F.lit(190.0)).alias("w")).first()
    assert (r.a, r.p, r.z, r.k, r.w) == (2.0, "modis", 0, 2, -170.0)
