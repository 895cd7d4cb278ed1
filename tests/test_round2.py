"""GeoTIFF, polygons, samples, reports, late truth and settings against plain versions."""

import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import storage
from rasterloom.functions import settings
from rasterloom.operators import focal, grid, learning, masking, regions, reports, sampling
from rasterloom.sources import geotiff, readers, writers
from rasterloom.streaming import streams


@pytest.mark.parametrize("kind", ["uint8", "int16", "uint16", "float32", "float64", "int32"])
def test_geotiff_round_trip(kind):
    a = (np.random.default_rng(0).normal(size=(150, 37, 3)) * 90).astype(kind)
    r = geotiff.Raster(a, (10.0, 0.5, 0.0, 60.0, 0.0, -0.25), 4326, -999.0, "<GDALMetadata/>")
    back = geotiff.decode(geotiff.encode(r))
    assert (back.pixels == a).all() and back.pixels.dtype == a.dtype
    assert (back.transform, back.epsg, back.nodata, back.metadata) == (r.transform, 4326, -999.0, "<GDALMetadata/>")
    gcps = [(0.0, 0.0, 1.0, 2.0), (5.0, 6.0, 7.0, 8.0)]
    assert geotiff.decode(geotiff.encode(geotiff.Raster(a[:, :, 0], gcps=gcps))).gcps == gcps


def by_hand(order, tags, data, at):
    """A file with these tags (number, type, values) and blocks of data from ``at`` on."""
    import struct

    out = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HIH", 42, 8, len(tags))
    extra = b""
    for tag, kind, values in sorted(tags):
        b = struct.pack(f"{order}{geotiff.TYPES[kind] * len(values)}", *values)
        if len(b) > 4:
            b, extra = struct.pack(f"{order}I", 10 + 12 * len(tags) + 4 + len(extra)), extra + b
        out += struct.pack(f"{order}HHI", tag, kind, len(values)) + b.ljust(4, b"\0")
    out += b"\0\0\0\0" + extra
    assert len(out) <= at
    return out.ljust(at, b"\0") + data


def test_geotiff_tiles_planes_prediction_and_packbits():
    a = np.arange(20 * 30 * 2, dtype=">u2").reshape(20, 30, 2) % 777
    # Big-endian, planes apart, 16 x 16 tiles, deflated, predicted.
    blocks = []
    for band in range(2):
        for y in (0, 16):
            for x in (0, 16):
                t = np.zeros((16, 16), ">u2")
                own = a[y : y + 16, x : x + 16, band]
                t[: own.shape[0], : own.shape[1]] = own
                t[:, 1:] = t[:, 1:] - t[:, :-1].copy()
                blocks.append(zlib.compress(t.tobytes()))
    starts = [1000 + sum(map(len, blocks[:k])) for k in range(8)]
    tags = [(256, 3, [30]), (257, 3, [20]), (258, 3, [16, 16]), (259, 3, [8]), (277, 3, [2]), (284, 3, [2]), (317, 3, [2]), (322, 3, [16]), (323, 3, [16]), (324, 4, starts), (325, 4, [len(b) for b in blocks]), (33550, 12, [2.0, 3.0, 0.0]), (33922, 12, [1.0, 2.0, 0.0, 100.0, 200.0, 0.0])]
    r = geotiff.decode(by_hand(">", tags, b"".join(blocks), 1000))
    assert (r.pixels == a).all() and r.transform == (98.0, 2.0, 0.0, 206.0, 0.0, -3.0)
    packed = bytes([2, 1, 2, 3, 0x100 - 4, 9, 128])  # 1 2 3 and five nines
    tags = [(256, 3, [4]), (257, 3, [2]), (258, 3, [8]), (259, 3, [32773]), (273, 4, [300]), (279, 4, [len(packed)])]
    assert geotiff.decode(by_hand("<", tags, packed, 300)).pixels[:, :, 0].tolist() == [[1, 2, 3, 9], [9, 9, 9, 9]]


def test_damaged_geotiff_raises():
    good = geotiff.encode(geotiff.Raster(np.arange(900, dtype="float32").reshape(30, 30)))
    for bad in (b"", b"GIF89a..", good[:40], good[:-9], good[:4] + b"\xff\xff\xff\x7f" + good[8:]):
        with pytest.raises(geotiff.Damaged):
            geotiff.decode(bad)
    with pytest.raises(NotImplementedError):
        geotiff.decode(b"II" + (43).to_bytes(2, "little") + good[4:])


def test_geotiff_files(spark, tmp_path):
    px = spark.createDataFrame([(s, y, x, float(s * 100 + y * 10 + x), None if x == 2 else 1.5) for s in range(2) for y in range(3) for x in range(4) if (y, x) != (1, 1)], "scene int, y int, x int, a double, b double")
    meta = spark.createDataFrame([(s, 3, 4, [5.0, 1.0, 0.0, 9.0, 0.0, -1.0], 4326) for s in range(3)], "scene int, height int, width int, transform array<double>, epsg int")
    writers.files(writers.geotiffs(px, meta, ["a", "b"]), f"file://{tmp_path}/out", F.concat(F.lit("s"), F.col("scene").cast("string"), F.lit(".tif")))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["s0.tif", "s1.tif", "s2.tif"]
    got = {(r.path[-6:-4], r.y, r.x): list(r.bands) for r in readers.reader("geotiff")(spark, str(tmp_path / "out")).collect()}
    assert len(got) == 36 and got["s1", 2, 3] == [123.0, 1.5] and got["s0", 1, 1] == [-999999.0] * 2 and got["s0", 0, 2][1] == -999999.0 and got["s2", 0, 0][0] == -999999.0
    profile = readers.reader("geotiff_profile")(spark, str(tmp_path / "out")).orderBy("path").first()
    assert (profile.height, profile.width, profile.n_bands, profile.dtype, profile.transform, profile.epsg, profile.nodata) == (3, 4, 2, "float32", [5.0, 1.0, 0.0, 9.0, 0.0, -1.0], 4326, -999999.0)
    assert readers.listing(spark, str(tmp_path / "out"), "*.tif").count() == 3


def test_polygons_of_any_length_burn_and_clip(spark):
    t = np.linspace(0, 2 * np.pi, 5000, endpoint=False)
    ring = [(float(10 + 6 * np.cos(k)), float(10 + 6 * np.sin(k))) for k in t]
    p = spark.createDataFrame([(1, 5.0, ring)], "id int, value double, ring array<struct<x: double, y: double>>")
    cells = spark.createDataFrame([(y, x, float(x), float(y)) for y in range(20) for x in range(20)], "y int, x int, lon double, lat double")
    got = {(r.y, r.x) for r in grid.burn_polygons(p, cells, 3.0).collect()}
    inside = {(y, x) for y in range(20) for x in range(20) if (x - 10) ** 2 + (y - 10) ** 2 < 35.9}
    assert inside <= got <= {(y, x) for y in range(20) for x in range(20) if (x - 10) ** 2 + (y - 10) ** 2 <= 36}

    def area(r):
        return abs(sum(a.x * b.y - b.x * a.y for a, b in zip(r, r[1:] + r[:1]))) / 2

    half = grid.clipped_rings(p, 10, 0, 30, 30).first().ring
    assert area(half) == pytest.approx(np.pi * 18, rel=1e-3) and min(q.x for q in half) == 10
    assert area(grid.clipped_rings(p, 0, 0, 30, 30).first().ring) == pytest.approx(np.pi * 36, rel=1e-3)
    assert grid.clipped_rings(p, 17, 0, 30, 30).count() == 0 and area(grid.clipped_rings(p, 9, 9, 11, 11).first().ring) == pytest.approx(4)


def test_unlabelled_centres_stay(spark):
    rows = [(0, y, x, None if (y, x) == (1, 1) else 7 if x < 2 else 3) for y in range(3) for x in range(3)] + [(1, 0, 0, None)]
    out = {(r.scene, r.y, r.x): r for r in focal.class_stats(spark.createDataFrame(rows, "scene int, y int, x int, label int"), 1).collect()}
    assert len(out) == 10
    assert (out[0, 1, 1].label, out[0, 1, 1].frac_same, out[0, 1, 1].n_valid, out[0, 1, 1].n_distinct) == (None, 0.0, 8, 3)
    assert (out[1, 0, 0].n_valid, out[1, 0, 0].n_distinct, out[1, 0, 0].entropy) == (0, 0, None)


def test_interval_join_with_long_intervals(spark, tmp_path):
    t = datetime(2024, 1, 1)
    spark.createDataFrame([("a", t + timedelta(hours=40), 1), ("a", t + timedelta(hours=80), 2), ("b", t, 3)], "k string, ts timestamp, v int").coalesce(1).write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([("a", t, t + timedelta(hours=72))], "i_k string, i_start timestamp, i_end timestamp").coalesce(1).write.parquet(str(tmp_path / "i"))
    read = lambda n, s: streams.source(spark, str(tmp_path / n), s)
    args = lambda: (read("p", "k string, ts timestamp, v int"), read("i", "i_k string, i_start timestamp, i_end timestamp"), "k")
    got = streams.drain(streams.interval_join(*args(), longest="3 days"), "held").collect()
    assert [r.v for r in got] == [1]
    with pytest.raises(Exception, match="longer than 1 day"):
        streams.drain(streams.interval_join(*args(), longest="1 day"), "rejected")


def test_reports_and_members(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(i % 2), float(rng.normal() + (i % 2) * 2), float(rng.normal())) for i in range(300)]
    d = learning.balanced_weights(spark.createDataFrame(rows, "id int, label double, a double, b double"))
    done = learning.cross_validated(sampling.folds(d, "id", 3), lambda: learning.classifiers(["a", "b"])["logistic"], 3)
    assert done.count() == 300
    got = {r.label: r for r in learning.class_report(done).collect()}
    pairs = [(r.label, r.prediction) for r in done.collect()]
    for c in (0.0, 1.0):
        tp = sum(p == q == c for p, q in pairs)
        assert got[c].precision == pytest.approx(tp / sum(q == c for _, q in pairs)) and got[c].recall == pytest.approx(tp / got[c].support) and got[c].f1 > 0.7
    model = learning.classifiers(["a", "b"], trees=4)["forest"].fit(d)
    m = learning.member_probabilities(model, d, "id")
    assert m.count() == 1200 and m.where("probability between 0 and 1").count() == 1200
    own = {r.id: r.p for r in m.groupBy("id").agg(F.avg("probability").alias("p")).collect()}
    from pyspark.ml.functions import vector_to_array

    for r in model.transform(d).select("id", vector_to_array("probability")[1].alias("p")).collect():
        assert own[r.id] == pytest.approx(r.p)


def test_balanced_and_kmeans_samples(spark):
    d = spark.createDataFrame([(i, "a" if i < 5 else "b" if i < 50 else "c" if i < 400 else None) for i in range(1000)], "id int, g string")
    got = sampling.balanced_sample(d, "g", ["id"], 203)
    n = {r.g: r["count"] for r in got.groupBy("g").count().collect()}
    assert sum(n.values()) == 203 and n["a"] == 5 and n["b"] >= 45 and got.select("id").distinct().count() == 203
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sampling.balanced_sample(d.repartition(5), "g", ["id"], 203).collect()))
    assert sampling.balanced_sample(d, "g", ["id"], 5000).count() == 1000
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=3) + (i % 4) * 30]) for i in range(400)], "id int, v array<double>")
    out = sampling.kmeans_sample(v, "v", ["id"], 4, 40)
    assert out.count() == 40 and {r["count"] for r in out.groupBy("stratum").count().collect()} <= {10, 20, 30, 40, 5, 15}


def test_operators_without_a_query(spark):
    gt = F.array(*map(F.lit, (1.0, 2.0, 0.0, 5.0, 0.0, -4.0)))
    assert spark.range(1).select(grid.scaled_transform(gt, 10, 5, 20, 5).alias("t")).first().t == [1.0, 1.0, 0.0, 5.0, 0.0, -1.0]
    one = spark.createDataFrame([(1e-12,), (0.5,)], "v double").select(masking.small_fill(F.col("v")).alias("v")).collect()
    assert [r.v for r in one] == [-9999.0, 0.5]
    p = reports.bootstrap_p(spark.createDataFrame([(1, 0.5), (2, 9.0)], "node int, s double"), spark.createDataFrame([(k, i / 10) for k in (1, 2) for i in range(10)], "node int, s double"), "node", "s")
    assert {r.node: r.p for r in p.collect()} == {1: 0.4, 2: 0.0}
    km = regions.centroid_distances(spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 1.0, 0.0)], "id int, lat double, lon double")).collect()
    assert {(r.a, r.b) for r in km} == {(1, 2), (1, 3), (2, 3)} and all(110 < r.km < 160 for r in km)
    scene = spark.createDataFrame([(0, 0, 0, 2.0), (0, 0, 1, None), (0, 1, 0, 4.0)], "scene int, y int, x int, value double")
    geo = spark.createDataFrame([(0, 0, 0, 10.0, 20.0)], "scene int, y int, x int, lat double, lon double")
    assert sorted((r.y, r.x, r.value, r.lat) for r in readers.scenes_with_geo(scene, geo).collect() if r.lat or r.x) == [(0, 0, 2.0, 10.0), (0, 1, 3.0, None)]
    assert {r.value for r in readers.scenes_with_geo(scene, geo, "constant", -1.0).collect()} == {2.0, -1.0, 4.0}


def test_settings():
    s = {"a": {"b": 1}, "c": 2}
    assert settings.with_value(s, ["a", "d", "e"], 5) == {"a": {"b": 1, "d": {"e": 5}}, "c": 2} and s == {"a": {"b": 1}, "c": 2}
    assert settings.merged(s, {"a": {"b": 7}, "c": {"x": 1}}) == {"a": {"b": 7}, "c": {"x": 1}}
    assert settings.valued(s, "a.b") == 1 and settings.valued(s, "a.b.c") is None


def test_tables_need_a_shared_folder_on_a_cluster(spark):
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="share"):
        storage.shared_dir(Cluster)
