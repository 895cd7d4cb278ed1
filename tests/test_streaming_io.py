import numpy as np
from pyspark.sql import functions as F

from rasterloom.operators import merging, sequences
from rasterloom.sources import readers, writers
from rasterloom.streaming import streams


def test_incremental_product_equals_batch(spark, tmp_path):
    rows = [(d, x, p, (d * 7 + x * 3 + p) % 5 - 1) for d in range(3) for x in range(6) for p in range(3)]
    src = tmp_path / "in"
    for i in range(4):
        spark.createDataFrame(rows[i::4], "day int, x int, prio int, value int").coalesce(1).write.mode("append").parquet(str(src))
    s = streams.source(spark, str(src), "day int, x int, prio int, value int")
    streams.daily_product(s, ["day", "x"], str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    last = max(tmp_path.glob("out/v*"), key=lambda p: int(p.name[1:]))
    got = {tuple(r) for r in spark.read.parquet(str(last)).select("day", "x", "prio", "value").collect()}
    batch = spark.createDataFrame(rows, "day int, x int, prio int, value int")
    want = {tuple(r) for r in merging.incremental(batch.limit(0), batch, ["day", "x"]).select("day", "x", "prio", "value").collect()}
    assert got == want


def test_tumbling_and_sessions_equal_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    e.repartition(3).write.parquet(str(tmp_path / "e"))
    s = streams.source(spark, str(tmp_path / "e"), e.schema, files=10)
    got = streams.drain(streams.tumbling(s, "ts", "1 hour", ["event_type"], "value"), "tumbling", "complete")
    want = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert {(r.start, r.event_type, r.n) for r in got.collect()} == {(r.w.start, r.event_type, r.n) for r in want.collect()}
    s = streams.source(spark, str(tmp_path / "e"), e.schema, files=10)
    ses = streams.drain(streams.sessions(s, "ts", "2 hours", ["user_id"]), "sess", "complete")
    assert ses.agg(F.sum("n")).first()[0] == e.count()


def test_scene_assembly(spark, tmp_path):
    from datetime import datetime, timedelta

    t = datetime(2024, 1, 1)
    rows = [(t, c) for c in range(4)] + [(t + timedelta(hours=1), c) for c in range(3)] + [(t + timedelta(days=2), 0)]
    spark.createDataFrame(rows, "ts timestamp, ch int").coalesce(1).write.parquet(str(tmp_path / "s"))
    s = streams.source(spark, str(tmp_path / "s"), "ts timestamp, ch int")
    got = streams.drain(streams.assembled(s, "ts", "ch", 4), "scenes").collect()
    assert [(r.ts, r.n) for r in got] == [(t, 4)]


def test_stream_sequences_equal_batch(spark, tmp_path):
    rows = [(k, t, float(k * 10 + t)) for k in range(3) for t in range(5)]
    df = spark.createDataFrame(rows, "trial bigint, t int, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "q"))
    s = streams.source(spark, str(tmp_path / "q"), df.schema)
    got = streams.drain(streams.sequences(s, "trial", "t", "value", 3), "seqs")
    assert {(r.trial, r.t, tuple(r.seq)) for r in got.collect()} == {(r.trial, r.t, tuple(r.seq)) for r in sequences.causal(df, 3).collect()}


def test_numpy_round_trip_and_registry(spark, tmp_path):
    a = np.random.default_rng(0).normal(size=(5, 4, 2)).astype("float32")
    np.save(tmp_path / "s.npy", a)
    got = readers.reader("numpy")(spark, str(tmp_path)).collect()
    back = np.zeros_like(a)
    for r in got:
        back[r.y, r.x] = r.bands
    assert (back == a).all()


def test_preprocessed_samples(spark, tmp_path):
    x, i = np.arange(6, dtype="float32").reshape(3, 2), np.array([[0, 1, 2], [0, 3, 4], [1, 5, 6]], "int16")
    np.save(tmp_path / "train_data.npy", x)
    np.save(tmp_path / "train_data.indices.npy", i)
    got = sorted((r.scene, r.y, r.x, r.features) for r in readers.reader("preprocessed")(spark, str(tmp_path)).collect())
    assert got == [(0, 1, 2, [0.0, 1.0]), (0, 3, 4, [2.0, 3.0]), (1, 5, 6, [4.0, 5.0])]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 0, [1.0, 2.0]), (0, 0, 1, [3.0, 4.0])], "scene bigint, y int, x int, bands array<double>")
    writers.bands(df, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).where("band = 1").count() == 2
    meta = spark.createDataFrame([(0, 2, 2)], "scene bigint, height int, width int")
    writers.stack(df.select("scene", "y", "x", F.col("bands")[0].alias("v")), meta, ["v"], str(tmp_path / "s"))
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [-9999.0, -9999.0, 1.0, 3.0]
    writers.report(meta, str(tmp_path / "c"))
    assert readers.reader("csv")(spark, str(tmp_path / "c")).first().height == "2"
    writers.raster(df, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2
