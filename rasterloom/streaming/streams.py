"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A stream over the files of a Parquet folder, some files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now, into a memory table of that name."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def daily_product(stream: DataFrame, by: Sequence[str], path: str, checkpoint: str):
    """Fills a product further, batch by batch: for each key the valid value of the best priority so far. Each batch writes
    a new version of the table, named by its id, so a repeated batch writes the same version again."""
    from ..operators.merging import incremental

    def upsert(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.select(*by, "prio", "value")
        old = spark.createDataFrame([], new.schema) if epoch == 0 else spark.read.schema(new.schema).parquet(f"{path}/v{epoch - 1}")
        incremental(old, new, by).write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def assembled(stream: DataFrame, by: str, member: str, n: int, delay: str = "1 hour") -> DataFrame:
    """Start times whose scene has all n channels, once the watermark has passed them; incomplete ones are never given out."""
    w = stream.withWatermark(by, delay).groupBy(by).agg(F.size(F.collect_set(member)).alias("n"))
    return w.where(F.col("n") == n).select(by, "n")


def interval_join(points: DataFrame, intervals: DataFrame, by: str, longest: str, delay: str = "1 hour", tolerance: str = "0 seconds") -> DataFrame:
    """Points (ts) with the intervals (i_start, i_end) that hold them, up to the tolerance; late truth is waited for.

    longest: what an interval may last. It bounds the points that are kept in state; a longer interval stops the stream.
    """
    p = points.withWatermark("ts", delay).alias("p")
    too_long = F.col("i_end") > F.col("i_start") + F.expr(f"INTERVAL {longest}")
    checked = intervals.withColumn("i_end", F.when(too_long, F.raise_error(F.lit(f"an interval is longer than {longest}")).cast("timestamp")).otherwise(F.col("i_end")))
    i = checked.withWatermark("i_start", delay).alias("i")
    on = F.expr(f"p.{by} = i.i_{by} AND p.ts >= i.i_start - INTERVAL {tolerance} AND p.ts <= i.i_end + INTERVAL {tolerance} AND p.ts <= i.i_start + INTERVAL {longest} + INTERVAL {tolerance}")
    return p.join(i, on)


def tumbling(stream: DataFrame, ts: str, width: str, by: Sequence[str], value: str, delay: str = "10 minutes") -> DataFrame:
    """Count and sum by time rounded down to the width."""
    g = stream.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(stream: DataFrame, ts: str, gap: str, by: Sequence[str], delay: str = "10 minutes") -> DataFrame:
    g = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sequences(stream: DataFrame, trial: str, t: str, value: str, length: int) -> DataFrame:
    """Step-1 sequences as they complete: the state of a trial is its last length - 1 values. Rows of a batch are put in
    order; a stream must bring a trial's batches in order."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        f = pd.concat(list(frames)).sort_values(t)
        out = []
        for at, v in zip(f[t], f[value]):
            held.append(float(v))
            if len(held) == length:
                out.append((key[0], at, list(held)))
                held = held[1:]
        state.update((held,))
        yield pd.DataFrame(out, columns=[trial, t, "seq"])

    kinds = f"{trial} bigint, {t} {stream.schema[t].dataType.simpleString()}, seq array<double>"
    return stream.groupBy(trial).applyInPandasWithState(step, kinds, "held array<double>", "append", GroupStateTimeout.NoTimeout)
