"""Rasters, series and catalogs seen in the driver's tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows."""
    def put(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"a query named {f.__name__} is there already")
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scenes of 50 x 50 pixels."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    inside = F.pmod(k, F.lit(2500))
    return o.select(
        F.floor(k / 2500).cast("bigint").alias("scene"), F.floor(inside / 50).cast("int").alias("y"), F.pmod(k, F.lit(50)).cast("int").alias("x"),
        F.col("o_totalprice").alias("value"), F.pmod("o_custkey", F.lit(12)).cast("int").alias("label"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("truth"),
        F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("id"))


PX = """px as (select o_orderkey // 2500 as scene, ((o_orderkey % 2500) // 50)::int as y, (o_orderkey % 50)::int as x, o_totalprice as value, (o_custkey % 12)::int as label,
  case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as truth, o_orderdate::date as day, o_orderkey as id from orders)"""


def px2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as one scene with two severities from -1 to 5."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(F.lit(0).cast("bigint").alias("scene"), F.floor(k / 50).cast("int").alias("y"), F.pmod(k, F.lit(50)).cast("int").alias("x"),
                    (F.pmod("p_size", F.lit(7)) - 1).cast("int").alias("sev"), (F.pmod(F.floor("p_retailprice").cast("bigint"), F.lit(7)) - 1).cast("int").alias("sev2"))


PX2 = """px2 as (select 0::bigint as scene, (p_partkey // 50)::int as y, (p_partkey % 50)::int as x, (p_size % 7 - 1)::int as sev, (floor(p_retailprice)::bigint % 7 - 1)::int as sev2 from part)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a series for each user."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("trial"), (F.row_number().over(w) - 1).cast("int").alias("t"), F.col("value"), "ts", "event_id", "event_type")


TS = """ts as (select user_id as trial, (row_number() over (partition by user_id order by ts, event_id) - 1)::int as t, value, ts, event_id, event_type from events)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a catalog of files: product, time, path, and the user as what files share."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("product"), "ts", F.concat(F.lit("f"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("path"), "user_id", "event_id", F.to_date("ts").alias("day"), F.col("value"))


CAT = """cat as (select event_type as product, ts, 'f' || lpad(event_id::varchar, 8, '0') as path, user_id, event_id, ts::date as day, value from events)"""


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.alias("station"), (30 + F.pmod(k, F.lit(10)) * 0.5).alias("s_lat"), (-120 + F.floor(k / 10) * 0.5).alias("s_lon"))


STATIONS = """st as (select s_suppkey as station, 30 + (s_suppkey % 10) * 0.5::double as s_lat, -120 + (s_suppkey // 10) * 0.5::double as s_lon from supplier)"""


def geo_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with the coordinates of a tenth of a degree a line and sample."""
    return px(spark, sf_dir).withColumns({"lat": 35.0 - F.col("y") * 0.1, "lon": -120.0 + F.col("x") * 0.1})


GEO = PX + """, gp as (select *, 35.0::double - y * 0.1::double as lat, -120.0::double + x * 0.1::double as lon from px)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four positive numbers of each vector, scaled to probabilities."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 4).alias("e"))
    a = F.transform("e", lambda v: F.abs(v.cast("double")) + 0.01)
    return e.select("vec_id", a.alias("a")).select("vec_id", F.transform("a", lambda v: v / F.aggregate("a", F.lit(0.0), lambda s, w: s + w)).alias("p"))


PROBS = """pr0 as (select vec_id, list_transform(embedding[1:4], lambda v: abs(v::double) + 0.01::double) as a from embeddings),
 pr as (select vec_id, list_transform(a, lambda v: v / (a[1] + a[2] + a[3] + a[4])) as p from pr0)"""
