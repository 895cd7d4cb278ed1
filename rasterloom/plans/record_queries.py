"""Queries over series, catalogs, class sets, vectors and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import classes, learning, masking, matchup, merging, sampling, sequences
from ..sources import readers
from .views import CAT, PROBS, PX, PX2, QUERIES, TS, catalog, probs, px, px2, query, series, table, vectors

KEYS = ["scene", "y", "x"]


# series and matchups

@query(f"with {TS}, w as (select trial, t, value, list(value) over (partition by trial order by t rows between 4 preceding and current row) as l from ts) select trial, t, round(list_sum(l), 4) as total, l[1] as first, l[5] as last from w where len(l) = 5")
def causal_sequences(spark, d):
    s = sequences.causal(series(spark, d), 5)
    return s.select("trial", "t", F.round(F.aggregate("seq", F.lit(0.0), lambda a, v: a + v), 4).alias("total"), F.col("seq")[0].alias("first"), F.col("seq")[4].alias("last"))


ASOF = CAT + """, tg as (select event_id as target, user_id, ts from cat where product = 'purchase'), ot as (select user_id, ts as o_ts, path, product from cat where product in ('view', 'click')),
 c as (select target, path, product, (epoch_us(o_ts) - epoch_us(ts)) / 1e6 as dt from tg join ot using (user_id) where abs(epoch_us(o_ts) - epoch_us(ts)) <= 604800000000::bigint)"""


def _targets(spark, d):
    c = catalog(spark, d)
    t = c.where("product = 'purchase'").select(F.col("event_id").alias("target"), "user_id", "ts")
    return t, lambda p: c.where(F.col("product") == p).select("user_id", F.col("ts").alias("o_ts"), "path")


@query(f"with {ASOF}, r as (select *, row_number() over (partition by target order by abs(dt), path) as k from c where product = 'view') select target, path, dt from r where k = 1")
def asof_nearest(spark, d):
    t, others = _targets(spark, d)
    return matchup.asof_nearest(t, others("view"), ["user_id"], 7 * 86400, ["target"], "path")


@query(f"with {ASOF}, p as (select *, case product when 'view' then 0 else 1 end as priority from c where product = 'view' or abs(dt) <= 86400), r as (select *, row_number() over (partition by target order by abs(dt), priority, path) as k from p) select target, priority, path, dt from r where k = 1")
def asof_families(spark, d):
    t, others = _targets(spark, d)
    return matchup.asof_families(t, [(others("view"), 0, 7 * 86400), (others("click"), 1, 86400)], ["user_id"], ["target"], "path")


def asof_exclusive(spark, d):
    t, others = _targets(spark, d)
    c = matchup.candidates(t, others("view"), ["user_id"], 7 * 86400)
    return matchup.exclusive(matchup.gap_islands(c, "user_id", 7 * 86400).withColumn("user", F.concat_ws(":", "user_id", "island")), "user", "target", "path").drop("user")


INTERVALS = CAT + """, iv as (select user_id, path, case when event_id % 7 <> 0 then ts end as s0, case when event_id % 7 <> 0 then ts + interval 1 second * (600 + event_id % 3600) end as e0, day from cat where product = 'view'),
 i as (select user_id, path, coalesce(s0, day::timestamp) as s, coalesce(e0, coalesce(s0, day::timestamp) + interval 86400 second) as e from iv),
 c as (select event_id as target, i.path, greatest((epoch_us(s) - epoch_us(ts)) / 1e6, (epoch_us(ts) - epoch_us(e)) / 1e6, 0) as away, abs(epoch_us(ts) - (epoch_us(s) + epoch_us(e)) / 2) / 1e6 as mid, (epoch_us(e) - epoch_us(s)) / 1e6 as duration
   from (select * from cat where product = 'purchase') p join i using (user_id)),
 r as (select *, row_number() over (partition by target order by away, mid, duration, path) as k from c where away <= 259200)"""


def _intervals(spark, d):
    c = catalog(spark, d)
    has = F.col("event_id") % 7 != 0
    start = F.when(has, F.col("ts"))
    end = F.when(has, F.timestamp_micros(S.micros(F.col("ts")) + (600 + F.col("event_id") % 3600) * 1000000))
    iv = c.where("product = 'view'").select("user_id", "path", start.alias("start"), end.alias("end"), "day")
    return c.where("product = 'purchase'").select(F.col("event_id").alias("target"), "user_id", "ts"), iv


@query(f"with {INTERVALS} select target, path, case when away = 0 then 'contained' else 'nearest' end as method, round(away, 3) as away from r where k = 1")
def interval_match(spark, d):
    p, iv = _intervals(spark, d)
    return matchup.interval_match(p, iv, ["target"], ["user_id"], "path", 259200).withColumn("away", F.round("away", 3))


@query(f"with {INTERVALS} select p.event_id as target, case when p.event_id % 11 = 0 then 'skipped_invalid' when r.target is not null then 'matched' else 'no_interval_match' end as status from (select * from cat where product = 'purchase') p left join (select * from r where k = 1) r on r.target = p.event_id")
def match_audit(spark, d):
    p, iv = _intervals(spark, d)
    m = matchup.interval_match(p, iv, ["target"], ["user_id"], "path", 259200)
    return matchup.audit(p, m, ["target"], F.col("target") % 11 != 0).select("target", "status")


@query("select a.l_shipdate::date::varchar as name, a.l_linestatus as size, a.l_returnflag as a, b.l_returnflag as b from (select distinct l_shipdate, l_linestatus, l_returnflag from lineitem) a join (select distinct l_shipdate, l_linestatus, l_returnflag from lineitem) b using (l_shipdate, l_linestatus) where a.l_returnflag < b.l_returnflag")
def sensor_pairs(spark, d):
    f = table(spark, d, "lineitem").select(F.to_date("l_shipdate").cast("string").alias("name"), F.col("l_linestatus").alias("size"), F.col("l_returnflag").alias("sensor")).distinct()
    return matchup.name_pairs(f, "sensor", ["name", "size"])


@query(f"with {PX} select id, coalesce(a, -1.0) as a, coalesce(b, -1.0) as b, coalesce(c, -1.0) as c from (select id, value as a from px where label < 4) full join (select id, value + 1 as b from px where label between 3 and 6) using (id) full join (select id, value + 2 as c from px where label > 8) using (id)")
def full_outer_merge(spark, d):
    p = px(spark, d)
    a = p.where("label < 4").select("id", F.col("value").alias("a"))
    b = p.where("label between 3 and 6").select("id", (F.col("value") + 1).alias("b"))
    c = p.where("label > 8").select("id", (F.col("value") + 2).alias("c"))
    return matchup.outer_merge([a, b, c], "id", -1.0)


@query("select d::date::varchar as day from generate_series(timestamp '1995-01-01', timestamp '1996-12-31', interval 1 day) g(d) where d::date not in (select l_shipdate::date from lineitem where l_returnflag = 'R' and l_quantity > 45)")
def missing_dates(spark, d):
    f = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.to_date("l_shipdate").alias("d"))
    return matchup.missing_days(f, "d", "1995-01-01", "1996-12-31").select(F.col("day").cast("string").alias("day"))


@query("select user_id, n from (select user_id, count(distinct event_type) as n, max(k) as k from events, (select count(distinct event_type) as k from events) group by user_id) where n = k")
def channel_complete(spark, d):
    e = table(spark, d, "events")
    k = e.select("event_type").distinct().count()
    return matchup.complete_groups(e, ["user_id"], "event_type", k).select("user_id", "n")


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) = 2")
def seen_exactly(spark, d):
    return matchup.exactly(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], 2)


# names and times

NAMES = """nm as (select event_id, case event_id % 4 when 0 then 'AQUA_MODIS.' || strftime(ts, '%Y%m%d') || '.L3m.DAY.tif' when 1 then 'viirs_' || strftime(ts, '%Y%m%dT%H%M%S') || '.nc' when 2 then 'S3A_' || strftime(ts, '%Y%j') || '_cf.tif' else 'unknown.tif' end as name, ts from events)"""


def _names(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id") % 4
    name = (
        F.when(k == 0, F.concat(F.lit("AQUA_MODIS."), F.date_format("ts", "yyyyMMdd"), F.lit(".L3m.DAY.tif")))
        .when(k == 1, F.concat(F.lit("viirs_"), F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.lit(".nc")))
        .when(k == 2, F.concat(F.lit("S3A_"), F.date_format("ts", "yyyyDDD"), F.lit("_cf.tif")))
        .otherwise(F.lit("unknown.tif"))
    )
    return e.select("event_id", name.alias("name"))


PRODUCTS = {"modis": ["aqua_modis", "terra_modis"], "viirs": ["viirs", "jpss"], "olci": ["s3[ab]"]}


@query(f"with {NAMES} select event_id, case event_id % 4 when 0 then 'modis' when 1 then 'viirs' when 2 then 'olci' end as product, case event_id % 4 when 0 then ts::date + interval 12 hour when 1 then date_trunc('second', ts) when 2 then ts::date + interval 12 hour end::timestamp::varchar as at from nm")
def name_parse(spark, d):
    return _names(spark, d).select("event_id", S.first_pattern(F.col("name"), PRODUCTS).alias("product"), F.date_format(S.name_time(F.col("name")), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(f"with {NAMES} select event_id, name, case event_id % 4 when 0 then 'modis' when 1 then 'viirs' else 'olci' end as product, ts::date::varchar as day from nm where event_id % 4 < 3 and ts::date between date '2024-01-05' and date '2024-01-20'")
def file_catalog(spark, d):
    return readers.catalog(_names(spark, d), PRODUCTS, "2024-01-05", "2024-01-20", name="name").select("event_id", "name", "product", F.col("day").cast("string").alias("day"))


@query("select event_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as h, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as d, strftime(time_bucket(interval 10 minute, ts), '%Y-%m-%d %H:%M:%S') as m from events")
def time_round(spark, d):
    r = lambda k: F.date_format(S.round_time(F.col("ts"), k), "yyyy-MM-dd HH:mm:ss")
    return table(spark, d, "events").select("event_id", r("hour").alias("h"), r("day").alias("d"), r("10min").alias("m"))


@query("with i as (select event_type, date_trunc('hour', ts) as s, date_trunc('hour', ts + interval 1 second * (event_id % 7200)) as e from events) select event_type, strftime(s, '%Y-%m-%d %H') as s, strftime(e, '%Y-%m-%d %H') as e, count(*) as n from i group by all")
def interval_groups(spark, d):
    end = F.timestamp_micros(S.micros(F.col("ts")) + F.col("event_id") % 7200 * 1000000)
    e = table(spark, d, "events").select("event_type", F.date_format(S.round_time(F.col("ts"), "hour"), "yyyy-MM-dd HH").alias("s"), F.date_format(S.round_time(end, "hour"), "yyyy-MM-dd HH").alias("e"))
    return e.groupBy("event_type", "s", "e").agg(F.count(F.lit(1)).alias("n"))


@query("select event_id, event_type || '_' || strftime(ts, '%Y%m%dT%H%M%S') as scene, strftime(ts, '%Y%m%d') as day from events")
def pair_ids(spark, d):
    return table(spark, d, "events").select("event_id", S.pair_id("scene", F.col("event_type"), F.col("ts")).alias("scene"), S.pair_id("day", F.col("event_type"), F.col("ts")).alias("day"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as a, strftime(o_orderdate, '%Y-%m-%d') as b, null::varchar as bad from orders")
def canonical_dates(spark, d):
    o = table(spark, d, "orders")
    c = lambda f: S.canonical_date(F.date_format("o_orderdate", f))
    return o.select("o_orderkey", c("yyyyMMdd").alias("a"), c("MM/dd/yyyy").alias("b"), S.canonical_date(F.col("o_orderpriority")).alias("bad"))


@query("select o_orderpriority, case lower(trim(o_orderpriority)) when 'light' then 1 when 'medium' then 2 when 'heavy' then 3 else 1 end as density, greatest(coalesce(try_cast(regexp_extract(o_orderpriority, '^\\d+') as double), 1), 1) as num, count(*) as n from orders group by all")
def coerced_values(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", S.density_level(F.col("o_orderpriority")).alias("density"), S.floor_one(F.regexp_extract("o_orderpriority", r"^\d+", 0)).alias("num"))
    return o.groupBy("o_orderpriority", "density", "num").agg(F.count(F.lit(1)).alias("n"))


@query("select event_id, props->>'k' as k from events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


# merges and class sets

STREAMS = PX2 + ", s as (select y, x, 0 as prio, sev as value from px2 union all select y, x, 1, sev2 from px2 union all select y, x, 2, case when (y + x) % 9 = 0 then -1 else 3 end from px2)"


def _streams(spark, d):
    p = px2(spark, d)
    third = F.when((F.col("y") + F.col("x")) % 9 == 0, -1).otherwise(3)
    cols = [(0, F.col("sev")), (1, F.col("sev2")), (2, third)]
    return p.select("y", "x", F.explode(F.array(*(F.struct(F.lit(k).alias("prio"), c.alias("value")) for k, c in cols))).alias("e")).select("y", "x", "e.prio", "e.value")


_BEST = "b as (select y, x, arg_min(value, prio) filter (value >= 0) as v, min(prio) filter (value >= 0) as k, bool_or(value = -1) as bad from s group by y, x)"


@query(f"with {STREAMS}, {_BEST} select y, x, case when v is not null and not bad then v else -1 end as value, case when v is not null and not bad then k else -1 end as dqi from b")
def daily_merge_veto(spark, d):
    return merging.daily_merge(_streams(spark, d), ["y", "x"], veto=True)


@query(f"with {STREAMS}, {_BEST} select y, x, coalesce(v, -1) as value, coalesce(k, -1) as dqi from b")
def daily_merge_fill(spark, d):
    return merging.daily_merge(_streams(spark, d), ["y", "x"], veto=False)


@query(f"with {PX} select year(day)::int as yr, month(day)::int as mon, y, coalesce(round_even(avg(case when label <> 0 then label end), 0), -1)::int as value, count(case when label <> 0 then label end) as days from px group by 1, 2, 3")
def monthly_composite(spark, d):
    p = px(spark, d).select(F.year("day").alias("yr"), F.month("day").alias("mon"), "y", F.when(F.col("label") != 0, F.col("label")).otherwise(-1).alias("value"))
    return merging.composite(p, ["yr", "mon", "y"])


@query(f"with {PX} select y, x, max(label) as v_max, sum(label)::bigint as v_sum, count_if(label > 0)::bigint as v_count, round(avg(nullif(label, 0)), 6) as v_mean from px group by y, x")
def slice_combine(spark, d):
    return merging.slice_combine(px(spark, d), ["y", "x"], "label").withColumn("v_mean", F.round("v_mean", 6))


ORDINAL = {
    "or_presence": "(sev > 0 or sev2 > 0)::int",
    "and_presence": "(sev > 0 and sev2 > 0)::int",
    "max": "greatest(sev, sev2)",
    "sum_capped": "least(sev + sev2, 6)",
    "mean": "round_even((sev + sev2) / 2, 0)::int",
    "mean_ceil": "ceil((sev + sev2) / 2)::int",
    "mean_floor": "floor((sev + sev2) / 2)::int",
}


def _ordinal(mode: str):
    def run(spark, d):
        return px2(spark, d).select("y", "x", classes.ordinal_combine(F.col("sev"), F.col("sev2"), mode).alias("value"))

    run.__name__ = f"ordinal_combine_{mode}"
    query(f"with {PX2} select y, x, case when sev = -1 or sev2 = -1 then -1 else {ORDINAL[mode]} end::int as value from px2")(run)


for _mode in classes.MODES:
    _ordinal(_mode)

SETS = "a as (select distinct l_suppkey % 40 as label, l_linenumber as bin from lineitem where l_returnflag = 'A'), b as (select distinct l_suppkey % 60 as label, l_linenumber - 2 as bin from lineitem where l_returnflag = 'R')"


def _sets(spark, d):
    li = table(spark, d, "lineitem")
    a = li.where("l_returnflag = 'A'").select((F.col("l_suppkey") % 40).alias("label"), F.col("l_linenumber").alias("bin")).distinct()
    return a, li.where("l_returnflag = 'R'").select((F.col("l_suppkey") % 60).alias("label"), (F.col("l_linenumber") - 2).alias("bin")).distinct()


@query(f"with {SETS} select label, max(bin) as bin from (select * from a union all select * from b) group by label")
def merge_max_bin(spark, d):
    return classes.merge_sets(*_sets(spark, d))


@query(f"with {SETS} select label, bin from a union all select label, bin - 1 from b where bin > 0 and label not in (select label from a)")
def absent_labels(spark, d):
    return classes.add_missing(*_sets(spark, d))


@query("select label, n, sum(n) over (order by label)::bigint as upto from (select l_suppkey % 13 as label, count(*) as n from lineitem group by 1)")
def label_cdf(spark, d):
    from pyspark.sql import Window

    n = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 13).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("upto", F.sum("n").over(Window.orderBy("label")))  # 13 rows


@query("with b as (select case when l_quantity < 0 then null else (l_quantity > 0)::int + (l_quantity >= 10)::int + (l_quantity >= 20)::int + (l_quantity >= 45)::int end as level from lineitem) select k::int as level, count(level) as n from range(0, 6) r(k) left join b on level = k group by k")
def insitu_bins(spark, d):
    n = table(spark, d, "lineitem").select(S.severity(F.col("l_quantity"), (0.0, 10.0, 20.0, 45.0)).alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    bins = spark.range(6).select(F.col("id").cast("int").alias("level"))
    return bins.join(n, "level", "left").select("level", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


@query("select c_nationkey, c_mktsegment, sum(round(c_acctbal * 100)::bigint)::double / count(*) as mean_cents from customer where c_acctbal <= 5000 group by all")
def insitu_means(spark, d):
    c = table(spark, d, "customer").where(masking.depth_filter(F.col("c_acctbal"), 5000))
    return c.groupBy("c_nationkey", "c_mktsegment").agg((F.sum(F.round(F.col("c_acctbal") * 100).cast("bigint")) / F.count(F.lit(1))).alias("mean_cents"))


# functions

@query("select c_custkey, (c_custkey // 8)::int as parent, (c_custkey % 8)::int as child, c_custkey::int as id, round(((((c_acctbal + 180) % 360) + 360) % 360) - 180, 6) as lon from customer")
def heir_encode(spark, d):
    p, c = S.split_id(F.col("c_custkey"), 8)
    t = table(spark, d, "customer").select("c_custkey", "c_acctbal", p.alias("parent"), c.cast("int").alias("child"))
    return t.select("c_custkey", "parent", "child", S.child_id(F.col("parent"), F.col("child"), 8).cast("int").alias("id"), F.round(S.lon_wrap(F.col("c_acctbal")), 6).alias("lon"))


@query("select c_custkey, round_even(c_acctbal, 0) as r0, ceil(c_acctbal)::int as up, round(sqrt(c_acctbal * c_acctbal + 9), 6) as amp, round(atan2(3.0, c_acctbal), 6) as phase, ceil((c_acctbal + 1000) / 0.5)::int as cells, round(c_acctbal / nullif(c_custkey % 3, 0), 6) as ratio from customer")
def scalar_math(spark, d):
    a = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", S.round_even(a).alias("r0"), F.ceil(a).cast("int").alias("up"), F.round(S.amplitude(a, F.lit(3.0)), 6).alias("amp"), F.round(S.phase(a, F.lit(3.0)), 6).alias("phase"),
                                              S.grid_size(F.lit(-1000.0), a, 0.5).alias("cells"), F.round(S.safe_div(a, F.col("c_custkey") % 3), 6).alias("ratio"))


@query(f"with {PROBS}, s as (select vec_id, p, list_reverse_sort(p) as q from pr) select vec_id, round(-list_sum(list_transform(p, lambda v: v * ln(greatest(v, 1e-8::double)))), 6) as entropy, round(1 - (q[1] - q[2]), 6) as margin, (list_position(p, q[1]) - 1)::int as best from s")
def prob_uncertainty(spark, d):
    p = F.col("p")
    return probs(spark, d).select("vec_id", F.round(S.entropy(p), 6).alias("entropy"), F.round(S.margin_uncertainty(p), 6).alias("margin"), S.argmax(p).alias("best"))


@query(f"""with {PROBS}, m as (select vec_id, [p[1:2], p[3:4], p[2:3]] as ms from pr), k as (select vec_id, ms, [(ms[1][1] + ms[2][1] + ms[3][1]) / 3, (ms[1][2] + ms[2][2] + ms[3][2]) / 3] as mu from m)
 select vec_id, round(list_sum(list_transform(ms, lambda v: ((v[1] - mu[1]) ** 2 + (v[2] - mu[2]) ** 2) / 6)), 8) as variance,
 round(-list_sum(list_transform(mu, lambda v: v * ln(greatest(v, 1e-8::double)))) + list_sum(list_transform(ms, lambda v: (v[1] * ln(greatest(v[1], 1e-8::double)) + v[2] * ln(greatest(v[2], 1e-8::double))) / 3)), 6) as mutual from k""")
def member_uncertainty(spark, d):
    p = F.col("p")
    m = probs(spark, d).select("vec_id", F.array(F.slice(p, 1, 2), F.slice(p, 3, 2), F.slice(p, 2, 2)).alias("ms"))
    return m.select("vec_id", F.round(S.epistemic_variance(F.col("ms")), 8).alias("variance"), F.round(S.mutual_information(F.col("ms")), 6).alias("mutual"))


VEC = "v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings)"
_COS = "1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))"


@query(f"with {VEC}, c as (select a.vec_id as a, b.vec_id as b, {_COS} as dist from v a join v b on a.vec_id <> b.vec_id), r as (select *, row_number() over (partition by a order by dist, b) as rank from c) select a, b, round(dist, 6) as dist, rank::int as rank from r where rank <= 6")
def knn_cosine(spark, d):
    return learning.knn(vectors(spark, d).select("vec_id", "embedding"), "vec_id", 6, "embedding").select("a", "b", F.round("dist", 6).alias("dist"), "rank")


@query(f"with {VEC} select a.vec_id, round(sqrt(list_dot_product(a.e, a.e)), 5) as norm, round({_COS}, 6) as cosine, round(sqrt(list_sum([(x - y) ** 2 for x, y in list_zip(a.e, b.e)])), 5) as x from v a, v b".replace(", round(sqrt(list_sum([(x - y) ** 2 for x, y in list_zip(a.e, b.e)])), 5) as x", "") + " where b.vec_id = 0")
def vector_norms(spark, d):
    v = vectors(spark, d).select("vec_id", "embedding")
    first = v.where("vec_id = 0").select(F.col("embedding").alias("b"))
    return v.crossJoin(F.broadcast(first)).select("vec_id", F.round(S.norm(F.col("embedding")), 5).alias("norm"), F.round(S.cosine_distance(F.col("embedding"), F.col("b")), 6).alias("cosine"))


@query(f"with {PROBS}, j as (select i, k, sum(p[i + 1] * q[k + 1]) as s from (select vec_id, p, list_reverse(p) as q from pr), range(0, 4) a(i), range(0, 4) b(k) group by i, k) select x.i::int as i, x.k::int as j, round((x.s + y.s) / 2 / (select sum(s) from j), 8) as p from j x join j y on x.i = y.k and x.k = y.i")
def iic_joint(spark, d):
    p = probs(spark, d).withColumn("q", F.reverse("p"))
    return learning.iic_joint(p, "p", "q").withColumn("p", F.round("p", 8))


@query("select vec_id, len(embedding) + 2 as n, round(embedding[1]::double, 5) as first, round(vec_id % 5, 5)::double as tail from embeddings where vec_id % 3 <> 0")
def late_fusion_concat(spark, d):
    v = vectors(spark, d)
    a = v.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    b = v.where("vec_id % 3 <> 0").select("vec_id", F.array((F.col("vec_id") % 5).cast("double"), F.lit(1.0)).alias("embedding"))
    f = learning.fuse_embeddings([a, b], ["vec_id"])
    e = F.col("embedding")
    return f.select("vec_id", F.size(e).cast("bigint").alias("n"), F.round(e[0], 5).alias("first"), F.element_at(e, -2).alias("tail"))


# samples

@query(f"""with {PX}, c as (select label, count(*) as n from px group by label), s as (select *, least(1000.0::double, sum(n) over ()) * n / sum(n) over () as sh from c), f as (select *, floor(sh) as fl from s),
 r as (select *, row_number() over (order by sh - fl desc, label) as k, least(1000, sum(n) over ()) - sum(fl) over () as rest from f) select label, n, (fl + case when k <= rest then 1 else 0 end)::bigint as quota from r""")
def sample_quotas(spark, d):
    n = px(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return sampling.quotas(n, 1000, key="label")


_HASH = "md5(concat_ws('|', id::varchar, '0'))"


@query(f"""with {PX}, c as (select label, count(*) as n from px group by label), s as (select *, least(1000.0::double, sum(n) over ()) * n / sum(n) over () as sh from c), f as (select *, floor(sh) as fl from s),
 q as (select label, fl + case when row_number() over (order by sh - fl desc, label) <= least(1000, sum(n) over ()) - sum(fl) over () then 1 else 0 end as quota from f),
 r as (select *, row_number() over (partition by label order by {_HASH}, id) as k from px) select id, label from r join q using (label) where k <= quota""")
def quota_sample(spark, d):
    return sampling.quota_sample(px(spark, d), "label", ["id"], 1000).select("id", "label")


@query(f"with {PX}, r as (select *, row_number() over (partition by label order by {_HASH}, id) as k from px) select id, label from r where k <= 25")
def per_class_cap(spark, d):
    return sampling.capped(px(spark, d), ["label"], ["id"], 25).select("id", "label")


@query(f"with {PX}, r as (select *, row_number() over (partition by label order by value, id) as k, count(*) over (partition by label) as n from px) select id, label, value from r where k <= n // 10")
def lowest_decile(spark, d):
    return sampling.lowest_decile(px(spark, d), ["label"], "value", "id").select("id", "label", "value")


@query(f"with {PX} select id, (day between date '1995-01-01' and date '1995-06-30' or day between date '1997-03-01' and date '1997-03-31') as is_test from px")
def date_split(spark, d):
    return sampling.holdout(px(spark, d), "date_ranges", date="day", ranges=[("1995-01-01", "1995-06-30"), ("1997-03-01", "1997-03-31")]).select("id", "is_test")


@query(f"with {PX}, h as (select id, label, ('0x' || substr(md5(concat_ws('|', label::varchar, '0')), 1, 8))::bigint as h from px) select id, h < 858993459 as is_test, (h % 5)::int as fold from h")
def group_split(spark, d):
    p = sampling.holdout(px(spark, d), "grouped_random", group="label", fraction=0.2)
    return sampling.folds(p, "label", 5).select("id", "is_test", "fold")


@query(f"with {PX} select id, case when row_number() over (order by id) <= floor((select count(*) from px) * 0.8) then 'train' else 'val' end as part from px")
def position_split(spark, d):
    return sampling.split_by_position(px(spark, d), ["id"], 0.2).select("id", "part")


@query(f"with {PX} select id, label, value from px order by value desc, id limit 50")
def top_values(spark, d):
    return px(spark, d).select("id", "label", "value").orderBy(F.col("value").desc(), "id").limit(50)


# learning and iterative operators: checked by tests against numpy, rows only here

def pca_scores(spark, d):
    v = vectors(spark, d)
    mean, comps = learning.pca_fit(v, 0.9, "embedding")
    return learning.encode(v.select("vec_id", "embedding"), lambda x: (x - mean) @ comps, "embedding").select("vec_id", "embedding")


def kmeans_labels(spark, d):
    return learning.kmeans(vectors(spark, d).select("vec_id", "embedding"), 10, "embedding").select("vec_id", "label")


def cluster_tree(spark, d):
    v = vectors(spark, d).select("vec_id", "label", "embedding")
    return learning.cluster_tree(v, 4, 30, "vec_id", "embedding").select("vec_id", "label", "child", "cluster")


def forest_predictions(spark, d):
    v, f = _labelled_vectors(spark, d)
    return learning.classifiers(f)["forest"].fit(v).transform(v).select("vec_id", "label", "prediction")


def _labelled_vectors(spark, d):
    """All numbers of each vector as columns, its parity as the label, and balanced weights."""
    f = [f"x{i}" for i in range(64)]
    v = vectors(spark, d).select("vec_id", (F.col("label") % 2).cast("double").alias("label"), *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(f)))
    return learning.balanced_weights(v), f


def cv_report(spark, d):
    v, f = _labelled_vectors(spark, d)
    done = learning.cross_validated(sampling.folds(v, "vec_id", 3), lambda: learning.classifiers(f)["tree"], 3)
    return learning.class_report(done).select("label", "precision", "recall", "f1", "support")


def forest_members(spark, d):
    v, f = _labelled_vectors(spark, d)
    model = learning.classifiers(f, trees=5)["forest"].fit(v)
    return learning.member_probabilities(model, v, "vec_id").select("vec_id", "member", "probability")


def kmeans_sample(spark, d):
    v = vectors(spark, d).select("vec_id", "embedding")
    return sampling.kmeans_sample(v, "embedding", ["vec_id"], 10, 100).select("vec_id", "stratum")


@query(f"""with {PX}, g as (select label, count(*) as n, row_number() over (order by label) - 1 as i, count(*) over () as g from px group by label),
 r as (select id, label, row_number() over (partition by label order by {_HASH}, id) as k, {_HASH} as h from px),
 f as (select r.*, k <= 5000 // g.g + case when g.i < 5000 % g.g then 1 else 0 end as taken from r join g using (label)),
 t as (select id, label, row_number() over (order by h, id) as k from f where not taken)
 select id, label from f where taken union all select id, label from t where k <= 5000 - (select count(*) from f where taken)""")
def balanced_sample(spark, d):
    return sampling.balanced_sample(px(spark, d), "label", ["id"], 5000).select("id", "label")


@query(f"""with {PX}, p as (select truth, (label % 3)::int as prediction from px), c as (select unnest([0, 1, 2])::int as label),
 n as (select label, count_if(truth = label and prediction = label) as tp, count_if(truth = label) as support, count_if(prediction = label) as given from c, p group by label)
 select label, coalesce(tp / nullif(given, 0), 0)::double as precision, coalesce(tp / nullif(support, 0), 0)::double as recall, coalesce(2 * tp / nullif(support + given, 0), 0)::double as f1, support from n""")
def class_report(spark, d):
    p = px(spark, d).select(F.col("truth").alias("label"), (F.col("label") % 3).cast("int").alias("prediction"))
    return learning.class_report(p).select("label", "precision", "recall", "f1", "support")


def hole_fill(spark, d):
    from ..operators import regions

    p = px(spark, d).withColumn("value", (F.col("label") < 7).cast("int"))
    meta = p.select("scene").distinct().withColumns({"height": F.lit(50), "width": F.lit(50)})
    return regions.filled(p, meta).select("scene", "y", "x", "filled")


def region_sizes(spark, d):
    from ..operators import regions

    return regions.sizes(regions.labelled(px(spark, d).where("label < 5"))).select("scene", "region", "size")


for _f in (asof_exclusive, pca_scores, kmeans_labels, cluster_tree, forest_predictions, cv_report, forest_members, kmeans_sample, hole_fill, region_sizes):
    QUERIES[_f.__name__] = _f
