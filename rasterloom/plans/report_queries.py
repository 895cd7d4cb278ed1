"""Queries over reports, sets of files, and what else the pipelines put together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classes, grid, learning, reports
from ..sources import readers, writers
from .views import CAT, PROBS, PX, catalog, probs, px, query, table

GRID = [i * 20000.0 for i in range(26)]


@query(f"with {PX} select truth, (i * 20000)::double as at, avg((value <= i * 20000)::int::double) as share from px, range(0, 26) r(i) group by truth, i")
def ecdf(spark, d):
    return reports.ecdf(px(spark, d), "value", GRID, ["truth"])


@query(f"with {PX} select label, min(value) as low, round(quantile_cont(value, 0.25), 4) as q1, round(quantile_cont(value, 0.5), 4) as median, round(quantile_cont(value, 0.75), 4) as q3, max(value) as high, count(*) as n from px group by label")
def box_stats(spark, d):
    b = reports.box_stats(px(spark, d), "value", ["label"]).drop("mean")
    return b.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query(f"with {PX} select label, count(*) as n from px group by label order by n desc, label limit 5")
def most_frequent(spark, d):
    return reports.frequencies(px(spark, d), "label", 5)


@query("select distinct regexp_replace(p_name, '[0-9]+', '', 'g') as p_name from part")
def clipped_names(spark, d):
    return reports.clipped_names(table(spark, d, "part"), "p_name", "[0-9]+")


@query("select l_partkey from lineitem where l_returnflag = 'A' intersect select l_partkey from lineitem where l_returnflag = 'R'")
def common_names(spark, d):
    li = table(spark, d, "lineitem")
    return reports.common_names(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), "l_partkey")


@query(f"with {CAT}, a as (select distinct day from cat where product = 'view'), b as (select day, count(*) as n from cat where product = 'purchase' group by day) select day::varchar as day, n from a join b using (day)")
def day_pairing(spark, d):
    c = catalog(spark, d)
    b = c.where("product = 'purchase'").groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return reports.by_day(c.where("product = 'view'").select("day").distinct(), b, "day").select(F.col("day").cast("string").alias("day"), "n")


@query("select s_suppkey as k, s_acctbal as a, null::varchar as seg from supplier union all select c_custkey, c_acctbal, c_mktsegment from customer")
def union_files(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("a"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("a"), F.col("c_mktsegment").alias("seg"))
    return readers.union_files([s, c])


@query("select a.s_suppkey as y, b.n_nationkey as x, a.s_suppkey * 0.5::double as lat, b.n_nationkey * 2.0::double as lon from supplier a, nation b where a.s_suppkey * 0.5 between 5 and 20 and b.n_nationkey * 2.0 between 10 and 30")
def axis_subset(spark, d):
    lats = table(spark, d, "supplier").select(F.col("s_suppkey").alias("y"), (F.col("s_suppkey") * 0.5).alias("lat"))
    lons = table(spark, d, "nation").select(F.col("n_nationkey").alias("x"), (F.col("n_nationkey") * 2.0).alias("lon"))
    return grid.axis_subset(spark, lats, lons, (10, 5, 30, 20))


@query(f"with {PX}, c as (select label as cluster, truth as class, count(*) as cnt from px group by all), m as (select cluster, class, cnt / total as share from (select *, sum(cnt) over (partition by cluster) as total, row_number() over (partition by cluster order by cnt desc, class) as r from c) where r = 1) select cluster from m where class = 1 or share < 0.35")
def positive_clusters(spark, d):
    from ..operators import zonal

    c = px(spark, d).groupBy(F.col("label").alias("cluster"), F.col("truth").alias("class")).agg(F.count(F.lit(1)).alias("cnt"))
    return classes.positives(zonal.majority(c, 0.35), accept_uncertain=True)


@query(f"with {PX} select id, strftime(date '2024-01-01' + (id % 300)::int, '%Y%m%d') || '_class' || label as name from px")
def renamed_outputs(spark, d):
    return px(spark, d).select("id", writers.renamed((F.col("id") % 300).cast("int"), "2024-01-01", F.concat(F.lit("class"), F.col("label").cast("string"))).alias("name"))


@query(f"with {PX} select scene, y + 10 as y, x + 20 as x, value from px where scene = 1 and y < 5 and x < 5")
def subset_paste(spark, d):
    return grid.paste(px(spark, d).where("scene = 1 and y < 5 and x < 5"), 10, 20).select("scene", "y", "x", "value")


@query(f"with {PX} select scene, y + 10 as y, x + 20 as x, value from px where y < 5 and x < 5")
def subset_paste_scenes(spark, d):
    return grid.paste(px(spark, d).where("y < 5 and x < 5"), 10, 20).select("scene", "y", "x", "value")


@query(f"with {PX} select scene, y, x, count(*) as n from px where label % 3 = 0 group by scene, y, x")
def train_locations(spark, d):
    return px(spark, d).where("label % 3 = 0").groupBy("scene", "y", "x").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {PROBS}, q as (select p, list_reverse(p) as q from pr), j0 as (select i, k, sum(p[i + 1] * q[k + 1]) as s from q, range(0, 4) a(i), range(0, 4) b(k) group by i, k), j as (select x.i, x.k, (x.s + y.s) / 2 / (select sum(s) from j0) as p from j0 x join j0 y on x.i = y.k and x.k = y.i),
 a as (select i, sum(p) as pi from j group by i), b as (select k, sum(p) as pj from j group by k) select round(sum(-p * (ln(p) - ln(pi) - ln(pj))), 6) as loss from j join a using (i) join b using (k)""")
def iic_loss(spark, d):
    p = probs(spark, d).withColumn("q", F.reverse("p"))
    return learning.iic_loss(learning.iic_joint(p, "p", "q")).select(F.round("loss", 6).alias("loss"))


@query(f"with {PX}, q as (select i, (select quantile_cont(value, i / 100) from px where truth = 0) as a, (select quantile_cont(value, i / 100) from px where truth = 1) as b from (select i::double as i from range(0, 101) r(i))) select round(sum(abs(a - b)) / 101, 3) as distance from q".replace("quantile_cont(value, i / 100) from px where truth = 0", "list_extract(quantile_cont(value, [k / 100.0 for k in range(0, 101)]), i::int + 1) from px where truth = 0").replace("quantile_cont(value, i / 100) from px where truth = 1", "list_extract(quantile_cont(value, [k / 100.0 for k in range(0, 101)]), i::int + 1) from px where truth = 1"))
def wasserstein(spark, d):
    p = px(spark, d)
    return learning.quantile_distance(p.where("truth = 0"), p.where("truth = 1"), "value").select(F.round("distance", 3).alias("distance"))


@query(f"""with {PX}, c as (select value as v, count(*) filter (where truth = 0) as a, count(*) filter (where truth = 1) as b from px where truth < 2 group by value),
 s as (select v, sum(a) over w / sum(a) over () as fa, sum(b) over w / sum(b) over () as fb, lead(v) over (order by v) as nxt from c window w as (order by v)) select round(sum(abs(fa - fb) * (nxt - v)), 3) as distance from s""")
def wasserstein_whole(spark, d):
    p = px(spark, d)
    return learning.wasserstein_1d(p.where("truth = 0"), p.where("truth = 1"), "value").select(F.round("distance", 3).alias("distance"))


@query(f"with {PX}, n as (select label, count(*) as n from px group by label), t as (select sum(n) as t, count(*) as k from n) select id, round(t / (k * n), 6) as weight from px join n using (label), t")
def balanced_weights(spark, d):
    return learning.balanced_weights(px(spark, d).select("id", "label")).select("id", F.round("weight", 6).alias("weight"))
