"""Queries over whole jobs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import flows
from ..operators import learning
from .views import CAT, PX, QUERIES, catalog, px, query, vectors


def _set(source: str) -> str:
    """Classes of labels in the counts of a source."""
    return f"(select prio, label, bin from (select *, sum(cnt) over (partition by prio, label) as total, row_number() over (partition by prio, label order by cnt desc, bin) as r from {source}) where r = 1 and cnt / total >= 0.34)"


@query(f"""with {PX}, p as (select (scene % 2)::int as prio, scene // 2 as slot, y, x, label, truth from px),
 c1 as (select prio, label, truth as bin, count(*) as cnt from p group by all), m1 as {_set("c1")},
 g as (select slot, y, x, arg_min(coalesce(bin, 0), prio) as bin from p left join m1 using (prio, label) group by all),
 c2 as (select prio, label, bin, count(*) as cnt from p join g using (slot, y, x) group by all), m2 as {_set("c2")},
 f as (select prio, label, max(bin) as bin from (select * from m1 union all select * from m2) group by all)
 select slot, y, x, arg_min(coalesce(bin, 0), prio)::int as value, min(prio)::int as dqi from p left join f using (prio, label) group by all""")
def post_inference(spark, d):
    p = px(spark, d).select(F.pmod("scene", F.lit(2)).cast("int").alias("prio"), F.floor(F.col("scene") / 2).alias("slot"), "y", "x", "label", F.col("truth").alias("klass"))
    return flows.post_inference(p, "prio", ["slot", "y", "x"], t=0.34)[1]


MATCHED = f"""with {PX}, s as (select scene, (scene // 4) % 2 as grp, min(day)::timestamp as ts from px group by scene),
 c as (select a.scene, b.scene as path, (b.scene % 4 = 3)::int as priority, abs(epoch(b.ts) - epoch(a.ts)) as dt from s a join s b using (grp)
  where a.scene % 2 = 0 and b.scene % 2 = 1 and abs(epoch(b.ts) - epoch(a.ts)) <= case when b.scene % 4 = 1 then 259200 else 2592000 end),
 m as (select scene, path from (select *, row_number() over (partition by scene order by dt, priority, path) as r from c) where r = 1)"""


def _validation(spark, d):
    p = px(spark, d)
    s = p.groupBy("scene").agg(F.min("day").cast("timestamp").alias("ts")).withColumn("grp", F.pmod(F.floor(F.col("scene") / 4), F.lit(2)))
    targets = s.where("scene % 2 = 0")
    family = lambda k: s.where(F.pmod("scene", F.lit(4)) == k).select("grp", F.col("ts").alias("o_ts"), F.col("scene").alias("path"))
    maps = p.select("scene", "y", "x", F.pmod("label", F.lit(2)).alias("pred"))
    truths = p.select(F.col("scene").alias("path"), "y", "x", (F.col("truth") == 1).cast("int").alias("truth"))
    return flows.matched_validation(targets, [(family(1), 0, 259200.0), (family(3), 1, 2592000.0)], ["grp"], "scene", "path", maps, truths)


@query(f"""{MATCHED}, k as (select a.scene, count_if(b.truth = 1 and a.label % 2 = 1) as tp, count_if(b.truth <> 1 and a.label % 2 = 0) as tn, count_if(b.truth <> 1 and a.label % 2 = 1) as fp,
 count_if(b.truth = 1 and a.label % 2 = 0) as fn from px a join m using (scene) join px b on b.scene = m.path and a.y = b.y and a.x = b.x group by a.scene)
 select scene, tp::bigint as tp, tn::bigint as tn, fp::bigint as fp, fn::bigint as fn, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1 from k""")
def matched_scenes(spark, d):
    return _validation(spark, d)["scenes"].select("scene", "tp", "tn", "fp", "fn", F.round("f1", 6).alias("f1"))


@query(f"{MATCHED} select scene, case when path is null then 'no_interval_match' else 'matched' end as status from s left join m using (scene) where scene % 2 = 0")
def matched_audit(spark, d):
    return _validation(spark, d)["audit"].select("scene", "status")


WEIGHTS = ((0.00001, -0.1, 0.3), (-0.000004, 0.05, 1.1), (0.000003, 0.02, 0.6))
_score = ", ".join(f"value::double * {a:.6f}::double + label * {b}::double + {c}::double as s{i}" for i, (a, b, c) in enumerate(WEIGHTS))


@query(f"with {PX}, s as (select id, x, y, {_score} from px) select id, case when s0 >= s1 and s0 >= s2 then 0 when s1 >= s2 then 1 else 2 end as label, round(-120 + (x + 0.5::double) * 0.1::double, 6) as mx, round(35 - (y + 0.5::double) * 0.1::double, 6) as my from s")
def located_labels(spark, d):
    w = np.array(WEIGHTS)
    p = px(spark, d).select("id", "y", "x", F.array(F.col("value").cast("double"), F.col("label").cast("double")).alias("features"))
    out = flows.located_labels(p, lambda x: x @ w[:, :2].T + w[:, 2], (-120.0, 0.1, 0.0, 35.0, 0.0, -0.1))
    return out.select("id", "label", F.round("mx", 6).alias("mx"), F.round("my", 6).alias("my"))


@query(f"with {CAT} select path, case when not regexp_matches(path, '[02468]$') then 'unused' when day < date '2024-01-15' then 'train' else 'test' end as part from cat")
def split_files(spark, d):
    return flows.split_files(catalog(spark, d), "[02468]$", "day", "2024-01-15").select("path", "part")


@query(f"""with {PX}, b as (select scene, y // 10 as ty, x // 10 as tx, least(greatest(floor((value::double - 0) / (500000 / 5)), 0), 4)::int as b from px)
 select scene, ty::int as ty, tx::int as tx, {", ".join(f"round(count_if(b = {i}) / count(*), 6) as f{i}" for i in range(5))} from b group by all""")
def tile_features(spark, d):
    t = flows.tile_features(px(spark, d), 10, "value", 0.0, 500000.0, 5)
    return t.select("scene", "ty", "tx", *(F.round(F.col("features")[i], 6).alias(f"f{i}") for i in range(5)))


# no SQL: tile_clusters and approximate_knn have tests against plain versions, trained_clusters only runs

def tile_clusters(spark, d):
    return flows.tile_clusters(px(spark, d), 10, "value", 0.0, 500000.0, 5, 4)


def trained_clusters(spark, d):
    return flows.trained_clusters(vectors(spark, d).select("vec_id", "embedding"), "vec_id", "embedding", 8, 3, 30)


def approximate_knn(spark, d):
    return learning.approximate_knn(vectors(spark, d).select("vec_id", "embedding"), "vec_id", 6, "embedding").select("a", "b", F.round("dist", 6).alias("dist"), "rank")


for _f in (tile_clusters, trained_clusters, approximate_knn):
    QUERIES[_f.__name__] = _f
