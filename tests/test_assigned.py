"""context_assign_metrics equals its SQL where no cluster has a class, at the least share, and where a score ends on a half."""

import duckdb
import pytest
from compare import both
from pyspark.sql import functions as F

from rasterloom import plans
from rasterloom.functions import scalars

NAME = "context_assign_metrics"


def compared(spark, path, orders):
    """Both results for orders of a label and status each."""
    cols = "o_orderkey, o_custkey, o_orderstatus, 100.0::double as o_totalprice, timestamp '1995-01-01' as o_orderdate"
    duckdb.sql(f"copy (select {cols} from ({orders})) to '{path / 'orders.parquet'}' (format parquet)")
    got, sql = both(spark, str(path), plans.QUERIES[NAME], plans.SQL[NAME])
    assert got == sql
    return dict(zip(got[0], got[1][0]))


def one_label(n, label, hits):
    """n orders of a label: the first are O, the rest F and P in turn."""
    status = f"case when k < {hits} then 'O' when k % 2 = 0 then 'F' else 'P' end"
    return f"select k + {label} * 100000 as o_orderkey, {label}::bigint as o_custkey, {status} as o_orderstatus from range({n}) r(k)"


@pytest.mark.parametrize("orders", [
    " union all ".join(one_label(900, label, 300) for label in range(12)),
    one_label(3, 0, 1) + " where false",
    f"select * replace (null::bigint as o_custkey) from ({one_label(50, 0, 50)})",
], ids=["even", "empty", "unlabelled"])
def test_no_cluster_has_a_class(spark, tmp_path, orders):
    assert set(compared(spark, tmp_path, orders).values()) == {None}


def test_least_share_makes_a_map(spark, tmp_path):
    row = compared(spark, tmp_path, one_label(100, 0, 34) + " union all " + one_label(300, 1, 100))
    assert (row["n"], row["tp"], row["fp"], row["precision"]) == (100, 34, 66, 0.34)


@pytest.mark.parametrize("hits", [323, 325, 333])
def test_scores_on_a_half(spark, tmp_path, hits):
    assert compared(spark, tmp_path, one_label(640, 0, hits))["tp"] == hits


def test_rounding_of_halves(spark):
    halves = spark.range(200_000).select("id", scalars.round_scaled((2 * F.col("id") + 1) / 2e6, 6).alias("r"))
    want = duckdb.sql("select m, round((2 * m + 1) / 2000000.0::double, 6) from range(200000) t(m)").fetchall()
    assert sorted(map(tuple, halves.collect())) == sorted(want)
