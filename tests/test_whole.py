"""Queries over the whole table: every scene takes part. sf0.001 has one scene only, so these read sf0.01."""

import pytest
from compare import both
from pyspark.sql import functions as F

from rasterloom import plans
from rasterloom.plans import views

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["resample_nearest_scenes", "sensor_fuse_scenes", "paste_last_scenes", "subset_paste_scenes"])
def test_every_scene_takes_part(spark, name):
    want = {r.scene for r in views.px(spark, SF).select("scene").distinct().collect()}
    got, sql = both(spark, SF, plans.QUERIES[name], plans.SQL[name])
    assert got == sql
    scene = got[0].index("scene")
    assert len(want) > 1
    assert {r[scene] for r in got[1]} >= want


def test_stations_match_on_their_days(spark):
    got, sql = both(spark, SF, plans.QUERIES["station_match_days"], plans.SQL["station_match_days"])
    assert got == sql
    visits = views.table(spark, SF, "lineitem").select(F.col("l_suppkey").alias("station"), F.to_date("l_shipdate").alias("day"))
    assert len(got[1]) > 0
    assert plans.QUERIES["station_match_days"](spark, SF).join(visits, ["station", "day"], "left_anti").count() == 0


def test_packed_tiles_have_all_positions(spark):
    got, sql = both(spark, SF, plans.QUERIES["packed_tiles_whole"], plans.SQL["packed_tiles_whole"])
    assert got == sql
    tile = [got[0].index(c) for c in ("scene", "tile_y", "tile_x")]
    held = {}
    for r in got[1]:
        held.setdefault(tuple(r[i] for i in tile), []).append(r[got[0].index("pos")])
    assert held
    assert all(sorted(p) == list(range(100)) for p in held.values())
