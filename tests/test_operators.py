"""Small facts and edge cases of the operators."""

import pytest
from pyspark.sql import functions as F

from stationlake import schemas
from stationlake.functions import exprs, freq
from stationlake.operators import flow, inequality, spatial
from stationlake.plans.rewrites import asof_join, knn, range_join

PANEL = "system_id string, station_id string, fetched_at timestamp_ntz, num_bikes_available long, num_docks_available long, capacity long"


def panel(spark, rows):
    return spark.sql("select * from values " + ", ".join(f"('s', '{k}', timestamp_ntz'2024-01-01 {t}:00', {b}, {d}, 10)" for k, t, b, d in rows) + " as t(system_id, station_id, fetched_at, num_bikes_available, num_docks_available, capacity)")


def test_net_flow_and_episodes(spark):
    p = panel(spark, [("a", "00:00", 5, 5), ("a", "01:00", 0, 10), ("a", "02:00", 0, 10), ("a", "03:00", 4, 6), ("b", "00:00", "null", 3)])
    assert [r.net_flow for r in flow.net_flow(p).where("station_id = 'a'").orderBy("fetched_at").collect()] == [None, -5, 0, 4]
    e = flow.stockout_episodes(p).collect()
    assert [(r.station_id, r.kind, r.n_obs, r.duration_minutes) for r in e] == [("a", "empty", 2, 60.0)]


def test_empty_panels(spark):
    p = spark.createDataFrame([], PANEL)
    for op in (flow.net_flow, flow.turnover, flow.flow_balance, flow.stockout_episodes, flow.coverage_stations, flow.coverage_systems, flow.resample, flow.frozen_stations):
        assert op(p).count() == 0


def test_resample_holds_the_last_poll(spark):
    p = panel(spark, [("a", "00:05", 5, 5), ("a", "00:20", 7, 3), ("a", "00:50", 1, 9)])
    assert [r.num_bikes_available for r in flow.resample(p, "15min").orderBy("fetched_at").collect()] == [None, 5, 7, 7]


def test_asof_prefers_backward_on_ties(spark):
    left = spark.sql("select timestamp'2024-01-01 01:00:00' as t")
    right = spark.sql("select * from values (timestamp'2024-01-01 00:30:00', 1), (timestamp'2024-01-01 01:30:00', 2) as r(u, v)")
    assert asof_join(left, right, "t", "u", 3600).first().v == 1
    assert asof_join(left, right, "t", "u", 3600, "forward").first().v == 2
    assert asof_join(left, right, "t", "u", 60).first().v is None


def test_range_join_and_knn_equal_brute_force(spark):
    pts = spark.range(300).select("id", (F.rand(1) * 2 - 1 + F.when(F.col("id") % 3 == 0, 60).otherwise(0)).alias("lat"), (F.rand(2) * 0.6 + F.when(F.col("id") % 2 == 0, 179.7).otherwise(-180.0)).alias("lon")).cache()
    a, b = pts.toDF("i", "y", "x"), pts.toDF("j", "v", "u")
    d = exprs.haversine_m(F.col("y"), F.col("x"), F.col("v"), F.col("u"))
    brute = {(r.i, r.j) for r in a.join(b, d <= 20_000).select("i", "j").collect()}
    assert {(r.a_id, r.b_id) for r in range_join(pts, pts, 20_000).select("a_id", "b_id").collect()} == brute
    best = {r.i: r.d for r in a.join(b, F.col("i") != F.col("j")).groupBy("i").agg(F.min(d).alias("d")).collect()}
    got = {r.a_id: r.distance_m for r in knn(pts, pts, 1, "id", "id").collect()}
    assert got == pytest.approx(best)


def test_point_in_zone(spark):
    ring = "array(named_struct('lon', 2.0D, 'lat', 48.0D), named_struct('lon', 2.1D, 'lat', 48.0D), named_struct('lon', 2.1D, 'lat', 48.1D), named_struct('lon', 2.0D, 'lat', 48.1D), named_struct('lon', 2.0D, 'lat', 48.0D))"
    zones = spark.sql(f"select 'z' as zone_id, {ring} as ring")
    points = spark.sql("select * from values (1, 48.05D, 2.05D), (2, 48.2D, 2.05D) as p(id, lat, lon)")
    assert {(r.id, r.zone_id) for r in spatial.zones_for_points(points, zones, point_id="id").collect()} == {(1, "z"), (2, None)}


def test_gini_and_guards(spark):
    df = spark.sql("select * from values (1L), (1L), (2L), (null) as t(x)")
    assert inequality.gini(df, "x").first().gini == pytest.approx(2 * (1 + 2 + 6) / (3 * 4) - 4 / 3)
    assert inequality.gini(df.where("x is null"), "x").count() == 0 or inequality.gini(df.where("x is null"), "x").first().gini is None
    with pytest.raises(ValueError):
        schemas.validate_schema(df, "station_info")
    with pytest.raises(ValueError):
        freq.seconds("1month")
    assert freq.seconds("15min") == 900
    row = spark.sql("select 'Citi Bike NYC' as n").select(exprs.normalize_operator(F.col("n")).alias("o")).first()
    assert row.o == "Lyft / Motivate"
