"""Feeds over an injected getter, invented cities, kernels, clusters, SQL functions, reports and streams against known results."""

import json
import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationlake import errors, report
from stationlake.functions import exprs
from stationlake.functions.register import SCALAR, register_functions
from stationlake.operators import audit, clusters, graph, kernels, service, spatial
from stationlake.plans.ranks import ranked_whole, step_up
from stationlake.sources import feeds, fetch, synthetic
from stationlake.streaming import panel as streams

STATIONS = [{"station_id": str(i), "name": f"n{i}", "lat": 48.85 + i / 500, "lon": 2.35, "capacity": 10 + i} for i in range(25)]
COUNTS = [{"station_id": str(i), "num_bikes_available": i % 5, "num_docks_available": 5, "last_reported": 1_700_000_000} for i in range(25)]
NET = {
    "u://a": {"version": "2.3", "ttl": 60, "last_updated": 1_700_000_000, "data": {"fr": {"feeds": [{"name": n, "url": f"u://a/{n}"} for n in ("station_information", "station_status", "system_information", "free_bike_status")]}}},
    "u://a/station_information": {"data": {"stations": STATIONS}}, "u://a/station_status": {"data": {"stations": COUNTS}}, "u://a/system_information": {"data": {"system_id": "a", "timezone": "Europe/Paris"}},
    "u://a/free_bike_status": {"data": {"bikes": [{"bike_id": "b1", "lat": 48.8, "lon": 2.3, "is_reserved": False, "is_disabled": False}]}},
    "u://b": {"version": "3.0", "data": {"feeds": [{"name": "station_information", "url": "u://b/broken"}]}}, "u://c": {"version": "3.0", "data": {"feeds": [{"name": "station_information", "url": "u://c/none"}]}}, "u://c/none": {"data": {"stations": []}},
}


def getter(url, headers):
    if headers.get("If-None-Match") == "tag":
        return fetch.Response(304, {}, "")
    return fetch.Response(200, {"etag": "tag"}, json.dumps(NET[url])) if url in NET else fetch.Response(404 if "broken" in url else 503, {}, "")


def test_documents_and_retries():
    got = fetch.fetch_json("u://a", getter=getter)
    assert got.etag == "tag" and got.data["ttl"] == 60
    with pytest.raises(errors.NotModified):
        fetch.fetch_json("u://a", getter=getter, etag="tag")
    with pytest.raises(errors.FetchError):
        fetch.fetch_json("u://b/broken", getter=getter)
    waits, states = [], iter([503, 429, 200])
    http = fetch.Http(wait=waits.append)
    http._once = lambda url, headers: fetch.Response(next(states), {}, "{}")
    assert http("u://x", {}).status == 200 and waits == [0.5, 1.0]


def test_feed_object(spark):
    feed = fetch.Feed(spark, "u://a", system_id="a", getter=getter)
    assert feed.version == "2.3" and feed.ttl == 60 and feed.has("vehicles") and not feed.has("alerts") and feed.timezone == "Europe/Paris" and feed.last_updated.year == 2023
    assert feed.availability().where("presence = 'both'").count() == 25 and feed.station_status().count() == 25
    assert {r.layer for r in feed.audit().select("layer").distinct().collect()} == {"static", "dynamic"}
    assert feed.reconcile_fleet().first().free_floating == 1 and set(feed.snapshot()) == {"information", "status", "vehicles"}
    s = feed.summary()
    assert (s["total_stations"], s["total_bikes_available"], s["total_vehicles"]) == (25, 50, 1)
    feed.language = "en"
    assert feed.has("station_status")  # the first language stands in
    with pytest.raises(errors.DiscoveryError):
        feed.alerts()
    assert fetch.availability(spark, "u://a", getter=getter).count() == 25 and fetch.audit_feed(spark, "u://a", getter=getter).count() == 50


def test_many_systems_and_their_audit(spark):
    systems = spark.createDataFrame([(s, f"u://{s}") for s in "abcd"] + [("e", None)], "system_id string, url string")
    docs = {(r.system_id, r.feed): r.error for r in fetch.fetch_many(systems, getter=getter).collect()}
    assert docs["a", "station_information"] is None and docs["b", "station_information"].startswith("FetchError") and docs["d", None].startswith("FetchError") and docs["e", None].startswith("DiscoveryError")
    verdict, status = fetch.audit_catalogue(systems, getter=getter)
    assert verdict.count() == 25
    assert {r.system_id: r.status for r in status.collect()} == {"a": "ok: 25 stations", "b": "no station_information: FetchError", "c": "empty", "d": "unreachable: FetchError", "e": "unreachable: DiscoveryError"}


def test_feed_source_batch_and_stream(spark, tmp_path):
    at = lambda name, x: (tmp_path / name).write_text(json.dumps(x)) and f"file://{tmp_path}/{name}"
    info = at("info.json", NET["u://a/station_information"])
    url = at("gbfs.json", {"version": "3.0", "data": {"feeds": [{"name": "station_information", "url": info}]}})
    spark.dataSource.register(fetch.FeedSource)
    options = {"systems": json.dumps({"s": url, "t": "file:///not/there"}), "kinds": "station_information"}
    rows = spark.read.format("station_feeds").options(**options).load()
    assert feeds.station_info(rows.where("error is null")).count() == 25 and rows.where("error is not null").count() == 1
    query = spark.readStream.format("station_feeds").options(**options).load().writeStream.format("memory").queryName("polls").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    try:
        query.processAllAvailable()
        assert feeds.station_info(spark.table("polls").where("error is null")).select("station_id").distinct().count() == 25
    finally:
        query.stop()


def test_catalogue_and_example(spark, tmp_path):
    answers = iter([fetch.Response(200, {}, "System ID,Name,Auto-Discovery URL\ns1,One,u://a\n"), fetch.Response(500, {}, "")])
    cache = str(tmp_path / "systems.csv")
    one = fetch.catalog(spark, "u://list", cache=cache, getter=lambda u, h: next(answers))
    assert one.columns == ["system_id", "name", "auto-discovery_url"] and feeds.resolve(one, "S1") == "u://a"
    assert fetch.catalog(spark, "u://list").count() == 1  # kept by the process
    assert fetch.catalog(spark, "u://list", cache=cache, refresh=True, getter=lambda u, h: next(answers)).count() == 1  # kept by the file
    info, status = fetch.example(spark)
    assert info.count() == status.count() == 8 and status.where("num_bikes_available + num_docks_available > 0").count() == 8


# --- invented cities -------------------------------------------------------------------------------------------------


def test_city_is_reproducible(spark):
    info, status = synthetic.city(spark, n_stations=40, days=3, n_frozen=2, missing_rate=0.1, weather_days=1)
    again = synthetic.city(spark, n_stations=40, days=3, n_frozen=2, missing_rate=0.1, weather_days=1)[1]
    key = lambda df: sorted(map(tuple, df.select("station_id", "fetched_at", "num_bikes_available").collect()))
    assert key(status) == key(again.repartition(3)) and 40 * 72 * 0.8 < len(key(status)) < 40 * 72
    both = status.join(info.select("station_id", "capacity"), "station_id")
    assert both.where("num_bikes_available + num_docks_available <> capacity or num_bikes_available < 0 or num_docks_available < 0").count() == 0
    assert both.groupBy("station_id").agg(F.count_distinct("num_bikes_available").alias("n")).where("n = 1").count() >= 2
    assert synthetic.city(spark, n_stations=5, days=1, lowfreq=0.7)[1].count() == 120


def test_flows_keep_every_bike(spark):
    c = synthetic.Flows(n_stations=30, days=2, weather_events=2, trip_rate=20.0)
    _, seen, figures = synthetic.run_flows(c)
    assert figures["lost"] < 1e-9 and seen.min() >= -1e-9 and figures["trips"].sum() > 100
    info, status = synthetic.flows(spark, c, synthetic.Flows(system_id="two", n_stations=10, days=1, ghost_rate=0.2, cell_loss=0.1, station_outages=1))
    n = {r.system_id: r["count"] for r in status.groupBy("system_id").count().collect()}
    assert n["synthetic"] == 30 * 48 and 150 < n["two"] < 240
    both = status.join(info.select("system_id", "station_id", "capacity"), ["system_id", "station_id"])
    assert both.where("num_bikes_available + num_bikes_disabled + num_docks_available <> capacity").count() == 0


def test_footprint_and_calibration(spark):
    c = synthetic.Flows(n_stations=20, days=2, climb_penalty=0.0, seed=3)
    g, seen, _ = synthetic.run_flows(c)
    want = synthetic._footprint(c, g, seen)
    _, status = synthetic.flows(spark, c)
    got = synthetic.footprint(status).first()
    assert got.turnover == pytest.approx(want[0], rel=1e-6) and got.acf1 == pytest.approx(want[1], rel=1e-6) and got.stockout == pytest.approx(want[2], rel=1e-6)
    info = synthetic.flows(spark, c)[0]
    ranked = synthetic.calibrate(info, tuple(want), days=1, betas=(1.5,), bases=(0.1, 0.6), rates=(6.0, 12.0)).collect()
    assert sorted(r.rank for r in ranked) == [1, 2, 3, 4] and min(ranked, key=lambda r: r.mse).rank == 1
    roles = [r.role for r in synthetic.with_roles(spark.createDataFrame([(float(x),) for x in range(1, 101)], "capacity double")).orderBy("capacity").collect()]
    assert (roles.count(0), roles.count(1), roles.count(2)) == (75, 20, 5)


def test_archive_and_learning_set(spark, tmp_path):
    c = synthetic.Flows(n_stations=12, days=2, cell_loss=0.1)
    synthetic.write_archive(spark, f"file://{tmp_path}/a", c)
    status, info = spark.read.parquet(f"file://{tmp_path}/a/status"), spark.read.parquet(f"file://{tmp_path}/a/info")
    assert dict(status.dtypes)["num_bikes_available"] == "smallint" and info.count() == 12
    synthetic.write_learning_set(info, status, f"file://{tmp_path}/m", k=3, n_eigen=4)
    full = spark.read.parquet(f"file://{tmp_path}/m/panel")
    assert full.count() == 12 * 48 and full.where("observed").count() == status.count() and spark.read.parquet(f"file://{tmp_path}/m/basis").count() == 12 * 4
    ends = {r.split: (r.a, r.b) for r in full.groupBy("split").agg(F.min("fetched_at").alias("a"), F.max("fetched_at").alias("b")).collect()}
    assert ends["train"][1] < ends["val"][0] and ends["val"][1] < ends["test"][0]


# --- kernels, clusters, ranks ----------------------------------------------------------------------------------------


def test_pair_correlations_equal_pandas(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(f"s{s}", int(b), float(np.round(rng.normal() + (s % 3) * np.sin(b / 3), 1))) for s in range(12) for b in range(60) if rng.random() < 0.8] + [("flat", b, 1.0) for b in range(60)]
    bins = spark.createDataFrame(rows, "station_id string, b long, x double")
    wide = pd.DataFrame(rows, columns=["s", "b", "x"]).pivot(index="b", columns="s", values="x")
    for blocks in (512, 4):
        monkeypatch.setattr(kernels, "BLOCK", blocks)
        monkeypatch.setattr(kernels, "RANK_BLOCK", blocks)
        monkeypatch.setattr(kernels, "CHUNK", 16)
        for method in ("pearson", "spearman", "kendall"):
            got = {(r.station_a, r.station_b): (r.corr, r.n_overlap) for r in kernels.pair_correlations(bins, method, 20).collect()}
            assert len(got) == 66 and not any("flat" in k for k in got)
            for (a, b), (c, n) in got.items():
                both = wide[[a, b]].dropna()
                if method == "kendall":
                    x, y = both[a].to_numpy(), both[b].to_numpy()
                    sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
                    want = (sx * sy).sum() / np.sqrt((sx != 0).sum() * (sy != 0).sum())
                else:
                    r = both.rank() if method == "spearman" else both
                    want = np.corrcoef(r[a], r[b])[0, 1]
                assert c == pytest.approx(want, abs=1e-9) and n == len(both)


def test_hull_and_zone_area(spark):
    corners = [(48.0, 2.0), (48.0, 2.1), (48.1, 2.1), (48.1, 2.0), (48.05, 2.05), (48.02, 2.03), (48.05, 2.05)]
    info = spark.createDataFrame([(str(i), a, b) for i, (a, b) in enumerate(corners)], "station_id string, lat double, lon double").repartition(4)
    r = math.radians(0.1) * exprs.EARTH_M
    mid = sum(a for a, _ in corners) / len(corners)
    assert spatial.hull_area(info).first().area_km2 == pytest.approx(r * r * math.cos(math.radians(mid)) / 1e6, rel=1e-3)
    assert spatial.hull_area(info.where("lat = 48.0")).first().area_km2 is None
    s = spatial.coverage_stats(info.where("station_id <> '6'")).first()
    assert s.n_stations == 6 and s.stations_per_km2 == pytest.approx(6 / s.hull_area_km2, abs=1e-3) and s.clark_evans_index > 0
    ring = lambda a, b, c, d: "array(" + ", ".join(f"named_struct('lon', {x}D, 'lat', {y}D)" for x, y in ((a, b), (c, b), (c, d), (a, d), (a, b))) + ")"
    zone = spark.sql(f"select 'z' as zone_id, array({ring(0.0, 0.0, 1.0, 1.0)}) as rings, array({ring(0.25, 0.25, 0.75, 0.75)}) as holes")
    area = zone.select("holes", F.explode("rings").alias("ring")).select(spatial.zone_area_km2("ring").alias("a"), spatial.zone_area_km2("ring", "holes").alias("b")).first()
    assert area.a == pytest.approx(12308.8, rel=1e-3) and area.b == pytest.approx(12308.8 * 0.75, rel=1e-3)
    points = spark.sql("select * from values (1, 0.1D, 0.1D), (2, 0.5D, 0.5D) as p(id, lat, lon)")
    assert {(r.id, r.zone_id) for r in spatial.zones_for_points(points, zone, point_id="id").collect()} == {(1, "z"), (2, None)}


def test_geofencing_keeps_holes(spark):
    square = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    doc = {"data": {"geofencing_zones": {"features": [{"geometry": {"type": "MultiPolygon", "coordinates": [[square(0, 9), square(1, 2)], [square(20, 29)]]}, "properties": {"name": "z", "rules": [{"ride_allowed": True}]}}]}}}
    z = feeds.geofencing(spark.createDataFrame([("s", json.dumps(doc))], "system_id string, body string")).first()
    assert len(z.rings) == 2 and len(z.holes) == 1 and z.holes[0][0].lon == 1.0 and z.ride_allowed


def test_local_moran_inference_finds_planted_clusters(spark):
    rows = [("s", f"{i:03d}", 48 + (i // 15) * 0.01, 2 + (i % 15) * 0.01, 10.0 if i % 15 < 5 and i // 15 < 5 else float(i * 7919 % 5)) for i in range(225)] + [("s", "x", None, 2.0, 1.0)]
    info = spark.createDataFrame(rows, "system_id string, station_id string, lat double, lon double, v double")
    got = {r.station_id: r for r in kernels.local_moran_inference(info, "v", k=4, permutations=999, fdr=True).collect()}
    stat = {r.station_id: r.local_i for r in spatial.local_moran(info.drop("system_id"), "v", k=4).collect()}
    inner = [f"{i:03d}" for i in range(225) if 0 < i % 15 < 4 and 0 < i // 15 < 4]
    assert all(got[s].cluster_type == "HH" and got[s].p_value <= 0.05 and got[s].fdr_p >= got[s].p_value for s in inner)
    assert got["x"].cluster_type == "ns" and (got["x"].local_i is None or math.isnan(got["x"].local_i))
    assert np.mean([abs(got[s].local_i - stat[s]) < 1e-9 for s in inner]) > 0.9


def test_rewiring_keeps_degrees(spark):
    rng = np.random.default_rng(0)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 40, (120, 2)).tolist() if p[0] != p[1]}
    edges = spark.createDataFrame([(str(a), str(b), 1.0) for a, b in pairs] + [(str(b), str(a), 1.0) for a, b in pairs], "a_id string, b_id string, weight double")
    got = kernels.degree_preserving_rewire(edges, seed=1)
    degree = lambda df: {r.a_id: r["count"] for r in df.groupBy("a_id").count().collect()}
    assert degree(got) == degree(edges) and got.where("a_id = b_id").count() == 0 and got.distinct().count() == got.count()
    assert got.join(edges, ["a_id", "b_id"], "left_anti").count() > 50


def test_hierarchy_and_warped_clusters(spark):
    rng = np.random.default_rng(2)
    blobs = np.concatenate([rng.normal(c, 0.0008, (25, 2)) for c in ((48.80, 2.30), (48.90, 2.40), (48.80, 2.45))] + [np.array([[48.5, 2.0], [49.2, 2.9]])])
    info = spark.createDataFrame([("s", f"{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(blobs)] + [("s", "none", None, None)], "system_id string, station_id string, lat double, lon double")
    label = {r.station_id: r.cluster for r in clusters.cluster_hierarchy(info, min_cluster_size=5).collect()}
    groups = [[label[f"{i:03d}"] for i in range(25 * k, 25 * k + 25)] for k in range(3)]
    assert all(np.mean(np.array(g) == max(set(g), key=g.count)) > 0.8 for g in groups) and len({max(set(g), key=g.count) for g in groups}) == 3
    assert label["075"] == label["076"] == label["none"] == -1
    bump = lambda at: np.exp(-((np.arange(24) - at) ** 2) / 6)
    courses = [bump(8 + i % 3) for i in range(12)] + [bump(8) + bump(19 + i % 2) for i in range(12)]
    profiles = spark.createDataFrame([("s", f"{i:02d}", *map(float, c)) for i, c in enumerate(courses)], "system_id string, station_id string, " + ", ".join(f"h{h:02d} double" for h in range(24)))
    got = [r.cluster for r in clusters.cluster_profiles(profiles, k=2, method="dtw").orderBy("station_id").collect()]
    assert len(set(got[:12])) == 1 and len(set(got[12:])) == 1 and got[0] != got[-1]
    assert clusters.cluster_profiles(profiles, method="dtw", k_range=(2, 4)).select("cluster").distinct().count() in (2, 3, 4)


def test_warping_equals_the_plain_recursion():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5, 7))

    def plain(a, b):
        t = np.full((8, 8), np.inf)
        t[0, 0] = 0
        for i in range(7):
            for j in range(7):
                t[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(t[i, j], t[i, j + 1], t[i + 1, j])
        return math.sqrt(t[7, 7])

    got = clusters.warped(x)
    assert all(got[i, j] == pytest.approx(plain(x[i], x[j])) for i in range(5) for j in range(5))


def test_whole_ranks_equal_windows(spark):
    df = spark.range(3000).select("id", (F.pmod(F.col("id") * 7919, F.lit(211)) / 211).alias("p"))
    got = sorted((r["__i"], r.p, r["__n"], round(r["__cum"], 6), round(r["__sum"], 6)) for r in ranked_whole(df, ["p"], "p").collect())
    p = sorted(r.p for r in df.collect())
    assert [(a, b, n) for a, b, n, _, _ in got] == [(i + 1, x, 3000) for i, x in enumerate(p)]
    assert [c for *_, c, _ in got] == pytest.approx(np.cumsum(p).tolist(), abs=1e-5)
    x = np.array(p)
    want = np.minimum(np.minimum.accumulate((x * 3000 / np.arange(1, 3001))[::-1])[::-1], 1)
    adjusted = {}
    for v, a in zip(x, want):
        adjusted[v] = min(adjusted.get(v, 1.0), a)
    assert all(r.p_adjusted == pytest.approx(adjusted[r.p]) for r in step_up(df, "p", lambda n: F.lit(1.0)).collect())
    signal = df.select("id", F.col("p").alias("y"))
    assert sorted(r.y for r in graph.permute_signal(signal).collect()) == p


def test_flag_rate_interval(spark):
    verdict = spark.createDataFrame([(f"s{i}", "x", *[i % 2 == 0 and k == 6 for k in range(7)]) for i in range(40)], "system_id string, station_id string, " + ", ".join(f"{f} boolean" for f in audit.FLAGS))
    got = {r["class"]: r for r in audit.flag_rate_ci(verdict, n_boot=2000).collect()}
    assert got["A7"].systems_flagged == 20 and got["A7"].rate == 0.5 and 0.3 < got["A7"].ci_lo < 0.45 < 0.55 < got["A7"].ci_hi < 0.7 and got["A1"].ci_hi == 0


# --- functions and reports -------------------------------------------------------------------------------------------


def test_sql_functions_equal_the_expressions(spark):
    assert len(register_functions(spark)) == len(SCALAR) + 2
    df = spark.sql("select * from values (48.85D, 2.35D, 48.86D, 2.36D, 3D, 7D), (0D, 0D, 0D, 0D, 0D, 0D) as t(a, b, c, d, n, m)")
    low, high = exprs.wilson_interval(F.col("n"), F.col("m"))
    r = df.select(F.expr("haversine_m(a, b, c, d)").alias("f"), exprs.haversine_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("g"), F.expr("occupancy(n, m)").alias("h"), exprs.occupancy(F.col("n"), F.col("m")).alias("i"), F.expr("wilson_low(n, m)").alias("j"), low.alias("k"), F.expr("wilson_high(n, m)").alias("l"), high.alias("o"), F.expr("decay_gaussian(n, 10)").alias("p"), exprs.decay_weight(F.col("n"), 10.0).alias("q"), F.expr("station_state(n, m, true, true, false, 10)").alias("s")).collect()
    for x in r:
        assert x.f == pytest.approx(x.g) and x.h == x.i and x.p == pytest.approx(x.q) and (x.j, x.l) == pytest.approx((x.k, x.o)) if x.k is not None else x.h is None
    assert [x.s for x in r] == ["normal", "empty"] and spark.sql("select * from periods(timestamp'2024-01-01 00:30:00', timestamp'2024-01-01 03:10:00', 3600)").count() == 4


def test_sphere_and_numbers(spark):
    df = spark.sql("select 48.85D as a, 2.35D as b, 48.90D as c, 2.45D as d, '7' as n")
    p, q = exprs.unit_xyz(F.col("a"), F.col("b")), exprs.unit_xyz(F.col("c"), F.col("d"))
    chord = F.sqrt(F.pow(p.x - q.x, 2) + F.pow(p.y - q.y, 2) + F.pow(p.z - q.z, 2))
    r = df.select(exprs.arc_m(chord).alias("f"), exprs.haversine_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("g"), exprs.arc_m(exprs.chord_of(F.lit(5000.0))).alias("h"), exprs.numeric(df, "n").alias("n"), exprs.numeric(df, "none").alias("m")).first()
    assert r.f == pytest.approx(r.g) and r.h == pytest.approx(5000) and r.n == 7.0 and r.m is None


def test_reports(spark):
    df = spark.sql("select 'a_b' as name, 12345L as n, 0.5D as x, cast(null as double) as y")
    assert report.table(df) == "| name | n | x | y |\n| --- | ---: | ---: | ---: |\n| a_b | 12,345 | 0.50 | - |"
    assert r"a\_b & 12,345 & 0.50 & - \\" in report.table(df, form="latex")
    with pytest.raises(ValueError):
        report.table(spark.range(101))
    v = report.versions(spark)
    assert v["spark"] == spark.version and "numpy" in v
    try:
        import geopandas  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            report.to_geopandas(df)


def test_surroundings_and_features(spark):
    info = spark.sql("select * from values ('s', 'a', 48.85D, 2.35D), ('s', 'b', 48.95D, 2.35D) as t(system_id, station_id, lat, lon)")
    shapes = spark.sql("select 1 as feature_id, 'cafe' as amenity, array(named_struct('lon', 2.349D, 'lat', 48.849D), named_struct('lon', 2.351D, 'lat', 48.849D), named_struct('lon', 2.351D, 'lat', 48.851D), named_struct('lon', 2.349D, 'lat', 48.851D), named_struct('lon', 2.349D, 'lat', 48.849D)) as ring")
    got = {r.station_id: r for r in spatial.station_surroundings(info, features=shapes).collect()}
    assert got["a"].osm_within == 1 and got["a"].osm_cafe == 1 and got["b"].osm_within == 0
    near = spatial.stations_near(spark.sql("select 1 as place, 48.8501D as lat, 2.35D as lon"), info, point_id="place").first()
    assert near.n_stations_within == 1 and near.nearest_station_id == "a" and near.nearest_station_dist_m == pytest.approx(11.1, abs=0.1)


def test_synchrony_threshold_and_concentration(spark):
    rows = [("s", k, datetime(2024, 1, 1) + timedelta(hours=h), b) for h in range(30) for k, b in (("a", h % 5), ("b", (h % 5) * 2), ("c", h * 7 % 3))]
    p = spark.createDataFrame(rows, "system_id string, station_id string, fetched_at timestamp, num_bikes_available long")
    strong = service.synchrony(p, threshold=0.9).collect()
    assert [(r.station_a, r.station_b, round(r.corr, 6)) for r in strong] == [("a", "b", 1.0)]
    one = p.where("station_id = 'a' and hour(fetched_at) < 3")
    got = service.temporal_concentration(one).first()
    assert got.peak_bin == 60 and 0 < got.peak_share < 1 and service.temporal_concentration(p.limit(0)).count() == 0


# --- streams ---------------------------------------------------------------------------------------------------------

POLLS = "system_id string, station_id string, fetched_at timestamp, num_bikes_available long, num_docks_available long"


def drained(spark, tmp_path, name, build, tables):
    """Rows that a stream over stored tables gives once all of them are read and a late row has moved the watermark."""
    sources = []
    for i, df in enumerate(tables):
        df.write.parquet(f"file://{tmp_path}/{name}{i}")
        sources.append(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/{name}{i}"))
    query = build(*sources).writeStream.format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/{name}cp").start()
    try:
        query.processAllAvailable()
        for i, df in enumerate(tables):
            time = next(c for c, t in df.dtypes if t == "timestamp")
            df.limit(1).withColumn(time, F.lit("2030-01-01").cast("timestamp")).write.mode("append").parquet(f"file://{tmp_path}/{name}{i}")
        query.processAllAvailable()
        return spark.table(name).where("not (fetched_at >= '2029-01-01')").collect() if "fetched_at" in spark.table(name).columns else spark.table(name).collect()
    finally:
        query.stop()


def polls(spark):
    at = lambda h, m=0: datetime(2024, 1, 1) + timedelta(hours=h, minutes=m)
    return spark.createDataFrame([("s", k, at(h, 5), (h * 3 + i) % 7, 7 - (h * 3 + i) % 7) for h in range(30) for i, k in enumerate("ab")], POLLS)


def test_stream_nearest_reading(spark, tmp_path):
    p = polls(spark)
    weather = spark.createDataFrame([(datetime(2024, 1, 1) + timedelta(minutes=40 * i), float(i)) for i in range(50)], "observed_at timestamp, temp double")
    got = {(r.station_id, r.fetched_at): r.temp for r in drained(spark, tmp_path, "near", streams.exogenous, [p, weather])}
    from stationlake.operators.frames import join_exogenous

    want = {(r.station_id, r.fetched_at): r.temp for r in join_exogenous(p, weather).collect() if r.temp is not None}
    assert got == want and len(got) == 60


def test_stream_service_and_fleet(spark, tmp_path):
    p = polls(spark)
    got = {(r.station_id, r.period): (r.p_bike, r.n_obs) for r in drained(spark, tmp_path, "service", streams.service, [p])}
    assert len([k for k in got if k[1].year == 2024]) == 60 and got["a", datetime(2024, 1, 1, 7)] == (0.0, 1)
    fleet = {r.period: (r.bikes, r.n_polls) for r in drained(spark, tmp_path, "fleet", lambda s: streams.fleet_totals(s, freq="1h"), [p])}
    assert fleet[datetime(2024, 1, 1, 1)] == (3 + 4, 2)


def test_stream_drift_and_idle_time(spark, tmp_path):
    from stationlake.operators.flow import cumulative_imbalance

    p = polls(spark)
    got = {(r.station_id, r.fetched_at): r.cumulative_imbalance for r in drained(spark, tmp_path, "drift", streams.drift, [p])}
    assert got == {(r.station_id, r.fetched_at): r.cumulative_imbalance for r in cumulative_imbalance(p).collect()}
    v = spark.createDataFrame([("s", "v", datetime(2024, 1, 1) + timedelta(hours=h), 48.0 + (0.01 if h >= 5 else 0.0), 2.0) for h in range(10)], "system_id string, vehicle_id string, fetched_at timestamp, lat double, lon double")
    idle = {r.fetched_at.hour: r.idle_hours for r in drained(spark, tmp_path, "idle", streams.idle_time, [v])}
    assert idle == {h: float(h if h < 5 else h - 5) for h in range(10)}
