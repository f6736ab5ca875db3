"""Normalisers, catalogue, lake and streams."""

import hashlib
import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stationlake.operators import flow
from stationlake.sources import feeds, lake
from stationlake.streaming import panel as streams

DOC = "system_id string, gbfs_version string, fetched_at timestamp, body string"


def docs(spark, *bodies):
    return spark.createDataFrame([("s", "2.3", datetime(2026, 1, 5, 8), x if isinstance(x, str) or x is None else json.dumps(x)) for x in bodies], DOC)


def test_station_info(spark):
    body = {"data": {"stations": [
        {"station_id": "1", "name": "A", "lat": 48.1, "lon": 2, "capacity": 10, "region_id": 7}, {"station_id": 2, "name": [{"text": "B", "language": "fr"}], "capacity": None, "lat": "x"},
        {"station_id": "3", "capacity": 5, "is_virtual_station": True}, {"name": "no id"}]}}
    rows = {r.station_id: r for r in feeds.station_info(docs(spark, body, "no json", None, "{}", "[]", {"data": {"stations": []}})).collect()}
    assert set(rows) == {"1", "2", "3"}
    assert (rows["1"].station_type, rows["2"].station_type, rows["3"].station_type) == ("docked_bike", "free_floating", "free_floating")
    assert (rows["1"].region_id, rows["2"].name, rows["2"].lat, rows["1"].lon, rows["2"].capacity) == ("7", "B", None, 2.0, None)


def test_station_status_of_both_versions(spark):
    two = {"data": {"stations": [{"station_id": "1", "num_bikes_available": 3, "num_docks_available": 4, "is_renting": None, "is_returning": 0, "last_reported": 1700000000}]}}
    three = {"data": {"en": {"stations": [{"station_id": "2", "num_vehicles_available": 5, "vehicle_docks_available": 6, "last_reported": "2023-11-14T22:13:20Z", "vehicle_types_available": [{"vehicle_type_id": "e", "count": 2}]}]}}}
    a, b = feeds.station_status(docs(spark, two, three)).orderBy("station_id").collect()
    assert (a.num_bikes_available, a.num_docks_available, a.is_renting, a.is_returning, a.is_installed) == (3, 4, False, False, True)
    assert (b.num_bikes_available, b.num_docks_available, b.is_renting) == (5, 6, True) and a.last_reported == b.last_reported
    assert [(r.station_id, r.vehicle_type_id, r.num_vehicles_available) for r in feeds.station_vehicle_counts(docs(spark, two, three)).collect()] == [("2", "e", 2)]


def test_other_feeds(spark):
    v = feeds.vehicles(docs(spark, {"data": {"bikes": [{"bike_id": "b", "lat": 1, "lon": 2, "is_disabled": 1}]}}, {"data": {"vehicles": [{"vehicle_id": "v", "vehicle_type_id": 4}]}})).orderBy("vehicle_id").collect()
    assert [(r.vehicle_id, r.is_disabled, r.is_reserved, r.vehicle_type_id) for r in v] == [("b", True, False, None), ("v", False, False, "4")]
    assert feeds.vehicle_types(docs(spark, {"data": {"vehicle_types": [{"vehicle_type_id": "e", "max_range_meters": 5.5}]}})).first().max_range_meters == 5.5
    assert feeds.pricing_plans(docs(spark, {"data": {"plans": [{"plan_id": "p", "price": "1.5", "is_taxable": True}]}})).first().price == 1.5
    assert feeds.system_regions(docs(spark, {"data": {"regions": [{"region_id": "r", "name": [{"text": "R"}]}]}})).first().name == "R"
    al = feeds.alerts(docs(spark, {"data": {"alerts": [{"alert_id": "a", "times": [{"start": 1700000000}, {"start": 1}], "summary": "x"}]}})).first()
    assert al.end is None and al.start.timestamp() > 1
    assert feeds.system_information(docs(spark, {"data": {"system_id": "q", "timezone": "Europe/Paris", "languages": ["fr", "en"]}})).first().language == "fr"


def test_geofencing_and_discovery(spark):
    square = [[[2.0, 48.0], [2.1, 48.0], [2.1, 48.1], [2.0, 48.0]]]
    zones = {"data": {"geofencing_zones": {"features": [
        {"geometry": {"type": "MultiPolygon", "coordinates": [square]}, "properties": {"name": "Z", "rules": [{"vehicle_type_ids": ["e"], "ride_allowed": True}, {"ride_allowed": False, "maximum_speed_kph": 20}]}},
        {"geometry": {"type": "Polygon", "coordinates": square}, "properties": {"rules": [{"ride_start_allowed": True, "ride_end_allowed": False}]}}, {"geometry": None, "properties": {"name": "none"}}]}}}
    a, b = feeds.geofencing(docs(spark, zones)).orderBy(F.desc("zone_id")).collect()
    assert (a.zone_id, a.ride_allowed, a.maximum_speed_kph, len(a.rings), len(a.rings[0])) == ("Z", False, 20.0, 1, 4)
    assert (b.zone_id, b.ride_allowed, b.rings[0][0].lat) == ("1", False, 48.0)
    three, two = {"version": "3.0", "data": {"feeds": [{"name": "x", "url": "u"}]}}, {"data": {"en": {"feeds": [{"name": "e", "url": "1"}]}, "fr": {"feeds": [{"name": "f", "url": "2"}]}}}
    assert {(r.version, r.name) for r in feeds.discovery(docs(spark, three, two)).collect()} == {("3.0", "x"), ("2.x", "e")}
    assert {r.name for r in feeds.discovery(docs(spark, two), "fr").collect()} == {"f"}


def test_catalogue_of_systems(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Country Code,Name,Location,System ID,URL,Auto-Discovery URL\nFR,Vélo,Paris,velo,u,d\nUS,Bike,\"Austin, TX\",bike,w,\n")
    c = feeds.systems_catalog(spark, str(tmp_path / "c.csv"))
    assert [r.system_id for r in feeds.filter_catalog(c, country_code="fr", city="par").collect()] == ["velo"]
    assert (feeds.resolve(c, "VELO"), feeds.resolve(c, "bike")) == ("d", "w")
    with pytest.raises(LookupError):
        feeds.resolve(c, "other")


PANEL = "system_id string, station_id string, num_bikes_available long, num_docks_available long, last_reported timestamp, fetched_at timestamp"


def polls(spark, *rows):
    return spark.createDataFrame([("7", k, b, d, datetime(2026, 1, 1, 0, said), datetime(2026, 1, 1, h, m)) for k, b, d, said, h, m in rows], PANEL)


def test_lake_round_trip(spark, tmp_path):
    path = str(tmp_path / "lake")
    lake.append(polls(spark, ("a", 5, 5, 0, 0, 0), ("a", 4, 6, 1, 0, 5)), path)
    lake.append(polls(spark, ("a", 4, 6, 1, 0, 10), ("b", 1, 1, 0, 23, 0)), path)
    p = lake.panel(spark, path, system_id="7")
    assert sorted((r.station_id, r.fetched_at.minute, r.system_id) for r in p.collect()) == [("a", 0, "7"), ("a", 10, "7"), ("b", 0, "7")]
    assert lake.panel(spark, path, start="2026-01-01T00:05:00", end="2026-01-01T00:10:00").count() == 1
    assert lake.panel(spark, path, columns=["num_bikes_available"]).columns == ["system_id", "station_id", "fetched_at", "last_reported", "num_bikes_available"]
    assert lake.panel(spark, path, tz="Europe/Paris").where("station_id = 'b'").first().local_time == datetime(2026, 1, 2, 0, 0)
    files = {r.path.removeprefix("file:"): r.sha256 for r in lake.manifest(spark, path).collect()}
    assert files and all(hashlib.sha256(Path(k).read_bytes()).hexdigest() == v for k, v in files.items())
    assert tuple(lake.summary(spark, path).first()) == (4, 1, "2026-01-01", "2026-01-01")


def test_geojson(spark):
    out = [json.loads(r.feature) for r in lake.geojson_features(spark.sql("select * from values (1, 48.0D, 2.0D), (2, null, 1.0D) as t(id, lat, lon)")).collect()]
    assert out == [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [2.0, 48.0]}, "properties": {"id": 1}}]


def stream_of(spark, tmp_path, *batches):
    folder = str(tmp_path / "in")
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(PANEL).option("maxFilesPerTrigger", 1).parquet(folder)


def results(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_streams_equal_batch(spark, tmp_path):
    one, two = polls(spark, ("a", 5, 5, 0, 0, 0), ("a", 0, 9, 1, 0, 5), ("b", 3, 0, 0, 0, 0)), polls(spark, ("a", 0, 9, 2, 0, 10), ("a", 4, 6, 3, 0, 15), ("b", 3, 1, 1, 0, 5))
    src, whole = stream_of(spark, tmp_path, one, two), one.union(two)
    key = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    got = results(streams.net_flow(src), "s_flow").where("not is_late")
    cols = ("station_id", "fetched_at", F.coalesce("net_flow", F.lit(-99)))
    assert key(got, *cols) == key(flow.net_flow(whole), *cols)
    cols = ("station_id", "kind", "start", "end", "n_obs", "duration_minutes")
    assert key(results(streams.stockout_episodes(src), "s_out"), *cols) == key(flow.stockout_episodes(whole), *cols)


def test_stream_to_lake_once(spark, tmp_path):
    src = stream_of(spark, tmp_path, polls(spark, ("a", 5, 5, 0, 0, 0)), polls(spark, ("a", 5, 5, 0, 0, 5), ("b", 1, 1, 0, 0, 5)))
    for _ in range(2):
        streams.to_lake(streams.dedup(src), str(tmp_path / "lake"), str(tmp_path / "state"), once=True).awaitTermination(120)
    assert lake.read(spark, str(tmp_path / "lake")).count() == 2
