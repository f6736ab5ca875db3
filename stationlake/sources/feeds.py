"""Feed documents (JSON) to canonical tables, one row per document in, one row per record out.

A document frame has `body` (JSON text) and, where known, system_id, gbfs_version and fetched_at. Absent fields and texts that
are no JSON give NULLs or no rows, never an error. Records without their key are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import parse_timestamp

OBJECT = "map<string,string>"


def read_documents(spark: SparkSession, path: str, system_id: str | None = None) -> DataFrame:
    """Files of one JSON document each; fetched_at is the file's time."""
    src = spark.read.text(path, wholetext=True)
    return src.select(F.lit(system_id).cast("string").alias("system_id"), F.lit(None).cast("string").alias("gbfs_version"), F.col("_metadata.file_modification_time").alias("fetched_at"), F.col("value").alias("body"))


def _data(body: Column) -> Column:
    """The payload: the member `data`, or the document itself."""
    return F.coalesce(F.get_json_object(body, "$.data"), body)


def localized(value: Column) -> Column:
    """A plain text, or the text of the first entry of a list of translations."""
    return F.when(F.ltrim(value).startswith("["), F.get_json_object(value, "$[0].text")).otherwise(value)


def _array(data: Column, *keys: str) -> Column:
    """JSON text of the first list found under one of the keys, directly or under the first language that has it."""
    languages = F.map_values(F.from_json(data, OBJECT))

    def nested(key: str) -> Column:
        return F.get(F.filter(F.transform(languages, lambda v: F.get_json_object(v, f"$.{key}")), lambda v: v.isNotNull()), F.lit(0))

    return F.coalesce(*(F.get_json_object(data, f"$.{k}") for k in keys), *map(nested, keys))


def records(docs: DataFrame, *keys: str) -> DataFrame:
    """Documents' own columns without the body, and each record's members as texts in the map `m`."""
    own = [c for c in docs.columns if c != "body"]
    found = docs.select(*own, F.explode(F.from_json(_array(_data(F.col("body")), *keys), "array<string>")).alias("__r"))
    return found.select(*own, F.from_json("__r", OBJECT).alias("m")).where("m is not null")


def _text(*names: str) -> Column:
    return F.coalesce(*(F.col("m").getItem(n) for n in names))


def _number(*names: str) -> Column:
    return F.nanvl(_text(*names).try_cast("double"), F.lit(None).cast("double"))


def _count(*names: str) -> Column:
    return _number(*names).try_cast("long")


def _flag(name: str, default: bool | None) -> Column:
    """An absent member is the default, a null false."""
    v = F.col("m").getItem(name)
    return F.when(~F.map_contains_key("m", F.lit(name)), F.lit(default)).otherwise(F.coalesce(~F.lower(v).isin("false", "0", "0.0", ""), F.lit(False)))


def _of(docs: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in docs.columns else F.lit(None).cast(kind)


def _keyed(found: DataFrame, key: str) -> DataFrame:
    return found.where(F.col(key).isNotNull())


def station_info(docs: DataFrame, *, station_type: str | None = None) -> DataFrame:
    virtual, capacity = _flag("is_virtual_station", False), _count("capacity")
    kind = F.lit(station_type) if station_type else F.when(virtual | ~F.coalesce(capacity != 0, F.lit(False)), "free_floating").otherwise("docked_bike")
    return _keyed(records(docs, "stations").select(_of(docs, "system_id").alias("system_id"), _text("station_id").alias("station_id"), localized(_text("name")).alias("name"), _number("lat").alias("lat"), _number("lon").alias("lon"), capacity.alias("capacity"), kind.alias("station_type"), virtual.alias("is_virtual_station"), _text("region_id").alias("region_id")), "station_id")


def station_status(docs: DataFrame) -> DataFrame:
    return _keyed(records(docs, "stations").select(
        _of(docs, "system_id").alias("system_id"), _text("station_id").alias("station_id"), _count("num_bikes_available", "num_vehicles_available").alias("num_bikes_available"),
        _count("num_docks_available", "vehicle_docks_available").alias("num_docks_available"), *(_flag(n, True).alias(n) for n in ("is_renting", "is_returning", "is_installed")),
        parse_timestamp(_text("last_reported")).alias("last_reported"), _of(docs, "fetched_at", "timestamp").alias("fetched_at"), _of(docs, "gbfs_version").alias("gbfs_version")), "station_id")


def station_vehicle_counts(docs: DataFrame) -> DataFrame:
    """One row per station and vehicle type listed; stations without a list give none."""
    found = records(docs, "stations").select(_of(docs, "system_id").alias("system_id"), _text("station_id").alias("station_id"), _of(docs, "fetched_at", "timestamp").alias("fetched_at"), F.explode(F.from_json(_text("vehicle_types_available"), f"array<{OBJECT}>")).alias("m"))
    return _keyed(found.select("system_id", "station_id", _text("vehicle_type_id").alias("vehicle_type_id"), _count("count", "num_vehicles_available").alias("num_vehicles_available"), "fetched_at"), "station_id")


def vehicles(docs: DataFrame) -> DataFrame:
    return _keyed(records(docs, "vehicles", "bikes").select(
        _of(docs, "system_id").alias("system_id"), _text("vehicle_id", "bike_id").alias("vehicle_id"), _text("station_id").alias("station_id"), _text("vehicle_type_id").alias("vehicle_type_id"),
        _number("lat").alias("lat"), _number("lon").alias("lon"), _flag("is_reserved", False).alias("is_reserved"), _flag("is_disabled", False).alias("is_disabled"), _number("current_range_meters").alias("current_range_meters"),
        _number("current_fuel_percent").alias("current_fuel_percent"), _text("pricing_plan_id").alias("pricing_plan_id"), _of(docs, "fetched_at", "timestamp").alias("fetched_at"), _of(docs, "gbfs_version").alias("gbfs_version")), "vehicle_id")


def vehicle_types(docs: DataFrame) -> DataFrame:
    return _keyed(records(docs, "vehicle_types").select(_of(docs, "system_id").alias("system_id"), *(_text(n).alias(n) for n in ("vehicle_type_id", "form_factor", "propulsion_type")), _number("max_range_meters").alias("max_range_meters")), "vehicle_type_id")


def pricing_plans(docs: DataFrame) -> DataFrame:
    return _keyed(records(docs, "plans").select(_of(docs, "system_id").alias("system_id"), _text("plan_id").alias("plan_id"), localized(_text("name")).alias("name"), _text("currency").alias("currency"), _number("price").alias("price"), _flag("is_taxable", None).alias("is_taxable"), localized(_text("description")).alias("description")), "plan_id")


def system_regions(docs: DataFrame) -> DataFrame:
    return _keyed(records(docs, "regions").select(_of(docs, "system_id").alias("system_id"), _text("region_id").alias("region_id"), localized(_text("name")).alias("name")), "region_id")


def alerts(docs: DataFrame) -> DataFrame:
    """Only the first time window of an alert; an open end is NULL."""
    times = [parse_timestamp(F.get_json_object(_text("times"), f"$[0].{n}")).alias(n) for n in ("start", "end")]
    return _keyed(records(docs, "alerts").select(_of(docs, "system_id").alias("system_id"), _text("alert_id").alias("alert_id"), _text("type").alias("type"), localized(_text("summary")).alias("summary"), localized(_text("description")).alias("description"), *times, parse_timestamp(_text("last_updated")).alias("last_updated")), "alert_id")


def system_information(docs: DataFrame) -> DataFrame:
    data = _data(F.col("body"))
    get = lambda n: F.get_json_object(data, f"$.{n}")
    return docs.select(F.coalesce(get("system_id"), _of(docs, "system_id")).alias("system_id"), localized(get("name")).alias("name"), localized(get("operator")).alias("operator"), get("timezone").alias("timezone"), F.coalesce(get("language"), F.get_json_object(get("languages"), "$[0]")).alias("language"))


def geofencing(docs: DataFrame) -> DataFrame:
    """One row per zone. The rule without vehicle types counts, else the first. `ride_allowed` of a version 3 rule needs start
    and end both allowed. `rings` are the outer rings of the polygons, `holes` the inner ones of all; features without geometry are left out."""
    data = _data(F.col("body"))
    zones = F.coalesce(F.get_json_object(data, "$.geofencing_zones.features"), F.get_json_object(data, "$.features"))
    found = docs.select(_of(docs, "system_id").alias("system_id"), F.posexplode(F.from_json(zones, "array<string>")).alias("at", "f"))
    rule = OBJECT
    found = found.select("system_id", "at", F.get_json_object("f", "$.properties.name").alias("name"), F.from_json(F.get_json_object("f", "$.properties.rules"), f"array<{rule}>").alias("rules"), F.get_json_object("f", "$.geometry.type").alias("kind"), F.get_json_object("f", "$.geometry.coordinates").alias("xy")).where("xy is not null")
    m = F.coalesce(F.get(F.filter("rules", lambda r: F.coalesce(r.getItem("vehicle_type_ids"), F.lit("[]")).isin("[]", "null")), F.lit(0)), F.get("rules", F.lit(0)))
    found = found.withColumn("m", m)
    truth = lambda n: F.col("m").getItem(n).try_cast("boolean")
    polygons = F.when(F.col("kind") == "MultiPolygon", F.from_json("xy", "array<array<array<array<double>>>>")).otherwise(F.array(F.from_json("xy", "array<array<array<double>>>")))
    corners = lambda ring: F.transform(ring, lambda q: F.struct(F.get(q, F.lit(0)).alias("lon"), F.get(q, F.lit(1)).alias("lat")))
    rings = F.transform(polygons, lambda p: corners(F.get(p, F.lit(0))))
    holes = F.transform(F.flatten(F.transform(polygons, lambda p: F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))))), corners)
    return found.select("system_id", F.coalesce(localized(F.col("name")), F.col("at").cast("string")).alias("zone_id"), localized(F.col("name")).alias("name"), F.coalesce(truth("ride_allowed"), truth("ride_start_allowed") & truth("ride_end_allowed")).alias("ride_allowed"), truth("ride_through_allowed").alias("ride_through_allowed"), F.col("m").getItem("maximum_speed_kph").try_cast("double").alias("maximum_speed_kph"), truth("station_parking").alias("station_parking"), "rules", rings.alias("rings"), holes.alias("holes"))


def discovery(docs: DataFrame, language: str | None = None) -> DataFrame:
    """Feeds that a discovery document lists: system_id, version, name, url. Version 2 documents list them per language: the
    one asked for, else the first."""
    data = _data(F.col("body"))
    by_language = F.from_json(data, OBJECT)
    asked = F.get_json_object(by_language.getItem(language), "$.feeds") if language else F.lit(None).cast("string")
    first = F.get(F.filter(F.transform(F.map_values(by_language), lambda v: F.get_json_object(v, "$.feeds")), lambda v: v.isNotNull()), F.lit(0))
    feeds = F.from_json(F.coalesce(F.get_json_object(data, "$.feeds"), asked, first), "array<struct<name:string,url:string>>")
    version = F.coalesce(F.get_json_object("body", "$.version"), F.lit("2.x"))
    return docs.select(_of(docs, "system_id").alias("system_id"), version.alias("version"), F.inline(feeds)).where("name is not null")


# --- catalogue of systems ----------------------------------------------------------------------------------------------


def systems_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file as text columns; headers in lower case with _ for spaces."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return df.toDF(*(c.strip().lower().replace(" ", "_") for c in df.columns))


def filter_catalog(catalog: DataFrame, *, country_code: str | None = None, city: str | None = None, name: str | None = None) -> DataFrame:
    """country_code: equal, in either case; city and name: patterns, in either case."""
    if country_code is not None:
        catalog = catalog.where(F.lower("country_code") == country_code.lower())
    if city is not None:
        place = next((c for c in ("location", "city", "name") if c in catalog.columns), None)
        if place is None:
            raise ValueError("the catalogue has no column for a place")
        catalog = catalog.where(F.col(place).rlike(f"(?i){city}"))
    return catalog if name is None else catalog.where(F.col("name").rlike(f"(?i){name}"))


def resolve(catalog: DataFrame, system_id: str) -> str:
    """Discovery address of a system; auto_discovery_url before url."""
    urls = [F.col(c) for c in ("auto-discovery_url", "auto_discovery_url", "url") if c in catalog.columns]
    if not urls:
        raise ValueError("the catalogue has no column for addresses")
    found = catalog.where(F.lower("system_id") == system_id.lower()).select(F.coalesce(*urls).alias("url")).where("url is not null").first()
    if found is None:
        raise LookupError(f"no system {system_id!r} in the catalogue")
    return found.url
