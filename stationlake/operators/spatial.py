"""Spatial operators on the range and nearest-neighbour joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import EARTH_M, decay_weight, haversine_m, project_metres
from ..plans.components import stored
from ..plans.rewrites import knn, range_join
from .flow import TIME
from .inequality import normal_sf
from .kernels import hull_of_parts


def nearest_stations(info: DataFrame, lat: float, lon: float, *, k: int = 1, max_radius_m: float | None = None) -> DataFrame:
    out = info.withColumn("distance_m", haversine_m(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).where("distance_m is not null")
    return (out if max_radius_m is None else out.where(F.col("distance_m") <= max_radius_m)).orderBy("distance_m", "station_id").limit(k)


MAX_CATEGORIES = 1000  # of features, a column each


def features_within(points: DataFrame, features: DataFrame, *, point_id: str, feature_id: str, radius_m: float = 300, category: str | None = None) -> DataFrame:
    """Per point: features within the radius, by category too where one is given (a column for each that features have), and the
    nearest feature at any distance."""
    pairs = range_join(points.select(point_id, "lat", "lon"), features.select(feature_id, "lat", "lon", *([category] if category else [])), radius_m)
    n = pairs.groupBy(F.col(f"a_{point_id}").alias(point_id)).agg(F.count("*").alias("n_total"))
    out = points.join(n, point_id, "left").withColumn("n_total", F.coalesce("n_total", F.lit(0).cast("long")))
    if category:
        names = sorted(r[0] for r in features.select(F.col(category).cast("string")).where(F.col(category).isNotNull()).distinct().limit(MAX_CATEGORIES + 1).collect())
        if len(names) > MAX_CATEGORIES:
            raise ValueError(f"more than {MAX_CATEGORIES} categories")
        count = pairs.groupBy(F.col(f"a_{point_id}").alias(point_id)).agg(F.count("*").alias("__all"), *(F.count_if(F.col(f"b_{category}") == c).alias(f"n_{c}") for c in names)).drop("__all")
        out = out.join(count, point_id, "left").fillna(0, [f"n_{c}" for c in names])
    near = knn(points, features, 1, point_id, feature_id, exclude_self=False).select(F.col("a_id").alias(point_id), F.col("b_id").alias(f"nearest_{feature_id}"), F.col("distance_m").alias("nearest_m"))
    return out.join(near, point_id, "left")


def link_transit(info: DataFrame, stops: DataFrame, *, stop_id: str, radius_m: float = 200) -> DataFrame:
    out = features_within(info, stops, point_id="station_id", feature_id=stop_id, radius_m=radius_m)
    return out.withColumn("is_feeder", F.coalesce(F.col("nearest_m") <= radius_m, F.lit(False)))


def stations_near(points: DataFrame, info: DataFrame, *, point_id: str, radius_m: float = 300) -> DataFrame:
    """points with the number of stations within the radius and the nearest station at any distance."""
    out = features_within(points, info, point_id=point_id, feature_id="station_id", radius_m=radius_m)
    return out.withColumnsRenamed({"n_total": "n_stations_within", "nearest_m": "nearest_station_dist_m"})


#: Tag columns of map features, the first that is there gives the category (fixed values).
FEATURE_TAGS = ("amenity", "shop", "leisure", "highway", "railway", "public_transport")


def enrich_with_features(info: DataFrame, features: DataFrame, *, feature_id: str, radius_m: float = 300, category: str | None = None, prefix: str = "osm_") -> DataFrame:
    """info with the number of map features within the radius, by category too. features: lat and lon, or `ring`, of which the
    mean of the corners counts; category: else the first tag column that is there."""
    if "lat" not in features.columns:
        mean = lambda part: F.aggregate(F.slice("ring", 1, F.size("ring") - 1), F.lit(0.0), lambda s, p: s + p[part]) / (F.size("ring") - 1)  # noqa: E731  the last corner repeats the first
        features = features.withColumns({"lat": mean("lat"), "lon": mean("lon")})
    category = category or next((c for c in FEATURE_TAGS if c in features.columns), None)
    out = features_within(info.select("station_id", "lat", "lon"), features, point_id="station_id", feature_id=feature_id, radius_m=radius_m, category=category)
    named = {c: f"{prefix}{c.removeprefix('n_')}" for c in out.columns if c.startswith("n_") and c != "n_total"} | {"n_total": f"{prefix}within"}
    return info.join(out.withColumnsRenamed(named).drop("lat", "lon", f"nearest_{feature_id}", "nearest_m"), "station_id", "left")


def station_surroundings(info: DataFrame, *, transit: DataFrame | None = None, features: DataFrame | None = None, feature_id: str = "feature_id", radius_m: float = 300, transit_radius_m: float | None = None, category: str | None = None) -> DataFrame:
    """info with its transit stops (nearest, number within, feeder or not) and map features around; what is not given is left out."""
    out = info
    if transit is not None:
        near = link_transit(info.select("station_id", "lat", "lon"), transit, stop_id=feature_id, radius_m=transit_radius_m or radius_m)
        out = out.join(near.select("station_id", F.col("nearest_m").alias("nearest_stop_dist_m"), F.col("n_total").alias("n_transit_within"), F.col("is_feeder").alias("is_transit_feeder")), "station_id", "left")
    return out if features is None else enrich_with_features(out, features, feature_id=feature_id, radius_m=radius_m, category=category)


def two_step_fca(info: DataFrame, demand: DataFrame, *, max_distance_m: float = 800, decay: str = "gaussian", supply: str = "capacity", demand_col: str = "population") -> DataFrame:
    """Two-step floating catchment accessibility of each demand point; one range join of places, of supply and of demand, feeds
    both steps. Stations at one place have one load."""
    known = lambda df: df.where("lat is not null and lon is not null").groupBy("lat", "lon")
    pairs = range_join(known(info).agg(F.sum(F.coalesce(F.col(supply).cast("double"), F.lit(0.0))).alias("s")), known(demand).agg(F.sum(F.coalesce(F.col(demand_col).cast("double"), F.lit(0.0))).alias("d")), max_distance_m)
    pairs = stored(pairs.withColumn("w", decay_weight(F.col("distance_m"), max_distance_m, decay)).select("a_lat", "a_lon", "b_lat", "b_lon", "a_s", "b_d", "w"))
    load = pairs.groupBy("a_lat", "a_lon").agg(F.sum(F.col("b_d") * F.col("w")).alias("load"))
    score = pairs.join(load, ["a_lat", "a_lon"]).where("load > 0").groupBy(F.col("b_lat").alias("lat"), F.col("b_lon").alias("lon")).agg(F.sum(F.col("a_s") / F.col("load") * F.col("w")).alias("accessibility"))
    return demand.join(score, ["lat", "lon"], "left").select(*demand.columns, F.coalesce("accessibility", F.lit(0.0)).alias("accessibility"))


def places(info: DataFrame) -> DataFrame:
    """Distinct coordinates with the number of stations there; many feeds give all stations without a place the same one."""
    return info.where("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.count("*").alias("n"))


def ripley_k(info: DataFrame, radii: list[float], *, area_km2: float) -> DataFrame:
    """K and L of each radius from one join of places at the largest; no edge correction. Pairs at one place are counted
    without making them."""
    p = places(info)
    pairs = range_join(p, p, max(radii)).where(F.struct("a_lat", "a_lon") < F.struct("b_lat", "b_lon"))
    own = p.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("long").alias("same"))
    counts = pairs.agg(*(F.coalesce(F.sum(F.when(F.col("distance_m") <= r, F.col("a_n") * F.col("b_n"))), F.lit(0)).alias(f"c{i}") for i, r in enumerate(radii))).join(F.broadcast(own))  # one row each
    rows = counts.select("n", F.explode(F.array(*(F.struct(F.lit(float(r)).alias("radius_m"), (F.col(f"c{i}") + F.col("same")).alias("pairs")) for i, r in enumerate(radii)))).alias("r")).select("n", "r.*")
    k = F.lit(area_km2 * 1e6) * 2 * F.col("pairs") / F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1))
    return rows.select("radius_m", "pairs", k.alias("k"), (F.sqrt(k / math.pi) - F.col("radius_m")).alias("l"))


def morans_i(info: DataFrame, value: str, *, k: int = 8) -> DataFrame:
    """Global Moran's I with row-standardised k-nearest neighbours, analytic z and two-sided p."""
    rows = info.where(F.col(value).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("station_id", "lat", "lon", F.col(value).cast("double").alias("v"))
    mean = rows.agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    z = rows.join(F.broadcast(mean)).select("station_id", (F.col("v") - F.col("m")).alias("z"), "n")
    e = knn(rows, rows, k, "station_id", "station_id").select(F.col("a_id").alias("i"), F.col("b_id").alias("j"))
    deg = Window.partitionBy("i")
    e = e.withColumn("w", 1.0 / F.count("*").over(deg))
    zi, zj = z.select(F.col("station_id").alias("i"), F.col("z").alias("zi")), z.select(F.col("station_id").alias("j"), F.col("z").alias("zj"))
    cross = e.join(zi, "i").join(zj, "j").agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("c"), F.sum("w").alias("s0"))
    back = e.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("wb"))
    s1 = e.join(back, ["i", "j"], "full_outer").agg((F.sum(F.pow(F.coalesce("w", F.lit(0.0)) + F.coalesce("wb", F.lit(0.0)), 2)) / 2).alias("s1"))
    ins = e.groupBy(F.col("j").alias("i")).agg(F.sum("w").alias("ci"))
    s2 = z.select(F.col("station_id").alias("i")).join(ins, "i", "left").agg(F.sum(F.pow(1 + F.coalesce("ci", F.lit(0.0)), 2)).alias("s2"))
    sq = z.agg(F.sum(F.col("z") * F.col("z")).alias("zz"), F.first("n").alias("n"))
    t = sq.join(F.broadcast(cross)).join(F.broadcast(s1)).join(F.broadcast(s2))  # one row each
    n, s0 = F.col("n").cast("double"), F.col("s0")
    moran = n / F.nullif(s0, F.lit(0.0)) * F.col("c") / F.when(F.col("zz") > 0, F.col("zz"))
    expect = -1 / F.nullif(n - 1, F.lit(0.0))
    var = (n * n * F.col("s1") - n * F.col("s2") + 3 * s0 * s0) / F.nullif(s0 * s0 * (n * n - 1), F.lit(0.0)) - expect * expect
    out = t.where("n >= 3").select(moran.alias("i"), expect.alias("expected"), ((moran - expect) / F.sqrt(F.when(var > 0, var))).alias("z"), "n")
    return out.withColumn("p", 2 * normal_sf(F.abs("z")))


def local_moran(info: DataFrame, value: str, *, k: int = 8) -> DataFrame:
    """The local statistic and quadrant of each station; `kernels.local_moran_inference` adds p-values."""
    rows = info.where(F.col(value).isNotNull() & F.col("lat").isNotNull()).select("station_id", "lat", "lon", F.col(value).cast("double").alias("v"))
    s = rows.agg(F.avg("v").alias("m"), F.var_samp("v").alias("m2"))
    z = rows.join(F.broadcast(s)).select("station_id", (F.col("v") - F.col("m")).alias("z"), "m2")
    lag = knn(rows, rows, k, "station_id", "station_id").join(z.select(F.col("station_id").alias("b_id"), "z"), "b_id").groupBy(F.col("a_id").alias("station_id")).agg(F.avg("z").alias("lag"))
    q = F.concat(F.when(F.col("z") > 0, "H").otherwise("L"), F.when(F.round("lag", 9) > 0, "H").otherwise("L"))
    return z.join(lag, "station_id").select("station_id", (F.col("z") / F.nullif(F.col("m2"), F.lit(0.0)) * F.col("lag")).alias("local_i"), q.alias("quadrant"))


def neighbour_stats(info: DataFrame, *, area_km2: float) -> DataFrame:
    """Mean and median distance to the nearest station, density and the Clark-Evans ratio of the rounded mean."""
    nn = knn(info, info, 1, "station_id", "station_id").agg(F.bround(F.avg("distance_m"), 1).alias("mean_nn_m"), F.bround(F.median("distance_m"), 1).alias("median_nn_m"), F.count("*").alias("n"))
    density = F.col("n") / (area_km2 * 1e6)
    return nn.select("n", "mean_nn_m", "median_nn_m", (F.col("n") / area_km2).alias("density_km2"), F.bround(F.col("mean_nn_m") * 2 * F.sqrt(density), 3).alias("clark_evans"))


def coverage_stats(info: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """One row: stations, distances to the nearest, area (of the zones, else of the convex hull), density and Clark-Evans
    ratio. NULL where too few stations leave a figure without meaning."""
    n = info.where("lat is not null and lon is not null").agg(F.count("*").alias("n_stations"))
    nn = knn(info, info, 1, "station_id", "station_id").agg(F.bround(F.avg("distance_m"), 1).alias("mean_nearest_neighbor_m"), F.bround(F.median("distance_m"), 1).alias("median_nearest_neighbor_m"))
    name = "hull_area_km2" if zones is None else "service_area_km2"
    area = hull_area(info).withColumnRenamed("area_km2", "a") if zones is None else zones.agg(F.sum(zone_area_km2()).alias("a"))
    row = n.join(F.broadcast(nn)).join(F.broadcast(area))  # one row each
    some = F.when(F.col("a") > 0, F.col("a"))
    ratio = F.col("mean_nearest_neighbor_m") * 2 * F.sqrt(F.col("n_stations") / (some * 1e6))
    return row.select("n_stations", "mean_nearest_neighbor_m", "median_nearest_neighbor_m", F.bround("a", 3).alias(name), F.bround(F.col("n_stations") / some, 3).alias("stations_per_km2"), F.bround(ratio, 3).alias("clark_evans_index"))


def projected(info: DataFrame) -> DataFrame:
    """info with x_m and y_m: equirectangular metres about the mean latitude of all rows."""
    mid = info.agg(F.avg("lat").alias("__mid"))
    return info.join(F.broadcast(mid)).withColumns(dict(zip(("x_m", "y_m"), project_metres(F.col("lat"), F.col("lon"), F.col("__mid"))))).drop("__mid")  # one row


def hull_area(info: DataFrame) -> DataFrame:
    """One row area_km2: convex hull of all points in equirectangular metres; NULL where they lie on a line.

    Each partition sends the corners of its own hull, and one task takes the hull of these."""
    pts = projected(info.where("lat is not null and lon is not null").select("lat", "lon")).select("x_m", "y_m").distinct()
    return hull_of_parts(pts)


def zone_area_km2(ring: str = "ring", holes: str | None = None) -> Column:
    """Area of a closed ring of (lon, lat) structs on the ellipsoid by the cylindrical equal-area projection and the shoelace
    formula; holes: a column of rings to take away."""
    a, f = 6_378_137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    e = math.sqrt(e2)

    def height(lat: Column) -> Column:  # authalic height, times a
        s = F.sin(F.radians(lat))
        return (1 - e2) * (s / (1 - e2 * s * s) + F.log((1 + e * s) / (1 - e * s)) / (2 * e)) * (a / 2)

    def area(r: Column) -> Column:
        return F.abs(F.aggregate(F.sequence(F.lit(0), F.size(r) - 2), F.lit(0.0), lambda s, i: s + (F.radians(F.get(r, i).lon) * height(F.get(r, i + 1).lat) - F.radians(F.get(r, i + 1).lon) * height(F.get(r, i).lat)) * a / 2)) / 1e6

    own = area(F.col(ring))
    return own if holes is None else own - F.aggregate(F.coalesce(F.col(holes), F.array().cast("array<array<struct<lon:double,lat:double>>>")), F.lit(0.0), lambda s, h: s + area(h))


def spatial_entropy(vehicles: DataFrame, *, grid_m: float = 200) -> DataFrame:
    """Entropy and evenness of vehicles over square cells, per snapshot."""
    rows = vehicles.where("lat is not null and lon is not null")
    mid = rows.agg(F.avg("lat").alias("mid"))
    rad = math.pi / 180
    cells = rows.join(F.broadcast(mid)).select(TIME, F.floor(F.col("lat") * rad * EARTH_M / grid_m).alias("y"), F.floor(F.col("lon") * rad * EARTH_M * F.cos(F.radians("mid")) / grid_m).alias("x")).groupBy(TIME, "y", "x").count()
    s = cells.groupBy(TIME).agg(F.sum("count").alias("n"), F.count("*").alias("cells"), F.sum(F.col("count") * F.log("count")).alias("cl"))
    h = F.log("n") - F.col("cl") / F.col("n")
    return s.select(TIME, "n", "cells", h.alias("entropy"), F.when(F.col("cells") > 1, h / F.log("cells")).otherwise(0.0).alias("evenness"))


def center_of_mass(panel: DataFrame, *, weight: str = "num_bikes_available", freq: str = "1h") -> DataFrame:
    from ..functions.exprs import floor_time

    w = F.coalesce(weight, F.lit(0)).cast("double")
    s = panel.where("lat is not null and lon is not null").groupBy(floor_time(F.col(TIME), freq).alias("period")).agg(F.sum(w).alias("w"), F.sum(w * F.col("lat")).alias("y"), F.sum(w * F.col("lon")).alias("x"))
    ok = F.when(F.col("w") > 0, F.col("w"))
    return s.select("period", (F.col("y") / ok).alias("lat"), (F.col("x") / ok).alias("lon"), F.col("w").alias("weight"))


def outage_redundancy(panel: DataFrame, *, radius_m: float = 300, value: str = "num_bikes_available") -> DataFrame:
    """Per station: share of polls at which it is empty, and at which all observed neighbours are empty too."""
    one = panel.groupBy("station_id", TIME).agg(F.max(value).alias("v"))
    place = panel.where("lat is not null and lon is not null").groupBy("station_id").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    edges = range_join(place, place, radius_m).where("a_station_id <> b_station_id").select(F.col("a_station_id").alias("station_id"), F.col("b_station_id").alias("nbr"))
    empty = one.where("v = 0").select("station_id", TIME)
    around = empty.join(edges, "station_id").join(one.select(F.col("station_id").alias("nbr"), TIME, F.col("v").alias("nv")), ["nbr", TIME]).groupBy("station_id", TIME).agg(F.count("nv").alias("seen"), F.coalesce(F.max(F.col("nv") > 0), F.lit(False)).alias("some"))
    systemic = around.where("seen > 0 and not some").groupBy("station_id").agg(F.count("*").alias("sys"))
    base = one.groupBy("station_id").agg(F.avg((F.col("v") == 0).cast("double")).alias("local_outage"), F.count("v").alias("n"))
    nbrs = edges.groupBy("station_id").agg(F.count("*").alias("n_neighbors"))
    out = base.join(systemic, "station_id", "left").join(nbrs, "station_id", "left")
    return out.select("station_id", "local_outage", (F.coalesce("sys", F.lit(0)) / F.nullif(F.col("n"), F.lit(0))).alias("systemic_outage"), F.coalesce("n_neighbors", F.lit(0).cast("long")).alias("n_neighbors"))


def inside_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Ray casting against a closed ring of (lon, lat) structs, as one higher-order expression."""
    edges = F.sequence(F.lit(0), F.size(ring) - 2)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, i + 1)
        return ((a.lat > lat) != (b.lat > lat)) & (lon < (b.lon - a.lon) * (lat - a.lat) / (b.lat - a.lat) + a.lon)

    return F.aggregate(edges, F.lit(False), lambda s, i: s != F.coalesce(crosses(i), F.lit(False)))


def zones_for_points(points: DataFrame, zones: DataFrame, *, point_id: str) -> DataFrame:
    """points with the ids of the zones that contain them, a row each (NULL: none). zones: zone_id and ring, or rings and
    holes; a hole is not part of its zone. Zones meet points in cells of a hundredth of a degree of their bounding boxes."""
    if "ring" not in zones.columns:
        none = F.array().cast("array<array<struct<lon:double,lat:double>>>")
        zones = zones.select("zone_id", F.col("holes").alias("holes") if "holes" in zones.columns else none.alias("holes"), F.explode("rings").alias("ring"))
    elif "holes" not in zones.columns:
        zones = zones.withColumn("holes", F.array().cast("array<array<struct<lon:double,lat:double>>>"))
    cell = lambda c: F.floor(c * 100)
    at = F.transform("ring", lambda p: p.lon), F.transform("ring", lambda p: p.lat)
    boxes = zones.select("zone_id", "ring", "holes", F.explode(F.sequence(cell(F.array_min(at[0])), cell(F.array_max(at[0])))).alias("cx"), F.sequence(cell(F.array_min(at[1])), cell(F.array_max(at[1]))).alias("cys")).select("zone_id", "ring", "holes", "cx", F.explode("cys").alias("cy"))
    hit = points.select(point_id, "lat", "lon", cell(F.col("lon")).alias("cx"), cell(F.col("lat")).alias("cy")).join(boxes, ["cx", "cy"]).where(inside_ring(F.col("lon"), F.col("lat"), F.col("ring")) & ~F.exists("holes", lambda h: inside_ring(F.col("lon"), F.col("lat"), h))).select(point_id, "zone_id").distinct()
    return points.join(hit, point_id, "left")


def core_points(info: DataFrame, *, eps_m: float = 300, min_points: int = 3) -> DataFrame:
    """Stations with at least min_points stations (themselves included) within eps_m: the cores of density clusters. Places
    are joined, not stations, so many stations at one place cost one row."""
    p = places(info)
    near = range_join(p, p, eps_m).groupBy(F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon")).agg(F.sum("b_n").alias("n_within"))
    return info.select("station_id", "lat", "lon").join(near, ["lat", "lon"]).select("station_id", "n_within", (F.col("n_within") >= min_points).alias("is_core"))
