"""Canonical views over the driver's tables; the SQL runs unchanged in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_info": """select concat('sys', cast(n.n_regionkey as string)) as system_id, cast(c.c_custkey as string) as station_id, c.c_name as name,
 cast(48.80 as double) + cast((c.c_custkey * 7919) % 2000 as double) / cast(10000 as double) as lat,
 cast(2.25 as double) + cast((c.c_custkey * 104729) % 3000 as double) / cast(10000 as double) as lon,
 case when c.c_custkey % 17 = 0 then null when c.c_custkey % 13 = 0 then 0 else cast(10 + c.c_custkey % 30 as int) end as capacity,
 case when c.c_custkey % 41 = 0 then 'carsharing' when c.c_custkey % 29 = 0 then 'free_floating' else 'docked_bike' end as station_type,
 (c.c_custkey % 19 = 0) as is_virtual_station, cast(n.n_nationkey as string) as region_id
 from customer c join nation n on c.c_nationkey = n.n_nationkey""",
    "v_panel": """select i.system_id, i.station_id, e.ts as fetched_at,
 cast(cast(floor(e.value) as bigint) % (coalesce(i.capacity, 20) + 1) as bigint) as num_bikes_available,
 cast(coalesce(i.capacity, 20) - cast(floor(e.value) as bigint) % (coalesce(i.capacity, 20) + 1) as bigint) as num_docks_available,
 (e.event_type <> 'error') as is_renting, (e.event_type <> 'error' or e.user_id % 2 = 0) as is_returning,
 i.capacity, i.station_type, i.is_virtual_station, i.lat, i.lon
 from events e join v_info i on cast(e.user_id as string) = i.station_id""",
    "v_snap": """select system_id, station_id, fetched_at, num_bikes_available, num_docks_available, capacity, lat, lon from (
 select system_id, station_id, cast(date_trunc('hour', fetched_at) as timestamp) as fetched_at, num_bikes_available, num_docks_available, capacity, lat, lon,
 row_number() over (partition by system_id, station_id, date_trunc('hour', fetched_at) order by fetched_at desc) as rn from v_panel) t where rn = 1""",
    "v_vehicles": """select i.system_id, concat('v', cast(e.user_id as string)) as vehicle_id,
 case when e.event_id % 5 = 0 then i.station_id else null end as station_id, concat('t', cast(e.user_id % 4 as string)) as vehicle_type_id,
 i.lat + cast(e.event_id % 7 as double) / cast(10000 as double) as lat, i.lon + cast(e.event_id % 11 as double) / cast(10000 as double) as lon,
 (e.event_type = 'purchase') as is_reserved, (e.event_type = 'error') as is_disabled, concat('p', cast(e.user_id % 3 as string)) as pricing_plan_id, e.ts as fetched_at
 from events e join v_info i on cast(e.user_id as string) = i.station_id""",
    "v_vehicle_types": """select concat('t', cast(p_partkey as string)) as vehicle_type_id,
 case p_partkey % 4 when 0 then 'bicycle' when 1 then 'scooter' when 2 then 'bicycle' else 'car' end as form_factor,
 case p_partkey % 4 when 0 then 'human' when 1 then 'electric' when 2 then 'electric_assist' else 'combustion' end as propulsion_type,
 cast(p_size * 1000 as double) as max_range_meters from part""",
    "v_plans": "select concat('p', cast(s_suppkey as string)) as plan_id, s_name as name, 'EUR' as currency, cast(s_nationkey as double) as price from supplier",
    "v_poi": """select cast(s_suppkey as string) as poi_id, cast(48.80 as double) + cast((s_suppkey * 6101) % 2000 as double) / cast(10000 as double) as lat,
 cast(2.25 as double) + cast((s_suppkey * 7369) % 3000 as double) / cast(10000 as double) as lon,
 case s_suppkey % 3 when 0 then 'cafe' when 1 then 'school' else 'station' end as category from supplier""",
    "v_demand": """select p_partkey as demand_id, cast(48.80 as double) + cast((p_partkey * 3571) % 2000 as double) / cast(10000 as double) as lat,
 cast(2.25 as double) + cast((p_partkey * 2213) % 3000 as double) / cast(10000 as double) as lon, cast(p_size as double) as population from part""",
    "v_weather": "select cast(date_trunc('hour', ts) as timestamp) as observed_at, count(*) as n_events, min(value) as temp_c from events group by date_trunc('hour', ts)",
    "v_info_new": """select system_id, station_id, name, case when cast(station_id as bigint) % 23 = 0 then lat + cast(0.01 as double) else lat end as lat, lon,
 case when cast(station_id as bigint) % 31 = 0 then coalesce(capacity, 0) + 5 else capacity end as capacity, station_type, is_virtual_station, region_id
 from v_info where cast(station_id as bigint) % 37 <> 0 union all
 select system_id, concat('n', station_id), name, lat, lon, capacity, station_type, is_virtual_station, region_id from v_info where cast(station_id as bigint) % 43 = 0""",
    "v_info_bad": """select system_id, station_id, name, case when system_id = 'sys3' and cast(station_id as bigint) % 50 = 0 then lon else lat end as lat,
 case when system_id = 'sys3' and cast(station_id as bigint) % 50 = 0 then lat else lon end as lon,
 case when system_id = 'sys1' then 20 when system_id = 'sys2' and cast(station_id as bigint) % 3 <> 0 then null when system_id = 'sys4' and capacity = 0 then 12 else capacity end as capacity,
 station_type, is_virtual_station, region_id from v_info""",
}
TABLES = ("customer", "nation", "events", "part", "supplier")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views over the tables of a folder."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for v, sql in VIEWS.items():
        spark.sql(sql).createOrReplaceTempView(v)
        if v == name:
            break
    return spark.table(name)


def with_views(sql: str) -> str:
    """DuckDB SQL over the same views."""
    return "with " + ", ".join(f"{v} as ({body})" for v, body in VIEWS.items()) + " " + sql
