"""The scalar expressions as SQL functions of a session; they are SQL themselves, so plans stay free of Python."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

from .exprs import EARTH_M

_A = "pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)"
_N = "nullif(n, 0)"
_SHARE = f"s / {_N}"
_WILSON = "({p} + 1.9207294103470684 / {n} {sign} 1.959963984540054 * sqrt({p} * (1 - {p}) / {n} + 0.9603647051735342 / ({n} * {n}))) / (1 + 3.8414588206941368 / {n})".replace("{n}", _N)
#: Name, arguments, type and body.
SCALAR = (
    ("haversine_m", "lat1 double, lon1 double, lat2 double, lon2 double", "double", f"{2 * EARTH_M} * atan2(sqrt({_A}), sqrt(1 - ({_A})))"),
    ("occupancy", "bikes double, docks double", "double", "case when bikes + docks > 0 then bikes / (bikes + docks) end"),
    ("utilization", "bikes double, capacity double", "double", "bikes / case when capacity > 0 then capacity end"),
    ("station_state", "bikes double, docks double, renting boolean, returning boolean, virtual boolean, capacity double", "string", "case when not coalesce(renting, true) and not coalesce(returning, true) then 'disabled' when coalesce(virtual, false) or not coalesce(capacity > 0, false) then 'virtual' when coalesce(bikes, -1) <= 0 then 'empty' when coalesce(docks, -1) <= 0 then 'full' else 'normal' end"),
    ("decay_gaussian", "d double, d_max double", "double", "case when d <= d_max then exp(-pow(d / (d_max / 3), 2) / 2) else 0 end"),
    ("decay_linear", "d double, d_max double", "double", "case when d <= d_max then 1 - d / d_max else 0 end"),
    ("decay_exponential", "d double, d_max double", "double", "case when d <= d_max then exp(-3 * d / d_max) else 0 end"),
    ("time_block", "at timestamp", "string", "case when hour(at) < 7 then 'night' when hour(at) < 10 then 'am_peak' when hour(at) < 16 then 'midday' when hour(at) < 19 then 'pm_peak' else 'evening' end"),
    ("floor_seconds", "at timestamp, step bigint", "timestamp", "timestamp_seconds(floor(unix_seconds(at) / step) * step)"),
    ("wilson_low", "s double, n double", "double", f"case when n <> 0 then greatest({_WILSON.format(p=_SHARE, sign='-')}, 0) end"),
    ("wilson_high", "s double, n double", "double", f"case when n <> 0 then least({_WILSON.format(p=_SHARE, sign='+')}, 1) end"),
    ("mercator_y", "lat double", "double", f"ln(tan({math.pi} / 4 + radians(lat) / 2))"),
)
#: Name, arguments and query of functions that return tables.
TABLE = (
    ("periods", "first timestamp, last timestamp, step_s bigint", "period timestamp", "select timestamp_seconds(s) from (select explode(sequence(unix_seconds(first) div step_s * step_s, unix_seconds(last) div step_s * step_s, step_s)) as s)"),
    ("hours_of_day", "", "hour int", "select cast(id as int) from range(24)"),
)


def register_functions(spark: SparkSession) -> list[str]:
    """Makes all of them temporary functions of the session; their names."""
    for name, args, kind, body in SCALAR:
        spark.sql(f"create or replace temporary function {name}({args}) returns {kind} return {body}")
    for name, args, kind, body in TABLE:
        spark.sql(f"create or replace temporary function {name}({args}) returns table ({kind}) return {body}")
    return [x[0] for x in (*SCALAR, *TABLE)]
