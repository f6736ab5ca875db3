"""Scalar expressions; NULL in, NULL out unless told otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .freq import seconds

EARTH_M = 6_371_000.0
_PERIODS = {"minute": 60, "hour": 24, "dow": 7, "day": 31, "month": 12, "doy": 366}


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def unit_xyz(lat: Column, lon: Column) -> Column:
    """Place on the unit sphere as struct (x, y, z)."""
    la, lo = F.radians(lat), F.radians(lon)
    return F.struct((F.cos(la) * F.cos(lo)).alias("x"), (F.cos(la) * F.sin(lo)).alias("y"), F.sin(la).alias("z"))


def arc_m(chord: Column) -> Column:
    """Great-circle metres of a chord of the unit sphere."""
    return F.lit(2 * EARTH_M) * F.asin(F.least(chord / 2, F.lit(1.0)))


def chord_of(metres: Column) -> Column:
    """Chord of the unit sphere for great-circle metres, half the circumference at most."""
    return 2 * F.sin(F.least(metres / (2 * EARTH_M), F.lit(math.pi / 2)))


def project_metres(lat: Column, lon: Column, mid_lat: Column) -> tuple[Column, Column]:
    """Equirectangular metres (x, y) about a latitude."""
    return F.radians(lon) * EARTH_M * F.cos(F.radians(mid_lat)), F.radians(lat) * EARTH_M


def numeric(df, name: str) -> Column:
    """A column as number; NULL where it can't be read as one, or isn't there."""
    return F.col(name).try_cast("double") if name in df.columns else F.lit(None).cast("double")


def occupancy(bikes: Column, docks: Column) -> Column:
    return F.when(bikes + docks > 0, bikes / (bikes + docks))


def station_state(bikes: Column, docks: Column, renting: Column | None = None, returning: Column | None = None, virtual: Column | None = None, capacity: Column | None = None) -> Column:
    """disabled, virtual, empty, full or normal; the first that holds."""
    off = F.lit(False) if renting is None or returning is None else ~F.coalesce(renting, F.lit(True)) & ~F.coalesce(returning, F.lit(True))
    free = F.lit(False) if virtual is None else F.coalesce(virtual, F.lit(False))
    if capacity is not None:
        free = free | ~F.coalesce(capacity > 0, F.lit(False))
    return F.when(off, "disabled").when(free, "virtual").when(F.coalesce(bikes, F.lit(-1)) <= 0, "empty").when(F.coalesce(docks, F.lit(-1)) <= 0, "full").otherwise("normal")


def decay_weight(d: Column, d_max: float, decay: str | None = "gaussian") -> Column:
    shape = {None: F.lit(1.0), "none": F.lit(1.0), "linear": 1 - d / d_max, "gaussian": F.exp(-F.pow(d / (d_max / 3), 2) / 2), "exponential": F.exp(-3 * d / d_max)}
    if decay not in shape:
        raise ValueError(f"unknown decay {decay!r}")
    return F.when(d <= d_max, shape[decay]).otherwise(0.0)


def floor_time(ts: Column, freq: str) -> Column:
    """Start of the period of a fixed length, counted from the epoch, UTC."""
    step = seconds(freq)
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts.cast("timestamp")) / step) * step)


def time_of_day_minutes(ts: Column, freq: str) -> Column:
    step = seconds(freq) // 60
    if not step:
        raise ValueError("buckets are whole minutes at least")
    return (F.floor((F.hour(ts) * 60 + F.minute(ts)) / step) * step).cast("int")


def cyclical(ts: Column, fields=("hour", "dow", "month")) -> dict[str, Column]:
    """Sine and cosine of the position in each period."""
    raw = {"minute": F.minute(ts), "hour": F.hour(ts), "dow": F.weekday(ts), "day": F.dayofmonth(ts), "month": F.month(ts), "doy": F.dayofyear(ts)}
    return {f"{f}_{g.__name__}": g(F.lit(2 * math.pi) * raw[f] / _PERIODS[f]) for f in fields for g in (F.sin, F.cos)}


def time_block(ts: Column) -> Column:
    h = F.hour(ts)
    return F.when(h < 7, "night").when(h < 10, "am_peak").when(h < 16, "midday").when(h < 19, "pm_peak").otherwise("evening")


def parse_timestamp(v: Column) -> Column:
    """Seconds since the epoch, as number or text, or RFC 3339; anything else is NULL."""
    s = v.cast("string")
    return F.coalesce(F.timestamp_seconds(s.try_cast("double")), F.try_to_timestamp(s))


def wilson_interval(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    n = F.nullif(n, F.lit(0))
    p = successes / n
    mid, width = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.when(n.isNotNull(), F.greatest((mid - width) / scale, F.lit(0.0))), F.when(n.isNotNull(), F.least((mid + width) / scale, F.lit(1.0)))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; NULL for a constant side."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


#: Pattern on the lower-cased name, brand; the first match counts (fixed values).
OPERATORS = [
    (r"v[eé]lib|smovengo", "Vélib' Métropole"),
    (r"jcdecaux|cyclocity", "JCDecaux"),
    (r"\blime\b", "Lime"),
    (r"\bdott\b", "Dott"),
    (r"\btier\b", "TIER"),
    (r"\bvoi\b", "Voi"),
    (r"\bbird\b", "Bird"),
    (r"\bpony\b", "Pony"),
    (r"nextbike", "Nextbike"),
    (r"donkey", "Donkey Republic"),
    (r"citi\s?bike|\blyft\b|motivate", "Lyft / Motivate"),
    (r"\bbixi\b", "BIXI"),
    (r"divvy", "Divvy"),
    (r"capital bikeshare|\bcabi\b", "Capital Bikeshare"),
    (r"\bmobi\b", "Mobi"),
    (r"ecobici", "Ecobici"),
    (r"call a bike|callabike", "Call a Bike"),
    (r"\bbcycle\b", "BCycle"),
    (r"veturilo", "Veturilo"),
    (r"\bspin\b", "Spin"),
]


def normalize_operator(value: Column, default: Column | None = None) -> Column:
    """Brand of an operator's name; a name without a match stays, or becomes the default."""
    low = F.lower(value)
    out = F.when(value.isNull(), default if default is not None else F.lit(None))
    for pattern, brand in OPERATORS:
        out = out.when(low.rlike(pattern), brand)
    return out.otherwise(default if default is not None else value)
