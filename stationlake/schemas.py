"""Canonical schemas, thresholds and column guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_T = {"S": "string", "D": "double", "L": "bigint", "B": "boolean", "T": "timestamp"}


def _schema(spec: str) -> dict[str, str]:
    return {n: _T[t] for n, t in (x.split(":") for x in spec.split())}


#: Column contracts by name (fixed values).
SCHEMAS = {
    "station_info": _schema("system_id:S station_id:S name:S lat:D lon:D capacity:L station_type:S is_virtual_station:B region_id:S"),
    "station_status": _schema("system_id:S station_id:S num_bikes_available:L num_docks_available:L is_renting:B is_returning:B is_installed:B last_reported:T fetched_at:T gbfs_version:S"),
    "vehicle_status": _schema("system_id:S vehicle_id:S station_id:S vehicle_type_id:S lat:D lon:D is_reserved:B is_disabled:B current_range_meters:D current_fuel_percent:D pricing_plan_id:S fetched_at:T gbfs_version:S"),
    "vehicle_types": _schema("system_id:S vehicle_type_id:S form_factor:S propulsion_type:S max_range_meters:D"),
    "station_vehicle_counts": _schema("system_id:S station_id:S vehicle_type_id:S num_vehicles_available:L fetched_at:T"),
    "pricing_plans": _schema("system_id:S plan_id:S name:S currency:S price:D is_taxable:B description:S"),
    "system_regions": _schema("system_id:S region_id:S name:S"),
    "alerts": _schema("system_id:S alert_id:S type:S summary:S description:S start:T end:T last_updated:T"),
    "geofencing": _schema("system_id:S zone_id:S name:S ride_allowed:B ride_through_allowed:B maximum_speed_kph:D station_parking:B"),
}
KEYS = ("system_id", "station_id")


class SchemaError(ValueError, KeyError):
    """Columns are missing; carries what was missing and what was there."""

    def __init__(self, missing: list[str], present: list[str], what: str):
        self.missing, self.present, self.what = missing, present, what
        super().__init__(f"{what} lacks {', '.join(missing)}; it has {', '.join(present)}")


def require_columns(df: DataFrame, columns, *, what: str = "the frame") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaError(missing, df.columns, what)
    return df


def validate_schema(df: DataFrame, schema: str) -> DataFrame:
    return require_columns(df, SCHEMAS[schema], what=schema)


def coerce_schema(df: DataFrame, schema: str) -> DataFrame:
    """Casts the contract's columns that are present; what can't be cast becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in SCHEMAS[schema].items() if c in df.columns})
