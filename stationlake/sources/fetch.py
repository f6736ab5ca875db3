"""Live feeds: documents over HTTP (or file addresses) to document frames, one system or many.

Executors fetch; what reaches the driver is only what the caller collects. A failure is a row with an error, never a failed
job. A getter, a callable from (address, headers) to `Response`, can be put in place of the network.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..errors import DiscoveryError, FetchError, NotModified
from ..operators import audit, frames, service
from . import feeds, lake

AGENT = "stationlake"
DOCUMENT = "system_id string, feed string, url string, gbfs_version string, fetched_at timestamp, body string, error string"
#: Names under which feeds are published, newer ones first (fixed values).
NAMES = {
    "station_information": ("station_information",), "station_status": ("station_status",), "vehicles": ("vehicle_status", "free_bike_status"), "vehicle_types": ("vehicle_types",),
    "geofencing_zones": ("geofencing_zones",), "system_regions": ("system_regions",), "alerts": ("system_alerts",), "system_information": ("system_information",), "pricing_plans": ("system_pricing_plans",),
}
_NORMAL = {
    "station_information": feeds.station_info, "station_status": feeds.station_status, "vehicles": feeds.vehicles, "vehicle_types": feeds.vehicle_types, "geofencing_zones": feeds.geofencing,
    "system_regions": feeds.system_regions, "alerts": feeds.alerts, "system_information": feeds.system_information, "pricing_plans": feeds.pricing_plans,
}


class Response(NamedTuple):
    status: int
    headers: dict[str, str]
    body: str


class FeedResponse(NamedTuple):
    data: dict
    etag: str | None
    last_modified: str | None


Getter = Callable[[str, dict[str, str]], Response]


@dataclass
class Http:
    """The default getter: tries again on transient states, after waits that double."""

    tries: int = 4
    backoff: float = 0.5
    transient: tuple[int, ...] = (429, 500, 502, 503, 504)
    timeout: float = 30
    wait: Callable[[float], None] = field(default=time.sleep, repr=False)

    def _once(self, url: str, headers: dict[str, str]) -> Response:
        asked = urllib.request.Request(url, headers={"User-Agent": AGENT, **headers})
        try:
            with urllib.request.urlopen(asked, timeout=self.timeout) as got:
                return Response(got.status or 200, {k.lower(): v for k, v in got.headers.items()}, got.read().decode("utf-8", "replace"))
        except urllib.error.HTTPError as e:
            return Response(e.code, {k.lower(): v for k, v in e.headers.items()}, "")

    def __call__(self, url: str, headers: dict[str, str]) -> Response:
        for i in range(self.tries):
            try:
                got = self._once(url, headers)
                if got.status not in self.transient or i == self.tries - 1:
                    return got
            except (OSError, ValueError) as e:
                if i == self.tries - 1 or isinstance(e, ValueError):
                    raise FetchError(f"{url}: {e}") from e
            self.wait(self.backoff * 2**i)
        raise FetchError(url)


def fetch_json(url: str, *, getter: Getter | None = None, etag: str | None = None, last_modified: str | None = None) -> FeedResponse:
    """A document with the tags to ask for newer ones with. NotModified if there is none newer."""
    headers = ({"If-None-Match": etag} if etag else {}) | ({"If-Modified-Since": last_modified} if last_modified else {})
    got = (getter or Http())(url, headers)
    if got.status == 304:
        raise NotModified(url)
    if not 200 <= got.status < 300:
        raise FetchError(f"{url}: status {got.status}")
    try:
        data = json.loads(got.body)
    except ValueError as e:
        raise FetchError(f"{url}: {e}") from e
    if not isinstance(data, dict):
        raise FetchError(f"{url}: no JSON object")
    return FeedResponse(data, got.headers.get("etag"), got.headers.get("last-modified"))


def listed_feeds(document: dict, language: str | None = None) -> tuple[dict[str, str], str]:
    """Addresses by feed name, and the version; version 2 lists them per language: the one asked for, else the first."""
    data = document.get("data") or {}
    found = data.get("feeds")
    if found is None:
        found = (data.get(language) or next(iter(data.values()), None) or {}).get("feeds", [])
    return {f["name"]: f["url"] for f in found if f.get("name") and f.get("url")}, str(document.get("version", "2.x"))


class Feed:
    """One system: documents are fetched when first needed and kept; each method gives a canonical frame. Without a system id its
    address names it."""

    def __init__(self, spark: SparkSession, url: str | None, *, system_id: str | None = None, language: str | None = None, getter: Getter | None = None):
        self.spark, self.url, self.system_id, self._language, self.getter = spark, url, system_id or url, language, getter
        self._document: dict | None = None
        self._bodies: dict[str, tuple[datetime, str]] = {}

    @classmethod
    def from_system_id(cls, catalog: DataFrame, system_id: str, **options) -> Feed:
        return cls(catalog.sparkSession, feeds.resolve(catalog, system_id), system_id=system_id, **options)

    @property
    def document(self) -> dict:
        if self._document is None:
            if not self.url:
                raise DiscoveryError("the system has no discovery address")
            self._document = fetch_json(self.url, getter=self.getter).data
        return self._document

    @property
    def language(self) -> str | None:
        return self._language

    @language.setter
    def language(self, value: str | None) -> None:
        self._language, self._document, self._bodies = value, None, {}

    @property
    def feeds(self) -> dict[str, str]:
        return listed_feeds(self.document, self._language)[0]

    @property
    def version(self) -> str:
        return listed_feeds(self.document, self._language)[1]

    @property
    def ttl(self) -> float | None:
        return self.document.get("ttl")

    @property
    def last_updated(self) -> datetime | None:
        at = self.document.get("last_updated")
        if isinstance(at, str):
            return datetime.fromisoformat(at)
        return datetime.fromtimestamp(at, timezone.utc) if at else None

    @property
    def timezone(self) -> str | None:
        row = self.system_information().first() if self.has("system_information") else None
        return row.timezone if row else None

    def has(self, *kinds: str) -> bool:
        """Does the system publish one of these, under any of their names?"""
        return any(n in self.feeds for k in kinds for n in NAMES.get(k, (k,)))

    def documents(self, kind: str) -> DataFrame:
        """The document as a frame of one row."""
        name = next((n for n in NAMES.get(kind, (kind,)) if n in self.feeds), None)
        if name is None:
            raise DiscoveryError(f"no {kind} among {sorted(self.feeds)}")
        if name not in self._bodies:
            self._bodies[name] = (datetime.now(timezone.utc), json.dumps(fetch_json(self.feeds[name], getter=self.getter).data))
        at, body = self._bodies[name]
        return self.spark.createDataFrame([(self.system_id, self.version, at, body)], "system_id string, gbfs_version string, fetched_at timestamp, body string")

    def frame(self, kind: str) -> DataFrame:
        return _NORMAL[kind](self.documents(kind))

    def __getattr__(self, kind: str):
        if kind in _NORMAL:
            return lambda: self.frame(kind)
        raise AttributeError(kind)

    def availability(self) -> DataFrame:
        """Live counts joined with the inventory."""
        return frames.join_availability(self.station_information(), self.station_status())

    def to_local_time(self, df: DataFrame, *columns: str) -> DataFrame:
        """df with the system's wall clock in place of the columns (fetched_at if none is named); as it is without a zone."""
        zone = self.timezone
        for c in (columns or ("fetched_at",)) if zone else ():
            df = lake.local_time(df, zone, time=c, name=c)
        return df

    def audit(self, **options) -> DataFrame:
        """Static verdicts, and dynamic ones where counts are published; what is stale follows from the feed's ttl."""
        if self.has("station_status"):
            return audit.audit_frames(self.station_information(), self.station_status(), ttl_seconds=self.ttl, **options)
        return audit.audit_static(self.station_information()).select(F.lit("static").alias("layer"), "system_id", "station_id", "flagged", "reason")

    def reconcile_fleet(self) -> DataFrame:
        none = lambda kind: _NORMAL[kind](self.spark.createDataFrame([], "system_id string, gbfs_version string, fetched_at timestamp, body string"))
        status, vehicles = (self.frame(k) if self.has(k) else none(k) for k in ("station_status", "vehicles"))
        return service.reconcile_fleet(status, vehicles)

    def snapshot(self) -> dict[str, DataFrame]:
        return {name: self.frame(kind) for name, kind in (("information", "station_information"), ("status", "station_status"), ("vehicles", "vehicles")) if self.has(kind)}

    def summary(self) -> dict:
        """System, version, feeds, and what the published ones count."""
        out = {"system_id": self.system_id, "gbfs_version": self.version, "feeds": sorted(self.feeds)}
        if self.has("station_information"):
            out["total_stations"] = self.station_information().count()
        if self.has("station_status"):
            age = (F.unix_micros("fetched_at") - F.unix_micros("last_reported")) / 60e6
            row = self.station_status().agg(F.coalesce(F.sum("num_bikes_available"), F.lit(0)).alias("n"), F.round(F.median(age), 1).alias("m")).first()
            out |= {"total_bikes_available": row.n, "feed_staleness_min": row.m}
        if self.has("vehicles"):
            out["total_vehicles"] = self.vehicles().count()
        return out


def availability(spark: SparkSession, url: str, **options) -> DataFrame:
    return Feed(spark, url, **options).availability()


def audit_feed(spark: SparkSession, url: str, **options) -> DataFrame:
    return Feed(spark, url, **options).audit()


# --- many systems ----------------------------------------------------------------------------------------------------


def system_rows(system_id: str | None, url: str | None, kinds: list[str], getter: Getter | None) -> Iterator[tuple]:
    """Documents of one system, a row each; a feed or system that fails is a row with an error."""
    now = lambda: datetime.now(timezone.utc)
    try:
        if not url:
            raise DiscoveryError("the system has no discovery address")
        names, version = listed_feeds(fetch_json(url, getter=getter).data)
    except Exception as e:  # noqa: BLE001  one system must not sink the others
        yield system_id, None, url, None, now(), None, f"{type(e).__name__}: {e}"
        return
    for kind in kinds:
        name = next((n for n in NAMES.get(kind, (kind,)) if n in names), None)
        try:
            if name is None:
                raise DiscoveryError(f"no {kind}")
            yield system_id, kind, names[name], version, now(), json.dumps(fetch_json(names[name], getter=getter).data), None
        except Exception as e:  # noqa: BLE001
            yield system_id, kind, names.get(name or ""), version, now(), None, f"{type(e).__name__}: {e}"


def fetch_many(systems: DataFrame, *, kinds: tuple[str, ...] = ("station_information", "station_status"), getter: Getter | None = None, at_once: int = 8) -> DataFrame:
    """Documents of all systems (system_id, url), fetched by `at_once` tasks or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for s, u in zip(pdf["system_id"], pdf["url"]) for r in system_rows(s, u, list(kinds), getter)]
            yield pd.DataFrame(rows, columns=["system_id", "feed", "url", "gbfs_version", "fetched_at", "body", "error"])

    return systems.select("system_id", "url").repartition(at_once, "system_id").mapInPandas(run, DOCUMENT)


def audit_catalogue(systems: DataFrame, *, getter: Getter | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Verdicts of all reachable systems' stations, and (system_id, status): ok with the number of stations, unreachable or no
    station_information with the error's class, or empty."""
    from ..plans.components import stored

    docs = stored(fetch_many(systems, kinds=("station_information",), getter=getter))  # both results need it; fetched once
    info = feeds.station_info(docs.where("error is null"))
    n = info.groupBy("system_id").agg(F.count("*").alias("n"))
    kind = F.substring_index("error", ":", 1)
    status = F.when(F.col("feed").isNull(), F.concat(F.lit("unreachable: "), kind)).when(F.col("error").isNotNull(), F.concat(F.lit("no station_information: "), kind)).when(F.col("n").isNull(), "empty").otherwise(F.concat(F.lit("ok: "), F.col("n"), F.lit(" stations")))
    return audit.audit_static(info, **options), docs.join(n, "system_id", "left").select("system_id", status.alias("status"))


class FeedSource(DataSource):
    """`spark.read.format("station_feeds")` and readStream: options `systems` (JSON object of addresses by system id) and
    `kinds` (comma-joined). Each system is a partition. A stream polls all systems every `every` seconds (60)."""

    @classmethod
    def name(cls) -> str:
        return "station_feeds"

    def schema(self) -> str:
        return DOCUMENT

    def _asked(self) -> tuple[list, list[str]]:
        return list(json.loads(self.options["systems"]).items()), self.options.get("kinds", "station_information,station_status").split(",")

    def reader(self, schema) -> DataSourceReader:
        return _Batch(*self._asked())

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802  the name that the interface asks for
        return _Polls(*self._asked(), float(self.options.get("every", "60")))


class _System(InputPartition):
    def __init__(self, system_id: str, url: str):
        super().__init__(system_id)
        self.system_id, self.url = system_id, url


class _Batch(DataSourceReader):
    def __init__(self, systems: list, kinds: list[str]):
        self.systems, self.kinds = systems, kinds

    def partitions(self):
        return [_System(s, u) for s, u in self.systems]

    def read(self, partition):
        return system_rows(partition.system_id, partition.url, self.kinds, None)


class _Polls(SimpleDataSourceStreamReader):
    def __init__(self, systems: list, kinds: list[str], every: float):
        self.systems, self.kinds, self.every = systems, kinds, every
        self.last: float | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"poll": 0}

    def _rows(self) -> list[tuple]:
        return [r for s, u in self.systems for r in system_rows(s, u, self.kinds, None)]

    def read(self, start: dict):
        if self.last is not None and time.monotonic() - self.last < self.every:
            return iter(()), start  # nothing new yet
        self.last = time.monotonic()
        return iter(self._rows()), {"poll": start["poll"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict):  # noqa: N802  a poll can't be repeated: what is there now stands for it
        return iter(self._rows())


# --- catalogue of systems and example --------------------------------------------------------------------------------

_CATALOGS: dict[str, str] = {}


def catalog(spark: SparkSession, source: str, *, cache: str | None = None, refresh: bool = False, getter: Getter | None = None) -> DataFrame:
    """The systems catalogue from an address or a path that Spark reads. An address is fetched once per process; `cache`, a
    file, keeps it and stands in when it can't be fetched."""
    if "://" not in source or source.startswith("file:"):
        return feeds.systems_catalog(spark, source)
    if refresh or source not in _CATALOGS:
        try:
            got = (getter or Http())(source, {})
            if got.status != 200:
                raise FetchError(f"{source}: status {got.status}")
            _CATALOGS[source] = got.body
            if cache:
                with open(cache, "w", encoding="utf-8") as f:
                    f.write(got.body)
        except OSError:
            if not cache:
                raise
            with open(cache, encoding="utf-8") as f:
                _CATALOGS[source] = f.read()
    import csv
    import io

    rows = list(csv.reader(io.StringIO(_CATALOGS[source])))
    names = [c.strip().lower().replace(" ", "_") for c in rows[0]]
    return spark.createDataFrame([tuple((x or None) for x in r) for r in rows[1:] if r], ", ".join(f"`{c}` string" for c in names))


def example(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Inventory and counts of a small invented system, through the normalisers; read at 2026-01-05 08:00 UTC."""
    at = datetime(2026, 1, 5, 8, tzinfo=timezone.utc)
    stations = [{"station_id": f"p{i}", "name": f"Place {i}", "lat": 48.85 + i * 0.004, "lon": 2.33 + (i * 7 % 8) * 0.006, "capacity": 15 + 5 * (i % 4)} for i in range(8)]
    counts = [{"station_id": s["station_id"], "num_bikes_available": (i * 5) % (s["capacity"] + 1), "num_docks_available": s["capacity"] - (i * 5) % (s["capacity"] + 1), "is_renting": True, "is_returning": True, "is_installed": True, "last_reported": int(at.timestamp()) - 60 * i} for i, s in enumerate(stations)]
    docs = [spark.createDataFrame([("example", "2.3", at, json.dumps({"data": {"stations": x}}))], "system_id string, gbfs_version string, fetched_at timestamp, body string") for x in (stations, counts)]
    return feeds.station_info(docs[0]), feeds.station_status(docs[1])
