"""Lake of snapshots: Parquet, partitioned by system_id and date."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flow

KEYS = ("system_id", "station_id")


def dated(df: DataFrame) -> DataFrame:
    return df if "date" in df.columns else df.withColumn("date", F.to_date(F.col("fetched_at").cast("timestamp")).cast("string"))


def append(df: DataFrame, path: str, *, partition_cols=("system_id", "date")) -> None:
    """Adds the rows; what is there stays. Rows of a partition are brought together first, so a write makes few files; a large
    partition is dealt over several by its stations."""
    df = dated(df)
    salt = [F.pmod(F.hash("station_id"), F.lit(8))] if "station_id" in df.columns else []
    df.repartition(*(F.col(c) for c in partition_cols), *salt).write.mode("append").partitionBy(*partition_cols).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The lake; keys of its folders stay texts. The setting that says so holds only while the folders are listed."""
    name = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    finally:
        spark.conf.set(name, before)


def _utc(t: datetime | str | None) -> datetime | None:
    if isinstance(t, str):
        t = datetime.fromisoformat(t)
    return t.replace(tzinfo=timezone.utc) if t is not None and t.tzinfo is None else t


def panel(spark: SparkSession, path: str, *, system_id: str | None = None, start=None, end=None, freq: str | None = None, dedup: bool = True, columns: list[str] | None = None, where: Column | str | None = None, tz: str | None = None) -> DataFrame:
    """Snapshots of a lake as one panel. Folders are pruned by system and day, columns at the scan. Of rows with the same
    last_reported the last poll stays, chosen among the days read and before the exact window (inclusive) applies. Times
    without a zone are UTC. tz adds local_time. freq resamples counts per station."""
    df = read(spark, path)
    start, end = _utc(start), _utc(end)
    if system_id is not None:
        df = df.where(F.col("system_id") == system_id)
    if start is not None:
        df = df.where(F.col("date") >= start.astimezone(timezone.utc).date().isoformat())
    if end is not None:
        df = df.where(F.col("date") <= end.astimezone(timezone.utc).date().isoformat())
    if where is not None:
        df = df.where(where)
    if columns is not None:
        wanted = dict.fromkeys([*KEYS, "fetched_at", *(["last_reported"] if "last_reported" in df.columns else []), *columns])
        df = df.select(*(c for c in wanted if c in df.columns))
    if dedup and "last_reported" in df.columns:
        df = flow.dedup_last(df)
    at = F.col("fetched_at").cast("timestamp")
    if start is not None:
        df = df.where(at >= F.lit(start))
    if end is not None:
        df = df.where(at <= F.lit(end))
    if freq is not None:
        df = flow.resample(df, freq, values=[c for c in (flow.BIKES, flow.DOCKS) if c in df.columns])
    return df if tz is None else local_time(df, tz)


def local_time(df: DataFrame, tz: str, *, time: str = "fetched_at", name: str = "local_time") -> DataFrame:
    """Adds the wall clock of a zone, as time without a zone; the instant stays."""
    return df.withColumn(name, F.from_utc_timestamp(F.col(time).cast("timestamp"), tz).cast("timestamp_ntz"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Each Parquet file with its size and SHA-256. Tasks list and hash the files a piece at a time, so their size doesn't
    matter; none reaches the driver."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for uri in pdf["path"]:
                system, name = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))
                digest = hashlib.sha256()
                with system.open_input_stream(name) as f:
                    while piece := f.read(8 << 20):
                        digest.update(piece)
                found.append(digest.hexdigest())
            yield pdf.assign(sha256=found)

    return files.select("path", F.col("length").alias("bytes")).mapInPandas(run, "path string, bytes long, sha256 string")


def summary(spark: SparkSession, path: str) -> DataFrame:
    """One row: rows, systems, first and last day of a lake."""
    return read(spark, path).agg(F.count("*").alias("n_rows"), F.count_distinct("system_id").alias("n_systems"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def geojson_features(df: DataFrame, *, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One GeoJSON point feature per row with coordinates, as text in `feature`; the other columns are its properties."""
    rest = [c for c in df.columns if c not in (lat, lon)]
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon).cast("double"), F.col(lat).cast("double")).alias("coordinates"))
    whole = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*rest).alias("properties") if rest else F.create_map().alias("properties"))
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("feature"))


def write_geojson(df: DataFrame, path: str, **columns) -> None:
    """Features as lines of text files (newline-delimited GeoJSON), which needs no task that holds all of them."""
    geojson_features(df, **columns).write.mode("errorifexists").text(path)
