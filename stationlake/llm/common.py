"""Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "__"
BATCH_BYTES = 4 << 20  # of an Arrow batch; a batch of rows counted alone could hold as many very long texts


def table(spark: SparkSession, sf_dir: str, name: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """A table of a test-data folder. The session's Arrow batches are bounded by bytes from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch_bytes)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of text in all rows."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def blocks(total: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(total / each))


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the folder that the driver and all executors share. It is named by spark.checkpoint.dir; without that
    setting only a local session, whose executors are the driver itself, may use a folder of this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = "/tmp/stationlake-checkpoints"
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def give_back() -> None:
    """Returns memory that a worker's allocators keep for later to the system; the worker goes on to other tasks, beside others
    on the executor. Does nothing where the C library can't."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def deleted(spark: SparkSession, path: str) -> None:
    """Removes a written table that is no longer needed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str, kept: list[str] | None = None) -> DataFrame:
    """df as a table written to the shared folder: its lineage ends there, and a lost executor costs no recomputation. Its
    path is added to `kept`, so that it can be deleted when nothing needs it any more."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    if kept is not None:
        kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, or others like them that no column of df has."""
    out = []
    for name in names:
        while name.lower() in (c.lower() for c in (*df.columns, *out)):
            name += "_"
        out.append(name)
    return out


HOT_SHARE = 1000  # a key with more than one in so many rows is hot; there are at most so many hot keys


def spread_join(many: DataFrame, one: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """many joined with `one`, which has one row per key and in column n the number of the key's rows in `many`, of `total`.
    Rows of hot keys, at most HOT_SHARE keys, meet theirs by broadcast where they lie, so no key is one task's work; all
    others are shuffled."""
    hot = F.coalesce(F.col(n) * HOT_SHARE > total, F.lit(False))
    rest = many.join(F.broadcast(one.where(hot).select(key)), key, "left_anti").join(one.where(~hot), key)
    return rest.unionByName(many.join(F.broadcast(one.where(hot)), key))
