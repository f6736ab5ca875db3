"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Toxic documents go; one document of each near-duplicate class stays; passages of the benchmark and confirmed secrets are
cut out of the texts that stay; the last stage encodes them and returns their ids. Every stage keeps clean documents as they
are. n_chars follows the text that a stage has changed.

Null and empty texts pass all stages: they have no features, no copies (each is its own class), no passages and no secrets,
and encode to no ids. Long texts are worked on whole. Of repeated rows, equal in id and text, one stays. Null ids are ids like
others. Other columns, whatever their names, pass all stages but the last; an empty table gives no rows, and empty `labels`
or `benchmark` reject and cut nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.llm.bpe import round_trip
from stationlake.llm.classify import fit_toxicity, scored
from stationlake.llm.common import fresh, shared_folder, table
from stationlake.llm.fmindex import remove_spans
from stationlake.llm.neardup import drop_near_duplicates
from stationlake.llm.secrets import redact


def _sized(new: DataFrame) -> DataFrame:
    return new.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in new.columns else new


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counterfactually regularised classifier does not reject."""
    model = fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    (name,) = fresh(docs, "__score")
    return scored(docs, model, name).where((F.col(name) < 0.5) | F.lit(not model.weights.any())).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that they share with the benchmark."""
    return _sized(remove_spans(docs, table(spark, sf_dir, "benchmark")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets masked."""
    return _sized(redact(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, their digest and that of the text decoded from them, and whether that is the text."""
    return round_trip(docs, keep_ids=True)


STAGES = [("toxicity", toxicity), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens)]

#: Classifier, sketches and tokeniser have no SQL form; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
