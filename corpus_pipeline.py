"""The corpus pipeline: quality, language, near-duplicates, personal data, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terravia.llm import langid, nearcopies, packing, pii, quality
from terravia.llm.common import discard, fresh_path, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.stage(docs)


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.stage(docs)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.stage(docs)


def _personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.stage(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.stage(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", _quality),
    ("language_id", _language),
    ("simhash_near_dedup", _near_duplicates),
    ("pii", _personal_data),
    ("best_fit_packing", _packing),
]

#: Language identification and packing have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet in the shared folder, read by the next and then removed."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            discard(before)
        docs, before = spark.read.parquet(path), path
    return docs
