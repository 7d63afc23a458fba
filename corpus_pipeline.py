"""The corpus pipeline: toxicity, SimHash near-duplicates, secrets, packing; each stage is one operator of reelframe.llm.

Rows with a null doc_id pass the near-duplicate stage. Stages work on all rows the one before kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe import ship
from reelframe.llm.common import work_dir
from reelframe.llm.packing import pack_documents
from reelframe.llm.secrets import redact_secrets
from reelframe.llm.simhash import drop_near_duplicates
from reelframe.llm.toxicity import drop_toxic, fit_severity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones, doesn't call toxic."""
    ship(spark)
    return drop_toxic(docs, fit_severity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest doc_id."""
    ship(spark)
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    ship(spark)
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of at most 1024 tokens."""
    ship(spark)
    found = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))


STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: SQL can express neither the fitted model nor XXH64 fingerprints; tests compare each stage with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        path = work_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
