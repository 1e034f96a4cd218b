"""Training-data pipeline over `documents`: language ID, toxicity, near-dedup, decontamination, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame and works on all that the one before it kept; stages are
written as Parquet to the shared folder and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import decontam, langid, packing, simhash_dedup, toxicity
from ledgerloom.llm.common import fresh, shared_dir
from ledgerloom.llm.queries import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: no letter, or two languages about equally likely (scores less than 0.2 apart)."""
    found = fresh(docs, "language")
    named = docs.withColumn(found, langid.identifier(docs, margin=0.2)("text"))
    return named.where((F.col(found)["lang_pred"] != "und") & ~F.col(found)["ambiguous"]).drop(found)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score is 0.5 or more."""
    score = fresh(docs, "score")
    return docs.withColumn(score, toxicity.scorer(docs, table(spark, sf_dir, "labels"))("text")).where(F.col(score) < 0.5).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near-duplicates, that with the smallest doc_id."""
    return simhash_dedup.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a passage copied from a benchmark item."""
    leaks = fresh(docs, "leaks")
    return decontam.scan(docs, table(spark, sf_dir, "benchmark"), docs.columns, out_col=leaks).where(F.size(leaks) == 0).drop(leaks)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [("language ID", language_id), ("toxicity", toxic), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("best-fit packing", pack)]

#: The trained stages have no SQL form; tests hold run() against brute-force versions.
ORACLE_SQL = None


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder by Spark's own file system, wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; a stage's folder is deleted when the next one's is written, so the last is left."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            removed(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
