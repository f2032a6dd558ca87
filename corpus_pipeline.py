"""From documents to token ids, in five stages; each works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.llm import decontam, langid, piece_bpe, similar, toxicity
from velum.llm.common import drop_folder, shared_folder, shuffles_dropped
from velum.llm.queries import piece_model
from velum.plans.catalog import spread


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned languages explain by half or more stay; null texts and those without a letter go."""
    return langid.identified(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the severity grade 0 stay, null and empty texts among them."""
    with shuffles_dropped(spark):  # those of the fit
        return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays. Null and empty texts are one class, and
    rows that repeat a kept id stay."""
    return similar.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window stay, null and empty texts among them."""
    return decontam.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, the end id last, and the digest of what they decode to. A null text has the end id
    alone. Every stage gives no rows for an empty table, and repeated rows the same result."""
    made = piece_bpe.with_round_trip(docs.select("doc_id", "text"), piece_model())
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic_documents),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", tokens),
]

#: SQL can't express the models, fingerprints and encodings; the tests compare with a version by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What each stage keeps is written to the shared folder, read again, and deleted when
    the next stage has read it; the last one's folder stays, as the result is read from it."""
    docs, before = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), None
    for name, stage in STAGES:
        folder = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        if before:
            drop_folder(spark, before)
        docs, before = spark.read.parquet(folder), folder
    return docs
