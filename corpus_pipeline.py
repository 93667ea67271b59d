"""From documents to shards in five stages; each reads what the one before it wrote.

Every stage is a function of (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import forget, free_name, materialize
from tracewell.llm.decontam import without_leaks
from tracewell.llm.mixing import mixed_documents
from tracewell.llm.near_duplicates import drop_near_duplicates
from tracewell.llm.quality import fit, with_scores
from tracewell.llm.sharding import shard_documents

#: Score below which a document is rejected: its rejection is then likelier right than wrong.
REJECT = 0.5


def warehouse(spark: SparkSession) -> str:
    """The folder of tables, which outlives the session."""
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that the classifier scores low; null and empty texts are scored like any other, repeated
    rows alike. No documents: none."""
    model, score = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), free_name(docs, "score")
    return with_scores(docs, model, to=score).where(F.col(score) >= REJECT).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one with the least doc_id; texts without words are one group."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item; null and empty texts hold none. An empty benchmark leaves all."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the sources' words to their target weights; null sources are one source, texts without words give no rows."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the documents as shards, which stay, and returns where each is; no documents: no rows."""
    return shard_documents(docs, f"{warehouse(spark)}/corpus-shards-{uuid.uuid4().hex}")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The classifier is learnt and the fingerprints are no SQL functions; tests/llm holds each stage against a brute-force version, in run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, root: str | None = None) -> DataFrame:
    """Where each document of the corpus is; the shards are below ``root``, or in the warehouse.

    A stage's output is deleted once the next one's is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, old = materialize(stage(spark, docs, sf_dir), f"stage-{name}"), docs
        forget(old)
    if root is None:
        return sharding(spark, docs, sf_dir)
    return shard_documents(docs, root)
