"""The corpus pipeline: five stages over ``documents``.

Documents that the toxicity classifier rejects go; one document of each group
of near-duplicates stays; documents that hold a benchmark item go; personal
data gets surrogates; the texts become SentencePiece ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm import decontamination, pii_surrogates, sentencepieces, shingle_dedup, toxicity
from strataflow.llm.common import shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the documents at hand that ``labels`` covers; thresholds by language."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By SimHash over five-word shingles, and the exact join for what fingerprints miss: similarity of at least 0.8 (op6's
    contract of 3 words and 2 bits is the query's alone)."""
    return shingle_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars`` follows the new text."""
    got = pii_surrogates.replace(docs).select(*docs.columns)
    return got.withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_tokens``."""
    return sentencepieces.encode(docs, sentencepieces.load()).withColumn("n_tokens", F.size("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii_surrogates", replace_personal_data),
    ("sentencepieces", encode),
]

#: Trained weights and a Viterbi fold are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
    return docs
