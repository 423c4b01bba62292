"""A pipeline from raw documents to token ids.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and
read again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytriage.llm import decontaminate, language, simhash, toxicity, transducer
from skytriage.llm.common import table
from skytriage.llm.queries import TOKENIZER
from skytriage.session import durable, ensure_checkpoint_dir

#: A document stays if its most likely language has at least this probability.
LANGUAGE_SCORE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return docs.where(toxicity.score_column(docs, table(spark, sf_dir, "labels"))["score"] < 0.5)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be learned; texts without letters and undecided ones go."""
    found = language.language_column(docs)
    return docs.where((found["lang"] != language.UNKNOWN) & (found["score"] >= LANGUAGE_SCORE))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest id, null ids last, of rows that share it one.

    Rows are told apart by a number of their own, so what shares an id or has none, but not its text, stays.
    """
    numbered = durable(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")))
    order = F.struct(F.col("doc.doc_id").isNull().alias("absent"), F.col("doc.doc_id").alias("id"), "row")
    found = simhash.near_duplicates(numbered.select(order.alias("place"), F.col("doc.text").alias("text")), "place")
    kept = found.where(F.col("doc_id.row") == F.col("component_id.row")).select(F.col("doc_id.row").alias("row"))
    return numbered.join(kept, "row", "left_semi").select("doc.*")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of each document and of their decoded text."""
    return transducer.digest_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", drop_toxic), ("language", keep_known_language), ("near duplicates", drop_near_duplicates), ("benchmark", drop_benchmark_leaks), ("bpe", encode)]

#: Classifiers and the alignment are not expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; results between them go to the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
