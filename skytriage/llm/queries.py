"""Registered queries of this package, each over a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytriage.llm import ball_tree, decontaminate, divergence, embeddings, html_text, language, language_model, piecewise, sharding, simhash, token_counts, toxicity, transducer
from skytriage.llm.common import fold, table

TOKENIZER = "word_bpe_49k.json"


def op1_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return sharding.assign(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of the held-out fold are not read."""
    scored = toxicity.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold(F.col("doc_id"), toxicity.FOLDS) == toxicity.HELD_FOLD).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))


def op3_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of every document."""
    return language_model.score(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of what they decode to."""
    return transducer.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and representative of every vector."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; those of the held-out fold teach nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), docs)
    return found.select("doc_id", (fold(F.col("doc_id"), language.FOLDS) == language.HELD_FOLD).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold copies of benchmark items, exact or edited."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ, per pair and by their telling terms."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, of its edited text, and how like they are."""
    return piecewise.fingerprints(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for each benchmark item."""
    return ball_tree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_extendible_sharding, op2_toxicity, op3_pseudo_likelihood, op4_html_text, op5_token_counts, op6_bpe_codec,
                                   op7_embedding_near_dedup, op8_simhash_near_dedup, op9_language_id, op10_decontamination, op11_source_divergence, op12_piecewise_fingerprints, op13_lexical_search)}
#: The others learn, align or digest what SQL cannot express and are tested against brute force.
ORACLES = {"op1_extendible_sharding": sharding.ORACLE_SQL, "op11_source_divergence": divergence.ORACLE_SQL, "op13_lexical_search": ball_tree.ORACLE_SQL}
