"""From raw documents to token ids in five stages, each over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import jaccard_join, mixing, perplexity, quality_rules, sentencepiece_codec
from tessera.llm.common import materialise
from tessera.llm.queries import tokenizer_path


def keep_unrepetitive(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that are short or repeat themselves go."""
    return quality_rules.filter_documents(docs)


def keep_fluent(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents beyond their language's perplexity fence go."""
    cfg = perplexity.Settings()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return perplexity.reject(docs, perplexity.train(perplexity.trusted_rows(docs, labels), cfg), cfg)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each component stays, the least by id, vertex and text."""
    return jaccard_join.first_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: documents repeat for whole epochs, then a weighted sample."""
    return mixing.mix(docs)


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every row, with the check of their decoding."""
    return sentencepiece_codec.tokenise(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", keep_unrepetitive),
    ("quality classifier", keep_fluent),
    ("n-gram Jaccard join", keep_first_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece", to_token_ids),
]

#: Hashing, models and sampling can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
