"""Corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's documents.

The quality classifier drops what it rejects, the n-gram Jaccard join leaves one document of each group, secrets are
redacted, the sources are mixed to their target weights (documents may then repeat), and byte-level BPE encodes the mix.
All stages but the last return the columns of documents.

Defined results: null and empty texts have no quality indicators, so the score of the bias decides whether they stay; they
are near duplicates of nothing, hold no secrets, count 0 words in the mix and have no ids. Repeated rows of one id and text
become one row; rows of one id and different texts, and those of null id, all pass the near-duplicate stage. Null sources
are one source. Ties go to the smaller doc_id. Extra columns, whatever their names, go with their rows to the mix; an empty
table gives an empty table at every stage, and without labels of both classes every score is 0.5, so nothing is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import bpe, jaccard, mixing, nbsvm, secrets, shared
from lattica.session import ship_package

#: Documents of a lower quality score are rejected: those that the operator predicts as 0.
LEAST_QUALITY = nbsvm.LEAST


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    model = nbsvm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return nbsvm.scored(docs, model, keep=LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return jaccard.deduplicated(docs, k=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship_package(spark)
    return bpe.tokenized(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("mix_sources", mix_sources),
    ("byte_level_bpe", byte_level_bpe),
]

#: A fitted classifier, a hash-threshold mix and BPE are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
