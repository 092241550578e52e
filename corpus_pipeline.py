"""From raw documents to packed training sequences: language, near duplicates, secrets, source mix, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwave.llm import jaccard_join, language_id, packing, secret_forest, source_mix
from barwave.llm.common import pass_few_bytes
from barwave.llm.queries import shared_folder

MIN_LANGUAGE_SCORE = 0.3
KEEP_WORDS = 100_000  # the stages before leave less room in an executor than packing has by itself


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network names with a score of at least ``MIN_LANGUAGE_SCORE``; null, empty and letterless texts go."""
    pass_few_bytes(spark)
    net = language_id.learn(docs.select(F.col("doc_id").alias("key"), "text", "lang"))
    found = language_id.identify(docs["text"], net)
    return docs.filter((found["lang_pred"] != language_id.UNKNOWN) & (found["score"] >= MIN_LANGUAGE_SCORE))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingle similarity of 0.8 or more connects: the one of smallest doc_id."""
    pass_few_bytes(spark)
    return jaccard_join.keep_first(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what the forest takes for a secret masked in the text."""
    return secret_forest.redact(docs, secret_forest.scan(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; weights 5, 2, 1 over the sources, at most three passes."""
    return source_mix.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, keep_words=KEEP_WORDS))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_known_language),
    ("jaccard_join", keep_one_of_near_duplicates),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: The trained stages can't be told in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
