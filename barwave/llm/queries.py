"""Queries over the given tables, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwave.llm import adaptive_rules, brown_lm, conversation_trie, edit_fingerprints, exact_dedup, jaccard_join, language_id, line_crf, packing, rtree_negatives, secret_forest, source_mix, wavelet_tokens
from barwave.llm.common import crc_mod, ensure_checkpoint_dir, n_words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


@query
def op1_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.scan(documents(spark, sf_dir)).drop("text_key")


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(documents(spark, sf_dir))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", crc_mod(F.col("doc_id"), 4) == 2)
    net = language_id.learn(docs.filter(~F.col("held_out")).withColumnRenamed("doc_id", "key"))
    return docs.select("doc_id", "held_out", language_id.identify(F.col("text"), net).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


@query
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return source_mix.mix_sources(docs.select("doc_id", "source", n_words(docs["text"]).alias("size"))).drop("source")


ORACLES["op4_source_mix"] = source_mix.ORACLE_SQL.format(documents="documents")


@query
def op5_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints.edited_likeness(documents(spark, sf_dir))


@query
def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 5) == 1
    return brown_lm.score(docs, ~held_out).withColumn("held_out", held_out)


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=1))


@query
def op8_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_rules.judge(adaptive_rules.measures(documents(spark, sf_dir))).drop("lang", "source", "n_lines")


ORACLES["op8_adaptive_rules"] = adaptive_rules.ORACLE_SQL


@query
def op9_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens"
    wavelet_tokens.write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return wavelet_tokens.read_tokens(spark, path)


@query
def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    crf = line_crf.learn(docs.filter(~F.col("held_out")).join(labels, "doc_id").withColumnRenamed("doc_id", "key"))
    scored = docs.select("doc_id", "held_out", line_crf.text_quality(F.col("text"), crf).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), digest_all=True).drop("n_chars")


ORACLES["op11_exact_dedup"] = exact_dedup.ORACLE_SQL


@query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLES["op12_conversation_trie"] = conversation_trie.ORACLE_SQL


@query
def op13_rtree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = rtree_negatives.relabelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rtree_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


ORACLES["op13_rtree_negatives"] = rtree_negatives.ORACLE_SQL
