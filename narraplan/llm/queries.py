"""Registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narraplan.llm import conversation_repair, edit_counts, fingerprints, language, line_dedup, mixing, ngram_join, packing, sharding, token_alignment, token_files, toxicity, vector_join

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECE_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = sharding.new_folder(spark)
    sharding.write_shards(docs, folder)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return sharding.read_shards(spark, folder, docs.schema, n_bytes).select("doc_id", n_bytes.alias("n_bytes"), "shard.*")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold != 0)
    return toxicity.scored(docs, lexicon).select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "toxicity.score", "toxicity.predicted")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = language.fit(docs.where(fold != 1))
    return language.identified(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score", "language.rejected")


def op7_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of every document: at a third, 16 code points become the text's first 16; a word is added at two thirds."""
    n = F.coalesce(F.length("text"), F.lit(0))
    edits = F.array(
        F.struct(F.floor(n / 3).alias("at"), F.lit(16).alias("cut"), F.substring("text", 1, 16).alias("put")),
        F.struct(F.floor(n * 2 / 3).alias("at"), F.lit(0).alias("cut"), F.lit(" edited").alias("put")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", edits)
    return edit_counts.counts_after_edits(docs, "edits", BYTE_VOCABULARY)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    token_files.write_token_files(table(spark, sf_dir, "documents"), WORD_VOCABULARY, folder)
    return token_files.token_digests(spark, folder)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.linked_counts(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, PIECE_VOCABULARY)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_sharding, op3_toxicity, op4_packing, op5_fingerprints, op6_language_id, op7_vector_near_dedup,
    op8_token_counts, op9_mixing, op10_token_files, op11_token_alignment, op12_conversation_repair, op13_line_dedup)}
ORACLE = {"op1_ngram_jaccard_join": ngram_join.ORACLE, "op2_sharding": sharding.ORACLE, "op7_vector_near_dedup": vector_join.ORACLE, "op9_mixing": mixing.ORACLE,
          "op12_conversation_repair": conversation_repair.ORACLE, "op13_line_dedup": line_dedup.ORACLE}
