"""A training corpus from `documents`: languages, toxicity, near duplicates, the mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. It works on all rows that the one before kept; all
but the last return the columns of documents.

Defined results: null, empty and letterless texts go at the first stage, which rejects what it can't identify; so do rows
without any learned language. Very long texts are treated whole. Of tied and repeated rows one stays at the third
stage: the smallest doc_id of a class, null last. Rows with null doc_id are documents like others. Without labels nothing
is toxic. Extra columns go through all stages but the last, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narraplan.llm import language, mixing, ngram_join, packing, toxicity
from narraplan.llm.common import free_name, written
from narraplan.llm.queries import BYTE_VOCABULARY, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that language identification rejects."""
    own = free_name(docs.columns, "language")
    found = language.identified(docs, language.fit(docs), own)
    return found.where(~F.col(f"{own}.rejected")).drop(own)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents predicted toxic by a lexicon learned from the labels of documents still here."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    own = free_name(docs.columns, "toxicity")
    return toxicity.scored(docs, lexicon, own).where(F.col(f"{own}.predicted") == 0).drop(own)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return ngram_join.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, BYTE_VOCABULARY)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned models and the tokenizer have no SQL form; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
