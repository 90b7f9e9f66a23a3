"""From raw documents to packed training sequences, five stages of the text operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet in the shared folder and the next stage reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm.common import read_table, stash
from tidegrid.llm.exact_dedup import drop_duplicates
from tidegrid.llm.language import drop_unidentified
from tidegrid.llm.near_dedup import drop_near_duplicates
from tidegrid.llm.packing import pack_documents
from tidegrid.llm.secrets import redact
from tidegrid.llm.tokenizer_files import tokenizer_file


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose language can't be told (null texts and texts without a letter)."""
    return drop_unidentified(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the smallest doc_id stays."""
    return drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each connected group of near-duplicates (five words, 0.8) the smallest doc_id stays."""
    return drop_near_duplicates(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in all layers of a text are replaced by a mark; every document stays."""
    return redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and offset."""
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("secret_scan", secret_stage),
    ("best_fit_packing", packing_stage),
]

#: Profiles, min-hash groups, nested decoding and tokenizers can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
