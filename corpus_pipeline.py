"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sunloom.llm import digest_index, langid, mixing, packing, similar
from sunloom.llm.common import documents, spread, stage
from sunloom.llm.queries import tokenizer


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus; null texts, texts without letters and texts of no clear language go.

    Repeated rows stay or go together; an empty table stays empty, and other columns are carried along unread.
    """
    return langid.keep_known(spread(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text once (A-Z folded, null as empty): of equal texts the row with the largest doc_id stays, of rows that
    repeat doc_id and text one, and a row without doc_id where no equal text has one."""
    return digest_index.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more): the smallest doc_id,
    a row without doc_id where the group has none; texts without words are one group."""
    return similar.keep_first(spread(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, each row by its own size; null is a source like others, and
    texts without words go."""
    return mixing.take(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; ``row_id`` tells the copies of a document apart. A null text is one
    end token; a null doc_id stays null."""
    return packing.pack(spread(docs), tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("language", language_stage),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: SQL has neither the network nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage_of in STAGES[:-1]:
        docs = stage(stage_of(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
