"""The queries of this subpackage, each over its whole table with production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, digest_index, langid, lattice, merkle, mixing, packing, pfor, preference, quality, repair, simhash, telephony
from .common import documents, spread


#: Queries that run on DataFrame and SQL functions alone.
NATIVE = ("op1_preference_format", "op2_exact_dedup", "op3_source_mix")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.preferences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_index.deduplicate(documents(spark, sf_dir))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op4_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spread(documents(spark, sf_dir)))


def op5_anchor_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread(documents(spark, sf_dir)))


def op6_bigru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(spread(documents(spark, sf_dir)))


def op7_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.scores(spread(documents(spark, sf_dir)), tokenizer("piece_bpe_32k.model"))


def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(documents(spark, sf_dir)), tokenizer("byte_bpe_50k.json"))


def op9_pfor_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.round_trip(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), with_ids=False)


def op10_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.telephony(spread(documents(spark, sf_dir)))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(documents(spark, sf_dir))


def op12_contiguous_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(spread(documents(spark, sf_dir)), tokenizer("byte_bpe_50k.json"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_preference_format,
        op2_exact_dedup,
        op3_source_mix,
        op4_weak_label_quality,
        op5_anchor_simhash,
        op6_bigru_language,
        op7_lattice_scores,
        op8_sum_of_squares_packing,
        op9_pfor_tokens,
        op10_telephony,
        op11_merkle_manifest,
        op12_contiguous_bpe,
        op13_conversation_repair,
    ]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_preference_format": preference.ORACLE,
        "op2_exact_dedup": digest_index.ORACLE,
        "op3_source_mix": mixing.ORACLE,
        "op11_merkle_manifest": merkle.ORACLE,
        "op13_conversation_repair": repair.ORACLE,
    }
