"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat_repair, decontaminate, language_id, lm_score, near_dedup, packing, pii, secrets, sentencepieces, spelling, spotsigs, swap_packing, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_held_out(_table(spark, sf_dir, "documents"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.segment_corpus(_table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), size=4, threshold=80)


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.scan(_table(spark, sf_dir, "documents"))


def op10_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair(_table(spark, sf_dir, "conversations"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(_table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.count_words(_table(spark, sf_dir, "documents")))


def op13_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swap_packing.digest(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_pack": op2_pack,
    "op3_language_id": op3_language_id,
    "op4_pii": op4_pii,
    "op5_secrets": op5_secrets,
    "op6_decontaminate": op6_decontaminate,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_near_dedup": op8_near_dedup,
    "op9_spotsigs": op9_spotsigs,
    "op10_chat_repair": op10_chat_repair,
    "op11_vector_codes": op11_vector_codes,
    "op12_spelling": op12_spelling,
    "op13_swap_packing": op13_swap_packing,
}
ORACLE_SQL: dict[str, str] = {"op4_pii": pii.ORACLE_SQL, "op8_near_dedup": near_dedup.ORACLE_SQL, "op10_chat_repair": chat_repair.ORACLE_SQL, "op11_vector_codes": vector_codes.ORACLE_SQL}
