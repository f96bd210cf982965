"""The corpus pipeline: language, near copies, benchmark passages, secrets, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapespark.llm import decontaminate, language_id, near_dedup, secrets, sentencepieces
from tapespark.llm._rows import fresh, named
from tapespark.llm._store import materialize

#: A language is rejected below this posterior probability.
LEAST_SCORE = 0.5


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those whose text is null, has no letter, or has no language of probability ``LEAST_SCORE`` go."""
    lang, score = fresh(docs.columns, "lang", "score")
    found = language_id.predict(docs, language_id.train(docs), docs.columns, names=(lang, score))
    return found.where((F.col(lang) != language_id.UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).select(*named(*docs.columns))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8).

    Rows that repeat a doc_id are one document, of which the row with the smallest text stays, then lang and source. Rows
    without doc_id are in no group and stay.
    """
    kept = near_dedup.near_duplicates(docs, size=5, threshold=80).where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
    kept = materialize(kept, "pipeline-kept")
    rows = docs.join(kept.where("n = 1").select("doc_id"), "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
    several = kept.where("n > 1").select("doc_id")
    if not several.isEmpty():
        (place,) = fresh(docs.columns, "place")
        first = Window.partitionBy("doc_id").orderBy(*(F.col(c).asc_nulls_last() for c in ("text", "lang", "source", "n_chars")))
        placed = docs.join(several, "doc_id", "left_semi").withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
        rows = rows.unionByName(placed.drop(place))
    return rows.select(*named(*docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget, or, for a short one, word for word."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    (hits,) = fresh(docs.columns, "hits")
    return decontaminate.find_items(docs, items, docs.columns, name=hits).where(F.size(hits) == 0).select(*named(*docs.columns))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in the text; n_chars follows."""
    base, every = fresh(docs.columns, "base", "found")
    found = secrets.find_secrets(docs, secrets.train(docs), docs.columns, names=(base, every))
    text = secrets.redacted("text", every)
    chars = F.when(F.size(every) > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    columns = {"text": text, "n_chars": chars}
    return found.select(*(columns.get(c, x).alias(c) for c, x in zip(docs.columns, named(*docs.columns), strict=True)))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and token ids of each document."""
    found = sentencepieces.encode(docs, ["doc_id", "lang", "source"], dropout=0.1, seed=17, names=("ids", "lossless"))
    return found.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identified),
    ("near_dedup", deduplicated),
    ("decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("sentencepiece", encoded),
]
#: SQL expresses neither the trained stages nor the token ids; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
