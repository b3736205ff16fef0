"""From raw documents to tokens: language, near copies, benchmark passages, personal data, encoding.

Each stage reads what its predecessor wrote and passes on the columns of ``documents``; the last gives the tokens' digests.
Rows with null or empty texts are rejected by the first stage; rows without an id go through all stages that don't need one.
Texts of any length are taken whole; of repeated rows and near copies one document of each group stays (rows that repeat id and
text stay or go together); ties are settled by id; further columns pass through under their names, whatever these are, up to the
last stage, which keeps id, language and source. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, langid, ngram_join, pii
from tessera.llm.joins import drop_rows
from tessera.llm.storage import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told go on, with that language; those without a letter go."""
    model = langid.learn(docs.select("text", "lang"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    told = langid.identify(rows, model).where("lang_pred <> 'und'")
    return told.select(*(F.col("lang_pred" if c == "lang" else f"row.`{c}`").alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies goes on, the one with the smallest id."""
    return ngram_join.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = materialize(found.select("doc_id").distinct(), "contaminated")
    return drop_rows(docs, hit, "doc_id").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that disclose them, are replaced by the names of their kinds."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers of tokens, and digests of ids and decoded texts."""
    import public_tokenizers

    return bpe.bpe(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("personal data", personal_data),
    ("BPE encoding and decoding", tokens),
]

#: Near copies, alignments and tokens are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.lower().replace(" ", "_"))
    return docs
