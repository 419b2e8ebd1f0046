"""A training corpus from raw documents: language ID, near-dedup, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runeflow.llm import common as C
from runeflow.llm.decontaminate import clean
from runeflow.llm.language import in_a_language
from runeflow.llm.mixing import mix
from runeflow.llm.near import near_duplicates
from runeflow.llm.tokens import default_tokenizer, read_tokens, write_tokens

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those with a letter in them."""
    return in_a_language(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Rows that share an id are one document and stay or go together.
    """
    kept = near_duplicates(docs).where("kept").groupBy("doc_id").agg(F.lit(1).alias("n")).select(F.col("doc_id").alias("_id"))
    kept = C.materialize(kept, "kept").hint("merge")  # as many as the corpus has documents: never broadcast
    return docs.select(*COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return clean(docs.select(*COLUMNS), C.table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document taken twice is two equal rows.

    Rows that share an id are each taken as often as the one of them that is taken most.
    """
    taken = mix(docs).groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").alias("copies")).where("copies > 0")
    taken = C.materialize(taken, "copies").hint("merge")
    return docs.select(*COLUMNS).join(taken, F.col("doc_id").eqNullSafe(F.col("_id"))).withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Binary shards of token ids, and what is read back from them for each row."""
    uri = f"{C.shared_dir(spark)}/ids"
    return read_tokens(write_tokens(docs, default_tokenizer(), uri), uri).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

ORACLE_SQL = None
"""None of the stages can be expressed in SQL."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
