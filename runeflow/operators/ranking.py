"""Ranking: best of a group, suggestions, index terms (RK)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """RK1: the first k rows of each group in a total order, numbered from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def index_terms(terms: DataFrame, k: int = 5) -> DataFrame:
    """RK8: (doc_id, term), a row for each occurrence -> the k terms of each document that say most about it.

    score = 100 * (in_doc / all terms of the document + in_doc / freq + in_doc / n_docs).
    """
    d = terms.groupBy("doc_id", "term").agg(F.count("*").alias("in_doc"))
    corpus = d.groupBy("term").agg(F.sum("in_doc").alias("freq"), F.count("*").alias("n_docs"))
    total = d.groupBy("doc_id").agg(F.sum("in_doc").alias("doc_total"))
    n = F.col("in_doc")
    s = d.join(corpus, "term").join(total, "doc_id").withColumn("score", F.round(100 * (n / F.col("doc_total") + n / F.col("freq") + n / F.col("n_docs")), 6))
    return best(s, ["doc_id"], [F.desc("score"), F.asc("term")], k).select("doc_id", "rank", "term", "score", F.round(100 * n / F.col("freq"), 6).alias("doc_share"))


def sort_modes(df: DataFrame, word: str, prob: str, mode: str) -> list[Column]:
    """RK4: orders none, alpha, length (then alpha), prob (descending)."""
    return {"none": [], "alpha": [F.col(word)], "length": [F.length(word), F.col(word)], "prob": [F.desc(prob), F.col(word)]}[mode]
