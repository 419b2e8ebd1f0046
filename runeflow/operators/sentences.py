"""Operators on sentences: flags, repeats, edits, printing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runeflow.functions import scan


def sentence_rows(toks: DataFrame) -> DataFrame:
    """(doc_id, sent_id, toks): tokens of each sentence in order."""
    return toks.groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tok", "cls"))).alias("toks"))


def seems_foreign(n_words: Column, n_ok: Column, n_foreign: Column) -> Column:
    """SE6: over four words, and none known but some foreign, or less than 15 % known."""
    return (n_words > 4) & (((n_ok == 0) & (n_foreign > 0)) | (n_ok / n_words < 0.15))


def repeated_words(words: DataFrame) -> DataFrame:
    """SE7: the second of two equal words in a row (numbers aside), last word of a sentence included."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    same = (F.lag("norm").over(w) == F.col("norm")) & (F.lag("sent_id").over(w) == F.col("sent_id"))
    return words.withColumn("repeated", F.coalesce(same, F.lit(False))).where("repeated")


def repeats(toks: Column) -> Column:
    """SE7: whether a sentence's tokens hold two equal words in a row."""
    w = F.transform(F.filter(toks, scan.is_word), F.lower)
    last = F.lit(None).cast("string")
    start = F.struct(last.alias("last"), F.lit(False).alias("hit"))
    return F.aggregate(w, start, lambda a, x: F.struct(x.alias("last"), (a["hit"] | F.coalesce(a["last"] == x, F.lit(False))).alias("hit")), lambda a: a["hit"])


def repeated_in(s: DataFrame) -> DataFrame:
    """As repeated_words, (doc_id, sent_id, pos), over rows of scan.numbered_rows: neighbours are compared inside the row."""
    parts = F.transform("parts", lambda x, i: F.struct(i.alias("i"), x.alias("tok")))
    s = s.select("doc_id", "sent_id", "first", F.transform(F.filter(parts, lambda x: scan.is_word(x["tok"])), lambda x: F.struct(x["i"].alias("i"), F.lower(x["tok"]).alias("norm"))).alias("w"))
    both = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))
    hit = F.transform(F.filter(both, lambda x: x["a"]["norm"] == x["b"]["norm"]), lambda x: x["b"]["i"])
    return s.select("doc_id", "sent_id", "first", F.explode_outer(hit).alias("i")).where("i is not null").select("doc_id", "sent_id", (F.col("first") + F.col("i")).alias("pos"))


def repeated_ngrams(words: DataFrame, size: int) -> DataFrame:
    """SE7: last words of a word sequence of the given length that directly follows its equal within a sentence."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    same = F.lit(True)
    for k in range(size):
        same = same & (F.lag("norm", k).over(w) == F.lag("norm", k + size).over(w))
    same = same & (F.lag("sent_id", 2 * size - 1).over(w) == F.col("sent_id"))
    return words.withColumn("repeated", F.coalesce(same, F.lit(False))).where("repeated")


def fix_up(toks: DataFrame) -> DataFrame:
    """SE8: ``trailing_space`` unless punctuation or the end follows; ``first_in_sentence`` for the first word."""
    w = Window.partitionBy("doc_id", "sent_id").orderBy("pos")
    is_word = F.col("cls").isin(*scan.WORDS)
    follows = F.lead("cls").over(w)
    first = F.min(F.when(is_word, F.col("pos"))).over(Window.partitionBy("doc_id", "sent_id"))
    return toks.withColumn("trailing_space", F.coalesce(follows.isin(*scan.WORDS, "cardinal", "year", "left_par"), F.lit(False))).withColumn("first_in_sentence", is_word & (F.col("pos") == first))


def delete(toks: Column, start: int, stop: int) -> Column:
    """SE10: without the tokens at original places start to stop."""
    return F.filter(toks, lambda t: ~t["org"].between(start, stop))


def replace(toks: Column, org: int, word: str) -> Column:
    """SE10: the token at an original place replaced; a missing place changes nothing."""
    return F.transform(toks, lambda t: F.when(t["org"] == org, F.struct(t["org"].alias("org"), F.lit(word).alias("tok"))).otherwise(t))


def insert(toks: Column, org: int, word: str) -> Column:
    """SE10: a token before the one at an original place, which it shares."""
    new = F.array(F.struct(F.lit(org).alias("org"), F.lit(word).alias("tok")))
    return F.when(F.exists(toks, lambda t: t["org"] == org), F.concat(F.filter(toks, lambda t: t["org"] < org), new, F.filter(toks, lambda t: t["org"] >= org))).otherwise(toks)


def printed(toks: Column) -> Column:
    """SE11, SE12: tokens joined by spaces."""
    return F.array_join(F.transform(toks, lambda t: t["tok"]), " ")
