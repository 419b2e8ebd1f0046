"""Lexicon lookup, inflection, compounds, spelling (LX) and unknown words (UN)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runeflow.config import TAGGING, TaggingConfig
from runeflow.operators.spelling import spelling_pairs

VOWELS = "aeiouyáéíóúàèìòùâêîôûäöüåæø"


class InflectRule(NamedTuple):
    """Endings it applies to, how many characters it strips, and the (tag, suffix) of each form; the first tag is its base."""

    name: str
    endings: tuple[str, ...]
    strip: int
    forms: tuple[tuple[str, str], ...]


def ending_pattern(ending: str) -> str:
    """LX10: a plain ending; ``^x`` the whole word; a leading V or C any vowel or consonant."""
    if ending.startswith("^"):
        return f"^{ending[1:]}$"
    if ending[:1] == "V":
        return f"[{VOWELS}]{ending[1:]}$"
    if ending[:1] == "C":
        return rf"[^{VOWELS}]{ending[1:]}$"
    return f"{ending}$"


def rule_table(spark: SparkSession, rules: tuple[InflectRule, ...]) -> DataFrame:
    """(rule_no, name, pattern, strip, base_tag, form_no, tag, suffix): ``=`` is no suffix, ``-`` no such form."""
    rows = [(i, r.name, ending_pattern(e), r.strip, r.forms[0][0], k, tag, None if s == "-" else "" if s == "=" else s) for i, r in enumerate(rules) for e in r.endings for k, (tag, s) in enumerate(r.forms)]
    return spark.createDataFrame(rows, "rule_no int, name string, pattern string, strip int, base_tag string, form_no int, tag string, suffix string")


def applicable(words: DataFrame, rules: DataFrame) -> DataFrame:
    """LX10, LX12: the first rule that applies to each word; a theta join with the (small, driver-made) rule table."""
    r = rules.select("rule_no", "name", "pattern").distinct()
    hit = words.join(F.broadcast(r), F.expr("word rlike pattern"))
    return hit.groupBy("word").agg(F.min_by("name", "rule_no").alias("rule"), F.min("rule_no").alias("rule_no"))


def apply_form(word: Column, strip: Column, suffix: Column, form_no: Column) -> Column:
    """LX11: form 0 is the word itself; others lose ``strip`` characters and get the suffix; null without such a form."""
    cut = F.greatest(F.length(word) - strip, F.lit(0))
    return F.when(form_no == 0, word).otherwise(F.concat(F.substring(word, F.lit(1), cut), suffix))


def paradigm(words: DataFrame, rules: DataFrame) -> DataFrame:
    """LX13, LX14: every form of every word by its first rule."""
    forms = rules.select("rule_no", "strip", "form_no", "tag", "suffix").distinct()
    p = applicable(words, rules).join(F.broadcast(forms), "rule_no")
    return p.select("word", "rule", "tag", apply_form(F.col("word"), F.col("strip"), F.col("suffix"), F.col("form_no")).alias("form")).where("form is not null")


def original_tag(tag: Column) -> Column:
    """LX9: tags with set, dat, mod, aux or kop lose their last 4 characters, 8 with ``imp.akt``."""
    marked = tag.rlike("set|dat|mod|aux|kop")
    cut = F.when(tag.contains("imp.akt"), 8).otherwise(4)
    return F.when(marked, F.substring(tag, F.lit(1), F.length(tag) - cut)).otherwise(tag)


def compound_splits(words: DataFrame, parts: DataFrame, c: TaggingConfig = TAGGING) -> DataFrame:
    """LX16: (word, head, tail) for each split into two known parts."""
    s = words.where(F.length("word") >= c.compound_min).select("word", F.explode(F.sequence(F.lit(c.compound_min_prefix), F.length("word") - c.compound_min_suffix)).alias("n"))
    s = s.where(F.col("n").between(c.compound_min_prefix, F.length("word") - c.compound_min_suffix))
    s = s.select("word", F.expr("left(word, n)").alias("head"), F.expr("right(word, length(word) - n)").alias("tail"))
    return s.join(parts.select(F.col("word").alias("head")), "head", "left_semi").join(parts.select(F.col("word").alias("tail")), "tail", "left_semi").select("word", "head", "tail")


def spelling_candidates(unknown: DataFrame, known: DataFrame, best: int | None = None) -> DataFrame:
    """RK7, LX25: (word, candidate, edits, freq) for all known words one or two edits away, two words with no letter in common aside; as ``spelling_pairs``."""
    freq = F.col("freq").cast("long").alias("freq")
    return spelling_pairs(unknown.select("word", F.lit(0).cast("long").alias("freq"), F.lit(False).alias("known")).unionByName(known.select("word", freq, F.lit(True).alias("known"))), best)


def unknown_readings(unknown: DataFrame, suffixes: DataFrame, c: TaggingConfig = TAGGING) -> DataFrame:
    """UN1, UN2: (word, capped) -> (word, tag, score): sum of suffix scores, times a factor for capitalised words' tags."""
    s = unknown.select("word", "capped", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("len")).where(F.length("word") - F.col("len") >= c.min_prefix)
    s = s.withColumn("suffix", F.expr("right(word, len)")).join(suffixes.select("suffix", "tag", "score"), "suffix")
    s = s.groupBy("word", "capped", "tag").agg(F.sum("score").alias("score"))
    proper = F.col("tag") == "word.cap"
    factor = F.when(F.col("capped") == proper, F.lit(c.alpha_unknown_cap)).otherwise(F.lit(c.alpha_unknown_no_cap))
    top = s.withColumn("score", F.col("score") * factor)
    w = Window.partitionBy("word").orderBy(F.desc(F.round("score", 9)), "tag")
    return top.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= c.unknown_readings).select("word", "rank", "tag", "score")
