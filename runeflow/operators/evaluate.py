"""Evaluation against gold tags and gold error positions (EV)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """Per cent, null if there is nothing to count."""
    return F.round(100 * a / F.nullif(b, F.lit(0)), 6)


def tagging(tokens: DataFrame) -> DataFrame:
    """EV1 to EV3: (gold, tag, known, is_punct) -> one row of counts and accuracies."""
    right = F.col("gold") == F.col("tag")
    n = lambda c: F.count_if(c)
    t = tokens.agg(F.count("*").alias("n"), n(right).alias("n_right"), n(F.col("known")).alias("n_known"), n(right & F.col("known")).alias("known_right"), n(~F.col("known")).alias("n_unknown"), n(right & ~F.col("known")).alias("unknown_right"), n(F.col("is_punct")).alias("n_punct"), n(right & F.col("is_punct")).alias("punct_right"))
    return t.select("*", ratio(F.col("n_right"), F.col("n")).alias("accuracy"), ratio(F.col("known_right"), F.col("n_known")).alias("known_accuracy"), ratio(F.col("unknown_right"), F.col("n_unknown")).alias("unknown_accuracy"), ratio(F.col("n_right") - F.col("punct_right"), F.col("n") - F.col("n_punct")).alias("accuracy_without_punct"))


def hit(begin: Column, end: Column, gold: Column) -> Column:
    """EV6: an alarm meets a gold position if either end is at most one off, or it spans it."""
    near = lambda x: x.between(gold - 1, gold + 1)
    return near(begin) | near(end) | ((begin <= gold - 1) & (end >= gold + 1))


def near_miss(begin: Column, end: Column, gold: Column) -> Column:
    """EV7: exactly two off."""
    return ~hit(begin, end, gold) & ((F.abs(begin - gold) == 2) | (F.abs(end - gold) == 2))


def alarm_kinds(alarms: DataFrame, gold: DataFrame, style_types: tuple[str, ...] = ("STYLE",)) -> DataFrame:
    """EV5, EV11: (key, begin, end, kind) for alarms (key, begin, end) against gold (key, pos, type, false_alarm).

    An alarm is ``detected`` if it meets a gold position of a countable type, ``style`` if that type is style, ``false`` if
    the position is marked as a false alarm or none is met, and ``unannotated`` if its key has no gold at all.
    """
    style = F.col("type").isin(*style_types)
    met = hit(F.col("begin"), F.col("end"), F.col("pos")) & ~F.col("false_alarm")
    j = alarms.join(gold, "key", "left").groupBy("key", "begin", "end").agg(
        F.coalesce(F.bool_or(met & ~style), F.lit(False)).alias("detects"), F.coalesce(F.bool_or(met & style), F.lit(False)).alias("styles"), (F.count("pos") > 0).alias("annotated")
    )
    kind = F.when(~F.col("annotated"), "unannotated").when(F.col("detects"), "detected").when(F.col("styles"), "style").otherwise("false")
    return j.select("key", "begin", "end", kind.alias("kind"))


def detection(alarms: DataFrame, gold: DataFrame, style_types: tuple[str, ...] = ("STYLE",)) -> DataFrame:
    """EV8, EV9: one row of counters, coverage and precision; known errors: keys with gold that isn't a false alarm."""
    counts = alarm_kinds(alarms, gold, style_types).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("detected", "style", "false", "unannotated")])
    known = gold.where(~F.col("false_alarm")).agg(F.countDistinct("key").alias("known"))
    d, f = F.col("detected"), F.col("false")
    return counts.crossJoin(known).select("*", ratio(d, F.col("known")).alias("coverage"), ratio(d, d + f).alias("precision"))  # one row each


def islands(positions: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """ER6, PR8: maximal runs of adjacent positions: (by, begin, end, n)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(pos)
    return positions.withColumn("island", F.col(pos) - F.row_number().over(w)).groupBy(*by, "island").agg(F.min(pos).alias("begin"), F.max(pos).alias("end"), F.count("*").alias("n")).drop("island")
