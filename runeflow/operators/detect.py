"""The statistical error detector: unlikely tag triples (PR)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runeflow.config import DETECTOR


def windows(toks: DataFrame) -> DataFrame:
    """PR1: (doc_id, sent_id, pos, t1, t2, t3) for each three tags in a row; ``pos`` is the middle one's."""
    w = Window.partitionBy("doc_id", "sent_id").orderBy("pos")
    t = toks.select("doc_id", "sent_id", F.lead("pos").over(w).alias("pos"), F.col("tag").alias("t1"), F.lead("tag").over(w).alias("t2"), F.lead("tag", 2).over(w).alias("t3"))
    return t.where(F.col("t3").isNotNull())


def triples(w: DataFrame) -> DataFrame:
    return w.groupBy("t1", "t2", "t3").agg(F.count("*").alias("freq"))


def suspects(w: DataFrame, freqs: DataFrame, threshold: float) -> DataFrame:
    """Windows whose triple is rarer than the threshold."""
    rare = freqs.where(F.col("freq") < threshold).select("t1", "t2", "t3")
    return w.join(F.broadcast(rare), ["t1", "t2", "t3"], "left_semi")  # at most the cube of the tag set


def representatives(bi: DataFrame, k: int) -> DataFrame:
    """PR11: the k tags most like each, itself included: (tag, rep, rank, sim)."""
    a = bi.select(F.col("t1").alias("tag"), F.col("t2").alias("ctx"), F.col("freq").alias("f"))
    norm = a.groupBy("tag").agg(F.sqrt(F.sum(F.col("f") * F.col("f"))).alias("nrm"))
    b = a.select(F.col("tag").alias("rep"), "ctx", F.col("f").alias("g"))
    s = a.join(b, "ctx").groupBy("tag", "rep").agg(F.sum(F.col("f") * F.col("g")).alias("dot"))
    s = s.join(norm, "tag").join(norm.select(F.col("tag").alias("rep"), F.col("nrm").alias("nr")), "rep")
    s = s.withColumn("sim", F.round(F.col("dot") / (F.col("nrm") * F.col("nr")), 9))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("sim"), "rep"))).where(F.col("rank") <= k).select("tag", "rep", "rank", "sim")


def _expanded(tri: DataFrame, reps: DataFrame) -> DataFrame:
    out = tri.select("t1", "t2", "t3")
    for i in (1, 2, 3):
        out = out.join(reps.select(F.col("tag").alias(f"t{i}"), F.col("rep").alias(f"r{i}"), F.col("rank").alias(f"k{i}"), F.col("sim").alias(f"s{i}")), f"t{i}")
    seen = tri.select(*[F.col(f"t{i}").alias(f"r{i}") for i in (1, 2, 3)], "freq")
    return out.join(seen, ["r1", "r2", "r3"]).withColumn("v", F.col("freq") * F.col("s1") * F.col("s2") * F.col("s3"))


def represented(tri: DataFrame, reps: DataFrame, weights: tuple[float, ...] | None = None) -> DataFrame:
    """PR2, PR4, PR5: sums over representatives, weighted by half for every rank or by the weights given for the ranks."""
    x = _expanded(tri, reps)
    if weights is None:
        value = F.col("v") / F.pow(F.lit(2.0), F.col("k1") + F.col("k2") + F.col("k3") - 3)
    else:
        given = F.array(*[F.lit(float(w)) for w in weights])
        x = x.where(F.greatest("k1", "k2", "k3") <= len(weights))
        value = F.col("v") * F.element_at(given, F.col("k1")) * F.element_at(given, F.col("k2")) * F.element_at(given, F.col("k3"))
    return x.groupBy("t1", "t2", "t3").agg(F.sum(value).alias("score"))


def default_scheme(tri: DataFrame, reps: DataFrame, uni: DataFrame, first: int = DETECTOR.first_representatives) -> DataFrame:
    """PR3: ``first_only``, the sum over the first representatives (scheme 4); ``relative``, over all, a thousand times per product of the tags' frequencies (3)."""
    x = _expanded(tri, reps)
    s = x.groupBy("t1", "t2", "t3").agg(F.sum(F.when(F.greatest("k1", "k2", "k3") <= first, F.col("v")).otherwise(0.0)).alias("first_only"), F.sum("v").alias("total"))
    for i in (1, 2, 3):
        s = s.join(uni.select(F.col("tag").alias(f"t{i}"), F.col("freq").cast("double").alias(f"n{i}")), f"t{i}")
    return s.withColumn("relative", 1000 * F.col("total") / (F.col("n1") * F.col("n2") * F.col("n3")))


def schemes(tri: DataFrame, reps: DataFrame) -> DataFrame:
    """PR3: sum, mean over those that are not zero, largest."""
    v = F.col("v")
    return _expanded(tri, reps).groupBy("t1", "t2", "t3").agg(F.sum(v).alias("total"), F.coalesce(F.sum(v) / F.nullif(F.count_if(v != 0), F.lit(0)), F.lit(0.0)).alias("mean"), F.max(v).alias("most"))
