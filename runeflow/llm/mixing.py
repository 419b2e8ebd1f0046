"""Mixing sources to target weights by entropy balancing (operator 3), in DataFrame functions only.

Rates r of the documents minimise the entropy of the mix relative to the corpus under one token constraint for each
source, sum(r * size) = target, and the bound r <= 2.  The dual is convex and has one multiplier for each source; its
solution is an exponential tilt, r = min(2, exp(lambda * size / mean size of the source)).  Newton steps, kept within a
shrinking bracket, are taken for all sources at once; each is one aggregation over the table of distinct (source, size)
and its row counts, which is all that the moments depend on.  Rates are then rounded into copies of whole documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

WORD = r"[^\x20\x09-\x0D]+"
SALTS = 128
"""Ranges of a hash by which documents of one source and size are ranked, so that no window holds a hot group."""
FIXES = 24
"""Rounds, at most, in which one size of each source makes up for what rounding left over; they end once none helps."""
TOLERANCE = 1e-9


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: str) -> Column:
    """A key that is never null: sources in code point order sort as before, null last."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(key, source_size) -> adds ``target``: ``share`` of all sizes by weight, at most ``cap`` times the source's size.

    Weights repeat over the sources in the order of their keys.  A source above its cap stops there, and the excess is
    shared again by weight: the common level t in target = min(weight * t, cap * size) is found from prefix sums over
    the sources by the level at which each reaches its cap.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(Window.orderBy("key")) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("level", F.col("most") / F.col("weight"))
    order, whole = Window.orderBy("level", "key"), Window.partitionBy()
    s = s.withColumn("goal", F.lit(float(share)) * F.sum("source_size").over(whole))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("capped", F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("t", (F.col("goal") - F.col("capped")) / F.col("open"))  # if exactly the sources before are capped
    t = F.min(F.when(F.col("t") <= F.col("level"), F.struct("level", "key", "t"))).over(whole)["t"]  # the first source that isn't
    return s.withColumn("target", F.least(F.coalesce(F.col("weight") * t, F.col("most")), "most")).select("key", "source_size", "target")


def tilt(hist: DataFrame, goals: DataFrame, cap: float, rounds: int = 80) -> DataFrame:
    """(key, size, n) and (key, source_size, target) -> (key, lam, mean), the solution of the dual."""
    base = hist.where("size > 0").groupBy("key").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    g = goals.join(base, "key").withColumn("least", F.col("least") / F.col("mean"))
    full = F.col("target") >= F.lit(cap * (1 - 1e-12)) * F.col("source_size")
    ratio = F.log(F.col("target") / F.col("source_size")) / F.col("least")
    lo, hi = F.least(ratio, F.lit(0.0)), F.lit(math.log(cap)) / F.col("least")
    state = C.materialize(g.select("key", "mean", "target", lo.alias("lo"), hi.alias("hi"), F.when(full, F.lit(float("inf"))).otherwise(F.lit(0.0)).alias("lam"), full.alias("done")), "dual")
    h = hist.where("size > 0").select("key", "size", "n")
    for _ in range(rounds):
        if not state.where("not done").limit(1).count():
            break
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.col("lam") * x)
        words = F.col("n") * F.col("size")
        m = h.join(state.where("not done").select("key", "lam", "mean"), "key").groupBy("key").agg(
            F.sum(words * F.least(rate, F.lit(float(cap)))).alias("f"), F.sum(F.when(rate < cap, words * x * rate).otherwise(F.lit(0.0))).alias("df")
        )
        s = state.join(m, "key", "left")
        err = F.col("f") - F.col("target")
        low = F.when(err < 0, F.col("lam")).otherwise(F.col("lo"))
        high = F.when(err > 0, F.col("lam")).otherwise(F.col("hi"))
        s = s.withColumns({"lo2": low, "hi2": high, "step": F.col("lam") - err / F.when(F.col("df") > 0, F.col("df"))})
        inside = (F.col("step") > F.col("lo2")) & (F.col("step") < F.col("hi2"))
        there = (F.abs(err) <= TOLERANCE * F.col("target")) | (F.col("hi2") - F.col("lo2") <= 1e-15 * F.abs("hi2"))
        nxt = F.when(inside, F.col("step")).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        done = F.col("done") | F.coalesce(there, F.lit(False))
        keep = lambda new, old: F.when(F.col("done"), F.col(old)).otherwise(new)
        state = C.materialize(s.select("key", "mean", "target", keep(F.col("lo2"), "lo").alias("lo"), keep(F.col("hi2"), "hi").alias("hi"), F.when(done, F.col("lam")).otherwise(nxt).alias("lam"), done.alias("done")), "dual")
    else:
        if state.where("not done").limit(1).count():
            raise RuntimeError(f"rates did not converge in {rounds} rounds")
    return state.select("key", "lam", "mean")


def rounded(rates: DataFrame, goals: DataFrame, cap: int) -> DataFrame:
    """(key, size, n, rate) -> (key, size, n, copies): whole copies of all n documents together.

    Running sums of the rates, from long documents to short ones, are rounded, so the words taken differ from the target
    by half of the longest document at most; then, round by round, the size that fits the rest best gives or takes
    some copies.
    """
    w = Window.partitionBy("key").orderBy(F.desc("size"))
    ideal = F.col("n") * F.col("rate")
    upto = lambda end: F.round(F.coalesce(F.sum(ideal).over(w.rowsBetween(Window.unboundedPreceding, end)), F.lit(0.0)))
    t = rates.withColumn("copies", F.least(F.greatest((upto(0) - upto(-1)).cast("long"), F.lit(0)), cap * F.col("n"))).select("key", "size", "n", "copies")
    t = C.materialize(t, "copies")
    for _ in range(FIXES):
        off = t.groupBy("key").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).join(goals, "key").select("key", (F.col("target") - F.col("taken")).alias("off"))
        a = t.join(off, "key").where("size > 0")
        room = F.when(F.col("off") > 0, cap * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        a = a.withColumn("room", room).where("room > 0")
        k = F.least(F.greatest(F.round(F.abs("off") / F.col("size")).cast("long"), F.lit(1)), F.col("room"))
        a = a.withColumn("k", k).withColumn("left", F.abs(F.abs("off") - F.col("k") * F.col("size"))).where(F.col("left") < F.abs("off") - 1e-6)
        best = a.groupBy("key").agg(F.min(F.struct("left", "size", (F.signum("off") * F.col("k")).cast("long").alias("k"))).alias("b"))
        best = C.materialize(best.select("key", F.col("b.size").alias("size"), F.col("b.k").alias("k")), "fix")
        if not best.limit(1).count():
            break
        t = C.materialize(t.join(best, ["key", "size"], "left").select("key", "size", "n", (F.col("copies") + F.coalesce("k", F.lit(0))).alias("copies")), "copies")
    return t


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How often each document enters a mix in which sources have the weights given.

    Returns one row per input row: ``doc_id, size, source_size, target, rate, copies, taken``.  ``size``: words of the
    text (null: 0); ``target``: words its source should give; ``copies`` (0 to ``cap``) whole copies; ``taken = copies *
    size``.  A null source is a source of its own, last in order.  Texts without words get rate 1 and as many copies, and
    count for nothing.  Which of equally long documents of a source get one copy more follows from a hash of their ids, so
    runs agree; rows that share an id are told apart by nothing.  Other columns are not read; an empty table gives none.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), _key(source).alias("key"), word_count(text).alias("size"))
    d = C.materialize(d.withColumn("u", F.xxhash64(F.lit(3), "doc_id")).withColumn("salt", F.pmod(F.col("u"), F.lit(SALTS))), "sizes")
    salted = C.materialize(d.groupBy("key", "size", "salt").agg(F.count("*").alias("c")), "salted")
    hist = C.materialize(salted.groupBy("key", "size").agg(F.sum("c").alias("n")), "hist")
    goals = C.materialize(targets(hist.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, cap), "goals")
    lam = tilt(hist, goals, cap)
    rate = F.when((F.col("size") == 0) | F.col("lam").isNull(), F.lit(1.0)).otherwise(F.least(F.exp(F.col("lam") * F.col("size") / F.col("mean")), F.lit(float(cap))))
    rates = C.materialize(hist.join(lam, "key", "left").select("key", "size", "n", rate.alias("rate")), "rates")
    copies = rounded(rates, goals, cap)
    # of the n documents of a source and size each gets copies div n, and copies mod n of them one more: those first by hash
    before = F.coalesce(F.sum("c").over(Window.partitionBy("key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = salted.withColumn("before", before).join(copies, ["key", "size"]).join(rates.select("key", "size", "rate"), ["key", "size"]).join(goals, "key")
    quota = quota.select("key", "size", "salt", "rate", "source_size", "target", F.expr("copies div n").alias("each"), F.greatest(F.expr("copies % n") - F.col("before"), F.lit(0)).alias("more"))
    quota = C.materialize(quota, "quota")
    place = F.row_number().over(Window.partitionBy("key", "size", "salt").orderBy("u", "doc_id"))
    out = d.join(quota, ["key", "size", "salt"]).withColumn("copies", (F.col("each") + F.when(place <= F.col("more"), 1).otherwise(0)).cast("int"))
    return out.select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op3_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(C.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op3_entropy_mixing": op3_entropy_mixing}
ORACLE: dict[str, str] = {}
