"""Counts and smoothed scores of tags and words (ST)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runeflow.config import TAGGING, TaggingConfig
from runeflow.functions import pieces


def shifted(toks: DataFrame, col: str, n: int) -> DataFrame:
    """(t1 .. tn): ``col`` of each token and the n - 1 that follow it in its sentence; null past its end."""
    w = Window.partitionBy("doc_id", "sent_id").orderBy("pos")
    return toks.select(*[(F.lead(col, k).over(w) if k else F.col(col)).alias(f"t{k + 1}") for k in range(n)])


def ngram_counts(toks: DataFrame, col: str, n: int) -> DataFrame:
    """ST3, ST4, ST20: counts of n successive values within a sentence."""
    names = [f"t{k + 1}" for k in range(n)]
    return shifted(toks, col, n).where(F.col(names[-1]).isNotNull()).groupBy(*names).agg(F.count("*").alias("freq"))


def triples_of(s: DataFrame, values: Column, *more: str) -> DataFrame:
    """(.., t1, t2, t3) of each token and the two that follow it, over rows that hold a sentence; null past its end."""
    v = s.select(*more, values.alias("v"))
    x = F.arrays_zip(F.col("v").alias("t1"), F.slice("v", F.lit(2), F.size("v")).alias("t2"), F.slice("v", F.lit(3), F.size("v")).alias("t3"))
    return v.select(*more, F.explode(x).alias("x")).select(*more, "x.t1", "x.t2", "x.t3")


def row_trigrams(s: DataFrame, values: Column) -> DataFrame:
    """ST4: counts of the triples of rows that hold a sentence; only counts leave a partition."""
    return triples_of(s, values).groupBy("t1", "t2", "t3").agg(F.count("*").alias("freq"))


def scanned_trigrams(docs: DataFrame, edge: str | None = None, text: str = "text") -> DataFrame:
    """ST4, DE1: (t1, t2, t3, freq) of tags within sentences, counted while texts are scanned; a few rows leave each partition.

    Without ``edge`` the last tokens' triples have nulls; with it sentences have two delimiters on each side.
    """
    names, size = (edge, *pieces.TAGS), len(pieces.TAGS) + 1

    def run(batches):
        s, n = pieces.Scanner(), np.zeros(size**3, np.int64)
        for whole in batches:
            for b in pieces.slices(whole, text):
                t = s.scan(b.column(text))
                first = t.starts()
                one = s.tag[t.tok].astype(np.int64) + 1
                two = np.append(np.where(first[1:], 0, one[1:]), 0)[: len(one)]
                three = np.append(np.where(first[1:], 0, two[1:]), 0)[: len(one)]
                n += np.bincount((one * size + two) * size + three, minlength=size**3)
                if edge is not None:
                    n += np.bincount(np.r_[one[first], one[first] * size + two[first]], minlength=size**3)
        seen = np.flatnonzero(n)
        columns = [pieces.strings(names, x) for x in (seen // size**2, seen // size % size, seen % size)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n[seen])], ["t1", "t2", "t3", "freq"])

    return docs.select(text).mapInArrow(run, "t1 string, t2 string, t3 string, freq long").groupBy("t1", "t2", "t3").agg(F.sum("freq").alias("freq"))


def bucket_words(docs: DataFrame) -> DataFrame:
    """(bucket, word, tag, n): the words of each bucket's texts (bucket, text), counted while they are scanned: a word leaves a bucket once."""

    def run(batches):
        s = pieces.Scanner()
        for whole in batches:
            buckets = np.asarray(whole.column("bucket"))
            for k in np.unique(buckets).tolist():
                n: dict[tuple[str, int], int] = {}
                for b in pieces.slices(whole.take(pa.array(np.flatnonzero(buckets == k)))):
                    used, freq = np.unique(s.scan(b.column("text")).tok, return_counts=True)
                    tag = s.tag
                    for i, f in zip(used.tolist(), freq.tolist(), strict=True):
                        key = (s.toks[i].lower(), int(tag[i]))
                        n[key] = n.get(key, 0) + f
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(n), pa.int32()), pa.array([x for x, _ in n], pa.string()), pieces.strings(pieces.TAGS, np.array([x for _, x in n], np.int64)), pa.array(list(n.values()), pa.int64())], ["bucket", "word", "tag", "n"])

    return docs.select("bucket", "text").mapInArrow(run, "bucket int, word string, tag string, n long")


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, freq, known): all words in small letters, counted while texts are scanned; known are those of two documents or more."""

    def rows(toks, freq, lo, hi):
        used = np.flatnonzero(freq)
        ids = [pa.array(x[used], mask=lo[used] > hi[used]) for x in (lo, hi)]
        return pa.RecordBatch.from_arrays([pa.array([toks[i] for i in used.tolist()], pa.string()), pa.array(freq[used]), *ids], ["tok", "freq", "lo", "hi"])

    def run(batches):
        s, age = pieces.Scanner(), -1
        least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        for whole in batches:
            for b in pieces.slices(whole):
                t = s.scan(b.column("text"))
                if s.age != age:
                    if age >= 0:
                        yield rows(toks, freq, lo, hi)
                    age, toks, freq, lo, hi = s.age, s.toks, *[np.full(0, x, np.int64) for x in (0, most, least)]
                freq, lo, hi = (np.r_[x, np.full(len(toks) - len(x), y)] for x, y in ((freq, 0), (lo, most), (hi, least)))
                words = s.is_word()[t.tok]
                tok, row = t.tok[words], t.row[words]
                freq += np.bincount(tok, minlength=len(toks))
                ids = b.column("doc_id")
                has = np.asarray(ids.is_valid())[row]
                ids = np.asarray(ids.fill_null(0))[row]
                np.minimum.at(lo, tok[has], ids[has])
                np.maximum.at(hi, tok[has], ids[has])
        if age >= 0:
            yield rows(toks, freq, lo, hi)

    n = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "tok string, freq long, lo long, hi long")
    n = n.groupBy(F.lower("tok").alias("word")).agg(F.sum("freq").alias("freq"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return n.select("word", "freq", F.coalesce(F.col("lo") < F.col("hi"), F.lit(False)).alias("known"))


def padded_trigrams(toks: DataFrame, col: str, edge: str) -> DataFrame:
    """ST4, DE1: counts of triples in sentences with two delimiters on each side."""
    w = Window.partitionBy("doc_id", "sent_id").orderBy("pos")
    t = toks.select(F.col(col).alias("t1"), F.lead(col, 1, edge).over(w).alias("t2"), F.lead(col, 2, edge).over(w).alias("t3"), (F.row_number().over(w) == 1).alias("first"))
    c = t.groupBy("t1", "t2", "t3", "first").agg(F.count("*").alias("freq"))
    e = F.lit(edge)
    tri = F.array(F.struct("t1", "t2", "t3"), *[F.when(F.col("first"), F.struct(x.alias("t1"), y.alias("t2"), z.alias("t3"))) for x, y, z in ((e, F.col("t1"), F.col("t2")), (e, e, F.col("t1")))])
    return c.select("freq", F.explode(tri).alias("x")).where("x is not null").groupBy("x.t1", "x.t2", "x.t3").agg(F.sum("freq").alias("freq"))


def padded_counts(tri: DataFrame, edge: str) -> tuple[DataFrame, DataFrame]:
    """Unigrams and bigrams of the same sentences: what the triples begin with, and the two delimiters at the end."""
    last = tri.where((F.col("t1") == edge) & (F.col("t2") == edge))  # as many as there are sentences
    bi = tri.select("t1", "t2", "freq").unionAll(last.select("t1", "t2", "freq")).groupBy("t1", "t2").agg(F.sum("freq").alias("freq"))
    one = bi.select(F.col("t1").alias("tag"), "freq").unionAll(last.select("t1", "freq")).groupBy("tag").agg(F.sum("freq").alias("freq"))
    total = one.agg(F.sum("freq").alias("total"))
    return one.crossJoin(F.broadcast(total)).select("tag", "freq", (F.col("freq") / F.col("total")).alias("uni")), bi  # one row


def unigrams(toks: DataFrame, col: str = "tag") -> DataFrame:
    """ST1: frequency and share of each tag; text-message tags count a millionth; verbs are poor compound parts."""
    t = toks.groupBy(F.col(col).alias("tag")).agg(F.count("*").alias("freq"))
    total = t.agg(F.sum("freq").alias("total"))
    prob = F.col("freq") / F.col("total") * F.when(F.col("tag").contains("sms"), F.lit(1e-6)).otherwise(F.lit(1.0))
    compound = F.when(F.col("tag").startswith("vb"), F.lit(0.1)).otherwise(F.lit(1.0))
    return t.crossJoin(F.broadcast(total)).select("tag", "freq", prob.alias("uni"), compound.alias("compound_prob"))  # one row


def bigram_scores(uni: DataFrame, bi: DataFrame, c: TaggingConfig = TAGGING) -> DataFrame:
    """ST5: lambda_uni * uni(j) + [C(i,j) > 0] * (lambda_bi * C(i,j) / C(i) + epsilon), for all pairs of tags."""
    i, j = uni.select(F.col("tag").alias("t1"), F.col("freq").alias("f1")), uni.select(F.col("tag").alias("t2"), F.col("uni").alias("u2"))
    p = i.crossJoin(j).join(bi, ["t1", "t2"], "left")  # tags by tags: both are fixed by the tag set
    seen = F.when(F.col("freq").isNotNull(), F.lit(c.lambda_bi) * F.col("freq") / F.col("f1") + F.lit(c.epsilon_tri)).otherwise(F.lit(0.0))
    return p.select("t1", "t2", F.coalesce("freq", F.lit(0)).alias("freq"), (F.lit(c.lambda_uni) * F.col("u2") + seen).alias("prob"))


def trigram_scores(uni: DataFrame, bi: DataFrame, tri: DataFrame, c: TaggingConfig = TAGGING) -> DataFrame:
    """ST6: lambda_uni uni(t3) + lambda_bi C(t2,t3) / C(t2) + lambda_tri C(t1,t2,t3) C(t1,t2) ** (exponent - 1)."""
    if c.lambda_tri_exp >= 0.6:
        raise ValueError("lambda_tri_exp must be below 0.6")
    b23 = bi.select(F.col("t1").alias("t2"), F.col("t2").alias("t3"), F.col("freq").alias("f23"))
    b12 = bi.select("t1", "t2", F.col("freq").alias("f12"))
    f2 = uni.select(F.col("tag").alias("t2"), F.col("freq").alias("f2"))
    u3 = uni.select(F.col("tag").alias("t3"), F.col("uni").alias("u3"))
    p = tri.join(b23, ["t2", "t3"]).join(b12, ["t1", "t2"]).join(f2, "t2").join(u3, "t3")
    prob = F.lit(c.lambda_uni) * F.col("u3") + F.lit(c.lambda_bi) * F.col("f23") / F.col("f2") + F.lit(c.lambda_tri) * F.col("freq") * F.pow("f12", F.lit(c.lambda_tri_exp - 1))
    return p.select("t1", "t2", "t3", "freq", prob.alias("prob"))


def backed_off(asked: DataFrame, tri_scores: DataFrame, bi_scores: DataFrame) -> DataFrame:
    """ST7: the trigram's score if it was seen, else that of its last two tags."""
    t = tri_scores.select("t1", "t2", "t3", F.col("prob").alias("p3"))
    b = bi_scores.select(F.col("t1").alias("t2"), F.col("t2").alias("t3"), F.col("prob").alias("p2"))
    return asked.join(t, ["t1", "t2", "t3"], "left").join(b, ["t2", "t3"], "left").select("t1", "t2", "t3", F.coalesce("p3", "p2").alias("prob"))


def word_tags(words: DataFrame) -> DataFrame:
    """The lexicon: (word, tag, tag_freq, word_freq, tag_total)."""
    wt = words.groupBy(F.col("norm").alias("word"), "tag").agg(F.count("*").alias("tag_freq"))
    w = wt.groupBy("word").agg(F.sum("tag_freq").alias("word_freq"))
    t = wt.groupBy("tag").agg(F.sum("tag_freq").alias("tag_total"))
    return wt.join(w, "word").join(t, "tag").select("word", "tag", "tag_freq", "word_freq", "tag_total")


def lexical_scores(wt: DataFrame, c: TaggingConfig = TAGGING) -> DataFrame:
    """ST10: C(w,t) / C(t), C(w,t) / C(w), and their weighted sum."""
    a, b = F.col("tag_freq") / F.col("tag_total"), F.col("tag_freq") / F.col("word_freq")
    return wt.select("word", "tag", a.alias("eq19"), b.alias("eq20"), (F.lit(c.lambda_19) * b + a).alias("eq21"))


def extra_scores(readings: DataFrame, c: TaggingConfig = TAGGING) -> DataFrame:
    """ST11: (word, word_freq or null, tag, tag_total, is_content, lex) -> score of a reading that was not observed."""
    known = F.col("word_freq").isNotNull()
    lex = F.when(F.col("is_content"), F.col("lex"))
    of_known = F.pow("word_freq", F.lit(-c.alpha_extra)) * F.lit(c.lambda_extra) * F.coalesce(lex, F.lit(c.epsilon_extra))
    return readings.withColumn("score", F.when(known, of_known).otherwise(F.lit(c.epsilon_extra) * F.coalesce(lex, F.lit(1.0)) / F.col("tag_total")))


def suffix_table(wt: DataFrame, longest: int = 5, c: TaggingConfig = TAGGING) -> DataFrame:
    """ST13: (suffix, len, tag, tag_freq, suffix_freq, score), for suffixes of 1 to 5 letters after at least two."""
    s = wt.select("tag", "tag_freq", "word", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - c.min_prefix))).alias("len")) if longest else wt
    s = s.where(F.length("word") - F.col("len") >= c.min_prefix).where("len > 0")
    s = s.groupBy(F.expr("right(word, len)").alias("suffix"), "len", "tag").agg(F.sum("tag_freq").alias("tag_freq"))
    total = s.groupBy("suffix").agg(F.sum("tag_freq").alias("suffix_freq"))
    alpha = F.element_at(F.array(*[F.lit(a) for a in c.alpha_last]), F.col("len"))
    return s.join(total, "suffix").select("suffix", "len", "tag", "tag_freq", "suffix_freq", (alpha * F.col("tag_freq") / F.col("suffix_freq")).alias("score"))
