"""Corpus statistics, smoothing, index terms and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from runeflow.config import TAGGING as C
from runeflow.functions import scan
from runeflow.operators import ngrams as N
from runeflow.operators import ranking as R
from runeflow.plans.catalogue import query, table
from runeflow.plans.text_queries import T, W, rows, toks, words

_UNI = """, tg AS (SELECT tag, count(*) AS freq FROM tk GROUP BY tag), un AS (SELECT tag, freq, freq / (SELECT sum(freq) FROM tg) * CASE WHEN contains(tag, 'sms') THEN 1e-6 ELSE 1.0 END AS uni, CASE WHEN tag LIKE 'vb%' THEN 0.1 ELSE 1.0 END AS compound_prob FROM tg)"""
_SH = """, sh AS (SELECT tag AS t1, lead(tag) OVER w AS t2, lead(tag, 2) OVER w AS t3 FROM tk WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY pos)),
bg AS (SELECT t1, t2, count(*) AS freq FROM sh WHERE t2 IS NOT NULL GROUP BY ALL), tr AS (SELECT t1, t2, t3, count(*) AS freq FROM sh WHERE t3 IS NOT NULL GROUP BY ALL)"""
_P2 = f""", p2 AS (SELECT a.tag AS t1, b.tag AS t2, coalesce(g.freq, 0) AS freq, {C.lambda_uni} * b.uni + CASE WHEN g.freq IS NOT NULL THEN {C.lambda_bi}::DOUBLE * g.freq / a.freq + {C.epsilon_tri} ELSE 0 END AS prob FROM un a CROSS JOIN un b LEFT JOIN bg g ON g.t1 = a.tag AND g.t2 = b.tag)"""
_P3 = f""", p3 AS (SELECT tr.*, {C.lambda_uni} * u.uni + {C.lambda_bi}::DOUBLE * b.freq / v.freq + {C.lambda_tri}::DOUBLE * tr.freq * pow(a.freq, {C.lambda_tri_exp - 1}) AS prob FROM tr JOIN bg b ON b.t1 = tr.t2 AND b.t2 = tr.t3 JOIN bg a ON a.t1 = tr.t1 AND a.t2 = tr.t2 JOIN un v ON v.tag = tr.t2 JOIN un u ON u.tag = tr.t3)"""
_WT = """, w1 AS (SELECT norm AS word, tag, count(*) AS tag_freq FROM wd GROUP BY ALL), wt AS (SELECT *, sum(tag_freq) OVER (PARTITION BY word)::BIGINT AS word_freq, sum(tag_freq) OVER (PARTITION BY tag)::BIGINT AS tag_total FROM w1)"""
_SX = f""", sx AS (SELECT right(word, len) AS suffix, len, tag, sum(tag_freq)::BIGINT AS tag_freq FROM wt, (SELECT unnest(range(1, 6)) AS len) WHERE length(word) - len >= {C.min_prefix} GROUP BY ALL)"""


@query("st1_tag_unigram_prob", T + _UNI + " SELECT tag, freq, round(uni, 9) AS uni, compound_prob::DOUBLE AS compound_prob FROM un")
def st1(spark, sf_dir):
    return N.unigrams(toks(spark, sf_dir)).withColumn("uni", F.round("uni", 9))


@query("st2_tag_members", W + ", m AS (SELECT tag, count(DISTINCT norm) AS members FROM wd GROUP BY tag) SELECT tag, members, round(members / sum(members) OVER (), 9) AS share FROM m")
def st2(spark, sf_dir):
    """Members of a tag: distinct words that carry it."""
    m = words(spark, sf_dir).groupBy("tag").agg(F.countDistinct("norm").alias("members"))
    return m.crossJoin(F.broadcast(m.agg(F.sum("members").alias("total")))).select("tag", "members", F.round(F.col("members") / F.col("total"), 9).alias("share"))


@query("st3_tag_bigrams", T + _SH + " SELECT t1, t2, freq FROM bg")
def st3(spark, sf_dir):
    return N.ngram_counts(toks(spark, sf_dir, True), "tag", 2)


@query("st4_tag_trigrams", T + _SH + " SELECT t1, t2, t3, freq FROM tr")
def st4(spark, sf_dir):
    return N.ngram_counts(toks(spark, sf_dir, True), "tag", 3)


def _counts(spark, sf_dir):
    """Unigrams, bigrams and trigrams from one pass over the texts: the counts of shifted tags hold all three.

    They are counted once and held as a table on the driver, which the tag set bounds.
    """
    counted = N.scanned_trigrams(table(spark, sf_dir, "documents"))
    all3 = spark.createDataFrame(counted.collect(), counted.schema).coalesce(1)  # at most the cube of the tag set
    tri = all3.where("t3 is not null")
    bi = all3.where("t2 is not null").groupBy("t1", "t2").agg(F.sum("freq").alias("freq"))
    one = all3.groupBy(F.col("t1").alias("tag")).agg(F.sum("freq").alias("freq"))
    total = one.agg(F.sum("freq").alias("total"))
    uni = one.crossJoin(F.broadcast(total)).select("tag", "freq", (F.col("freq") / F.col("total")).alias("uni"))
    return uni, bi, tri


@query("st5_bigram_smoothed", T + _UNI + _SH + _P2 + " SELECT t1, t2, freq, round(prob, 8) AS prob FROM p2")
def st5(spark, sf_dir):
    uni, bi, _ = _counts(spark, sf_dir)
    return N.bigram_scores(uni, bi).withColumn("prob", F.round("prob", 8))


@query("st6_trigram_smoothed", T + _UNI + _SH + _P3 + " SELECT t1, t2, t3, freq, round(prob, 7) AS prob FROM p3")
def st6(spark, sf_dir):
    return N.trigram_scores(*_counts(spark, sf_dir)).withColumn("prob", F.round("prob", 7))


@query("st7_trigram_backoff", T + _UNI + _SH + _P2 + _P3 + " SELECT a.tag AS t1, b.tag AS t2, c.tag AS t3, round(coalesce(p3.prob, p2.prob), 7) AS prob FROM un a CROSS JOIN un b CROSS JOIN un c LEFT JOIN p3 ON p3.t1 = a.tag AND p3.t2 = b.tag AND p3.t3 = c.tag LEFT JOIN p2 ON p2.t1 = b.tag AND p2.t2 = c.tag")
def st7(spark, sf_dir):
    uni, bi, tri = _counts(spark, sf_dir)
    one = lambda c: uni.select(F.col("tag").alias(c))
    asked = one("t1").crossJoin(one("t2")).crossJoin(one("t3"))  # all triples of the tag set
    return N.backed_off(asked, N.trigram_scores(uni, bi, tri), N.bigram_scores(uni, bi)).withColumn("prob", F.round("prob", 7))


@query("st8_pair_prob", T + _UNI + _SH + " SELECT bg.t1, bg.t2, round(un.uni * bg.freq / un.freq, 9) AS prob FROM bg JOIN un ON un.tag = bg.t1")
def st8(spark, sf_dir):
    uni, bi, _ = _counts(spark, sf_dir)
    return bi.join(uni, bi.t1 == uni.tag).select("t1", "t2", F.round(F.col("uni") * bi.freq / uni.freq, 9).alias("prob"))


@query("st10_lexical_prob", W + _WT + f" SELECT word, tag, round(tag_freq / tag_total, 9) AS eq19, round(tag_freq / word_freq, 9) AS eq20, round({C.lambda_19} * (tag_freq / word_freq) + tag_freq / tag_total, 9) AS eq21 FROM wt")
def st10(spark, sf_dir):
    s = N.lexical_scores(N.word_tags(words(spark, sf_dir)))
    return s.select("word", "tag", *[F.round(c, 9).alias(c) for c in ("eq19", "eq20", "eq21")])


@query(
    "st11_extra_readings",
    W + _WT + f""", ra AS (SELECT word, word_freq, tag AS had FROM wt WHERE tag = 'word.cap' AND word_freq = tag_freq), tt AS (SELECT DISTINCT tag, tag_total FROM wt WHERE tag = 'word.low')
SELECT word, tt.tag, round(pow(word_freq, -{C.alpha_extra}) * {C.lambda_extra}::DOUBLE * (word_freq / tag_total), 12) AS score FROM ra, tt""",
)
def st11(spark, sf_dir):
    """Words only seen with a capital get a lower-case reading as an extra one."""
    w = words(spark, sf_dir)
    low = w.where("tag = 'word.low'").groupBy("tag").agg(F.count("*").alias("tag_total"))  # one row
    v = w.groupBy(F.col("norm").alias("word")).agg(F.count("*").alias("word_freq"), F.count_if(F.col("tag") == "word.cap").alias("capped")).where("capped = word_freq")
    r = v.select("word", "word_freq").crossJoin(F.broadcast(low)).withColumn("is_content", F.lit(True)).withColumn("lex", F.col("word_freq") / F.col("tag_total"))
    return N.extra_scores(r).select("word", "tag", F.round("score", 12).alias("score"))


@query("st13_suffix_stats", W + _WT + _SX + f", sc AS (SELECT *, sum(tag_freq) OVER (PARTITION BY suffix)::BIGINT AS suffix_freq FROM sx) SELECT suffix, len::INT AS len, tag, tag_freq, suffix_freq, round([{', '.join(map(str, C.alpha_last))}][len]::DOUBLE * tag_freq / suffix_freq, 8) AS score FROM sc")
def st13(spark, sf_dir):
    return N.suffix_table(N.word_tags(words(spark, sf_dir))).withColumn("score", F.round("score", 8))


@query("io5_suffix_consistency", W + _WT + _SX + ", a AS (SELECT suffix, sum(tag_freq) AS s FROM sx GROUP BY suffix), b AS (SELECT right(norm, len) AS suffix, count(*) AS n FROM wd, (SELECT unnest(range(1, 6)) AS len) WHERE length(norm) - len >= 2 GROUP BY ALL) SELECT count(*) AS n_suffixes, count(*) FILTER (s <> n) AS n_wrong FROM a FULL JOIN b USING (suffix)")
def io5(spark, sf_dir):
    """Frequencies of a suffix's tags must add up to its own, counted apart."""
    w = words(spark, sf_dir)
    a = N.suffix_table(N.word_tags(w)).groupBy("suffix").agg(F.sum("tag_freq").alias("s"))
    b = w.select(F.col("norm"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("len")).where("length(norm) - len >= 2").groupBy(F.expr("right(norm, len)").alias("suffix")).agg(F.count("*").alias("n"))
    return a.join(b, "suffix", "full").agg(F.count("*").alias("n_suffixes"), F.count_if(F.col("s") != F.col("n")).alias("n_wrong"))


@query("st14_vocabulary", W + " SELECT norm AS word, count(*) AS freq, count(DISTINCT doc_id) AS n_docs FROM wd GROUP BY norm")
def st14(spark, sf_dir):
    # documents per word from counts per document: one partial aggregate, no expansion for the distinct count
    per = words(spark, sf_dir).groupBy("norm", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy(F.col("norm").alias("word")).agg(F.sum("n").alias("freq"), F.count("*").alias("n_docs"))


@query(
    "st15_new_words",
    W + r""", lx AS (SELECT norm FROM wd GROUP BY norm HAVING count(DISTINCT doc_id) >= 2)
SELECT norm AS word, count(*) AS freq, bool_and(regexp_matches(tok, '^\p{Lu}')) AS always_capped, NOT regexp_matches(max_by(tok, doc_id * 1000000 + pos), '^[A-Za-z]') AS is_foreign FROM wd WHERE norm NOT IN (SELECT norm FROM lx) GROUP BY norm""",
)
def st15(spark, sf_dir):
    """Words outside the lexicon, from all their occurrences: always capitalised; foreign by the first letter of the last."""
    w = words(spark, sf_dir)
    new = w.groupBy("norm").agg(F.count("*").alias("freq"), F.bool_and(F.col("tok").rlike(r"^\p{Lu}")).alias("always_capped"), F.max_by("tok", F.struct("doc_id", "pos")).alias("last"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    return new.where("a = b").select(F.col("norm").alias("word"), "freq", "always_capped", (~F.col("last").rlike("^[A-Za-z]")).alias("is_foreign"))


@query("st17_totals", T + _SH + " SELECT (SELECT count(DISTINCT t1) FROM sh) AS ct, (SELECT count(*) FROM bg) AS ctt, (SELECT count(*) FROM tr) AS cttt, (SELECT count(*) FROM (SELECT DISTINCT norm, tag FROM tk)) AS cwt")
def st17(spark, sf_dir):
    uni, bi, tri = _counts(spark, sf_dir)
    n = lambda df, c: df.agg(F.count("*").alias(c))
    wt = toks(spark, sf_dir).groupBy("norm", "tag").agg(F.lit(1).alias("one"))
    return n(uni, "ct").crossJoin(n(bi, "ctt")).crossJoin(n(tri, "cttt")).crossJoin(n(wt, "cwt"))  # one row each


@query("st18_tag_rollup", T + _SH + " SELECT coalesce(t1, '*') AS t1, coalesce(t2, '*') AS t2, sum(freq)::BIGINT AS freq FROM tr GROUP BY ROLLUP (t1, t2)")
def st18(spark, sf_dir):
    tri = N.ngram_counts(toks(spark, sf_dir, True), "tag", 3)
    r = tri.rollup("t1", "t2").agg(F.sum("freq").alias("freq"))
    return r.select(F.coalesce("t1", F.lit("*")).alias("t1"), F.coalesce("t2", F.lit("*")).alias("t2"), "freq")


@query("st20_word_bigrams", W + ", b AS (SELECT norm AS t1, lead(norm) OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS t2 FROM wd) SELECT t1, t2, count(*) AS freq FROM b WHERE t2 IS NOT NULL GROUP BY ALL")
def st20(spark, sf_dir):
    return N.ngram_counts(words(spark, sf_dir, True), "norm", 2)


_RK8 = """, te AS (SELECT doc_id, norm AS term, count(*) AS n FROM wd WHERE length(norm) >= 5 GROUP BY ALL), co AS (SELECT term, sum(n) AS freq, count(*) AS nd FROM te GROUP BY term), dt AS (SELECT doc_id, sum(n) AS tot FROM te GROUP BY doc_id),
sc AS (SELECT te.doc_id, te.term, round(100 * (n / tot + n / freq + n / nd), 6) AS score, round(100 * n / freq, 6) AS doc_share FROM te JOIN co USING (term) JOIN dt ON dt.doc_id = te.doc_id)
SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank, term, score, doc_share FROM sc) WHERE rank <= 5"""


@query("rk8_index_terms", W + _RK8)
def rk8(spark, sf_dir):
    """The five terms that say most about each document; terms are words of five letters or more."""
    w = words(spark, sf_dir).where(F.length("norm") >= 5)
    return R.index_terms(w.select("doc_id", F.col("norm").alias("term")))


@query("rk9_canonical_terms", W + ", te AS (SELECT doc_id, CASE WHEN right(norm, 1) = 's' AND length(norm) > 5 THEN left(norm, length(norm) - 1) ELSE norm END AS term FROM wd WHERE length(norm) >= 5) SELECT term, count(*) AS freq, count(DISTINCT doc_id) AS n_docs FROM te GROUP BY term")
def rk9(spark, sf_dir):
    """Terms counted under their preferred form: use, else preferred, else the word; here a plural's preferred form is its singular."""
    w = words(spark, sf_dir).where(F.length("norm") >= 5)
    preferred = F.when(F.col("norm").endswith("s") & (F.length("norm") > 5), F.expr("left(norm, length(norm) - 1)"))
    per = w.groupBy("doc_id", F.coalesce(preferred, "norm").alias("term")).agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("freq"), F.count("*").alias("n_docs"))


@query("rk3_prefix_suggestions", W + ", v AS (SELECT norm AS word, count(*) AS freq FROM wd WHERE length(norm) >= 4 GROUP BY norm) SELECT * FROM (SELECT left(word, 2) AS prefix, row_number() OVER (PARTITION BY left(word, 2) ORDER BY freq DESC, word) AS rank, word, freq FROM v) WHERE rank <= 5")
def rk3(spark, sf_dir):
    """LX19, RK3: the likeliest words with each two-letter prefix."""
    v = words(spark, sf_dir).where(F.length("norm") >= 4).groupBy(F.col("norm").alias("word")).agg(F.count("*").alias("freq"))
    return R.best(v.withColumn("prefix", F.expr("left(word, 2)")), ["prefix"], [F.desc("freq"), F.asc("word")], 5).select("prefix", "rank", "word", "freq")


@query(
    "rk4_sort_modes",
    W + ", v AS (SELECT tag, norm AS word, count(*) AS freq FROM wd GROUP BY ALL) SELECT * FROM (" + " UNION ALL ".join(f"SELECT tag, '{m}' AS mode, row_number() OVER (PARTITION BY tag ORDER BY {o}) AS rank, word FROM v" for m, o in (("alpha", "word"), ("length", "length(word), word"), ("prob", "freq DESC, word"))) + ") WHERE rank <= 10",
)
def rk4(spark, sf_dir):
    v = words(spark, sf_dir).groupBy("tag", F.col("norm").alias("word")).agg(F.count("*").alias("freq"))
    parts = [R.best(v, ["tag"], R.sort_modes(v, "word", "freq", m), 10).select("tag", F.lit(m).alias("mode"), "rank", "word") for m in ("alpha", "length", "prob")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_PRED = """, b AS (SELECT norm AS w1, lead(norm) OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS w2 FROM wd), c AS (SELECT w1, w2, count(*) AS n FROM b WHERE w2 IS NOT NULL GROUP BY ALL), f AS (SELECT norm AS w2, count(*) AS freq FROM wd GROUP BY norm),
s AS (SELECT w1, w2, round(n / sum(n) OVER (PARTITION BY w1) * pow(freq, 0.02), 9) AS score FROM c JOIN f USING (w2))
SELECT * FROM (SELECT w1, row_number() OVER (PARTITION BY w1 ORDER BY score DESC, w2) AS rank, w2, score FROM s) WHERE rank <= 3"""


@query("rk6_next_word", W + _PRED)
def rk6(spark, sf_dir):
    """Three likeliest next words: share of the bigram times the word's frequency to the power 0.02."""
    w = words(spark, sf_dir, True)
    c = N.ngram_counts(w, "norm", 2).select(F.col("t1").alias("w1"), F.col("t2").alias("w2"), F.col("freq").alias("n"))
    total = c.groupBy("w1").agg(F.sum("n").alias("total"))
    f = words(spark, sf_dir).groupBy(F.col("norm").alias("w2")).agg(F.count("*").alias("freq"))
    s = c.join(total, "w1").join(f, "w2").withColumn("score", F.round(F.col("n") / F.col("total") * F.pow("freq", F.lit(0.02)), 9))
    return R.best(s, ["w1"], [F.desc("score"), F.asc("w2")], 3).select("w1", "rank", "w2", "score")
