"""Further operators on tokens, rules and words."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from runeflow.functions import scan
from runeflow.operators import rules as R
from runeflow.operators.rules import Element, Rule
from runeflow.plans import sql
from runeflow.plans.catalogue import query
from runeflow.plans.lexicon_queries import _LX, _PA, _RT, RULES, _vocabulary
from runeflow.plans.rule_queries import ALL, CATEGORIES, NP, _matches, _sql
from runeflow.plans.text_queries import T, W, lexicon, toks, words


@query("pr14_bio_chunks", T + _sql([NP]) + ", ft AS (SELECT doc_id, sent_id, start, max(n) AS n FROM ma GROUP BY ALL), co AS (SELECT a.* FROM ft a WHERE NOT EXISTS (SELECT 1 FROM ft b WHERE b.doc_id = a.doc_id AND b.sent_id = a.sent_id AND b.start < a.start AND b.start + b.n > a.start)), lb AS (SELECT doc_id, unnest(range(0, n)) AS k FROM co) SELECT doc_id, count(*) FILTER (k = 0) AS n_begin, count(*) FILTER (k > 0) AS n_inside FROM lb GROUP BY doc_id")
def pr14(spark, sf_dir):
    """Begin and inside labels of phrases that start in no earlier one."""
    m = _matches(spark, sf_dir, [NP]).groupBy("doc_id", "sent_id", "start").agg(F.max("n").alias("n"))
    reach = F.max(F.expr("start + n")).over(Window.partitionBy("doc_id", "sent_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    c = m.withColumn("reach", F.coalesce(reach, F.lit(0))).where("start >= reach")
    return c.groupBy("doc_id").agg(F.count("*").alias("n_begin"), F.sum(F.col("n") - 1).cast("long").alias("n_inside"))


@query("pr10_match_order", T + _sql([NP]) + " SELECT doc_id, sent_id, start, n, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY n, start) AS place FROM ma")
def pr10(spark, sf_dir):
    """Matches by length, then by where they begin."""
    m = _matches(spark, sf_dir, [NP])
    return m.select("doc_id", "sent_id", F.col("start").cast("long").alias("start"), F.col("n").cast("long").alias("n"), F.row_number().over(Window.partitionBy("doc_id", "sent_id").orderBy("n", "start")).alias("place"))


@query("ev12_rule_usage", T + _sql(ALL) + ", rs(rule) AS (VALUES " + ", ".join(f"('{r.name}')" for r in [*ALL, Rule(9, "never", "style", (Element("norm = 'zzzz'"),))]) + ") SELECT rs.rule, count(ma.rule_no) AS n, count(ma.rule_no) = 0 AS unused FROM rs LEFT JOIN ma USING (rule) GROUP BY rs.rule")
def ev12(spark, sf_dir):
    """SO2: how often each rule was used, and those never used."""
    used = _matches(spark, sf_dir, ALL).groupBy("rule").agg(F.count("*").alias("k"))
    names = spark.createDataFrame([(r.name,) for r in ALL] + [("never",)], "rule string")
    return names.join(used, "rule", "left").select("rule", F.coalesce("k", F.lit(0)).alias("n"), F.col("k").isNull().alias("unused"))


@query("ru5_rule_diagnostics", "SELECT * FROM (VALUES ('jumpy: jumps backwards'), ('lost: category nowhere is not declared'), ('empty: matches nothing at all')) t(message)")
def ru5(spark, sf_dir):
    bad = [Rule(5, "jumpy", "style", (Element("true"),), jump=3), Rule(6, "lost", "nowhere", (Element("true"),)), Rule(7, "empty", "style", (Element("true", "*"),))]
    return spark.createDataFrame([(m,) for m in R.diagnose([*ALL, *bad], set(CATEGORIES))], "message string")


@query("lx20_abbreviations", T + ", ab AS (SELECT DISTINCT left(norm, 2) AS short FROM tk WHERE cls = 'simple_word' AND length(norm) = 2) SELECT norm, count(*) AS n FROM tk JOIN ab ON ab.short = norm GROUP BY norm")
def lx20(spark, sf_dir):
    """Tokens found in a list of short forms."""
    t = toks(spark, sf_dir)
    n = t.groupBy("norm", "cls").agg(F.count("*").alias("n"))
    short = n.where("cls = 'simple_word' and length(norm) = 2").select("norm").distinct()
    return n.join(short, "norm", "left_semi").groupBy("norm").agg(F.sum("n").alias("n"))


@query("lx24_thesaurus_forms", W + _RT + _PA + " SELECT word AS term, form, tag FROM pa WHERE form IS NOT NULL AND length(word) BETWEEN 6 AND 8")
def lx24(spark, sf_dir):
    """All forms of the terms of a thesaurus: here the words of six to eight letters."""
    from runeflow.operators import lexicon as L

    terms = _vocabulary(spark, sf_dir).where("length(word) between 6 and 8")
    return L.paradigm(terms, L.rule_table(spark, RULES)).select(F.col("word").alias("term"), "form", "tag")


@query("lx2_main_or_new", W + _LX + ", f AS (SELECT norm, count(*) AS n FROM wd GROUP BY norm) SELECT coalesce(CASE WHEN lx.norm IS NOT NULL THEN 'main' END, CASE WHEN n > 1 THEN 'new, seen again' END, 'new') AS lexicon, count(*) AS n_words, sum(n)::BIGINT AS n_tokens FROM f LEFT JOIN lx USING (norm) GROUP BY 1")
def lx2(spark, sf_dir):
    w = words(spark, sf_dir)
    f = w.groupBy("norm").agg(F.count("*").alias("n")).join(lexicon(w).withColumn("k", F.lit(1)), "norm", "left")
    where = F.coalesce(F.when(F.col("k").isNotNull(), "main"), F.when(F.col("n") > 1, "new, seen again"), F.lit("new"))
    return f.groupBy(where.alias("lexicon")).agg(F.count("*").alias("n_words"), F.sum("n").alias("n_tokens"))


@query("rk5_suggestions_without_repeats", W + ", v AS (SELECT norm AS word, count(*) AS freq FROM wd WHERE length(norm) >= 4 GROUP BY norm), r AS (SELECT left(word, 2) AS prefix, word, row_number() OVER (PARTITION BY left(word, 2) ORDER BY freq DESC, word) AS rank FROM v) SELECT prefix, word, (rank - 3)::INT AS rank FROM r WHERE rank BETWEEN 4 AND 6")
def rk5(spark, sf_dir):
    """The next three words of each prefix once the first three were shown: an anti join with the history."""
    from runeflow.operators import ranking as K

    v = words(spark, sf_dir).where(F.length("norm") >= 4).groupBy(F.col("norm").alias("word")).agg(F.count("*").alias("freq")).withColumn("prefix", F.expr("left(word, 2)"))
    order = [F.desc("freq"), F.asc("word")]
    shown = K.best(v, ["prefix"], order, 3).select("word")
    return K.best(v.join(shown, "word", "left_anti"), ["prefix"], order, 3).select("prefix", "word", "rank")


@query("ev3_without_punctuation", T + f" SELECT doc_id, count(*) AS n, count(*) FILTER ({sql.WORDS}) AS n_without, round(100 * count(*) FILTER (NOT ({sql.WORDS})) / count(*), 6) AS punct_share FROM tk GROUP BY doc_id")
def ev3(spark, sf_dir):
    w = F.col("cls").isin(*scan.WORDS)
    t = toks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(w).alias("n_without"))
    return t.withColumn("punct_share", F.round(100 * (F.col("n") - F.col("n_without")) / F.col("n"), 6))


@query("se4_headings", T + f", s AS (SELECT doc_id, sent_id, count(*) FILTER ({sql.WORDS}) AS n, arg_max(cls, pos) AS last FROM tk GROUP BY ALL) SELECT doc_id, count(*) FILTER (n BETWEEN 1 AND 8 AND last NOT IN ('period', 'question_mark', 'exclamation_mark')) AS n_headings FROM s GROUP BY doc_id")
def se4(spark, sf_dir):
    """Short sentences that no mark ends."""
    s = toks(spark, sf_dir, True).groupBy("doc_id", "sent_id").agg(F.count_if(F.col("cls").isin(*scan.WORDS)).alias("n"), F.max_by("cls", "pos").alias("last"))
    return s.groupBy("doc_id").agg(F.count_if(F.col("n").between(1, 8) & ~F.col("last").isin(*scan.ENDERS)).alias("n_headings"))
