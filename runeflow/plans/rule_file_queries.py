"""Rules read from a rule file, and what a text's errors look like in the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from runeflow.operators import rulefile as RF
from runeflow.operators import rules as R
from runeflow.plans import sql
from runeflow.plans.catalogue import query
from runeflow.plans.rule_queries import _JUMP, _matches, _sql, _with_words, ALL, ART, NP, OF_THE, THE
from runeflow.plans.text_queries import T, rows, toks

TEXT = """
category article: wrong article
category style: matters of style
category phrase: phrases
rule 11 vowel_after_a in article
  a: word = 'a'
  b: starts(word, '[aeiou]') and not class = 'abbreviation'
  info an stands before a vowel
  fix replace a an
  fires it was a apple
  silent it was a pear
help 12 long_word in phrase
  w: length(word) > 8
rule 13 long_pair in style
  a: tag in ('word.low', 'word.cap') and length(word) > 7
  b: (tag = 'word.low' or tag = 'word.cap') and length(word) > 7
  agree a.case b.case
  fires some wonderful programmes
  silent some good programmes
rule 14 ing_form in phrase
  left a: word != 'the'
  b: word ~ /[a-z]+(ing|tion)/ +
  fires they are singing
  silent sing it
accept 15 of_the jump 17
  a: word = 'of'
  b: word in ('the', 'a')
rule 16 the_short in style
  a: word = 'the'
  b: length(word) < 5 and left(tag, 4) = 'word'
"""
FILE = RF.parse(TEXT)
RULES = RF.active(FILE, off=("none",))


def _like(s: str) -> str:
    return s.replace("regexp_like(", "regexp_matches(")


_FIT = ", fi AS (SELECT ma.* FROM ma JOIN (SELECT doc_id, sent_id, list(tag ORDER BY pos) AS ts FROM tk GROUP BY ALL) USING (doc_id, sent_id) WHERE rule_no <> 13 OR split_part(ts[start + 1], '.', 2) = split_part(ts[start + 2], '.', 2))"


def _found(spark, sf_dir, rules=RULES):
    return RF.fitting(R.each_match(R.row_matches(R.tagged(rows(spark, sf_dir)), rules), "ts"), FILE)


@query("ru1_rule_file", T + _like(_sql(RULES)) + _FIT + " SELECT doc_id, rule, count(*) AS n, sum(n)::BIGINT AS n_tokens FROM fi GROUP BY ALL")
def ru1(spark, sf_dir):
    """RU1, RU9, RU14 to RU17, RU19: the rules of a file, with a regular expression, functions and an agreement."""
    return _found(spark, sf_dir).groupBy("doc_id", "rule").agg(F.count("*").alias("n"), F.sum("n").cast("long").alias("n_tokens"))


@query("ru3_inactive_category", T + _like(_sql([r for r in RULES if r.category != "style"])) + " SELECT rule_no, rule, count(*) AS n FROM ma GROUP BY ALL")
def ru3(spark, sf_dir):
    """One category switched off; help rules are never active."""
    return _matches(spark, sf_dir, RF.active(FILE, off=("style",))).groupBy("rule_no", "rule").agg(F.count("*").alias("n"))


@query("ru24_rule_profile", T + _like(_sql(RULES)) + ", p AS (SELECT rule, count(*) AS n FROM ma GROUP BY rule) SELECT rule, n, round(n / sum(n) OVER (), 6) AS share FROM p QUALIFY n / sum(n) OVER () > 0.01")
def ru24(spark, sf_dir):
    """Rules that take more than a hundredth of all matches."""
    n = _matches(spark, sf_dir, RULES).groupBy("rule").agg(F.count("*").alias("n"))
    share = F.col("n") / F.col("total")
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).where(share > 0.01).select("rule", "n", F.round(share, 6).alias("share"))  # one row for each rule


_DATE = "([0-9]{1,2})[:/.]([0-9]{2})"


@query("ru20_text_patterns", f"SELECT doc_id, 1 AS rule_no, strpos(text, regexp_extract(text, '{_DATE}', 0)) - 1 AS start, length(regexp_extract(text, '{_DATE}', 0)) AS n, regexp_extract(text, '{_DATE}', 1) AS g1, regexp_extract(text, '{_DATE}', 2) AS g2, len(regexp_extract_all(text, '{_DATE}')) AS n_matches FROM documents WHERE regexp_matches(text, '{_DATE}')")
def ru20(spark, sf_dir):
    """A pattern over the text itself: its first match with its groups, and how many there are."""
    from runeflow.plans.catalogue import table

    g = lambda k: F.regexp_extract("text", _DATE, k)
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike(_DATE))
    return d.select("doc_id", F.lit(1).alias("rule_no"), (F.regexp_instr("text", F.lit(_DATE)) - 1).cast("long").alias("start"), F.length(g(0)).cast("long").alias("n"), g(1).alias("g1"), g(2).alias("g2"), F.regexp_count("text", F.lit(_DATE)).cast("long").alias("n_matches"))


_ANCHORED = [ART, OF_THE, THE]


@query("ru22_anchored_rules", T + ", an(rule, word) AS (VALUES " + ", ".join(f"('{r.name}', {sql.quoted(w)})" for r in _ANCHORED for w in RF.anchors(r)) + ") SELECT rule, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM tk JOIN an ON an.word = tk.norm GROUP BY rule")
def ru22(spark, sf_dir):
    """Words without which a rule can't match, derived from its tests, and where they stand."""
    a = spark.createDataFrame([(r.name, w) for r in _ANCHORED for w in RF.anchors(r)], "rule string, norm string")
    return toks(spark, sf_dir).join(F.broadcast(a), "norm").groupBy("rule").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n"))


_SW = ", sw AS (SELECT doc_id, sent_id, list(norm ORDER BY pos) AS words FROM tk GROUP BY ALL)"


@query("er7_marked_area", T + _sql([NP]) + _SW + " SELECT doc_id, CASE WHEN n = len(words) THEN 'whole' ELSE 'part' END AS marked, count(*) AS n, sum(CASE WHEN n = len(words) THEN 0 ELSE n END)::BIGINT AS area FROM ma JOIN sw USING (doc_id, sent_id) GROUP BY ALL")
def er7(spark, sf_dir):
    """Without marks of its own a match is marked as a whole; if that is the whole sentence the marked area is empty."""
    j = _matches(spark, sf_dir, [NP])
    whole = F.col("n") == F.col("size")
    return j.groupBy("doc_id", F.when(whole, "whole").otherwise("part").alias("marked")).agg(F.count("*").alias("n"), F.sum(F.when(whole, 0).otherwise(F.col("n"))).cast("long").alias("area"))


@query("er11_suggestion_text", T + _sql([ART]) + _SW + " SELECT doc_id, sent_id, start, edit_no, CASE edit_no WHEN 1 THEN words[start + 2] ELSE 'an ' || words[start + 2] END AS suggestion FROM ma JOIN sw USING (doc_id, sent_id), (VALUES (1), (2)) e(edit_no)")
def er11(spark, sf_dir):
    """The corrected words in place of the marked ones."""
    c = R.edited(_with_words(spark, sf_dir, [ART]), [ART]).where("status = 'ok'")
    n = F.col("n") + F.size("new") - F.size("words")
    return c.select("doc_id", "sent_id", F.col("start").cast("long").alias("start"), "edit_no", F.array_join(F.slice("new", F.col("start") + 1, n), " ").alias("suggestion"))


@query("er14_scrutinize", T + _sql(ALL) + _JUMP + _SW + ", rc(rule_no, category) AS (VALUES " + ", ".join(f"({r.no}, {sql.quoted(r.category)})" for r in ALL if not r.accepting) + ") SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id, start, rule_no, n) AS error_no, sent_id, start, n, rule, category, array_to_string(words[start + 1:start + n], ' ') AS marked FROM kp JOIN rc USING (rule_no) JOIN sw USING (doc_id, sent_id)")
def er14(spark, sf_dir):
    """All errors of every text, numbered in the order in which they stand."""
    from pyspark.sql import Window

    k = R.reported(_with_words(spark, sf_dir, ALL, jumps=True), ALL)
    of = spark.createDataFrame([(r.no, r.category) for r in ALL], "rule_no int, category string")
    w = Window.partitionBy("doc_id").orderBy("sent_id", "start", "rule_no", "n")
    marked = F.array_join(F.slice("words", F.col("start") + 1, F.col("n")), " ")
    j = k.select("doc_id", "sent_id", "rule_no", "rule", "start", "n", marked.alias("marked")).join(F.broadcast(of), "rule_no")  # the rules
    return j.select("doc_id", F.row_number().over(w).cast("long").alias("error_no"), "sent_id", F.col("start").cast("long").alias("start"), F.col("n").cast("long").alias("n"), "rule", "category", "marked")
