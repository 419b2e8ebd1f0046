"""Lexicon, morphology, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from runeflow.config import TAGGING as C
from runeflow.functions import scan
from runeflow.operators import features as FE
from runeflow.operators import lexicon as L
from runeflow.operators import ngrams as N
from runeflow.plans import sql
from runeflow.plans.catalogue import query, table
from runeflow.plans.model_queries import _SX, _WT
from runeflow.plans.text_queries import W, lexicon, words

_LX = ", lx AS (SELECT norm FROM wd GROUP BY norm HAVING count(DISTINCT doc_id) >= 2)"
#: A small grammar of English-like endings, for running the operators.
RULES = (
    L.InflectRule("n.tion", ("tion",), 0, (("nn.sin", "="), ("nn.plu", "s"))),
    L.InflectRule("v.ed", ("Ced", "Ved"), 2, (("vb.prt", "="), ("vb.prs", "ing"), ("vb.inf", "-"))),
    L.InflectRule("n.er", ("er", "or"), 0, (("nn.sin", "="), ("nn.plu", "s"), ("nn.gen", "'s"))),
    L.InflectRule("dt.the", ("^the",), 3, (("dt.def", "="), ("dt.ind", "a"))),
    L.InflectRule("unused", ("^zzzz",), 0, (("xx", "="),)),
)


def _values(rows) -> str:
    lit = lambda v: "NULL" if v is None else sql.quoted(v) if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


_RULE_ROWS = [(i, r.name, L.ending_pattern(e), r.strip, k, tag, None if s == "-" else "" if s == "=" else s) for i, r in enumerate(RULES) for e in r.endings for k, (tag, s) in enumerate(r.forms)]
_RT = f", rt(rule_no, name, pattern, strip, form_no, tag, suffix) AS {_values(_RULE_ROWS)}, vo AS (SELECT DISTINCT norm AS word FROM wd), ap AS (SELECT word, min(rule_no) AS rule_no FROM vo JOIN rt ON regexp_matches(word, pattern) GROUP BY word)"
_PA = ", pa AS (SELECT DISTINCT word, name AS rule, tag, CASE WHEN form_no = 0 THEN word ELSE left(word, greatest(length(word) - strip, 0)) || suffix END AS form FROM ap JOIN rt USING (rule_no))"


def _vocabulary(spark, sf_dir):
    return words(spark, sf_dir).select(F.col("norm").alias("word")).distinct()


@query("lx1_known_rate", W + _LX + " SELECT doc_id, count(*) AS n_words, count(lx.norm) AS n_known, round(count(lx.norm) / count(*), 6) AS rate FROM wd LEFT JOIN lx USING (norm) GROUP BY doc_id")
def lx1(spark, sf_dir):
    w = words(spark, sf_dir)
    j = w.join(lexicon(w).withColumn("known", F.lit(1)), "norm", "left").groupBy("doc_id").agg(F.count("*").alias("n_words"), F.count("known").alias("n_known"))
    return j.withColumn("rate", F.round(F.col("n_known") / F.col("n_words"), 6))


@query("lx3_two_step_lookup", W + _LX + ", ex AS (SELECT tok FROM wd GROUP BY tok HAVING count(DISTINCT doc_id) >= 3) SELECT CASE WHEN ex.tok IS NOT NULL THEN 'exact' WHEN lx.norm IS NOT NULL THEN 'lower' ELSE 'new' END AS found, count(*) AS n, count(DISTINCT wd.tok) AS n_forms FROM wd LEFT JOIN ex ON ex.tok = wd.tok LEFT JOIN lx ON lx.norm = wd.norm GROUP BY ALL")
def lx3(spark, sf_dir):
    """Exact form first, then lower case; the joins run on distinct forms, not on tokens."""
    w = words(spark, sf_dir)
    forms = w.groupBy("tok", "norm").agg(F.count("*").alias("n"))
    exact = w.groupBy("tok").agg(F.countDistinct("doc_id").alias("d")).where("d >= 3").select("tok", F.lit(1).alias("e"))
    j = forms.join(exact, "tok", "left").join(lexicon(w).withColumn("l", F.lit(1)), "norm", "left")
    found = F.when(F.col("e").isNotNull(), "exact").when(F.col("l").isNotNull(), "lower").otherwise("new")
    return j.groupBy(found.alias("found")).agg(F.sum("n").alias("n"), F.count("*").alias("n_forms"))


@query("lx4_new_words", W + _LX + " SELECT norm AS word, count(*) AS freq FROM wd WHERE NOT EXISTS (SELECT 1 FROM lx WHERE lx.norm = wd.norm) GROUP BY norm")
def lx4(spark, sf_dir):
    w = words(spark, sf_dir)
    return w.groupBy("norm").agg(F.count("*").alias("freq")).join(lexicon(w), "norm", "left_anti").select(F.col("norm").alias("word"), "freq")


@query("lx5_word_tag", W + _WT + ", b AS (SELECT norm AS word, doc_id, tag FROM wd) SELECT doc_id, count(*) AS n, count(*) FILTER (tag_freq = 1 AND word_freq > 1) AS n_rare_reading FROM b JOIN wt USING (word, tag) GROUP BY doc_id")
def lx5(spark, sf_dir):
    w = words(spark, sf_dir).select(F.col("norm").alias("word"), "doc_id", "tag", "norm")
    wt = N.word_tags(w)
    per = w.groupBy("doc_id", "word", "tag").agg(F.count("*").alias("k")).join(wt, ["word", "tag"])
    return per.groupBy("doc_id").agg(F.sum("k").alias("n"), F.sum(F.when((F.col("tag_freq") == 1) & (F.col("word_freq") > 1), F.col("k")).otherwise(0)).alias("n_rare_reading"))


@query("lx6_readings", W + _WT + " SELECT word, count(*) AS n_readings, string_agg(tag, ' ' ORDER BY tag_freq DESC, tag) AS readings FROM wt GROUP BY word HAVING count(*) > 1")
def lx6(spark, sf_dir):
    wt = N.word_tags(words(spark, sf_dir))
    r = wt.groupBy("word").agg(F.count("*").alias("n_readings"), F.array_sort(F.collect_list(F.struct((-F.col("tag_freq")).alias("f"), "tag"))).alias("l")).where("n_readings > 1")
    return r.select("word", "n_readings", F.array_join(F.transform("l", lambda x: x["tag"]), " ").alias("readings"))


_LEMMA = ", le AS (SELECT DISTINCT a.norm AS word, left(a.norm, length(a.norm) - 1) AS lemma FROM lx a WHERE a.norm LIKE '%s' AND EXISTS (SELECT 1 FROM lx b WHERE b.norm = left(a.norm, length(a.norm) - 1)))"


@query("lx7_lemma", W + _LX + _LEMMA + " SELECT coalesce(lemma, norm) AS lemma, count(*) AS freq, count(DISTINCT norm) AS n_forms FROM wd LEFT JOIN le ON le.word = wd.norm GROUP BY 1 HAVING count(DISTINCT norm) > 1")
def lx7(spark, sf_dir):
    """Lemma of the reading, else the word; here a known word in -s has the known word without it as its lemma."""
    w = words(spark, sf_dir)
    lx = lexicon(w)
    lemmas = lx.where("norm like '%s'").select("norm", F.expr("left(norm, length(norm) - 1)").alias("lemma")).join(lx.select(F.col("norm").alias("lemma")), "lemma", "left_semi")
    forms = w.groupBy("norm").agg(F.count("*").alias("n")).join(lemmas, "norm", "left")
    return forms.groupBy(F.coalesce("lemma", "norm").alias("lemma")).agg(F.sum("n").alias("freq"), F.count("*").alias("n_forms")).where("n_forms > 1")


@query("lx9_original_tag", f"WITH t(tag) AS {_values([(x,) for x in ('vb.prs.akt.mod', 'vb.inf.akt.aux', 'vb.imp.akt.kop', 'nn.utr.sin', 'vb.prt.akt', 'pn.set')])} SELECT tag, CASE WHEN regexp_matches(tag, 'set|dat|mod|aux|kop') THEN left(tag, length(tag) - CASE WHEN contains(tag, 'imp.akt') THEN 8 ELSE 4 END) ELSE tag END AS original FROM t")
def lx9(spark, sf_dir):
    t = spark.createDataFrame([(x,) for x in ("vb.prs.akt.mod", "vb.inf.akt.aux", "vb.imp.akt.kop", "nn.utr.sin", "vb.prt.akt", "pn.set")], "tag string")
    return t.select("tag", L.original_tag(F.col("tag")).alias("original"))


@query("lx10_inflection_applicable", W + _RT + " SELECT word, name AS rule FROM ap JOIN (SELECT DISTINCT rule_no, name FROM rt) USING (rule_no)")
def lx10(spark, sf_dir):
    return L.applicable(_vocabulary(spark, sf_dir), L.rule_table(spark, RULES)).select("word", "rule")


@query("lx14_inflect_generate", W + _RT + _PA + " SELECT word, rule, tag, form FROM pa WHERE form IS NOT NULL")
def lx14(spark, sf_dir):
    return L.paradigm(_vocabulary(spark, sf_dir), L.rule_table(spark, RULES))


@query("lx8_get_form", W + _RT + _PA + " SELECT p.word, p.form AS plural, vo.word IS NOT NULL AS known FROM pa p JOIN pa q ON q.word = p.word AND q.tag = 'nn.sin' AND q.form = q.word LEFT JOIN vo ON vo.word = p.form WHERE p.tag = 'nn.plu'")
def lx8(spark, sf_dir):
    """The plural of nouns whose rule gives their present form back, and whether it is a word of the corpus."""
    v = _vocabulary(spark, sf_dir)
    p = L.paradigm(v, L.rule_table(spark, RULES))
    sure = p.where("tag = 'nn.sin' and form = word").select("word")
    return p.where("tag = 'nn.plu'").join(sure, "word", "left_semi").select("word", F.col("form").alias("plural")).join(v.select(F.col("word").alias("plural"), F.lit(True).alias("known")), "plural", "left").select("word", "plural", F.coalesce("known", F.lit(False)).alias("known"))


@query("lx15_unused_rules", W + _RT + " SELECT DISTINCT name AS rule FROM rt WHERE rule_no NOT IN (SELECT rule_no FROM ap)")
def lx15(spark, sf_dir):
    t = L.rule_table(spark, RULES)
    return t.select(F.col("name").alias("rule")).distinct().join(L.applicable(_vocabulary(spark, sf_dir), t).select("rule"), "rule", "left_anti")


_CO = f""", kn AS (SELECT norm AS word, count(*) AS freq FROM wd WHERE length(norm) >= 3 GROUP BY norm HAVING count(*) >= 20), un AS (SELECT norm AS word FROM wd WHERE length(norm) >= {C.compound_min} GROUP BY norm HAVING count(*) < 20),
sp AS (SELECT word, left(word, n) AS head, right(word, length(word) - n) AS tail FROM un, (SELECT unnest(range(1, 200)) AS n) WHERE n BETWEEN {C.compound_min_prefix} AND length(word) - {C.compound_min_suffix})"""


@query("lx16_compound_splits", W + _CO + " SELECT word, head, tail FROM sp WHERE head IN (SELECT word FROM kn) AND tail IN (SELECT word FROM kn)")
def lx16(spark, sf_dir):
    v = words(spark, sf_dir).groupBy(F.col("norm").alias("word")).agg(F.count("*").alias("freq"))
    return L.compound_splits(v.where("freq < 20").select("word"), v.where("freq >= 20 and length(word) >= 3"))


@query(
    "lx18_guess_rules",
    W + _RT + """, hd AS (SELECT v.word, ap.rule_no, n FROM (SELECT word, unnest(range(1, length(word))) AS n FROM vo) v JOIN ap ON ap.word = right(v.word, n))
SELECT word, min(name) AS rule FROM (SELECT word, rule_no FROM hd QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC) = 1) JOIN rt USING (rule_no) GROUP BY word""",
)
def lx18(spark, sf_dir):
    """Longer words take the rule of the longest word that they end in, of any length.

    A rule that a compound head was given is that of the longest word with a rule of its own that the head ends in, and
    longer words which end in the head end in that word too: so one pass gives what passing rules on by length would.
    """
    v = _vocabulary(spark, sf_dir)
    heads = L.applicable(v, L.rule_table(spark, RULES)).select(F.col("word").alias("head"), "rule")
    s = v.where("length(word) > 1").select("word", F.explode(F.expr("sequence(1, length(word) - 1)")).alias("n")).withColumn("head", F.expr("right(word, n)"))
    return s.join(heads, "head").groupBy("word").agg(F.max_by("rule", "n").alias("rule"))


_ONCE = (_RT + _PA + _WT).replace("vo AS (", "vo AS MATERIALIZED (").replace("ap AS (", "ap AS MATERIALIZED (").replace("wt AS (", "wt AS MATERIALIZED (")


@query("lx22_more_word_forms", W.replace("wd AS (", "wd AS MATERIALIZED (") + _ONCE + ", c AS (SELECT DISTINCT form AS word, tag FROM pa WHERE form IS NOT NULL) SELECT c.word, c.tag FROM c SEMI JOIN vo ON vo.word = c.word ANTI JOIN wt ON wt.word = c.word AND wt.tag = c.tag ANTI JOIN ap ON ap.word = c.word")
def lx22(spark, sf_dir):
    """Generated forms that are known words but lack the tag, and have no rule of their own."""
    w = words(spark, sf_dir)
    t = L.rule_table(spark, RULES)
    v = w.select(F.col("norm").alias("word")).distinct()
    forms = L.paradigm(v, t).select(F.col("form").alias("word"), "tag").distinct()
    return forms.join(v, "word", "left_semi").join(N.word_tags(w).select("word", "tag"), ["word", "tag"], "left_anti").join(L.applicable(v, t).select("word"), "word", "left_anti")


@query("lx23_lexicon_check", f"WITH {sql.tokens('benchmark', 'item_id')}, bw AS (SELECT DISTINCT norm FROM tk WHERE {sql.WORDS}), dw AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, {sql.quoted(scan.PATTERN)}))) AS norm FROM documents) SELECT count(*) AS n_words, count(*) FILTER (norm NOT IN (SELECT norm FROM dw)) AS n_missing FROM bw")
def lx23(spark, sf_dir):
    """Words of the benchmark that the corpus doesn't have."""
    from runeflow.plans.text_queries import toks

    b = toks(spark, sf_dir, False, "benchmark", "item_id").where(F.col("cls").isin(*scan.WORDS)).select("norm").distinct()
    d = toks(spark, sf_dir).select("norm", F.lit(1).alias("here")).distinct()
    return b.join(d, "norm", "left").agg(F.count("*").alias("n_words"), F.count_if(F.col("here").isNull()).alias("n_missing"))


_STYLE = (("ou", "informal", "you"), ("thth", "typing", "the"), ("inin", "typing", "in"))


@query("lx21_style_words", W + f", st(norm, style, alternative) AS {_values(_STYLE)} SELECT doc_id, style, count(*) AS n FROM wd JOIN st USING (norm) GROUP BY ALL")
def lx21(spark, sf_dir):
    st = spark.createDataFrame(list(_STYLE), "norm string, style string, alternative string")
    return words(spark, sf_dir).join(F.broadcast(st), "norm").groupBy("doc_id", "style").agg(F.count("*").alias("n"))


_TRANS = (("re", 2), ("on", 1), ("re", 4), ("er", 3))


@query("lx26_transitivity", W + f", tv(k, norm, mask) AS {_values([(i, *r) for i, r in enumerate(_TRANS)])}, tu AS (SELECT norm, arg_min(mask, k) AS mask FROM tv GROUP BY norm) SELECT coalesce(mask, 0)::INT AS mask, count(*) AS n FROM wd LEFT JOIN tu USING (norm) GROUP BY 1")
def lx26(spark, sf_dir):
    """The first entry of a lemma wins; words without one have mask 0."""
    t = spark.createDataFrame([(i, *r) for i, r in enumerate(_TRANS)], "k int, norm string, mask int").groupBy("norm").agg(F.min_by("mask", "k").alias("mask"))
    return words(spark, sf_dir).join(F.broadcast(t), "norm", "left").groupBy(F.coalesce("mask", F.lit(0)).alias("mask")).agg(F.count("*").alias("n"))


@query("lx25_spell_ok", W + _LX + ", s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY pos) = 1 AS head FROM wd) SELECT CASE WHEN lx.norm IS NOT NULL THEN 'known' WHEN tag = 'word.all' THEN 'capitals' WHEN tag = 'word.cap' AND NOT head THEN 'proper' ELSE 'wrong' END AS verdict, count(*) AS n FROM s LEFT JOIN lx USING (norm) GROUP BY 1")
def lx25(spark, sf_dir):
    """Right if known, in capitals, or capitalised inside a sentence."""
    from pyspark.sql import Window

    w = words(spark, sf_dir, True).withColumn("head", F.row_number().over(Window.partitionBy("doc_id", "sent_id").orderBy("pos")) == 1)
    j = w.join(lexicon(words(spark, sf_dir)).withColumn("k", F.lit(1)), "norm", "left")
    v = F.when(F.col("k").isNotNull(), "known").when(F.col("tag") == "word.all", "capitals").when((F.col("tag") == "word.cap") & ~F.col("head"), "proper").otherwise("wrong")
    return j.groupBy(v.alias("verdict")).agg(F.count("*").alias("n"))


@query("rk7_spelling_candidates")
def rk7(spark, sf_dir):
    """The five nearest words of the lexicon for each word that isn't in it; no SQL, as DuckDB counts edits of bytes."""
    from runeflow.operators import ranking as R
    from runeflow.operators import spelling as SP

    s = SP.spelling_pairs(N.vocabulary(table(spark, sf_dir, "documents")), 5)
    return R.best(s, ["word"], [F.asc("edits"), F.desc("freq"), F.asc("candidate")], 5).select("word", "rank", "candidate", "edits")


_UN = f""", sc AS (SELECT suffix, tag, [{', '.join(map(str, C.alpha_last))}][len]::DOUBLE * tag_freq / sum(tag_freq) OVER (PARTITION BY suffix) AS score FROM sx),
nw AS (SELECT norm AS word, bool_and(tag <> 'word.low') AS capped FROM wd GROUP BY norm HAVING count(*) = 1),
us AS (SELECT word, capped, sc.tag, sum(score) AS score FROM nw JOIN (SELECT unnest(range(1, 6)) AS len) ON length(word) - len >= {C.min_prefix} JOIN sc ON sc.suffix = right(word, len) GROUP BY ALL),
uf AS (SELECT word, tag, score * CASE WHEN capped = (tag = 'word.cap') THEN {C.alpha_unknown_cap} ELSE {C.alpha_unknown_no_cap} END AS score FROM us)
SELECT word, rank, tag, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY round(score, 9) DESC, tag) AS rank FROM uf) WHERE rank <= {C.unknown_readings}"""


@query("un1_unknown_readings", W + _WT + _SX + _UN)
def un1(spark, sf_dir):
    """Readings of words seen once, from the suffixes of all words."""
    w = words(spark, sf_dir)
    new = w.groupBy(F.col("norm").alias("word")).agg(F.count("*").alias("n"), F.bool_and(F.col("tag") != "word.low").alias("capped")).where("n = 1").select("word", "capped")
    return L.unknown_readings(new, N.suffix_table(N.word_tags(w))).withColumn("score", F.round("score", 5))


# ---- features ----------------------------------------------------------------------------------------------------

CLASSES = {"wordcl": ("nn", "vb", "jj", "pn"), "gender": ("utr", "neu", "utr/neu"), "number": ("sin", "plu", "sin/plu", "set"), "tense": ("prs", "prt")}
TAGS = ("nn.utr.sin", "nn.utr.plu", "nn.neu.sin", "nn.neu.plu", "jj.utr/neu.plu", "jj.utr.sin", "jj.neu.sin", "vb.prs", "vb.prt", "pn.utr.sin/plu", "pn.neu.set")
_TAGS = f"t(tag) AS {_values([(t,) for t in TAGS])}"
_PARSE = ", p AS (SELECT tag, " + ", ".join(f"list_filter(string_split(tag, '.'), lambda x: x IN ({', '.join(map(sql.quoted, vs))}))[1] AS {c}" for c, vs in CLASSES.items()) + " FROM t)"


def _fits(a: str, b: str) -> str:
    return f"({a} IS NOT DISTINCT FROM {b} OR coalesce((NOT contains({a}, '/') AND list_contains(string_split({b}, '/'), {a})) OR (NOT contains({b}, '/') AND list_contains(string_split({a}, '/'), {b})), false))"


def _tags(spark):
    return spark.createDataFrame([(t,) for t in TAGS], "tag string")


@query("fe1_feature_parse", f"WITH {_TAGS}{_PARSE} SELECT *, len(list_distinct(list_concat(string_split(tag, '.'), string_split_regex(tag, '[./]')))) AS n_components FROM p")
def fe1(spark, sf_dir):
    return FE.parsed(_tags(spark), CLASSES).withColumn("n_components", F.size(FE.components(F.col("tag"))).cast("long"))


@query("fe2_compatible_pairs", f"WITH {_TAGS}, v AS (SELECT DISTINCT unnest(string_split(tag, '.')) AS v FROM t) SELECT a.v AS a, b.v AS b FROM v a, v b WHERE {_fits('a.v', 'b.v')}")
def fe2(spark, sf_dir):
    v = _tags(spark).select(F.explode(FE.values(F.col("tag"))).alias("v")).distinct()
    return v.select(F.col("v").alias("a")).join(F.broadcast(v.select(F.col("v").alias("b"))), FE.compatible(F.col("a"), F.col("b")))


@query("fe4_tag_predicates", f"WITH {_TAGS} SELECT tag, starts_with(tag, 'nn') AS is_noun, starts_with(tag, 'vb') AS is_verb, starts_with(tag, 'jj') AS is_adjective, contains(tag, 'gen') AS is_genitive FROM t")
def fe4(spark, sf_dir):
    t = F.col("tag")
    return _tags(spark).select("tag", t.startswith("nn").alias("is_noun"), t.startswith("vb").alias("is_verb"), t.startswith("jj").alias("is_adjective"), t.contains("gen").alias("is_genitive"))


@query("fe6_set_feature", f"WITH {_TAGS}{_PARSE} SELECT tag, concat_ws('.', wordcl, gender, 'plu', tense) AS changed, 'wordcl = ' || wordcl || coalesce(', gender = ' || gender, '') AS described FROM p")
def fe6(spark, sf_dir):
    p = FE.parsed(_tags(spark), CLASSES)
    cols = list(CLASSES)
    described = F.concat_ws(", ", *[F.concat(F.lit(f"{c} = "), F.col(c)) for c in cols[:2]])
    return p.select("tag", F.concat_ws(".", *FE.set_feature(cols, "number", "plu")).alias("changed"), described.alias("described"))


@query(
    "fe8_find_matching_tag",
    f"WITH {_TAGS}{_PARSE}, q AS (SELECT tag, wordcl, gender, number, tense FROM p), h AS (SELECT q.tag, b.tag AS found FROM q JOIN p b ON " + " AND ".join(f"(q.{c} IS NULL OR q.{c} = 'set' OR {_fits(f'q.{c}', f'b.{c}')})" for c in CLASSES) + ") SELECT tag, found FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY CASE WHEN tag = found THEN 0 ELSE 1 END, found) AS n FROM h) WHERE n = 1",
)
def fe8(spark, sf_dir):
    p = FE.parsed(_tags(spark), CLASSES)
    return FE.matching_tags(p, FE.parsed(_tags(spark), CLASSES), list(CLASSES))
