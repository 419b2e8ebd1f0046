"""Modes of the unknown-word model, word lists, tag tables, and choices of the detector."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from runeflow.config import TAGGING as C
from runeflow.operators import decode as D
from runeflow.operators import detect as P
from runeflow.operators import lexicon as L
from runeflow.operators import ngrams as N
from runeflow.plans.catalogue import query, table
from runeflow.plans.lexicon_queries import _CO, _UN
from runeflow.plans.model_queries import _SH, _SX, _WT, _counts
from runeflow.plans.tagging_queries import _GUESS, _REP, _TRI, _guessed, _windows
from runeflow.plans.text_queries import T, W, toks, words


def _new(w):
    return w.groupBy(F.col("norm").alias("word")).agg(F.count("*").alias("n"), F.bool_and(F.col("tag") != "word.low").alias("capped")).where("n = 1").select("word", "capped")


def _readings(spark, sf_dir):
    w = words(spark, sf_dir)
    return L.unknown_readings(_new(w), N.suffix_table(N.word_tags(w)))


def _unknown(columns: str) -> str:
    """CTEs up to ur: the readings of new words."""
    head, tail = _UN.split("SELECT word, rank, tag, round(score, 5) AS score", 1)
    return f"{W}{_WT}{_SX}{head}, ur AS (SELECT {columns}{tail})"


@query("st12_new_word_lex", _unknown("word, tag, score") + " SELECT word, tag, round(CASE WHEN count(*) OVER (PARTITION BY word) = 1 THEN 1.0 ELSE score END, 5) AS lex FROM ur")
def st12(spark, sf_dir):
    """A new word with one reading has it for certain; of several each has the score of the unknown-word model."""
    n = F.count("*").over(Window.partitionBy("word"))
    return _readings(spark, sf_dir).select("word", "tag", F.round(F.when(n == 1, 1.0).otherwise(F.col("score")), 5).alias("lex"))


@query("un4_best_or_several", _unknown("word, rank, tag") + " SELECT n_readings, best, count(*) AS n FROM (SELECT word, max(rank) AS n_readings, min_by(tag, rank) AS best FROM ur GROUP BY word) GROUP BY ALL")
def un4(spark, sf_dir):
    """New words by the number of readings that the ambiguous mode keeps, and by the one that the other mode keeps."""
    r = _readings(spark, sf_dir).groupBy("word").agg(F.max("rank").cast("long").alias("n_readings"), F.min_by("tag", "rank").alias("best"))
    return r.groupBy("n_readings", "best").agg(F.count("*").alias("n"))


@query("un3_member_only", W + _WT + f", nw AS (SELECT norm AS word, bool_and(tag <> 'word.low') AS capped FROM wd GROUP BY norm HAVING count(*) = 1), mb AS (SELECT tag, count(*) AS members FROM wt GROUP BY tag) SELECT word, tag, round({C.alpha_member}::DOUBLE * members * CASE WHEN capped = (tag = 'word.cap') THEN {C.alpha_unknown_cap} ELSE {C.alpha_unknown_no_cap} END, 6) AS score FROM nw, mb")
def un3(spark, sf_dir):
    """Readings of new words from the members of each tag alone."""
    w = words(spark, sf_dir)
    members = N.word_tags(w).groupBy("tag").agg(F.count("*").alias("members"))  # the tag set
    lex = F.lit(C.alpha_member) * F.col("members") * D.capital_factor(F.col("capped"), F.col("tag") == "word.cap", F.lit(False))
    return _new(w).crossJoin(F.broadcast(members)).select("word", "tag", F.round(lex, 6).alias("score"))


@query("st19_key_skew", W + ", c AS (SELECT norm AS key, count(*) AS n FROM wd GROUP BY norm) SELECT key, n, round(n / (SELECT sum(n) FROM c), 6) AS share FROM c ORDER BY n DESC, key LIMIT 20")
def st19(spark, sf_dir):
    """The keys that would weigh most in a shuffle: a report of the first twenty."""
    c = words(spark, sf_dir).groupBy(F.col("norm").alias("key")).agg(F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("total")))).orderBy(F.desc("n"), "key").limit(20).select("key", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


_ORIGINAL = "CASE WHEN regexp_matches({0}, 'set|dat|mod|aux|kop') THEN left({0}, length({0}) - CASE WHEN contains({0}, 'imp.akt') THEN 8 ELSE 4 END) ELSE {0} END"


@query("fe9_correct_guess", T + _GUESS + f" SELECT gold, count(*) FILTER (gold = tag) AS n_same, count(*) FILTER (gold = tag OR {_ORIGINAL.format('gold')} = {_ORIGINAL.format('tag')} OR gold = 'punctuation') AS n_correct, count(*) AS n FROM ge GROUP BY gold")
def fe9(spark, sf_dir):
    """A guess is right if it is the tag, has the tag's original, or the tag is one that means nothing."""
    same, original = F.col("gold") == F.col("tag"), L.original_tag(F.col("gold")) == L.original_tag(F.col("tag"))
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return _guessed(spark, sf_dir).groupBy("gold").agg(n(same).alias("n_same"), n(same | original | (F.col("gold") == "punctuation")).alias("n_correct"), F.sum("n").alias("n"))


_LINES = "CASE WHEN starts_with(tag, 'word') THEN '+' ELSE '-' END || chr(9) || tag || chr(9) || CASE WHEN tag = 'word.all' THEN 'word.low' ELSE tag END"


@query("fe5_taginfo", T + f", ln AS (SELECT {_LINES} AS line, count(*) AS n FROM tk GROUP BY tag) SELECT split_part(line, chr(9), 2) AS tag, starts_with(line, '+') AS is_content, split_part(line, chr(9), 3) AS lemma_tag, NOT starts_with(line, '+') AS compound_stop, n FROM ln")
def fe5(spark, sf_dir):
    """The table of tags: content or not, the lemma's tag, and whether compounds stop at it."""
    from runeflow.sources.readers import taginfo

    t = F.col("tag")
    line = F.concat_ws("\t", F.when(t.startswith("word"), "+").otherwise("-"), t, F.when(t == "word.all", "word.low").otherwise(t))
    n = toks(spark, sf_dir).groupBy("tag").agg(F.count("*").alias("n"))
    return taginfo(n.select(line.alias("value"))).join(n, "tag").select("tag", "is_content", "lemma_tag", (~F.col("is_content")).alias("compound_stop"), "n")


@query("io6_word_lists", W + ", vo AS (SELECT norm, bool_and(lang IS DISTINCT FROM 'en') AS is_foreign, length(norm) > 12 AS is_style FROM wd JOIN documents USING (doc_id) GROUP BY norm) SELECT doc_id, count(*) FILTER (is_foreign) AS n_foreign, count(*) FILTER (is_style) AS n_style, count(*) AS n FROM wd JOIN vo USING (norm) GROUP BY doc_id")
def io6(spark, sf_dir):
    """A word list, a line for each word and its marks, read back and looked up for every token."""
    from runeflow.sources.readers import word_list

    w = words(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    v = w.groupBy("norm").agg(F.bool_and(~F.col("lang").eqNullSafe("en")).alias("f"))
    lines = v.select(F.concat_ws("\t", "norm", F.when(F.col("f"), "foreign"), F.when(F.length("norm") > 12, "style")).alias("value"))
    j = words(spark, sf_dir).join(word_list(lines).withColumnRenamed("word", "norm"), "norm")
    has = lambda m: F.count_if(F.array_contains("marks", m))
    return j.groupBy("doc_id").agg(has("foreign").alias("n_foreign"), has("style").alias("n_style"), F.count("*").alias("n"))


@query("lx17_new_word_analysis", W + _WT + _CO + ", be AS (SELECT word, max(length(tail)) AS n FROM sp WHERE head IN (SELECT word FROM kn) AND tail IN (SELECT word FROM kn) GROUP BY word) SELECT DISTINCT be.word, right(be.word, n) AS tail, wt.tag, wt.tag_freq FROM be JOIN wt ON wt.word = right(be.word, n)")
def lx17(spark, sf_dir):
    """A new word that is a compound inherits the readings of its longest known tail."""
    wt = N.word_tags(words(spark, sf_dir))
    v = wt.groupBy("word").agg(F.sum("tag_freq").alias("freq"))
    s = L.compound_splits(v.where("freq < 20").select("word"), v.where("freq >= 20 and length(word) >= 3"))
    best = s.groupBy("word").agg(F.max_by("tail", F.length("tail")).alias("tail"))
    return best.join(wt.select(F.col("word").alias("tail"), "tag", "tag_freq"), "tail").select("word", "tail", "tag", "tag_freq")


@query("de8_fixed_tags", T + ", gu AS (SELECT norm, arg_max(tag, (n, tag)) AS guess, count(*) AS n_tags, any_value(tag) AS one FROM (SELECT norm, tag, count(*) AS n FROM tk GROUP BY ALL) GROUP BY norm) SELECT doc_id, count(*) FILTER (n_tags = 1) AS n_fixed, count(*) FILTER (coalesce(CASE WHEN n_tags = 1 THEN one END, guess) = tag) AS n_right, count(*) AS n FROM tk JOIN gu USING (norm) GROUP BY doc_id")
def de8(spark, sf_dir):
    """DE8, DE11: a given tag sticks, whatever would be selected; here words with one tag have it given."""
    t = toks(spark, sf_dir)
    n = t.groupBy("norm", "tag").agg(F.count("*").alias("n"))
    g = n.groupBy("norm").agg(F.max_by("tag", F.struct("n", "tag")).alias("guess"), F.when(F.count("*") == 1, F.first("tag")).alias("fixed"))
    j = t.join(g, "norm")
    return j.groupBy("doc_id").agg(F.count("fixed").alias("n_fixed"), F.count_if(D.selected("fixed", "guess") == F.col("tag")).alias("n_right"), F.count("*").alias("n"))


_M = ", m AS (SELECT tn.t1, tn.t2, tn.t3, a.rank AS k1, b.rank AS k2, c.rank AS k3, tr.freq * a.sim * b.sim * c.sim AS v FROM tr tn JOIN rp a ON a.tag = tn.t1 AND a.rank <= 10 JOIN rp b ON b.tag = tn.t2 AND b.rank <= 10 JOIN rp c ON c.tag = tn.t3 AND c.rank <= 10 JOIN tr ON tr.t1 = a.rep AND tr.t2 = b.rep AND tr.t3 = c.rep)"


@query("pr3_default_scheme", T + _SH + _REP + _M + ", fq AS (SELECT tag, count(*) AS n FROM tk GROUP BY tag) SELECT t1, t2, t3, round(coalesce(sum(v) FILTER (k1 <= 3 AND k2 <= 3 AND k3 <= 3), 0), 4) AS first_only, round(1000 * sum(v) / (any_value(a.n)::DOUBLE * any_value(b.n) * any_value(c.n)), 9) AS relative FROM m JOIN fq a ON a.tag = t1 JOIN fq b ON b.tag = t2 JOIN fq c ON c.tag = t3 GROUP BY t1, t2, t3")
def pr3_default(spark, sf_dir):
    """Schemes 4, the default: only the first three representatives; and 3: in relation to the tags' frequencies."""
    uni, bi, tri = _counts(spark, sf_dir)
    s = P.default_scheme(tri, P.representatives(bi, 10), uni)
    return s.select("t1", "t2", "t3", F.round("first_only", 4).alias("first_only"), F.round("relative", 9).alias("relative"))


@query("pr5_given_weights", T + _SH + _REP + _M + " SELECT t1, t2, t3, round(sum(v * [1.0, 0.3, 0.1][k1] * [1.0, 0.3, 0.1][k2] * [1.0, 0.3, 0.1][k3]), 4) AS score FROM m WHERE k1 <= 3 AND k2 <= 3 AND k3 <= 3 GROUP BY t1, t2, t3")
def pr5_weights(spark, sf_dir):
    """Weights of the ranks given from outside instead of halves."""
    _, bi, tri = _counts(spark, sf_dir)
    return P.represented(tri, P.representatives(bi, 3), (1.0, 0.3, 0.1)).withColumn("score", F.round("score", 4))


@query("opt5_threshold_grid", _TRI + " SELECT thresh, count(*) AS n_suspect, count(DISTINCT doc_id) AS n_docs FROM ps JOIN tr USING (t1, t2, t3) JOIN (VALUES (2), (5), (10), (50), (200)) g(thresh) ON tr.freq < thresh GROUP BY thresh")
def opt5(spark, sf_dir):
    """OPT5, IO21: settings that another program would try one by one are rows of a table, all tried in one job."""
    w = _windows(spark, sf_dir)
    grid = spark.createDataFrame([(x,) for x in (2, 5, 10, 50, 200)], "thresh int")
    t = P.triples(w).join(F.broadcast(grid), F.col("freq") < F.col("thresh"))
    return w.join(F.broadcast(t.select("t1", "t2", "t3", "thresh")), ["t1", "t2", "t3"]).groupBy("thresh").agg(F.count("*").alias("n_suspect"), F.countDistinct("doc_id").alias("n_docs"))  # at most the cube of the tag set


@query("io22_messages", r"SELECT message, count(*) AS n FROM (SELECT unnest([CASE WHEN text IS NULL THEN 'no text' END, CASE WHEN text = '' THEN 'empty text' END, CASE WHEN NOT regexp_matches(text, '\p{L}') THEN 'no letters' END, CASE WHEN lang IS NULL THEN 'no language' END, CASE WHEN length(text) > 10000 THEN 'long text' END]) AS message FROM documents) WHERE message IS NOT NULL GROUP BY message")
def io22(spark, sf_dir):
    """Warnings about the input, counted by kind instead of printed one by one."""
    t = F.col("text")
    notes = F.array(F.when(t.isNull(), "no text"), F.when(t == "", "empty text"), F.when(~t.rlike(r"\p{L}"), "no letters"), F.when(F.col("lang").isNull(), "no language"), F.when(F.length(t) > 10000, "long text"))
    return table(spark, sf_dir, "documents").select(F.explode(F.array_compact(notes)).alias("message")).groupBy("message").agg(F.count("*").alias("n"))


@query("so3_distinct", T + " SELECT doc_id, len(list_distinct(list(norm))) AS n_distinct, count(*) AS n FROM tk GROUP BY doc_id")
def so3(spark, sf_dir):
    return toks(spark, sf_dir).groupBy("doc_id").agg(F.countDistinct("norm").alias("n_distinct"), F.count("*").alias("n"))


@query("so5_find_and_remove", W + ", be AS (SELECT DISTINCT lower(unnest(string_split(regexp_replace(text, '[^\\p{L} ]', ' ', 'g'), ' '))) AS norm FROM benchmark), c AS (SELECT norm, count(*) AS n FROM wd GROUP BY norm) SELECT norm IN (SELECT norm FROM be) AS found, count(*) AS n_words, sum(n)::BIGINT AS n FROM c GROUP BY 1")
def so5(spark, sf_dir):
    """Finding in a set and what is left when it is removed: joins by hash."""
    b = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.regexp_replace("text", r"[^\p{L} ]", " "), " ")).alias("norm")).select(F.lower("norm").alias("norm")).distinct().withColumn("found", F.lit(True))
    c = words(spark, sf_dir).groupBy("norm").agg(F.count("*").alias("n"))
    return c.join(b, "norm", "left").groupBy(F.coalesce("found", F.lit(False)).alias("found")).agg(F.count("*").alias("n_words"), F.sum("n").alias("n"))
