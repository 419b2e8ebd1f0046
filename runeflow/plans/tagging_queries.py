"""Tagging, evaluation of tags, the statistical detector."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from runeflow.config import TAGGING as C
from runeflow.functions import scan
from runeflow.operators import decode as D
from runeflow.operators import detect as P
from runeflow.operators import evaluate as E
from runeflow.operators import lexicon as L
from runeflow.operators import ngrams as N
from runeflow.plans.catalogue import query, table
from runeflow.plans.model_queries import _P2, _P3, _SH, _UNI, _WT, _counts
from runeflow.plans.text_queries import T, W, rows, toks, words


def _lexical(wt):
    return wt.select("word", "tag", (F.col("tag_freq") / F.col("tag_total")).alias("lex"))


@query("de6_top_readings", W + _WT + f" SELECT word, rank, tag, round(lex, 9) AS lex FROM (SELECT word, tag, tag_freq / tag_total AS lex, row_number() OVER (PARTITION BY word ORDER BY tag_freq / tag_total DESC, tag) AS rank FROM wt) WHERE rank <= {C.known_readings}")
def de6(spark, sf_dir):
    return D.top_readings(_lexical(N.word_tags(words(spark, sf_dir))), C.known_readings).select("word", "rank", "tag", F.round("lex", 9).alias("lex"))


@query("de7_capital_factors", W + _WT + f" SELECT word, tag, round(tag_freq / tag_total * CASE WHEN word_freq > 1 THEN CASE WHEN (tag <> 'word.low') = (tag = 'word.cap') THEN {C.alpha_cap} ELSE {C.alpha_no_cap} END ELSE CASE WHEN (tag <> 'word.low') = (tag = 'word.cap') THEN {C.alpha_unknown_cap} ELSE {C.alpha_unknown_no_cap} END END, 9) AS score FROM wt")
def de7(spark, sf_dir):
    f = D.capital_factor(F.col("tag") != "word.low", F.col("tag") == "word.cap", F.col("word_freq") > 1)
    return N.word_tags(words(spark, sf_dir)).select("word", "tag", F.round(F.col("tag_freq") / F.col("tag_total") * f, 9).alias("score"))


def guessed_readings(unknown, w):
    """(word, capped) -> (word, capped, guess): readings by suffix, or by the members of each tag where no suffix is known; ``w`` are the words of the corpus."""
    wt = N.word_tags(w)
    suffixes = N.suffix_table(wt)
    by_case = [L.unknown_readings(unknown.where(F.col("capped") == x), suffixes).select("word", F.lit(x).alias("capped"), "tag", F.col("score").alias("lex")) for x in (True, False)]
    r = by_case[0].union(by_case[1])
    members = wt.groupBy("tag").agg(F.count("*").alias("members"))
    lex = F.lit(C.alpha_member) * F.col("members") * D.capital_factor(F.col("capped"), F.col("tag") == "word.cap", F.lit(False))
    rest = unknown.join(r.select("word", "capped").distinct(), ["word", "capped"], "left_anti").crossJoin(F.broadcast(members))  # the tag set
    return r.union(rest.select("word", "capped", "tag", lex.alias("lex"))).groupBy("word", "capped").agg(F.collect_list(F.struct("tag", "lex")).alias("guess"))


BUCKET = 600_000
"""Tokens whose texts are decoded together, about 3 MB; what grows with the input is the number of buckets."""


def _model(spark, sf_dir):
    """Model, tags' frequencies, and the documents in buckets with the readings of every word, (word, rs, buckets)."""
    d = table(spark, sf_dir, "documents")
    counted = N.scanned_trigrams(d, D.EDGE)
    tri = spark.createDataFrame(counted.collect(), counted.schema).coalesce(1)  # bounded by the tag set; the tokens are counted once
    uni, bi = N.padded_counts(tri, D.EDGE)
    model = D.read_model(N.bigram_scores(uni, bi), N.trigram_scores(uni, bi, tri))
    totals = uni.where(F.col("tag") != D.EDGE).select("tag", F.col("freq").alias("tag_total")).collect()
    n = sum(r["tag_total"] for r in totals) // BUCKET + 1
    d = d.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("bucket"))
    total = spark.createDataFrame(totals, "tag string, tag_total long")  # the tag set
    # dealt by word once: a word's tags and its buckets meet in one task
    wt = N.bucket_words(d.repartition(n, "bucket")).repartition("word").groupBy("word", "tag").agg(F.sum("n").alias("tag_freq"), F.collect_set("bucket").alias("in"))
    r = F.struct((-F.col("tag_freq") / F.col("tag_total")).alias("lex"), "tag")
    lex = wt.join(F.broadcast(total), "tag").groupBy("word").agg(F.slice(F.array_sort(F.collect_list(r)), 1, C.known_readings).alias("rs"), F.array_distinct(F.flatten(F.collect_list("in"))).alias("buckets"))
    return model, d, lex.select("word", F.transform("rs", lambda x: F.struct(x["tag"].alias("tag"), (-x["lex"]).alias("lex"))).alias("rs"), "buckets")


def _decoded(spark, sf_dir):
    """Tokens of the documents, tagged with their own model: (doc_id, sent_id, log_prob, pos, gold, tag, known, cls)."""
    model, d, lex = _model(spark, sf_dir)
    t = D.decode_texts(d, lex.select(F.explode("buckets").alias("bucket"), "word", "rs"), model)
    return t.withColumn("log_prob", F.round("log_prob", 6))


def _decoded_others(spark, sf_dir, name, doc_id):
    """As _decoded, of a table that the model wasn't fitted on: its tokens are joined to the lexicon, and unknown words get readings by suffix."""
    model, _, lex = _model(spark, sf_dir)
    lex = lex.select("word", "rs")
    is_word = F.col("cls").isin(*scan.WORDS)
    t = toks(spark, sf_dir, True, name, doc_id).select("doc_id", "sent_id", "pos", F.col("norm").alias("word"), F.col("tag").alias("gold"), "cls", (is_word & scan.first_capped(F.col("tok"))).alias("capped"))
    j = t.join(lex, "word", "left")
    cased = F.transform("rs", lambda x: F.struct(x["tag"].alias("tag"), (x["lex"] * D.capital_factor(F.col("capped"), x["tag"] == "word.cap", F.lit(True))).alias("lex")))
    unknown = t.where(is_word).select("word", "capped").distinct().join(lex.select("word"), "word", "left_anti")
    j = j.join(guessed_readings(unknown, words(spark, sf_dir)), ["word", "capped"], "left")
    rs = F.coalesce(F.when(is_word, cased).otherwise(F.col("rs")), F.when(is_word, F.col("guess")))
    x = F.struct("pos", "gold", F.coalesce(rs, F.array()).alias("rs"), F.col("rs").isNotNull().alias("known"), "cls")
    s = j.groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(x)).alias("ts"))
    s = s.select("doc_id", "sent_id", F.transform("ts", lambda x: x["rs"]).alias("readings"), F.transform("ts", lambda x: F.struct(x["pos"].alias("pos"), x["gold"].alias("gold"), x["known"].alias("known"), x["cls"].alias("cls"))).alias("ts"))
    return D.decode(s, model).select("doc_id", "sent_id", F.round("log_prob", 6).alias("log_prob"), F.explode(F.arrays_zip("ts", "tags")).alias("x")).select("doc_id", "sent_id", "log_prob", F.col("x.ts.pos").alias("pos"), F.col("x.ts.gold").alias("gold"), F.col("x.tags").alias("tag"), F.col("x.ts.known").alias("known"), F.col("x.ts.cls").alias("cls"))


@query("de1_viterbi_tags")
def de1(spark, sf_dir):
    return _decoded(spark, sf_dir)


@query("de1_benchmark_tags")
def de1_benchmark(spark, sf_dir):
    """A table that the model wasn't fitted on, with unknown words."""
    return _decoded_others(spark, sf_dir, "benchmark", "item_id")


@query("ev2_tag_eval")
def ev2(spark, sf_dir):
    return E.tagging(_decoded(spark, sf_dir).withColumn("is_punct", ~F.col("cls").isin(*scan.WORDS)))


@query("ev2_benchmark_eval")
def ev2_benchmark(spark, sf_dir):
    return E.tagging(_decoded_others(spark, sf_dir, "benchmark", "item_id").withColumn("is_punct", ~F.col("cls").isin(*scan.WORDS)))


_GUESS = ", mc AS (SELECT norm, arg_max(tag, (n, tag)) AS guess, sum(n) AS f FROM (SELECT norm, tag, count(*) AS n FROM tk GROUP BY ALL) GROUP BY norm), ge AS (SELECT tk.tag AS gold, mc.guess AS tag, f > 1 AS known, cls NOT IN ('simple_word', 'word', 'split_word', 'abbreviation') AS punct FROM tk JOIN mc USING (norm))"


def _guessed(spark, sf_dir):
    """Every token with its word's most frequent tag: the baseline tagger, which SQL can check."""
    t = toks(spark, sf_dir)
    n = t.groupBy("norm", "tag").agg(F.count("*").alias("n"), F.first("cls").alias("cls"))
    guess = n.groupBy("norm").agg(F.max_by("tag", F.struct("n", "tag")).alias("guess"), F.sum("n").alias("f"))
    return n.join(guess, "norm").select(F.col("tag").alias("gold"), F.col("guess").alias("tag"), (F.col("f") > 1).alias("known"), (~F.col("cls").isin(*scan.WORDS)).alias("is_punct"), "n")


_PC = "round(100 * {a} / nullif({b}, 0), 6)"


@query("ev1_baseline_eval", T + _GUESS + """, c AS (SELECT count(*) AS n, count(*) FILTER (gold = tag) AS n_right, count(*) FILTER (known) AS n_known, count(*) FILTER (known AND gold = tag) AS known_right, count(*) FILTER (NOT known) AS n_unknown, count(*) FILTER (NOT known AND gold = tag) AS unknown_right, count(*) FILTER (punct) AS n_punct, count(*) FILTER (punct AND gold = tag) AS punct_right FROM ge)
SELECT *, round(100 * n_right / nullif(n, 0), 6) AS accuracy, round(100 * known_right / nullif(n_known, 0), 6) AS known_accuracy, round(100 * unknown_right / nullif(n_unknown, 0), 6) AS unknown_accuracy, round(100 * (n_right - punct_right) / nullif(n - n_punct, 0), 6) AS accuracy_without_punct FROM c""")
def ev1(spark, sf_dir):
    g = _guessed(spark, sf_dir)
    return E.tagging(g.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n")))))


@query("ev4_confusion", T + _GUESS + " SELECT tag AS selected, gold, count(*) AS n FROM ge WHERE tag <> gold GROUP BY ALL")
def ev4(spark, sf_dir):
    return _guessed(spark, sf_dir).where("tag <> gold").groupBy(F.col("tag").alias("selected"), "gold").agg(F.sum("n").alias("n"))


@query("ev4_confusion_pivot", T + _GUESS + " SELECT gold, count(*) FILTER (tag = 'word.low') AS low, count(*) FILTER (tag = 'word.cap') AS cap, count(*) FILTER (tag = 'word.all') AS capitals FROM ge GROUP BY gold")
def ev4_pivot(spark, sf_dir):
    p = _guessed(spark, sf_dir).groupBy("gold").pivot("tag", ["word.low", "word.cap", "word.all"]).agg(F.sum("n"))
    return p.select("gold", *[F.coalesce(F.col(f"`{a}`"), F.lit(0)).alias(b) for a, b in (("word.low", "low"), ("word.cap", "cap"), ("word.all", "capitals"))])


# ---- detector ----------------------------------------------------------------------------------------------------

_TRI = T + _SH + ", ps AS (SELECT doc_id, sent_id, pos, tag AS t1, lead(tag) OVER w AS t2, lead(tag, 2) OVER w AS t3, lead(pos) OVER w AS mid FROM tk WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY pos))"


def _windows(spark, sf_dir):
    return P.windows(toks(spark, sf_dir, True))


@query("pr1_trigram_anomalies", _TRI + " SELECT doc_id, count(*) AS n_suspect, min(mid) AS first_pos FROM ps JOIN tr USING (t1, t2, t3) WHERE tr.freq < 10 GROUP BY doc_id")
def pr1(spark, sf_dir):
    """Middle places of tag triples seen fewer than ten times."""
    w = _windows(spark, sf_dir)
    s = P.suspects(w, P.triples(w), 10)
    return s.groupBy("doc_id").agg(F.count("*").alias("n_suspect"), F.min("pos").cast("long").alias("first_pos"))


@query("pr8_suspect_intervals", _TRI + ", su AS (SELECT DISTINCT doc_id, mid AS pos FROM ps JOIN tr USING (t1, t2, t3) WHERE tr.freq < 10), i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM su) SELECT doc_id, min(pos) AS begin_pos, max(pos) AS end_pos, count(*) AS n FROM i GROUP BY doc_id, g")
def pr8(spark, sf_dir):
    w = _windows(spark, sf_dir)
    s = P.suspects(w, P.triples(w), 10).select("doc_id", "pos").distinct()
    i = E.islands(s, ["doc_id"])
    return i.select("doc_id", F.col("begin").cast("long").alias("begin_pos"), F.col("end").cast("long").alias("end_pos"), "n")


_REP = """, cx AS (SELECT t1 AS tag, t2 AS ctx, freq AS f FROM bg), ct AS (SELECT tag, sqrt(sum(f * f)) AS nrm FROM cx GROUP BY tag), si AS (SELECT a.tag AS tag, b.tag AS rep, sum(a.f * b.f) / (any_value(x.nrm) * any_value(y.nrm)) AS sim FROM cx a JOIN cx b USING (ctx) JOIN ct x ON x.tag = a.tag JOIN ct y ON y.tag = b.tag GROUP BY a.tag, b.tag),
rp AS (SELECT tag, rep, round(sim, 9) AS sim, row_number() OVER (PARTITION BY tag ORDER BY round(sim, 9) DESC, rep) AS rank FROM si)"""


@query("pr11_representatives", T + _SH + _REP + " SELECT tag, rep, rank, sim FROM rp WHERE rank <= 10")
def pr11(spark, sf_dir):
    """Tags that stand for each other: the cosine of what follows them."""
    _, bi, _ = _counts(spark, sf_dir)
    return P.representatives(bi, 10)


_PR2 = ", tn AS (SELECT DISTINCT t1, t2, t3 FROM tr) SELECT tn.t1, tn.t2, tn.t3, round(sum(tr.freq * a.sim * b.sim * c.sim / (pow(2, a.rank + b.rank + c.rank - 3))), 4) AS score FROM tn JOIN rp a ON a.tag = tn.t1 AND a.rank <= 3 JOIN rp b ON b.tag = tn.t2 AND b.rank <= 3 JOIN rp c ON c.tag = tn.t3 AND c.rank <= 3 JOIN tr ON tr.t1 = a.rep AND tr.t2 = b.rep AND tr.t3 = c.rep GROUP BY ALL"


@query("pr2_representative_scores", T + _SH + _REP + _PR2)
def pr2(spark, sf_dir):
    """Triples scored by the frequencies of what their tags' three best representatives form, halved for each rank."""
    _, bi, tri = _counts(spark, sf_dir)
    return P.represented(tri, P.representatives(bi, 3)).withColumn("score", F.round("score", 4))


@query("pr3_score_schemes", T + _SH + _REP + ", m AS (SELECT tn.t1, tn.t2, tn.t3, tr.freq * a.sim * b.sim * c.sim AS v FROM tr tn JOIN rp a ON a.tag = tn.t1 AND a.rank <= 3 JOIN rp b ON b.tag = tn.t2 AND b.rank <= 3 JOIN rp c ON c.tag = tn.t3 AND c.rank <= 3 JOIN tr ON tr.t1 = a.rep AND tr.t2 = b.rep AND tr.t3 = c.rep) SELECT t1, t2, t3, round(sum(v), 4) AS total, round(coalesce(sum(v) / nullif(count(*) FILTER (v <> 0), 0), 0), 4) AS mean, round(max(v), 4) AS most FROM m GROUP BY ALL")
def pr3(spark, sf_dir):
    _, bi, tri = _counts(spark, sf_dir)
    return P.schemes(tri, P.representatives(bi, 3)).select("t1", "t2", "t3", *[F.round(c, 4).alias(c) for c in ("total", "mean", "most")])


@query("pr7_decisions", _TRI + ", fl AS (SELECT doc_id, mid, (tr.freq < 10)::INT AS a, (bg.freq < 50)::INT AS b, (tg.n < 500)::INT AS c FROM ps JOIN tr USING (t1, t2, t3) JOIN bg ON bg.t1 = ps.t1 AND bg.t2 = ps.t2 JOIN (SELECT tag, count(*) AS n FROM tk GROUP BY tag) tg ON tg.tag = ps.t2) SELECT doc_id, count(*) FILTER (a + b + c >= 1) AS any_model, count(*) FILTER (a + b + c >= 2) AS majority, count(*) FILTER (a + b + c = 3) AS all_models FROM fl GROUP BY doc_id")
def pr7(spark, sf_dir):
    """Three detectors, joined by any, majority and all."""
    uni, bi, tri = _counts(spark, sf_dir)
    # flags depend on the triple only: a table of votes that the tag set bounds, looked up inside a sentence's row
    t = tri.join(bi.select("t1", "t2", F.col("freq").alias("f2")), ["t1", "t2"]).join(uni.select(F.col("tag").alias("t2"), F.col("freq").alias("f1")), "t2")
    n = (F.col("freq") < 10).cast("int") + (F.col("f2") < 50).cast("int") + (F.col("f1") < 500).cast("int")
    votes = t.select("t1", "t2", "t3", n.alias("votes"))
    w = N.triples_of(rows(spark, sf_dir), F.transform("toks", scan.tag_of), "doc_id").where("t3 is not null")
    w = w.join(F.broadcast(votes), ["t1", "t2", "t3"])  # at most the cube of the tag set
    return w.groupBy("doc_id").agg(F.count_if(F.col("votes") >= 1).alias("any_model"), F.count_if(F.col("votes") >= 2).alias("majority"), F.count_if(F.col("votes") == 3).alias("all_models"))


@query("pr5_bigram_baseline", _TRI + " SELECT doc_id, round(avg(bg.freq), 4) AS mean_freq, min(bg.freq) AS least FROM ps JOIN bg ON bg.t1 = ps.t1 AND bg.t2 = ps.t2 GROUP BY doc_id")
def pr5(spark, sf_dir):
    """Scheme 5: the frequency of the first two tags alone."""
    _, bi, _ = _counts(spark, sf_dir)
    w = Window.partitionBy("doc_id", "sent_id").orderBy("pos")
    p = toks(spark, sf_dir, True).select("doc_id", F.col("tag").alias("t1"), F.lead("tag").over(w).alias("t2"))
    return p.join(F.broadcast(bi), ["t1", "t2"]).groupBy("doc_id").agg(F.round(F.avg("freq"), 4).alias("mean_freq"), F.min("freq").alias("least"))


_GRID = "(VALUES (0.5), (1.0), (2.0), (4.0))"


@query("opt2_parameter_grid", T + _UNI + _SH + f" SELECT x::DOUBLE AS scale, round(sum(bg.freq * ({C.lambda_uni}::DOUBLE * u.uni + x::DOUBLE * {C.lambda_bi}::DOUBLE * bg.freq / v.freq)) / sum(bg.freq), 6) AS mean_score FROM {_GRID} g(x), bg JOIN un u ON u.tag = bg.t2 JOIN un v ON v.tag = bg.t1 GROUP BY x")
def opt2(spark, sf_dir):
    """A grid of weights, all evaluated in one job: parameters are rows joined to the counts."""
    uni, bi, _ = _counts(spark, sf_dir)
    grid = spark.createDataFrame([(x,) for x in (0.5, 1.0, 2.0, 4.0)], "scale double")
    j = bi.join(uni.select(F.col("tag").alias("t2"), F.col("uni").alias("u")), "t2").join(uni.select(F.col("tag").alias("t1"), F.col("freq").alias("f1")), "t1").crossJoin(F.broadcast(grid))  # four points
    s = F.lit(C.lambda_uni) * F.col("u") + F.col("scale") * F.lit(C.lambda_bi) * F.col("freq") / F.col("f1")
    return j.groupBy("scale").agg(F.round(F.sum(F.col("freq") * s) / F.sum("freq"), 6).alias("mean_score"))
