"""Formulas, quirks and properties of the text engine on small inputs."""

import collections
import itertools
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runeflow import config
from runeflow.functions import scan
from runeflow.operators import decode, evaluate, features, lexicon, ngrams, rules, sentences
from runeflow.operators.rules import Edit, Element, Rule
from runeflow.sources import readers, sinks


def toks_of(spark, texts, **kw):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = scan.tokens(d, spaces=True, **kw)
    return scan.with_sentences(t.where("cls <> 'space'")).withColumn("norm", F.lower("tok")).withColumn("tag", scan.pseudo_tag(F.col("tok"), F.col("cls")))


def test_token_classes(spark):
    text = "Mr.X paid 1 or 12:30 on 2024-01-02, i.e. 50 % of $9,999.50 (see www.a.se) to a@b.se! It's §4 1st 1999?\n\nNew-\nline"
    got = [(r["tok"], r["cls"]) for r in toks_of(spark, [text]).orderBy("pos").collect()]
    want = {"1": "cardinal_sin", "12:30": "time", "2024-01-02": "date", "i.e.": "abbreviation", "50 %": "percentage", "9,999.50": "bad_cardinal", "www.a.se)": "url", "a@b.se": "email", "It's": "word", "§4": "paragraph", "1st": "ordinal", "1999": "year", "\n\n": "begin_paragraph", "New-\nline": "split_word", "(": "left_par", "!": "exclamation_mark"}
    for t, c in want.items():
        assert (t, c) in got, t


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB é.!?\n\t 12,-'’@😀 \u000b", max_size=30), min_size=1, max_size=20))
def test_scanner_covers_every_character(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = d.select("text", F.array_join(F.regexp_extract_all("text", F.lit(scan.PATTERN), F.lit(0)), "").alias("again")).collect()
    assert all(r["text"] == r["again"] for r in got)


def test_sentences_and_repeats(spark):
    t = toks_of(spark, ["The the cat sat. Sat on on", "a b a b c"])
    w = t.where(F.col("cls").isin(*scan.WORDS))
    assert sorted((r["doc_id"], r["tok"]) for r in sentences.repeated_words(w).collect()) == [(0, "on"), (0, "the")]  # the last word counts, a new sentence doesn't
    assert [(r["doc_id"], r["tok"]) for r in sentences.repeated_ngrams(w, 2).collect()] == [(1, "b")]


def test_edits_are_inverse(spark):
    d = spark.createDataFrame([("a b c d",)], "text string").select(F.transform(F.split("text", " "), lambda t, i: F.struct(i.alias("org"), t.alias("tok"))).alias("l"))
    x = F.col("l")
    r = d.select(
        sentences.printed(sentences.delete(sentences.insert(x, 2, "Z"), 9, 9)).alias("ins"),
        sentences.printed(sentences.replace(sentences.replace(x, 1, "Q"), 1, "b")).alias("same"),
        sentences.printed(sentences.insert(x, 7, "Z")).alias("missing"),
    ).first()
    assert (r["ins"], r["same"], r["missing"]) == ("a b Z c d", "a b c d", "a b c d")


def test_smoothing_by_hand(spark):
    c = config.TAGGING
    t = spark.createDataFrame([(0, 0, i, x) for i, x in enumerate("AABA")] + [(0, 1, i, x) for i, x in enumerate("AB")], "doc_id long, sent_id long, pos int, tag string")
    uni, bi, tri = ngrams.unigrams(t), ngrams.ngram_counts(t, "tag", 2), ngrams.ngram_counts(t, "tag", 3)
    p2 = {(r["t1"], r["t2"]): r["prob"] for r in ngrams.bigram_scores(uni, bi).collect()}
    assert math.isclose(p2["A", "B"], c.lambda_uni * 2 / 6 + c.lambda_bi * 2 / 4 + c.epsilon_tri)
    assert math.isclose(p2["B", "B"], c.lambda_uni * 2 / 6)
    p3 = {(r["t1"], r["t2"], r["t3"]): r["prob"] for r in ngrams.trigram_scores(uni, bi, tri).collect()}
    assert math.isclose(p3["A", "A", "B"], c.lambda_uni * 2 / 6 + c.lambda_bi * 2 / 4 + c.lambda_tri * 1 * 1 ** (c.lambda_tri_exp - 1))
    asked = spark.createDataFrame([("A", "A", "B"), ("B", "A", "B")], "t1 string, t2 string, t3 string")
    got = {r["t1"]: r["prob"] for r in ngrams.backed_off(asked, ngrams.trigram_scores(uni, bi, tri), ngrams.bigram_scores(uni, bi)).collect()}
    assert math.isclose(got["A"], p3["A", "A", "B"]) and math.isclose(got["B"], p2["A", "B"])


def test_delimiters_are_counted_on_both_sides(spark):
    sentences = ["AABA", "B", "AB"]
    t = spark.createDataFrame([(0, k, i, x) for k, s in enumerate(sentences) for i, x in enumerate(s)], "doc_id long, sent_id long, pos int, tag string")
    want = [collections.Counter(), collections.Counter(), collections.Counter()]
    for s in sentences:
        full = (decode.EDGE, decode.EDGE, *s, decode.EDGE, decode.EDGE)
        for n, c in enumerate(want, 1):
            c.update(full[i : i + n] for i in range(len(full) - n + 1))
    tri = ngrams.padded_trigrams(t, "tag", decode.EDGE)
    uni, bi = ngrams.padded_counts(tri, decode.EDGE)
    assert {(r["tag"],): r["freq"] for r in uni.collect()} == want[0] and math.isclose(sum(r["uni"] for r in uni.collect()), 1)
    assert {(r["t1"], r["t2"]): r["freq"] for r in bi.collect()} == want[1]
    assert {(r["t1"], r["t2"], r["t3"]): r["freq"] for r in tri.collect()} == want[2]
    m = decode.read_model(ngrams.bigram_scores(uni, bi), ngrams.trigram_scores(uni, bi, tri))
    assert {tuple(m.tags[i] for i in k) for k in m.triple} == set(want[2]) and (m.pair != 0).all()
    assert m.pair[m.tags.index(decode.EDGE), m.tags.index("A")] > m.pair[m.tags.index(decode.EDGE), m.tags.index("B")]


def test_viterbi_is_the_best_path():
    rng = random.Random(1)
    tags = sorted(["A", "B", "C", decode.EDGE])
    import numpy as np

    for _ in range(30):
        m = decode.Model(tags, np.array([[rng.uniform(-3, 0) for _ in tags] for _ in tags]), {tuple(rng.randrange(4) for _ in range(3)): rng.uniform(-3, 0) for _ in range(20)})
        edge = tags.index(decode.EDGE)
        readings = [[(tags.index(t), rng.uniform(-2, 0)) for t in rng.sample("ABC", rng.randrange(1, 4))] for _ in range(rng.randrange(1, 6))]

        def score(path, m=m, edge=edge):
            full = [edge, edge, *[p for p, _ in path], edge, edge]
            return sum(lex for _, lex in path) + sum(m.triple.get((a, b, c), m.pair[b, c]) for a, b, c in zip(full, full[1:], full[2:]))

        best = max(score(p) for p in itertools.product(*readings))
        path, got = decode.viterbi(m, readings)
        assert math.isclose(got, best) and math.isclose(score([(t, dict(r)[t]) for t, r in zip(path, readings, strict=True)]), best)


def test_batches_decode_as_single_sentences(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(2)
    tags = sorted(["A", "B", "C", "D", decode.EDGE])
    m = decode.Model(tags, np.array([[rng.uniform(-3, 0) for _ in tags] for _ in tags]), {tuple(rng.randrange(5) for _ in range(3)): rng.uniform(-3, 0) for _ in range(40)})
    triple = np.repeat(m.pair[None], 5, 0)
    for k, v in m.triple.items():
        triple[k] = v
    rows = [[[{"tag": t, "lex": rng.uniform(0.01, 1)} for t in rng.sample("ABCDX", rng.randrange(0 if i % 3 == 0 else 2, 4))] for _ in range(rng.randrange(1, 9))] for i in range(200)]
    every = [(i, 0.0) for i, t in enumerate(tags) if t != decode.EDGE]
    want = [decode.viterbi(m, [[(tags.index(r["tag"]), math.log(r["lex"])) for r in one if r["tag"] in tags] or every for one in rs]) for rs in rows]
    kind = pa.list_(pa.list_(pa.struct([("tag", pa.string()), ("lex", pa.float64())])))
    monkeypatch.setattr(decode, "TOGETHER", 16)
    for most in (6, 2):
        monkeypatch.setattr(decode, "MOST", most)
        got, prob = decode._decoded(m, triple, pa.array(rows, kind).slice(10))
        assert got.to_pylist() == [[tags[i] for i in path] for path, _ in want[10:]] and np.allclose(prob, [p for _, p in want[10:]])


def test_tagger_decodes_documents_and_unknown_words(spark, tmp_path):
    from runeflow.plans import catalogue

    texts = [f"the tall man saw Anna{x}berg and walked . Then he talked !" for x in "abcdef"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "the Lindberg balked , Xy and q .")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    q = catalogue.queries()
    rows = q["de1_viterbi_tags"](spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == set(range(6)) and len(rows) == sum(len(t.split()) for t in texts) and all(r["known"] for r in rows)
    assert q["ev2_tag_eval"](spark, str(tmp_path)).first()["n"] == len(rows)
    new = {r["pos"]: r for r in q["de1_benchmark_tags"](spark, str(tmp_path)).collect()}
    by_pos = [new[p] for p in sorted(new)]
    assert [(r["tag"], r["known"]) for r in by_pos if r["gold"].startswith("word")] == [("word.low", True), ("word.cap", False), ("word.low", False), ("word.cap", False), ("word.low", True), ("word.low", False)]


def test_inflection(spark):
    parsed = readers.inflection_rules("$ nn.sin nn.plu nn.gen\nreg  y,Vr 1 = ies -\n# note\nwhole ^ox 0 = en s")
    assert parsed[0].endings == ("y", "Vr") and parsed[1].forms == (("nn.sin", "="), ("nn.plu", "en"), ("nn.gen", "s"))
    words = spark.createDataFrame([("city",), ("car",), ("str",), ("ox",), ("fox",), ("y",)], "word string")
    got = {(r["word"], r["tag"], r["form"]) for r in lexicon.paradigm(words, lexicon.rule_table(spark, tuple(parsed))).collect()}
    assert ("city", "nn.plu", "cities") in got and ("car", "nn.plu", "caies") in got and ("ox", "nn.plu", "oxen") in got and ("y", "nn.plu", "ies") in got
    assert not any(w in ("str", "fox") for w, _, _ in got) and not any(t == "nn.gen" and w != "ox" for w, t, _ in got)


def test_compatibility_is_reflexive_and_symmetric(spark):
    values = ["utr", "neu", "utr/neu", "neu/utr", None]
    d = spark.createDataFrame([(a, b) for a in values for b in values], "a string, b string")
    got = {(r["a"], r["b"]): r["c"] for r in d.select("a", "b", features.compatible(F.col("a"), F.col("b")).alias("c")).collect()}
    assert all(got[a, a] for a in values) and all(got[a, b] == got[b, a] for a, b in got)
    assert got["utr", "utr/neu"] and not got["utr", "neu"] and not got["utr/neu", "neu/utr"] and not got["utr", None]


NP = Rule(1, "np", "phrase", (Element("norm = 'the'", "?"), Element("norm IN ('big', 'old')", "*"), Element("norm = 'dog'")))


def test_rules(spark):
    t = toks_of(spark, ["the big old dog saw the dog. big cat"])
    got = sorted((r["start"], r["n"]) for r in rules.matches(t, [NP]).collect())
    assert got == [(0, 4), (1, 3), (2, 2), (3, 1), (5, 2), (6, 1)]
    bad = [NP, Rule(2, "jumpy", "none", (Element("true", "*"),), jump=1), Rule(3, "ok", "phrase", (Element("true"),), accepting=True, info="x"), NP]
    found = rules.diagnose(bad, {"phrase"})
    assert len(found) == 5 and found[-1] == "np: defined twice"


def test_jumps_and_false_alarms(spark):
    first = Rule(1, "ok", "", (Element("norm = 'of'"), Element("norm = 'the'")), accepting=True, jump=3)
    second = Rule(2, "the", "x", (Element("norm = 'the'"),), edits=(Edit("replace", 0, "a"), Edit("delete"), Edit("replace", 0, "a")))
    third = Rule(3, "the2", "x", (Element("norm = 'the'"),), edits=(Edit("nothing"), Edit("delete")))
    t = toks_of(spark, ["of the dog and the cat"])
    m = rules.suppressed(rules.matches(t, [first, second, third]), [first, second, third])
    assert sorted((r["rule_no"], r["start"]) for r in m.collect()) == [(1, 0), (2, 4), (3, 1), (3, 4)]
    s = t.groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "norm"))).alias("ts")).select("doc_id", "sent_id", F.transform("ts", lambda x: x["norm"]).alias("words"))
    c = rules.candidates(rules.reported(m, [first, second, third]), s, [first, second, third]).collect()
    assert sorted((r["rule_no"], r["edit_no"], r["status"]) for r in c) == [(2, 0, "same_as_another"), (2, 1, "ok"), (2, 2, "ok")]  # the later of a pair stays; rule 3 is a false alarm


def test_islands_and_hits(spark):
    d = spark.createDataFrame([(1, p) for p in (1, 2, 3, 7, 9, 10)], "doc_id int, pos int")
    assert sorted((r["begin"], r["end"]) for r in evaluate.islands(d, ["doc_id"]).collect()) == [(1, 3), (7, 7), (9, 10)]
    alarms = spark.createDataFrame([(1, 5, 5), (2, 1, 9), (3, 0, 0), (4, 1, 1), (5, 1, 1)], "key long, begin long, end long")
    gold = spark.createDataFrame([(1, 6, "VERB", False), (2, 5, "STYLE", False), (3, 2, "VERB", False), (4, 1, "VERB", True)], "key long, pos long, type string, false_alarm boolean")
    r = evaluate.detection(alarms, gold).first()
    assert (r["detected"], r["style"], r["false"], r["unannotated"], r["known"]) == (1, 1, 2, 1, 3)
    assert math.isclose(r["coverage"], 33.333333) and math.isclose(r["precision"], 33.333333)
    none = evaluate.detection(alarms.limit(0), gold.limit(0)).first()
    assert none["coverage"] is None and none["precision"] is None


def test_sources_and_sinks(spark, tmp_path):
    lines = spark.createDataFrame([("two words\tNN",), ("",), ('" CIT',), ("x ZZ",)], "value string")
    tags = spark.createDataFrame([("NN",), ("CIT",)], "tag string")
    assert sorted((r["word"], r["tag"]) for r in readers.tagged(lines, tags).collect()) == [('"', "CIT"), ("two words", "NN"), ("x", "DummyTag")]
    assert readers.tagged(lines, tags, skip_citations=True).count() == 2
    s = readers.counts(spark.createDataFrame([("3 ing",), ("2\ted",)], "value string"), ["suffix"])
    st_ = readers.counts(spark.createDataFrame([("1 ing nn",), ("2 ing vb",), ("1 ed vb",)], "value string"), ["suffix", "tag"])
    assert [r["suffix"] for r in readers.inconsistent(s, st_).collect()] == ["ed"]
    (tmp_path / "a.xml").write_text('<r><s ref="10"><annot><type>VERB</type><position pos="3"/></annot></s><s ref="10"><annot><type>SPELL</type><range from="4" to="6"/></annot></s></r>')
    assert [(r["sent_offset"], r["pos"], r["types"]) for r in readers.read_annotations(spark, str(tmp_path / "a.xml")).collect()] == [(10, 4, ["SPELL"])]
    assert readers.read_config(config.TaggingConfig, readers.write_config(config.TAGGING)) == config.TAGGING
    with pytest.raises(ValueError):
        readers.read_config(config.DetectorConfig, "{}")
    sinks.save_model({"s": s}, str(tmp_path / "m"))
    assert sinks.load_model(spark, str(tmp_path / "m"))["s"].count() == 2
    r = spark.createDataFrame([("a<b",)], "t string").select(sinks.marked(F.col("t"), F.lit(True), "xml").alias("x"), rules.spaced(F.lit("<emph>a </emph>b")).alias("y")).first()
    assert (r["x"], r["y"]) == ("<emph>a&lt;b</emph>", "<emph>a</emph> b")


def test_no_state_between_runs(spark):
    a = toks_of(spark, ["En hus."]).collect()
    toks_of(spark, ["Iledning."]).collect()
    assert a == toks_of(spark, ["En hus."]).collect()


def test_parameter_search():
    from runeflow.operators import optimize as O

    f = lambda xs: [-((x - 3) ** 2) for x in xs]
    assert abs(O.linear(f, 1.0, 8.0)[0] - 3) < 0.1 and abs(O.golden(f, 1.0, 9.0)[0] - 3) < 0.02
    assert O.integer(lambda xs: [-abs(x - 4.5) for x in xs], 1, 9)[0] == 4
    best, _ = O.coordinate_ascent(lambda p: -((p["a"] - 2) ** 2) - (p["b"] - 5) ** 2, {"a": 1.0, "b": 1.0}, ["a", "b"])
    assert abs(best["a"] - 2) < 0.3 and abs(best["b"] - 5) < 0.5
    assert 0.5 <= O.randomized(1.0, 2.0, random.Random(1)) <= 1.5
