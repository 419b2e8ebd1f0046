"""The scanner over Arrow batches gives the tokens of the scanner's pattern."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from runeflow.functions import pieces, scan
from runeflow.operators import ngrams, rules
from runeflow.plans import catalogue, rule_file_queries, rule_queries, tagging_queries
from tests.test_rows import PIECES, texts


def test_pieces_hold_the_tokens_of_the_scanner(spark):
    rng = random.Random(8)
    own = ["".join(rng.choice([*PIECES, " ", " ", "word", "Word.", "%", "10", "§", "www.a\u2028b", "12:30", "1999", "İB", "ΑΣ"]) for _ in range(rng.randrange(30))) for _ in range(1500)]
    all_texts = own + texts()
    d = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string")
    t = d.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(scan.PATTERN), F.lit(0))).alias("pos", "tok")).withColumn("cls", scan.classify(F.col("tok"))).where("cls <> 'space'")
    t = scan.with_sentences(t).withColumn("tag", scan.pseudo_tag(F.col("tok"), F.col("cls")))
    want = sorted(map(tuple, t.select("doc_id", "pos", "sent_id", "tok", "cls", "tag").collect()))
    s, got = pieces.Scanner(), []
    batch = pa.table({"id": list(range(len(all_texts))), "text": pa.array(all_texts, pa.string())})
    for x in pieces.slices(batch, limit=2000):
        k = s.scan(x.column("text").combine_chunks())
        ids = x.column("id").to_pylist()
        cls, tag = s.cls.tolist(), s.tag.tolist()
        got += [(ids[r], p, n, s.toks[i], pieces.CLASSES[cls[i]], pieces.TAGS[tag[i]]) for r, p, n, i in zip(*[c.tolist() for c in k], strict=True)]
    assert sorted(got) == want


def test_triples_counted_while_scanning_are_those_of_shifted_tags(spark, tmp_path):
    d = spark.createDataFrame(list(enumerate([*texts()[:300], "", None, "One two. A"])), "doc_id long, text string")
    t = scan.with_sentences(scan.tokens(scan.dealt(d)).withColumn("tag", scan.pseudo_tag(F.col("tok"), F.col("cls"))))
    rows = lambda df: sorted(map(str, df.select("t1", "t2", "t3", "freq").collect()))
    assert rows(ngrams.scanned_trigrams(d)) == rows(ngrams.shifted(t, "tag", 3).groupBy("t1", "t2", "t3").agg(F.count("*").alias("freq")))
    assert rows(ngrams.scanned_trigrams(d, "<edge>")) == rows(ngrams.padded_trigrams(t, "tag", "<edge>"))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("st6_trigram_smoothed", "st7_trigram_backoff", "pr3_score_schemes"):
        catalogue.queries()[name](spark, str(tmp_path)).collect()
    d.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert catalogue.queries()["st6_trigram_smoothed"](spark, f"{tmp_path}/empty").count() == 0


def test_texts_are_decoded_in_buckets_and_no_token_is_dealt(spark, tmp_path, monkeypatch):
    d = [(i, x) for i, x in enumerate(["The cat sat. The Cat ran to NATO.", "the nato cat sat, the dog ran", "", None, "A dog! Nato the Dog 12 dogs", "word " * 500 + "Word."])]
    spark.createDataFrame(d, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {}
    for n in (10**6, 20):
        monkeypatch.setattr(tagging_queries, "BUCKET", n)
        got = catalogue.queries()["de1_viterbi_tags"](spark, str(tmp_path))
        rows[n] = sorted(map(tuple, got.collect()))
    assert rows[20] == rows[10**6] and {r[5] for r in rows[20]} >= {"word.low", "word.cap", "period"} and all(r[6] for r in rows[20])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "Window" not in plan


def test_rules_matched_while_scanning_give_the_matches_of_rows(spark, monkeypatch):
    own = ["of the Apple of a cat. the the, a apple of the Of THE programme programmes and a", "the word! of a low low.", "", None, "a", "It's the 10 % of the word-\nword"]
    d = spark.createDataFrame(list(enumerate([*own, *texts()[:200]])), "doc_id long, text string")
    E, Rule = rules.Element, rules.Rule
    more = [Rule(7, "loose", "style", (E("norm = 'the'", "*"), E("tag = 'word.low' OR NOT (cls = 'period')"), E("norm <> 'it''s'", "?")), left=1), *rule_file_queries.RULES]
    rows = lambda df: sorted(map(str, df.select("doc_id", "sent_id", "rule_no", "rule", "start", "n").collect()))
    for rs in ([*rule_queries.ALL, *more],):
        for jumps in (False, True):
            want = rows(rules.each_match(rules.row_matches(rules.tagged(scan.sentence_rows(d)), rs, jumps)))
            got = rules.scanned_matches(d, rs, jumps)
            assert rows(got) == want and len(want) > 30
            assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert rules.predicate(["norm = 'a'", "abs(1) = 1"]) is None
    odd = [Rule(1, "odd", "style", (E("reverse(norm) = 'eht'"),))]
    assert {r["size"] for r in rules.scanned_matches(d, odd).collect()} == {3, 6, 7, 13}
