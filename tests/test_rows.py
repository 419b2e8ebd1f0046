"""Sentences split, tagged and matched inside their rows."""

import random

import pytest
from pyspark.sql import functions as F

from runeflow.functions import scan
from runeflow.plans import catalogue, rule_file_queries, rule_queries

PIECES = ["a", "bc", "Ab", "É", "www.", "http://", "1", "2.5", "10%", "§ 3", "a.b.", "-", "-\n", "\n", "\n\n", "\n \t\n", "'", "’", "@", "_", ":", "!", "?", ".", ",", " ", "  ", " ", "(", "2020-01-02", "3rd", "e-mail@x.se", "ǅ", "漢", "\f", "\r"]


def texts():
    rng = random.Random(5)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(30))) for _ in range(500)] + ["", None, "word " * 20000]


def test_rows_hold_the_sentences_of_the_scanner(spark):
    d = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    t = d.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(scan.PATTERN), F.lit(0))).alias("pos", "tok")).withColumn("cls", scan.classify(F.col("tok"))).where("cls <> 'space'")
    t = scan.with_sentences(t)
    want = t.groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tok", scan.pseudo_tag(F.col("tok"), F.col("cls")).alias("tag")))).alias("x"))
    want = sorted((r["doc_id"], r["sent_id"], [y["tok"] for y in r["x"]], [y["tag"] for y in r["x"]], [y["pos"] for y in r["x"]]) for r in want.collect())
    got = scan.sentence_rows(d).select("doc_id", "sent_id", "toks", F.transform("toks", scan.tag_of).alias("tags"))
    assert sorted((r["doc_id"], r["sent_id"], r["toks"], r["tags"]) for r in got.collect()) == [x[:4] for x in want]
    numbered = scan.numbered_rows(d).select("doc_id", "sent_id", "first", F.posexplode("parts").alias("i", "tok")).where(~F.col("tok").rlike(rf"^[{scan.SPACES}]"))
    assert sorted((r["doc_id"], r["sent_id"], r["first"] + r["i"]) for r in numbered.collect()) == sorted((x[0], x[1], p) for x in want for p in x[4])


@pytest.mark.parametrize("name", ["io19_keyword_in_context", "se12_detokenize", "er11_suggestion_text", "ru12_jump_suppression", "er7_marked_area", "er14_scrutinize", "er8_suggestions_verified", "pr7_decisions", "ru10_help_rules"])
def test_no_token_is_shuffled_before_its_sentence_is_done(spark, tmp_path, name):
    """What a query reads isn't dealt or sorted as tokens: below any exchange sentences are whole."""
    spark.createDataFrame([(0, "It was a apple of the tree. A tree of the wonderful things.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = catalogue.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and "collect_list" not in plan


def test_matches_leave_no_row(spark, tmp_path):
    spark.createDataFrame([(0, "It was a apple.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for found in (rule_queries._matches(spark, str(tmp_path), rule_queries.ALL), rule_file_queries._found(spark, str(tmp_path))):
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_texts_of_two_detectors_are_read_once_and_not_dealt(spark, tmp_path):
    rows = [(0, "A word word here."), (1, "Word. Word word-word"), (2, "the The"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = catalogue.queries()["ev14_detector_overlap"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("both", 1), ("first", 1), ("second", 2)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("documents") <= 1 and "RepartitionByExpression" not in plan and "Window" not in plan and plan.count("regexp_extract_all(text") == 1
