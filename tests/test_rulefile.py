"""Rule files: tests, faults with their lines, self tests of rules; odd sentences."""

import pytest
from pyspark.sql import functions as F

from runeflow.functions import scan
from runeflow.operators import rulefile as RF
from runeflow.operators import rules as R
from runeflow.plans import rule_file_queries as Q


def tokens(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = scan.tokens(scan.dealt(d))
    return scan.with_sentences(t.withColumn("norm", F.lower("tok")).withColumn("tag", scan.pseudo_tag(F.col("tok"), F.col("cls"))))


def test_expressions():
    assert RF.test_of("word = 'a' or not tag in ('x', 'y') and length(word) > 3") == "(norm = 'a' OR ((NOT tag IN ('x', 'y')) AND length(norm) > 3))"
    assert RF.test_of("word ~ /a|b/") == "regexp_like(norm, '^(?:a|b)$')"
    for bad in ("word", "word = 3", "length(word, 2) > 1", "length(3) > 1", "colour = 'a'", "word ~ 'a'", "word = 'a' and tag", "word = 'a')", "word in ()", "not word", "(word = 'a'", "word ="):
        with pytest.raises(RF.RuleError):
            RF.test_of(bad)


@pytest.mark.parametrize(
    ("text", "line"),
    [
        ("rule 1 a in nowhere\n a: word = 'a'", 1),
        ("category c: d\nrule 1 a in c\n a: wort = 'a'", 3),
        ("a: word = 'a'", 1),
        ("category c: d\nrule 1 a in c\n a: word = 'a' *\n b: word = 'b'\n fix delete b", 5),
        ("category c: d\nrule 1 a in c\n a: word = 'a'\n a: word = 'b'", 4),
        ("category c: d\nrule 1 a in c\n a: word = 'a'\n agree a.case a.gender", 4),
    ],
)
def test_faults_name_their_line(text, line):
    with pytest.raises(RF.RuleError, match=f"^line {line}: "):
        RF.parse(text)


def test_a_file():
    f = Q.FILE
    assert [r.no for r in RF.active(f)] == [11, 13, 14, 15, 16] and [r.no for r in f.helpers] == [12]
    assert [r.no for r in RF.active(f, off=("style", "ing_form"))] == [11, 15]
    r = next(r for r in f.rules if r.no == 14)
    assert (r.left, r.right, r.elements[1].times) == (1, 0, "+")
    assert RF.described(f.rules[0]).startswith("vowel_after_a(  [ norm = 'a' ")
    assert RF.anchors(f.rules[0]) == ["a"] and not R.diagnose(f.rules, set(f.categories))


def test_self_tests(spark):
    """ER15: texts that must set a rule off, and texts that must not."""
    told = [(*x, True) for x in Q.FILE.fires] + [(*x, False) for x in Q.FILE.silent]
    t = tokens(spark, [x[1] for x in told])
    found = RF.agreeing(R.matches(t, Q.FILE.rules), R.sentences(t), Q.FILE)
    hits = {(r["doc_id"], r["rule"]) for r in found.collect()}
    assert [(i, rule) in hits for i, (rule, _, _) in enumerate(told)] == [must for _, _, must in told]


def test_agreement_parts_cases(spark):
    t = tokens(spark, ["Wonderful programmes", "wonderful programmes", "Wonderful Programmes"])
    found = RF.agreeing(R.matches(t, Q.FILE.rules), R.sentences(t), Q.FILE).where("rule_no = 13")
    assert {r["doc_id"] for r in found.collect()} == {1, 2}


def test_more_than_six_tests_are_refused():
    r = R.Rule(1, "x", "c", tuple(R.Element(f"norm = '{i}'") for i in range(7)))
    with pytest.raises(ValueError, match="six"):
        R.pattern(r)


def test_corrections_see_other_rules_and_long_sentences(spark):
    """A correction that sets off another rule isn't offered; a sentence of 20,000 words is matched."""
    first = R.Rule(1, "a_vowel", "c", (R.Element("norm = 'a'"), R.Element("left(norm, 1) IN ('a', 'e')")), edits=(R.Edit("replace", 0, "an"), R.Edit("delete", 0)))
    other = R.Rule(2, "an_apple", "c", (R.Element("norm = 'an'"), R.Element("norm = 'apple'")))
    retag = lambda w: F.struct(F.lower(w).alias("norm"), scan.pseudo_tag(w, scan.classify(w)).alias("tag"), scan.classify(w).alias("cls"))
    t = tokens(spark, ["eat a apple now", "eat a egg now", "so " * 10_000 + "a egg " + "so " * 10_000])
    got = {(r["doc_id"], r["edit_no"]): (r["n_before"], r["n_after"]) for r in R.corrections(t, [first, other], retag).collect()}
    assert got == {(0, 1): (1, 0), (1, 0): (1, 0), (1, 1): (1, 0), (2, 0): (1, 0), (2, 1): (1, 0)}
