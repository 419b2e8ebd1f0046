"""Suggestions for unknown words: the same as among all pairs, from rows that don't grow with the pairs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from runeflow.functions import scan
from runeflow.operators import lexicon, ngrams, spelling
from runeflow.operators import ranking as R
from tests.test_whole_jobs import edits


def ranked(spark, unknown, known, best, k=5):
    s = lexicon.spelling_candidates(spark.createDataFrame([(w,) for w in unknown], "word string"), spark.createDataFrame(known, "word string, freq long"), best)
    return s, R.best(s, ["word"], [F.asc("edits"), F.desc("freq"), F.asc("candidate")], k).select("word", "rank", "candidate", "edits")


def first(unknown, known, k=5):
    out = []
    for u in unknown:
        near = sorted((e, -f, w) for w, f in known for e in [edits(u, w)] if 1 <= e <= 2 and set(u) & set(w))
        out += [(u, i + 1, w, e) for i, (e, _, w) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize("held", [60, 150_000])
def test_first_five_of_dense_words(spark, monkeypatch, held):
    monkeypatch.setattr(spelling, "HELD", held)  # few words at once: slots of one task meet apart
    rng = random.Random(held)
    every = ["".join(x) for n in range(1, 5) for x in itertools.product("abä", repeat=n)] + ["".join(rng.choice("ab") for _ in range(rng.choice((6, 7, 11)))) for _ in range(150)]
    every = sorted(set(every) | {w + "tion" for w in every[::3]})
    known = [(w, rng.choice((1, 2, 2, 9))) for w in rng.sample(every, 2 * len(every) // 3)]
    unknown = sorted(set(rng.sample(every, len(every) // 3)) | {"a", "😀b", "zzzzzzzzz"})  # some are known too
    assert sorted(map(tuple, ranked(spark, unknown, known, 5)[1].collect())) == first(unknown, known)


def test_rows_do_not_grow_with_the_pairs(spark):
    every = ["wort" + "".join(x) + "ende" for x in itertools.product("abcdefghijklmnopqrst", repeat=2)]  # all within two edits of all
    unknown, known = every[::2], [(w, 2 + i) for i, w in enumerate(every[1::2])]
    rows, got = ranked(spark, unknown, known, 5)
    some = unknown[::40]
    assert sorted(map(tuple, got.where(F.col("word").isin(some)).collect())) == first(some, known)
    assert rows.count() < len(unknown) * len(known) / 2
    assert ranked(spark, unknown, known, None)[0].count() == len(unknown) * len(known)


def test_vocabulary_counts_documents_by_id(spark):
    rows = [(1, "Haus haus z.B. it's 10 % 3"), (1, "Maus HAUS"), (2, "maus e-mail x@y.de"), (None, "Laus laus"), (None, "allein Haus"), (3, None), (4, ""), (5, "ΣΑΣ İx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    t = scan.tokens(docs, where=scan.is_word).groupBy(F.lower("tok").alias("word")).agg(F.count("*").alias("freq"), (F.countDistinct("doc_id") >= 2).alias("known"))
    got = {r["word"]: (r["freq"], r["known"]) for r in ngrams.vocabulary(docs).collect()}
    assert got == {r["word"]: (r["freq"], r["known"]) for r in t.collect()}
    assert got["haus"] == (4, False) and got["maus"] == (2, True) and got["laus"] == (2, False) and got["allein"] == (1, False)
    assert got["z.b."] == (1, False) and got["it's"] == (1, False) and "10" not in got and "x@y.de" not in got


def test_very_long_words(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeß") for _ in range(n)) for n in (30, 31, 32, 33, 34, 35, 36, 60, 3_000)]
    known = [(w, i) for i, w in enumerate(sorted({x for w in base for x in (w, w[:9] + w[10:], w[:3] + "é" + w[3:-1] + "z")}))]
    unknown = sorted({x for w in base for x in (w[1:-1], "x" + w + "y", w[:5] + "q" + w[6:-2] + "qq", w[:7] + w[9:], w[:5] + "q" + w[6:20] + "q" + w[20:])})
    got = sorted(map(tuple, ranked(spark, [w for w in unknown if len(w) < 99], [x for x in known if len(x[0]) < 99], 5)[1].collect()))
    assert got == first([w for w in unknown if len(w) < 99], [x for x in known if len(x[0]) < 99])
    rows = ranked(spark, [w for w in unknown if len(w) > 99], [x for x in known if len(x[0]) > 99], 5)[1].collect()
    w = base[-1]
    assert (w, 2) in {(r["candidate"], r["edits"]) for r in rows if r["word"] == w[:7] + w[9:]}
    assert {r["candidate"] for r in rows if r["word"] == "x" + w + "y"} == {w}
