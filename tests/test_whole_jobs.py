"""Queries over the whole vocabulary."""

import random

import duckdb

from runeflow.operators import lexicon
from runeflow.plans import catalogue


def both(spark, folder, name, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = catalogue.queries()[name](spark, str(folder))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(catalogue.oracle_sql()[name]).fetchall())
    return got


def test_every_tagged_line_is_returned(spark, tmp_path):
    rows = both(spark, tmp_path, "io14_wtl_lines", ["one two two . Two", "one"]).collect()
    assert sorted(r["n"] for r in rows) == [1, 1, 2, 2]


def test_heads_of_any_length_give_rules(spark, tmp_path):
    got = both(spark, tmp_path, "lx18_guess_rules", ["nation subnation supersubnation baker minibaker stone"])
    assert {r["word"]: r["rule"] for r in got.collect()} == {"subnation": "n.tion", "supersubnation": "n.tion", "minibaker": "n.er"}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_spelling_candidates_are_all_pairs_within_two_edits(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcä") for _ in range(rng.choice((1, 2, 3, 4, 7, 9, 10, 11, 12, 13, 16, 30)))) for _ in range(60)]

    def changed(w):
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w) + 1)
            w = rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i:], w[:i] + rng.choice("abcé") + w[i + 1 :]))
        return w

    known = sorted(set(base))
    unknown = sorted({changed(w) for w in base * 3} | set("aä"))
    got = lexicon.spelling_candidates(spark.createDataFrame([(w,) for w in unknown], "word string"), spark.createDataFrame([(w, len(w)) for w in known], "word string, freq long"))
    want = [(u, k, edits(u, k), len(k)) for u in unknown for k in known if 1 <= edits(u, k) <= 2 and set(u) & set(k)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and {len(k) for _, k, _, _ in want} >= {2, 3, 10, 11, 30}


def test_suggestions_leave_out_no_word(spark, tmp_path):
    texts = ["über nations xbercool longestwordofall", "über nations longestwordofall", "üxer nation longestwxrdofalls xnations"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.queries()["rk7_spelling_candidates"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("longestwxrdofalls", 1, "longestwordofall", 2), ("nation", 1, "nations", 1), ("xnations", 1, "nations", 1), ("üxer", 1, "über", 1)]
