"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from runeflow.llm import decontaminate, language, mixing, near, neighbours, quality, shuffle, suffixes, tokens, windows
from runeflow.llm.common import shared_dir

from . import data


def bench(spark, full=True):
    return spark.createDataFrame([(1, data.rows()[62][1]), (2, None), (3, ""), (4, "two words"), (None, "no id at all here")] if full else [], "item_id long, text string")


def labels(spark, full=True):
    return spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (None, 1), (3, None), (4, 7)] if full else [], "doc_id long, quality int")


def written(spark, d):
    uri = f"{shared_dir(spark)}/ids"
    return tokens.read_tokens(tokens.write_tokens(d, tokens.default_tokenizer(), uri), uri)


OPERATORS = {
    "op3": lambda s, d, full: mixing.mix(d),
    "op4": lambda s, d, full: language.identify(d),
    "op5": lambda s, d, full: quality.classify(d, labels(s, full)),
    "op6": lambda s, d, full: written(s, d),
    "op7": lambda s, d, full: shuffle.shuffled_shards(d, f"{shared_dir(s)}/shards", shards=4),
    "op8": lambda s, d, full: near.near_duplicates(d),
    "op9": lambda s, d, full: windows.remove_repeated_windows(d),
    "op10": lambda s, d, full: suffixes.remove_repeated_bytes(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(spark, name):
    d = data.docs(spark)
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in OPERATORS[name](spark, d, True).select("doc_id").collect())
    assert ids == sorted((r[0] is None, r[0] or 0) for r in data.rows())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, data.empty(spark), False).count() == 0


def test_decontaminate(spark):
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(data.docs(spark), bench(spark)).collect()}
    assert {(62, 1), (None, None)} <= got
    assert decontaminate.contaminated(data.empty(spark), bench(spark)).count() == 0
    assert decontaminate.contaminated(data.docs(spark), bench(spark, False)).count() == 0
    kept = decontaminate.clean(data.docs(spark), bench(spark))
    assert kept.count() == len(data.rows()) - len({d for d, _ in got}) and kept.columns == data.docs(spark).columns


def test_language_filter_keeps_rows_whole(spark):
    kept = language.in_a_language(data.docs(spark))
    assert kept.columns == data.docs(spark).columns
    gone = {66, 67, 68, 73}
    assert kept.count() == sum(r[0] not in gone for r in data.rows())


def test_neighbours(spark):
    v = [(i, [float(i % 7), 1.0, float(i % 3)], 0) for i in range(30)]
    v += [(30, None, 0), (31, [0.0, 0.0, 0.0], 0), (32, [None, 1.0, 1.0], 0), (33, [float("nan"), 1.0, 1.0], 0), (34, [float("inf"), 1.0, 0.0], 0), (None, [1.0, 1.0, 1.0], 0), (3, v[3][1], 0)]
    d = spark.createDataFrame(v, "vec_id long, embedding array<float>, band int")
    got = {}
    for r in neighbours.nearest(d, k=5, query="vec_id % 2 = 0").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 30, 2))
    for q, rs in got.items():
        want = sorted((-sum(a * b for a, b in zip(v[q][1], x[1], strict=True)), x[0]) for x in v[:30] if x[0] != q)[:5]
        assert [(i + 1, b, -a) for i, (a, b) in enumerate(want)] == sorted(rs)
    few = neighbours.nearest(d.where("vec_id < 3"), k=20)
    assert few.groupBy("query_id").count().where("count <> 2").count() == 0
    assert neighbours.nearest(d.limit(0)).count() == 0
    assert neighbours.nearest(d.where(F.lit(False)), query="false").count() == 0


def test_neighbours_of_odd_vectors(spark):
    """Other lengths are strangers; an id with two vectors counts with the better one; ties at the edge go to small ids."""
    rows = [(i, [1.0, float(i)], True) for i in range(4)] + [(10 + i, [1.0, 2.0, float(i)], True) for i in range(3)]
    rows += [(20, [0.0, 5.0], True), (20, [9.0, 0.0], True)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, q boolean")
    got = {}
    for r in neighbours.nearest(d, k=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for q in got:
        score = {}
        for i, v, _ in rows:
            for j, w, _ in rows:
                if i == q and j != q and len(v) == len(w):
                    score[j] = max(score.get(j, -1e9), dot(v, w))
        want = sorted((-s, j) for j, s in score.items())[:3]
        assert sorted(got[q]) == [(n + 1, j, -s) for n, (s, j) in enumerate(want)]
    assert set(got) == {i for i, _, _ in rows}
    bits = [(i, [1.0 if i >> b & 1 else -1.0 for b in range(8)]) for i in range(256)]
    d = spark.createDataFrame(bits, "vec_id long, embedding array<double>")
    for r in neighbours.nearest(d, k=12, query="vec_id % 40 = 0").groupBy("query_id").agg(F.collect_list("vec_id").alias("ids")).collect():
        want = sorted((-dot(bits[r["query_id"]][1], v), i) for i, v in bits if i != r["query_id"])[:12]
        assert sorted(r["ids"]) == sorted(i for _, i in want)
