import re

import pytest
from pyspark.sql import functions as F

from runeflow.llm import common

from . import data

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    data.docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, data.rows()[62][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, sf_dir = common.table(spark, str(tmp_path), "documents"), str(tmp_path)
    seen = {}
    for name, f in pipeline.STAGES[:-1]:
        docs = common.materialize(f(spark, docs, sf_dir), name)
        assert docs.columns == list(pipeline.COLUMNS)
        seen[name] = docs.collect()
    ids = {k: [r["doc_id"] for r in v] for k, v in seen.items()}
    assert {66, 67, 68, 73}.isdisjoint(ids["language_id"]) and len(ids["language_id"]) == len(data.rows()) - 4
    assert set(range(40, 60)).isdisjoint(ids["near_dedup"]) and 3 in ids["near_dedup"]
    assert set(ids["near_dedup"]) - set(ids["decontamination"]) == set(range(60, 66))  # all hold most of the item: the shared passage
    assert set(ids["mixing"]) <= set(ids["decontamination"]) and max(map(ids["mixing"].count, ids["mixing"])) <= 6
    last = pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == len(ids["mixing"]) and last.agg(F.countDistinct("start")).first()[0] == len(ids["mixing"])
    assert pipeline.run(spark, sf_dir).count() == len(ids["mixing"])
