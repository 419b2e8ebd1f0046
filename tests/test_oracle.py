"""A query of each kind against DuckDB on the smallest tables; the others are compared by the driver."""

import os

import duckdb
import pytest

from runeflow.plans import catalogue

SF = "/root/testdata/sf0.001"
NAMES = ["tk2_token_class_hist", "tk3_token_offsets", "se7_repeated_words", "st6_trigram_smoothed", "st13_suffix_stats", "rk8_index_terms", "lx16_compound_splits", "fe8_find_matching_tag", "ru8_star_plus_rule", "ru12_jump_suppression", "er8_suggestions_verified", "pr8_suspect_intervals", "ev8_detection_eval", "stream_tokenize_counts"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "labels", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalogue.queries()[name](spark, SF)
    cur = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    text = lambda x: repr(round(x, 9) + 0.0) if isinstance(x, float) else str(x)
    want = sorted("|".join(map(text, r)) for r in cur.fetchall())
    assert sorted("|".join(text(r[c]) for c in names) for r in got.collect()) == want


def test_every_query_is_registered():
    assert len(catalogue.queries()) > 80 and set(catalogue.oracle_sql()) <= set(catalogue.queries())
