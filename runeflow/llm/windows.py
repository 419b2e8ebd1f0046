"""Repeated word windows by difference-cover anchors (operator 9).

Let D be a difference cover modulo v: for any two places i, j some shift d < v brings both i + d and j + d into D.  Two
equal windows of ``width`` words therefore share, at the same shift, an anchor: ``width - v + 1`` words that begin at a
cover place.  Only anchors at cover places (5 of 21) are hashed and compared across the corpus; where an anchor
repeats, the windows that hold it are extended to the full width, hashed and compared in a second exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import hashing as H

PERIOD = 21
COVER = (3, 6, 7, 12, 14)
"""Fixed values: a perfect difference set modulo 21 (each residue but 0 is a difference of exactly one pair)."""
OUT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<begin:int,end:int>>"


class _Bucket:
    """Anchors of a bucket, and from the parts' answers on: candidate windows, repeated windows."""

    def __init__(self, docs: pa.Table, width: int) -> None:
        self.data, self.offsets = C.utf8(docs["text"])
        self.w = w = H.Words(self.data, self.offsets)
        self.width, self.hashes = width, H.word_hashes(self.data, w)
        left = w.count[w.doc] - w.place  # words from here to the end of the text
        long = w.count[w.doc] >= width
        self.window_ok = left >= width
        short = width - PERIOD + 1
        cover = np.isin(np.arange(PERIOD), COVER)
        self.anchor_at = np.flatnonzero(cover[w.place % PERIOD] & long & (left >= short))
        grams = H.windows(self.hashes, short)
        self.anchors, self.anchor_multi, self.anchor_place = C.distinct(grams[self.anchor_at] if len(self.anchor_at) else np.zeros(0, H.U))

    def candidates(self, repeated: np.ndarray) -> None:
        n = len(self.hashes)
        at = self.anchor_at[repeated[self.anchor_place]] if len(self.anchor_at) else self.anchor_at
        first = np.maximum(at - (PERIOD - 1), self.w.first[self.w.doc[at]])
        steps = np.bincount(first, minlength=n + 1) - np.bincount(at + 1, minlength=n + 1)
        self.window_at = np.flatnonzero((np.cumsum(steps)[:n] > 0) & self.window_ok)
        grams = H.windows(self.hashes, self.width)
        self.wins, self.win_multi, self.win_place = C.distinct(grams[self.window_at] if len(self.window_at) else np.zeros(0, H.U))

    def removed(self, repeated: np.ndarray) -> np.ndarray:
        n = len(self.hashes)
        at = self.window_at[repeated[self.win_place]] if len(self.window_at) else self.window_at
        steps = np.bincount(at, minlength=n + 1) - np.bincount(at + self.width, minlength=n + 1)[: n + 1]
        return np.cumsum(steps)[:n] > 0


def _result(docs: pa.Table, b: _Bucket, gone: np.ndarray) -> pa.Table:
    w, n = b.w, docs.num_rows
    kept = np.flatnonzero(~gone)
    doc = w.doc[kept]
    lens = w.end[kept] - w.start[kept]
    glue = np.r_[doc[1:] == doc[:-1], False] if len(doc) else np.zeros(0, bool)  # a space after each kept word but a text's last
    # a white space follows each word that is glued to the next one: it stays as the space between them
    step, data = np.zeros(len(b.data) + 1, np.int8), b.data.copy()
    step[w.start[kept]] += 1
    step[w.end[kept] + glue] -= 1
    data[w.end[kept][glue]] = 32
    out = data[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]
    size = np.bincount(doc, weights=lens + glue, minlength=n).astype(np.int64)
    text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int64).tobytes()), pa.py_buffer(out.tobytes()))
    starts = np.flatnonzero(gone & ~(np.r_[False, gone[:-1]] & (w.place > 0))) if len(gone) else np.zeros(0, int)
    stops = np.flatnonzero(gone & ~(np.r_[gone[1:], False] & (w.place + 1 < w.count[w.doc]))) if len(gone) else np.zeros(0, int)
    spans = pa.StructArray.from_arrays([pa.array(w.place[starts].astype(np.int32)), pa.array((w.place[stops] + 1).astype(np.int32))], ["begin", "end"])
    per = np.r_[0, np.cumsum(np.bincount(w.doc[starts], minlength=n))].astype(np.int32)
    return pa.table(
        {
            "doc_id": docs["doc_id"],
            "n_words": pa.array(w.count.astype(np.int64)),
            "n_removed": pa.array(np.bincount(w.doc[gone], minlength=n).astype(np.int64)),
            "kept": text.cast(pa.string()),
            "spans": pa.ListArray.from_arrays(pa.array(per), spans),
        }
    )


def remove_repeated_windows(docs: DataFrame, width: int = 35, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text without the words covered by a window of ``width`` words that also starts elsewhere in the corpus.

    Returns ``doc_id, n_words, n_removed, kept, spans``: one row per input row; ``kept`` has the words that stay joined
    by one space, ``spans`` the removed word ranges.  Null and empty texts have no words and an empty ``kept``; rows
    that share a doc_id, or have none, count as documents of their own; other columns are not read.  Windows are
    compared by 64-bit hashes of their exact words.  A text, however long, is worked on as a whole: a Python worker needs
    about twelve times its bytes.  An empty table gives none.  ``width`` must exceed the period of the cover (21).
    """
    if width <= PERIOD:
        raise ValueError(f"width must be over {PERIOD}")
    n, parts = C.n_buckets(docs, text), C.n_parts(docs, text)
    docs_b = C.bucketed(docs, doc_id, text, n)

    def anchors(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        b = _Bucket(C.ordered(t), width)
        return C.key_rows(key[0].as_py(), b.anchors, b.anchor_multi, parts)

    def wins(bucket: int, t: pa.Table, masks: dict) -> pa.Table:
        b = _Bucket(t, width)
        b.candidates(C.unmask(b.anchors, masks.get("anchor", ()), parts))
        return C.key_rows(bucket, b.wins, b.win_multi, parts)

    def result(_: int, t: pa.Table, masks: dict) -> pa.Table:
        b = _Bucket(t, width)
        b.candidates(C.unmask(b.anchors, masks.get("anchor", ()), parts))
        return _result(t, b, b.removed(C.unmask(b.wins, masks.get("window", ()), parts)))

    m1 = C.repeated_masks(docs_b.groupBy("bucket").applyInArrow(anchors, C.KEYS), parts).withColumn("kind", F.lit("anchor"))
    m1 = C.materialize(m1, "anchors")
    m2 = C.repeated_masks(C.with_masks(docs_b, m1, wins, C.KEYS, n), parts).withColumn("kind", F.lit("window"))
    return C.with_masks(docs_b, m1.unionByName(m2), result, OUT, n)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = remove_repeated_windows(C.table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
ORACLE: dict[str, str] = {}
