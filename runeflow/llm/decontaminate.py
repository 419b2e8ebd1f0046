"""Benchmark decontamination (operator 2): n-gram seeds, then Smith-Waterman alignment of words.

The test items, in blocks of bounded size, are held by every task; the corpus is only scanned, never shuffled.  Every
n-gram of an item is a seed, however frequent it is: the n-grams that an edited copy keeps may be the most frequent ones
of its item.  An item is aligned with the passages around its seeds, allowing for changed, dropped and added words, unless
they hold too few of its words to reach the score; pairs are reported whose score is a large enough share of the item's own.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import hashing as H

NGRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -1
SCORE = 0.4
ITEM_BYTES = 4 << 20
"""Bytes of items that tasks hold at a time; a larger benchmark is done in several scans."""
HITS = 1 << 20
"""Places of seeds that a task looks at together."""
OUT = "doc_id long, item_id long, score double, begin int, end int"

_PLAIN = np.full(256, 32, np.uint8)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _PLAIN[_a:_b] = np.arange(_a, _b)
_PLAIN[65:91] = np.arange(97, 123)


def plain(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of the same number: lower case (ASCII and Latin-1), punctuation (ASCII, Latin-1, U+2000 to U+207F) blanked."""
    out = _PLAIN[data]
    if not len(data):
        return out
    before = np.r_[np.uint8(0), data[:-1]]
    upper = (before == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    out[upper] += 32
    sign = np.flatnonzero(data == 0xC2)
    out[sign] = 32
    out[np.minimum(sign + 1, len(data) - 1)] = 32
    general = np.flatnonzero((before == 0xE2) & ((data == 0x80) | (data == 0x81)))
    for k in (-1, 0, 1):
        out[np.minimum(general + k, len(data) - 1)] = 32
    return out


class Items(NamedTuple):
    ids: list[int | None]
    hashes: np.ndarray  # of all words
    first: np.ndarray
    count: np.ndarray
    grams: np.ndarray  # sorted distinct n-grams
    gram_of: np.ndarray  # for each n-gram of each item: its number in grams,
    item_of: np.ndarray  # its item
    place_of: np.ndarray  # and its place there
    words: np.ndarray  # sorted distinct words
    keys: np.ndarray  # sorted item * len(words) + word, of the words of each item
    times: np.ndarray  # how often the item has that word


def read_items(ids: list[int | None], texts: list[str | None]) -> Items:
    data, offsets = C.utf8(pa.array(texts, pa.string()))
    data = plain(data)
    w = H.Words(data, offsets)
    h = H.word_hashes(data, w)
    at = np.flatnonzero(w.count[w.doc] - w.place >= NGRAM)
    grams, which = np.unique(H.windows(h, NGRAM)[at] if len(at) else np.zeros(0, H.U), return_inverse=True)
    words, no = np.unique(h, return_inverse=True)
    keys, times = np.unique(w.doc * len(words) + no, return_counts=True)
    return Items(ids, h, w.first, w.count, grams, which, w.doc[at], w.place[at], words, keys, times)


class _Batch:
    """Words of a batch of texts and the places at which an n-gram of the items stands."""

    def __init__(self, texts: pa.Array, items: Items) -> None:
        data, offsets = C.utf8(texts)
        data = plain(data)
        self.w = w = H.Words(data, offsets)
        self.h = H.word_hashes(data, w)
        grams = H.windows(self.h, NGRAM)
        at = np.minimum(np.searchsorted(items.grams, grams), max(len(items.grams) - 1, 0))
        hit = items.grams[at] == grams if len(items.grams) else np.zeros(len(grams), bool)
        hit &= (w.count[w.doc] - w.place >= NGRAM)[: len(grams)]
        self.at = np.flatnonzero(hit)
        self.gram = at[self.at]
        self.word = np.minimum(np.searchsorted(items.words, self.h), max(len(items.words) - 1, 0))
        self.word[items.words[self.word] != self.h if len(items.words) else slice(None)] = -1


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each row of ``a`` (pairs, n) with that of ``b`` (pairs, m); 0 and 1 are paddings that match nothing.

    Returns its score and where it ends (exclusive) in a and in b.
    """
    pairs, m = b.shape
    step = np.arange(m + 1, dtype=np.int32) * -GAP
    row = np.zeros((pairs, m + 1), np.int32)
    best, end_a, end_b = np.zeros(pairs, np.int32), np.zeros(pairs, np.int32), np.zeros(pairs, np.int32)
    for i in range(a.shape[1]):
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + np.where(a[:, i, None] == b, MATCH, MISMATCH), row[:, 1:] + GAP)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + step, axis=1) - step
        top = row.argmax(1)
        value = row[np.arange(pairs), top]
        up = value > best
        best[up], end_a[up], end_b[up] = value[up], i + 1, top[up]
    return best, end_a, end_b


def _padded(values: np.ndarray, first: np.ndarray, count: np.ndarray, fill: int) -> np.ndarray:
    out = np.full((len(first), int(count.max())), H.U(fill))
    idx = C.ragged(first, count)
    ends = np.cumsum(count)
    out[np.repeat(np.arange(len(first)), count), np.arange(len(idx)) - np.repeat(ends - count, count)] = values[idx]
    return out


class Seeds(NamedTuple):
    """The n-grams of all items, by n-gram and item."""

    key: np.ndarray  # n-gram * number of items + item
    item: np.ndarray
    place: np.ndarray
    count: np.ndarray  # of each n-gram


def seeds_of(items: Items) -> Seeds:
    key = items.gram_of * len(items.ids) + items.item_of
    order = np.argsort(key, kind="stable")
    return Seeds(key[order], items.item_of[order], items.place_of[order], np.bincount(items.gram_of, minlength=len(items.grams)))


def _enough(b: _Batch, items: Items, doc: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray, least: float) -> np.ndarray:
    """Whether each passage could score ``least``: a bound, as if all words that it shares with the item were aligned."""
    which = np.repeat(np.arange(len(doc)), end - begin)
    word = b.word[C.ragged(b.w.first[doc] + begin, end - begin)]
    which, word = which[word >= 0], word[word >= 0]
    key = item[which] * len(items.words) + word
    at = np.minimum(np.searchsorted(items.keys, key), len(items.keys) - 1)
    here = items.keys[at] == key
    shared, n = np.unique(which[here] * len(items.keys) + at[here], return_counts=True)
    matches = np.bincount(shared // len(items.keys), np.minimum(n, items.times[shared % len(items.keys)]), len(doc))
    return MATCH * matches / (MATCH * items.count[item]) >= least


def _passages(b: _Batch, items: Items, seeds: Seeds, hits: slice, lo: int, hi: int, least: float) -> np.ndarray:
    """(text, item, begin, end) of the passages around the seeds at ``hits`` of the items lo to hi - 1 that could score ``least``."""
    w, n_items = b.w, len(items.ids)
    gram = b.gram[hits]
    first = np.searchsorted(seeds.key, gram * n_items + lo)
    n = np.searchsorted(seeds.key, gram * n_items + hi) - first
    s = C.ragged(first, n)
    if not len(s):
        return np.zeros((0, 4), np.int64)
    at = np.repeat(b.at[hits], n)
    # seeds on one diagonal have one passage
    t = np.unique(np.stack([w.doc[at], seeds.item[s], w.place[at] - seeds.place[s]], 1), axis=0)
    doc, item, m = t[:, 0], t[:, 1], items.count[t[:, 1]]
    pad = m // 4 + 2
    begin, end = np.maximum(t[:, 2] - pad, 0), np.minimum(t[:, 2] + m + pad, w.count[doc])
    run = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] > end[:-1])])
    last = np.r_[run[1:], len(t)] - 1
    could = _enough(b, items, doc[run], item[run], begin[run], end[last], least)
    short = end[last] - begin[run] <= 3 * m[run] + 8
    whole = could & short
    out = [np.stack([doc[run], item[run], begin[run], end[last]], 1)[whole]]
    # passages that overlap are one passage, cut where it would exceed thrice the item
    parts: list[list[int]] = []
    for j, k in zip(run[could & ~short].tolist(), last[could & ~short].tolist(), strict=True):
        size = 3 * int(m[j]) + 8
        parts.append([int(doc[j]), int(item[j]), int(begin[j]), int(end[j])])
        for p, q in zip(begin[j + 1 : k + 1].tolist(), end[j + 1 : k + 1].tolist(), strict=True):
            if q - parts[-1][2] <= size:
                parts[-1][3] = q
            else:
                parts.append([int(doc[j]), int(item[j]), p, q])
    if parts:
        t = np.array(parts)
        out.append(t[_enough(b, items, *t.T, least)])
    return np.concatenate(out)


def align(b: _Batch, items: Items, seeds: Seeds, least: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, begin, end) of each text and item that align well enough; word places in the text."""
    if not len(b.at):
        return []
    w = b.w
    n_items = len(items.ids)
    total = np.cumsum(seeds.count[b.gram])
    ends = np.flatnonzero(np.r_[w.doc[b.at[1:]] != w.doc[b.at[:-1]], True]) + 1  # hits of one text stay together
    t, lo = [], 0
    while lo < len(b.at):
        before = total[lo - 1] if lo else 0
        k = int(np.searchsorted(ends, np.searchsorted(total, before + HITS, "right"), "right")) - 1
        hi = int(ends[k]) if k >= 0 and ends[k] > lo else int(ends[np.searchsorted(ends, lo, "right")])
        step = max(1, n_items // -(-int(total[hi - 1] - before) // HITS))
        for i in range(0, n_items, step):
            t.append(_passages(b, items, seeds, slice(lo, hi), i, min(i + step, n_items), least))
        lo = hi
    t = np.concatenate(t)
    if not len(t):
        return []
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    t = t[np.argsort(t[:, 3] - t[:, 2], kind="stable")]
    for lo in range(0, len(t), 256):
        d, i, p, q = t[lo : lo + 256].T
        a = _padded(b.h, w.first[d] + p, q - p, 0)
        c = _padded(items.hashes, items.first[i], items.count[i], 1)
        score, end_a, end_b = smith_waterman(a, c)
        share = score / (MATCH * items.count[i])
        for k in np.flatnonzero(share >= least).tolist():
            # backwards from its end, the same alignment ends where it begins
            ra, rc = a[k : k + 1, : end_a[k]][:, ::-1], c[k : k + 1, : end_b[k]][:, ::-1]
            _, back, _ = smith_waterman(ra, rc)
            key, value = (int(d[k]), int(i[k])), (float(share[k]), int(p[k] + end_a[k] - back[0]), int(p[k] + end_a[k]))
            if key not in found or (-value[0], value[1]) < (-found[key][0], found[key][1]):
                found[key] = value
    return [(*k, *v) for k, v in sorted(found.items())]


def _blocks(bench: DataFrame, item_id: str, text: str) -> list[Items]:
    """The benchmark in blocks of at most ITEM_BYTES (or one item)."""
    d = bench.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // ITEM_BYTES))
    out = []
    for k in range(n):
        rows = d.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect() if n > 1 else d.collect()
        out.append(read_items([r["item_id"] for r in rows], [r["text"] for r in rows]))
    return out


def _found(texts: pa.Array, items: Items, seeds: Seeds, score: float) -> list[tuple[int, int, float, int, int]]:
    return align(_Batch(texts, items), items, seeds, score)


def contaminated(docs: DataFrame, bench: DataFrame, score: float = SCORE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of a document and a test item that it holds, as it is or edited.

    Returns ``doc_id, item_id, score, begin, end``, one row for a pair: the best alignment's score as a share of the
    item's score with itself (2 for each equal word, -1 for each changed, dropped or added one), at least ``score``; and
    its words in the document.  Words are compared without case and punctuation.  Null and empty texts, and items of
    fewer than 3 words, match nothing.  Repeated rows and null ids are reported as they are; other columns are not read.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    results = []
    for items in _blocks(bench, item_id, item_text):

        def pairs(batches, items=items, seeds=seeds_of(items)):
            for whole in batches:
                for t in C.slices(whole, 1):
                    rows = _found(t.column(1), items, seeds, score)
                    if rows:
                        text_no, item_no, share, begin, end = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [t.column(0).take(pa.array(text_no)), pa.array([items.ids[i] for i in item_no], pa.int64()), pa.array(share), pa.array(begin, pa.int32()), pa.array(end, pa.int32())],
                            ["doc_id", "item_id", "score", "begin", "end"],
                        )

        results.append(d.mapInArrow(pairs, OUT))
    out = results[0]
    for r in results[1:]:
        out = out.union(r)
    return out


def clean(docs: DataFrame, bench: DataFrame, score: float = SCORE, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows of ``docs``, with all their columns, that hold no test item; judged where they are read, without a join."""
    at = docs.columns.index(text)
    for items in _blocks(bench, item_id, item_text):

        def free(batches, items=items, seeds=seeds_of(items)):
            for whole in batches:
                for t in C.slices(whole, at):
                    keep = np.ones(t.num_rows, bool)
                    keep[[r[0] for r in _found(t.column(at), items, seeds, score)]] = False
                    yield t.filter(pa.array(keep))

        docs = docs.mapInArrow(free, docs.schema)
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontaminate": op2_decontaminate}
ORACLE: dict[str, str] = {}
