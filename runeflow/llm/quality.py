"""Document quality by a linear-chain conditional random field over lines (operator 5).

Every line is good or bad.  A line's state depends on binned measures of itself and of the lines before and after it, and
on its neighbour's state.  The field is fitted to labelled documents, whose lines take the label of the document at
first; lines of bad documents that the fitted field finds good are then relabelled, and it is fitted once more.  A
document's quality is the mean of its lines' forward-backward marginals, weighted by their lengths, put on a probability
scale by a logistic curve.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import hashing as H
from .language import bounded_sample, fold_of

ROWS, CHARS = 1500, 20_000
"""Bound of the fit: so many rows of each label, chosen by hash, none longer than so many characters."""
BINS = 6
STEPS, RATE, RIDGE = 150, 0.1, 1e-4
CUT = 0.3

_CLASS = np.zeros((6, 256), bool)
_CLASS[0, 65:91] = True  # capitals
_CLASS[1, 48:58] = True  # digits
_CLASS[2, [44, 46, 59, 58, 63, 45, 39, 34, 40, 41]] = True  # common punctuation
_CLASS[3] = [33 <= c < 127 and not chr(c).isalnum() and not _CLASS[2, c] for c in range(256)]  # other signs
_CLASS[4] = [c < 32 and c != 10 for c in range(256)]
_CLASS[5, 128:192] = True  # continuation bytes
_DIGIT_LETTER = np.array([chr(c).isalnum() or c >= 128 for c in range(256)])


class Lines(NamedTuple):
    first: np.ndarray  # of each text; one more at the end
    weight: np.ndarray  # bytes, 1 at least
    measures: np.ndarray  # (lines, measures)


def read_lines(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """Lines of each text, parted by newlines; an empty text is one empty line."""
    n = len(offsets) - 1
    cuts = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, cuts, side="right") - 1
    count = np.bincount(owner, minlength=n) + 1
    first = np.r_[0, np.cumsum(count)]
    start = np.empty(first[-1], np.int64)
    stop = np.empty(first[-1], np.int64)
    start[first[:-1]] = offsets[:-1]
    stop[first[1:] - 1] = offsets[1:]
    rank = np.arange(len(cuts)) - np.searchsorted(cuts, offsets[:-1])[owner]
    start[first[:-1][owner] + rank + 1] = cuts + 1
    stop[first[:-1][owner] + rank] = cuts
    size = stop - start

    total = lambda flags: (lambda c: c[stop] - c[start])(np.r_[0, np.cumsum(flags, dtype=np.int64)])
    share = [total(k[data]) / np.maximum(size, 1) for k in _CLASS]
    w = H.Words(data, offsets)
    h = H.word_hashes(data, w)
    line = np.searchsorted(start, w.start, side="right") - 1
    # empty lines share their start with the next line: a word belongs to the last line that starts at or before it
    words = np.bincount(line, minlength=len(start))
    per = np.maximum(words, 1)
    same = np.r_[False, (h[1:] == h[:-1]) & (line[1:] == line[:-1])] if len(h) else np.zeros(0, bool)
    order = np.lexsort((h, line))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])] if len(h) else np.zeros(0, bool)
    different = np.bincount(line[order][new], minlength=len(start))
    sign_end = ~_DIGIT_LETTER[data[w.end - 1]] if len(h) else np.zeros(0, bool)
    in_line = lambda flags: np.bincount(line[flags], minlength=len(start)) / per
    last = np.where(size > 0, data[np.maximum(stop - 1, 0)] if len(data) else 0, 0)
    m = np.stack([*share, np.log1p(size), np.log1p(words), size / per, in_line(same), different / per, in_line(sign_end), last == 46, np.where(size > 0, _CLASS[0][data[np.minimum(start, len(data) - 1)]] if len(data) else 0, 0)], 1)
    return Lines(first, np.maximum(size, 1), m.astype(float))


class Field(NamedTuple):
    edges: list[np.ndarray]  # of the bins of each measure
    weights: np.ndarray  # of good against bad, for each feature
    moves: np.ndarray  # 2 x 2: score of a state after another
    curve: tuple[float, float]


def features(lines: Lines, edges: list[np.ndarray]) -> np.ndarray:
    """Numbers of the features that each line has: its own bins, then those of its neighbours (or the text's edge)."""
    own = np.stack([np.searchsorted(e, lines.measures[:, k], side="right") for k, e in enumerate(edges)], 1)
    k, wide = own.shape[1], BINS + 1
    base = np.arange(k) * wide
    edge = np.full((1, k), BINS)
    before, after = np.r_[edge, own[:-1]], np.r_[own[1:], edge]
    before[lines.first[:-1]] = BINS
    after[lines.first[1:] - 1] = BINS
    return np.concatenate([own + base, before + base + k * wide, after + base + 2 * k * wide, np.full((len(own), 1), 3 * k * wide)], 1)


def forward_backward(e: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of good, summed pair marginals (2 x 2), and the log partition of each text.  e: score of good of each line."""
    size = np.diff(first)
    by = np.argsort(-size, kind="stable")
    start, size = first[:-1][by], size[by]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")
    a, b = np.zeros((len(e), 2)), np.zeros((len(e), 2))
    for t in range(longest):
        k = active[t]
        at = start[:k] + t
        if t:
            p = a[at - 1]
            a[at, 0] = np.logaddexp(p[:, 0] + moves[0, 0], p[:, 1] + moves[1, 0])
            a[at, 1] = np.logaddexp(p[:, 0] + moves[0, 1], p[:, 1] + moves[1, 1])
        a[at, 1] += e[at]
    for t in range(longest - 2, -1, -1):
        k = active[t + 1]  # the others end here
        at = start[:k] + t
        q0, q1 = b[at + 1, 0], b[at + 1, 1] + e[at + 1]
        b[at, 0] = np.logaddexp(moves[0, 0] + q0, moves[0, 1] + q1)
        b[at, 1] = np.logaddexp(moves[1, 0] + q0, moves[1, 1] + q1)
    ends = first[1:] - 1
    z = np.logaddexp(a[ends, 0], a[ends, 1])
    zz = np.repeat(z, np.diff(first))
    good = np.exp(a[:, 1] + b[:, 1] - zz)
    pairs = np.zeros((2, 2))
    inner = np.ones(len(e), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    for i in range(2):
        for j in range(2):
            pairs[i, j] = np.exp(a[at - 1, i] + moves[i, j] + b[at, j] + (e[at] if j else 0) - zz[at]).sum()
    return good, pairs, z


def _train(feats: np.ndarray, first: np.ndarray, y: np.ndarray, n_features: int, start: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    w, moves = start if start else (np.zeros(n_features), np.zeros((2, 2)))
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    seen = np.bincount(2 * y[at - 1] + y[at], minlength=4).reshape(2, 2)
    m, v = np.zeros(n_features + 4), np.zeros(n_features + 4)
    for step in range(1, STEPS + 1):
        good, pairs, _ = forward_backward(w[feats].sum(1), first, moves)
        g = np.bincount(feats.ravel(), weights=np.repeat(y - good, feats.shape[1]), minlength=n_features) / len(y) - RIDGE * w
        g = np.r_[g, ((seen - pairs) / len(y) - RIDGE * moves).ravel()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        d = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, moves = w + d[:-4], moves + d[-4:].reshape(2, 2)
    return w, moves


def _quality(good: np.ndarray, lines: Lines) -> np.ndarray:
    return np.add.reduceat(good * lines.weight, lines.first[:-1]) / np.add.reduceat(lines.weight.astype(float), lines.first[:-1])


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def fit(texts: list[str], labels: np.ndarray, prior: float) -> Field | None:
    """``prior``: share of good documents that scores should agree with."""
    if not len(texts) or labels.min() == labels.max():
        return None
    lines = read_lines(*C.utf8(pa.array(texts, pa.string())))
    edges = [np.unique(np.quantile(x, np.arange(1, BINS) / BINS)) for x in lines.measures.T]
    feats = features(lines, edges)
    n = int(3 * lines.measures.shape[1] * (BINS + 1)) + 1
    per = np.diff(lines.first)
    y = np.repeat(labels, per)
    w, moves = _train(feats, lines.first, y, n, None)
    alone = 1 / (1 + np.exp(-w[feats].sum(1)))
    y2 = np.where((y == 0) & (alone > 0.7), 1, y)
    w, moves = _train(feats, lines.first, y2, n, (w, moves))
    x = _logit(_quality(forward_backward(w[feats].sum(1), lines.first, moves)[0], lines))
    part = labels.mean()
    weight = np.where(labels == 1, prior / part, (1 - prior) / (1 - part))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic curve, slightly held back
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([((labels - p) * weight * x).sum() - 0.01 * a, ((labels - p) * weight).sum() - 0.01 * b])
        r = p * (1 - p) * weight
        hess = np.array([[(r * x * x).sum() + 0.01, (r * x).sum()], [(r * x).sum(), r.sum() + 0.01]])
        d = np.linalg.solve(hess, g)
        a, b = a + np.clip(d[0], -1, 1), b + np.clip(d[1], -1, 1)
    return Field(edges, w, moves, (float(a), float(b)))


def score_texts(f: Field, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    lines = read_lines(data, offsets)
    good, _, _ = forward_backward(f.weights[features(lines, f.edges)].sum(1), lines.first, f.moves)
    a, b = f.curve
    return 1 / (1 + np.exp(-(a * _logit(_quality(good, lines)) + b)))


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = ROWS) -> DataFrame:
    """The quality of every whole text: ``doc_id, held_out, score, predicted``, one row per input row.

    Learned from rows of ``labels`` (doc_id, 0 or 1) outside the held-out fold: at most about ``rows`` of each label,
    chosen by hash, with texts of at most 20,000 characters.  ``score`` is the probability of label 1 at the labels' own
    rates; ``predicted`` is 1 from ``cut`` up.  Null and empty texts are one empty line.  If nothing can be learned (no
    labels, or one only) the score is the share of label 1, or 0.5.  A document labelled both ways counts as 0; a null
    id is not held out.  Other columns are not read.
    """
    marks = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(fold_of("doc_id") != 0)
    marks = marks.groupBy("doc_id").agg(F.min("y").alias("y"))
    n = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    prior = n.get(1, 0) / max(sum(n.values()), 1) if n else 0.5
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    some = bounded_sample(marks, "y", rows, 5).collect()  # at most about 2 * rows
    field = None
    if some:
        chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["y"]) for r in some], "doc_id long, y int")
        train = d.where(F.col("text").isNotNull() & (F.length("text") <= CHARS)).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).collect()
        train.sort(key=lambda r: r["doc_id"])
        field = fit([r["text"] for r in train], np.array([r["y"] for r in train], np.int64), prior)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        f = shared.value
        for whole in batches:
            for b in C.slices(whole, 2):
                s = score_texts(f, *C.utf8(b.column(2))) if f else np.full(b.num_rows, prior)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return d.select("doc_id", F.coalesce(fold_of("doc_id") == 0, F.lit(False)).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


QUERIES = {"op5_quality_crf": op5_quality_crf}
ORACLE: dict[str, str] = {}
