"""Tagging with a second-order hidden Markov model (DE)."""

from __future__ import annotations

import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runeflow.config import TAGGING, TaggingConfig
from runeflow.functions import pieces

EDGE = "<edge>"


class Model(NamedTuple):
    """Log scores of tag pairs (back-off) and of the triples that were seen."""

    tags: list[str]
    pair: np.ndarray
    triple: dict[tuple[int, int, int], float]


def read_model(bi_scores: DataFrame, tri_scores: DataFrame) -> Model:
    """The tables on the driver: their size is set by the tag set (at most some hundred tags), not by the corpus."""
    b, t = bi_scores.select("t1", "t2", "prob").collect(), tri_scores.select("t1", "t2", "t3", "prob").collect()
    tags = sorted({r["t1"] for r in b} | {EDGE})
    no = {x: i for i, x in enumerate(tags)}
    pair = np.zeros((len(tags), len(tags)))
    for r in b:
        pair[no[r["t1"]], no[r["t2"]]] = np.log(max(r["prob"], 1e-300))
    return Model(tags, pair, {(no[r["t1"]], no[r["t2"]], no[r["t3"]]): float(np.log(max(r["prob"], 1e-300))) for r in t})


def viterbi(m: Model, readings: list[list[tuple[int, float]]]) -> tuple[list[int], float]:
    """Best tags and their log score.  readings: for each token (tag, log lexical score); ties go to the smaller tag number."""
    edge = m.tags.index(EDGE)
    layers = [[(edge, 0.0)], [(edge, 0.0)], *readings, [(edge, 0.0)], [(edge, 0.0)]]
    score = {(edge, edge): 0.0}
    back: list[dict[tuple[int, int], int]] = []
    for i in range(2, len(layers)):
        new: dict[tuple[int, int], float] = {}
        step: dict[tuple[int, int], int] = {}
        for b, lex in sorted(layers[i]):
            for (c, a), v in sorted(score.items()):
                s = v + m.triple.get((c, a, b), m.pair[a, b]) + lex
                if (a, b) not in new or s > new[a, b] + 1e-12:
                    new[a, b], step[a, b] = s, c
        score = new
        back.append(step)
    (a, b), best = max(sorted(score.items()), key=lambda x: x[1])
    path = []
    for step in reversed(back):
        path.append(b)
        a, b = step[a, b], a
    return path[::-1][: len(readings)], best


def viterbi_batch(m: Model, triple: np.ndarray, tags: np.ndarray, lex: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As viterbi, for many sentences at once: tag numbers of all tokens and the log score of each sentence.

    triple: scores of all triples; tags, lex: (tokens, most readings), by tag number, padded with a score of -inf; the sentences'
    first tokens and their numbers of tokens, longest sentence first.
    """
    edge, size = m.tags.index(EDGE), tags.shape[1]
    before = last = np.full((len(first), 1), edge)
    score = np.zeros((len(first), 1, 1))
    best, back = np.zeros(len(first)), []
    for i in range(int(count[0]) + 2):
        k = int(np.searchsorted(-count, 2 - i, "left"))  # count + 2 > i
        at = first[:k] + np.minimum(i, count[:k] - 1)
        cur, here = tags[at], lex[at]
        over = i >= count[:k]
        cur[over], here[over] = edge, np.r_[0.0, [-np.inf] * (size - 1)]
        s = score[:k, :, :, None] + triple[before[:k, :, None, None], last[:k, None, :, None], cur[:, None, None, :]] + here[:, None, None, :]
        score = s.max(1)
        back.append((s > score[:, None] - 1e-12).argmax(1).astype(np.int16))
        before, last = last[:k], cur
        done = count[:k] + 1 == i
        best[:k][done] = score[done, 0, 0]
    path = np.zeros(len(tags), np.int64)
    a, b = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    for i in range(len(back) - 1, -1, -1):
        k = len(back[i])
        inside = np.flatnonzero(i < count[:k])
        path[first[inside] + i] = tags[first[inside] + i, b[inside]]
        a[:k], b[:k] = back[i][np.arange(k), a[:k], b[:k]], a[:k].copy()
    return path, best


def top_readings(lexical: DataFrame, n: int) -> DataFrame:
    """DE6: the n likeliest readings of each word."""
    w = Window.partitionBy("word").orderBy(F.desc("lex"), "tag")
    return lexical.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def capital_factor(capped: Column, proper: Column, known: Column, c: TaggingConfig = TAGGING) -> Column:
    """DE7: favours proper readings of capitalised words, and others of the rest."""
    fits = capped == proper
    return F.when(known & fits, c.alpha_cap).when(known, c.alpha_no_cap).when(fits, c.alpha_unknown_cap).otherwise(c.alpha_unknown_no_cap)


def selected(fixed: str, decoded: str) -> Column:
    """DE8, DE11: a tag that is given sticks; others are the decoder's."""
    return F.coalesce(fixed, decoded)


MOST, LONGEST, TOGETHER = 6, 400, 1024
"""Sentences with more readings of a token, a token without any, or more tokens are decoded one by one, others so many together."""


def _decoded(m: Model, triple: np.ndarray, readings: pa.ListArray) -> tuple[pa.ListArray, np.ndarray]:
    """Tags and log scores of the sentences of a batch."""
    count = np.diff(np.asarray(readings.offsets)).astype(np.int64)
    tokens = readings.flatten()
    n = np.diff(np.asarray(tokens.offsets)).astype(np.int64)
    flat = tokens.flatten()
    no = {x: i for i, x in enumerate(m.tags)}
    code = flat.field("tag").dictionary_encode()
    number = np.array([no.get(x, -1) for x in code.dictionary.to_pylist()] or [0])[np.asarray(code.indices)]
    value = np.log(np.maximum(np.asarray(flat.field("lex")), 1e-300))
    token = np.repeat(np.arange(len(n)), n)[number >= 0]
    number, value = number[number >= 0], value[number >= 0]
    order = np.lexsort((number, token))
    path, best = paths(m, triple, count, np.bincount(token, minlength=len(n)), number[order], value[order])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pieces.strings(m.tags, path)), best


def paths(m: Model, triple: np.ndarray, count: np.ndarray, n: np.ndarray, number: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tag numbers of all tokens and log scores of sentences: tokens of each sentence, readings of each token, their tags (in order) and log scores."""
    start = np.cumsum(n) - n
    first = np.cumsum(count) - count
    most = np.maximum.reduceat(np.where(n == 0, MOST + 1, n), first) if len(first) else first
    path, best = np.zeros(len(n), np.int64), np.zeros(len(count))
    every = [(i, 0.0) for i, x in enumerate(m.tags) if x != EDGE]
    alone = (most > MOST) | (count > LONGEST)
    for k in np.flatnonzero(alone).tolist():
        rs = [list(zip(number[start[i] : start[i] + n[i]].tolist(), value[start[i] : start[i] + n[i]].tolist(), strict=True)) or every for i in range(first[k], first[k] + count[k])]
        path[first[k] : first[k] + count[k]], best[k] = viterbi(m, rs)
    for size in np.unique(most[~alone]).tolist():
        group = np.flatnonzero(~alone & (most == size))
        group = group[np.argsort(-count[group], kind="stable")]
        for lo in range(0, len(group), TOGETHER):
            g = group[lo : lo + TOGETHER]
            c = count[g]
            at = np.repeat(first[g] - np.cumsum(c) + c, c) + np.arange(c.sum())
            slot = np.arange(size)
            real = slot < n[at, None]
            which = np.where(real, start[at, None] + slot, 0)
            got, best[g] = viterbi_batch(m, triple, np.where(real, number[which], 0), np.where(real, value[which], -np.inf), np.cumsum(c) - c, c)
            path[at] = got
    return path, best


def _all_triples(m: Model) -> np.ndarray:
    triple = np.repeat(m.pair[None], len(m.tags), 0)
    for k, v in m.triple.items():
        triple[k] = v
    return triple


def decode(sentences: DataFrame, model: Model) -> DataFrame:
    """DE1, DE9: (..., readings array<array<struct<tag, lex>>>) -> (..., tags, log_prob); in Arrow batches.

    Sentences have at least one token.  A token without readings gets all tags alike.
    """
    shared = sentences.sparkSession.sparkContext.broadcast(model)
    others = [c for c in sentences.columns if c != "readings"]

    def run(batches):
        m = shared.value
        triple = _all_triples(m)
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                t = whole.slice(lo, 4096)
                tags, probs = _decoded(m, triple, t.column("readings"))
                yield pa.RecordBatch.from_arrays([*[t.column(c) for c in others], tags, pa.array(probs)], [*others, "tags", "log_prob"])

    out = T.StructType([sentences.schema[c] for c in others]).add("tags", T.ArrayType(T.StringType())).add("log_prob", T.DoubleType())
    return sentences.select(*others, "readings").mapInArrow(run, out)


def decode_texts(docs: DataFrame, words: DataFrame, model: Model, c: TaggingConfig = TAGGING, limit: int = 1 << 20) -> DataFrame:
    """As decode, of whole texts: (bucket, doc_id, text) and the words of each bucket (bucket, word, rs array<struct<tag, lex>>).

    Texts meet the readings of their bucket's words, each word once a bucket; tokens leave no row before they are tagged.
    Returns (doc_id, sent_id, log_prob, pos, gold, tag, known, cls).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept: list = []
    ids = docs.schema["doc_id"].dataType

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        m = shared.value
        if not kept:
            kept.append((pieces.Scanner(), _all_triples(m), {x: i for i, x in enumerate(m.tags)}))
        s, triple, no = kept[0]
        rs = words.column("rs").combine_chunks()
        flat = rs.flatten()
        number = np.array([no.get(x, -1) for x in flat.field("tag").to_pylist()], np.int64)
        lex = np.asarray(flat.field("lex"))
        of = np.repeat(np.arange(len(rs)), np.diff(np.asarray(rs.offsets)))
        order = np.lexsort((number, of))
        order = order[number[order] >= 0]
        number, lex, of = np.r_[number[order], 0], np.r_[lex[order], 0.0], of[order]
        size = np.r_[np.bincount(of, minlength=len(rs)), 0]  # the last: words without readings
        begin = np.cumsum(size) - size
        line = dict(zip(words.column("word").to_pylist(), range(len(rs)), strict=True))
        out = []
        for b in pieces.slices(texts.combine_chunks(), limit=limit):
            t = s.scan(b.column("text").combine_chunks())
            if not len(t.tok):
                continue
            used, at = np.unique(t.tok, return_inverse=True)
            own = np.array([line.get(s.toks[k].lower(), -1) for k in used.tolist()])[at]
            capped = np.array([s.toks[k][0].isalpha() and unicodedata.category(s.toks[k][0]) == "Lu" for k in used.tolist()])[at]
            is_word = s.is_word()[t.tok]
            n = size[own]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            which = np.repeat(begin[own], n) + step
            fits = np.repeat(capped, n) == (number[which] == no.get("word.cap", -1))
            factor = np.where(np.repeat(is_word, n), np.where(fits, c.alpha_cap, c.alpha_no_cap), 1.0)
            first = t.starts()
            count = np.diff(np.r_[np.flatnonzero(first), len(first)])
            path, best = paths(m, triple, count, n, number[which], np.log(np.maximum(lex[which] * factor, 1e-300)))
            columns = [b.column("doc_id").combine_chunks().take(pa.array(t.row)), pa.array(t.sent), pa.array(np.repeat(best, count)), pa.array(t.pos.astype(np.int32)), pieces.strings(pieces.TAGS, s.tag[t.tok]), pieces.strings(m.tags, path), pa.array(own >= 0), pieces.strings(pieces.CLASSES, s.cls[t.tok])]
            out.append(pa.Table.from_arrays(columns, names))
        return pa.concat_tables(out) if out else pa.Table.from_arrays([texts.column("doc_id").slice(0, 0).combine_chunks(), *[pa.array([], x) for x in (pa.int64(), pa.float64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string())]], names)

    names = ["doc_id", "sent_id", "log_prob", "pos", "gold", "tag", "known", "cls"]
    kinds = (ids, T.LongType(), T.DoubleType(), T.IntegerType(), T.StringType(), T.StringType(), T.BooleanType(), T.StringType())
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])
    return docs.select("bucket", "doc_id", "text").groupBy("bucket").cogroup(words.select("bucket", "word", "rs").groupBy("bucket")).applyInArrow(run, schema)
