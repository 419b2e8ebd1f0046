"""Language identification by prediction by partial matching (operator 4).

For each language a context tree of bytes is fitted: contexts of up to ``ORDER`` bytes that occur often enough, each with
the counts of the bytes that follow.  A context gives an unseen byte its escape probability (method C: distinct symbols
over symbols plus distinct symbols) times what the next shorter context says, spread over the bytes not yet seen; below
the empty context all bytes are alike.  The statistics are then frozen, so the tree is an automaton with a fixed cost for
each state and byte, and the exact code length of a whole text is a sum along its path.  The language with the shortest
code wins.  Texts are cut into pieces that run through the automaton side by side; a piece first reads the ``ORDER``
bytes before it, after which its state is the same as if it had read the whole text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

ORDER, LEAST = 4, 6
"""Longest context, and how often a context must occur to be a state."""
ROWS, CHARS = 300, 20_000
"""Bound of the fit: so many rows of each language, chosen by hash, none longer than so many characters."""
PIECE = 256
SHARP = 40
"""Bytes to which a text's margin counts at most, so that scores of long texts still differ."""
UND = "und"
OUT = "doc_id long, held_out boolean, lang_pred string, score double, bits double, n_bytes long"

_FOLD = np.full(256, ord("."), np.uint8)
for _a, _b in ((97, 123), (128, 256)):
    _FOLD[_a:_b] = np.arange(_a, _b)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[48:58] = ord("0")
_FOLD[[32, *range(9, 14)]] = ord(" ")


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with case (ASCII, Latin-1), digits, white space and other signs folded."""
    out = _FOLD[data]
    if len(data):
        before = np.r_[np.uint8(0), data[:-1]]
        out[(before == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return out


class Automaton(NamedTuple):
    cost: np.ndarray  # bits, flat: state * symbols + symbol
    step: np.ndarray  # next state, likewise


class Model(NamedTuple):
    langs: list[str]
    code: np.ndarray  # folded byte -> symbol
    symbols: int
    trees: list[Automaton]


def fit_tree(s: np.ndarray, a: int) -> Automaton:
    """The automaton of the symbol sequence ``s`` over ``a`` symbols."""
    n = len(s)
    s = s.astype(np.int64)
    keys, probs, parents = [np.zeros(1, np.int64)], [], []
    first = [0]
    context = np.zeros(n, np.int64)  # the k symbols before each place, the nearest in the highest digit
    for k in range(ORDER + 1):
        if k:
            if n <= k:
                break
            context[k:] += s[: n - k] * a ** (ORDER - k)  # digit of the k-th symbol back; shared by all orders
            at = np.arange(k, n)
            u, inverse, count = np.unique(context[at], return_inverse=True, return_counts=True)
            often = count >= LEAST
            number = np.cumsum(often) - 1
            keep = often[inverse]
            at, row = at[keep], number[inverse[keep]]
            if not often.any():
                break
            keys.append(u[often])
            first.append(first[-1] + len(keys[-2]))
            short = u[often] - u[often] % a ** (ORDER - k + 1)
            parents.append(np.searchsorted(keys[-2], short))
        else:
            at, row = np.arange(n), np.zeros(n, np.int64)
        counts = np.bincount(row * a + s[at], minlength=len(keys[-1]) * a).reshape(-1, a).astype(float)
        seen = counts > 0
        d, total = seen.sum(1, keepdims=True), counts.sum(1, keepdims=True)
        lower = probs[-1][parents[-1]] if k else np.full((1, a), 1 / a)
        new = np.where(seen, 0, lower)
        left = new.sum(1, keepdims=True)
        escape = np.where(left > 0, d, 0)
        probs.append(np.where(seen, counts / np.maximum(total + escape, 1), new * escape / np.maximum(total + escape, 1) / np.where(left > 0, left, 1)) if n else lower)
    p = np.concatenate(probs)
    # the state after a symbol: the longest known context among the symbol and what was known before it
    key = np.concatenate(keys)
    order = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
    longest = np.arange(a, dtype=np.int64) * a ** (ORDER - 1) + (key // a)[:, None]  # nearest symbol in the highest digit
    step = np.zeros((len(key), a), np.int64)
    for k in range(1, len(keys)):
        unit = a ** (ORDER - k)
        want = longest - longest % unit
        at = np.minimum(np.searchsorted(keys[k], want), len(keys[k]) - 1)
        ok = (keys[k][at] == want) & (order[:, None] >= k - 1)
        step[ok] = first[k] + at[ok]
    return Automaton(-np.log2(p).astype(np.float32).ravel(), step.astype(np.int32).ravel())


def fit(rows: list[tuple[str, str]]) -> Model:
    """From (language, text)."""
    by: dict[str, list[str]] = {}
    for lang, text in rows:
        by.setdefault(lang, []).append(text)
    langs = sorted(by)
    raw = {k: folded(np.frombuffer(("\n".join(sorted(by[k])) + "\n").encode(), np.uint8)) for k in langs}
    used = np.zeros(256, bool)
    for v in raw.values():
        used |= np.bincount(v, minlength=256) >= LEAST
    code = np.full(256, used.sum(), np.uint8)  # all other bytes are one more symbol
    code[used] = np.arange(used.sum())
    a = int(used.sum()) + 1
    return Model(langs, code, a, [fit_tree(code[raw[k]], a) for k in langs])


def code_lengths(m: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits that each language's tree takes for each text: (texts, languages)."""
    n = len(offsets) - 1
    s = m.code[folded(data)]
    size = np.diff(offsets)
    pieces = -(-size // PIECE)
    doc = np.repeat(np.arange(n), pieces)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = offsets[doc] + number * PIECE
    length = np.minimum(PIECE, size[doc] - number * PIECE)
    by = np.argsort(-length, kind="stable")
    doc, number, start, length = doc[by], number[by], start[by], length[by]
    active = np.searchsorted(-length, -np.arange(PIECE), side="left")  # pieces longer than j
    later = np.flatnonzero(number > 0)
    out = np.zeros((n, len(m.langs)))
    bits = [np.zeros(len(doc)) for _ in m.langs]
    state = [np.zeros(len(doc), np.int64) for _ in m.langs]
    for j in range(-ORDER, 0):
        x = s[start[later] + j]
        for st, tree in zip(state, m.trees, strict=True):
            st[later] = tree.step[st[later] * m.symbols + x]
    for j in range(PIECE):
        k = int(active[j])
        if not k:
            break
        x = s[start[:k] + j]
        for b, st, tree in zip(bits, state, m.trees, strict=True):
            at = st[:k] * m.symbols + x
            b[:k] += tree.cost[at]
            st[:k] = tree.step[at]
    for i, b in enumerate(bits):
        out[:, i] = np.bincount(doc, weights=b, minlength=n)
    return out


def fold_of(doc_id: str) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def bounded_sample(rows: DataFrame, label: str, per_label: int, seed: int) -> DataFrame:
    """About ``per_label`` rows of each label, chosen by a hash of ``doc_id``; a few per cent more than asked for."""
    n = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    share = F.create_map(*[x for k, v in n.items() for x in (F.lit(k), F.lit(min(1.0, 1.1 * per_label / v)))]) if n else F.create_map()
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    return rows.where(u < share[F.col(label)]) if n else rows.limit(0)


def learn(train: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS) -> Model:
    """Fits the trees to the rows with a language outside the held-out fold, at most about ``rows`` of each language."""
    t = train.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    t = t.where((fold_of("doc_id") != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= CHARS))
    return fit([(r["lang"], r["text"]) for r in bounded_sample(t, "lang", rows, 4).select("lang", "text").collect()])


def predict(m: Model, texts: pa.Array, letters: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, bits and bytes of each text."""
    data, offsets = C.utf8(texts)
    n = len(offsets) - 1
    some = letters.to_numpy(zero_copy_only=False).astype(bool)
    names, score, least = np.full(n, UND, object), np.zeros(n), np.zeros(n)
    if m.langs and n:
        bits = code_lengths(m, data, offsets)
        best = bits.argmin(1)
        least = bits[np.arange(n), best]
        scale = np.minimum(1, SHARP / np.maximum(np.diff(offsets), 1))
        p = 1 / np.exp2(-np.minimum((bits - least[:, None]) * scale[:, None], 1000)).sum(1)
        names = np.where(some, np.array(m.langs, object)[best], UND)
        score = np.where(some, p, 0.0)
    return names, score, least, np.diff(offsets)


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, train: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS) -> DataFrame:
    """The language of every whole text, learned from the rows of ``train`` (default: ``docs``) with a language and outside the held-out fold.

    Returns one row per input row: ``doc_id, held_out, lang_pred, score, bits, n_bytes``.  ``lang_pred`` is a learned
    language, ties to the first by name, or ``und`` if the text is null or has no letter, or nothing was learned (score 0).
    ``score``: 1 / sum of 2 ** -(excess of each language's code over the shortest), the excess scaled to that of 40 bytes
    in longer texts.  Learning reads at most about ``rows`` texts of each language, chosen by hash, of at most 20,000
    characters.  A null id is not held out.  ``lang`` takes no part in a prediction; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs if train is None else train, doc_id, text, lang, rows))  # bounded by the sample

    def run(batches):
        for whole in batches:
            for b in C.slices(whole, 2, rows=2048):
                names, score, least, size = predict(shared.value, b.column(2), b.column(3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(least), pa.array(size)], ["doc_id", "held_out", "lang_pred", "score", "bits", "n_bytes"])

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(fold_of(doc_id) == 0, F.lit(False)).alias("held_out"), F.col(text).alias("text"), has_letter(text).alias("letters"))
    return d.mapInArrow(run, OUT)


def in_a_language(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows of ``docs``, with all their columns, whose language isn't ``und``; judged where they are read, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, doc_id, text, lang))
    names, at = docs.columns, docs.columns.index(text)

    def run(batches):
        for whole in batches:
            for b in C.slices(whole, at, rows=2048):
                found = predict(shared.value, b.column(at), b.column(len(names)))[0]
                yield b.select(list(range(len(names)))).filter(pa.array(found != UND))

    flag = "_letters"
    while flag in names:
        flag += "_"
    return docs.withColumn(flag, has_letter(text)).mapInArrow(run, docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(C.table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
ORACLE: dict[str, str] = {}
