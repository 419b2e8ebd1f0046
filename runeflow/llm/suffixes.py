"""Repeated byte strings by prefix-free parsing: suffix arrays of the dictionary and of the parse (operator 10).

A rolling hash of ``GRAM`` bytes triggers phrase ends: the trigger of a place is the leftmost smallest hash among the
``width - GRAM + 1`` grams that its ``width``-byte string holds, so equal strings have the same trigger at the same
distance wherever they stand, and every string holds one.  Places that share a trigger form a phrase: a word of the
dictionary, which ends with the trigger, and the parse that follows it, of which up to ``width - GRAM`` bytes matter.

Phrases whose trigger gram repeats in the corpus meet in the part of that gram.  There the suffixes of the distinct
words are sorted by prefix doubling, and so are the distinct continuations (suffixes of the parse), with the longest
common prefixes of neighbours.  A string is a suffix of a word and a prefix of a continuation, so sorting the pairs of
both ranks puts the part's strings into corpus order: strings are equal if their word suffixes are and the common
prefix of their continuations reaches to the ``width``-th byte.  Of each run of equal strings all but the earliest are
repeats.  Strings with different triggers are never equal, so no comparison crosses parts.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import hashing as H

GRAM = 48
PLACE = H.U((1 << 20) - 1)
STRETCH = 1 << 18
"""Places that are parsed, and phrases' bytes that are hashed, at a time."""
PART_BYTES = 8 << 20
"""Text bytes whose phrases one part sorts, if all of them repeat."""
SORTED = 200_000
"""Strings that a part sorts together, unless one trigger has more."""
LAST = np.int64(2**63 - 1)
PHRASES = "part int, bucket int, phrases binary"
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<begin:int,end:int>>"


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """min(v[i : i + width]) for each i at which that many are left."""
    step = 1
    while step * 2 <= width:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    rest = width - step
    return np.minimum(v[:-rest], v[rest:]) if rest else v


def parse(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of the texts: first and last place, place of the trigger, its hash."""
    ends = offsets[1:] - width + 1  # a text's places end here
    out: list[list[np.ndarray]] = [[], [], [], []]
    ok = np.zeros(len(data) + 1, np.int8)
    some = np.flatnonzero(ends > offsets[:-1])
    ok[offsets[:-1][some]] += 1
    ok[ends[some]] -= 1
    ok = np.cumsum(ok, dtype=np.int8).astype(bool)
    places = len(data) - width + 1
    for lo in range(0, max(places, 0), STRETCH):
        hi = min(lo + STRETCH, places)
        at = np.flatnonzero(ok[lo:hi])
        if not len(at):
            continue
        x = data[lo : hi + width - 1]
        total = np.zeros(len(x) + 1, H.U)
        np.cumsum(H.BYTE[x] * H.powers(H.BASE, len(x)), out=total[1:])
        grams = H.mix((total[GRAM:] - total[:-GRAM]) * H.powers(H.inverse(H.BASE), len(x))[: len(x) - GRAM + 1])
        # the low bits tell places apart: of equal hashes the leftmost is the smallest
        low = sliding_min((grams & ~PLACE) | np.arange(len(grams), dtype=H.U), width - GRAM + 1)
        trigger = (low[at] & PLACE).astype(np.int64)
        head = np.flatnonzero(np.r_[True, (trigger[1:] != trigger[:-1]) | (at[1:] != at[:-1] + 1)])
        for part, values in zip(out, (at[head] + lo, at[np.r_[head[1:], len(at)] - 1] + lo, trigger[head] + lo, H.mix(grams[trigger[head]])), strict=True):
            part.append(values)  # hashes that are minima are mixed again, so that they spread over all parts alike
    z = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else z.astype(t) for x, t in zip(out, (np.int64, np.int64, np.int64, H.U), strict=True))


def _kinds(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges."""
    out, upto, lo = np.empty(len(begin), H.U), np.cumsum(size), 0
    while lo < len(begin):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + STRETCH, "right")))
        n = size[lo:hi]
        heads = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(heads, n)
        out[lo:hi] = np.add.reduceat(H.BYTE[data[place + np.repeat(begin[lo:hi], n)]] * H.powers(H.BASE, int(n.max()))[place], heads)
        lo = hi
    return H.mix(out + size.astype(H.U) * H.WORD_BASE)


class _Bucket:
    """Parse of a bucket: phrases ``begin .. end`` (inclusive), their trigger's place and hash."""

    def __init__(self, docs: pa.Table, width: int) -> None:
        self.data, self.offsets = C.utf8(docs["text"])
        self.width = width
        ids = docs["doc_id"].combine_chunks() if isinstance(docs["doc_id"], pa.ChunkedArray) else docs["doc_id"]
        self.ids = ids.fill_null(int(LAST)).to_numpy(zero_copy_only=False).astype(np.int64)
        self.begin, self.end, self.trigger, self.gram_hash = parse(self.data, self.offsets, width)
        self.doc = np.searchsorted(self.offsets, self.begin, side="right") - 1
        self.grams, self.multi, self.place = C.distinct(self.gram_hash)

    def dictionary(self, repeated: np.ndarray) -> None:
        """Phrases with a repeated trigger: ``first``, in the order of their trigger's hash, is the earliest of each kind in this bucket, ``later`` the others."""
        some = np.flatnonzero(repeated[self.place]) if len(self.place) else np.zeros(0, np.int64)
        if not len(some):
            self.first = self.later = some
            return
        b = self.begin[some]
        whole = _kinds(self.data, b, self.end[some] + self.width - b)
        _, first = np.unique(H.mix(whole + (self.trigger[some] - b).astype(H.U)), return_index=True)  # the lowest index, so the earliest by document and place
        self.later = np.delete(some, first)
        first = some[np.sort(first)]
        self.first = first[np.argsort(self.gram_hash[first], kind="stable")]

    def rows(self, bucket: int, n_parts: int) -> pa.Table:
        runs = C.cut(self.gram_hash[self.first], n_parts)
        out = []
        for _, a, z in runs:
            k = self.first[a:z]
            b, t, e = self.begin[k], self.trigger[k], self.end[k]
            load = (self.ids[self.doc[k]], t - self.offsets[self.doc[k]], (t - b).astype(np.uint8), (t - e).astype(np.uint8), self.gram_hash[k], self.data[C.ragged(b, e - b + self.width)])
            raw = pickle.dumps(load, protocol=5)
            out.append(pa.compress(raw, codec="zstd", asbytes=True) + len(raw).to_bytes(8, "little"))
        return pa.table({"part": pa.array([p for p, _, _ in runs], pa.int32()), "bucket": pa.array([bucket] * len(runs), pa.int32()), "phrases": pa.array(out, pa.binary())})

    def removed(self, bits: list[tuple[int, bytes]], n_parts: int) -> np.ndarray:
        n, w = len(self.data), self.width
        step = np.zeros(n + 1, np.int32)

        def cover(at: np.ndarray) -> None:
            for lo in range(0, len(at), STRETCH):
                np.add.at(step, at[lo : lo + STRETCH], 1)
                np.add.at(step, at[lo : lo + STRETCH] + w, -1)

        # all places of a phrase that isn't the first of its kind
        np.add.at(step, self.begin[self.later], 1)
        np.add.at(step, self.end[self.later] + w, -1)
        got = dict(bits)
        for p, a, z in C.cut(self.gram_hash[self.first], n_parts):
            if p in got:
                k = self.first[a:z]
                at = C.ragged(self.begin[k], self.end[k] - self.begin[k] + 1)
                cover(at[np.unpackbits(np.frombuffer(got[p], np.uint8), count=len(at)).astype(bool)])
        return np.cumsum(step[:n], dtype=np.int32) > 0


def _padded(text: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The byte ranges as rows of ``width`` bytes, zero behind their ends."""
    out = np.zeros((len(begin), width), np.uint8)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(begin)), size), place] = text[place + np.repeat(begin, size)]
    return out


def _distinct_rows(rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, size) in the rows' order: an index of each, and the number of each input's."""
    text = np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()
    _, code = np.unique(text, return_inverse=True)
    _, index, number = np.unique(code * 256 + size, return_index=True, return_inverse=True)
    return index, number


def suffix_ranks(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a dictionary, as ranks: equal ones for equal suffixes, in the suffixes' order, a suffix before its extensions.

    words: rows of bytes, of which the first ``size`` count.  Returns the ranks of all suffixes, word after word, and where each word's begin.
    Ranks by 7 bytes are doubled (a suffix's rank and that of the suffix ``n`` bytes on) until they cover a whole word.
    """
    longest = int(size.max())
    first = np.cumsum(size) - size
    code = np.where(np.arange(words.shape[1]) < size[:, None], words.astype(np.int64) + 1, 0)
    code = np.concatenate([code, np.zeros((len(words), 7), np.int64)], 1)
    key = np.zeros((len(words), words.shape[1]), np.int64)
    for k in range(7):
        key = (key << 9) | code[:, k : k + words.shape[1]]
    inside = np.arange(words.shape[1]) < size[:, None]
    rank = np.unique(key[inside], return_inverse=True)[1] + 1
    left = np.repeat(first + size, size) - np.arange(len(rank))  # bytes from each suffix to its word's end
    reach = 7
    while reach < longest:
        after = np.where(left > reach, rank[np.minimum(np.arange(len(rank)) + reach, len(rank) - 1)], 0)
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1] + 1
        reach *= 2
    return rank, first


class _Lcp:
    """Longest common prefixes of sorted rows, for any two of them."""

    def __init__(self, rows: np.ndarray) -> None:
        differ = rows[1:] != rows[:-1]
        near = np.where(differ.any(1), differ.argmax(1), 255).astype(np.uint8) if len(rows) > 1 else np.zeros(0, np.uint8)
        self.levels = [near]  # level k: the least of 2**k neighbours' from each row on
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of rows a < b."""
        span = b - a
        level = np.frexp(span.astype(float))[1] - 1
        out = np.empty(len(a), np.uint8)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][a[at]], self.levels[k][b[at] - (1 << k)])
        return out


def again(text: np.ndarray, at: np.ndarray, before: np.ndarray, after: np.ndarray, width: int) -> np.ndarray:
    """For each string of each phrase, phrase after phrase, whether an equal string has an earlier place.

    Phrases in the order of their places; ``at``: where a phrase's bytes begin in ``text``; ``before``, ``after``: how far its first
    and its last place lie before the trigger.
    """
    n = before - after + 1
    word, rest = before + GRAM, width - GRAM - after
    words, parsed = _padded(text, at, word, width), _padded(text, at + word, np.maximum(rest, 0), width - GRAM + 1)
    w_index, w_no = _distinct_rows(words, word)
    p_index, p_no = _distinct_rows(parsed, rest)
    # of phrases that are equal to the end the first stands for all
    _, first, kind = np.unique(w_no * (len(p_index) + 1) + p_no, return_index=True, return_inverse=True)
    out = np.ones(int(n.sum()), bool)
    begins = np.cumsum(n) - n
    first = np.sort(first)
    where = C.ragged(begins[first], n[first])
    owner = np.repeat(first, n[first])
    place = where - begins[owner]
    ranks, heads = suffix_ranks(words[w_index], word[w_index])
    suffix = ranks[heads[w_no[owner]] + place]
    need = width - (word[owner] - place)  # bytes of the continuation that belong to the string
    order = np.lexsort((p_no[owner], suffix))  # corpus order
    s, p = suffix[order], p_no[owner][order]
    same = s[1:] == s[:-1]
    other = np.flatnonzero(same & (p[1:] != p[:-1]))
    if len(other):
        same[other] = _Lcp(parsed[p_index]).between(p[other], p[other + 1]) >= need[order][other]
    runs = np.flatnonzero(np.r_[True, ~same])
    least = np.minimum.reduceat(owner[order], runs)
    flags = np.empty(len(order), bool)
    flags[order] = owner[order] != np.repeat(least, np.diff(np.r_[runs, len(order)]))
    out[where] = flags
    return out


def sort_part(t: pa.Table, width: int) -> pa.Table:
    """One part: for each row of PHRASES one bit per string, set if an earlier string has the same ``width`` bytes."""
    loads = [pickle.loads(pa.decompress(b[:-8], int.from_bytes(b[-8:], "little"), codec="zstd")) for b in t["phrases"].to_pylist()]
    row = np.repeat(np.arange(len(loads)), [len(x[0]) for x in loads])
    ids, pos, before, after, gram = (np.concatenate([x[k] for x in loads]) for k in range(5))
    text = np.concatenate([x[5] for x in loads])
    before, after = before.astype(np.int64), after.astype(np.int64)
    n = before - after + 1
    length = n + width - 1
    at, flag_at = np.cumsum(length) - length, np.cumsum(n) - n
    flags = np.zeros(int(n.sum()), bool)
    order = np.lexsort((pos, ids, gram))  # by trigger, and by document and place
    cuts = np.flatnonzero(np.r_[True, gram[order][1:] != gram[order][:-1], True])
    upto = np.r_[0, np.cumsum(n[order])][cuts]
    lo = 0
    while lo < len(cuts) - 1:  # whole triggers at a time
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + SORTED, "right")) - 1)
        k = order[cuts[lo] : cuts[hi]]
        k = k[np.lexsort((pos[k], ids[k]))]
        flags[C.ragged(flag_at[k], n[k])] = again(text, at[k], before[k], after[k], width)
        lo = hi
    ends = np.cumsum(np.bincount(row, weights=n, minlength=len(loads)).astype(np.int64))
    masks = [flags[a:b] for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]
    keep = [i for i, m in enumerate(masks) if m.any()]
    bucket, part = t["bucket"].to_pylist(), t["part"].to_pylist()
    return pa.table(
        {
            "bucket": pa.array([bucket[i] for i in keep], pa.int32()),
            "part": pa.array([part[i] for i in keep], pa.int32()),
            "mask": pa.array([np.packbits(masks[i]).tobytes() for i in keep], pa.binary()),
        }
    )


def _result(docs: pa.Table, b: _Bucket, gone: np.ndarray) -> pa.Table:
    n, offsets = docs.num_rows, b.offsets
    head, tail = np.zeros(len(gone) + 1, bool), np.zeros(len(gone) + 1, bool)
    head[offsets], tail[offsets] = True, True
    starts = np.flatnonzero(gone & (head[: len(gone)] | ~np.r_[False, gone[:-1]])) if len(gone) else np.zeros(0, int)
    stops = np.flatnonzero(gone & (tail[1:] | ~np.r_[gone[1:], False])) if len(gone) else np.zeros(0, int)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    removed = np.array([np.count_nonzero(gone[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64)
    size = np.diff(offsets)
    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.r_[0, np.cumsum(size - removed)].astype(np.int64).tobytes()), pa.py_buffer(b.data[~gone].tobytes())])
    n_spans = np.bincount(doc, minlength=n)
    spans = pa.StructArray.from_arrays([pa.array((starts - offsets[doc]).astype(np.int32)), pa.array((stops + 1 - offsets[doc]).astype(np.int32))], ["begin", "end"])
    return pa.table(
        {
            "doc_id": docs["doc_id"],
            "n_bytes": pa.array(size),
            "n_removed": pa.array(removed.astype(np.int64)),
            "n_spans": pa.array(n_spans.astype(np.int64)),
            "kept": kept.cast(pa.binary()),
            "spans": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_spans)].astype(np.int32)), spans),
        }
    )


def remove_repeated_bytes(docs: DataFrame, width: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text without the bytes covered by a ``width``-byte string that also starts earlier in the corpus.

    Earlier: in a smaller doc_id, or in the same document at a smaller place.  Returns ``doc_id, n_bytes, n_removed,
    n_spans, kept, spans``: one row per input row; ``kept`` is binary, as a cut may fall inside a character.  Null and
    empty texts have no bytes.  Null doc_ids come last; among rows that share a doc_id the smaller text comes first.
    Other columns are not read; an empty table gives none.  A text, however long, is parsed as a whole: a Python worker
    needs about six times its bytes.  Strings are compared byte by byte in the sort; phrases of one bucket are found
    equal by a 64-bit hash.
    """
    if not GRAM < width <= GRAM + 150:
        raise ValueError(f"width must be from {GRAM + 1} to {GRAM + 150}")
    n, key_parts, parts = C.n_buckets(docs, text), C.n_parts(docs, text), C.n_parts(docs, text, PART_BYTES)
    docs_b = C.bucketed(docs, doc_id, text, n)

    def triggers(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        b = _Bucket(C.ordered(t), width)
        return C.key_rows(key[0].as_py(), b.grams, b.multi, key_parts)

    def parsed(t: pa.Table, masks: dict) -> _Bucket:
        b = _Bucket(t, width)
        b.dictionary(C.unmask(b.grams, masks.get("trigger", ()), key_parts))
        return b

    def phrases(bucket: int, t: pa.Table, masks: dict) -> pa.Table:
        return parsed(t, masks).rows(bucket, parts)

    def result(_: int, t: pa.Table, masks: dict) -> pa.Table:
        b = parsed(t, masks)
        return _result(t, b, b.removed(masks.get("suffix", []), parts))

    m1 = C.repeated_masks(docs_b.groupBy("bucket").applyInArrow(triggers, C.KEYS), key_parts).withColumn("kind", F.lit("trigger"))
    m1 = C.materialize(m1, "triggers")
    p = C.with_masks(docs_b, m1, phrases, PHRASES, n).repartition(parts, "part")
    m2 = p.groupBy("part").applyInArrow(lambda t: sort_part(t, width), C.MASKS).withColumn("kind", F.lit("suffix"))
    return C.with_masks(docs_b, m1.unionByName(m2), result, OUT, n)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = remove_repeated_bytes(C.table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


QUERIES = {"op10_suffix_array_dedup": op10_suffix_array_dedup}
ORACLE: dict[str, str] = {}
