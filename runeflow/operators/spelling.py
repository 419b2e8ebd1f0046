"""Known words within two edits of unknown ones (RK7, LX25), by keys that hold for the pair and nothing else.

Two words are one edit apart if one letter deleted from either, or the same place left open in both, makes them equal; two
edits are any two of these.  A word's keys are itself and what is left of it after one or two of its letters are deleted
or left open; which keys of an unknown word are met by which of a known one (``JOINS``) makes every meeting a pair within
two edits.  So no pair has to be tried in vain, and where only the best are asked for, the first few known words of a key
are enough: keys and rows grow with the words, not with their pairs.

A key goes to the slot of its smallest three letters in a row (by hash), which many keys of a word share: words are sent to
slots, some 13 times each, and their keys are made again where they meet.

Known words of more than ``LONG`` letters would have too many keys: two edits leave one of three pieces of such a word whole, at
most two places away, and pairs with a piece in common are all tried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOT_BITS, HELD, ROUTED, GRAM, LONG = 12, 150_000, 2048, 3, 32
"""Slots; words that a task holds at once, one slot's at least; words that are sent to slots at once; letters that choose a slot; letters of the longest known word with such keys."""
#: Letters deleted and left open in an unknown word's key, the same for a known word's, edits.
JOINS = (
    ((1, 0), (0, 0), 1), ((0, 0), (1, 0), 1), ((0, 1), (0, 1), 1),
    ((2, 0), (0, 0), 2), ((0, 0), (2, 0), 2), ((1, 0), (1, 0), 2), ((0, 2), (0, 2), 2), ((1, 1), (0, 1), 2), ((0, 1), (1, 1), 2),
)
KINDS = ((0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1))
_M = 1 << 64
_BASE, _OPEN = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(_BASE, -1, _M))
_BACK2 = np.uint64(pow(_BASE, -2, _M))


@cache
def _power(i: int) -> np.uint64:
    return np.uint64(pow(_BASE, i, _M))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _changes(length: int, kind: tuple[int, int]) -> tuple[tuple[tuple[int, ...], tuple[int, ...]], ...]:
    """Places deleted and left open for each key of a kind; a key without a letter is none."""
    every, (gone, opened) = range(length), kind
    if length - gone - opened < 1:
        return ()
    if kind == (1, 1):
        return tuple(((p,), (q,)) for p in every for q in every if p != q)
    places = [()] if gone + opened == 0 else [(p,) for p in every] if gone + opened == 1 else [(p, q) for p in every for q in range(p + 1, length)]
    return tuple((x, ()) if gone else ((), x) for x in places)


@cache
def _grams(length: int, gone: tuple[int, ...], opened: tuple[int, ...]) -> tuple[tuple[int, ...], ...]:
    """Places of the ``GRAM`` letters in a row that a key has: (first, last) of runs that stand so in the word, then those that deletions have made."""
    left = [i for i in range(length) if i not in gone]
    every = [tuple(left[i : i + GRAM]) for i in range(len(left) - GRAM + 1) if not set(left[i : i + GRAM]) & set(opened)]
    runs, made = [], []
    for x in every:
        if x[-1] - x[0] >= GRAM:
            made.append(x)
        elif runs and runs[-1][1] == x[0] - 1:
            runs[-1][1] = x[0]
        else:
            runs.append([x[0], x[0]])
    return (*map(tuple, runs), *made)


class _Words:
    """Words of one length as columns of letters; ``at`` is where they stand among all."""

    def __init__(self, at: np.ndarray, letters: np.ndarray) -> None:
        self.at, self.length = at, letters.shape[1]
        self.value = [_mixed(x) for x in np.ascontiguousarray(letters.T).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)]
        self.before = [np.zeros(len(at), np.uint64)]
        for i, v in enumerate(self.value):
            self.before.append(self.before[-1] + v * _power(i))
        self.whole = self.before[-1]
        self._kept: dict[tuple[int, ...], np.ndarray] = {}

    def _least(self, x: tuple[int, ...]) -> np.ndarray:
        """Number of a group of letters, or the smallest of those that begin at x[0] to x[1]."""
        out = self._kept.get(x)
        if out is None:
            if len(x) == 2 and x[0] < x[1]:
                out = np.minimum(self._least((x[0], x[1] - 1)), self._least((x[1], x[1])))
            else:
                places = range(x[0], x[0] + GRAM) if len(x) == 2 else x
                out = (_mixed(sum(self.value[p] * _power(i) for i, p in enumerate(places))) >> np.uint64(32)).astype(np.uint32)
            self._kept[x] = out
        return out

    def key(self, gone: tuple[int, ...], opened: tuple[int, ...]) -> np.ndarray:
        b = self.before
        if not gone:
            h = self.whole
        elif len(gone) == 1:
            h = b[gone[0]] + (self.whole - b[gone[0] + 1]) * _BACK
        else:
            p, q = gone
            h = b[p] + (b[q] - b[p + 1]) * _BACK + (self.whole - b[q + 1]) * _BACK2
        for q in opened:
            h = h + (_OPEN - self.value[q]) * _power(q - sum(p < q for p in gone))
        return h

    def slot(self, gone: tuple[int, ...], opened: tuple[int, ...]) -> np.ndarray:
        """By the smallest group of letters; a key without one goes its own way."""
        grams = _grams(self.length, gone, opened)
        if not grams:
            return (_mixed(self.key(gone, opened)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        least = self._least(grams[0])
        for x in grams[1:]:
            least = np.minimum(least, self._least(x))
        return ((least * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)).astype(np.int64)


class _Side:
    """Words of one side by length, their columns made when asked for; ``whole`` is a number for each word."""

    def __init__(self, words: pa.Array) -> None:
        length = np.asarray(pc.utf8_length(words)).astype(np.int64)
        letters = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
        begin = np.cumsum(length) - length
        self.whole = np.zeros(len(words), np.uint64)
        self._at = {n: np.flatnonzero(length == n) for n in np.unique(length).tolist() if 0 < n <= LONG + 2}
        self._letters = lambda n: letters[begin[self._at[n]][:, None] + np.arange(n)]
        self._made: dict[int, _Words] = {}
        self.lengths = set(self._at)

    def words(self, n: int) -> _Words | None:
        if n in self._at and n not in self._made:
            w = self._made[n] = _Words(self._at[n], self._letters(n))
            self.whole[w.at] = w.whole + np.uint64(n)
        return self._made.get(n)

    def drop(self, n: int) -> None:
        self._made.pop(n, None)


def _pieces(word: str, known: bool) -> set[tuple[int, int, str]]:
    """Length of the known word, which third of it, its letters."""
    out = set()
    for n in [len(word)] if known else range(max(len(word) - 2, LONG + 1), len(word) + 3):
        for i in range(3 if n > LONG else 0):
            begin, end = n * i // 3, n * (i + 1) // 3
            out |= {(n, i, word[begin + x : end + x]) for x in ([0] if known else range(-2, 3)) if 0 <= begin + x and end + x <= len(word)}
    return out


def _piece_slot(piece: tuple[int, int, str]) -> int:
    return crc32("{} {} {}".format(*piece).encode()) >> (32 - SLOT_BITS)


def _long_pairs(unknown: pa.Array, known: pa.Array, mine: np.ndarray) -> tuple[list[int], list[int]]:
    """Words that have a piece in common; they may be more than two edits apart."""
    at: dict[tuple[int, int, str], list[int]] = {}
    for k in np.flatnonzero(np.asarray(pc.utf8_length(known)) > LONG).tolist():
        for x in _pieces(known[k].as_py(), True):
            at.setdefault(x, []).append(k)
    out = set()
    for u in np.flatnonzero(np.asarray(pc.utf8_length(unknown)) > LONG - 2).tolist() if at else ():
        out |= {(u, k) for x in _pieces(unknown[u].as_py(), False) if x in at and mine[_piece_slot(x)] for k in at[x]}
    return [u for u, _ in out], [k for _, k in out]


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word to the slots of its keys."""

    def sent(t: pa.Table) -> Iterator[pa.RecordBatch]:
        words = t.column("word").combine_chunks()
        length = np.asarray(pc.utf8_length(words))
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            for lo in range(0, len(at), ROUTED):
                here = at[lo : lo + ROUTED]
                held = np.zeros((len(here), 1 << SLOT_BITS), bool)
                if 0 < n <= LONG + 2:
                    w = _Side(words.take(pa.array(here))).words(n)
                    for change in [x for kind in KINDS for x in _changes(n, kind)]:
                        held[w.at, w.slot(*change)] = True
                if n > LONG - 2:
                    for i, (word, known) in enumerate(zip(words.take(pa.array(here)).to_pylist(), t.column("known").take(pa.array(here)).to_pylist(), strict=True)):
                        held[i, [_piece_slot(x) for x in _pieces(word, known)]] = True
                row, slot = np.divmod(np.flatnonzero(held), 1 << SLOT_BITS)
                for b in t.take(pa.array(here[row])).combine_chunks().to_batches():
                    yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), *b.columns], ["slot", *b.schema.names])

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= HELD:
            yield from sent(pa.Table.from_batches(held))
            held, size = [], 0
    if held:
        yield from sent(pa.Table.from_batches(held))


class _Keys(NamedTuple):
    """Keys of one kind and length and the words they are of; for known words in order, with where each distinct key begins."""

    key: np.ndarray
    word: np.ndarray
    begin: np.ndarray


def _keys(words: _Side, kind: tuple[int, int], length: int, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    w = words.words(length + kind[0])
    for change in _changes(w.length, kind) if w else ():
        here = mine[w.slot(*change)]
        keys.append(w.key(*change)[here])
        at.append(w.at[here])
    return np.concatenate(keys), np.concatenate(at)


def _posted(key: np.ndarray, word: np.ndarray, most: int | None) -> _Keys:
    """Known words by key, the first ``most`` of each (words are numbered best first)."""
    order = np.argsort(key)
    key, word = key[order], word[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(first)
    size = np.diff(np.r_[begin, len(key)])
    if most is not None and len(size) and size.max() > most:
        large = np.repeat(size > most, size)
        k, w = key[large], word[large]
        order = np.lexsort((w, k))
        k, w = k[order], w[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (w[1:] != w[:-1])
        k, w = k[new], w[new]
        start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        place = np.arange(len(k)) - np.repeat(start, np.diff(np.r_[start, len(k)]))
        return _posted(np.r_[key[~large], k[place < most]], np.r_[word[~large], w[place < most]], None)
    return _Keys(key[begin], word, np.r_[begin, len(key)])


def _met(key: np.ndarray, word: np.ndarray, known: _Keys) -> tuple[np.ndarray, np.ndarray]:
    """Words of both sides that have a key in common."""
    if not len(key) or not len(known.key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(key)
    key, word = key[order], word[order]
    i = np.minimum(np.searchsorted(known.key, key), len(known.key) - 1)
    hit = known.key[i] == key
    i, word = i[hit], word[hit]
    n = known.begin[i + 1] - known.begin[i]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(word, n), known.word[np.repeat(known.begin[i], n) + step]


def _pairs(words: pa.Table, mine: np.ndarray, best: int | None) -> pa.RecordBatch:
    """(word, candidate, freq): pairs within two edits that have a key in these slots, the first ``best`` of each unknown word; of long words all that may be within two."""
    is_known = words.column("known")
    unknown, known = (words.filter(x).select(["word", "freq"]).combine_chunks() for x in (pc.invert(is_known), is_known))
    known = known.take(pc.sort_indices(known, [("freq", "descending"), ("word", "ascending")]))
    names, candidates = unknown.column("word").combine_chunks(), known.column("word").combine_chunks()
    us, ks = _Side(names), _Side(candidates)
    found = [[], [], []]
    for n in range(1, max(us.lengths | ks.lengths, default=0) + 1):
        if us.lengths.isdisjoint(range(n, n + 3)) or ks.lengths.isdisjoint(range(n, n + 3)):
            continue
        asked = {kind: _keys(us, kind, n, mine) for kind in KINDS}
        posted = {kind: _posted(*_keys(ks, kind, n, mine), None if best is None else best + 1) for kind in KINDS}
        for kind, against, edits in JOINS:
            u, k = _met(*asked[kind], posted[against])
            new = us.whole[u] != ks.whole[k]
            for x, y in zip(found, (u[new], k[new], np.full(new.sum(), edits)), strict=True):
                x.append(y)
        us.drop(n), ks.drop(n)
    u, k, edits = (np.concatenate([np.zeros(0, np.int64), *x]) for x in found)
    order = np.lexsort((edits, k, u))
    u, k, edits = u[order], k[order], edits[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (k[1:] != k[:-1])
    u, k, edits = u[new], k[new], edits[new]
    if best is not None and len(u):
        order = np.lexsort((k, edits, u))
        u, k = u[order], k[order]
        start = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        few = np.arange(len(u)) - np.repeat(start, np.diff(np.r_[start, len(u)])) < best
        u, k = u[few], k[few]
    more = _long_pairs(names, candidates, mine)
    u, k = np.r_[u, np.array(more[0], np.int64)], np.r_[k, np.array(more[1], np.int64)]
    return pa.RecordBatch.from_arrays([names.take(pa.array(u)), candidates.take(pa.array(k)), known.column("freq").combine_chunks().take(pa.array(k))], ["word", "candidate", "freq"])


def spelling_pairs(words: DataFrame, best: int | None = None) -> DataFrame:
    """(word, freq, known) -> (word, candidate, edits, freq): for each unknown word all known ones one or two edits away, two words with no letter in common aside.

    With ``best`` at least the first so many of each by edits, freq (highest first) and candidate; others may be missing.
    A known word of an unknown one's fewer than ``best`` neighbours at one edit can push none at two edits out of a key's
    first ``best`` + 1, nor can the word itself, so these are enough.
    """

    def run(batches):
        held, size, last = [], 0, None

        def met():
            t = pa.Table.from_batches(held)
            mine = np.zeros(1 << SLOT_BITS, bool)
            mine[np.asarray(t.column("slot"))] = True
            t = t.group_by(["word", "known"], use_threads=False).aggregate([("freq", "max")]).rename_columns({"freq_max": "freq"})
            return _pairs(t, mine, best)

        for b in batches:
            slot = np.asarray(b.column("slot"))
            lo = 0
            for hi in [*(np.flatnonzero(np.diff(slot)) + 1).tolist(), len(slot)]:  # rows of one slot
                if lo < hi:
                    if size >= HELD and slot[lo] != last:
                        yield met()
                        held, size = [], 0
                    held.append(b.slice(lo, hi - lo))
                    size, last = size + hi - lo, slot[lo]
                lo = hi
        if held:
            yield met()

    w = words.select("word", F.col("freq").cast("long").alias("freq"), "known").where("word is not null")
    sent = w.mapInArrow(_sent, "slot int, word string, freq long, known boolean")
    both = sent.repartition("slot").sortWithinPartitions("slot").mapInArrow(run, "word string, candidate string, freq long")
    both = both.repartition("word").withColumn("edits", F.levenshtein("word", "candidate", 2)).where(F.col("edits").between(1, 2))
    return both.groupBy("word", "candidate").agg(F.first("edits").alias("edits"), F.first("freq").alias("freq"))
