"""The scanner over Arrow batches: a text is cut at blanks that no token spans, and every distinct piece is scanned once.

Tokens become numbers, so that what follows (classes, tags, sentences, triples, letters of rules) is looked up in arrays.
The tokens, places, classes and tags are those of ``scan``; its patterns are used as they are.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from runeflow.functions import scan

CLASSES = (*[name for name, _ in scan.CLASSES], "punctuation")
TAGS = ("word.low", "word.cap", "word.all", *[c for c in CLASSES if c not in scan.WORDS])
_CLASS, _TAG = {x: i for i, x in enumerate(CLASSES)}, {x: i for i, x in enumerate(TAGS)}
_ENDS = np.array([c in (*scan.ENDERS, "begin_paragraph") for c in CLASSES])
_IS_WORD = np.array([c in scan.WORDS for c in CLASSES])
_BLANK = " \t\r\n\f\xa0"
HELD, SLICE = 600_000, 4 << 20
"""Distinct pieces that a worker remembers; bytes of text that are scanned together (a longer text alone)."""


@cache
def _letters(capitals: bool) -> str:
    out, begin = [], None
    for c in range(sys.maxunicode + 2):
        ok = c <= sys.maxunicode and (x := chr(c)).isalpha() and (not capitals or unicodedata.category(x) == "Lu")
        if ok and begin is None:
            begin = c
        elif not ok and begin is not None:
            out.append(f"\\U{begin:08x}-\\U{c - 1:08x}")
            begin = None
    return "".join(out)


def python_pattern(pattern: str) -> str:
    """A pattern of ``scan`` or of a rule in Python's syntax, letters written out."""
    out, inside = [], False
    for m in re.finditer(r"\\p\{(Lu?)\}|\\x\{A0\}|\\.|.", pattern, re.DOTALL):
        x = m[0]
        if m[1]:
            x = _letters(m[1] == "Lu") if inside else f"[{_letters(m[1] == 'Lu')}]"
        elif x == r"\x{A0}":
            x = r"\xa0"
        elif x == r"\z":
            x = r"\Z"
        elif x == "." and not inside:
            x = r"[^\n\r\x85\u2028\u2029]"  # Java's line ends
        elif x in "[]":
            inside = x == "["
        out.append(x)
    return "".join(out)


@cache
def _scanner() -> re.Pattern:
    return re.compile(python_pattern(scan.QUICK_PATTERN))


@cache
def _forms() -> list[tuple[str, re.Pattern]]:
    return [(name, re.compile(python_pattern(form))) for name, form in scan.CLASSES]


def class_of(tok: str) -> str:
    """TK2, as scan.classify."""
    return "simple_word" if tok.isalpha() else next((name for name, form in _forms() if form.fullmatch(tok)), "punctuation")


def tag_of(tok: str, cls: str) -> str:
    """As scan.pseudo_tag."""
    if cls not in scan.WORDS:
        return cls
    if unicodedata.category(tok[0]) != "Lu":
        return "word.low"
    return "word.all" if all(unicodedata.category(x) == "Lu" for x in tok) else "word.cap"


class Tokens(NamedTuple):
    """Tokens of some texts, white space aside: row of the text, place among all matches, sentence, number of the token."""

    row: np.ndarray
    pos: np.ndarray
    sent: np.ndarray
    tok: np.ndarray

    def starts(self) -> np.ndarray:
        """Which tokens begin a sentence."""
        out = np.ones(len(self.row), bool)
        out[1:] = (self.row[1:] != self.row[:-1]) | (self.sent[1:] != self.sent[:-1])
        return out


class Scanner:
    """What one worker has seen: pieces and their tokens, tokens and their class and tag."""

    def __init__(self) -> None:
        self.age = 0
        self.forget()

    def forget(self) -> None:
        self.age += 1  # numbers of another age mean other tokens
        self.pieces: dict[str, int] = {}
        self.begin, self.parts = array("q", [0]), array("q")
        self.opens, self.closes = bytearray(), bytearray()
        self.numbers: dict[str, int] = {}
        self.toks: list[str] = []
        self._cls, self._tag = bytearray(), bytearray()

    @property
    def cls(self) -> np.ndarray:
        return np.array(self._cls)

    @property
    def tag(self) -> np.ndarray:
        return np.array(self._tag)

    def _token(self, tok: str) -> int:
        k = self.numbers.get(tok)
        if k is None:
            k = self.numbers[tok] = len(self.toks)
            self.toks.append(tok)
            cls = class_of(tok)
            self._cls.append(_CLASS[cls])
            self._tag.append(_TAG[tag_of(tok, cls)])
        return k

    def _piece(self, piece: str) -> int:
        k = self.pieces.get(piece)
        if k is None:
            k = self.pieces[piece] = len(self.opens)
            # a word, or one and a mark that can't make it longer, is told without the pattern
            toks = [piece] if piece.isalpha() else [piece[:-1], piece[-1]] if piece[-1:] in (".", ",", "!", "?", ";") and piece[:-1].isalpha() else _scanner().findall(piece)
            self.parts.extend([self._token(x) for x in toks])
            self.begin.append(len(self.parts))
            # only 10 %, § 3 and white space reach over a blank
            self.opens.append(bool(piece) and piece[0] not in _BLANK + "%")
            self.closes.append(bool(piece) and piece[-1] not in _BLANK + "§")
        return k

    def scan(self, texts: pa.Array) -> Tokens:
        """Tokens of a slice of texts."""
        if len(self.opens) > HELD:
            self.forget()
        lists = pc.split_pattern(texts.cast(pa.large_string()).fill_null(""), " ")
        ends = np.asarray(lists.offsets).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        own = np.fromiter(map(self.pieces.get, names, repeat(-1)), np.int64, len(names))
        for i in np.flatnonzero(own < 0).tolist():
            own[i] = self._piece(names[i])
        which = np.asarray(coded.indices)
        row = np.repeat(np.arange(len(texts)), np.diff(ends))
        piece = own[which]
        cut = np.ones(len(piece), bool)  # whether a piece begins here
        cut[1:] = (row[1:] != row[:-1]) | (np.array(self.closes, bool)[piece[:-1]] & np.array(self.opens, bool)[piece[1:]])
        at = np.flatnonzero(cut)
        size = np.diff(np.r_[at, len(piece)])
        piece, row, code = piece[at], row[at], which
        for k in np.flatnonzero(size > 1).tolist():
            piece[k] = self._piece(" ".join([names[i] for i in code[at[k] : at[k] + size[k]].tolist()]))
        begin, parts = np.array(self.begin), np.array(self.parts)
        n = begin[piece + 1] - begin[piece]
        before = np.cumsum(n) - n
        blanks = np.arange(len(piece))
        first = np.searchsorted(row, np.arange(len(texts)))  # of each text
        place = before + blanks - (before + blanks)[first[row]] if len(piece) else before
        step = np.arange(n.sum()) - np.repeat(before, n)
        tok = parts[np.repeat(begin[piece], n) + step] if len(parts) else np.zeros(0, np.int64)
        pos, row = np.repeat(place, n) + step, np.repeat(row, n)
        cls = self.cls[tok]
        keep = cls != _CLASS["space"]
        tok, pos, row, cls = tok[keep], pos[keep], row[keep], cls[keep]
        ends = _ENDS[cls].astype(np.int64)
        sent = np.cumsum(ends) - ends
        if len(row):
            sent -= sent[np.searchsorted(row, np.arange(len(texts)))[row]]
        return Tokens(row, pos, sent, tok)

    def is_word(self) -> np.ndarray:
        return _IS_WORD[self.cls]


def slices(batch: pa.RecordBatch | pa.Table, text: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch | pa.Table]:
    """A batch in slices whose texts have some bytes together."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + limit, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def strings(names: list[str] | tuple[str, ...], which: np.ndarray) -> pa.Array:
    """Names by number, as an array of strings."""
    return pa.array(names, pa.string()).take(pa.array(which))
