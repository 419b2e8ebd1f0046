"""The rule language: patterns over tagged tokens, jumps, marks, corrections (RU, ER).

A rule is a sequence of elements; an element tests a token (an SQL condition on ``norm``, ``tag`` and ``cls``) and says how
often it may stand: once, ``?``, ``*`` or ``+``.  A rule is compiled to two built-in steps.  Each token becomes one letter
that tells which of the rule's tests it passes; the pattern becomes a regular expression over these letters.  So all
quantifiers run inside the engine's generated code, and a sentence is one row throughout.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runeflow.config import RULES, RuleConfig
from runeflow.functions import pieces, scan

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
"""One for each set of at most six tests."""


class Element(NamedTuple):
    test: str
    times: str = ""  # "", "?", "*" or "+"


class Edit(NamedTuple):
    """A correction: ``op`` on the match's token ``at`` (from 0, contexts not counted)."""

    op: str  # delete, replace, insert, nothing
    at: int = 0
    word: str = ""


class Rule(NamedTuple):
    no: int
    name: str
    category: str
    elements: tuple[Element, ...]
    left: int = 0  # leading elements that are context
    right: int = 0  # trailing ones
    accepting: bool = False
    jump: int | None = None  # rules below this number are skipped at the matched tokens
    edits: tuple[Edit, ...] = ()
    info: str = ""


def diagnose(rules: list[Rule], categories: set[str]) -> list[str]:
    """RU5: what is wrong with a rule set."""
    out = []
    for r in rules:
        if r.jump is not None and r.jump <= r.no:
            out.append(f"{r.name}: jumps backwards")
        if not r.accepting and not r.category:
            out.append(f"{r.name}: has no category")
        elif r.category and r.category not in categories:
            out.append(f"{r.name}: category {r.category} is not declared")
        if r.accepting and r.info:
            out.append(f"{r.name}: an accepting rule reports nothing")
        if min_length(r) == 0:
            out.append(f"{r.name}: matches nothing at all")
        if len({e.test for e in r.elements}) > 6:
            out.append(f"{r.name}: has more than six tests")
    return out + [f"{n}: defined twice" for n in sorted({r.name for r in rules if sum(x.name == r.name for x in rules) > 1})]


def min_length(r: Rule) -> int:
    """RU6: tokens that a match has at least."""
    return sum(e.times in ("", "+") for e in r.elements)


def tests(r: Rule) -> list[str]:
    return list(dict.fromkeys(e.test for e in r.elements))


def pattern(r: Rule) -> str:
    """The regular expression over letters: groups for left context, match, right context."""
    ts = tests(r)
    if len(ts) > 6:
        raise ValueError(f"{r.name}: more than six tests")

    def piece(e: Element) -> str:
        k = ts.index(e.test)
        return "[" + "".join(LETTERS[m] for m in range(1 << len(ts)) if m >> k & 1).replace("-", r"\-") + "]" + e.times

    parts = [piece(e) for e in r.elements]
    end = len(parts) - r.right
    return f"^({''.join(parts[: r.left])})({''.join(parts[r.left : end])})({''.join(parts[end:])})"


def letter(r: Rule) -> str:
    """SQL for the number of a token's letter."""
    return " + ".join(f"CASE WHEN {t} THEN {1 << k} ELSE 0 END" for k, t in enumerate(tests(r)))


def first_letters(r: Rule) -> list[str]:
    """Letters that a match of the pattern can begin with."""
    ts, out = tests(r), set()
    for e in r.elements:
        k = ts.index(e.test)
        out |= {LETTERS[m] for m in range(1 << len(ts)) if m >> k & 1}
        if e.times in ("", "+"):
            break
    return sorted(out)


def _found(r: Rule, code: Column) -> Column:
    """(start, n) of every match of one rule in a string of letters; only fitting first letters are tried."""

    def at(k: Column) -> Column:
        rest = F.substring(code, k + 1, F.length(code))
        return F.struct((k + F.length(F.regexp_extract(rest, pattern(r), 1)) if r.left else k).alias("start"), F.length(F.regexp_extract(rest, pattern(r), 2)).alias("n"))

    tried = F.filter(F.sequence(F.lit(0), F.length(code) - 1), lambda k: F.substring(code, k + 1, F.lit(1)).isin(first_letters(r)))
    return F.filter(F.transform(tried, at), lambda m: m["n"] > 0)


def _starts(r: Rule, code: str) -> Column:
    """All (rule_no, rule, start, n) of one rule in a sentence's letters, a string column."""
    found = F.transform(_found(r, F.col(code)), lambda m: F.struct(F.lit(r.no).alias("rule_no"), F.lit(r.name).alias("rule"), m["start"].alias("start"), m["n"].alias("n")))
    return F.when(F.col(code).rlike(pattern(r)[1:]), found).otherwise(F.array())  # one pass tells whether it is anywhere


def n_matches(r: Rule, code: Column) -> Column:
    """How many matches one rule has in a sentence's letters.

    Matches of a rule whose left context has one length, and that matches one token at least, are as many as the places at
    which its expression fits: one pass of the expression as a look-ahead.
    """
    left, middle = r.elements[: r.left], r.elements[r.left : len(r.elements) - r.right]
    if all(not e.times for e in left) and any(e.times in ("", "+") for e in middle):
        return F.regexp_count(code, F.lit(f"(?={pattern(r)[1:]})"))
    return F.size(F.array_distinct(_found(r, code)))


def matches(toks: DataFrame, rules: list[Rule]) -> DataFrame:
    """RU7, RU8, RU11: (doc_id, sent_id, rule_no, rule, start, n): every start of every rule; contexts are not part of the span.

    toks: (doc_id, sent_id, pos, norm, tag, cls).  ``start`` counts the sentence's tokens from 0.
    """
    codes = [F.expr(f"substring('{LETTERS}', 1 + {letter(r)}, 1)").alias(f"c{i}") for i, r in enumerate(rules)]
    s = toks.select("doc_id", "sent_id", "pos", *codes).groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", *[f"c{i}" for i in range(len(rules))]))).alias("ts"))
    strings = [F.array_join(F.col("ts")[f"c{i}"], "").alias(f"c{i}") for i in range(len(rules))]
    s = s.select("doc_id", "sent_id", *strings)
    found = [_starts(r, f"c{i}") for i, r in enumerate(rules)]
    # outer: else the optimizer infers a filter on what is exploded, and works out a sentence's letters for every place of it again
    m = s.select("doc_id", "sent_id", F.explode_outer(F.concat(*found)).alias("m")).where("m is not null")
    return m.select("doc_id", "sent_id", "m.*").distinct()


def on_field(test: str, of: str) -> str:
    """A test with ``norm``, ``tag`` and ``cls`` read from the struct ``of``; what is quoted stays."""
    parts = re.split(r"('(?:[^']|'')*')", test)
    return "".join(p if i % 2 else re.sub(r"\b(norm|tag|cls)\b", rf"{of}.\1", p) for i, p in enumerate(parts))


def code_of(ts: str, r: Rule) -> str:
    """SQL for the letters of an array of tokens (norm, tag, cls): a sentence is matched inside its row."""
    return f"array_join(transform({ts}, t -> substring('{LETTERS}', 1 + {on_field(letter(r), 't')}, 1)), '')"


def sentences(toks: DataFrame) -> DataFrame:
    """(doc_id, sent_id, ts): one row for each sentence, its tokens (norm, tag, cls) in order."""
    s = toks.groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "norm", "tag", "cls"))).alias("ts"))
    return s.select("doc_id", "sent_id", F.transform("ts", lambda x: F.struct(x["norm"].alias("norm"), x["tag"].alias("tag"), x["cls"].alias("cls"))).alias("ts"))


def tagged(s: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Rows of scan.sentence_rows with ``ts``, their tokens' norm, tag and cls: all three, or those that the rules ask for."""
    asked = " ".join(re.sub(r"'(?:[^']|'')*'", "", letter(r)) for r in rules) if rules else "norm tag cls"
    fields = {"norm": F.lower, "tag": scan.tag_of, "cls": scan.classify}
    return s.withColumn("ts", F.transform("toks", lambda x: F.struct(*[f(x).alias(n) for n, f in fields.items() if n == "norm" or re.search(rf"\b{n}\b", asked)])))


def row_matches(s: DataFrame, rules: list[Rule], jumps: bool = False) -> DataFrame:
    """RU7, RU8, RU11, with ``jumps`` RU12: rows of scan.sentence_rows with ``found``, all their matches; nothing leaves its row."""
    s = with_matches(s if "ts" in s.columns else tagged(s, rules), rules)
    for r in sorted((r for r in rules if jumps and r.jump is not None), key=lambda r: r.no):
        s = s.withColumn("found", _jumped(r))
    return s


def _jumped(r: Rule) -> Column:
    """RU12: what is found without the matches that start inside one of a rule which jumps past theirs."""

    def inside(m: Column) -> Column:
        return F.exists("found", lambda j: (j["rule_no"] == r.no) & (j["start"] <= m["start"]) & (m["start"] < j["start"] + j["n"]))

    return F.filter("found", lambda m: ~((m["rule_no"] > r.no) & (m["rule_no"] < r.jump) & inside(m)))


_SQL = re.compile(r"('(?:[^'\\]|''|\\.)*')|(<>|<=|>=|[=<>(),])|(\d+)|(\w+)|\s+")
_KNOWN = {"=": "==", "<>": "!=", "AND": "and", "OR": "or", "NOT": "not", "IN": "in", "norm": "norm", "tag": "tag", "cls": "cls", "length": "len", "left": "left", "right": "right", "regexp_like": "regexp_like"}
_CALLS = {"len": len, "left": lambda x, n: x[:n], "right": lambda x, n: x[-n:] if n else "", "regexp_like": lambda x, p: bool(_regexp(p).search(x))}


@cache
def _regexp(p: str) -> re.Pattern:
    return re.compile(pieces.python_pattern(p))


def predicate(tests: list[str]) -> Callable[[str, str, str], tuple[bool, ...]] | None:
    """Tests on norm, tag and cls as one function in Python, so that a token is tested once a worker; None if one holds more than comparisons, lists and the functions of rule files."""
    out = []
    for test in tests:
        words, at = [], 0
        while at < len(test):
            m = _SQL.match(test, at)
            if not m or m[4] and m[4] not in _KNOWN:
                return None
            if m[1]:
                words.append(repr(re.sub(r"\\(.)", r"\1", m[1][1:-1].replace("''", "'"))))
            elif m[0].strip():
                words.append(_KNOWN.get(m[0], m[0]))
            at = m.end()
        for k, w in enumerate(words):  # a list of one value is a tuple, too
            if w == "in":
                words[words.index(")", k)] = ",)"
        out.append(f"({' '.join(words)})")
    try:
        return eval(f"lambda norm, tag, cls: ({', '.join(out)},)", dict(_CALLS))  # noqa: S307: nothing but what is in _KNOWN
    except SyntaxError:
        return None


def scanned_matches(docs: DataFrame, rules: list[Rule], jumps: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As each_match over row_matches, matched while texts are scanned: (doc_id, sent_id, rule_no, rule, start, n, size), ``size`` the sentence's tokens.

    A token's letters are looked up by its number.  All sentences of some texts are one string of letters, with a letter
    that no test gives between them, so an expression goes over them once and no match leaves its sentence.
    """
    asked = list(dict.fromkeys(t for r in rules for t in tests(r)))
    if predicate(asked) is None:
        return each_match(row_matches(scan.sentence_rows(docs, doc_id, text), rules, jumps).withColumn("size", F.size("toks")), "size").select("doc_id", "sent_id", "rule_no", "rule", "start", "n", "size")

    def run(batches):
        s, test, known, age = pieces.Scanner(), predicate(asked), [], 0
        letters, forms = np.frombuffer(LETTERS.encode(), np.uint8), [re.compile(f"(?={pattern(r)[1:]})".encode()) for r in rules]
        for whole in batches:
            for b in pieces.slices(whole, text):
                t = s.scan(b.column(text))
                if not len(t.tok):
                    continue
                if age != s.age:
                    known, age = [], s.age
                for tok, k, c in zip(s.toks[len(known) :], s.tag[len(known) :].tolist(), s.cls[len(known) :].tolist(), strict=True):
                    known.append(test(tok.lower(), pieces.TAGS[k], pieces.CLASSES[c]))
                used, at = np.unique(t.tok, return_inverse=True)
                passed = np.array([known[k] for k in used.tolist()], np.uint8)
                first = t.starts()
                no = np.cumsum(first) - 1  # of the sentence
                begin = np.flatnonzero(first)
                size = np.diff(np.r_[begin, len(first)])
                place = np.arange(len(first)) + no + 1  # in the string of letters
                found = []
                for i, r in enumerate(rules):
                    code = np.full(len(first) + len(begin) + 1, 10, np.uint8)
                    code[place] = letters[passed[:, [asked.index(x) for x in tests(r)]] @ (1 << np.arange(len(tests(r))))][at]
                    got = np.array([(m.start(2), m.end(2)) for m in forms[i].finditer(code.tobytes()) if m.end(2) > m.start(2)], np.int64).reshape(-1, 2)
                    got = np.unique(got, axis=0) if r.left else got
                    found.append(np.c_[np.full(len(got), i), np.searchsorted(place, got[:, 0]), got[:, 1] - got[:, 0]])
                x = np.concatenate(found)
                for i, r in sorted(((i, r) for i, r in enumerate(rules) if jumps and r.jump is not None), key=lambda y: y[1].no):
                    own = x[x[:, 0] == i]
                    change = np.bincount(own[:, 1], minlength=len(first) + 1) - np.bincount(own[:, 1] + own[:, 2], minlength=len(first) + 1)
                    over = np.array([r.no < q.no < r.jump for q in rules])
                    x = x[~(over[x[:, 0]] & (np.cumsum(change)[x[:, 1]] > 0))]
                which, start, n = x.T
                ints = [pa.array(y.astype(np.int32)) for y in (np.array([r.no for r in rules])[which], start - begin[no[start]], n, size[no[start]])]
                columns = [b.column(doc_id).take(pa.array(t.row[start])), pa.array(t.sent[start]), ints[0], pieces.strings([r.name for r in rules], which), *ints[1:]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sent_id", "rule_no", "rule", "start", "n", "size"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, sent_id long, rule_no int, rule string, start int, n int, size int")


def each_match(s: DataFrame, *more: str) -> DataFrame:
    """(doc_id, sent_id, .., rule_no, rule, start, n): one row for each match that rows hold."""
    # outer: else the optimizer infers a filter on what is exploded, and works it out twice
    m = s.select("doc_id", "sent_id", *more, F.explode_outer("found").alias("m")).where("m is not null")
    return m.select("doc_id", "sent_id", *more, "m.*")


def with_matches(s: DataFrame, rules: list[Rule], ts: str = "ts", name: str = "found") -> DataFrame:
    """Adds all matches of the rules, an array of (rule_no, rule, start, n), to rows that hold a sentence."""
    codes = [f"_c{r.no}" for r in rules]
    s = s.select("*", *[F.expr(code_of(ts, r)).alias(c) for r, c in zip(rules, codes, strict=True)])
    return s.withColumn(name, F.array_distinct(F.concat(*[_starts(r, c) for r, c in zip(rules, codes, strict=True)]))).drop(*codes)


def count_of(rules: list[Rule], ts: str) -> Column:
    """Matches of all rules together in an array of tokens."""
    return sum((n_matches(r, F.expr(code_of(ts, r))) for r in rules), F.lit(0))


def corrections(s: DataFrame, rules: list[Rule], retag: Callable[[Column], Column], c: RuleConfig = RULES) -> DataFrame:
    """ER3 to ER5, ER8 to ER10 in one go: suggestions that leave fewer matches, of all rules, than there were.

    Returns (doc_id, sent_id, rule_no, rule, start, n, edit_no, words, n_before, n_after, place).  Each sentence is one row
    throughout: matched, edited, tagged again (``retag``: word -> struct of norm, tag and cls) and matched again by all
    rules; nothing is joined.  s: tokens, or rows with ``ts`` as ``tagged`` gives them.
    """
    # of a rule that offers to change nothing every match is a false alarm
    useful = [r for r in rules if r.edits and not (c.same_as_original_is_false_alarm and any(e.op == "nothing" for e in r.edits))]
    s = (s if "ts" in s.columns else sentences(s)).select("doc_id", "sent_id", "ts").where(count_of(useful, "ts") > 0)  # sentences that there is something to correct in
    s = with_matches(s.withColumn("n_before", count_of(rules, "ts")), useful)
    s = s.select("doc_id", "sent_id", "ts", "n_before", F.explode_outer("found").alias("m")).where("m is not null").select("doc_id", "sent_id", "ts", "n_before", "m.*")
    edits = F.when(F.lit(False), F.lit(None))
    for r in useful:
        own = F.array(*[F.struct(F.lit(i).alias("edit_no"), _edited(F.col("ts"), F.col("start"), e, retag(F.lit(e.word))).alias("new")) for i, e in enumerate(r.edits)])
        edits = edits.when(F.col("rule_no") == r.no, own)
    s = s.withColumn("es", edits).where("es is not null")
    if c.same_as_original_is_false_alarm:
        s = s.where(~F.exists("es", lambda e: e["new"] == F.col("ts")))
    e = s.select("*", F.explode("es").alias("e"))
    repeated = F.exists("es", lambda x: (x["edit_no"] > F.col("e.edit_no")) & (x["new"] == F.col("e.new")))
    ok = F.col("e.new") != F.col("ts")
    e = e.where(ok if c.accept_repeated_suggestions else ok & ~repeated)
    e = e.select("doc_id", "sent_id", "rule_no", "rule", "start", "n", "n_before", F.col("e.edit_no").alias("edit_no"), F.col("e.new").alias("new"))
    e = e.withColumn("n_after", count_of(rules, "new"))
    e = e.where(F.lit(c.accept_not_improving) | (F.col("n_after") < F.col("n_before")))
    w = Window.partitionBy("doc_id", "sent_id", "rule_no", "start").orderBy(F.desc("edit_no"))
    e = e.withColumn("place", F.row_number().over(w)).where(F.col("place") <= c.max_suggestions)
    return e.select("doc_id", "sent_id", "rule_no", "rule", "start", "n", "edit_no", F.transform("new", lambda x: x["norm"]).alias("words"), "n_before", "n_after", "place")


def suppressed(found: DataFrame, rules: list[Rule]) -> DataFrame:
    """RU12: without matches that start inside a match of a rule which jumps past their rule.

    Jumps depend on order: rules that jump are taken by number, and one that is itself suppressed doesn't jump.
    """
    for r in sorted((r for r in rules if r.jump is not None), key=lambda r: r.no):
        jumps = found.where(F.col("rule_no") == r.no).select("doc_id", "sent_id", F.explode(F.sequence("start", F.expr("start + n - 1"))).alias("start")).distinct()
        hit = jumps.withColumn("skip", F.lit(True))
        found = found.join(hit, ["doc_id", "sent_id", "start"], "left").where(F.col("skip").isNull() | ~((F.col("rule_no") > r.no) & (F.col("rule_no") < r.jump))).drop("skip")
    return found


def reported(found: DataFrame, rules: list[Rule]) -> DataFrame:
    """RU13, ER13: matches of rules that report: not accepting ones, nor those named ``..recog``."""
    names = [r.no for r in rules if not r.accepting and not r.name.endswith("recog")]
    return found.where(F.col("rule_no").isin(names))


def sequences(first: DataFrame, second: DataFrame) -> DataFrame:
    """RU10: a help rule's match that directly follows another: joined where one ends and the other starts."""
    b = second.select("doc_id", "sent_id", F.col("start").alias("next"), F.col("n").alias("n2"))
    a = first.withColumn("next", F.col("start") + F.col("n"))
    return a.join(b, ["doc_id", "sent_id", "next"]).select("doc_id", "sent_id", "start", (F.col("n") + F.col("n2")).alias("n"))


def sequences_in(s: DataFrame, first: int, second: int) -> DataFrame:
    """As sequences, of two rules' matches in rows of row_matches: looked up inside the row."""
    a = each_match(s.withColumn("all", F.filter("found", lambda m: m["rule_no"] == second)), "all").where(F.col("rule_no") == first)
    b = F.filter("all", lambda m: m["start"] == F.col("start") + F.col("n"))
    return a.select("doc_id", "sent_id", "start", "n", F.explode_outer(b).alias("b")).where("b is not null").select("doc_id", "sent_id", "start", (F.col("n") + F.col("b.n")).alias("n"))


def _edited(words: Column, start: Column, e: Edit, word: Column | None = None) -> Column:
    word = F.lit(e.word) if word is None else word
    k = start + e.at
    head, tail = F.slice(words, F.lit(1), k), F.slice(words, k + 2, F.greatest(F.size(words) - k - 1, F.lit(0)))
    if e.op == "delete":
        return F.concat(head, tail)
    if e.op == "replace":
        return F.concat(head, F.array(word), tail)
    if e.op == "insert":
        return F.concat(head, F.array(word), F.slice(words, k + 1, F.size(words) - k))
    return words


def candidates(found: DataFrame, sentences: DataFrame, rules: list[Rule], c: RuleConfig = RULES) -> DataFrame:
    """ER3 to ER5: one row for each correction of each match: (.., edit_no, words, status).

    sentences: (doc_id, sent_id, words).  Later edits come first; one equal to the original makes the whole match a false
    alarm; of equal ones the first in that order stays ``ok`` and the others are ``same_as_another``.
    """
    return edited(found.join(sentences, ["doc_id", "sent_id"]), rules, c)


def edited(f: DataFrame, rules: list[Rule], c: RuleConfig = RULES) -> DataFrame:
    """As candidates, of matches whose rows hold their sentence's ``words``; a match's corrections are compared inside its row."""
    edits = F.when(F.lit(False), F.lit(None))
    for r in rules:
        if r.edits:
            own = F.array(*[F.struct(F.lit(i).alias("edit_no"), _edited(F.col("words"), F.col("start"), e).alias("new")) for i, e in enumerate(r.edits)])
            edits = edits.when(F.col("rule_no") == r.no, own)
    x = f.select("doc_id", "sent_id", "rule_no", "rule", "start", "n", "words", edits.alias("es"))
    x = x.withColumn("alarm", F.exists("es", lambda e: e["new"] == F.col("words")))
    if c.same_as_original_is_false_alarm:
        x = x.where(~F.col("alarm"))
    x = x.select("*", F.explode("es").alias("e"))
    copy = F.exists("es", lambda y: (y["edit_no"] > F.col("e.edit_no")) & (y["new"] == F.col("e.new")))
    status = F.when(F.col("e.new") == F.col("words"), "same_as_original").when(copy, "same_as_another").otherwise("ok")
    return x.select("doc_id", "sent_id", "rule_no", "rule", "start", "n", "words", F.col("e.edit_no").alias("edit_no"), F.col("e.new").alias("new"), status.alias("status"))


def verified(cands: DataFrame, n_errors: DataFrame, n_after: DataFrame, c: RuleConfig = RULES) -> DataFrame:
    """ER8 to ER10: candidates whose sentence has fewer matches than before; at most ``max_suggestions`` for a match."""
    j = cands.join(n_errors, ["doc_id", "sent_id"]).join(n_after, ["doc_id", "sent_id", "rule_no", "start", "edit_no"], "left").withColumn("n_after", F.coalesce("n_after", F.lit(0)))
    ok = (F.col("status") == "ok") if not c.accept_repeated_suggestions else F.col("status").isin("ok", "same_as_another")
    j = j.where(ok & (F.lit(c.accept_not_improving) | (F.col("n_after") < F.col("n_before"))))
    w = Window.partitionBy("doc_id", "sent_id", "rule_no", "start").orderBy(F.desc("edit_no"))
    return j.withColumn("place", F.row_number().over(w)).where(F.col("place") <= c.max_suggestions)


def escaped(s: Column) -> Column:
    """ER16: the five characters that XML reserves, the ampersand first."""
    for a, b in (("&", "&amp;"), ("'", "&apos;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def spaced(s: Column) -> Column:
    """ER12: a space before a closing mark moves behind it."""
    return F.regexp_replace(s, r"( +)</emph>", "</emph>$1")
