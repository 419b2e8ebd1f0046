"""Rule files: the text form of rules (RU1, RU3, RU9, RU14 to RU17, RU19, RU21, RU23, ER15).

    category article: wrong article
    rule 1 a_vowel in article
      a: word = 'a'
      b: starts(word, '[aeiou]') and not class = 'abbreviation'   then ?, * or + if it may be left out or repeated
      left c: ...                                                 context before the match; right: after it
      agree a.case b.case
      info use an before a vowel
      fix replace a an
      fires it was a apple
      silent it was a pear

``help`` and ``accept`` stand for ``rule`` where matches aren't reported; ``jump 4`` ends the line of a rule that skips
others.  Tests are expressions over the attributes word, tag and class, with =, !=, <, >, in (..), ~ /regexp/ (of the whole
value), and, or, not and typed functions; they are compiled to SQL conditions.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runeflow.operators.features import compatible
from runeflow.operators.rules import Edit, Element, Rule

ATTRIBUTES = {"word": "norm", "tag": "tag", "class": "cls"}


class Function(NamedTuple):
    args: tuple[str, ...]
    result: str
    sql: str  # {0}, {1}, ..: the arguments


FUNCTIONS = {
    "length": Function(("text",), "number", "length({0})"),
    "starts": Function(("text", "regexp"), "truth", "regexp_like({0}, {1})"),
    "left": Function(("text", "number"), "text", "left({0}, {1})"),
    "right": Function(("text", "number"), "text", "right({0}, {1})"),
}
"""RU17: functions with typed arguments; more are added by name."""
LIMITS = {"starts": r"^(?:%s)"}


class Agreement(NamedTuple):
    """RU16: two elements' tags have compatible values in one place of the tag."""

    rule_no: int
    a: int
    b: int
    value: int  # 0: word class, 1: case, ..


class RuleFile(NamedTuple):
    categories: dict[str, str]
    rules: list[Rule]
    helpers: list[Rule]
    agreements: list[Agreement]
    fires: list[tuple[str, str]]  # (rule, text that must set it off)
    silent: list[tuple[str, str]]


class RuleError(ValueError):
    pass


_TOKEN = re.compile(r"\s*(?:('(?:[^']|'')*')|/((?:[^/\\]|\\.)*)/|(\d+)|(!=|<=|>=|[=<>~(),])|([A-Za-z_]+))")


class _Parser:
    """Recursive descent: or, and, not, comparison, operand; each gives (type, SQL)."""

    def __init__(self, text: str) -> None:
        self.items, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise RuleError(f"can't read {text[at:]!r}")
            kind = ("text", "regexp", "number", "sign", "name")[m.lastindex - 1]
            self.items.append((kind, m.group(m.lastindex)))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.items) and self.items[self.at][0] in ("sign", "name") and self.items[self.at][1] in values

    def take(self, *values: str) -> str:
        if self.at >= len(self.items) or values and not self.peek(*values):
            raise RuleError(f"expected {' or '.join(values) or 'more'}")
        self.at += 1
        return self.items[self.at - 1][1]

    def parsed(self) -> str:
        kind, out = self.any()
        if kind != "truth" or self.at < len(self.items):
            raise RuleError("not a test")
        return out

    def any(self) -> tuple[str, str]:
        return self.joined("or", lambda: self.joined("and", self.negated))

    def joined(self, word: str, part) -> tuple[str, str]:
        kind, out = part()
        while self.peek(word):
            self.take(word)
            k, more = part()
            if {kind, k} != {"truth"}:
                raise RuleError(f"{word} joins tests")
            out = f"({out} {word.upper()} {more})"
        return kind, out

    def negated(self) -> tuple[str, str]:
        if not self.peek("not"):
            return self.compared()
        self.take("not")
        kind, out = self.negated()
        if kind != "truth":
            raise RuleError("not needs a test")
        return kind, f"(NOT {out})"

    def compared(self) -> tuple[str, str]:
        kind, a = self.operand()
        if self.peek("~"):
            self.take("~")
            k, b = self.operand()
            if (kind, k) != ("text", "regexp"):
                raise RuleError("~ compares text with /regexp/")
            return "truth", f"regexp_like({a}, {_quoted(f'^(?:{b})$')})"
        if self.peek("in"):
            self.take("in")
            self.take("(")
            values = [self.operand()]
            while self.peek(","):
                self.take(",")
                values.append(self.operand())
            self.take(")")
            if any(k != kind for k, _ in values):
                raise RuleError("in lists values of one type")
            return "truth", f"{a} IN ({', '.join(v for _, v in values)})"
        if self.peek("=", "!=", "<", ">", "<=", ">="):
            sign = self.take()
            k, b = self.operand()
            if k != kind or kind == "truth":
                raise RuleError(f"{sign} compares values of one type")
            return "truth", f"{a} {'<>' if sign == '!=' else sign} {b}"
        return kind, a

    def operand(self) -> tuple[str, str]:
        if self.peek("("):
            self.take("(")
            out = self.any()
            self.take(")")
            return out
        if self.at >= len(self.items):
            raise RuleError("a value is missing")
        kind, value = self.items[self.at]
        self.at += 1
        if kind != "name":
            return kind, value
        if value in ATTRIBUTES:
            return "text", ATTRIBUTES[value]
        if value not in FUNCTIONS:
            raise RuleError(f"unknown name {value}")
        self.take("(")
        args = [] if self.peek(")") else [self.operand()]
        while self.peek(","):
            self.take(",")
            args.append(self.operand())
        self.take(")")
        f = FUNCTIONS[value]
        given = tuple("regexp" if want == "regexp" and k == "text" else k for (k, _), want in zip(args, f.args, strict=False))
        if len(args) != len(f.args) or given != f.args:
            raise RuleError(f"{value} takes ({', '.join(f.args)})")
        sql = [_quoted(LIMITS.get(value, "%s") % (v[1:-1] if k == "text" else v)) if want == "regexp" else v for (k, v), want in zip(args, f.args, strict=True)]
        return f.result, f.sql.format(*sql)


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "''") + "'"


def test_of(text: str) -> str:
    """RU14, RU19: a test as an SQL condition on norm, tag and cls."""
    return _Parser(text).parsed()


def parse(text: str, values: tuple[str, ...] = ("wordcl", "case")) -> RuleFile:
    """RU1: a rule file; ``values`` names the places of a tag.  Faults are raised with the number of their line."""
    out = RuleFile({}, [], [], [], [], [])
    head: dict | None = None

    def close() -> None:
        if head:
            r = Rule(head["no"], head["name"], head["category"], tuple(e for _, e in head["parts"]), head["left"], head["right"], head["kind"] == "accept", head["jump"], tuple(head["edits"]), head["info"])
            (out.helpers if head["kind"] == "help" else out.rules).append(r)

    for number, line in enumerate(text.splitlines(), 1):
        try:
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            if m := re.fullmatch(r"category (\w+): (.+)", line):
                out.categories[m[1]] = m[2]
            elif m := re.fullmatch(r"(rule|help|accept) (\d+) (\w+)(?: in (\w+))?(?: jump (\d+))?", line):
                close()
                if m[4] and m[4] not in out.categories:
                    raise RuleError(f"category {m[4]} is not declared")
                head = {"kind": m[1], "no": int(m[2]), "name": m[3], "category": m[4] or "", "jump": int(m[5]) if m[5] else None, "parts": [], "left": 0, "right": 0, "edits": [], "info": ""}
            elif head is None:
                raise RuleError("stands before any rule")
            elif m := re.fullmatch(r"(left |right )?(\w+): (.+?)\s*([?*+])?", line):
                if m[2] in [n for n, _ in head["parts"]]:
                    raise RuleError(f"element {m[2]} is there already")
                head["parts"].append((m[2], Element(test_of(m[3]), m[4] or "")))
                head["left"] += m[1] == "left "
                head["right"] += m[1] == "right "
            elif m := re.fullmatch(r"agree (\w+)\.(\w+) (\w+)\.(\w+)", line):
                if m[2] != m[4] or m[2] not in values:
                    raise RuleError("agreement is in one value of a tag")
                out.agreements.append(Agreement(head["no"], _place(head, m[1]), _place(head, m[3]), values.index(m[2])))
            elif m := re.fullmatch(r"info (.+)", line):
                head["info"] = m[1]
            elif m := re.fullmatch(r"fix (delete|replace|insert|nothing)(?: (\w+))?(?: (\S+))?", line):
                head["edits"].append(Edit(m[1], _place(head, m[2]) if m[2] else 0, m[3] or ""))
            elif m := re.fullmatch(r"(fires|silent) (.+)", line):
                (out.fires if m[1] == "fires" else out.silent).append((head["name"], m[2]))
            else:
                raise RuleError("not understood")
        except RuleError as e:
            raise RuleError(f"line {number}: {e}") from None
    close()
    return out


def _place(head: dict, name: str) -> int:
    """RU15, RU21: which token of the match an element's name stands for; only elements before any repeated one have a fixed place."""
    for k, (n, e) in enumerate(head["parts"][head["left"] :]):
        if n == name:
            return k
        if e.times:
            break
    raise RuleError(f"no element {name} with a fixed place")


def active(f: RuleFile, off: tuple[str, ...] = ()) -> list[Rule]:
    """RU3: rules by number, without those that are switched off by their name or category; help rules are never active."""
    return sorted((r for r in f.rules if r.name not in off and r.category not in off), key=lambda r: r.no)


def agreeing(found: DataFrame, sentences: DataFrame, f: RuleFile) -> DataFrame:
    """RU16: matches whose agreements hold; sentences: (doc_id, sent_id, ts), tokens with their tags."""
    return found if not f.agreements else fitting(found.join(sentences, ["doc_id", "sent_id"]), f).select(*found.columns)


def fitting(found: DataFrame, f: RuleFile) -> DataFrame:
    """As agreeing, of matches whose rows hold their sentence's tokens ``ts``."""
    value = lambda at, k: F.get(F.split(F.get("ts", F.col("start") + at)["tag"], r"\."), F.lit(k))
    holds: Column = F.lit(True)
    for g in f.agreements:
        holds = holds & ((F.col("rule_no") != g.rule_no) | F.coalesce(compatible(value(g.a, g.value), value(g.b, g.value)), F.lit(False)))
    return found.where(holds)


def described(r: Rule) -> str:
    """RU23: a rule's matching in one line."""
    parts = [f"{e.test}{e.times}" for e in r.elements]
    end = len(parts) - r.right
    return f"{r.name}( {' '.join(parts[: r.left])} [ {' '.join(parts[r.left : end])} ] {' '.join(parts[end:])} )"


def anchors(r: Rule) -> list[str]:
    """RU22, LX27: words of which a match needs one, from the first element that lists them and can't be left out; none if there is no such."""
    out = []
    for e in r.elements:
        if e.times in ("", "+") and (m := re.fullmatch(r"norm (?:= ('[^']*')|IN \(([^)]*)\))", e.test)):
            out += re.findall(r"'([^']*)'", m[1] or m[2])
    return sorted(set(out))
