"""The scanner: one pattern that covers every character, and classes given to its matches afterwards.

Pattern and classes use only what Java's and RE2's syntax share, so that any SQL engine with either can check them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACES = r" \t\r\f\x{A0}"
#: Alternatives of the scanner in order: the first that matches wins, so longer forms come first.
ALTERNATIVES = (
    r"[\p{L}0-9._-]+@[\p{L}0-9-]+(?:\.[\p{L}0-9-]+)+",
    r"https?://[^ \t\r\n\f<>\"]+",
    r"www\.[^ \t\r\n\f<>\"]+",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"[0-9]+(?:[.,][0-9]+)* ?%",
    r"§+ ?[0-9]+",
    r"[0-9]+(?:st|nd|rd|th|:[ae])",
    r"[0-9]+(?:[.,:/][0-9]+)*",
    r"(?:\p{L}\.){2,}",
    r"\p{L}+-\n\p{L}+",
    r"\p{L}+(?:['’-]\p{L}+)*",
    r"\n[ \t\r]*\n[ \t\r\n]*",
    r"\n",
    rf"[{SPACES}]+",
    rf"[^\p{{L}}0-9{SPACES}\n]",
)
PATTERN = "|".join(ALTERNATIVES)
#: The same matches in Java's syntax only: nothing is given back in vain, and a word that nothing can make longer is found at once.
_QUICK = (
    r"\p{L}++(?![@0-9_:'’-]|\.[^ \n])",
    r"[\p{L}0-9._-]++@[\p{L}0-9-]+(?:\.[\p{L}0-9-]+)+",
    *ALTERNATIVES[1:9],
    r"\p{L}++-\n\p{L}++",
    r"\p{L}++(?:['’-]\p{L}++)*+",
)
QUICK_PATTERN = "|".join((*_QUICK, *ALTERNATIVES[11:]))
#: Group 1: the matches that are not white space.
_FULL = rf"[{SPACES}]*+({'|'.join((*_QUICK, *ALTERNATIVES[11:13], ALTERNATIVES[14]))})"
#: A whole sentence, white space included: matches that end none, and the one that does.
_SENTENCE = rf"(?>{'|'.join(_QUICK)}|[{SPACES}]++|\n(?![ \t\r]*\n)|[^\p{{L}}0-9{SPACES}\n.?!])*+(?:[.?!]|{ALTERNATIVES[11]})?"
#: Class and the form a token must have as a whole; the first that fits counts.
CLASSES = (
    ("space", rf"[{SPACES}]+"),
    ("simple_word", r"\p{L}+"),
    ("period", r"\."),
    ("newline", r"\n"),
    ("exclamation_mark", r"!"),
    ("question_mark", r"\?"),
    ("begin_paragraph", r"\n[ \t\r]*\n[ \t\r\n]*"),
    ("left_par", r"[(\[{]"),
    ("right_par", r"[)\]}]"),
    ("citation", r"[\"“”„«»]"),
    ("math", r"[+=<>*/]"),
    ("email", r"[\p{L}0-9._-]+@[\p{L}0-9-]+(?:\.[\p{L}0-9-]+)+"),
    ("url", r"(?:https?://|www\.).+"),
    ("date", r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}"),
    ("time", r"(?:[01]?[0-9]|2[0-4])[.:][0-5][0-9]"),
    ("percentage", r"[0-9]+(?:[.,][0-9]+)* ?%"),
    ("paragraph", r"§+ ?[0-9]+"),
    ("ordinal", r"[0-9]+(?:st|nd|rd|th|:[ae])"),
    ("year", r"1[0-9]{3}|20[0-9]{2}"),
    ("cardinal_sin", r"1"),
    ("cardinal", r"[0-9]+|[0-9]{1,3}(?:[.,][0-9]{3})+|[0-9]+[.,][0-9]+"),
    ("bad_cardinal", r"[0-9]+(?:[.,:/][0-9]+)+"),
    ("abbreviation", r"(?:\p{L}\.){2,}"),
    ("split_word", r"\p{L}+-\n\p{L}+"),
    ("word", r"\p{L}+(?:['’-]\p{L}+)+"),
)
WORDS = ("simple_word", "word", "split_word", "abbreviation")
ENDERS = ("period", "question_mark", "exclamation_mark")


def classify(tok: Column) -> Column:
    """TK2: class of a token, by full match; what most tokens are is asked first."""
    out = F.when(tok.rlike(r"^\p{L}+\z"), F.lit("simple_word")).when(tok == " ", F.lit("space")).when(tok == ".", F.lit("period")).when(tok == ",", F.lit("punctuation"))
    for name, form in CLASSES:
        out = out.when(tok.rlike(rf"^(?:{form})\z"), F.lit(name))
    return out.otherwise(F.lit("punctuation"))


def pseudo_tag(tok: Column, cls: Column) -> Column:
    """A tag that any corpus has: the class, for words refined by capitalisation."""
    case = F.when(tok.rlike(r"^\p{Lu}+\z"), F.lit("word.all")).when(tok.rlike(r"^\p{Lu}"), F.lit("word.cap")).otherwise(F.lit("word.low"))
    return F.when(cls.isin(*WORDS), case).otherwise(cls)


def first_capped(tok: Column) -> Column:
    """TK4."""
    return tok.rlike(r"^\p{Lu}")


def all_capped(tok: Column) -> Column:
    """TK4: every character is a capital."""
    return tok.rlike(r"^\p{Lu}+\z")


def tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spaces: bool = False, where: Callable[[Column], Column] | None = None) -> DataFrame:
    """TK1: (doc_id, pos, tok, cls); ``pos`` counts all matches from 0, white space included, whether it is returned or not.

    Stays in one stage: a text is split inside its row, and no row leaves its partition.
    """
    t = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.regexp_extract_all(text, F.lit(QUICK_PATTERN), F.lit(0))).alias("pos", "tok"))
    t = t.where(where(F.col("tok"))) if where else t if spaces else t.where(~F.col("tok").rlike(rf"^[{SPACES}]"))  # white space, told without its class
    return t.withColumn("cls", classify(F.col("tok")))


def tag_of(tok: Column) -> Column:
    """The pseudo tag of a token alone; a word in small letters takes one test."""
    return F.when(tok.rlike(r"^[\p{L}&&[^\p{Lu}]]\p{L}*+\z"), F.lit("word.low")).when(tok == ".", F.lit("period")).when(tok == ",", F.lit("punctuation")).otherwise(pseudo_tag(tok, classify(tok)))


def is_word(tok: Column) -> Column:
    """Whether a token's class is one of WORDS: no other class has these forms, so one test tells."""
    return tok.rlike(r"^(?:\p{L}++(?:['’-]\p{L}++)*+|(?:\p{L}\.){2,}|\p{L}++-\n\p{L}++)\z")


def word_tag(tok: Column) -> Column:
    """The pseudo tag of a word."""
    return F.when(~tok.rlike(r"^\p{Lu}"), F.lit("word.low")).when(tok.rlike(r"^\p{Lu}+\z"), F.lit("word.all")).otherwise(F.lit("word.cap"))


def sentence_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """SE1: (doc_id, sent_id, toks): the tokens of each sentence in order, white space aside.

    Sentences are split inside the document's row, and tokens inside the sentence's: nothing is shuffled, sorted or spilled.
    A document is one row, so its id should be too.
    """
    s = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.regexp_extract_all(text, F.lit(_SENTENCE), F.lit(0))).alias("sent_id", "line"))
    s = s.select("doc_id", F.col("sent_id").cast("long").alias("sent_id"), F.regexp_extract_all("line", F.lit(_FULL), F.lit(1)).alias("toks"))
    return s.where(F.size("toks") > 0)


def printed(text: Column) -> Column:
    """SE12: the sentences of a text, tokens joined by spaces, inside its row."""
    lines = F.transform(F.regexp_extract_all(text, F.lit(_SENTENCE), F.lit(0)), lambda x: F.array_join(F.regexp_extract_all(x, F.lit(_FULL), F.lit(1)), " "))
    return F.filter(lines, lambda x: x != "")


def numbered_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As sentence_rows, (doc_id, sent_id, first, parts): all matches of a sentence, white space included, and ``pos`` of the first."""
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.regexp_extract_all(text, F.lit(_SENTENCE), F.lit(0)).alias("lines"))
    counts = F.transform("lines", lambda x: F.regexp_count(x, F.lit(QUICK_PATTERN)))
    firsts = F.aggregate(counts, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    s = lines.select("doc_id", F.posexplode(F.arrays_zip("lines", firsts.alias("firsts"))).alias("sent_id", "x")).where("x.lines <> ''")
    return s.select("doc_id", F.col("sent_id").cast("long").alias("sent_id"), F.col("x.firsts").alias("first"), F.regexp_extract_all("x.lines", F.lit(QUICK_PATTERN), F.lit(0)).alias("parts"))


def dealt(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Deals documents by id before they are split: windows over a document's tokens then move no token, only texts once."""
    return docs.repartition(doc_id)


def with_offsets(toks: DataFrame) -> DataFrame:
    """TK3: ``off``, characters before the token; needs all tokens, white space included."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return toks.withColumn("off", F.coalesce(F.sum(F.length("tok")).over(w), F.lit(0)).cast("long"))


def with_sentences(toks: DataFrame, newline_ends: bool = False) -> DataFrame:
    """SE1: ``sent_id`` from 0: a sentence ends with a full stop, question or exclamation mark or a blank line; with ``newline_ends`` (TK7) with a newline too."""
    ends = ENDERS + ("begin_paragraph",) + (("newline",) if newline_ends else ())
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return toks.withColumn("sent_id", F.coalesce(F.sum(F.col("cls").isin(*ends).cast("int")).over(w), F.lit(0)).cast("long"))
