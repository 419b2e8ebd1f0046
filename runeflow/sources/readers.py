"""Readers of corpora, lexica, rules and annotations (IO).  Each takes lines or paths and returns a DataFrame."""

from __future__ import annotations

import json
from dataclasses import asdict, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runeflow.operators.lexicon import InflectRule

ANNOTATION = "_ref BIGINT, annot ARRAY<STRUCT<type: ARRAY<STRING>, range: STRUCT<_from: STRING, _to: STRING>, position: STRUCT<_pos: STRING>>>"
FALSE_ALARM = -12
#: Tags that the external trigrams number differently, and the number they stand for.
ALIASES, ALIAS_OF = (22, 41, 52, 99), 143


def texts(spark: SparkSession, path: str) -> DataFrame:
    """IO1: (path, text), one row per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def tagged(lines: DataFrame, known_tags: DataFrame | None = None, skip_citations: bool = False) -> DataFrame:
    """IO3: ``value`` lines -> (word, tag): the last field is the tag, the word may hold spaces; blank lines are skipped.

    An unknown tag becomes ``DummyTag``.
    """
    t = lines.where(F.trim("value") != "")
    form = r"^(.*?)[ \t]+(\S+)\s*$"
    t = t.where(F.col("value").rlike(form)).withColumns({"word": F.regexp_extract("value", form, 1), "tag": F.regexp_extract("value", form, 2)})
    if skip_citations:
        t = t.where(F.col("word") != '"')
    if known_tags is not None:
        t = t.join(F.broadcast(known_tags.select("tag", F.lit(1).alias("_known"))), "tag", "left").withColumn("tag", F.when(F.col("_known").isNotNull(), F.col("tag")).otherwise("DummyTag")).drop("_known")
    return t.drop("value")


def counts(lines: DataFrame, names: list[str]) -> DataFrame:
    """IO4, IO5: ``freq a b ..`` lines, parted by blanks or tabs."""
    part = F.split(F.trim("value"), r"\s+")
    return lines.where(F.trim("value") != "").select(part[0].cast("long").alias("freq"), *[part[i + 1].alias(n) for i, n in enumerate(names)])


def inconsistent(suffixes: DataFrame, suffix_tags: DataFrame) -> DataFrame:
    """IO5: suffixes whose tags' frequencies don't add up to their own."""
    s = suffix_tags.groupBy("suffix").agg(F.sum("freq").alias("sum_freq"))
    return suffixes.join(s, "suffix", "left").where(~F.col("freq").eqNullSafe(F.col("sum_freq")))


def inflection_rules(text: str) -> list[InflectRule]:
    """IO7: ``$ tag tag ..`` heads the rules below it; a rule is ``name ending[,ending] strip form ..``; ``=`` empty, ``-`` none."""
    out, tags = [], []
    for line in text.splitlines():
        f = line.split()
        if not f or f[0].startswith("#"):
            continue
        if f[0] == "$":
            tags = f[1:]
        else:
            out.append(InflectRule(f[0], tuple(f[1].split(",")), int(f[2]), tuple(zip(tags, f[3:], strict=False))))
    return out


def annotations(docs: DataFrame) -> DataFrame:
    """IO10: parsed ``s`` elements -> (sent_offset, annot_no, pos, is_false_alarm, types); the last of equal offsets counts.

    Only the start of a range is kept.  ``docs`` has the columns of ANNOTATION and ``line``, their order.
    """
    w = Window.partitionBy("_ref").orderBy(F.desc("line"))
    last = docs.withColumn("n", F.row_number().over(w)).where("n = 1")
    a = last.select(F.col("_ref").alias("sent_offset"), F.posexplode("annot").alias("annot_no", "a"))
    raw = F.coalesce("a.position._pos", "a.range._from")
    false = raw == "FALSE_ALARM"
    return a.select("sent_offset", "annot_no", F.when(false, F.lit(FALSE_ALARM)).otherwise(raw.cast("int")).alias("pos"), F.coalesce(false, F.lit(False)).alias("is_false_alarm"), F.array_sort("a.type").alias("types"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.format("xml").option("rowTag", "s").schema(ANNOTATION).load(path)
    return annotations(d.withColumn("line", F.monotonically_increasing_id()))


def external_trigrams(lines: DataFrame, n_tags: int) -> DataFrame:
    """IO11: ``freq t1 t2 t3`` with numbers from 1; rows out of range are dropped."""
    t = counts(lines, ["t1", "t2", "t3"]).withColumns({c: F.col(c).cast("int") for c in ("t1", "t2", "t3")})
    for c in ("t1", "t2", "t3"):
        t = t.where(F.col(c).between(1, n_tags))
    return t


def aliased(tag: Column) -> Column:
    """PR12: the number under which a tag is looked up."""
    return F.when(tag.isin(*ALIASES), F.lit(ALIAS_OF)).otherwise(tag)


def transitivity(lines: DataFrame) -> DataFrame:
    """IO12: ``lemma mask`` lines with their order in ``line``; the first of a lemma wins."""
    part = F.split(F.trim("value"), r"\s+")
    return lines.select(part[0].alias("lemma"), part[1].cast("int").alias("mask"), "line").groupBy("lemma").agg(F.min_by("mask", "line").alias("mask"))


def thesaurus(lines: DataFrame) -> DataFrame:
    """IO13: head terms at the start of a line, indented ``USE term`` and ``UF term`` below; terms of several words are skipped.

    ``lines``: (file, line, value).  A window per file: thesauri are small.
    """
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    head = ~F.col("value").rlike(r"^\s")
    t = lines.where(F.trim("value") != "").withColumn("term", F.last(F.when(head, F.trim("value")), ignorenulls=True).over(w))
    t = t.where(~head).select("term", F.regexp_extract("value", r"^\s+(USE|UF)\s+(.*?)\s*$", 1).alias("relation"), F.regexp_extract("value", r"^\s+(USE|UF)\s+(.*?)\s*$", 2).alias("target"))
    return t.where((F.col("relation") != "") & ~F.col("term").contains(" ") & ~F.col("target").contains(" "))


def write_config(config) -> str:
    """IO9: settings as JSON."""
    return json.dumps(asdict(config), indent=1)


def read_config(kind: type, text: str):
    """IO9: settings from JSON; an unknown or missing name is an error."""
    d = json.loads(text)
    names = {f.name for f in fields(kind)}
    if set(d) != names:
        raise ValueError(f"settings differ: {sorted(set(d) ^ names)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()})


def taginfo(lines: DataFrame) -> DataFrame:
    """IO4, FE5: lines ``+|-``, tag, lemma's tag, roles, parted by tabs -> (tag, is_content, lemma_tag, roles)."""
    p = F.split("value", "\t")
    return lines.select(p[1].alias("tag"), (p[0] == "+").alias("is_content"), F.coalesce(F.nullif(F.get(p, F.lit(2)), F.lit("")), p[1]).alias("lemma_tag"), F.slice(p, F.lit(4), F.greatest(F.size(p) - 3, F.lit(0))).alias("roles"))


def word_list(lines: DataFrame) -> DataFrame:
    """IO6: lines of a word and its marks (foreign, style, ..), parted by tabs -> (word, marks)."""
    p = F.split("value", "\t")
    return lines.select(p[0].alias("word"), F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))).alias("marks"))
