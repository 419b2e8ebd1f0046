"""Sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from runeflow.functions import scan
from runeflow.plans import sql
from runeflow.plans.catalogue import query, table
from runeflow.plans.text_queries import T, toks
from runeflow.sources import readers, sinks
from runeflow.streaming import counts

_B = f"WITH {sql.tokens('benchmark', 'item_id')} "


@query("io14_tagged_round_trip", _B + "SELECT doc_id AS item_id, tag, count(*) AS n FROM tk GROUP BY ALL")
def io14(spark, sf_dir):
    """IO3, IO14: tokens written as tagged lines and read again."""
    t = toks(spark, sf_dir, False, "benchmark", "item_id").withColumn("lemma", F.lit(None).cast("string"))
    lines = t.select("doc_id", F.concat_ws(" ", F.when(F.col("tok") == "\n", "\\n").otherwise(F.col("tok")), "tag").alias("value"))
    return readers.tagged(lines).groupBy(F.col("doc_id").alias("item_id"), "tag").agg(F.count("*").alias("n"))


@query("io14_wtl_lines", T + "SELECT md5(tok || chr(9) || tag || chr(9) || lower(tok)) AS line, count(*) AS n FROM tk GROUP BY 1")
def io14_wtl(spark, sf_dir):
    """IO14: every line, however rare."""
    lines = sinks.wtl_lines(toks(spark, sf_dir).withColumn("lemma", F.lit(None).cast("string")))
    return lines.groupBy(F.md5(F.col("value").cast("binary")).alias("line")).agg(F.count("*").alias("n"))


_XML = (
    (1, '<s ref="10"><annot><type>VERB</type><position pos="3"/></annot></s>'),
    (2, '<s ref="20"><annot><type>SPELL</type><type>STYLE</type><range from="4" to="6"/></annot><annot><type>LOOK_AT</type><position pos="FALSE_ALARM"/></annot></s>'),
    (3, '<s ref="10"><annot><type>COMPOUND</type><position pos="5"/></annot></s>'),
)


@query("io10_xml_annotations", "SELECT * FROM (VALUES (10::BIGINT, 0, 5, false, ['COMPOUND']), (20, 0, 4, false, ['SPELL', 'STYLE']), (20, 1, -12, true, ['LOOK_AT'])) t(sent_offset, annot_no, pos, is_false_alarm, types)")
def io10(spark, sf_dir):
    d = spark.createDataFrame(list(_XML), "line long, value string").select("line", F.from_xml("value", readers.ANNOTATION).alias("s")).select("line", "s.*")
    return readers.annotations(d)


@query("io11_external_trigrams", "SELECT * FROM (VALUES (7::BIGINT, 1, 143, 3), (2, 143, 5, 6)) t(freq, t1, t2, t3)")
def io11(spark, sf_dir):
    lines = spark.createDataFrame([("7 1 22 3",), ("2 99 5 6",), ("4 0 1 2",), ("5 1 2 400",), ("",)], "value string")
    t = readers.external_trigrams(lines, 149)
    return t.select("freq", *[readers.aliased(F.col(c)).alias(c) for c in ("t1", "t2", "t3")])


@query("io13_thesaurus", "SELECT * FROM (VALUES ('car', 'UF', 'automobile'), ('auto', 'USE', 'car')) t(term, relation, target)")
def io13(spark, sf_dir):
    rows = ["car", "\tUF\tautomobile", "auto", "\tUSE\tcar", "steam engine", "\tUSE\tengine", "boat", "\tUF\tsmall ship"]
    return readers.thesaurus(spark.createDataFrame([("f", i, v) for i, v in enumerate(rows)], "file string, line int, value string"))


@query("io15_marked_html", "SELECT item_id, md5(array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN length(w) > 8 THEN '<b>' || replace(replace(w, '&', '&amp;'), '<', '&lt;') || '</b>' ELSE replace(replace(w, '&', '&amp;'), '<', '&lt;') END), ' ')) AS html FROM benchmark")
def io15(spark, sf_dir):
    w = F.transform(F.split("text", " "), lambda x: sinks.marked(x, F.length(x) > 8, "html"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(F.array_join(w, " ").cast("binary")).alias("html"))


@query("io16_xml_elements", "SELECT conv_id, turn, '<turn role=\"' || role || '\" n=\"' || length(text) || '\">' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '''', '&apos;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;') || '</turn>' AS xml FROM conversations")
def io16(spark, sf_dir):
    from runeflow.operators.rules import escaped

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", sinks.element("turn", escaped(F.col("text")), role=F.col("role"), n=F.length("text")).alias("xml"))


@query("stream_tokenize_counts", f"{T} SELECT cls, count(*) AS n FROM tk GROUP BY cls")
def stream(spark, sf_dir):
    schema = table(spark, sf_dir, "documents").schema
    # a pattern, because a stream's plain path must be a folder
    return counts.run_to_end(counts.class_counts(counts.read_documents(spark, f"{sf_dir}/documents.parque[t]", schema)))


@query("event_windows", "SELECT date_trunc('hour', ts) AS begin_ts, event_type, count(*) AS n FROM events GROUP BY ALL")
def events(spark, sf_dir):
    """The batch form of the windowed stream."""
    w = counts.windowed_events(table(spark, sf_dir, "events"))
    return w.select(F.col("window.start").alias("begin_ts"), "event_type", "n")
