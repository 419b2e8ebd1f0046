"""Rules over tagged sentences, corrections and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from runeflow.functions import scan
from runeflow.operators import evaluate as E
from runeflow.operators import rules as R
from runeflow.operators.rules import Edit, Element, Rule
from runeflow.plans import sql
from runeflow.plans.catalogue import query, table
from runeflow.plans.text_queries import T, rows, toks

VOWEL = "left(norm, 1) IN ('a', 'e', 'i', 'o', 'u')"
ART = Rule(1, "a_vowel", "article", (Element("norm = 'a'"), Element(VOWEL)), edits=(Edit("replace", 0, "an"), Edit("delete", 0), Edit("replace", 0, "an")))
OF_THE = Rule(2, "of_the", "", (Element("norm = 'of'"), Element("norm = 'the'")), accepting=True, jump=4)
THE = Rule(3, "the_cap_or_low", "style", (Element("norm = 'the'"), Element("tag IN ('word.cap', 'word.low')")), edits=(Edit("nothing"),))
NP = Rule(4, "np", "phrase", (Element("norm IN ('the', 'a')", "?"), Element("tag = 'word.low' AND length(norm) > 5", "+"), Element("norm = 'and'", "?")))
CONTEXT = Rule(5, "in_context", "style", (Element("norm = 'of'"), Element("norm IN ('the', 'a')"), Element("tag = 'word.low'", "*"), Element("cls = 'period'")), left=1, right=1)
PREP = Rule(6, "preposition", "phrase", (Element("norm IN ('of', 'in', 'to', 'de', 'von')"),))
ALL = [ART, OF_THE, THE, NP, CONTEXT]
CATEGORIES = {"article": "wrong article", "style": "matters of style", "phrase": "phrases", "unused": "never reported"}


def _sql(rules) -> str:
    """CTEs up to ma(doc_id, sent_id, rule_no, rule, start, n)."""
    codes = ", ".join(f"string_agg(substr('{R.LETTERS}', 1 + {R.letter(r)}, 1), '' ORDER BY pos) AS c{r.no}" for r in rules)
    each = " UNION ".join(
        f"SELECT doc_id, sent_id, {r.no} AS rule_no, '{r.name}' AS rule, k + length(regexp_extract(substr(c{r.no}, k + 1), {sql.quoted(R.pattern(r))}, 1)) AS start, length(regexp_extract(substr(c{r.no}, k + 1), {sql.quoted(R.pattern(r))}, 2)) AS n FROM st WHERE regexp_matches(substr(c{r.no}, k + 1), {sql.quoted(R.pattern(r))})"
        for r in rules
    )
    return f", sc AS (SELECT doc_id, sent_id, {codes} FROM tk GROUP BY ALL), st AS (SELECT *, unnest(range(0, length(c{rules[0].no}))) AS k FROM sc), ma AS (SELECT * FROM ({each}) WHERE n > 0)"


def _matches(spark, sf_dir, rules, jumps=False):
    return R.scanned_matches(table(spark, sf_dir, "documents"), rules, jumps)


def _per_rule(m):
    return m.groupBy("doc_id", "rule").agg(F.count("*").alias("n_matches"), F.sum("n").cast("long").alias("n_tokens"), F.min("start").cast("long").alias("first_start"))


_PER = " SELECT doc_id, rule, count(*) AS n_matches, sum(n)::BIGINT AS n_tokens, min(start) AS first_start FROM ma GROUP BY ALL"


@query("ru7_two_token_rule", T + _sql([ART]) + _PER)
def ru7(spark, sf_dir):
    return _per_rule(_matches(spark, sf_dir, [ART]))


@query("ru8_star_plus_rule", T + _sql([NP]) + _PER)
def ru8(spark, sf_dir):
    return _per_rule(_matches(spark, sf_dir, [NP]))


@query("ru11_rule_with_context", T + _sql([CONTEXT]) + _PER)
def ru11(spark, sf_dir):
    return _per_rule(_matches(spark, sf_dir, [CONTEXT]))


_JUMP = ", jp AS (SELECT DISTINCT doc_id, sent_id, unnest(range(start, start + n)) AS p FROM ma WHERE rule_no = 2), kp AS (SELECT * FROM ma WHERE NOT (rule_no = 3 AND EXISTS (SELECT 1 FROM jp WHERE jp.doc_id = ma.doc_id AND jp.sent_id = ma.sent_id AND jp.p = ma.start)))"


@query("ru12_jump_suppression", T + _sql([OF_THE, THE]) + _JUMP + " SELECT doc_id, count(*) FILTER (rule_no = 2) AS n_accepting, count(*) FILTER (rule_no = 3) AS n_left FROM kp GROUP BY doc_id")
def ru12(spark, sf_dir):
    rules = [OF_THE, THE]
    k = _matches(spark, sf_dir, rules, jumps=True)
    return k.groupBy("doc_id").agg(F.count_if(F.col("rule_no") == 2).alias("n_accepting"), F.count_if(F.col("rule_no") == 3).alias("n_left"))


@query("ru10_help_rules", T + _sql([NP, PREP]) + " SELECT a.doc_id, count(*) AS n, max(a.n + b.n) AS longest FROM ma a JOIN ma b ON a.rule_no = 6 AND b.rule_no = 4 AND a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND b.start = a.start + a.n GROUP BY a.doc_id")
def ru10(spark, sf_dir):
    """A preposition followed by a noun phrase: two help rules put together."""
    s = R.sequences_in(R.row_matches(rows(spark, sf_dir), [NP, PREP]), PREP.no, NP.no)
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n").cast("long").alias("longest"))


@query("ev13_category_usage", T + _sql(ALL) + _JUMP + f", ct(category) AS (VALUES {', '.join(f'({sql.quoted(c)})' for c in CATEGORIES)}), rc(rule_no, category) AS (VALUES {', '.join(f'({r.no}, {sql.quoted(r.category)})' for r in ALL if not r.accepting)}) SELECT ct.category, count(kp.rule_no) AS n FROM ct LEFT JOIN rc USING (category) LEFT JOIN kp ON kp.rule_no = rc.rule_no GROUP BY ct.category")
def ev13(spark, sf_dir):
    """IO18: matches of each category, those without any included."""
    k = R.reported(_matches(spark, sf_dir, ALL, jumps=True), ALL).groupBy("rule_no").agg(F.count("*").alias("k"))
    of = spark.createDataFrame([(r.no, r.category) for r in ALL], "rule_no int, category string")
    n = k.join(F.broadcast(of), "rule_no").groupBy("category").agg(F.sum("k").alias("k"))
    return spark.createDataFrame([(c,) for c in CATEGORIES], "category string").join(n, "category", "left").select("category", F.coalesce("k", F.lit(0)).alias("n"))


@query("er6_mark_islands", T + _sql([NP]) + ", mk AS (SELECT DISTINCT doc_id, sent_id, unnest(range(start, start + n)) AS p FROM ma), i AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY p) AS g FROM mk), s AS (SELECT doc_id, sent_id, count(*) AS n FROM i GROUP BY doc_id, sent_id, g) SELECT doc_id, count(*) AS n_sections, max(n) AS longest, sum(n)::BIGINT AS n_marked FROM s GROUP BY doc_id")
def er6(spark, sf_dir):
    """Marked tokens as maximal sections, gaps between them."""
    m = _matches(spark, sf_dir, [NP]).select("doc_id", "sent_id", F.explode(F.sequence("start", F.expr("start + n - 1"))).alias("pos")).distinct()
    return E.islands(m, ["doc_id", "sent_id"]).groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.max("n").alias("longest"), F.sum("n").alias("n_marked"))


def _with_words(spark, sf_dir, rules, jumps=False):
    """Matches beside the words of their sentence, which are in the same row already."""
    s = R.row_matches(rows(spark, sf_dir), rules, jumps)
    return R.each_match(s.withColumn("words", F.transform("toks", F.lower)), "words")


_CAND = """, sw AS (SELECT doc_id, sent_id, list(norm ORDER BY pos) AS words FROM tk GROUP BY ALL), ca AS (SELECT ma.doc_id, ma.sent_id, ma.start, e.edit_no, words, CASE e.op WHEN 'delete' THEN list_concat(words[1:start], words[start + 2:]) ELSE list_concat(words[1:start], ['an'], words[start + 2:]) END AS new
FROM ma JOIN sw USING (doc_id, sent_id), (VALUES (0, 'replace'), (1, 'delete'), (2, 'replace')) e(edit_no, op)), cs AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id, sent_id, start, new ORDER BY edit_no DESC) > 1 THEN 'same_as_another' ELSE 'ok' END AS status FROM ca)"""


@query("er5_correction_status", T + _sql([ART]) + _CAND + " SELECT doc_id, edit_no, status, count(*) AS n FROM cs GROUP BY ALL")
def er5(spark, sf_dir):
    c = R.edited(_with_words(spark, sf_dir, [ART]), [ART])
    return c.groupBy("doc_id", "edit_no", "status").agg(F.count("*").alias("n"))


@query("er5_false_alarms", T + _sql([THE]) + ", sw AS (SELECT doc_id, sent_id, list(norm ORDER BY pos) AS words FROM tk GROUP BY ALL) SELECT count(*) FILTER (list_concat(words[1:start], words[start + 1:]) <> words) AS n_left, count(*) AS n_matches FROM ma JOIN sw USING (doc_id, sent_id)")
def er5_false(spark, sf_dir):
    """A correction that changes nothing makes the whole match a false alarm; the count of matches before stays."""
    m = _with_words(spark, sf_dir, [THE])
    return m.agg(F.count("*").alias("n_matches")).crossJoin(R.edited(m, [THE]).agg(F.count("*").alias("n_left"))).select("n_left", "n_matches")  # one row each


MATCHED = [ART, THE, NP, CONTEXT]
"""The rules that report; a correction is tried against all of them."""


def _retagged(word):
    """The token that a word of a correction becomes."""
    cls = scan.classify(word)
    return F.struct(F.lower(word).alias("norm"), scan.pseudo_tag(word, cls).alias("tag"), cls.alias("cls"))


def _after(r) -> str:
    """Letters of the corrected sentence."""
    return f"array_to_string(list_transform(new, lambda t: substr('{R.LETTERS}', 1 + {R.on_field(R.letter(r), 't')}, 1)), '') AS c{r.no}"


_NEW = f"(SELECT {{{{'norm': lower(tok), 'tag': {sql.TAG}, 'cls': cls}}}} FROM (SELECT tok, {sql.case()} AS cls FROM (SELECT 'an' AS tok)))".replace("{{", "{").replace("}}", "}")
_VER = f""", sw AS (SELECT doc_id, sent_id, list({{'norm': norm, 'tag': tag, 'cls': cls}} ORDER BY pos) AS ts FROM tk GROUP BY ALL), nb AS (SELECT doc_id, sent_id, count(*) AS n_before FROM ma GROUP BY ALL),
ca AS (SELECT ma.doc_id, ma.sent_id, ma.start, e.edit_no, n_before, CASE e.op WHEN 'delete' THEN list_concat(ts[1:start], ts[start + 2:]) ELSE list_concat(ts[1:start], [{_NEW}], ts[start + 2:]) END AS new
FROM ma JOIN sw USING (doc_id, sent_id) JOIN nb USING (doc_id, sent_id), (VALUES (1, 'delete'), (2, 'replace')) e(edit_no, op) WHERE rule_no = 1),
aw AS (SELECT *, {', '.join(_after(r) for r in MATCHED)} FROM ca), ax AS (SELECT *, unnest(range(0, len(new))) AS k FROM aw),
af AS (SELECT doc_id, sent_id, start, edit_no, count(*) AS n_after FROM ({' UNION '.join(f"SELECT doc_id, sent_id, start, edit_no, {r.no} AS rule_no, k + length(regexp_extract(substr(c{r.no}, k + 1), {sql.quoted(R.pattern(r))}, 1)) AS s2, length(regexp_extract(substr(c{r.no}, k + 1), {sql.quoted(R.pattern(r))}, 2)) AS n2 FROM ax WHERE regexp_matches(substr(c{r.no}, k + 1), {sql.quoted(R.pattern(r))})" for r in MATCHED)}) WHERE n2 > 0 GROUP BY ALL)
SELECT ca.doc_id, edit_no, count(*) AS n_suggested, sum(coalesce(n_after, 0))::BIGINT AS n_errors_left FROM ca LEFT JOIN af USING (doc_id, sent_id, start, edit_no) WHERE coalesce(n_after, 0) < n_before GROUP BY ALL"""


@query("er8_suggestions_verified", T + _sql(MATCHED) + _VER)
def er8(spark, sf_dir):
    """Corrected sentences are tagged again and matched by all rules; suggestions that leave as many matches are dropped."""
    v = R.corrections(R.tagged(rows(spark, sf_dir)), MATCHED, _retagged)
    return v.groupBy("doc_id", "edit_no").agg(F.count("*").alias("n_suggested"), F.sum("n_after").cast("long").alias("n_errors_left"))


@query("io17_error_records", T + _sql([ART]) + """, sw AS (SELECT doc_id, sent_id, list(tok ORDER BY pos) AS words FROM tk GROUP BY ALL) SELECT ma.doc_id, ma.sent_id, '<gramerror rule="' || rule || '"><marked>' || replace(replace(replace(replace(replace(array_to_string(words[start + 1:start + n], ' '), '&', '&amp;'), '''', '&apos;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;') || '</marked><mark begin="' || start || '" end="' || (start + n - 1) || '"/></gramerror>' AS xml FROM ma JOIN sw USING (doc_id, sent_id)""")
def io17(spark, sf_dir):
    j = R.each_match(R.row_matches(rows(spark, sf_dir), [ART]), "toks")
    marked = R.escaped(F.array_join(F.slice("toks", F.col("start") + 1, F.col("n")), " "))
    return j.select("doc_id", "sent_id", F.format_string('<gramerror rule="%s"><marked>%s</marked><mark begin="%d" end="%d"/></gramerror>', "rule", marked, "start", F.expr("start + n - 1")).alias("xml"))


@query("io19_keyword_in_context", T + _sql([ART]) + ", sw AS (SELECT doc_id, sent_id, list(tok ORDER BY pos) AS w FROM tk GROUP BY ALL) SELECT ma.doc_id, ma.sent_id, start, array_to_string(w[greatest(start - 2, 1):start], ' ') || ' [' || array_to_string(w[start + 1:start + n], ' ') || '] ' || array_to_string(w[start + n + 1:start + n + 3], ' ') AS line FROM ma JOIN sw USING (doc_id, sent_id)")
def io19(spark, sf_dir):
    """The skeleton of a new annotation: the suspect in brackets among its neighbours."""
    j = R.each_match(R.row_matches(rows(spark, sf_dir), [ART]), "toks").withColumnRenamed("toks", "w")
    a, n = F.col("start"), F.col("n")
    first = F.greatest(a - 2, F.lit(1))
    line = F.concat(F.array_join(F.slice("w", first, a - first + 1), " "), F.lit(" ["), F.array_join(F.slice("w", a + 1, n), " "), F.lit("] "), F.array_join(F.slice("w", a + n + 1, F.lit(3)), " "))
    return j.select("doc_id", "sent_id", F.col("start").cast("long").alias("start"), line.alias("line"))


@query("er16_xml_escape", """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '''', '&apos;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;')) AS escaped FROM pages""")
def er16(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(R.escaped(F.col("html")).cast("binary")).alias("escaped"))


@query("lx27_rule_anchors", f"WITH an(word, rule) AS (VALUES ('a', 'a_vowel'), ('of', 'of_the'), ('the', 'of_the'), ('the', 'the_cap_or_low')), dw AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, {sql.quoted(scan.PATTERN)}))) AS word FROM documents) SELECT doc_id, string_agg(DISTINCT rule, ' ' ORDER BY rule) AS rules FROM dw JOIN an USING (word) GROUP BY doc_id")
def lx27(spark, sf_dir):
    """Rules that can match in a document at all, from an index of words that rules need."""
    anchors = spark.createDataFrame([("a", "a_vowel"), ("of", "of_the"), ("the", "of_the"), ("the", "the_cap_or_low")], "word string, rule string")
    w = toks(spark, sf_dir).select("doc_id", F.col("norm").alias("word")).distinct()
    return w.join(F.broadcast(anchors), "word").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("rule")), " ").alias("rules"))
