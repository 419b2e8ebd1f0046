"""DuckDB SQL of the shared relations, for checking the Spark plans."""

from __future__ import annotations

from runeflow.functions import scan


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case(tok: str = "tok") -> str:
    whens = " ".join(f"WHEN regexp_full_match({tok}, {quoted(form)}) THEN '{name}'" for name, form in scan.CLASSES)
    return f"CASE {whens} ELSE 'punctuation' END"


WORDS = "cls IN (" + ", ".join(quoted(c) for c in scan.WORDS) + ")"
TAG = rf"CASE WHEN {WORDS} THEN CASE WHEN regexp_full_match(tok, '\p{{Lu}}+') THEN 'word.all' WHEN regexp_matches(tok, '^\p{{Lu}}') THEN 'word.cap' ELSE 'word.low' END ELSE cls END"
ENDS = "cls IN ('period', 'question_mark', 'exclamation_mark', 'begin_paragraph')"


def all_tokens(source: str = "documents", doc_id: str = "doc_id", text: str = "text") -> str:
    """CTEs: every match with its class and offset: al(doc_id, pos, tok, cls, off)."""
    return f"""l0 AS (SELECT {doc_id} AS doc_id, regexp_extract_all({text}, {quoted(scan.PATTERN)}) AS l FROM {source}),
l1 AS (SELECT doc_id, unnest(l) AS tok, unnest(range(0, len(l))) AS pos FROM l0),
al AS (SELECT doc_id, pos, tok, {case()} AS cls, coalesce(sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM l1)"""


def tokens(source: str = "documents", doc_id: str = "doc_id", text: str = "text") -> str:
    """CTEs up to tk(doc_id, pos, tok, cls, off, norm, tag, sent_id): tokens that are not white space."""
    return f"""{all_tokens(source, doc_id, text)},
tk AS (SELECT doc_id, pos, tok, cls, off, lower(tok) AS norm, {TAG} AS tag, coalesce(sum(({ENDS})::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sent_id FROM al WHERE cls <> 'space')"""


def words() -> str:
    """CTEs up to wd: the words among tk."""
    return f"{tokens()}, wd AS (SELECT * FROM tk WHERE {WORDS})"
