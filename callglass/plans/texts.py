"""Text queries over documents and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from callglass.functions import text as X
from callglass.operators import conversations as C
from callglass.plans.registry import Query
from callglass.sources.given import with_views


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def cut_sql(column: str) -> str:
    return f"case when length({column}) > 500 then concat(substr({column}, 1, 500), '…') else {column} end"


def redacted_sql(column: str) -> str:
    for rule in X.RULES:
        column = f"regexp_replace({column}, {sql_text(rule.pattern)}, {sql_text(rule.placeholder)}, 'gi')"
    return column


RE2_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TITLE = f"""coalesce(nullif(substr(replace(regexp_replace(content, '^{RE2_SPACE}+|{RE2_SPACE}+$', '', 'g'), chr(10), ' '), 1, 60), ''), 'New conversation')"""

QUERIES = [
    Query(
        "redacted_previews",
        lambda g: g.documents.select("doc_id", X.preview(F.col("text")).alias("preview")),
        f"""select doc_id, {redacted_sql("case when length(text) > 500 then concat(substr(text, 1, 500), '…') else text end")} as preview
from documents""",
    ),
    # Whole texts: the SQL engine's patterns know ASCII classes only, so a Python model checks this one in the tests.
    Query("redacted_documents", lambda g: g.documents.select("doc_id", X.redact(F.col("text")).alias("redacted"))),
    Query("redaction_counts", lambda g: X.rule_hits(g.documents, "text", keys=("lang",))),
    Query(
        "titles",
        lambda g: C.summaries(g.messages, g.conversations).select("conversation_id", "title"),
        with_views("fx_messages", sql=f"""select conversation_id,
  arg_min({TITLE}, seq) filter (where role = 'user') as title from fx_messages group by 1"""),
    ),
    Query(
        "document_titles",
        lambda g: g.documents.select("doc_id", X.title(F.col("text")).alias("title")),
        f"select doc_id, {TITLE.replace('content', 'text')} as title from documents",
    ),
    Query(
        "token_estimate",
        lambda g: g.documents.select("doc_id", X.token_estimate(F.col("text")).alias("tokens")),
        f"""select doc_id, cast(len(list_filter(regexp_split_to_array(text, '{RE2_SPACE}+'), lambda w: w <> '')) as integer) as tokens
from documents""",
    ),
]
