"""Search, pattern discovery and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from .registry import query
from .views import SQL_VIEWS

ALL = ["ssn", "credit_card", "email", "phone"]

# The same four patterns in the oracle's dialect.
_RE2 = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d(?:[ -]?\d){12,18}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)|\b\d{3})[ .-]?\d{3}[ .-]?\d{4}\b",
}


def spans_sql(table: str, keys: str, text: str, pattern: str) -> str:
    """Positions in SQL: match texts beside the gaps between them, running lengths summed."""
    return f"""
      SELECT {keys}, m, CAST(sum(length(g) + length(m)) OVER (PARTITION BY {keys} ORDER BY i) - length(m) AS BIGINT) AS s
      FROM (SELECT {keys}, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i
            FROM (SELECT {keys}, regexp_extract_all({text}, '{pattern}') AS ms, string_split_regex({text}, '{pattern}') AS gs FROM {table}))"""


_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, s AS \"start\", s + length(m) AS \"end\", '{k}' AS kind, {i} AS ord, m AS preview FROM ({spans_sql('documents', 'doc_id', 'text', p)})"
    for i, (k, p) in enumerate(_RE2.items())
)
SQL_VIEWS["candidates"] = ((), f"""
    SELECT * FROM ({_FOUND}) WHERE kind <> 'credit_card' OR
      (len(regexp_extract_all(preview, '[0-9]')) BETWEEN 13 AND 19 AND
       list_sum([CASE WHEN i % 2 = 0 THEN (CAST(d AS INT) * 2) // 10 + (CAST(d AS INT) * 2) % 10 ELSE CAST(d AS INT) END
                 for d, i in list_reverse(regexp_extract_all(preview, '[0-9]'))]) % 10 = 0)""")  # fmt: skip
SQL_VIEWS["hit_list"] = (("candidates",), """
    SELECT doc_id, kind, "start", "end", preview FROM (
      WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "start" - "end", ord) AS n FROM candidates),
      kept AS (
        SELECT doc_id, n, "end" AS last, true AS keep FROM r WHERE n = 1
        UNION ALL
        SELECT r.doc_id, r.n, CASE WHEN r."start" >= k.last THEN r."end" ELSE k.last END, r."start" >= k.last
        FROM kept k JOIN r ON r.doc_id = k.doc_id AND r.n = k.n + 1)
      SELECT r.* FROM r JOIN kept k ON r.doc_id = k.doc_id AND r.n = k.n WHERE k.keep)""")


def _hits(v):
    return S.find_patterns(v.table("documents", "doc_id", "text", "lang", "source"), ALL)


@query("search_whole_word", "D1", f"""
    SELECT doc_id, page_no, s AS "start", s + length(m) AS "end" FROM ({spans_sql('doc_pages', 'doc_id, page_no', 'text', r'(?i)' + chr(92) + 'bque' + chr(92) + 'b')})
""", "doc_pages")  # fmt: skip
def search_whole_word(v):
    return S.search(v.doc_pages().select("doc_id", "page_no", "text"), "que", whole_word=True)


@query("search_case_sensitive", "D1", f"""
    SELECT item_id, s AS "start", s + length(m) AS "end" FROM ({spans_sql('benchmark', 'item_id', 'text', 'The')})
""")  # fmt: skip
def search_case_sensitive(v):
    return S.search(v.table("benchmark"), "The", case_sensitive=True)


@query("search_page_counts", "A7 D1", """
    SELECT doc_id, page_no, CAST(len(regexp_extract_all(text, '(?i)er')) AS BIGINT) AS matches FROM doc_pages
    WHERE regexp_matches(text, '(?i)er')""", "doc_pages")  # fmt: skip
def search_page_counts(v):
    return S.matches_per_page(v.doc_pages(), "er", ["doc_id", "page_no"])


@query("pattern_hits", "D2 D3", 'SELECT doc_id, kind, "start", "end", preview FROM hit_list', "hit_list")
def pattern_hits(v):
    return S.explode_hits(_hits(v), ["doc_id"])


@query("pattern_hits_custom", "D2", f"""
    SELECT doc_id, 'custom' AS kind, s AS "start", s + length(m) AS "end", m AS preview
    FROM ({spans_sql('documents', 'doc_id', 'text', '[0-9]{4,}')})""")  # fmt: skip
def pattern_hits_custom(v):
    return S.explode_hits(S.find_patterns(v.table("documents", "doc_id", "text"), [], ["[0-9]{4,}"]), ["doc_id"])


@query("pattern_rollup", "A17 D2 D3", """
    SELECT source, lang, kind, count(*) AS hits, count(DISTINCT doc_id) AS docs
    FROM hit_list JOIN documents USING (doc_id) GROUP BY ROLLUP (source, lang, kind)""", "hit_list")
def pattern_rollup(v):
    hits = S.explode_hits(_hits(v), ["doc_id", "source", "lang"])
    return hits.rollup("source", "lang", "kind").agg(
        F.count(F.lit(1)).alias("hits"), F.count_distinct("doc_id").alias("docs")
    )


@query("unreadable_pages", "D6", """
    SELECT h.doc_id, kind, "start", "end", preview, false AS unreadable FROM hit_list h WHERE h.doc_id % 10 <> 7
    UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, true FROM documents WHERE doc_id % 10 = 7""", "hit_list")
def unreadable_pages(v):
    d = v.table("documents", "doc_id", "text").withColumn("text", F.when(F.col("doc_id") % 10 != 7, F.col("text")))
    found = S.explode_hits(S.find_patterns(d, ALL), ["doc_id"]).withColumn("unreadable", F.lit(False))
    return found.unionByName(S.unreadable_rows(d, ["doc_id"]))


@query("confirmed_hits", "J11", """
    SELECT doc_id, kind, "start", "end", preview FROM hit_list WHERE ("start" + "end") % 2 = 0 AND doc_id % 3 <> 0""", "hit_list")
def confirmed_hits(v):
    hits = S.explode_hits(_hits(v), ["doc_id"])
    even = (F.col("start") + F.col("end")) % 2 == 0
    decisions = hits.filter(F.col("doc_id") % 3 != 0).select("doc_id", "start", "end", even.alias("confirmed"))
    return S.confirmed_hits(hits, decisions, ["doc_id", "start", "end"])


_REDACTED_SQL = """
    SELECT d.doc_id, CAST(count(h."start") AS BIGINT) AS removed,
           coalesce(string_agg(substr(text, CAST(prev + 1 AS BIGINT), CAST(h."start" - prev AS BIGINT)), '' ORDER BY h."start"), '')
             || substr(any_value(text), CAST(coalesce(max(h."end"), 0) + 1 AS BIGINT)) AS redacted
    FROM documents d LEFT JOIN (
      SELECT *, lag("end", 1, 0) OVER (PARTITION BY doc_id ORDER BY "start") AS prev FROM hit_list) h USING (doc_id)
    GROUP BY d.doc_id"""


@query("redact_text", "D4", f"SELECT doc_id, removed, sha256(redacted) AS digest FROM ({_REDACTED_SQL})", "hit_list")
def redact_text(v):
    r = S.redact_text(_hits(v))
    return r.select("doc_id", "removed", F.sha2("redacted", 256).alias("digest"))


SQL_VIEWS["redacted_docs"] = (("hit_list",), _REDACTED_SQL)


@query("confirm_removed", "D5", """
    WITH n AS (SELECT doc_id, preview AS needle, false AS keep FROM hit_list
               UNION ALL SELECT doc_id, string_split(text, ' ')[1], true FROM documents)
    SELECT doc_id, count_if(NOT keep AND contains(redacted, needle))::BIGINT AS leaked,
           count_if(keep AND NOT contains(redacted, needle))::BIGINT AS vanished,
           count_if(keep <> contains(redacted, needle)) = 0 AS passed
    FROM n JOIN redacted_docs USING (doc_id) GROUP BY doc_id""", "hit_list redacted_docs")
def confirm_removed(v):
    r = S.redact_text(_hits(v))
    needles = S.explode_hits(r, ["doc_id"]).select("doc_id", F.col("preview").alias("needle"), F.lit(False).alias("must_survive"))
    first = r.select("doc_id", F.element_at(F.split("text", " ", 2), 1).alias("needle"), F.lit(True).alias("must_survive"))
    return S.confirm_removed(r, needles.unionByName(first), ["doc_id"], "redacted")
