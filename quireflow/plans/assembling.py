"""Merging and inserting documents with their bookmarks, links, fields and defaults."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly as Y
from ..operators.hierarchy import qualified_names
from ..operators.page_ranges import parse_pages
from ..operators.scan import apart
from ..session import written
from .registry import query
from .views import SQL_VIEWS

_AGAIN = 1_000_000_000

SQL_VIEWS.update({
    # Documents are merged by source; every fourth one is put in once more at the end.
    "merge_sources": (("doc_pages",), f"""
        SELECT source AS merge_id, doc_id AS source_ord, doc_id FROM doc_pages WHERE page_no = 0
        UNION ALL SELECT source, doc_id + {_AGAIN}, doc_id FROM doc_pages WHERE page_no = 0 AND doc_id % 4 = 0"""),
    "merge_plan": (("merge_sources", "doc_pages", "outline"), """
        SELECT merge_id, source_ord, doc_id, CAST(coalesce(sum(pages) OVER w, 0) AS BIGINT) AS page_off, CAST(coalesce(sum(coalesce(nodes, 0)) OVER w, 0) AS BIGINT) AS node_off
        FROM merge_sources JOIN (SELECT doc_id, count(*) AS pages FROM doc_pages GROUP BY 1) USING (doc_id)
        LEFT JOIN (SELECT doc_id, max(node_id) + 1 AS nodes FROM outline GROUP BY 1) USING (doc_id)
        WINDOW w AS (PARTITION BY merge_id ORDER BY source_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
    "insert_pairs": (("doc_pages",), """
        WITH n AS (SELECT doc_id, count(*) AS n FROM doc_pages GROUP BY 1)
        SELECT a.doc_id, b.doc_id AS src_id FROM n a JOIN n b ON b.doc_id = a.doc_id + 1 WHERE a.n >= 1 AND b.n >= 2"""),
    "page_fields": (("doc_pages",), """
        SELECT doc_id, page_no * 2 AS field_id, NULL::BIGINT AS parent_id, 0 AS seq, 'p' || (page_no % 2) AS t, CASE WHEN page_no % 3 <> 2 THEN page_no END AS page_no FROM doc_pages
        UNION ALL SELECT doc_id, page_no * 2 + 1, page_no * 2, 1, 'kid', page_no FROM doc_pages"""),
})


def _sources(v):
    firsts = v.doc_pages().filter("page_no = 0").select(F.col("source").alias("merge_id"), F.col("doc_id").alias("source_ord"), "doc_id")
    return firsts.unionByName(firsts.filter("doc_id % 4 = 0").withColumn("source_ord", F.col("source_ord") + _AGAIN))


def _plan(v, outline=None):
    return Y.merge_plan(_sources(v), v.page_keys(), outline)[0]


@query("merge_plan", "G1", "SELECT * FROM merge_plan", "merge_plan")
def merge_plan(v):
    return _plan(v, v.outline()).drop("field_off")


@query("merge_pages", "G1", "SELECT merge_id, source_ord, doc_id, page_no, page_no + page_off AS new_page_no FROM doc_pages JOIN merge_plan USING (doc_id)", "doc_pages merge_plan")
def merge_pages(v):
    return Y.merged_pages(_plan(v), v.page_keys().select("doc_id", "page_no"))


@query("merge_outline", "G1", """
    WITH m AS (SELECT merge_id, source_ord, doc_id, node_id + node_off AS node_id, parent_id + node_off AS parent_id, seq, title, page + page_off AS page FROM outline JOIN merge_plan USING (doc_id)),
    t AS (SELECT merge_id, node_id, row_number() OVER w - 1 AS rank, lag(node_id) OVER w AS prev_id, lead(node_id) OVER w AS next_id FROM m WHERE parent_id IS NULL
          WINDOW w AS (PARTITION BY merge_id ORDER BY source_ord, seq))
    SELECT m.* REPLACE (coalesce(rank, seq) AS seq), prev_id, next_id FROM m LEFT JOIN t USING (merge_id, node_id)""", "outline merge_plan")
def merge_outline(v):
    return Y.merged_outline(_plan(v, v.outline()), v.outline())


@query("merge_links", "G1", """
    SELECT merge_id, source_ord, doc_id, page_no + page_off AS page_no, page_no + 2 + page_off AS target_page FROM doc_pages JOIN merge_plan USING (doc_id)""", "doc_pages merge_plan")
def merge_links(v):
    return Y.merged_links(_plan(v), v.page_links())


def _forms(v):
    """A form per customer: two top-level fields with one below each, merged by nation."""
    c = v.table("customer", "c_custkey", "c_nationkey", "c_mktsegment", "c_name").withColumnRenamed("c_custkey", "doc_id")
    node = lambda i, up, seq, t: F.struct(
        F.lit(i).cast("long").alias("field_id"), F.lit(up).cast("long").alias("parent_id"), F.lit(seq).cast("long").alias("seq"), t.alias("t"))
    kid = F.concat(F.lit("x"), (F.col("doc_id") % 3).cast("string"))
    fields = c.select("doc_id", F.inline(F.array(node(0, None, 0, F.lit("form")), node(1, 0, 0, F.lit("name")), node(2, None, 1, F.col("c_mktsegment")), node(3, 2, 0, kid))))
    sources = c.select(F.col("c_nationkey").cast("long").alias("merge_id"), F.col("doc_id").alias("source_ord"), "doc_id")
    pages = c.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 2)).alias("page_no"))
    return c, sources, pages, fields


@query("merge_fields", "G1 W5 H3", """
    WITH r AS (SELECT c_nationkey::BIGINT AS merge_id, c_custkey AS source_ord, c_custkey % 3 AS kid, 4 * (row_number() OVER n - 1) AS off,
                 'form' || CASE WHEN row_number() OVER n > 1 THEN '_' || row_number() OVER n ELSE '' END AS form,
                 c_mktsegment || CASE WHEN row_number() OVER s > 1 THEN '_' || row_number() OVER s ELSE '' END AS segment
               FROM customer WINDOW n AS (PARTITION BY c_nationkey ORDER BY c_custkey), s AS (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey))
    SELECT merge_id, source_ord, off AS field_id, NULL::BIGINT AS parent_id, form AS t, form AS qualified FROM r
    UNION ALL SELECT merge_id, source_ord, off + 1, off, 'name', form || '.name' FROM r
    UNION ALL SELECT merge_id, source_ord, off + 2, NULL, segment, segment FROM r
    UNION ALL SELECT merge_id, source_ord, off + 3, off + 2, 'x' || kid, segment || '.x' || kid FROM r""")
def merge_fields(v):
    _, sources, pages, fields = _forms(v)
    merged = Y.merged_fields(Y.merge_plan(sources, pages, fields=fields)[0], fields)
    names = qualified_names(merged, "merge_id")
    return merged.join(apart(names), ["merge_id", "field_id"]).select("merge_id", "source_ord", "field_id", "parent_id", "t", "qualified")


@query("merge_defaults", "G1", """
    SELECT c_nationkey::BIGINT AS merge_id, 'DA' AS name, arg_min('/Helv ' || c_custkey, c_custkey) AS value FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1
    UNION ALL SELECT c_nationkey, 'Font' || (c_custkey % 4), arg_min(c_name, c_custkey) FROM customer GROUP BY 1, 2""")
def merge_defaults(v):
    c, sources, pages, _ = _forms(v)
    plan = Y.merge_plan(sources, pages)[0]
    appearance = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/Helv "), F.col("doc_id").cast("string")))
    first = Y.merged_defaults(plan, c.select("doc_id", appearance.alias("appearance")))
    fonts = c.select("doc_id", F.concat(F.lit("Font"), (F.col("doc_id") % 4).cast("string")).alias("name"), F.col("c_name").alias("value"))
    return first.select("merge_id", F.lit("DA").alias("name"), F.col("appearance").alias("value")).unionByName(Y.merged_resources(plan, fonts))


@query("merge_refused", "G1", f"""
    SELECT merge_id, CASE WHEN n < 2 THEN '{Y.TOO_FEW}' ELSE '{Y.MISSING}' END AS error FROM (
      SELECT c_nationkey * 1000 + c_custkey % 97 AS merge_id, count(*) AS n, count_if(c_custkey % 10 = 0) AS gone FROM customer GROUP BY 1) WHERE n < 2 OR gone > 0""")
def merge_refused(v):
    c, sources, pages, _ = _forms(v)
    finer = sources.withColumn("merge_id", F.col("merge_id") * 1000 + F.col("doc_id") % 97)
    return Y.merge_plan(finer, pages.filter("doc_id % 10 <> 0"))[1]


_SPEC, _AT = parse_pages("1-2"), 1


def _insertion(v, pages):
    pairs = v.table("documents", "doc_id").select("doc_id", (F.col("doc_id") + 1).alias("src_id"))
    return Y.insert_plan(pairs, pages, _SPEC, _AT)


def _laid_out(v):
    """The keys of all pages, laid out once for the plan and all that follows it."""
    return written(v.page_keys().select("doc_id", "page_no"))


@query("insert_outline", "G2", """
    SELECT doc_id, node_id, parent_id, seq, title, CASE WHEN page >= 1 THEN page + 2 ELSE page END AS page FROM outline JOIN insert_pairs USING (doc_id)""", "outline insert_pairs")
def insert_outline(v):
    return Y.inserted_outline(_insertion(v, v.page_keys()), v.outline(), _AT)


@query("insert_links", "G2", """
    SELECT doc_id, CASE WHEN page_no >= 1 THEN page_no + 2 ELSE page_no END AS page_no, page_no + 3 AS target_page, doc_id AS from_id FROM doc_pages JOIN insert_pairs USING (doc_id)
    UNION ALL SELECT i.doc_id, 1, 2, src_id FROM insert_pairs i JOIN doc_pages p ON p.doc_id = src_id WHERE page_no = 0""", "doc_pages insert_pairs")
def insert_links(v):
    p = _laid_out(v)
    return Y.inserted_links(_insertion(v, p), p.withColumn("target_page", F.col("page_no") + 1), _SPEC, _AT)


@query("insert_fields", "G2 W5", """
    WITH own AS (SELECT i.doc_id, i.doc_id AS from_id, field_id, parent_id, t, CASE WHEN page_no >= 1 THEN page_no + 2 ELSE page_no END AS page_no FROM page_fields JOIN insert_pairs i USING (doc_id)),
    had AS (SELECT doc_id, t, count(*) AS n FROM own WHERE parent_id IS NULL GROUP BY ALL),
    came AS (SELECT i.doc_id, src_id AS from_id, field_id, t, page_no + 1 AS page_no, row_number() OVER (PARTITION BY i.doc_id, t ORDER BY page_no, seq) AS k
             FROM page_fields f JOIN insert_pairs i ON f.doc_id = src_id WHERE page_no < 2)
    SELECT * FROM own UNION ALL
    SELECT c.doc_id, from_id, field_id, NULL, c.t || CASE WHEN k + coalesce(n, 0) > 1 THEN '_' || (k + coalesce(n, 0)) ELSE '' END, page_no
    FROM came c LEFT JOIN had h ON h.doc_id = c.doc_id AND h.t = c.t""", "page_fields insert_pairs")
def insert_fields(v):
    p, page = _laid_out(v), F.col("page_no")
    none = F.lit(None).cast("long")
    field = lambda *xs: F.struct(*[x.alias(n) for x, n in zip(xs, ("field_id", "parent_id", "seq", "t", "page_no"), strict=True)])
    parent = field(page * 2, none, F.lit(0).cast("long"), F.concat(F.lit("p"), (page % 2).cast("string")), F.when(page % 3 != 2, page))
    kid = field(page * 2 + 1, page * 2, F.lit(1).cast("long"), F.lit("kid"), page)
    return Y.inserted_fields(_insertion(v, p), p.select("doc_id", F.inline(F.array(parent, kid))), _SPEC, _AT)
