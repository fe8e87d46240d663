"""Page selection, numbering, merging, splitting and page properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages as P
from ..operators.page_ranges import parse_pages, parse_split_points
from .registry import query
from .views import SQL_VIEWS

SQL_VIEWS["pc"] = (("doc_pages",), "SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM doc_pages")


@query("select_pages", "P1", "SELECT doc_id, page_no, n_bytes FROM pc WHERE n >= 4 AND (page_no < 2 OR page_no = 3)", "pc")
def select_pages(v):
    return P.select_pages(v.page_keys(), parse_pages("1-2, 4")).select("doc_id", "page_no", "n_bytes")


@query("page_range_errors", "P1", """
    SELECT DISTINCT doc_id, CASE WHEN n < 2 THEN 'Range "1-2" is outside 1–' || n || '.' ELSE 'Page 4 is outside 1–' || n || '.' END AS error
    FROM pc WHERE n < 4""", "pc")
def page_range_errors(v):
    return P.page_spec_errors(v.page_keys(), parse_pages("1-2, 4"))


@query("extract_pages", "P2", """
    SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) - 1 AS new_page_no FROM pc
    WHERE n >= 5 AND page_no IN (1, 2, 4)""", "pc")
def extract_pages(v):
    spec = parse_pages("3-2, 5, 2", allow_all=False, swap=True)
    return P.extract_pages(v.page_keys(), spec).select("doc_id", "page_no", "new_page_no")


@query("delete_pages", "G3", """
    SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) - 1 AS new_page_no FROM pc
    WHERE NOT (n >= 3 AND page_no IN (0, 2))""", "pc")
def delete_pages(v):
    left, _ = P.delete_pages(v.page_keys(), parse_pages("1,3"))
    return left.select("doc_id", "page_no", "new_page_no")


@query("restore_pages", "G3", "SELECT doc_id, page_no, n_bytes FROM doc_pages", "doc_pages")
def restore_pages(v):
    return P.restore_pages(*P.delete_pages(v.page_keys(), parse_pages("1,3"))).select("doc_id", "page_no", "n_bytes")


@query("renumber_pages", "W1", """
    SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) - 1 AS new_page_no FROM doc_pages WHERE page_no % 3 <> 1""", "doc_pages")
def renumber_pages(v):
    return P.renumber_pages(v.page_keys().filter("page_no % 3 <> 1")).select("doc_id", "page_no", "new_page_no")


@query("bates_number", "W2 F6", """
    SELECT doc_id, page_no, n AS bates_no, 'QF-' || CASE WHEN length(n::VARCHAR) < 4 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END || '-A' AS bates
    FROM (SELECT doc_id, page_no, row_number() OVER (ORDER BY doc_id, page_no) + 99 AS n FROM doc_pages)""", "doc_pages")
def bates_number(v):
    return P.bates_number(v.page_keys(), "QF-", "-A", 4, 100).select("doc_id", "page_no", "bates_no", "bates")


@query("page_labels", "W3 F1 F2 F4", """
    SELECT doc_id, page_no, CASE WHEN page_no <> 1 THEN 'Page ' || (page_no + 3) || ' of ' || (n + 2) END AS of_n,
           ['iii','iv','v','vi','vii','viii','ix','x','xi','xii','xiii','xiv','xv','xvi','xvii','xviii','xix','xx','xxi','xxii','xxiii','xxiv','xxv','xxvi','xxvii','xxviii','xxix','xxx'][page_no + 1] AS roman,
           CASE WHEN page_no < 24 THEN chr(CAST(67 + page_no AS INT)) ELSE 'A' || chr(CAST(65 + page_no - 24 AS INT)) END AS alpha FROM pc""", "pc")
def page_labels(v):
    p = v.page_keys()
    of_n = P.page_labels(p, "page-x-of-n", 3, parse_pages("2")).withColumnRenamed("label", "of_n")
    from ..functions.numbering import format_number

    n, t = F.col("page_no") + 3, F.col("page_count") + 2
    return of_n.select("doc_id", "page_no", "of_n", format_number("lower-roman", n, t).alias("roman"), format_number("upper-alpha", n, t).alias("alpha"))


@query("header_footer", "W4", """
    SELECT doc_id, page_no, '2024-05-06: ' || (page_no + 1) || ' / ' || n AS line FROM pc""", "pc")
def header_footer(v):
    return P.header_footer(v.page_keys(), "{date}: {n} / {total}", "2024-05-06").select("doc_id", "page_no", "line")


@query("unique_field_names", "W5", """
    SELECT c_nationkey::BIGINT AS merge_id, c_custkey AS pos, c_mktsegment AS name, c_mktsegment || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS unique_name
    FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey % 7, c_custkey) AS k FROM customer)""")
def unique_field_names(v):
    f = v.table("customer").select(
        F.col("c_nationkey").cast("long").alias("merge_id"), (F.col("c_custkey") % 7).alias("source_ord"), F.col("c_custkey").alias("pos"), F.col("c_mktsegment").alias("name")
    )
    return P.unique_field_names(f, "merge_id", "source_ord", "pos").drop("source_ord")


@query("unique_sheet_names", "W6 F15", """
    SELECT p_brand AS book, p_partkey AS pos, CASE WHEN k = 1 THEN name ELSE left(name, 31 - length(' (' || k || ')')) || ' (' || k || ')' END AS sheet_name
    FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, lower(name) ORDER BY p_partkey) AS k
          FROM (SELECT *, left(p_name || ' ' || p_type || ' of the great part list', 31) AS name FROM part))""")
def unique_sheet_names(v):
    from ..functions.text import sanitise_sheet_name

    raw = F.concat("p_name", F.lit(" /"), F.col("p_type"), F.lit("* of the great part list"))
    n = v.table("part").select(F.col("p_brand").alias("book"), F.col("p_partkey").alias("pos"), sanitise_sheet_name(raw).alias("name"))
    return P.unique_sheet_names(n, "book", "pos").drop("name")


@query("insert_blank", "W12", """
    SELECT doc_id, page_no, CASE WHEN n >= 2 AND page_no >= 2 THEN page_no + 1 ELSE page_no END AS new_page_no, width, height FROM pc
    UNION ALL SELECT doc_id, NULL, 2, width, height FROM pc WHERE n >= 2 AND page_no = 1""", "pc")
def insert_blank(v):
    return P.insert_blank(v.page_keys(), 2)


@query("merge_documents", "G1", """
    SELECT source, doc_id, page_no, row_number() OVER (PARTITION BY source ORDER BY doc_id, page_no) - 1 AS new_page_no FROM doc_pages""", "doc_pages")
def merge_documents(v):
    return P.merge_documents(v.doc_pages().select("source", "doc_id", "page_no"), "source", "doc_id")


@query("insert_from", "G2", """
    WITH d AS (SELECT a.doc_id, a.n, b.n AS sn FROM (SELECT DISTINCT doc_id, n FROM pc) a JOIN (SELECT DISTINCT doc_id, n FROM pc) b ON b.doc_id = a.doc_id + 1
               WHERE b.n >= 2)
    SELECT doc_id, CASE WHEN page_no >= 1 THEN page_no + 2 ELSE page_no END AS new_page_no, doc_id AS from_id, page_no FROM pc JOIN d USING (doc_id)
    UNION ALL SELECT d.doc_id, 1 + page_no, p.doc_id, page_no FROM d JOIN doc_pages p ON p.doc_id = d.doc_id + 1 WHERE page_no < 2""", "pc")
def insert_from(v):
    pairs = v.table("documents", "doc_id").select("doc_id", (F.col("doc_id") + 1).alias("src_id"))
    return P.insert_from(v.page_keys(), pairs, parse_pages("1-2"), 1)


@query("reorder_pages", "O2", "SELECT doc_id, page_no, n - 1 - page_no AS new_page_no FROM pc WHERE doc_id % 5 <> 0 OR n = 1", "pc")
def reorder_pages(v):
    p = v.page_keys().select("doc_id", "page_no")
    last = F.col("page_count") - 1
    # Every fifth document is given an order that is not a permutation.
    order = P.with_page_count(p).select("doc_id", "page_no", F.when(F.col("doc_id") % 5 != 0, last - F.col("page_no")).otherwise(0).alias("new_page_no"))
    return P.reorder_pages(p, order)


@query("reorder_inverse", "O2", "SELECT doc_id, page_no, page_no AS back FROM doc_pages", "doc_pages")
def reorder_inverse(v):
    p = v.page_keys().select("doc_id", "page_no")
    order = P.with_page_count(p).select("doc_id", "page_no", (F.pmod(F.col("page_no") + 1, F.col("page_count"))).alias("new_page_no"))
    there = P.reorder_pages(p, order)
    back = P.inverse_order(order).withColumnRenamed("page_no", "at").withColumnRenamed("new_page_no", "back")
    return there.withColumnRenamed("new_page_no", "at").join(back, ["doc_id", "at"]).select("doc_id", "page_no", "back")


@query("move_page", "O3", """
    SELECT doc_id, page_no, CASE WHEN n <= 3 THEN page_no WHEN page_no = 1 THEN 3 WHEN page_no IN (2, 3) THEN page_no - 1 ELSE page_no END AS new_page_no FROM pc""", "pc")
def move_page(v):
    return P.move_page(v.page_keys(), 1, 3).select("doc_id", "page_no", "new_page_no")


@query("split_every_n", "G4 K1", """
    SELECT doc_id, page_no, page_no // 2 AS part_no, 'piece-' || lpad((page_no // 2 + 1)::VARCHAR, 3, '0') AS part_name,
           CASE WHEN n <= 2 THEN 'the split would give a single part' END AS error FROM pc""", "pc")
def split_every_n(v):
    return P.part_names(P.split_every_n(v.page_keys(), 2), "piece").select("doc_id", "page_no", "part_no", "part_name", "error")


@query("split_at_pages", "G5", """
    SELECT doc_id, page_no, CASE WHEN page_no >= 3 THEN 2 WHEN page_no >= 1 THEN 1 ELSE 0 END::BIGINT AS part_no,
           CASE WHEN n < 4 THEN 'Split points must be between 2 and ' || n || '.' END AS error FROM pc""", "pc")
def split_at_pages(v):
    return P.split_at_pages(v.page_keys(), parse_split_points("4, 2, 4")).select("doc_id", "page_no", "part_no", "error")


@query("split_by_size", "G6", """
    WITH RECURSIVE f AS (
      SELECT doc_id, page_no, n_bytes AS total, 0::BIGINT AS part_no FROM doc_pages WHERE page_no = 0
      UNION ALL SELECT p.doc_id, p.page_no, CASE WHEN f.total + p.n_bytes > 6000 THEN p.n_bytes ELSE f.total + p.n_bytes END,
             f.part_no + CASE WHEN f.total + p.n_bytes > 6000 THEN 1 ELSE 0 END
      FROM f JOIN doc_pages p ON p.doc_id = f.doc_id AND p.page_no = f.page_no + 1)
    SELECT doc_id, page_no, part_no, CASE WHEN max(part_no) OVER (PARTITION BY doc_id) = 0 THEN 'the split would give a single part' END AS error FROM f""", "doc_pages")
def split_by_size(v):
    return P.split_by_size(v.page_keys().select("doc_id", "page_no", "n_bytes"), 6000).select("doc_id", "page_no", "part_no", "error")


@query("split_by_bookmarks", "G7", """
    SELECT *, CASE WHEN max(part_no) OVER (PARTITION BY doc_id) = 0 THEN 'the split would give a single part' END AS error FROM (
      SELECT p.doc_id, p.page_no, CAST(sum(CASE WHEN o.page IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.doc_id ORDER BY p.page_no) AS BIGINT) AS part_no
      FROM doc_pages p LEFT JOIN (SELECT * FROM outline WHERE parent_id IS NULL) o ON o.doc_id = p.doc_id AND o.page = p.page_no)""", "doc_pages outline")
def split_by_bookmarks(v):
    return P.split_by_bookmarks(v.page_keys(), v.outline()).select("doc_id", "page_no", "part_no", "error")


@query("rotate_pages", "G8", """
    SELECT doc_id, page_no, CASE WHEN n >= 2 AND page_no < 2 THEN (rotate // 90 + 3) % 4 * 90 ELSE rotate END AS rotate FROM pc""", "pc")
def rotate_pages(v):
    return P.rotate_pages(v.page_keys(), parse_pages("1-2"), -1).select("doc_id", "page_no", "rotate")


@query("crop_pages", "G9", """
    SELECT doc_id, page_no, 10.0::DOUBLE AS x0, 20.0::DOUBLE AS y0, 300.0::DOUBLE AS x1, 400.0::DOUBLE AS y1, 0.0::DOUBLE AS rx0, width AS rx1, height AS ry1 FROM doc_pages""", "doc_pages")
def crop_pages(v):
    c = P.crop_pages(v.page_keys(), 10, 20, 300, 400).withColumn("_c", F.col("crop"))
    r = P.reset_crop(c)
    return r.select("doc_id", "page_no", "_c.x0", "_c.y0", "_c.x1", "_c.y1", F.col("crop.x0").alias("rx0"), F.col("crop.x1").alias("rx1"), F.col("crop.y1").alias("ry1"))


@query("resize_pages", "G10", """
    SELECT doc_id, page_no, width AS old_width, 306.0::DOUBLE AS width, 396.0::DOUBLE AS height, least(306 / width, 396 / height) AS sx,
           (306 - width * least(306 / width, 396 / height)) / 2 AS dx, (396 - height * least(306 / width, 396 / height)) / 2 AS dy FROM doc_pages""", "doc_pages")
def resize_pages(v):
    p = v.page_keys().withColumn("old_width", F.col("width"))
    return P.resize_pages(p, 306, 396).select("doc_id", "page_no", "old_width", "width", "height", "sx", "dx", "dy")


@query("match_page_size", "J10", """
    SELECT p_partkey AS id, CASE WHEN abs(w - 612) <= 1 AND abs(h - 792) <= 1 THEN 'Letter' WHEN abs(w - 612) <= 1 AND abs(h - 1008) <= 1 THEN 'Legal'
      WHEN abs(w - 792) <= 1 AND abs(h - 1224) <= 1 THEN 'Tabloid' WHEN abs(w - 841.89) <= 1 AND abs(h - 1190.55) <= 1 THEN 'A3'
      WHEN abs(w - 595.28) <= 1 AND abs(h - 841.89) <= 1 THEN 'A4' WHEN abs(w - 419.53) <= 1 AND abs(h - 595.28) <= 1 THEN 'A5' ELSE 'Custom' END AS size_name
    FROM (SELECT p_partkey, [612, 612.5, 792, 842, 595, 420][p_partkey % 6 + 1] AS w, [792, 1008, 1224.9, 1190, 842, 600][(p_partkey // 2) % 6 + 1] AS h FROM part)""")
def match_page_size(v):
    k = F.col("p_partkey")
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), (i % 6 + 1).cast("int"))
    w, h = pick([612, 612.5, 792, 842, 595, 420], k), pick([792, 1008, 1224.9, 1190, 842, 600], F.floor(k / 2))
    return v.table("part", "p_partkey").select(k.alias("id"), P.match_page_size(w, h).alias("size_name"))


@query("prune_links", "J5", """
    SELECT doc_id, page_no, page_no + 2 AS target_page FROM pc WHERE page_no + 2 < n AND NOT (n >= 3 AND page_no + 2 IN (0, 2))""", "pc")
def prune_links(v):
    left, _ = P.delete_pages(v.page_keys(), parse_pages("1,3"))
    return P.prune_dangling(v.page_links(), left)


@query("prune_bookmarks", "J5", "SELECT doc_id, node_id, page FROM outline WHERE page <> 4", "outline")
def prune_bookmarks(v):
    left = v.page_keys().filter("page_no <> 4")
    return P.prune_dangling(v.outline(), left, "page").select("doc_id", "node_id", "page")
