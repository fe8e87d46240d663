"""Corpus reports, region redaction, retrieval."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..functions.folds import each
from ..functions.spans import spans
from ..operators import redaction as D
from ..operators import reports as R
from ..operators import retrieval as K
from ..operators import usage as U
from ..session import checkpoint_dir
from .registry import query
from .views import SQL_VIEWS


@query("document_summary", "A1", """
    SELECT d.doc_id, count(p.page_no) AS page_count, 'Document ' || d.doc_id AS title, any_value(d.source) AS author FROM documents d LEFT JOIN doc_pages p USING (doc_id) GROUP BY d.doc_id""", "doc_pages")
def document_summary(v):
    d = v.table("documents", "doc_id", "source").select("doc_id", F.concat(F.lit("Document "), "doc_id").alias("title"), F.col("source").alias("author"))
    return R.document_summary(v.page_keys(), d)


@query("font_inventory", "A6 F7", "SELECT DISTINCT doc_id, regexp_replace(font_name, '^[A-Z]{6}\\+', '') AS font, embedded FROM runs", "runs")
def font_inventory(v):
    return R.font_inventory(v.runs())


@query("font_report", "J8 F8 F9", """
    SELECT doc_id, font, CASE font WHEN 'Arial-BoldMT' THEN 'arial' WHEN 'Calibri-Bold' THEN 'calibri' WHEN 'Georgia-Italic' THEN 'georgia' ELSE lower(font) END AS key,
      CASE WHEN embedded THEN 'embedded' WHEN font = 'Arial-BoldMT' THEN 'standard' WHEN font IN ('Calibri-Bold') THEN 'system' ELSE 'fallback' END AS status,
      CASE WHEN NOT embedded THEN CASE font WHEN 'Georgia-Italic' THEN 'Times-Italic' WHEN 'Consolas' THEN 'Courier' WHEN 'Verdana' THEN 'Helvetica' END END AS substitute
    FROM (SELECT doc_id, regexp_replace(font_name, '^[A-Z]{6}\\+', '') AS font, arg_min(embedded, (page_no, run_no)) AS embedded FROM runs GROUP BY ALL)""", "runs")
def font_report(v):
    installed = v.spark.createDataFrame([("calibri",), ("verdanapro",)], "key string")
    return R.font_report(R.first_fonts(v.runs()), installed)


@query("needs_fallback", "J8", """
    SELECT doc_id, bool_or(font_name IN ('Georgia-Italic', 'Consolas')) AS needs_fallback FROM runs GROUP BY doc_id""", "runs")
def needs_fallback(v):
    installed = v.spark.createDataFrame([("calibri",)], "key string")
    return R.needs_fallback(R.font_report(R.first_fonts(v.runs()), installed))


_FAM = ["Arial", "Georgia", "Menlo", "Carlito", "Noto Serif"]
_ASK = ["Arial", "georgia", "Cambria", "Monaco", "Futura", "Noto Sans Mono"]


@query("closest_face", "J9", f"""
    WITH f AS (SELECT p_partkey AS face_index, {_FAM!r}[p_partkey % 5 + 1] AS family, p_size * 18 AS weight, p_partkey % 3 = 0 AS italic, p_brand AS path FROM part),
    a AS (SELECT s_suppkey AS id, {_ASK!r}[s_suppkey % 6 + 1] AS family, s_suppkey % 2 = 0 AS bold, s_suppkey % 4 < 2 AS italic FROM supplier),
    b AS (SELECT a.*, CASE a.family WHEN 'Arial' THEN 'Arial' WHEN 'georgia' THEN 'Georgia' WHEN 'Cambria' THEN 'Georgia' WHEN 'Monaco' THEN 'Menlo' WHEN 'Futura' THEN 'Carlito' ELSE 'Menlo' END AS target FROM a)
    SELECT id, b.family, arg_min(f.path, (CASE WHEN f.italic <> b.italic THEN 10000 ELSE 0 END + CASE WHEN (weight >= 600) <> bold THEN 1000 ELSE 0 END + abs(weight - CASE WHEN bold THEN 700 ELSE 400 END), f.path, f.face_index)) AS path,
      CASE WHEN lower(b.family) <> lower(target) THEN target END AS used_family
    FROM b JOIN f ON f.family = b.target GROUP BY id, b.family, target""")
def closest_face(v):
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    faces = v.table("part").select(p.alias("face_index"), pick(_FAM, p).alias("family"), (F.col("p_size") * 18).alias("weight"), (p % 3 == 0).alias("italic"), F.col("p_brand").alias("path"))
    asks = v.table("supplier").select(s.alias("id"), pick(_ASK, s).alias("family"), (s % 2 == 0).alias("bold"), (s % 4 < 2).alias("italic"))
    return R.closest_face(asks, faces).select("id", "family", "path", "used_family")


@query("glyph_usage", "A12", """
    SELECT lang, count(*) AS glyphs, string_agg(c, '' ORDER BY c) AS characters FROM (SELECT DISTINCT lang, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY lang""")
def glyph_usage(v):
    return R.glyph_usage(v.table("documents", "lang", "text", "doc_id"), "lang", "text")


@query("distinct_words", "A18", "SELECT doc_id, count(DISTINCT text) AS distinct_values FROM runs GROUP BY doc_id", "runs")
def distinct_words(v):
    return R.distinct_values(v.runs(), "doc_id", "text")


@query("distinct_words_approx", "A18", "SELECT doc_id, count(DISTINCT text) AS distinct_values, true AS within_tolerance FROM runs GROUP BY doc_id", "runs")
def distinct_words_approx(v):
    # The estimate is held against the exact count: its standard error is 2 %, five of which no group should pass.
    near = R.distinct_values(v.runs(), "doc_id", "text", approximate=True).withColumnRenamed("distinct_values", "_near")
    return _tolerable(R.distinct_values(v.runs(), "doc_id", "text").join(near, "doc_id"), F.col("_near"), 0.1).drop("_near")


def _tolerable(df, estimate, share):
    return df.withColumn("within_tolerance", F.abs(estimate - F.col("distinct_values")) <= F.greatest(F.col("distinct_values") * share, F.lit(1.0)))


@query("distinct_word_sketches", "A18", """
    WITH w AS (SELECT lang, source, unnest(string_split(text, ' ')) AS word FROM documents)
    SELECT 'lang' AS level, lang AS name, count(DISTINCT word) AS distinct_values, true AS within_tolerance FROM w GROUP BY lang
    UNION ALL SELECT 'source', source, count(DISTINCT word), true FROM w GROUP BY source""")
def distinct_word_sketches(v):
    docs = v.table("documents", "doc_id", "lang", "source", "text")
    words = each(docs, ["doc_id", "lang", "source"], F.split("text", " ", -1), "word")
    path = f"{checkpoint_dir(v.spark)}/sketches_{uuid.uuid4().hex}"
    U.value_sketches(words, ["doc_id", "lang", "source"], F.col("word")).write.parquet(path)
    stored = v.spark.read.parquet(path)  # both levels come from the stored sketches of single documents

    def level(name):
        exact = words.groupBy(F.col(name).alias("name")).agg(F.count_distinct("word").alias("distinct_values"))
        near = U.merged_estimates(stored, [name]).withColumnRenamed(name, "name")
        return _tolerable(exact.join(near, "name"), F.col("estimate"), 0.08).select(F.lit(name).alias("level"), "name", "distinct_values", "within_tolerance")

    return level("lang").unionByName(level("source"))


@query("shared_glyphs", "A12", """
    WITH u AS (SELECT doc_id, font_name || '#' || (doc_id % 20) AS file_id, text, NOT (doc_id % 20 = 7 AND doc_id % 3 = 0) AS readable FROM runs),
    g AS (SELECT file_id, count(DISTINCT c) AS n FROM (SELECT file_id, unnest(string_split(text, '')) AS c FROM u WHERE readable) WHERE c <> '' GROUP BY file_id)
    SELECT file_id, count(DISTINCT doc_id) AS documents, NOT bool_and(readable) AS kept_whole, CASE WHEN bool_and(readable) THEN any_value(coalesce(n, 0)) END AS glyphs
    FROM u LEFT JOIN g USING (file_id) GROUP BY file_id""", "runs")
def shared_glyphs(v):
    file_id = F.concat("font_name", F.lit("#"), (F.col("doc_id") % 20).cast("string"))
    readable = ~((F.col("doc_id") % 20 == 7) & (F.col("doc_id") % 3 == 0))
    uses = v.runs().select("doc_id", file_id.alias("file_id"), "text", readable.alias("readable"))
    return U.shared_glyphs(uses, U.glyph_bitmaps(uses))


_SUBTYPES = [*U.MARKUP_SUBTYPES, "Link", "Widget", U.ATTACHMENT]
SQL_VIEWS["removable"] = (("fields", "outline", "runs"), f"""
    SELECT conv_id AS doc_id, CASE WHEN k < 18 THEN 'comments' WHEN k = 20 THEN 'attachments' END AS cat FROM (SELECT conv_id, (conv_id + turn * 3) % {len(_SUBTYPES)} AS k FROM conversations)
    UNION ALL SELECT doc_id, 'form_fields' FROM fields WHERE len(value) > 0 OR (name = 'sign' AND doc_id % 2 = 0)
    UNION ALL SELECT doc_id, 'bookmarks' FROM outline UNION ALL SELECT doc_id, 'hidden_text_runs' FROM runs WHERE render_mode IN (3, 7)
    UNION ALL SELECT doc_id, 'info_keys' FROM documents, range(0, 3) t(i) WHERE i < doc_id % 4
    UNION ALL SELECT doc_id, 'xmp_packets' FROM documents WHERE doc_id % 4 = 1 UNION ALL SELECT doc_id, 'embedded_files' FROM documents WHERE doc_id % 5 = 0""")


def _clean_sql(asked):
    counts = ", ".join((f"count_if(cat = '{c}')::BIGINT" if c in asked else "0::BIGINT") + f" AS {c}" for c in U.CLEAN_COUNTS)
    wanted = ", ".join(f"'{c}'" for c in asked)
    rows = "documents d LEFT JOIN removable r USING (doc_id)"
    return f"SELECT doc_id, {counts}, count_if(cat IN ({wanted})) = 0 AS is_empty FROM {rows} GROUP BY doc_id UNION ALL SELECT NULL, {counts}, count_if(cat IN ({wanted})) = 0 FROM {rows}"


def _clean(v, options):
    docs = v.table("documents", "doc_id", "n_chars")
    subtype = F.element_at(F.array(*[F.lit(x) for x in _SUBTYPES]), ((F.col("conv_id") + F.col("turn") * 3) % len(_SUBTYPES) + 1).cast("int"))
    value = F.when(F.size("value") > 0, F.array_join("value", ";"))
    default = F.when((F.col("name") == "sign") & (F.col("doc_id") % 2 == 0), "Off")
    tables = {
        "annotations": v.table("conversations", "conv_id", "turn").select(F.col("conv_id").alias("doc_id"), subtype.alias("subtype")),
        "fields": v.fields().select("doc_id", value.alias("value"), default.alias("default_value")), "outline": v.outline(), "runs": v.runs(),
        "info": docs.filter("doc_id % 4 > 0").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("doc_id") % 4)).alias("key")),
        "xmp": docs.filter("doc_id % 4 = 1"), "embedded_files": docs.filter("doc_id % 5 = 0"),
    }
    return U.clean_documents(docs, tables, options)


@query("clean_documents", "A10", _clean_sql(U.CLEAN_COUNTS), "removable")
def clean_documents(v):
    return _clean(v, U.CleanOptions(*[True] * 7))


@query("clean_some", "A10", _clean_sql(["info_keys", "xmp_packets", "embedded_files"]), "removable")
def clean_some(v):
    return _clean(v, U.CleanOptions(metadata=True, embedded_files=True))


SQL_VIEWS["reasons"] = (("images",), """
    SELECT *, CASE WHEN NOT is_image THEN 'NotAnImage' WHEN masked THEN 'Masked' WHEN filter = 'JPXDecode' THEN 'Jpeg2000' WHEN coalesce(bits, 8) = 1 THEN 'Bilevel'
      WHEN coalesce(bits, 8) <> 8 THEN 'BitDepth' WHEN width_px * height_px < 4096 THEN 'TooSmall' WHEN color_space IN ('Indexed', 'DeviceCMYK') THEN 'ColourSpace' END AS reason FROM images""")
SQL_VIEWS["packed"] = (("images",), """
    SELECT *, CASE WHEN reason IS NULL AND new_bytes < n_bytes THEN true ELSE false END AS replaced, CASE WHEN width_px / (page_width / 72) > 200 AND round(200 * page_width / 72) < width_px
        THEN CAST(round(200 * page_width / 72) AS BIGINT) END AS new_width FROM (
      SELECT *, CASE WHEN NOT is_image THEN 'NotAnImage' WHEN masked THEN 'Masked' WHEN filter = 'JPXDecode' THEN 'Jpeg2000' WHEN coalesce(bits, 8) = 1 THEN 'Bilevel'
        WHEN coalesce(bits, 8) <> 8 THEN 'BitDepth' WHEN width_px * height_px < 4096 THEN 'TooSmall' WHEN color_space IN ('Indexed', 'DeviceCMYK') THEN 'ColourSpace' END AS reason FROM (
        SELECT doc_id, object_id, min(page_width) AS page_width, max(width_px) AS width_px, max(height_px) AS height_px, max(bits) AS bits, min(color_space) AS color_space, max(filter) AS filter,
          bool_or(masked) AS masked, bool_and(is_image) AS is_image, max(n_bytes) AS n_bytes, max(new_bytes) AS new_bytes FROM images GROUP BY ALL))""")
SQL_VIEWS["savings"] = (("packed",), """
    SELECT doc_id, images, CASE WHEN a < b THEN r ELSE 0 END AS recompressed, images - CASE WHEN a < b THEN r ELSE 0 END AS untouched, b AS before_bytes, least(a, b) AS after_bytes, greatest(b - a, 0) AS saved_bytes
    FROM (SELECT doc_id, count(*) AS images, count_if(replaced)::BIGINT AS r, sum(n_bytes)::BIGINT AS b, sum(CASE WHEN replaced THEN new_bytes ELSE n_bytes END)::BIGINT AS a FROM packed GROUP BY doc_id)""")


@query("image_eligibility", "P9", "SELECT doc_id, page_no, object_id, reason FROM reasons", "reasons")
def image_eligibility(v):
    return R.image_eligibility(v.images()).select("doc_id", "page_no", "object_id", "reason")


@query("compress_images", "A11", "SELECT doc_id, object_id, reason, new_width, replaced FROM packed", "packed")
def compress_images(v):
    return R.compress_images(v.images(), "medium").select("doc_id", "object_id", "reason", "new_width", "replaced")


@query("compress_report", "A11", "SELECT * FROM savings", "savings")
def compress_report(v):
    return R.compress_report(R.compress_images(v.images(), "medium"))


@query("largest_savings", "O5", "SELECT doc_id, saved_bytes FROM savings ORDER BY saved_bytes DESC, doc_id LIMIT 20", "savings")
def largest_savings(v):
    return R.largest_savings(R.compress_report(R.compress_images(v.images(), "medium")), 20).select("doc_id", "saved_bytes")


@query("visible_runs", "P6", "SELECT doc_id, page_no, count(*) AS runs FROM runs WHERE render_mode NOT IN (3, 7) GROUP BY ALL", "runs")
def visible_runs(v):
    return R.drop_hidden_runs(v.runs()).groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("runs"))


@query("hidden_run_counts", "P6", "SELECT doc_id, count_if(render_mode IN (3, 7))::BIGINT AS hidden, count(*) AS runs FROM runs GROUP BY doc_id", "runs")
def hidden_run_counts(v):
    return R.hidden_run_counts(v.runs())


@query("clean_report", "A10", """
    WITH c AS (SELECT doc_id, 'comments' AS cat FROM annotations WHERE kind <> 'measure' UNION ALL SELECT doc_id, 'bookmarks' FROM outline
               UNION ALL SELECT doc_id, 'form_values' FROM fields WHERE len(value) > 0 UNION ALL SELECT doc_id, 'hidden_text' FROM runs WHERE render_mode IN (3, 7)
               UNION ALL SELECT doc_id, 'metadata' FROM documents WHERE doc_id % 2 = 0)
    SELECT doc_id, count_if(cat = 'comments')::BIGINT AS comments, 0::BIGINT AS attachments, count_if(cat = 'bookmarks')::BIGINT AS bookmarks, count_if(cat = 'form_values')::BIGINT AS form_values,
      0::BIGINT AS embedded_files, count_if(cat = 'hidden_text')::BIGINT AS hidden_text, count_if(cat = 'metadata')::BIGINT AS metadata, 0::BIGINT AS xmp, false AS is_empty
    FROM c GROUP BY doc_id""", "annotations outline fields runs")
def clean_report(v):
    parts = {
        "comments": v.annotations().filter("kind <> 'measure'"), "bookmarks": v.outline(), "form_values": v.fields().filter("size(value) > 0"),
        "hidden_text": v.runs().filter(F.col("render_mode").isin(3, 7)), "metadata": v.table("documents", "doc_id").filter("doc_id % 2 = 0"),
    }
    return R.clean_report(parts, list(parts))


@query("confident_words", "P4", "SELECT doc_id, page_no, count(*) AS words FROM ocr_words WHERE confidence >= 0.5 GROUP BY ALL", "ocr_words")
def confident_words(v):
    return R.confident_words(v.ocr_words()).groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("words"))


@query("ocr_summary", "A8", """
    SELECT doc_id, count(DISTINCT page_no) AS pages, count_if(confidence >= 0.5)::BIGINT AS kept, count_if(confidence < 0.5)::BIGINT AS skipped FROM ocr_words GROUP BY doc_id""", "ocr_words")
def ocr_summary(v):
    return R.ocr_summary(v.ocr_words())


@query("ocr_page_text", "T17", "SELECT doc_id, page_no, sha256(string_agg(text, ' ' ORDER BY word_no)) AS digest FROM ocr_words WHERE confidence >= 0.5 GROUP BY ALL", "ocr_words")
def ocr_page_text(v):
    return R.ocr_page_text(R.confident_words(v.ocr_words())).select("doc_id", "page_no", F.sha2("text", 256).alias("digest"))


@query("place_ocr_words", "T16", """
    WITH w AS (SELECT w.*, p.width, p.height, "left" / 2 - 400 AS dx, bottom / 2 - 500 AS dy, radians(-((w.doc_id % 5) - 2)) AS a FROM ocr_words w JOIN doc_pages p USING (doc_id, page_no))
    SELECT doc_id, page_no, count(*) AS words, round(sum((dx * cos(a) + dy * sin(a) + 400) * width / 800), 3) AS x, round(sum(height - (-dx * sin(a) + dy * cos(a) + 500) * height / 1000), 3) AS y,
      round(sum(("right" - "left") / 2 * width / 800), 3) AS w, round(sum((bottom - top) / 2 * height / 1000), 3) AS h FROM w GROUP BY doc_id, page_no""", "ocr_words doc_pages")
def place_ocr_words(v):
    scans = v.page_keys().select(
        "doc_id", "page_no", "width", "height", F.lit(800.0).alias("scan_width"), F.lit(1000.0).alias("scan_height"), F.lit(2.0).alias("scale"),
        ((F.col("doc_id") % 5) - 2).cast("double").alias("skew_degrees"),
    )
    p = R.place_ocr_words(v.ocr_words(), scans)
    return p.groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("words"), *[F.round(F.sum(c), 3).alias(c) for c in ("x", "y", "w", "h")])


@query("validate_links", "P7", """
    SELECT page_id, seq::BIGINT AS seq, kind, CASE WHEN trim(value) = '' THEN 'Enter a value.' WHEN kind = 'url' AND NOT regexp_matches(value, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN 'URL needs a scheme, e.g. https://'
      WHEN kind = 'email' THEN 'Enter a valid email address.' WHEN kind = 'page' AND seq + 1 > 4 THEN 'Page must be between 1 and 4.' END AS reason,
      CASE kind WHEN 'page' THEN CASE WHEN seq + 1 <= 4 THEN seq::VARCHAR END WHEN 'named' THEN value WHEN 'url' THEN CASE WHEN seq % 2 = 0 THEN value END END AS wire FROM (
      SELECT page_id, seq, ['url', 'email', 'page', 'named'][(page_id + seq) % 4 + 1] AS kind, CASE (page_id + seq) % 4 WHEN 2 THEN ' ' || (seq + 1) || ' ' WHEN 0 THEN CASE WHEN seq % 2 = 0 THEN 'https://h' || href ELSE href END ELSE href END AS value FROM hrefs)""", "hrefs")
def validate_links(v):
    k = (F.col("page_id") + F.col("seq")) % 4
    kind = F.element_at(F.array(*[F.lit(x) for x in ("url", "email", "page", "named")]), (k + 1).cast("int"))
    value = F.when(k == 2, F.concat(F.lit(" "), F.col("seq") + 1, F.lit(" "))).when((k == 0) & (F.col("seq") % 2 == 0), F.concat(F.lit("https://h"), "href")).otherwise(F.col("href"))
    h = v.hrefs().select("page_id", F.col("seq").cast("long").alias("seq"), kind.alias("kind"), value.alias("value"), F.lit(4).cast("long").alias("page_count"))
    return R.validate_links(h).select("page_id", "seq", "kind", "reason", "wire")


# -- regions --------------------------------------------------------------------------------


def _regions(v):
    p = v.page_keys().select("doc_id", "page_no")
    r = lambda n, x0, y0, x1, y1: F.struct(F.lit(n).cast("long").alias("region_no"), *[F.lit(float(c)).alias(k) for k, c in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1))])
    return p.select("doc_id", "page_no", F.inline(F.array(r(0, 100, 130, 181, 200), r(1, 160, 190, 260, 215))))


SQL_VIEWS["verdicts"] = (("runs",), """
    WITH g AS (SELECT doc_id, page_no, run_no, text, top, bottom, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS i, "left" FROM runs),
    a AS (SELECT *, bottom >= 130 AND top <= 200 AND "left" + i * 6 + 6 > 100 AND "left" + i * 6 < 181 AS hit FROM g),
    f AS (SELECT doc_id, page_no, run_no, text, any_value(top) AS top, any_value(bottom) AS bottom, any_value("left") AS "left", coalesce(string_agg(CASE WHEN NOT hit THEN c END, '' ORDER BY i), '') AS k FROM a GROUP BY ALL),
    s AS (SELECT *, CASE WHEN k = text THEN 'keep' WHEN k = '' THEN 'remove' WHEN starts_with(text, k) THEN 'split' ELSE 'unmeasurable' END AS v1,
                 CASE WHEN k = text OR starts_with(text, k) THEN k ELSE '' END AS t1 FROM f),
    g2 AS (SELECT *, CASE WHEN t1 = '' OR bottom < 190 OR top > 215 THEN t1 ELSE coalesce(list_aggregate([t1[j + 1] FOR j IN range(0, length(t1)) IF NOT ("left" + j * 6 + 6 > 160 AND "left" + j * 6 < 260)], 'string_agg', ''), '') END AS k2 FROM s)
    SELECT doc_id, page_no, run_no, CASE WHEN k2 = t1 THEN v1 WHEN k2 = '' THEN 'remove' WHEN starts_with(t1, k2) THEN 'split' ELSE 'unmeasurable' END AS verdict,
           CASE WHEN k2 = t1 OR starts_with(t1, k2) THEN k2 ELSE '' END AS kept_text FROM g2""")


@query("redact_region", "D7", "SELECT doc_id, page_no, run_no, verdict, kept_text FROM verdicts WHERE verdict <> 'keep'", "verdicts")
def redact_region(v):
    out = D.redact_region(v.runs(), _regions(v))
    return out.select("doc_id", "page_no", "run_no", "verdict", "kept_text").filter("verdict <> 'keep'")


@query("redact_report", "D7", """
    SELECT v.doc_id, count_if(verdict = 'remove')::BIGINT AS removed, count_if(verdict = 'split')::BIGINT AS split, count_if(verdict = 'unmeasurable')::BIGINT AS removed_for_safety, any_value(coalesce(n, 0)) AS images
    FROM verdicts v LEFT JOIN (SELECT doc_id, count(*) AS n FROM doc_pages WHERE page_no % 2 = 0 GROUP BY doc_id) i USING (doc_id) GROUP BY v.doc_id""", "verdicts doc_pages")
def redact_report(v):
    even = F.col("page_no") % 2 == 0
    # On odd pages the picture only touches the second region.
    images = v.page_keys().select("doc_id", "page_no", F.when(even, 250.0).otherwise(260.0).alias("left"), F.lit(400.0).alias("right"), F.lit(195.0).alias("top"), F.lit(300.0).alias("bottom"))
    r = _regions(v)
    return D.redact_report(D.redact_region(v.runs(), r), D.images_in_region(images, r))


@query("match_boxes", "D8", """
    SELECT doc_id, page_no, run_no, "left" + 6 * k AS x0, top AS y0, "left" + 6 * (k + 2) AS x1, bottom AS y1 FROM (
      SELECT *, unnest([list_sum([length(x) FOR x IN s[1:i]]) + 2 * (i - 1) FOR i IN range(1, len(s))]) AS k FROM (SELECT *, string_split(text, 'qu') AS s FROM runs WHERE contains(text, 'qu')))""", "runs")
def match_boxes(v):
    runs = v.runs().filter(F.contains("text", F.lit("qu")))
    hit = each(runs, ["doc_id", "page_no", "run_no", "text", "left", "right", "top", "bottom"], spans("text", "qu"), "_s")
    return hit.withColumn("_b", D.sub_rect(F.col("_s.start"), F.col("_s.end"))).select("doc_id", "page_no", "run_no", "_b.x0", "_b.y0", "_b.x1", "_b.y1")


# -- retrieval --------------------------------------------------------------------------------


@query("chunk_text", "F24", """
    SELECT doc_id, page_no, (i // 700)::BIGINT AS chunk_no, i AS "start", least(i + 800, length(text)) AS "end", sha256(substr(text, i + 1, 800)) AS digest
    FROM (SELECT doc_id, page_no, text, unnest(range(0, greatest(length(text) - 100, 1), 700)) AS i FROM doc_pages WHERE text <> '')""", "doc_pages")
def chunk_text(v):
    c = K.chunk_text(v.doc_pages().select("doc_id", "page_no", "text"))
    return c.select("doc_id", "page_no", "chunk_no", "start", "end", F.sha2("chunk", 256).alias("digest"))


_QUESTIONS = [[math.cos(0.1 * (i + 1) * (j + 1)) for i in range(64)] for j in range(3)]
SQL_VIEWS["nearest"] = ((), f"""
    SELECT * FROM (SELECT q::BIGINT AS question, vec_id, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) AS rank FROM (
      SELECT q, vec_id, list_cosine_similarity(embedding::DOUBLE[], v) AS sim FROM embeddings, (SELECT unnest([0, 1, 2]) AS q, unnest({_QUESTIONS!r}::DOUBLE[][]) AS v))) WHERE rank <= 5""")


@query("knn", "O4", "SELECT question, vec_id, round(sim, 6) AS similarity, rank FROM nearest", "nearest")
def knn(v):
    return K.knn(v.table("embeddings", "vec_id", "embedding"), _QUESTIONS).withColumn("similarity", F.round("similarity", 6))


@query("cite_chunks", "J12", """
    SELECT question, vec_id, rank, chunk_no, page_no, "start", '[doc ' || doc_id || ', p. ' || (page_no + 1) || ']' AS citation FROM nearest JOIN (
      SELECT doc_id, page_no, (i // 700)::BIGINT AS chunk_no, i AS "start" FROM (SELECT doc_id, page_no, unnest(range(0, greatest(length(text) - 100, 1), 700)) AS i FROM doc_pages WHERE text <> '')) ON doc_id = vec_id""", "nearest doc_pages")
def cite_chunks(v):
    top = K.knn(v.table("embeddings", "vec_id", "embedding"), _QUESTIONS)
    chunks = K.chunk_text(v.doc_pages().select("doc_id", "page_no", "text")).withColumn("vec_id", F.col("doc_id"))
    return K.cite_chunks(top, chunks, "vec_id").select("question", "vec_id", "rank", "chunk_no", "page_no", "start", "citation")


@query("key_value_pairs", "D9", """
    SELECT c_custkey AS doc_id, i::BIGINT AS line_no, k AS key, x AS value FROM customer, LATERAL (VALUES (0, 'Name', c_name), (2, 'Market segment', c_mktsegment || ' : yes'), (4, 'Key', c_custkey::VARCHAR)) t(i, k, x)""")
def key_value_pairs(v):
    c = F.concat(
        F.lit("Name: "), "c_name", F.lit("\nno pair here\n  Market segment :  "), "c_mktsegment", F.lit(" : yes  \nhttp://x.example\nKey: "), "c_custkey", F.lit("\n: none\nempty: ")
    )
    return K.key_value_pairs(v.table("customer").select(F.col("c_custkey").alias("doc_id"), c.alias("text")))
