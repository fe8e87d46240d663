"""Comments: filters, threads, interchange, geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import each
from ..functions.text import parse_floats, xml_unescape
from .hierarchy import pointer_roots
from .scan import block_of, dense_index
from .tables import xml_escape

# Labels of the annotation kinds, in display order.
KIND_LABELS = {
    "highlight": "Highlight", "underline": "Underline", "strikeout": "Strikethrough", "squiggly": "Squiggly",
    "note": "Note", "freetext": "Free text", "rectangle": "Rectangle", "ellipse": "Ellipse", "line": "Line",
    "polygon": "Polygon", "polyline": "Polyline", "ink": "Ink", "stamp": "Stamp", "measure": "Measurement",
}

# Annotation subtype -> kind, and kind -> interchange element.
SUBTYPE_KINDS = {
    "Highlight": "highlight", "Underline": "underline", "StrikeOut": "strikeout", "Squiggly": "squiggly", "Text": "note",
    "FreeText": "freetext", "Square": "rectangle", "Circle": "ellipse", "Line": "line", "Polygon": "polygon",
    "PolyLine": "polyline", "Ink": "ink", "Stamp": "stamp",
}
KIND_ELEMENTS = {
    "highlight": "highlight", "underline": "underline", "strikeout": "strikeout", "squiggly": "squiggly", "note": "text",
    "freetext": "freetext", "rectangle": "square", "ellipse": "circle", "line": "line", "polyline": "polyline",
    "polygon": "polygon", "ink": "ink", "stamp": "stamp",
}
MEASURE_INTENTS = ["LineDimension", "PolyLineDimension", "PolygonDimension"]
DAY_MS = 86_400_000


def lookup(col: Column, table: dict[str, str]) -> Column:
    """A fixed table as one expression, so no join is planned."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), col)


def annotation_kind(df: DataFrame) -> DataFrame:
    """``kind`` from ``subtype`` and ``intent``; other subtypes are left out."""
    base = lookup(F.col("subtype"), SUBTYPE_KINDS)
    kind = F.when(F.col("intent").isin(*MEASURE_INTENTS), F.lit("measure")).otherwise(base)
    return df.filter(F.col("subtype").isin(*SUBTYPE_KINDS)).withColumn("kind", kind)


def filter_annotations(
    df: DataFrame, search: str = "", kinds: list[str] | None = None, author: str | None = None, modified_after: int | None = None
) -> DataFrame:
    """Every given condition must hold; an unset one is no condition. A null date fails a date filter."""
    out = df
    if kinds:
        out = out.filter(F.col("kind").isin(*kinds))
    if author is not None:
        out = out.filter(F.col("author") == author)
    if modified_after is not None:
        out = out.filter(F.col("modified") >= modified_after)
    needle = search.strip().lower()
    if needle:
        hay = F.lower(F.concat_ws(" ", "contents", "author", lookup(F.col("kind"), KIND_LABELS)))
        out = out.filter(F.contains(hay, F.lit(needle)))
    return out


def group_by_page(df: DataFrame) -> DataFrame:
    """Position of each annotation within its page, in input order; a hot page is not gathered."""
    return dense_index(df, ["doc_id", "page"], block_of("seq"), [F.col("seq")], "item_no")


def distinct_authors(df: DataFrame) -> DataFrame:
    return df.filter(F.col("author") != "").select("doc_id", "author").distinct()


def distinct_kinds(df: DataFrame) -> DataFrame:
    """Per document, the kinds present in display order (at most the fixed list)."""
    order = F.array(*[F.lit(k) for k in KIND_LABELS])
    return df.groupBy("doc_id").agg(F.array_intersect(order, F.collect_set("kind")).alias("kinds"))


def build_threads(df: DataFrame) -> DataFrame:
    """Add ``root_id`` and, for replies, ``reply_no`` by date (null dates first, then input order)."""
    roots = pointer_roots(df, "doc_id", "id", "in_reply_to").withColumnRenamed("root", "root_id")
    j = df.join(roots, ["doc_id", "id"])
    is_reply = F.col("root_id") != F.col("id")
    when = F.coalesce("modified", F.lit(0))
    replies = dense_index(j.filter(is_reply).withColumn("_w", when), ["doc_id", "root_id"], block_of("_w", DAY_MS), [F.col("_w"), F.col("seq")], "reply_no")
    return j.filter(~is_reply).withColumn("reply_no", F.lit(None).cast("long")).unionByName(replies.drop("_w"))


def import_replies(existing: DataFrame, incoming: DataFrame, page_counts: DataFrame) -> DataFrame:
    """The incoming annotations that can be added: tops on a real page, and replies whose chain
    reaches an existing annotation or an added top. Cycles and broken chains are left out.
    """
    names = existing.select("doc_id", F.col("id").alias("in_reply_to"), F.lit(True).alias("_old")).distinct()
    j = incoming.join(names, ["doc_id", "in_reply_to"], "left").join(page_counts, "doc_id", "left")
    top = F.col("in_reply_to").isNull()
    on_page = F.coalesce((F.col("page") >= 0) & (F.col("page") < F.col("page_count")), F.lit(False))
    base = j.withColumn("_ok", F.when(top, on_page).otherwise(F.coalesce("_old", F.lit(False))))
    # A reply to an existing annotation needs no other incoming one: it ends its chain.
    linked = base.withColumn("_up", F.when(F.col("_old").isNull(), F.col("in_reply_to")))
    roots = pointer_roots(linked, "doc_id", "id", "_up")
    ok = base.filter("_ok").select("doc_id", F.col("id").alias("root"))
    good = roots.join(ok, ["doc_id", "root"], "left_semi").select("doc_id", "id")
    return incoming.join(good, ["doc_id", "id"], "left_semi")


# -- interchange -----------------------------------------------------------------------


def _attr(source: Column, name: str) -> Column:
    found = F.regexp_extract(source, rf"(?s)(?:^|\s){name}\s*=\s*(\"[^\"]*\"|'[^']*')", 1)
    return F.when(found != "", xml_unescape(F.substring(found, F.lit(2), F.length(found) - 2)))


def parse_xfdf_annotations(df: DataFrame, xml: str = "xml") -> DataFrame:
    """One row per annotation element of each document's interchange text, in order."""
    tags = "|".join(dict.fromkeys(KIND_ELEMENTS.values()))
    whole = rf"(?s)<(?:{tags})\b[^>]*?/>|<({tags})\b[^>]*>.*?</\1>"
    body = F.regexp_extract(F.col(xml), r"(?s)<annots>(.*)</annots>", 1)
    keep = [c for c in df.columns if c != xml]
    e = each(df, keep, F.regexp_extract_all(body, F.lit(whole), F.lit(0)), "_el", "seq")
    head = F.regexp_extract("_el", r"(?s)^<[a-z]+([^>]*?)/?>", 1)
    inner = lambda t: xml_unescape(F.regexp_extract("_el", rf"(?s)<{t}(?:\s[^>]*)?>(.*?)</{t}>", 1))
    arrow = lambda c: F.coalesce((F.lower(c) != "none") & (c != ""), F.lit(False))
    a = e.withColumn("_h", head)
    floats = lambda n: parse_floats(F.coalesce(_attr(F.col("_h"), n), F.lit("")))
    rect = floats("rect")
    return a.select(
        *keep, F.col("seq").cast("long").alias("seq"), F.regexp_extract("_el", "^<([a-z]+)", 1).alias("element"),
        F.coalesce(F.trim(_attr(F.col("_h"), "page")).try_cast("long"), F.lit(0)).alias("page"),
        F.when(F.size(rect) >= 4, F.slice(rect, 1, 4)).otherwise(F.array_repeat(F.lit(0.0), 4)).alias("rect"),
        floats("coords").alias("coords"), floats("vertices").alias("vertices"),
        F.concat(floats("start"), floats("end")).alias("line"), parse_floats(inner("gesture")).alias("gesture"),
        (arrow(_attr(F.col("_h"), "head")) | arrow(_attr(F.col("_h"), "tail"))).alias("arrow"),
        _attr(F.col("_h"), "IT").alias("intent"), _attr(F.col("_h"), "icon").alias("icon"),
        _attr(F.col("_h"), "color").alias("color"), _attr(F.col("_h"), "opacity").try_cast("double").alias("opacity"),
        _attr(F.col("_h"), "width").try_cast("double").alias("width"), _attr(F.col("_h"), "name").alias("name"),
        F.coalesce(_attr(F.col("_h"), "title"), F.lit("")).alias("author"), inner("contents").alias("contents"),
        _attr(F.col("_h"), "date").alias("date"), _attr(F.col("_h"), "inreplyto").alias("in_reply_to"),
    )


def xfdf_element(df: DataFrame) -> Column:
    """One annotation row as an interchange element."""
    el = lookup(F.col("kind"), KIND_ELEMENTS)
    attr = lambda n, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f' {n}="'), xml_escape(F.col(c).cast("string")), F.lit('"'))).otherwise("")
    cols = {"page": "page", "rect": "rect", "title": "author", "name": "id", "date": "date", "inreplyto": "in_reply_to"}
    return F.concat(
        F.lit("<"), el, *[attr(n, c) for n, c in cols.items() if c in df.columns], F.lit("><contents>"),
        xml_escape(F.col("contents")), F.lit("</contents></"), el, F.lit(">"),
    )


#: What stands before, between and after the elements of an interchange file.
XFDF_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<xfdf xmlns="http://ns.adobe.com/xfdf/" xml:space="preserve">\n<annots>\n'
XFDF_BETWEEN, XFDF_TAIL = "\n", "\n</annots>\n</xfdf>\n"


def xfdf_elements(df: DataFrame) -> DataFrame:
    """``(doc_id, page, seq, element)`` of the annotations whose kind has an element."""
    return df.filter(F.col("kind").isin(*KIND_ELEMENTS)).select("doc_id", "page", "seq", xfdf_element(df).alias("element"))


def annotations_to_xfdf(df: DataFrame) -> DataFrame:
    """Interchange text per document and page: ``annots`` lines in input order, and their count.

    One page's elements make one output row; :func:`xfdf_document` wraps a document's pages.
    """
    g = xfdf_elements(df).groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("seq", "element"))).alias("_e"), F.count(F.lit(1)).alias("written"))
    return g.select("doc_id", "page", F.array_join(F.col("_e.element"), XFDF_BETWEEN).alias("annots"), "written")


def xfdf_document(pages: DataFrame) -> DataFrame:
    """One file per document: pages in order, and how many annotations were written."""
    g = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "annots"))).alias("_p"), F.sum("written").alias("written"))
    xml = F.concat(F.lit(XFDF_HEAD), F.array_join(F.col("_p.annots"), XFDF_BETWEEN), F.lit(XFDF_TAIL))
    return g.select("doc_id", xml.alias("xml"), "written")


# -- geometry --------------------------------------------------------------------------------


def quads_bounds(rects: DataFrame, keys: list[str]) -> DataFrame:
    """Bounding box of the rectangles wider and higher than half a point."""
    kept = rects.filter((F.col("right") - F.col("left") > 0.5) & (F.col("bottom") - F.col("top") > 0.5))
    return kept.groupBy(*keys).agg(F.min("left").alias("x0"), F.min("top").alias("y0"), F.max("right").alias("x1"), F.max("bottom").alias("y1"))


def calibration(reference_points: float, real_length: float) -> float:
    """Units per point; a reference of no length leaves 1:1."""
    return 1.0 if reference_points <= 0 else real_length / reference_points


def measure(points: Column, kind: str, units_per_point: float = 1.0) -> Column:
    """``points`` is an array of ``struct<x,y>``: distance, perimeter or area in real units."""
    seg = lambda a, b: F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2))
    n = F.size(points)
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)
    if kind == "distance":
        value = F.when(n < 2, 0.0).otherwise(seg(F.get(points, F.lit(0)), F.element_at(points, -1)))
        return value * units_per_point
    if kind == "perimeter":
        steps = F.transform(points, lambda p, i: F.when(i == 0, 0.0).otherwise(seg(F.get(points, i - 1), p)))
        return total(steps) * units_per_point
    if kind == "area":
        cross = F.transform(points, lambda p, i: p["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * p["y"])
        return F.when(n < 3, 0.0).otherwise(F.abs(total(cross)) / 2) * units_per_point * units_per_point
    raise ValueError(f"unknown measure: {kind}")


def format_measurement(kind: str, value: Column, unit: str) -> Column:
    """Two decimals at most, no trailing zeros, squared unit for an area."""
    from ..functions.numbering import number_text

    return F.concat(number_text(F.floor(value * 100 + 0.5) / 100), F.lit(" " + unit + ("²" if kind == "area" else "")))


# -- signatures -------------------------------------------------------------------------------

# All wording of signature reports, by the code of what was found.
SIGNATURE_TEXTS = {
    "unnamed": "an unnamed certificate",
    "problems": "This signature could not be checked",
    "broken": "This signature's certificate has been altered",
    "broken_note": "Whatever name it shows cannot be relied on.",
    "mismatch": "This signature is not valid",
    "mismatch_note": "The signature doesn't match the certificate attached to it.",
    "changed": "The document changed after {} signed it",
    "changed_note": "The signature itself is intact — it is the document that no longer matches.",
    "signed": "Signed by {}",
    "partial_note": "The file was changed after this signature — by a later edit or another signature. Everything this signature covers is still intact.",
    "expired_note": "The certificate has expired. That does not undo the signature, but nobody is standing behind the certificate now.",
    "level_1_note": "Certified: no changes were meant to be made after signing.",
    "level_2_note": "Certified: only form filling and further signatures were meant to be allowed.",
    "level_3_note": "Certified: form filling, comments and further signatures were meant to be allowed.",
    "level_other_note": "Certified at an unrecognised level ({}).",
    "all_intact": "{} signatures, all intact",
    "some_bad": "{} signatures, {} needing attention",
}
# What each state of a certificate chain means to a reader.
CHAIN_NOTES = {
    "selfSigned": "The certificate vouches for itself — nobody else has verified it.",
    "issuerNotChecked": "Issued by another certificate, which can't be checked against any trust list.",
    "incomplete": "The document doesn't include the certificates needed to follow the chain.",
    "broken": "A certificate doesn't match the key that supposedly issued it.",
}
SEVERITIES = {"problems": "invalid", "broken": "invalid", "mismatch": "invalid", "changed": "invalid", "partial": "warning", "expired": "warning", "signed": "valid"}


def _worded(code: str, *values: Column) -> Column:
    """The text of ``code`` with its gaps filled."""
    parts = SIGNATURE_TEXTS[code].split("{}")
    filled = [x for k, part in enumerate(parts) for x in (F.lit(part), *values[k : k + 1])]
    return F.concat(*[x.cast("string") for x in filled])


def signature_reason(df: DataFrame) -> Column:
    """The code of the worst finding."""
    found = {
        "problems": F.size("problems") > 0, "broken": F.col("chain") == "broken", "mismatch": ~F.col("signature_valid"), "changed": ~F.col("digest_matches"),
        "partial": ~F.col("covers_whole"), "expired": F.col("expired"),
    }
    return F.coalesce(*[F.when(test, code) for code, test in found.items()], F.lit("signed"))


def signature_status(df: DataFrame, chain_notes: dict[str, str] = CHAIN_NOTES) -> DataFrame:
    """Add ``severity``, ``headline`` and ``notes``; the worst finding decides."""
    reason, chain, level = signature_reason(df), lookup(F.col("chain"), chain_notes), F.col("level")
    who = F.coalesce(F.nullif("signer", F.lit("")), F.lit(SIGNATURE_TEXTS["unnamed"]))
    headlines = {"problems": _worded("problems"), "broken": _worded("broken"), "mismatch": _worded("mismatch"), "changed": _worded("changed", who)}
    headline = F.coalesce(*[F.when(reason == code, text) for code, text in headlines.items()], _worded("signed", who))
    certified = F.coalesce(*[F.when(level == k, _worded(f"level_{k}_note")) for k in (1, 2, 3)], F.when(level.isNotNull(), _worded("level_other_note", level)))
    sound = F.array_compact(F.array(F.when(~F.col("covers_whole"), _worded("partial_note")), F.when(F.col("expired"), _worded("expired_note")), certified, chain))
    notes = {
        "problems": F.col("problems"), "broken": F.array(chain, _worded("broken_note")), "mismatch": F.array(_worded("mismatch_note"), chain),
        "changed": F.array(_worded("changed_note"), chain),
    }
    return df.withColumns({
        "severity": lookup(reason, SEVERITIES), "headline": headline,
        "notes": F.coalesce(*[F.when(reason == code, text) for code, text in notes.items()], sound),
    })


def signature_intact(df: DataFrame) -> DataFrame:
    return df.withColumn("intact", F.col("signature_valid") & F.col("digest_matches") & (F.size("problems") == 0))


def document_signature_status(status: DataFrame) -> DataFrame:
    """One line per signed document: the worst severity and a headline."""
    rank = F.array_position(F.array(F.lit("valid"), F.lit("warning"), F.lit("invalid")), F.col("severity"))
    g = status.groupBy("doc_id").agg(
        F.max(rank).alias("_w"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") != "valid").alias("bad"), F.max("headline").alias("_one")
    )
    worst = F.element_at(F.array(F.lit("valid"), F.lit("warning"), F.lit("invalid")), F.col("_w").cast("int"))
    line = (
        F.when(F.col("n") == 1, F.col("_one"))
        .when(F.col("bad") == 0, _worded("all_intact", F.col("n")))
        .otherwise(_worded("some_bad", F.col("n"), F.col("bad")))
    )
    return g.select("doc_id", worst.alias("severity"), line.alias("headline"), "n", "bad")
