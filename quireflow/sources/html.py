"""HTML pages as rows: tokens, flat text, nesting, blocks, lists, tables, resources.

A page is cut into tokens by one regular expression in the JVM; everything after that is
column work over tokens. Only table slots, which depend on every earlier row of the
same table, are assigned in a grouped function.
"""

from __future__ import annotations

import html.entities
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import each, let
from ..functions.numbering import list_marker
from ..functions.text import CP1252_HIGH, _LATIN1_HIGH, percent_decode, scheme

# Tag groups.
RAW_TEXT = ["script", "style", "textarea", "title", "xmp", "noembed", "noframes"]
NOT_NESTING = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "p",
    "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "option", "optgroup", "colgroup", "caption", "rb", "rt",
    "rp", "html", "head",
]
# What of these is left open ends where the next one starts, so a list counts for itself and the one item open in it, a table for its body, row and cell too.
HOLDERS = ["ul", "ol", "menu", "dir", "dl"]
FLAT_BREAKS = [
    "p", "div", "br", "li", "tr", "td", "th", "table", "ul", "ol", "dl", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6",
    "blockquote",
]
VOID = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
]
DROPPED = [
    "head", "script", "style", "template", "title", "meta", "link", "base", "noembed", "param", "source", "track", "area",
    "map", "datalist", "option", "optgroup",
]
EMBEDDED = [
    "svg", "canvas", "video", "audio", "iframe", "object", "embed", "math", "frame", "frameset", "applet",
]
FORMS = ["input", "select", "textarea"]
BLOCKS = [
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup",
    "hr", "html", "legend", "li", "listing", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
]
MAX_DEPTH = 200
IMAGE_LIMIT, STYLESHEET_LIMIT = 64 << 20, 4 << 20

WARN_EMBEDDED = "embedded media were left out"
WARN_FORMS = "form fields were left out"
WARN_DEPTH = "very deeply nested content was flattened to plain text"

_RAW = "|".join(RAW_TEXT)
_TOKEN = (
    r"(?is)<!--.*?(?:-->|\z)"
    rf"|<({_RAW})(?![a-z0-9-])(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1[^>]*>|\z)"
    r"|</?[a-z](?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>|<[!?][^>]*(?:>|\z)|[^<]+|<"
)
_NEST = (
    r"(?is)<!--.*?(?:-->|\z)"
    rf"|<({_RAW})(?![a-z0-9-])[^>]*>.*?(?=</\1|\z)"
    r"|</?[a-z][^>]*(?:>|\z)|<[!?][^>]*(?:>|\z)"
)


def _tag(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"^</?([A-Za-z][A-Za-z0-9-]*)", 1))


def attr(token: Column, name: str) -> Column:
    """An attribute's value, entities decoded; null when absent."""
    found = F.regexp_extract(token, rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    bare = F.regexp_replace(found, r"^[\"']|[\"']\z", "")
    return F.when(found != "", decode_entities(bare, every_name=False))


def decode_entities(text: Column, every_name: bool = True) -> Column:
    """Named and numeric character references that end in a semicolon.

    Attribute values need only the markup characters' names, which keeps their plans small.
    """
    names = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")} if every_name else {"nbsp": "\u00a0"}
    table = F.from_json(F.lit(json.dumps(names)), "map<string,string>")

    def one(part: Column) -> Column:
        ref = F.regexp_extract(part, r"^&(#[xX][0-9A-Fa-f]+|#[0-9]+|[A-Za-z][A-Za-z0-9]*);", 1)

        def put(r: Column) -> Column:
            digits = F.regexp_replace(r, "^#[xX]?0*", "")
            # Without leading zeros no character has more than seven digits; longer ones are out of range.
            code = F.when(F.length(digits) > 7, "-1").when(r.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits)
            n = code.try_cast("long")
            ok = n.isNotNull() & (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
            char = F.translate(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"), _LATIN1_HIGH, CP1252_HIGH)
            named = F.when(r == "amp", "&").when(r == "lt", "<").when(r == "gt", ">").when(r == "quot", '"').otherwise(F.element_at(table, r))
            value = F.when(r.startswith("#"), F.when(ok, char).otherwise("\ufffd")).otherwise(named)
            return F.when((r == "") | value.isNull(), part).otherwise(F.concat(value, F.substring(part, F.length(r) + 3, F.length(part))))

        return let(ref, put)

    decoded = F.array_join(F.transform(F.split(text, "(?=&)", -1), one), "")
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def html_tokens(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """``(key, tok_no, kind, tag, raw)``; kind is start, end, raw (an element of raw text) or text."""
    found = F.regexp_extract_all(source, F.lit(_TOKEN), F.lit(0))
    t = each(pages, [key], found, "raw", "tok_no")
    t = t.filter(~F.rlike("raw", F.lit(r"^<[!?]"))).withColumn("tag", _tag(F.col("raw")))
    kind = (
        F.when(F.col("tag") == "", "text").when(F.col("raw").startswith("</"), "end")
        .when(F.col("tag").isin(*RAW_TEXT), "raw").otherwise("start")
    )
    return t.select(key, "tok_no", kind.alias("kind"), "tag", "raw")


def html_flat_text(source: Column) -> Column:
    """All text, with a space where a block or line break starts; inside one row."""
    s = F.regexp_replace(source, r"(?s)<!--.*?(?:-->|\z)", "")
    s = F.regexp_replace(s, r"(?is)<(script|style|title)(?![a-z0-9-])[^>]*>.*?(?:</\1[^>]*>|\z)", "")
    s = F.regexp_replace(s, rf"(?i)<(?:{'|'.join(FLAT_BREAKS)})(?![a-z0-9-])[^>]*>", " ")
    return decode_entities(F.regexp_replace(s, r"(?i)</?[a-z][^>]*>|<[!?][^>]*>", ""))


def nesting_depth(source: Column) -> Column:
    """Deepest nesting of a page; closing tags never take the depth below zero."""
    tokens = F.regexp_extract_all(source, F.lit(_NEST), F.lit(0))
    flat = [*NOT_NESTING]

    def delta(tok: Column) -> Column:
        return let(
            _tag(tok),
            lambda tag: F.when((tag == "") | tag.isin(*flat) | (F.right(tok, F.lit(2)) == "/>"), 0)
            .when(tok.startswith("</"), -1).when(tag.isin(*RAW_TEXT), 0).otherwise(1),
        )

    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))
    step = lambda a, x: F.struct(F.greatest(a["d"] + x, F.lit(0)).alias("d"), F.greatest(a["m"], a["d"] + x).alias("m"))
    return F.aggregate(F.transform(tokens, delta), start, step, lambda a: a["m"])


def html_nesting(pages: DataFrame, maximum: int, key: str = "page_id", source: str = "html") -> DataFrame:
    d = pages.select(key, nesting_depth(F.col(source)).cast("long").alias("depth"))
    return d.withColumn("too_deep", F.col("depth") > maximum)


def _by_page(key: str):
    return Window.partitionBy(key).orderBy("tok_no")


def _so_far(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def live_tokens(tokens: DataFrame, key: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """``(tokens that show, warnings)``: dropped elements, embedded media and form fields removed."""
    gone = [*DROPPED, *EMBEDDED, *FORMS]
    # An option ends where the next one or its list does, closed or not, so only the list counts.
    holds = F.col("tag").isin(*[t for t in gone if t not in (*VOID, "option", "optgroup")])
    # Of the elements that hold content only svg and math can close themselves.
    empty = F.col("tag").isin("svg", "math") & (F.right("raw", F.lit(2)) == "/>")
    enters = holds & (F.col("kind") == "start") & ~empty
    step = F.when(enters, 1).when(holds & (F.col("kind") == "end"), -1).otherwise(0)
    depth = F.sum(step).over(_so_far(_by_page(key)))
    t = tokens.withColumn("_in", depth)
    opens = F.col("kind").isin("start", "raw") & (F.col("_in") - F.when(enters, 1).otherwise(0) == 0)
    what = F.when(F.col("tag").isin(*EMBEDDED), WARN_EMBEDDED).when(F.col("tag").isin(*FORMS), WARN_FORMS)
    warnings = t.filter(opens).select(key, what.alias("warning")).filter("warning IS NOT NULL")
    live = t.filter((F.col("_in") <= 0) & ~F.col("tag").isin(*gone) & (F.col("kind") != "raw"))
    return live.drop("_in"), warnings


def displayed(live: DataFrame, key: str) -> DataFrame:
    """The tokens outside elements whose ``style`` says ``display: none``: they and all inside them leave no text, no break and no list number.

    An element ends at the next end tag that takes the nesting below its own; one that nothing closes lasts to the page's end.
    """
    w = _by_page(key)
    tag, kind = F.col("tag"), F.col("kind")
    nests = ~tag.isin(*VOID) & (F.right("raw", F.lit(2)) != "/>")
    opens, closes = nests & (kind == "start"), nests & (kind == "end")
    style = F.lower(F.coalesce(attr(F.col("raw"), "style"), F.lit("")))
    # The attribute is only read where the words occur at all.
    none = (kind == "start") & F.col("raw").rlike(r"(?i)display\s*:\s*none") & style.rlike(r"(^|;)\s*display\s*:\s*none\b")
    depth = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(_so_far(w))
    t = live.withColumn("_outer", depth - F.when(opens, 1).otherwise(0))
    later = Window.partitionBy(key, "_outer").orderBy(F.desc("tok_no")).rowsBetween(Window.unboundedPreceding, -1)
    end = F.coalesce(F.min(F.when(closes, F.col("tok_no"))).over(later), F.lit(1 << 60))
    t = t.withColumn("_until", F.when(none, F.when(nests, end).otherwise(F.col("tok_no"))))
    hidden = F.col("tok_no") <= F.coalesce(F.max("_until").over(_so_far(w)), F.lit(-1))
    return t.withColumn("_hidden", hidden).filter("NOT _hidden").drop("_outer", "_until", "_hidden")


# Private-use stand-ins: a line break, and white space that pre keeps.
_BR, _KEEP = "\ue000", "\ue001\ue002\ue003"


def parse_html(pages: DataFrame, key: str = "page_id", source: str = "html") -> tuple[DataFrame, DataFrame]:
    """``(blocks, warnings)``: the page's blocks in source order.

    A block has ``kind`` (paragraph, rule, image), ``level`` (heading 1-6), ``marker`` of the
    list item it opens, ``text``, and an image's ``src``. White space is collapsed across inline
    elements; ``pre`` keeps it; a line break is a line feed.
    """
    live, warnings = live_tokens(html_tokens(pages, key, source), key)
    live = displayed(live, key)
    w = _by_page(key)
    marks = html_list_markers(live, key).select(key, "tok_no", "marker")
    t = live.join(marks, [key, "tok_no"], "left")
    tag, kind = F.col("tag"), F.col("kind")
    nests = ~tag.isin(*[x for x in NOT_NESTING if x != "html"]) & (F.right("raw", F.lit(2)) != "/>")
    levels = F.when(tag.isin(*HOLDERS), 2).when(tag == "table", 4).otherwise(1)
    t = t.withColumn("_depth", F.sum(F.when(nests & (kind == "start"), levels).when(nests & (kind == "end"), -levels).otherwise(0)).over(_so_far(w)))
    deep = F.col("_depth") > MAX_DEPTH
    too_deep = t.filter(deep).select(key).distinct().withColumn("warning", F.lit(WARN_DEPTH))
    edge = (kind != "text") & tag.isin(*BLOCKS) & ~deep
    image = (kind == "start") & (tag == "img")
    t = t.withColumn("_cut", F.when(edge | image, 1).otherwise(0))
    # An image stands alone: text after it starts another block.
    after_image = F.lag(F.when(image, 1).otherwise(0), 1, 0).over(w)
    t = t.withColumn("block_no", F.sum(F.col("_cut") + after_image).over(_so_far(w)))
    run = lambda start, end: F.sum(F.when(start, 1).when(end, -1).otherwise(0)).over(_so_far(w))
    t = t.withColumn("_pre", run((kind == "start") & (tag == "pre"), (kind == "end") & (tag == "pre")))
    head = tag.rlike("^h[1-6]$")
    t = t.withColumn("_h", run((kind == "start") & head, (kind == "end") & head))
    level = F.last(F.when((kind == "start") & head, F.substring(tag, F.lit(2), F.lit(1)).cast("long")), ignorenulls=True).over(_so_far(w))
    t = t.withColumn("_level", F.when(F.col("_h") > 0, level))
    alt = F.coalesce(attr(F.col("raw"), "alt"), F.lit(""))
    plain = F.translate(decode_entities(F.col("raw")), "\u00ad\u200b", "")
    words = F.when(F.col("_pre") > 0, F.translate(plain, " \n\t", _KEEP)).otherwise(plain)
    style = F.lower(F.coalesce(attr(F.col("raw"), "style"), F.lit("")))
    case = F.regexp_extract(style, r"text-transform\s*:\s*(uppercase|lowercase|capitalize)", 1)
    piece = (
        F.when(kind == "text", words).when((kind == "start") & (tag == "br"), _BR).when(image, alt)
        .when(deep & (kind == "start") & tag.isin(*FLAT_BREAKS), " ").otherwise("")
    )
    t = t.withColumns({"_piece": piece, "_case": F.when(edge & (kind == "start"), case), "_src": F.when(image, F.coalesce(attr(F.col("raw"), "src"), F.lit("")))})
    g = t.groupBy(key, "block_no").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("tok_no", "_piece")))["_piece"], "").alias("_t"),
        F.max("_level").alias("level"), F.max("marker").alias("marker"), F.max("_case").alias("_case"), F.max("_src").alias("src"),
        F.max(F.when((kind == "start") & (tag == "hr"), 1).otherwise(0)).alias("_hr"),
    )
    text = collapse_space(F.col("_t"))
    text = F.when(F.col("_case") == "uppercase", F.upper(text)).when(F.col("_case") == "lowercase", F.lower(text)).when(
        F.col("_case") == "capitalize", capitalise(text)).otherwise(text)
    kinds = F.when(F.col("_hr") == 1, "rule").when(F.col("src").isNotNull(), "image").otherwise("paragraph")
    blocks = g.select(key, F.col("block_no").cast("long").alias("block_no"), kinds.alias("kind"), "level", "marker", text.alias("text"), "src",
                      F.contains("_t", F.lit(_BR)).alias("_br"))
    # A list item's marker stays with the first text of the item, which may be in a block inside it.
    shown = blocks.filter((F.col("kind") != "paragraph") | (F.col("text") != "") | F.col("_br") | F.col("marker").isNotNull()).drop("_br")
    return shown, warnings.unionByName(too_deep)


def capitalise(text: Column) -> Column:
    """First letter of each word in upper case, the rest as written."""
    parts = F.split(text, r"(?<=\s)", -1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, F.lit(2), F.length(p)))), "")


def collapse_space(text: Column) -> Column:
    """Runs of ASCII white space to one space, none around a line break or at the edges."""
    s = F.regexp_replace(text, r"[ \t\n\f\r]+", " ")
    s = F.regexp_replace(s, f" ?{_BR} ?", _BR)
    s = F.trim(F.regexp_replace(F.trim(s), f"{_BR}\\z", ""))
    return F.translate(s, _BR + _KEEP, "\n \n\t")


def html_paragraphs(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """Text blocks only: ``(key, block_no, level, marker, text)``, numbered in order from 0."""
    blocks, _ = parse_html(pages, key, source)
    p = blocks.filter("kind = 'paragraph' AND text <> ''")
    w = Window.partitionBy(key).orderBy("block_no")
    return p.select(key, (F.row_number().over(w) - 1).cast("long").alias("par_no"), "level", "marker", "text")


# List types by the type attribute and by bullet depth.
_TYPE_ATTR = {"1": "decimal", "a": "lower-alpha", "A": "upper-alpha", "i": "lower-roman", "I": "upper-roman"}


def html_list_markers(tokens: DataFrame, key: str = "page_id") -> DataFrame:
    """``(key, tok_no, list_no, value, marker)`` of every list item.

    An ordered list counts from ``start``; an item's ``value`` restarts the count there.
    """
    lists = ["ol", "ul", "menu", "dir"]
    rows = tokens.filter(F.col("tag").isin(*lists, "li") & (F.col("kind") != "text"))
    w = _by_page(key)
    is_list = F.col("tag").isin(*lists)
    opens, closes = is_list & (F.col("kind") == "start"), is_list & (F.col("kind") == "end")
    t = rows.withColumn("_d", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(_so_far(w)))
    # The list open at a depth is the last one that started there.
    at_depth = Window.partitionBy(key, "_d").orderBy("tok_no").rowsBetween(Window.unboundedPreceding, 0)
    start = F.when(F.col("tag") == "ol", F.coalesce(attr(F.col("raw"), "start").try_cast("long"), F.lit(1))).otherwise(1)
    css = F.regexp_extract(F.lower(F.coalesce(attr(F.col("raw"), "style"), F.lit(""))), r"list-style(?:-type)?\s*:\s*([a-z-]+)", 1)
    by_attr = F.element_at(F.create_map(*[F.lit(x) for kv in _TYPE_ATTR.items() for x in kv]), F.coalesce(attr(F.col("raw"), "type"), F.lit("")))
    bullet = F.when(F.col("_d") <= 1, "disc").when(F.col("_d") == 2, "circle").otherwise("square")
    named = F.lower(F.coalesce(attr(F.col("raw"), "type"), F.lit("")))
    given = F.when(css != "", css).when(by_attr.isNotNull(), by_attr).when(named.isin("disc", "circle", "square", "none"), named)
    info = F.struct(F.col("tok_no").alias("no"), F.greatest(start - 1, F.lit(0)).alias("base"),
                    F.coalesce(given, F.when(F.col("tag") == "ol", "decimal").otherwise(bullet)).alias("type"))
    t = t.withColumn("_l", F.last(F.when(opens, info), ignorenulls=True).over(at_depth))
    li = t.filter((F.col("tag") == "li") & (F.col("kind") == "start"))
    li = li.select(key, "tok_no", F.when(F.col("_d") > 0, F.col("_l.no")).alias("list_no"), F.coalesce("_l.base", F.lit(0)).alias("_base"),
                   F.coalesce("_l.type", F.lit("disc")).alias("_type"), attr(F.col("raw"), "value").try_cast("long").alias("_v"))
    inside = Window.partitionBy(key, "list_no").orderBy("tok_no")
    n = li.withColumn("_n", F.row_number().over(inside))
    anchor = F.last(F.when(F.col("_v") >= 0, F.struct(F.col("_v").alias("v"), F.col("_n").alias("n"))), ignorenulls=True).over(_so_far(inside))
    value = F.when(F.col("list_no").isNull() & F.col("_v").isNull(), 1).when(anchor.isNull(), F.col("_base") + F.col("_n")).otherwise(anchor["v"] + F.col("_n") - anchor["n"])
    v = n.withColumn("value", value.cast("long"))
    return v.select(key, "tok_no", "list_no", "value", list_marker(F.col("_type"), F.col("value")).alias("marker"))


def html_table_cells(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """``(key, table_no, row_no, col_no, colspan, merge, header, text)`` of every table slot.

    Head rows come first and foot rows last wherever they stand. A row span of 0 runs to the
    end; slots covered from above are ``continue`` cells.
    """
    tokens, _ = live_tokens(html_tokens(pages, key, source), key)
    w = _by_page(key)
    tag, kind = F.col("tag"), F.col("kind")
    is_table = tag == "table"
    t = tokens.withColumn("_td", F.sum(F.when(is_table & (kind == "start"), 1).when(is_table & (kind == "end"), -1).otherwise(0)).over(_so_far(w)))
    # A nested table's tokens carry a greater depth; each open table is told by its start.
    depth = F.when(is_table & (kind == "end"), F.col("_td") + 1).otherwise(F.col("_td"))
    t = t.withColumn("_dep", depth).filter("_dep > 0")
    at = Window.partitionBy(key, "_dep").orderBy("tok_no").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("table_no", F.last(F.when(is_table & (kind == "start"), F.col("tok_no")), ignorenulls=True).over(at))
    tw = Window.partitionBy(key, "table_no").orderBy("tok_no").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when((kind == "start") & tag.isin("thead", "tbody", "tfoot"), tag).when((kind == "end") & tag.isin("thead", "tbody", "tfoot"), "tbody"), ignorenulls=True).over(tw)
    row = F.sum(F.when((kind == "start") & (tag == "tr"), 1).otherwise(0)).over(tw)
    cell = F.sum(F.when((kind == "start") & tag.isin("td", "th"), 1).otherwise(0)).over(tw)
    # A cell belongs to the row it starts in; the tag of the next row comes before its first cell.
    t = t.withColumns({"_sec": F.coalesce(section, F.lit("tbody")), "_r": row, "_cell": cell})
    opens = (kind == "start") & tag.isin("td", "th")
    # Rows are numbered from their tags, with or without cells: head rows first, foot rows last.
    place = F.when(F.col("_sec") == "thead", 0).when(F.col("_sec") == "tfoot", 2).otherwise(1)
    rows = t.filter(opens | ((kind == "start") & (tag == "tr"))).groupBy(key, "table_no", F.col("_r").alias("_row")).agg(F.min(place).alias("_place"))
    table = Window.partitionBy(key, "table_no")
    rows = rows.select(
        key, "table_no", "_row", (F.row_number().over(table.orderBy("_place", "_row")) - 1).alias("row"),
        F.count(F.lit(1)).over(table).alias("n_rows"), F.count_if(F.col("_place") == 0).over(table).alias("n_head"),
    )
    t = t.withColumn("_row", F.last(F.when(opens, F.col("_r")), ignorenulls=True).over(tw))

    def span(name: str) -> Column:
        digits = F.regexp_replace(F.regexp_extract(F.coalesce(attr(F.col("raw"), name), F.lit("")), "^[0-9]+$", 0), "^0+(?=[0-9])", "")
        return F.when(opens, F.when(digits == "", 1).when(F.length(digits) > 6, 1_000_000).otherwise(digits.try_cast("int")))

    g = t.filter("_cell > 0").groupBy(key, "table_no", "_row", "_cell").agg(
        F.max(span("colspan")).alias("colspan"), F.max(span("rowspan")).alias("rowspan"),
        F.array_join(F.sort_array(F.collect_list(F.struct("tok_no", F.when(kind == "text", decode_entities(F.col("raw"))).when(tag == "br", _BR).otherwise("").alias("p"))))["p"], "").alias("_t"),
    )
    ready = g.join(rows, [key, "table_no", "_row"]).withColumn("text", collapse_space(F.col("_t")))
    # One table is one row, so a batch of tables goes to Python at a time.
    cells = F.sort_array(F.collect_list(F.struct("row", "_cell", "colspan", "rowspan", "text")))
    placed = ready.groupBy(key, "table_no").agg(cells.alias("_c"), F.max("n_rows").alias("_n"), F.max("n_head").alias("_h"))
    placed = placed.withColumn("_c", _place_cells("_c", "_n", "_h"))
    return each(placed, [key, "table_no"], F.col("_c"), "c").select(key, "table_no", "c.*")


_SLOT = "array<struct<row_no:bigint,col_no:bigint,colspan:bigint,merge:string,header:boolean,text:string>>"
MAX_COLSPAN = 1000


def _place_cells(*columns: str) -> Column:
    def batch(cells: pd.Series, rows: pd.Series, head: pd.Series) -> pd.Series:
        return pd.Series([_grid(*x) for x in zip(cells, rows, head, strict=True)])

    return F.pandas_udf(batch, _SLOT)(*columns)


def _grid(cells, n_rows: int, n_head: int) -> list[dict]:
    """The slots of one table. ``hanging``: column intervals that reach down from above, with the last row they reach."""
    by_row: dict[int, list] = {}
    for c in cells:
        by_row.setdefault(c["row"], []).append(c)
    out: list[dict] = []
    hanging: list[tuple[int, int, int]] = []
    for row in range(n_rows):
        hanging = sorted(h for h in hanging if h[2] >= row)
        ahead, free, fresh = iter(hanging), 0, []
        following = next(ahead, None)
        for cell in [*by_row.get(row, ()), None]:
            # Intervals that begin at or before the free column push it on; at the end of the row all that are left show.
            while following and (cell is None or following[0] <= free):
                begin, end, _ = following
                if begin >= free:
                    out.append({"row_no": row, "col_no": begin, "colspan": end - begin, "merge": "continue", "header": row < n_head, "text": ""})
                free, following = max(free, end), next(ahead, None)
            if cell is None:
                break
            width = min(max(int(cell["colspan"]), 1), MAX_COLSPAN)
            last = n_rows - 1 if cell["rowspan"] == 0 else min(row + int(cell["rowspan"]), n_rows) - 1
            if last > row:
                fresh.append((free, free + width, last))
            out.append({"row_no": row, "col_no": free, "colspan": width, "merge": "start" if last > row else "none", "header": row < n_head, "text": cell["text"]})
            free += width
        hanging += fresh
    return out


def html_resources(df: DataFrame, src: str = "src", limit: int = IMAGE_LIMIT) -> DataFrame:
    """Classify a resource address; nothing is fetched. Adds ``class``, ``path`` and ``data``."""
    s = F.trim(src)
    head = F.substring_index(s, ",", 1)
    body = F.when(F.contains(s, F.lit(",")), F.substring(s, F.length(head) + 2, F.length(s)))
    is_data = F.lower(s).startswith("data:") & (F.length(s) > 5)
    base64 = F.lower(head).endswith(";base64")
    compact = percent_decode(F.regexp_replace(body, r"\s", ""))
    data = F.when(base64, F.try_to_binary(compact, F.lit("base64"))).otherwise(F.encode(percent_decode(body), "UTF-8"))
    big = F.octet_length(body) > limit * 4 // 3 + 4
    sch = scheme(s)
    local = percent_decode(F.regexp_replace(s, r"[#?].*$", ""))
    file = F.concat(F.lit("/"), percent_decode(F.regexp_replace(F.regexp_replace(s, r"(?i)^file:/*", ""), "^localhost/", "")))
    cls = (
        F.when(s == "", "empty").when(is_data & (body.isNull() | data.isNull()), "damaged").when(is_data & big, "too large").when(is_data, "data")
        .when(sch == "file", "file").when(sch.isNotNull() | s.startswith("//"), "remote").when(local.startswith("/"), "absolute").otherwise("relative")
    )
    out = df.withColumn("class", cls)
    return out.withColumns({
        "path": F.when(F.col("class").isin("absolute", "relative"), local).when(F.col("class") == "file", file),
        "data": F.when(F.col("class") == "data", data),
    })
