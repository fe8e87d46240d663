"""Page-set algebra: select, number, merge, split, reorder, rotate, crop, resize.

Pages are ``(doc_id, page_no, ...)`` with ``page_no`` dense from 0. Wherever a new position is
arithmetic it is computed in place; where it is a rank, :mod:`.scan` keeps a hot document
from landing in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import each
from ..functions.numbering import bates_label, format_number
from ..session import checkpointed
from .page_ranges import PageSpec
from .scan import block_of, dense_index, global_offsets, running

PAGE_NO = F.col


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"))


def with_page_count(pages: DataFrame) -> DataFrame:
    return pages.join(page_counts(pages), "doc_id")


# -- selection ---------------------------------------------------------------------


def page_spec_errors(pages: DataFrame, spec: PageSpec) -> DataFrame:
    """Documents the range text does not fit, with the message."""
    return page_counts(pages).select("doc_id", spec.error(F.col("page_count")).alias("error")).filter("error IS NOT NULL")


def select_pages(pages: DataFrame, spec: PageSpec) -> DataFrame:
    """The chosen pages of every document the range fits; the filter runs before the check."""
    chosen = pages.filter(spec.contains(F.col("page_no")))
    return chosen if spec.every else chosen.join(page_spec_errors(pages, spec), "doc_id", "left_anti")


def extract_pages(pages: DataFrame, spec: PageSpec) -> DataFrame:
    """Chosen pages renumbered from 0 as ``new_page_no``."""
    return select_pages(pages, spec).withColumn("new_page_no", spec.before(F.col("page_no")))


def delete_pages(pages: DataFrame, spec: PageSpec) -> tuple[DataFrame, DataFrame]:
    """``(remaining, deleted)``; what remains is renumbered, what went can be put back.

    A range that would leave a document without pages, or does not fit it, changes nothing.
    """
    fits = page_counts(pages).filter(spec.error(F.col("page_count")).isNull())
    fits = fits.filter(spec.before(F.col("page_count")) < F.col("page_count")).select("doc_id", F.lit(True).alias("_fits"))
    j = pages.join(fits, "doc_id", "left")
    hit = F.coalesce("_fits", F.lit(False)) & spec.contains(F.col("page_no"))
    shift = F.when(F.coalesce("_fits", F.lit(False)), spec.before(F.col("page_no"))).otherwise(0)
    remaining = j.filter(~hit).withColumn("new_page_no", F.col("page_no") - shift).drop("_fits")
    return remaining, j.filter(hit).drop("_fits")


def restore_pages(remaining: DataFrame, deleted: DataFrame) -> DataFrame:
    return remaining.drop("new_page_no").unionByName(deleted)


def renumber_pages(pages: DataFrame, position: str = "page_no") -> DataFrame:
    """Dense 0-based ``new_page_no`` in the order of ``position``."""
    return dense_index(pages, ["doc_id"], block_of(position), [F.col(position)], "new_page_no")


# -- numbering -----------------------------------------------------------------------


def bates_number(pages: DataFrame, prefix: str = "", suffix: str = "", padding: int = 6, start: int = 1) -> DataFrame:
    """Number every page of the corpus without a gap, documents in order.

    Page counts are combined per document first; only they are put in global order.
    """
    if start < 0:
        raise ValueError("Bates numbering cannot start below 0")
    offsets = global_offsets(page_counts(pages), ["doc_id"], "page_count", "_off").select("doc_id", "_off")
    n = F.lit(start) + F.col("_off") + F.col("page_no")
    out = pages.join(offsets, "doc_id").withColumn("bates_no", n.cast("long"))
    return out.withColumn("bates", bates_label(F.col("bates_no"), prefix, suffix, padding)).drop("_off")


def page_labels(pages: DataFrame, fmt: str, start: int = 1, exclude: PageSpec | None = None) -> DataFrame:
    """Shown number per page; an excluded page has none but still counts."""
    if start < 1:
        raise ValueError("starting number must be at least 1")
    j = with_page_count(pages)
    label = format_number(fmt, F.col("page_no") + start, F.col("page_count") + (start - 1))
    if exclude is not None:
        label = F.when(~exclude.contains(F.col("page_no")), label)
    return j.withColumn("label", label)


def header_footer(pages: DataFrame, template: str, date: str) -> DataFrame:
    """``{n}``, ``{total}`` and ``{date}`` replaced in that order."""
    j = with_page_count(pages)
    t = F.replace(F.lit(template), F.lit("{n}"), (F.col("page_no") + 1).cast("string"))
    t = F.replace(t, F.lit("{total}"), F.col("page_count").cast("string"))
    return j.withColumn("line", F.replace(t, F.lit("{date}"), F.lit(date)))


def unique_field_names(fields: DataFrame, merge_key: str, source: str, position: str) -> DataFrame:
    """The n-th use of a name in one merge (n > 1) becomes ``name_n``."""
    block = F.struct(F.col(source), block_of(position))
    order = [F.col(source), F.col(position)]
    n = running(fields, [merge_key, "name"], block, order, {"_n": ("sum", F.lit(1).cast("long"))})
    return n.withColumn("unique_name", F.when(F.col("_n") > 1, F.concat("name", F.lit("_"), F.col("_n"))).otherwise(F.col("name"))).drop("_n")


_SHEET_MAX = 31


def unique_sheet_names(names: DataFrame, book: str, position: str) -> DataFrame:
    """Case-insensitively distinct sheet names per workbook, `` (k)`` appended, at most 31 characters.

    Workbooks in which a generated name meets a written one take the step-by-step rule.
    """
    low = names.withColumn("_low", F.lower("name"))
    ranked = running(low, [book, "_low"], block_of(position), [F.col(position)], {"_k": ("sum", F.lit(1).cast("long"))})
    tag = F.concat(F.lit(" ("), F.col("_k"), F.lit(")"))
    made = F.when(F.col("_k") == 1, F.col("name")).otherwise(F.concat(F.left("name", F.lit(_SHEET_MAX) - F.length(tag)), tag))
    made_df = ranked.withColumn("sheet_name", made).drop("_low", "_k")
    clash = made_df.groupBy(book, F.lower("sheet_name").alias("_s")).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select(book).distinct()
    schema = made_df.schema
    stepped = names.join(clash, book, "left_semi").groupBy(book).applyInPandas(_sheet_names(position), schema)
    return made_df.join(clash, book, "left_anti").unionByName(stepped)


def _sheet_names(position: str):
    def assign(pdf):
        # A workbook's sheet list: bounded by what one workbook can hold.
        pdf = pdf.sort_values(position)
        seen, out, nxt = set(), [], {}
        for name in pdf["name"]:
            cand, k = name, nxt.get(name, 2)
            while cand.lower() in seen:
                tag = f" ({k})"
                cand, k = name[: _SHEET_MAX - len(tag)] + tag, k + 1
            nxt[name] = k
            seen.add(cand.lower())
            out.append(cand)
        return pdf.assign(sheet_name=out)

    return assign


# -- set operations ----------------------------------------------------------------


def insert_blank(pages: DataFrame, index: int, size: tuple[float, float] | None = None) -> DataFrame:
    """A blank page at ``index`` of every document long enough; its size is the page before's."""
    counts = page_counts(pages).filter(F.col("page_count") >= index).select("doc_id")
    shifted = pages.join(counts.withColumn("_in", F.lit(True)), "doc_id", "left").withColumn(
        "new_page_no", F.col("page_no") + F.when(F.col("_in") & (F.col("page_no") >= index), 1).otherwise(0)
    )
    donor = pages.filter(F.col("page_no") == max(index - 1, 0)).join(counts, "doc_id", "left_semi")
    w, h = (F.lit(size[0]), F.lit(size[1])) if size else (F.col("width"), F.col("height"))
    blank = donor.select("doc_id", F.lit(None).cast("long").alias("page_no"), w.cast("double").alias("width"), h.cast("double").alias("height"),
                         F.lit(index).cast("long").alias("new_page_no"))
    keep = shifted.select("doc_id", "page_no", "width", "height", F.col("new_page_no").cast("long").alias("new_page_no"))
    return keep.unionByName(blank)


def merge_documents(pages: DataFrame, merge_key: str, source: str) -> DataFrame:
    """Concatenate documents per ``merge_key`` in the order of ``source``; sets of one are left out."""
    docs = pages.groupBy(merge_key, source).agg(F.count(F.lit(1)).alias("_n"))
    sizes = docs.groupBy(merge_key).agg(F.count(F.lit(1)).alias("_docs")).filter("_docs >= 2").select(merge_key)
    off = running(docs, [merge_key], block_of(source), [F.col(source)], {"_end": ("sum", F.col("_n"))})
    off = off.select(merge_key, source, (F.col("_end") - F.col("_n")).alias("_off"))
    j = pages.join(off, [merge_key, source]).join(sizes, merge_key, "left_semi")
    return j.withColumn("new_page_no", (F.col("_off") + F.col("page_no")).cast("long")).drop("_off")


def insert_from(pages: DataFrame, pairs: DataFrame, spec: PageSpec, at: int) -> DataFrame:
    """Put the chosen pages of ``src_id`` into ``doc_id`` before page ``at``, for each pair that fits.

    Returns ``(doc_id, new_page_no, from_id, page_no)`` of the changed documents.
    """
    n = page_counts(pages)
    src_n = n.select(F.col("doc_id").alias("src_id"), F.col("page_count").alias("_src_n"))
    ok = pairs.join(n, "doc_id").join(src_n, "src_id").filter((F.col("page_count") >= at) & spec.error(F.col("_src_n")).isNull())
    ok = ok.select("doc_id", "src_id", spec.before(F.col("_src_n")).alias("_k"))
    kept = pages.select("doc_id", "page_no").join(ok, "doc_id").select(
        "doc_id", (F.col("page_no") + F.when(F.col("page_no") >= at, F.col("_k")).otherwise(0)).alias("new_page_no"),
        F.col("doc_id").alias("from_id"), "page_no",
    )
    chosen = pages.filter(spec.contains(F.col("page_no"))).select(F.col("doc_id").alias("src_id"), "page_no")
    added = chosen.join(ok, "src_id").select(
        "doc_id", (F.lit(at) + spec.before(F.col("page_no"))).alias("new_page_no"), F.col("src_id").alias("from_id"), "page_no"
    )
    return kept.unionByName(added)


def reorder_pages(pages: DataFrame, order: DataFrame) -> DataFrame:
    """Move pages as ``order(doc_id, page_no, new_page_no)`` says, where it is a permutation.

    Documents without a full permutation are left out; see :func:`reorder_errors`.
    """
    bad = reorder_errors(pages, order).select("doc_id")
    return pages.join(order, ["doc_id", "page_no"]).join(bad, "doc_id", "left_anti")


def reorder_errors(pages: DataFrame, order: DataFrame) -> DataFrame:
    """Documents whose order is not a permutation of their pages."""
    shape = order.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("new_page_no").alias("d"), F.count_distinct("page_no").alias("p"),
        F.min(F.least("new_page_no", "page_no")).alias("lo"), F.max(F.greatest("new_page_no", "page_no")).alias("hi"),
    )
    j = page_counts(pages).join(shape, "doc_id")
    n = F.col("page_count")
    good = (F.col("n") == n) & (F.col("d") == n) & (F.col("p") == n) & (F.col("lo") == 0) & (F.col("hi") == n - 1)
    return j.filter(~good).select("doc_id", F.lit("the order is not a permutation of the pages").alias("error"))


def inverse_order(order: DataFrame) -> DataFrame:
    return order.select("doc_id", F.col("new_page_no").alias("page_no"), F.col("page_no").alias("new_page_no"))


def move_page(pages: DataFrame, source: int, target: int) -> DataFrame:
    """Move one page; a position outside the document leaves it as it is."""
    j, p = with_page_count(pages), F.col("page_no")
    if source < target:
        moved = F.when(p == source, F.lit(target)).when(p.between(source + 1, target), p - 1).otherwise(p)
    else:
        moved = F.when(p == source, F.lit(target)).when(p.between(target, source - 1), p + 1).otherwise(p)
    inside = (F.lit(min(source, target)) >= 0) & (F.lit(max(source, target)) < F.col("page_count"))
    return j.withColumn("new_page_no", F.when(inside & F.lit(source != target), moved).otherwise(p).cast("long"))


# -- splitting ---------------------------------------------------------------------------


def _with_split_error(parts: DataFrame) -> DataFrame:
    """A split that yields one part is an error of its document."""
    n = parts.groupBy("doc_id").agg(F.max("part_no").alias("_last"))
    text = F.when(F.col("_last") < 1, F.lit("the split would give a single part"))
    return parts.join(n, "doc_id").withColumn("error", text).drop("_last")


def split_every_n(pages: DataFrame, n: int) -> DataFrame:
    if n < 1:
        raise ValueError("pages per part must be at least 1")
    return _with_split_error(pages.withColumn("part_no", F.floor(F.col("page_no") / n).cast("long")))


def split_at_pages(pages: DataFrame, boundaries: list[int]) -> DataFrame:
    """Split before each 1-based page in ``boundaries``; all must lie in 2..page count."""
    part = F.lit(0).cast("long")
    for b in boundaries:
        part = part + F.when(F.col("page_no") >= b - 1, 1).otherwise(0)
    j = with_page_count(pages).withColumn("part_no", part.cast("long"))
    bad = (F.lit(min(boundaries)) <= 1) | (F.lit(max(boundaries)) > F.col("page_count"))
    text = F.concat(F.lit("Split points must be between 2 and "), F.col("page_count"), F.lit("."))
    return j.withColumn("error", F.when(bad, text)).drop("page_count")


def split_by_bookmarks(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """Split before every page a top-level bookmark points at."""
    starts = outline.filter(F.col("parent_id").isNull() & (F.col("page") > 0))
    starts = starts.select("doc_id", F.col("page").alias("page_no")).distinct().withColumn("_start", F.lit(1).cast("long"))
    j = pages.join(starts, ["doc_id", "page_no"], "left")
    parts = running(j, ["doc_id"], block_of("page_no"), [F.col("page_no")], {"part_no": ("sum", F.coalesce("_start", F.lit(0)).cast("long"))})
    return _with_split_error(parts.drop("_start"))


def split_by_size(pages: DataFrame, max_bytes: int) -> DataFrame:
    """Greedy parts of at most ``max_bytes``; a page larger than that stands alone.

    A document is never gathered: each page's next part start comes from running totals, and the starts
    reachable from page 0 are found by doubling the jumps. The pages are computed once, as three numbers each.
    """
    if max_bytes < 1:
        raise ValueError("size target must be greater than zero")
    slim = checkpointed(pages.select("doc_id", "page_no", F.col("n_bytes").cast("long").alias("n_bytes")))
    starts = _part_starts(slim, max_bytes).withColumn("_start", F.lit(1).cast("long"))
    j = slim.select("doc_id", "page_no").join(starts, ["doc_id", "page_no"], "left")
    parts = running(j, ["doc_id"], block_of("page_no"), [F.col("page_no")], {"_n": ("sum", F.coalesce("_start", F.lit(0)).cast("long"))})
    parts = _with_split_error(parts.withColumn("part_no", F.col("_n") - 1).drop("_start", "_n"))
    rest = [c for c in pages.columns if c not in ("doc_id", "page_no")]
    return pages.join(parts, ["doc_id", "page_no"]) if set(rest) - {"n_bytes"} else parts.join(slim, ["doc_id", "page_no"])


def _part_starts(pages: DataFrame, max_bytes: int) -> DataFrame:
    p = running(pages, ["doc_id"], block_of("page_no"), [F.col("page_no")],
                {"_end": ("sum", F.col("n_bytes"))})
    p = checkpointed(p)
    # A part starting at page i ends before the first page whose running total passes
    # start + max: count the totals at or below that bound.
    ends = p.select("doc_id", F.col("_end").alias("v"), F.lit(0).alias("q"), F.col("page_no"))
    asks = p.select("doc_id", (F.col("_end") - F.col("n_bytes") + max_bytes).alias("v"), F.lit(1).alias("q"), F.col("page_no"))
    both = running(ends.unionByName(asks), ["doc_id"], block_of("v", max_bytes * 1024), [F.col("v"), F.col("q"), F.col("page_no")],
                   {"_c": ("sum", (1 - F.col("q")).cast("long"))})
    jump = both.filter("q = 1").select("doc_id", "page_no", F.greatest(F.col("_c"), F.col("page_no") + 1).alias("to"))
    jump = checkpointed(jump.join(pages.select("doc_id", F.col("page_no").alias("to")), ["doc_id", "to"], "left_semi"))
    reach = checkpointed(pages.filter("page_no = 0").select("doc_id", "page_no"))
    while True:
        more = reach.join(jump, ["doc_id", "page_no"]).select("doc_id", F.col("to").alias("page_no"))
        grown = checkpointed(reach.unionByName(more).distinct())
        if grown.count() == reach.count():
            return grown
        reach = grown
        onward = jump.select("doc_id", F.col("page_no").alias("to"), F.col("to").alias("_to"))
        jump = checkpointed(jump.join(onward, ["doc_id", "to"]).select("doc_id", "page_no", F.col("_to").alias("to")))


def part_names(parts: DataFrame, stem: str) -> DataFrame:
    """``stem-001`` for the first part; a stem that names a path is refused."""
    if not stem or "/" in stem or "\\" in stem or stem in (".", ".."):
        raise ValueError(f"not a plain file name: {stem!r}")
    return parts.withColumn("part_name", F.format_string(f"{stem.replace('%', '%%')}-%03d", F.col("part_no") + 1))


# -- page properties ---------------------------------------------------------------------


def rotate_pages(pages: DataFrame, spec: PageSpec, turns: int) -> DataFrame:
    """Quarter turns, clockwise; documents the range does not fit are left unchanged."""
    j = with_page_count(pages)
    hit = spec.error(F.col("page_count")).isNull() & spec.contains(F.col("page_no"))
    turned = F.pmod(F.floor(F.col("rotate") / 90) + turns, F.lit(4)) * 90
    return j.withColumn("rotate", F.when(hit, turned.cast("long")).otherwise(F.col("rotate"))).drop("page_count")


def crop_pages(pages: DataFrame, left: float, bottom: float, right: float, top: float) -> DataFrame:
    """Set the crop box; the page's content and media box stay."""
    if not (left < right and bottom < top):
        raise ValueError("the crop box is empty")
    box = F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (left, bottom, right, top))])
    return pages.withColumn("crop", box)


def reset_crop(pages: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return pages.withColumn("crop", F.struct(zero.alias("x0"), zero.alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1")))


def resize_pages(pages: DataFrame, width: float, height: float, keep_aspect: bool = True) -> DataFrame:
    """New page size with the content's ``sx, sy, dx, dy``: scaled evenly and centred, or stretched."""
    if not (0 < width <= 14400 and 0 < height <= 14400):
        raise ValueError("a page side must be a positive number of points, at most 14400")
    w, h = F.col("width"), F.col("height")
    if keep_aspect:
        s = F.least(F.lit(float(width)) / w, F.lit(float(height)) / h)
        sx, sy, dx, dy = s, s, (F.lit(float(width)) - w * s) / 2, (F.lit(float(height)) - h * s) / 2
    else:
        sx, sy, dx, dy = F.lit(float(width)) / w, F.lit(float(height)) / h, F.lit(0.0), F.lit(0.0)
    out = pages.withColumns({"sx": sx, "sy": sy, "dx": dx, "dy": dy})
    return out.withColumns({"width": F.lit(float(width)), "height": F.lit(float(height))})


# Standard page sizes in points.
PAGE_SIZES = [("Letter", 612.0, 792.0), ("Legal", 612.0, 1008.0), ("Tabloid", 792.0, 1224.0), ("A3", 841.89, 1190.55), ("A4", 595.28, 841.89), ("A5", 419.53, 595.28)]


def match_page_size(width: Column, height: Column, tol: float = 1.0) -> Column:
    """Name of the first standard size within ``tol`` of both sides, else ``Custom``."""
    out = F.lit("Custom")
    for name, w, h in reversed(PAGE_SIZES):
        out = F.when((F.abs(width - w) <= tol) & (F.abs(height - h) <= tol), name).otherwise(out)
    return out


def prune_dangling(links: DataFrame, pages: DataFrame, target: str = "target_page") -> DataFrame:
    """Links and bookmarks whose target page still exists; those without a target stay."""
    alive = pages.select("doc_id", F.col("page_no").alias(target))
    kept = links.filter(F.col(target).isNotNull()).join(alive, ["doc_id", target], "left_semi")
    return kept.unionByName(links.filter(F.col(target).isNull()))
