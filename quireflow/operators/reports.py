"""Corpus reports: documents, fonts, glyphs, images, OCR words, links, cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import each
from ..functions.fonts import FALLBACK_FAMILIES, fallback_substitute, font_class, is_standard, normalize_font_key
from ..functions.text import strip_subset_tag
from .scan import union_all


def document_summary(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Page count, title and author of every document."""
    n = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"))
    return documents.join(n, "doc_id", "left").select("doc_id", F.coalesce("page_count", F.lit(0)).alias("page_count"), "title", "author")


# -- fonts -----------------------------------------------------------------------------------


def font_inventory(runs: DataFrame) -> DataFrame:
    """Distinct (font, embedded) per document, subset tags off, blank names dropped."""
    f = runs.select("doc_id", strip_subset_tag(F.col("font_name")).alias("font"), "embedded")
    return f.filter(F.trim("font") != "").distinct()


def first_fonts(runs: DataFrame) -> DataFrame:
    """One row per document and font, embedded or not as where it is first seen: the lowest page, then run."""
    f = runs.select("doc_id", strip_subset_tag(F.col("font_name")).alias("font"), "embedded", F.struct("page_no", "run_no").alias("_at"))
    return f.filter(F.trim("font") != "").groupBy("doc_id", "font").agg(F.min_by("embedded", "_at").alias("embedded"))


def font_report(fonts: DataFrame, installed: DataFrame) -> DataFrame:
    """How each document's fonts will be drawn; ``fonts`` as from :func:`first_fonts`. ``installed`` has ``key`` (normalised names)."""
    once = fonts.withColumn("key", normalize_font_key(F.col("font")))
    j = once.join(installed.select("key", F.lit(True).alias("_sys")).distinct(), "key", "left")
    status = F.when(F.col("embedded"), "embedded").when(is_standard(F.col("font")), "standard").when(F.col("_sys"), "system").otherwise("fallback")
    j = j.withColumn("status", status)
    return j.withColumn("substitute", F.when(F.col("status") == "fallback", fallback_substitute(F.col("font")))).drop("_sys", "embedded")


def needs_fallback(report: DataFrame) -> DataFrame:
    return report.groupBy("doc_id").agg(F.bool_or(F.col("status") == "fallback").alias("needs_fallback"))


def closest_face(wanted: DataFrame, faces: DataFrame) -> DataFrame:
    """Best installed face for each wanted (family, bold, italic), and the family used if another.

    Every installed family is scored once per weight and slant; requests then look their
    family, or the first installed fallback, up.
    """
    combos = faces.withColumn("_w", F.explode(F.array(*[
        F.struct(F.lit(b).alias("bold"), F.lit(i).alias("italic")) for b in (False, True) for i in (False, True)
    ])))
    b, i = F.col("_w.bold"), F.col("_w.italic")
    cost = F.when(F.col("italic") != i, 10000).otherwise(0) + F.when((F.col("weight") >= 600) != b, 1000).otherwise(0)
    cost = cost + F.abs(F.col("weight") - F.when(b, 700).otherwise(400))
    best = combos.groupBy(F.lower("family").alias("_fam"), b.alias("bold"), i.alias("italic")).agg(
        F.min(F.struct(cost.alias("cost"), F.col("path"), F.col("face_index"), F.col("family"))).alias("_best")
    )
    asks = wanted.select("family", "bold", "italic").distinct()
    order = F.lit(None)
    for cls in FALLBACK_FAMILIES:
        names = [*FALLBACK_FAMILIES[cls], *[n for c, ns in FALLBACK_FAMILIES.items() if c != cls for n in ns]]
        order = F.when(font_class(F.col("family")) == cls, F.array(*[F.lit(n) for n in names])).otherwise(order)
    tries = asks.withColumn("_try", F.concat(F.array("family"), order))
    tries = tries.select("family", "bold", "italic", F.posexplode("_try").alias("_ord", "_t")).withColumn("_fam", F.lower("_t"))
    hit = tries.join(best, ["_fam", "bold", "italic"])
    first = hit.groupBy("family", "bold", "italic").agg(F.min_by(F.struct("_best", "_ord"), "_ord").alias("_h"))
    used = F.when(F.col("_h._ord") > 0, F.col("_h._best.family"))
    out = first.select("family", "bold", "italic", F.col("_h._best.path").alias("path"), used.alias("used_family"))
    return wanted.join(out, ["family", "bold", "italic"], "left")


def glyph_usage(runs: DataFrame, font: str, text: str) -> DataFrame:
    """Characters each font draws; distinct ones leave each row before anything is shuffled."""
    chars = each(runs, [font], F.array_distinct(F.split(text, "")), "char").select(font, "char").filter("char <> ''").distinct()
    return chars.groupBy(font).agg(F.count(F.lit(1)).alias("glyphs"), F.array_join(F.sort_array(F.collect_list("char")), "").alias("characters"))


def distinct_values(df: DataFrame, key: str, value: str, approximate: bool = False) -> DataFrame:
    """Distinct count per key, exact by default.

    The approximation is a sketch that holds small sets as they are (some hundreds of values) and estimates larger ones with a standard error of 2 %
    at most; a plain register array takes one of a few thousand small sets for two values short.
    """
    hashed = F.when(F.col(value).isNotNull(), F.xxhash64(value))
    n = F.hll_sketch_estimate(F.hll_sketch_agg(hashed, F.lit(12))) if approximate else F.count_distinct(value)
    return df.groupBy(key).agg(n.alias("distinct_values"))


# -- images ------------------------------------------------------------------------------------

# Colour spaces whose samples are plain grey or RGB values.
PLAIN_SPACES = ["DeviceGray", "DeviceRGB", "CalGray", "CalRGB", "ICCBased"]
# Target resolution of each compression level.
TARGET_DPI = {"low": None, "medium": 200.0, "high": 150.0}
MIN_PIXELS = 64 * 64


def ineligible_reason() -> Column:
    """First reason an image keeps its bytes, or null when it may be recompressed."""
    bits = F.coalesce("bits", F.lit(8))
    return (
        F.when(~F.col("is_image"), "NotAnImage").when(F.col("masked"), "Masked").when(F.col("filter") == "JPXDecode", "Jpeg2000")
        .when(bits == 1, "Bilevel").when(bits != 8, "BitDepth")
        .when((F.col("width_px") <= 0) | (F.col("height_px") <= 0) | (F.col("width_px") * F.col("height_px") < MIN_PIXELS), "TooSmall")
        .when(~F.col("color_space").isin(*PLAIN_SPACES), "ColourSpace")
    )


def image_eligibility(images: DataFrame) -> DataFrame:
    return images.withColumn("reason", ineligible_reason())


def compress_images(images: DataFrame, level: str) -> DataFrame:
    """One row per image object of a document: new width, and whether the new bytes replace the old.

    An image on several pages is sized for the narrowest one.
    """
    if level not in TARGET_DPI:
        raise ValueError(f"unknown compression level: {level}")
    objects = images.groupBy("doc_id", "object_id").agg(
        F.min("page_width").alias("page_width"), F.max("width_px").alias("width_px"), F.max("height_px").alias("height_px"),
        F.max("bits").alias("bits"), F.min("color_space").alias("color_space"), F.max("filter").alias("filter"),
        F.bool_or("masked").alias("masked"), F.bool_and("is_image").alias("is_image"),
        F.max("n_bytes").alias("n_bytes"), F.max("new_bytes").alias("new_bytes"),
    )
    inches, dpi = F.col("page_width") / 72, TARGET_DPI[level]
    want = F.greatest(F.round(F.lit(dpi or 0.0) * inches), F.lit(1.0)).cast("long")
    shrink = (F.col("page_width") > 0) & (F.col("width_px") / inches > F.lit(dpi or float("inf"))) & (want < F.col("width_px"))
    out = objects.withColumn("reason", ineligible_reason()).withColumn("new_width", F.when(shrink, want))
    return out.withColumn("replaced", F.col("reason").isNull() & (F.col("new_bytes") < F.col("n_bytes")))


def compress_report(plan: DataFrame) -> DataFrame:
    """Per document; a document that would not shrink is left as it was."""
    after = F.when(F.col("replaced"), F.col("new_bytes")).otherwise(F.col("n_bytes"))
    g = plan.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("images"), F.count_if("replaced").alias("_r"), F.sum("n_bytes").alias("before_bytes"), F.sum(after).alias("_a")
    )
    smaller = F.col("_a") < F.col("before_bytes")
    return g.select(
        "doc_id", "images", F.when(smaller, F.col("_r")).otherwise(0).alias("recompressed"),
        (F.col("images") - F.when(smaller, F.col("_r")).otherwise(0)).alias("untouched"), "before_bytes",
        F.when(smaller, F.col("_a")).otherwise(F.col("before_bytes")).alias("after_bytes"),
        F.greatest(F.col("before_bytes") - F.col("_a"), F.lit(0)).alias("saved_bytes"),
    )


def largest_savings(report: DataFrame, k: int) -> DataFrame:
    """Top-k documents by bytes saved; a partial top-k runs before anything moves."""
    return report.orderBy(F.desc("saved_bytes"), "doc_id").limit(k)


# -- hidden text and cleaning ----------------------------------------------------------------

INVISIBLE = (3, 7)


def drop_hidden_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(~F.coalesce("render_mode", F.lit(0)).isin(*INVISIBLE))


def hidden_run_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("doc_id").agg(F.count_if(F.col("render_mode").isin(*INVISIBLE)).alias("hidden"), F.count(F.lit(1)).alias("runs"))


CLEAN_CATEGORIES = ["comments", "attachments", "bookmarks", "form_values", "embedded_files", "hidden_text", "metadata", "xmp"]


def clean_report(removable: dict[str, DataFrame], options: list[str]) -> DataFrame:
    """Counts of what cleaning would remove, one row per document with a column per category.

    ``removable`` maps a category to a table with ``doc_id``; only the categories in ``options``
    count. Each table is counted before the counts are brought together.
    """
    for o in options:
        if o not in CLEAN_CATEGORIES:
            raise ValueError(f"unknown category: {o}")
    counted = [removable[c].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).withColumn("category", F.lit(c)) for c in options if c in removable]
    wide = union_all(counted).groupBy("doc_id").pivot("category", CLEAN_CATEGORIES).agg(F.sum("n"))
    out = wide.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in CLEAN_CATEGORIES])
    total = sum((F.col(c) for c in CLEAN_CATEGORIES[1:]), F.col(CLEAN_CATEGORIES[0]))
    return out.withColumn("is_empty", total == 0)


# -- OCR words ----------------------------------------------------------------------------------


def confident_words(words: DataFrame, minimum: float = 0.5) -> DataFrame:
    return words.filter(F.col("confidence") >= minimum)


def ocr_summary(words: DataFrame, minimum: float = 0.5) -> DataFrame:
    kept = F.col("confidence") >= minimum
    return words.groupBy("doc_id").agg(
        F.count_distinct("page_no").alias("pages"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("skipped")
    )


def ocr_page_text(words: DataFrame) -> DataFrame:
    g = words.groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list(F.struct("word_no", "text"))).alias("_w"))
    return g.select("doc_id", "page_no", F.array_join(F.col("_w.text"), " ").alias("text"))


def place_ocr_words(words: DataFrame, scans: DataFrame) -> DataFrame:
    """Word boxes in scan pixels to page points, baseline left, y up.

    ``scans`` has the page keys, ``scan_width``, ``scan_height``, ``scale``, ``skew_degrees`` and the
    page's visual ``width`` and ``height``. Scaling is undone, then the straightening.
    """
    j = words.join(scans.filter((F.col("scan_width") > 0) & (F.col("scan_height") > 0)), ["doc_id", "page_no"])
    s = F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)
    cx, cy = F.col("scan_width") / 2, F.col("scan_height") / 2
    angle = F.radians(-F.col("skew_degrees"))
    dx, dy = F.col("left") / s - cx, F.col("bottom") / s - cy
    rx, ry = dx * F.cos(angle) + dy * F.sin(angle) + cx, -dx * F.sin(angle) + dy * F.cos(angle) + cy
    kx, ky = F.col("width") / F.col("scan_width"), F.col("height") / F.col("scan_height")
    return j.select(
        "doc_id", "page_no", "word_no", "text", (rx * kx).alias("x"), (F.col("height") - ry * ky).alias("y"),
        ((F.col("right") - F.col("left")) / s * kx).alias("w"), ((F.col("bottom") - F.col("top")) / s * ky).alias("h"),
        (-F.col("skew_degrees")).alias("degrees"),
    )


# -- links -----------------------------------------------------------------------------------


# What each reason says; ``{pages}`` is the document's page count.
LINK_REASONS = {
    "empty": "Enter a value.",
    "url": "URL needs a scheme, e.g. https://",
    "email": "Enter a valid email address.",
    "page": "Page must be between 1 and {pages}.",
}
# The shape of a link's value.
LINK_SHAPES = {"url": r"(?i)^[a-z][a-z0-9+.\-]*://", "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$"}


def link_problem(kind: Column, value: Column, pages: Column) -> Column:
    """The reason code of a link whose trimmed value does not fit its kind, else null; named targets take any value."""
    number = value.try_cast("double")
    there = F.coalesce((number % 1 == 0) & number.between(F.lit(1), pages), F.lit(False))
    shaped = F.lit(True)
    for name, shape in LINK_SHAPES.items():
        shaped = F.when(kind == name, F.rlike(value, F.lit(shape))).otherwise(shaped)
    fits = F.when(kind == "page", there).otherwise(shaped)
    return F.when(value == "", "empty").when(~fits, kind)


def validate_links(links: DataFrame) -> DataFrame:
    """Add ``ok``, ``reason`` and the stored ``wire`` value; needs ``kind``, ``value``, ``page_count``."""
    v = F.trim("value")
    told = links.withColumn("_problem", link_problem(F.col("kind"), v, F.col("page_count")))
    text = F.element_at(F.create_map(*[F.lit(x) for pair in LINK_REASONS.items() for x in pair]), F.col("_problem"))
    out = told.withColumn("reason", F.replace(text, F.lit("{pages}"), F.col("page_count").cast("string"))).withColumn("ok", F.col("_problem").isNull())
    wire = F.when(F.col("kind") == "page", (v.try_cast("double").cast("long") - 1).cast("string")).otherwise(v)
    return out.withColumn("wire", F.when(F.col("ok"), wire)).drop("_problem")


def recovery_list(autosaves: DataFrame, copies: DataFrame) -> DataFrame:
    """The latest autosave of each document whose recovery copy exists."""
    live = autosaves.filter(F.col("doc_id").isNotNull() & F.col("saved_at").isNotNull()).join(copies, "doc_id", "left_semi")
    return live.groupBy("doc_id").agg(F.max_by("original_path", "saved_at").alias("original_path"), F.max("saved_at").alias("saved_at"))
