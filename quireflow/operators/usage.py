"""Corpus-wide usage: mergeable sketches of distinct values, glyph sets of shared font files, and what a clean would remove."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reports import INVISIBLE
from .scan import union_all

# -- distinct values --------------------------------------------------------------------------


def value_sketches(df: DataFrame, keys: list[str], value: Column, lg_k: int = 12) -> DataFrame:
    """``(keys..., sketch)``: one sketch of the distinct values per key, of bounded size, to be stored and merged later; nulls are no value."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(value, lg_k).alias("sketch"))


def merged_estimates(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., estimate)`` over any coarser keys, from stored sketches alone."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


# -- glyphs of shared font files -----------------------------------------------------------------


def glyph_bitmaps(uses: DataFrame) -> DataFrame:
    """``(doc_id, file_id, bucket, bitmap)`` of the code points that each document draws with each font file; texts leave their rows as bits.

    ``uses`` is ``(doc_id, file_id, text, readable)``. A use whose text cannot be read gives no bits here. Each character of a document counts
    once before bits are set: bitmaps are built from sorted rows, and those would be all characters of all texts.
    """
    drawn = uses.filter("readable").select("doc_id", "file_id", F.explode_outer(F.split("text", "")).alias("c")).filter("c <> ''")
    once = drawn.distinct().select("doc_id", "file_id", F.ascii("c").cast("long").alias("cp"))  # of any character, not only ASCII ones
    bucket = F.bitmap_bucket_number("cp").alias("bucket")
    return once.groupBy("doc_id", "file_id", bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cp")).alias("bitmap"))


def shared_glyphs(uses: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``(file_id, documents, kept_whole, glyphs)`` of each font file over all documents that share it.

    One unreadable use keeps the whole file, as any glyph may be drawn there: ``glyphs`` is null then. A file that is used but never drawn with has 0.
    """
    files = uses.groupBy("file_id").agg(F.count_distinct("doc_id").alias("documents"), (~F.bool_and("readable")).alias("kept_whole"))
    merged = bitmaps.groupBy("file_id", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bitmap")).alias("n"))
    counts = merged.groupBy("file_id").agg(F.sum("n").alias("n"))
    glyphs = F.when(~F.col("kept_whole"), F.coalesce("n", F.lit(0))).cast("long")
    return files.join(counts, "file_id", "left").select("file_id", "documents", "kept_whole", glyphs.alias("glyphs"))


# -- cleaning ---------------------------------------------------------------------------------

# The annotation subtypes that count as comments.
MARKUP_SUBTYPES = [
    "Text", "FreeText", "Line", "Square", "Circle", "Polygon", "PolyLine", "Highlight", "Underline", "Squiggly",
    "StrikeOut", "Stamp", "Caret", "Ink", "Popup", "Sound", "Movie", "Redact",
]
ATTACHMENT = "FileAttachment"
CLEAN_COUNTS = ["info_keys", "xmp_packets", "hidden_text_runs", "comments", "attachments", "bookmarks", "form_fields", "embedded_files"]


@dataclass(frozen=True)
class CleanOptions:
    """What a clean removes; everything is off unless asked for."""

    metadata: bool = False
    hidden_text: bool = False
    comments: bool = False
    attachments: bool = False
    bookmarks: bool = False
    form_data: bool = False
    embedded_files: bool = False

    def counts(self) -> list[str]:
        asked = {"info_keys": self.metadata, "xmp_packets": self.metadata, "hidden_text_runs": self.hidden_text, "form_fields": self.form_data}
        return [c for c in CLEAN_COUNTS if asked.get(c, getattr(self, c, False))]


def _removable(table: str, df: DataFrame) -> DataFrame:
    """``(doc_id, removes)`` of the rows of one table that some option removes."""
    if table == "annotations":
        kind = F.when(F.col("subtype").isin(*MARKUP_SUBTYPES), "comments").when(F.col("subtype") == ATTACHMENT, "attachments")
        return df.select("doc_id", kind.alias("removes")).filter("removes IS NOT NULL")
    if table == "fields":
        df = df.filter("value IS NOT NULL OR default_value IS NOT NULL")
    if table == "runs":
        df = df.filter(F.col("render_mode").isin(*INVISIBLE))
    names = {"info": "info_keys", "xmp": "xmp_packets", "runs": "hidden_text_runs", "outline": "bookmarks", "fields": "form_fields", "embedded_files": "embedded_files"}
    if table not in names:
        raise ValueError(f"unknown table: {table}")
    return df.select("doc_id", F.lit(names[table]).alias("removes"))


def clean_documents(documents: DataFrame, tables: dict[str, DataFrame], options: CleanOptions) -> DataFrame:
    """What cleaning removes from each row of ``documents``: one row per document with a count per category, and one with the totals (``doc_id`` null).

    ``tables`` may hold ``annotations(doc_id, subtype)``, ``fields(doc_id, value, default_value)``, ``runs(doc_id, render_mode)``, ``outline``, ``info`` (a row
    per key), ``xmp`` and ``embedded_files``; the rules of what counts are applied here. A document from which nothing goes ``is_empty``.
    All tables are one stream of tags, counted by document and overall in one pass.
    """
    tags = union_all([documents.select("doc_id", F.lit("").alias("removes")), *[_removable(t, df) for t, df in tables.items()]])
    asked = options.counts()
    kept = tags.join(documents.select("doc_id"), "doc_id", "left_semi").filter(F.col("removes").isin("", *asked))
    n = kept.groupingSets([["doc_id", "removes"], ["removes"]], "doc_id", "removes").agg(F.count(F.lit(1)).alias("n"), F.grouping("doc_id").alias("all"))
    wide = n.groupBy("doc_id", "all").agg(*[F.sum(F.when(F.col("removes") == c, F.col("n")).otherwise(0)).alias(c) for c in CLEAN_COUNTS])
    total = sum((F.col(c) for c in CLEAN_COUNTS[1:]), F.col(CLEAN_COUNTS[0]))
    return wide.select("doc_id", *CLEAN_COUNTS, (total == 0).alias("is_empty"))
