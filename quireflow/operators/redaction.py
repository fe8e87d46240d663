"""Redaction by region: what happens to each run and image under a rectangle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_no"]


def _page_regions(regions: DataFrame) -> DataFrame:
    r = F.struct("region_no", "x0", "y0", "x1", "y1")
    return regions.groupBy(*PAGE).agg(F.sort_array(F.collect_list(r)).alias("_regions"))


def redact_region(runs: DataFrame, regions: DataFrame) -> DataFrame:
    """Verdict of each run: keep, remove, split (a clean prefix is kept) or unmeasurable.

    Regions are applied one after another, each to what the one before left. A glyph goes when
    any of its advance is inside. A cut that would leave a later part, and a run that cannot be
    measured (``measurable`` false), goes whole. A page's regions travel as one short array,
    so runs are not multiplied.
    """
    j = runs.join(_page_regions(regions), PAGE, "left")
    if "measurable" not in runs.columns:
        j = j.withColumn("measurable", F.lit(True))
    j = j.withColumn("_adv", (F.col("right") - F.col("left")) / F.length("text"))
    glyphs = (
        "array_join(transform(filter(transform(split(a.t, ''), (c, i) -> named_struct('c', c, 'x', left + i * _adv)), "
        "g -> NOT (g.x + _adv > r.x0 AND g.x < r.x1)), g -> g.c), '')"
    )
    verdict = (
        "transform(array({g}), k -> CASE WHEN NOT measurable THEN if(left <= r.x1, named_struct('t', '', 'v', 'unmeasurable'), a) "
        "WHEN k = a.t THEN a WHEN k = '' THEN named_struct('t', '', 'v', 'remove') "
        "WHEN startswith(a.t, k) THEN named_struct('t', k, 'v', 'split') ELSE named_struct('t', '', 'v', 'unmeasurable') END)[0]"
    ).format(g=glyphs)
    fold = (
        "aggregate(coalesce(_regions, filter(_regions, x -> false), array()), named_struct('t', text, 'v', 'keep'), "
        f"(a, r) -> if(a.t = '' OR top > r.y1 OR bottom < r.y0, a, {verdict}))"
    )
    # An empty list keeps its element type by coming from a typed null.
    fold = fold.replace("coalesce(_regions, filter(_regions, x -> false), array())", "coalesce(_regions, slice(array(named_struct("
                        "'region_no', 0L, 'x0', 0D, 'y0', 0D, 'x1', 0D, 'y1', 0D)), 1, 0))")  # fmt: skip
    out = j.withColumn("_v", F.expr(fold))
    return out.withColumn("verdict", F.col("_v.v")).withColumn("kept_text", F.col("_v.t")).drop("_v", "_adv", "_regions", "measurable")


def images_in_region(images: DataFrame, regions: DataFrame) -> DataFrame:
    """Images that overlap a region of their page; touching edges do not count."""
    r = regions.select(*PAGE, F.col("x0").alias("_x0"), F.col("y0").alias("_y0"), F.col("x1").alias("_x1"), F.col("y1").alias("_y1"))
    cond = [images[c] == r[c] for c in PAGE]
    over = (images["right"] > r["_x0"]) & (images["left"] < r["_x1"]) & (images["bottom"] > r["_y0"]) & (images["top"] < r["_y1"])
    return images.join(r, [*cond, over], "left_semi")


def redact_report(verdicts: DataFrame, removed_images: DataFrame) -> DataFrame:
    v = verdicts.groupBy("doc_id").agg(
        F.count_if(F.col("verdict") == "remove").alias("removed"), F.count_if(F.col("verdict") == "split").alias("split"),
        F.count_if(F.col("verdict") == "unmeasurable").alias("removed_for_safety"),
    )
    i = removed_images.groupBy("doc_id").agg(F.count(F.lit(1)).alias("images"))
    return v.join(i, "doc_id", "left").withColumn("images", F.coalesce("images", F.lit(0)))


def sub_rect(start: Column, end: Column) -> Column:
    """Box of a match inside its run, from even advances; the whole run when it cannot be measured."""
    adv = (F.col("right") - F.col("left")) / F.length("text")
    ok = (F.length("text") > 0) & (start >= 0) & (end <= F.length("text"))
    x0 = F.when(ok, F.col("left") + adv * start).otherwise(F.col("left"))
    x1 = F.when(ok, F.col("left") + adv * end).otherwise(F.col("right"))
    return F.struct(x0.alias("x0"), F.col("top").alias("y0"), x1.alias("x1"), F.col("bottom").alias("y1"))
