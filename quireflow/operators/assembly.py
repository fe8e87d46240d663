"""Putting documents together: pages, bookmarks, links, form fields and defaults move under one remapping of keys.

A merge is planned once: per source, how far its pages, bookmark ids and field ids move. Each table of the documents is then rewritten by
one join with the plan, so they stay consistent however many tables there are. Offsets, ranks and counts are running values over blocks
(`scan.py`): a merge or a name that holds a third of all rows is not gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .page_ranges import PageSpec
from .pages import page_counts
from .scan import apart, block_of, dense_index, running

MERGE = ["merge_id", "source_ord"]
TOO_FEW, MISSING = "a merge needs at least two documents", "a document of the merge cannot be read"


def _extent(rows: DataFrame | None, key: str, out: str, sources: DataFrame) -> DataFrame:
    """``sources`` with the size of each document's id range."""
    if rows is None:
        return sources.withColumn(out, F.lit(0).cast("long"))
    top = rows.groupBy("doc_id").agg((F.max(key) + 1).alias(out))
    return sources.join(apart(top), "doc_id", "left").withColumn(out, F.coalesce(out, F.lit(0).cast("long")))


def merge_plan(sources: DataFrame, pages: DataFrame, outline: DataFrame | None = None, fields: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(plan, refused)`` of ``sources(merge_id, source_ord, doc_id)``; a document may occur more than once in a merge.

    The plan adds ``page_off``, ``node_off`` and ``field_off``, by which the pages, bookmark ids and field ids of that source move. ``refused`` names the
    merges of one source or with a document that has no pages, and says why.
    """
    sized = sources.join(apart(page_counts(pages).select("doc_id", F.col("page_count").alias("_pages"))), "doc_id", "left")
    state = sized.groupBy("merge_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_pages").isNull()).alias("_gone"))
    error = F.when(F.col("_n") < 2, TOO_FEW).when(F.col("_gone") > 0, MISSING)
    refused = state.select("merge_id", error.alias("error")).filter("error IS NOT NULL")
    kept = sized.join(apart(refused), "merge_id", "left_anti")
    kept = _extent(fields, "field_id", "_fields", _extent(outline, "node_id", "_nodes", kept))
    sums = {name: ("sum", F.col(col).cast("long")) for name, col in (("page_off", "_pages"), ("node_off", "_nodes"), ("field_off", "_fields"))}
    plan = running(kept, ["merge_id"], block_of("source_ord"), [F.col("source_ord")], sums, inclusive=False)
    return plan.select(*MERGE, "doc_id", *sums), refused


def merged_pages(plan: DataFrame, pages: DataFrame) -> DataFrame:
    """Every page with ``new_page_no``, sources one after another."""
    j = pages.join(apart(plan.select(*MERGE, "doc_id", "page_off")), "doc_id")
    return j.withColumn("new_page_no", (F.col("page_no") + F.col("page_off")).cast("long")).drop("page_off")


def merged_outline(plan: DataFrame, outline: DataFrame) -> DataFrame:
    """Bookmarks of all sources under new ids; top-level ones are one chain in source order, with ``prev_id``, ``next_id`` and a new ``seq``.

    Nested bookmarks keep their order below their parents; all pages move with their source.
    """
    moved = outline.join(apart(plan.select(*MERGE, "doc_id", "page_off", "node_off")), "doc_id").select(
        *MERGE, "doc_id", (F.col("node_id") + F.col("node_off")).alias("node_id"), (F.col("parent_id") + F.col("node_off")).alias("parent_id"),
        "seq", "title", (F.col("page") + F.col("page_off")).alias("page"),
    )
    top = moved.filter("parent_id IS NULL")
    order = [F.col("source_ord"), F.col("seq"), F.col("node_id")]
    block = F.struct(F.col("source_ord"), block_of("seq"))
    ranked = dense_index(top.select(*MERGE, "seq", "node_id"), ["merge_id"], block, order, "_rank")
    at = ranked.select("merge_id", "node_id", "_rank")
    before = at.select("merge_id", (F.col("_rank") + 1).alias("_rank"), F.col("node_id").alias("prev_id"))
    after = at.select("merge_id", (F.col("_rank") - 1).alias("_rank"), F.col("node_id").alias("next_id"))
    chain = at.join(apart(before), ["merge_id", "_rank"], "left").join(apart(after), ["merge_id", "_rank"], "left")
    j = moved.join(apart(chain), ["merge_id", "node_id"], "left")
    return j.withColumn("seq", F.coalesce("_rank", "seq").cast("long")).drop("_rank")


def merged_links(plan: DataFrame, links: DataFrame) -> DataFrame:
    """Links between pages, both ends moved with their source."""
    j = links.join(apart(plan.select(*MERGE, "doc_id", "page_off")), "doc_id")
    return j.withColumns({c: (F.col(c) + F.col("page_off")).cast("long") for c in ("page_no", "target_page")}).drop("page_off")


def merged_fields(plan: DataFrame, fields: DataFrame) -> DataFrame:
    """Form fields under new ids; the n-th top-level field of one name in a merge (n > 1) becomes ``name_n``, and with it all below it.

    ``fields`` is ``(doc_id, field_id, parent_id, seq, t, ...)``, ``seq`` the order of top-level fields in their form.
    """
    moved = fields.join(apart(plan.select(*MERGE, "doc_id", "field_off")), "doc_id")
    moved = moved.withColumns({c: (F.col(c) + F.col("field_off")).cast("long") for c in ("field_id", "parent_id")}).drop("field_off")
    top = moved.filter("parent_id IS NULL AND t IS NOT NULL").select(*MERGE, "seq", "field_id", "t")
    use = _nth_use(top, ["merge_id", "t"], F.struct(F.col("source_ord"), block_of("seq")), [F.col("source_ord"), F.col("seq"), F.col("field_id")])
    j = moved.join(apart(use.select("merge_id", "field_id", "_use")), ["merge_id", "field_id"], "left")
    return j.withColumn("t", _suffixed(F.col("_use"))).drop("_use")


def _nth_use(names: DataFrame, keys: list[str], block: Column, order: list[Column]) -> DataFrame:
    return running(names, keys, block, order, {"_use": ("sum", F.lit(1).cast("long"))})


def _suffixed(use: Column, name: str = "t") -> Column:
    return F.when(use > 1, F.concat(name, F.lit("_"), use.cast("string"))).otherwise(F.col(name))


def merged_defaults(plan: DataFrame, defaults: DataFrame) -> DataFrame:
    """``(merge_id, appearance)``: the first source's default appearance that has one."""
    j = defaults.filter("appearance IS NOT NULL").join(apart(plan.select(*MERGE, "doc_id")), "doc_id")
    return j.groupBy("merge_id").agg(F.min_by("appearance", "source_ord").alias("appearance"))


def merged_resources(plan: DataFrame, resources: DataFrame) -> DataFrame:
    """``(merge_id, name, value)``: of each resource name the first source's value."""
    j = resources.join(apart(plan.select(*MERGE, "doc_id")), "doc_id")
    return j.groupBy("merge_id", "name").agg(F.min_by("value", "source_ord").alias("value"))


# -- pages of one document put into another ---------------------------------------------------


def insert_plan(pairs: DataFrame, pages: DataFrame, spec: PageSpec, at: int) -> DataFrame:
    """``(doc_id, src_id, added)`` of the pairs that fit: ``at`` within the document and the chosen pages within the source."""
    n = page_counts(pages)
    src_n = n.select(F.col("doc_id").alias("src_id"), F.col("page_count").alias("_src_n"))
    ok = pairs.join(apart(n), "doc_id").join(apart(src_n), "src_id").filter((F.col("page_count") >= at) & spec.error(F.col("_src_n")).isNull())
    return ok.select("doc_id", "src_id", spec.before(F.col("_src_n")).alias("added"))


def _pushed(page: str, at: int) -> Column:
    """Where a page of the receiving document goes."""
    return (F.col(page) + F.when(F.col(page) >= at, F.col("added")).otherwise(0)).cast("long")


def _landed(page: str, spec: PageSpec, at: int) -> Column:
    """Where a chosen page of the source goes."""
    return (F.lit(at) + spec.before(F.col(page))).cast("long")


def inserted_outline(plan: DataFrame, outline: DataFrame, at: int) -> DataFrame:
    """The receiving documents' bookmarks on their moved pages; pages are taken from a source without its bookmarks."""
    return outline.join(apart(plan.select("doc_id", "added")), "doc_id").withColumn("page", _pushed("page", at)).drop("added")


def inserted_links(plan: DataFrame, links: DataFrame, spec: PageSpec, at: int) -> DataFrame:
    """``(doc_id, page_no, target_page, from_id)``: own links moved, and those of inserted pages whose target came along; others have no page to go to."""
    own = links.join(apart(plan.select("doc_id", "added")), "doc_id")
    own = own.select("doc_id", _pushed("page_no", at).alias("page_no"), _pushed("target_page", at).alias("target_page"), F.col("doc_id").alias("from_id"))
    chosen = links.filter(spec.contains(F.col("page_no")) & spec.contains(F.col("target_page"))).withColumnRenamed("doc_id", "src_id")
    came = chosen.join(apart(plan.select("doc_id", "src_id")), "src_id")
    came = came.select("doc_id", _landed("page_no", spec, at).alias("page_no"), _landed("target_page", spec, at).alias("target_page"), F.col("src_id").alias("from_id"))
    return own.unionByName(came)


def inserted_fields(plan: DataFrame, fields: DataFrame, spec: PageSpec, at: int) -> DataFrame:
    """The form of each receiving document: its fields, then the fields with a widget on the inserted pages, by page and ``seq``.

    ``fields`` is ``(doc_id, field_id, parent_id, seq, t, page_no)``; ``page_no`` is that of a field's widget, null for a field without. Only
    fields with a widget come along, each at top level. A name that n - 1 earlier top-level fields have (n > 1) becomes ``name_n``.
    Returns ``(doc_id, from_id, field_id, parent_id, t, page_no)``; ids are those of the document they come from.
    """
    own = fields.join(apart(plan.select("doc_id", "added")), "doc_id").select(
        "doc_id", F.col("doc_id").alias("from_id"), "field_id", "parent_id", "t", _pushed("page_no", at).alias("page_no"))
    widgets = fields.filter(F.col("t").isNotNull() & F.coalesce(spec.contains(F.col("page_no")), F.lit(False))).withColumnRenamed("doc_id", "src_id")
    came = widgets.join(apart(plan.select("doc_id", "src_id")), "src_id").select(
        "doc_id", F.col("src_id").alias("from_id"), "field_id", F.lit(None).cast("long").alias("parent_id"), "t",
        _landed("page_no", spec, at).alias("page_no"), "seq",
    )
    # Own fields keep their names: they are counted, and only those that come are put in order.
    use = _nth_use(came, ["doc_id", "t"], F.struct(block_of("page_no"), block_of("seq")), [F.col("page_no"), F.col("seq"), F.col("field_id")])
    had = own.filter("parent_id IS NULL AND t IS NOT NULL").groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("_had"))
    use = use.join(apart(had), ["doc_id", "t"], "left").withColumn("t", _suffixed(F.col("_use") + F.coalesce("_had", F.lit(0))))
    return own.unionByName(use.select(*own.columns))
