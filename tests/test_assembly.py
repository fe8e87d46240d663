"""Merging and inserting documents whole: chained bookmarks, renamed fields, first defaults."""

from quireflow.operators import assembly as Y
from quireflow.operators.hierarchy import qualified_names
from quireflow.operators.page_ranges import parse_pages


def tables(spark):
    pages = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0)], "doc_id long, page_no long")
    outline = spark.createDataFrame(
        [(1, 0, None, 0, "A", 0), (1, 5, None, 1, "B", 1), (1, 6, 5, 0, "B1", 1), (2, 0, None, 0, "C", 0)],
        "doc_id long, node_id long, parent_id long, seq long, title string, page long",
    )
    fields = spark.createDataFrame(
        [(1, 0, None, 0, "name"), (1, 1, 0, 0, "first"), (2, 0, None, 0, "name"), (2, 1, None, 1, None), (2, 2, None, 2, "name")],
        "doc_id long, field_id long, parent_id long, seq long, t string",
    )
    sources = spark.createDataFrame([(7, 0, 1), (7, 1, 2), (7, 2, 1), (8, 0, 3), (9, 0, 1), (9, 1, 44)], "merge_id long, source_ord long, doc_id long")
    return sources, pages, outline, fields


def test_bookmarks_of_all_sources_are_one_chain(spark):
    sources, pages, outline, fields = tables(spark)
    plan, refused = Y.merge_plan(sources, pages, outline, fields)
    assert {tuple(r) for r in refused.collect()} == {(8, Y.TOO_FEW), (9, Y.MISSING)}
    assert sorted(tuple(r) for r in plan.collect()) == [(7, 0, 1, 0, 0, 0), (7, 1, 2, 2, 7, 2), (7, 2, 1, 3, 8, 5)]
    got = {r["node_id"]: r for r in Y.merged_outline(plan, outline).collect()}
    assert set(got) == {0, 5, 6, 7, 8, 13, 14}
    chain, at = [], 0
    while at is not None:
        chain.append((got[at]["title"], got[at]["page"], got[at]["seq"]))
        assert got[at]["next_id"] is None or got[got[at]["next_id"]]["prev_id"] == at
        at = got[at]["next_id"]
    assert chain == [("A", 0, 0), ("B", 1, 1), ("C", 2, 2), ("A", 3, 3), ("B", 4, 4)]
    nested = [got[i] for i in (6, 14)]
    assert [(r["parent_id"], r["prev_id"], r["seq"], r["page"]) for r in nested] == [(5, None, 0, 1), (13, None, 0, 4)]
    new = sorted((r["doc_id"], r["source_ord"], r["new_page_no"]) for r in Y.merged_pages(plan, pages).collect())
    assert new == [(1, 0, 0), (1, 0, 1), (1, 2, 3), (1, 2, 4), (2, 1, 2)]


def test_a_renamed_field_renames_all_below_it(spark):
    sources, pages, outline, fields = tables(spark)
    plan, _ = Y.merge_plan(sources, pages, outline, fields)
    merged = Y.merged_fields(plan, fields)
    names = {r["field_id"]: r["qualified"] for r in qualified_names(merged, "merge_id").collect()}
    # The unnamed field keeps its place and counts for no name.
    assert names == {0: "name", 1: "name.first", 2: "name_2", 3: "", 4: "name_3", 5: "name_4", 6: "name_4.first"}


def test_first_defaults_win(spark):
    sources, pages, *_ = tables(spark)
    plan, _ = Y.merge_plan(sources, pages)
    defaults = spark.createDataFrame([(1, None), (2, "/Helv"), (3, "/No")], "doc_id long, appearance string")
    assert [tuple(r) for r in Y.merged_defaults(plan, defaults).collect()] == [(7, "/Helv")]
    fonts = spark.createDataFrame([(2, "F", "two"), (1, "F", "one"), (2, "G", "two")], "doc_id long, name string, value string")
    assert {tuple(r) for r in Y.merged_resources(plan, fonts).collect()} == {(7, "F", "one"), (7, "G", "two")}


def test_inserted_pages_bring_their_fields_and_inner_links(spark):
    pages = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (3, 0)], "doc_id long, page_no long")
    pairs = spark.createDataFrame([(1, 2), (3, 1), (2, 3)], "doc_id long, src_id long")
    spec = parse_pages("1,3")
    plan = Y.insert_plan(pairs, pages, spec, 1)
    assert [tuple(r) for r in plan.collect()] == [(1, 2, 2)]
    links = spark.createDataFrame([(1, 1, 0), (2, 0, 2), (2, 0, 1), (2, 1, 0)], "doc_id long, page_no long, target_page long")
    assert {tuple(r) for r in Y.inserted_links(plan, links, spec, 1).collect()} == {(1, 3, 0, 1), (1, 1, 2, 2)}
    outline = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (2, 0, 0)], "doc_id long, node_id long, page long")
    assert {tuple(r) for r in Y.inserted_outline(plan, outline, 1).collect()} == {(1, 0, 0), (1, 1, 3)}
    fields = spark.createDataFrame(
        [(1, 0, None, 0, "name", 0), (1, 1, None, 1, "name_2", 1), (1, 2, 0, 0, "kid", 0), (2, 0, None, 0, "name", 0), (2, 1, 0, 1, "kid", 2), (2, 2, None, 2, "name", 2), (2, 3, None, 3, "gone", 1), (2, 4, None, 4, "loose", None)],
        "doc_id long, field_id long, parent_id long, seq long, t string, page_no long",
    )
    got = {(r["from_id"], r["field_id"]): (r["parent_id"], r["t"], r["page_no"]) for r in Y.inserted_fields(plan, fields, spec, 1).collect()}
    assert got == {
        (1, 0): (None, "name", 0), (1, 1): (None, "name_2", 3), (1, 2): (0, "kid", 0),
        (2, 0): (None, "name_2", 1), (2, 1): (None, "kid", 2), (2, 2): (None, "name_3", 2),
    }


def test_a_merge_with_most_of_the_sources(spark):
    sources = spark.range(3000).selectExpr("IF(id % 10 < 8, 0, 1) AS merge_id", "id AS source_ord", "id % 50 AS doc_id")
    pages = spark.range(50).selectExpr("id AS doc_id", "explode(sequence(0L, id % 3)) AS page_no")
    plan, _ = Y.merge_plan(sources, pages)
    got = Y.merged_pages(plan, pages).groupBy("merge_id").agg({"new_page_no": "max", "page_no": "count"}).collect()
    assert all(r["max(new_page_no)"] == r["count(page_no)"] - 1 for r in got) and len(got) == 2
