"""Paragraphs, items and cells whose end tags are left out do not nest."""

from quireflow.sources import html


def test_open_paragraphs_and_items_are_not_deep(spark):
    pages = [
        (0, "<p>a" * 300), (1, "<ul>" + "<li>a" * 300 + "</ul>"), (2, "<div>" * 300 + "a"), (3, "<ul><li>" * 150 + "a"), (4, "<table>" + "<tr><td>a" * 300 + "</table>"),
        (5, "<p><b>a" * 150),
    ]
    blocks, warnings = html.parse_html(spark.createDataFrame(pages, "page_id long, html string"))
    assert {r["page_id"] for r in warnings.collect() if r["warning"] == html.WARN_DEPTH} == {2, 3}
    counts = {r["page_id"]: r["count"] for r in blocks.filter("text <> ''").groupBy("page_id").count().collect()}
    assert counts[0] == counts[1] == 300 and counts[5] == 150
