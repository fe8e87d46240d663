import html
import re

import pytest

from quireflow.llm.html_extract import extract, main_text

LONG = "This is a long sentence, with commas, that reads like an article. "
CASES = [
    ("", ""), ("<html><body></body></html>", ""), ("plain text &amp; more", "plain text & more"),
    ("<article><p>a</p><svg/><p>b <b>c</b>d</p></article>", "a\nb cd"),
    ("<article><p><b>one<br>two<p>three</article>", "one two\nthree"),
    (f"<div class=sidebar><p>{LONG}</p></div><div id=content><p>x.</p><p>{LONG * 3}</p></div><div class='comments'><p>{LONG}</p></div>", "x.\n" + (LONG * 3).strip()),
    ("<article><header><h1>T</h1></header><p>x</p><aside>z</aside><ul><li>one<li>two</ul><form><p>q</p></form></article><footer>f</footer>", "T\nx\none\ntwo"),
    (f"<nav><a>{LONG}</a></nav><p>{LONG}</p><div class='cookie-notice'>{LONG}</div><script>var x='<p>no</p>'</script><style>p{{}}</style>", LONG.strip()),
    ("<main><p>1 &lt; 2 &#x41;&nbsp;z \n\t q</p><!-- <p>c</p> --></main>", "1 < 2 A z q"),
    ("<article><p>p</p><div role='complementary'>x</div><section id='comments'>c</section><p>q</p></article>", "p\nq"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_written_pages(page, text):
    assert main_text(page) == text


def test_nested_and_malformed_pages_end():
    assert main_text("<div>" * 3000 + "deep") == "deep"
    assert main_text("<article><p>a</b></i></p></div><p>b") == "a\nb"
    assert main_text("<<<>>>&&& < a") != ""


def test_every_given_page_keeps_its_article(spark):
    """The given pages hold their text in article elements of headings and paragraphs."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract(rows).collect()}
    for r in rows.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", body))
        assert got[r["page_id"]] == "\n".join(x for x in parts if x)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>x</p>"), (2, "v", "<article>" + "<p>long text</p>" * 20000 + "</article>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' AS text", "1 AS n_chars")
    got = sorted((tuple(r) for r in extract(frame).collect()), key=repr)
    assert got == sorted([(1, "u", ""), (1, "u", ""), (None, None, "x"), (2, "v", "\n".join(["long text"] * 20000))], key=repr)
    assert extract(frame.limit(0)).collect() == []


PARAGRAPHS = "".join(f"<p>{LONG * 4}</p>" for _ in range(40))


@pytest.mark.parametrize(
    ("page", "parts"),
    [
        (f"<article>{PARAGRAPHS}<table><tr>{'<th>head1</th>' * 5}</tr>{('<tr>' + '<td>12345</td>' * 5 + '</tr>') * 4}</table></article>", ["12345"] * 20 + ["head1"] * 5),
        (f"<main>{PARAGRAPHS}<h2>Links</h2><ul>{'<li><a>one link</a></li>' * 12}</ul><h2>End</h2></main>", ["one link"] * 12),
        (f"<body class='right-sidebar'><main class='search-page'>{PARAGRAPHS}</main></body>", [(LONG * 4).strip()] * 40),
        (f"<body class='no-sidebar'><div class='content with-sidebar'>{PARAGRAPHS}</div></body>", [(LONG * 4).strip()] * 40),
    ],
)
def test_nothing_else_of_the_article_is_dropped(page, parts):
    lines = main_text(page).split("\n")
    assert [lines.count(x) for x in set(parts)] == [parts.count(x) for x in set(parts)]
