"""Reading order, paragraphs and tables against step-by-step references and written cases."""

import random

from pyspark.sql import functions as F

from quireflow.operators import layout as L
from quireflow.operators import tables as T

RUN = "doc_id long, page_no long, run_no long, text string, left double, right double, top double, bottom double, size double, bold boolean, italic boolean"


def runs(spark, rows):
    """rows of (page, text, left, right, top, bottom[, size, bold, italic])"""
    full = [(1, r[0], i, *r[1:6], *(r[6:] or (9.0, False, False))) for i, r in enumerate(rows)]
    full = [tuple(float(x) if isinstance(x, int) and 4 <= k <= 8 else x for k, x in enumerate(r)) for r in full]
    return spark.createDataFrame(full, RUN)


def order_reference(pieces):
    """(run_no, column, line, seq) by walking the pieces one at a time."""
    spans = []
    for p in sorted(pieces, key=lambda p: p["left"]):
        if spans and p["left"] <= spans[-1][1] + 36:
            spans[-1][1] = max(spans[-1][1], p["right"])
        else:
            spans.append([p["left"], p["right"]])
    groups = [pieces]
    if 2 <= len(spans) <= 4:
        groups = [[p for p in pieces if a <= (p["left"] + p["right"]) / 2 <= b] for a, b in spans]
    out = []
    for c, group in enumerate(groups):
        lines = []
        for p in sorted(group, key=lambda p: ((p["top"] + p["bottom"]) / 2, p["run_no"])):
            mid, tol = (p["top"] + p["bottom"]) / 2, max((p["bottom"] - p["top"]) / 2, 1.0)
            if lines and abs((lines[-1][0]["top"] + lines[-1][0]["bottom"]) / 2 - mid) <= tol:
                lines[-1].append(p)
            else:
                lines.append([p])
        for n, line in enumerate(lines):
            for s, p in enumerate(sorted(line, key=lambda p: p["left"])):
                out.append((p["run_no"], c, n, s))
    return sorted(out)


def test_reading_order_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for page in range(12):
        for _ in range(rng.randrange(1, 60)):
            left, top, h = rng.randrange(0, 500, 7) + rng.random(), rng.randrange(0, 300) + rng.random(), rng.choice([2, 8, 12, 30])
            rows.append((page, "w", left, left + rng.choice([5, 20, 60]), top, top + h))
    df = runs(spark, rows)
    got = {}
    for r in L.reading_order(df).collect():
        got.setdefault(r.page_no, []).append((r.run_no, r.column_no, r.line_no, r.seq))
    pages = {}
    for r in df.collect():
        pages.setdefault(r.page_no, []).append(r.asDict())
    for page, pieces in pages.items():
        assert sorted(got[page]) == order_reference(pieces), page


def test_two_columns_are_read_one_after_the_other(spark):
    rows = [(0, f"{w} {n}", x, x + 60, 100 + 28 * n, 112 + 28 * n) for n in range(3) for w, x in (("Alpha", 72), ("Beta", 330))]
    text = L.page_text(L.reading_lines(runs(spark, rows))).first()["text"]
    assert text == "Alpha 0\nAlpha 1\nAlpha 2\nBeta 0\nBeta 1\nBeta 2\n"


def test_five_columns_are_one(spark):
    rows = [(0, str(c), c * 100, c * 100 + 20, 10, 22) for c in range(5)]
    assert {r.column_no for r in L.reading_order(runs(spark, rows)).collect()} == {0}


def test_space_rule_and_blank_lines(spark):
    rows = [(0, "a ", 0, 10, 10, 20), (0, "b", 11, 20, 10, 20), (0, "c", 21, 30, 10, 20), (0, "  ", 0, 10, 50, 60), (0, "d ", 0, 9, 90, 99)]
    assert L.page_text(L.reading_lines(runs(spark, rows))).first()["text"] == "a b c\nd\n"


def test_document_text_keeps_an_empty_page_between_pages(spark):
    pages = spark.createDataFrame([(1, 0, ""), (1, 1, "a\n"), (1, 2, ""), (1, 3, "b\n"), (2, 0, "")], "doc_id long, page_no long, text string")
    got = {r.doc_id: (r.text, r.pages, r.characters) for r in L.document_text(pages).collect()}
    assert got == {1: ("a\n\n\nb\n", 4, 6), 2: ("", 1, 0)}


def test_body_size_ties_go_to_the_smaller(spark):
    df = runs(spark, [(0, "abcd", 0, 1, 0, 9, 12.0, False, False), (0, "ab cd", 0, 1, 20, 29, 9.0, False, False), (0, "x", 0, 1, 40, 49, 24.0, False, False)])
    assert L.body_size(df).first()["body"] == 9.0
    assert [(r.bucket, r.rank) for r in L.heading_sizes(df).orderBy("rank").collect()] == [(240, 0), (120, 1)]


def test_paragraphs_headings_and_styles(spark):
    rows = [
        (0, "Title", 72, 200, 100, 118, 18.0, True, False),
        (0, "one", 72, 90, 130, 142), (0, "two", 96, 110, 130, 142, 9.0, True, False), (0, "three", 72, 100, 144, 156),
        (0, "indented", 110, 150, 158, 170), (0, "far", 110, 130, 220, 232),
    ]
    df = runs(spark, [r if len(r) > 6 else (*r, 9.0, False, False) for r in rows])
    lines = L.paragraph_breaks(L.heading_level(L.reading_lines(df), L.size_stats(df)))
    got = [(r.heading, [(x.text, x.bold) for x in r.runs]) for r in L.paragraphs(lines).orderBy("par_no").collect()]
    assert got == [
        (1, [("Title", True)]),
        (None, [("one", False), ("two ", True), ("three", False)]),
        (None, [("indented", False)]),
        (None, [("far", False)]),
    ]


def test_a_wide_line_a_little_larger_is_no_heading(spark):
    df = runs(spark, [(0, "x" * 50, 0, 300, 0, 12, 12.0, False, False), (0, "y" * 200, 0, 300, 20, 30, 9.0, False, False), (0, "z", 0, 100, 60, 72, 12.0, False, False)])
    got = L.heading_level(L.reading_lines(df), L.size_stats(df)).orderBy("line_no").collect()
    assert [r.heading for r in got] == [None, None, 1]


RULE = "doc_id long, page_no long, horizontal boolean, position double, lo double, hi double"


def grid(spark, extra=()):
    rows = [(1, 0, True, float(y), 72.0, 500.0) for y in range(152, 249, 24)] + [(1, 0, False, float(x), 152.0, 248.0) for x in (72, 220, 360, 500)]
    return spark.createDataFrame([*rows, *extra], RULE)


def test_grid_with_decoys(spark):
    extra = [(1, 0, True, 86.0, 72.0, 540.0), (1, 0, True, 296.0, 72.0, 540.0), (1, 0, True, 164.0, 80.0, 110.0), (1, 0, True, 152.4, 72.0, 500.0), (1, 0, False, 220.4, 152.0, 248.0)]
    t = T.detect_tables(T.usable_rules(grid(spark, extra))).collect()
    assert [(r.columns, r.rows) for r in t] == [([72.0, 220.0, 360.0, 500.0], [152.0, 176.0, 200.0, 224.0, 248.0])]
    assert T.table_cells(T.detect_tables(grid(spark, extra))).count() == 12


def test_two_grids_on_a_page_and_too_few_rules(spark):
    second = [(1, 0, h, p + (300 if h else 0), lo + (0 if h else 300), hi + (0 if h else 300)) for _, _, h, p, lo, hi in grid(spark).collect()]
    assert T.detect_tables(grid(spark, second)).count() == 2
    few = grid(spark).filter("horizontal OR position < 300")
    assert T.detect_tables(few).count() == 0


def test_a_centre_on_a_shared_edge_is_in_both_cells(spark):
    cells = T.detect_tables(grid(spark))
    df = runs(spark, [(0, "12.5", 210, 230, 160, 170), (0, "x", 80, 100, 181, 191), (0, "y", 102, 110, 181, 191)])
    got = {(r.row_no, r.col_no): r.text for r in T.table_rows(df, cells).collect() if r.text}
    assert got == {(0, 0): "12.5", (0, 1): "12.5", (1, 0): "x y"}
    assert T.table_rows(df, cells).count() == 12


def test_cluster_keeps_the_first(spark):
    df = spark.createDataFrame([([5.0, 1.0, 2.5, 3.5, 6.0],)], "p array<double>")
    assert df.select(T.cluster_positions(F.col("p")).alias("c")).first()["c"] == [1.0, 3.5, 6.0]


def test_numbers_in_cells(spark):
    texts = ["12", "-1.5", "+.5", "5.", ".", "1,000", "5%", "1e3", "", "1.2.3", "9" * 400]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.cell_number(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [12.0, -1.5, 0.5, 5.0, None, None, None, None, None, None, None]


def test_blocks_and_html(spark):
    rows = [(0, "above", 72, 110, 100, 112), (0, "<in>", 80, 100, 155, 165), (0, "below", 72, 110, 400, 412)]
    df = runs(spark, rows)
    tabs = T.detect_tables(grid(spark))
    lines = L.reading_lines(T.exclude_table_runs(df, tabs))
    lines = L.paragraph_breaks(L.heading_level(lines, L.size_stats(df)))
    images = spark.createDataFrame([(1, 0, 0), (1, 2, 0)], "doc_id long, page_no long, image_no long")
    b = T.document_blocks(lines, tabs, images)
    assert [(r.page_no, r.kind, r.text) for r in b.orderBy("page_no", "block_no").collect()] == [
        (0, "paragraph", "above"), (0, "table", None), (0, "paragraph", "below"), (0, "image", None), (2, "image", None),
    ]
    assert tuple(T.block_counts(b).first()) == (1, 2, 2, 0, 2, 1)
    cells = T.table_cells(tabs)
    sizes = images.withColumns({"width_points": F.lit(72.0), "height_points": F.lit(0.1)})
    html = T.blocks_to_html(b, T.table_html(cells, T.cell_paragraphs(df, tabs)), "my files", sizes).orderBy("page_no").collect()
    assert html[0].html.startswith("<p>above</p>\n<table><tbody><tr><td><p>&lt;in&gt;</p></td><td></td>")
    assert html[0].html.endswith('<p>below</p>\n<p><img src="my%20files/image-001.png" width="96" height="1" alt=""></p>')
    assert html[1].html == '<p><img src="my%20files/image-002.png" width="96" height="1" alt=""></p>'


def test_rotated_pages(spark):
    df = runs(spark, [(p, "w", 10, 30, 20, 25) for p in range(4)])
    pages = spark.createDataFrame([(1, p, p * 90, 600.0, 800.0) for p in range(4)], "doc_id long, page_no long, rotate long, width double, height double")
    got = [(r.left, r.right, r.top, r.bottom) for r in L.to_visual(df, pages).orderBy("page_no").collect()]
    assert got == [(10, 30, 775, 780), (575, 580, 770, 790), (570, 590, 20, 25), (20, 25, 10, 30)]


def test_page_windows_share_one_shuffle(spark):
    """Columns, lines and page text run on a single exchange of the runs."""
    rows = [(p, "w", 10 * i, 10 * i + 5, 20, 30) for p in range(3) for i in range(5)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = L.page_text(L.reading_lines(runs(spark, rows)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_bisect_counts_entries_below(spark):
    from quireflow.functions.folds import bisect

    rng = random.Random(3)
    rows = [(sorted({float(rng.randrange(30)) for _ in range(n)}), float(rng.randrange(-2, 32))) for n in [*range(12)] * 6]
    df = spark.createDataFrame(rows, "a array<double>, x double").select("a", "x", bisect(F.col("a"), F.col("x")), bisect(F.col("a"), F.col("x"), right=True))
    assert all((lo, hi) == (sum(v < x for v in a), sum(v <= x for v in a)) for a, x, lo, hi in df.collect())


def test_bisect_halves_long_arrays(spark):
    from quireflow.functions.folds import bisect

    rows = [([float(i) for i in range(0, 2 * n, 2)], float(x)) for n in (15, 16, 17, 40) for x in (-1, 0, 7, 30, 31, 78, 90)]
    df = spark.createDataFrame(rows, "a array<double>, x double").select("a", "x", bisect(F.col("a"), F.col("x")), bisect(F.col("a"), F.col("x"), right=True))
    assert all((lo, hi) == (sum(v < x for v in a), sum(v <= x for v in a)) for a, x, lo, hi in df.collect())


def test_runs_find_their_cells_in_several_tables(spark):
    rng = random.Random(8)
    tabs = [(d, 0, t, sorted(float(v) for v in rng.sample(range(0, 400, 20), 6)), sorted(float(v) + 300 * t for v in rng.sample(range(0, 280, 20), 5))) for d in range(3) for t in range(3)]
    places = [(d, 0, i, float(rng.randrange(0, 420, 10)), float(rng.randrange(0, 900, 10))) for d in range(3) for i in range(400)]
    df = spark.createDataFrame([(d, p, i, x - 5, x + 5, y - 2, y + 2) for d, p, i, x, y in places], "doc_id long, page_no long, run_no long, left double, right double, top double, bottom double")
    got = T.assign_cells(df, spark.createDataFrame(tabs, "doc_id long, page_no long, table_no long, columns array<double>, rows array<double>"))
    want = {
        (d, i, t, r, c)
        for d, _, i, x, y in places
        for e, _, t, columns, rows in tabs
        if d == e
        for r in range(len(rows) - 1)
        if rows[r] <= y <= rows[r + 1]
        for c in range(len(columns) - 1)
        if columns[c] <= x <= columns[c + 1]
    }
    rows = got.select("doc_id", "run_no", "table_no", "row_no", "col_no").collect()
    assert want and len(rows) == len(want) and {tuple(r) for r in rows} == want
