"""Page algebra: facts, invariants, hot documents."""

import random

import pytest
from pyspark.sql import functions as F

from quireflow.operators import pages as P
from quireflow.operators.page_ranges import parse_pages, parse_split_points
from quireflow.operators.scan import block_of, dense_index, running


def book(spark, *sizes):
    rows = [(d, p, 100 + (d * 7 + p * 13) % 50, 0, 612.0, 792.0) for d, n in enumerate(sizes) for p in range(n)]
    return spark.createDataFrame(rows, "doc_id long, page_no long, n_bytes long, rotate long, width double, height double")


def table(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_page_texts():
    assert parse_pages("").every and parse_pages(" ALL ").every
    assert parse_pages("3, 1-2,2").merged() == [(0, 2)]
    with pytest.raises(ValueError, match="isn't a page"):
        parse_pages("1-x")
    with pytest.raises(ValueError, match="at least one"):
        parse_pages(" , ")
    assert parse_split_points("4, 2,4") == [2, 4]
    with pytest.raises(ValueError):
        parse_split_points("two")


def test_selection_errors_name_the_token(spark):
    b = book(spark, 3, 5)
    err = {r.doc_id: r.error for r in P.page_spec_errors(b, parse_pages("2, 4-5")).collect()}
    assert err == {0: 'Range "4-5" is outside 1–3.'}
    assert table(P.select_pages(b, parse_pages("2, 4-5")), "doc_id", "page_no") == [(1, 1), (1, 3), (1, 4)]
    assert {r.error for r in P.page_spec_errors(b, parse_pages("5-2")).collect()} == {'Range "5-2" is outside 1–3.', 'Range "5-2" is outside 1–5.'}


def test_delete_then_restore_is_the_identity(spark):
    b = book(spark, 3, 5, 1)
    left, gone = P.delete_pages(b, parse_pages("1"))
    assert table(P.restore_pages(left, gone), *b.columns) == table(b, *b.columns)
    # a document is never emptied
    assert (2, 0) in table(left, "doc_id", "page_no")


def test_split_of_a_merge_gives_the_parts_back(spark):
    b = book(spark, 3, 3, 3).withColumn("set", F.lit(1))
    m = P.merge_documents(b, "set", "doc_id").select(F.lit(9).cast("long").alias("doc_id"), F.col("new_page_no").alias("page_no"), F.col("doc_id").alias("was"))
    parts = P.split_every_n(m, 3)
    assert all(r.was == r.part_no and r.error is None for r in parts.collect())


def test_reorder_then_inverse_is_the_identity(spark):
    b = book(spark, 6)
    order = b.select("doc_id", "page_no", ((F.col("page_no") * 5 + 2) % 6).alias("new_page_no"))
    moved = P.reorder_pages(b, order).select("doc_id", F.col("new_page_no").alias("page_no"), F.col("page_no").alias("was"))
    back = P.reorder_pages(moved, P.inverse_order(order))
    assert all(r.new_page_no == r.was for r in back.collect())
    bad = order.withColumn("new_page_no", F.lit(0).cast("long"))
    assert P.reorder_pages(b, bad).count() == 0 and P.reorder_errors(b, bad).count() == 1


def test_bates_numbers_have_no_gap(spark):
    b = book(spark, *[(i * 7) % 11 + 1 for i in range(60)])
    rows = table(P.bates_number(b, "X", padding=3, start=5), "doc_id", "page_no", "bates_no", "bates")
    assert [r[2] for r in rows] == list(range(5, 5 + len(rows)))
    assert rows[0][3] == "X005"
    with pytest.raises(ValueError):
        P.bates_number(b, start=-1)


def test_bates_label_is_never_cut(spark):
    from quireflow.functions.numbering import bates_label

    assert spark.range(1).select(bates_label(F.lit(12345), "", "", 3).alias("x")).first()["x"] == "12345"


def greedy(sizes, limit):
    part, total, out = 0, 0, []
    for i, n in enumerate(sizes):
        if i and total + n > limit:
            part, total = part + 1, 0
        total += n
        out.append(part)
    return out


def test_split_by_size(spark):
    rng = random.Random(5)
    sizes = {d: [rng.choice([10, 40, 70, 250]) for _ in range(n)] for d, n in enumerate((1, 2, 40, 75))}
    rows = [(d, p, s) for d, ss in sizes.items() for p, s in enumerate(ss)]
    df = spark.createDataFrame(rows, "doc_id long, page_no long, n_bytes long")
    got = table(P.split_by_size(df, 200), "doc_id", "page_no", "part_no")
    assert got == [(d, p, part) for d, ss in sizes.items() for p, part in enumerate(greedy(ss, 200))]


def test_running_values_equal_plain_windows_on_a_hot_key(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", i, rng.choice([None, 1, 2, 3])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = running(df, ["k"], block_of("o", 100), [F.col("o")], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))})
    df.createOrReplaceTempView("t_running")
    w = "OVER (PARTITION BY k ORDER BY o ROWS UNBOUNDED PRECEDING)"
    want = spark.sql(f"SELECT k, o, coalesce(sum(v) {w}, 0) s, max(v) {w} m, last(v, true) {w} l FROM t_running")
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got.select("k", "o", "s", "m", "l").collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    before = running(df, ["k"], block_of("o", 100), [F.col("o")], {"s": ("sum", F.lit(1))}, inclusive=False)
    idx = dense_index(df, ["k"], block_of("o", 100), [F.col("o")], "s")
    assert table(before, "k", "o", "s") == table(idx, "k", "o", "s")


def test_no_task_holds_a_whole_hot_document(spark):
    """The windows of a rank are keyed by block as well as by document."""
    plan = dense_index(book(spark, 3), ["doc_id"], block_of("page_no"), [F.col("page_no")], "i")._jdf.queryExecution().optimizedPlan().toString()
    row_windows = [line for line in plan.split("\n") if "Window" in line and "page_no" in line.split("[", 1)[-1]]
    assert row_windows and all("_blk" in line for line in row_windows)


def test_unique_names(spark):
    f = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "a_2"), (1, 1, 0, "a"), (1, 2, 0, "A"), (1, 2, 1, "a")], "m long, s long, p long, name string")
    assert [r[2] for r in table(P.unique_field_names(f, "m", "s", "p"), "s", "p", "unique_name")] == ["a", "a_2", "a_2", "A", "a_3"]
    long = "x" * 31
    n = spark.createDataFrame([(1, 0, "S"), (1, 1, "s"), (1, 2, "s (2)"), (1, 3, "S"), (2, 0, long), (2, 1, long)], "b long, p long, name string")
    got = [r[2] for r in table(P.unique_sheet_names(n, "b", "p"), "b", "p", "sheet_name")]
    assert got == ["S", "s (2)", "s (2) (2)", "S (3)", long, "x" * 27 + " (2)"]


def test_properties(spark):
    b = book(spark, 2)
    assert {r.rotate for r in P.rotate_pages(b, parse_pages(""), -1).collect()} == {270}
    with pytest.raises(ValueError):
        P.crop_pages(b, 10, 0, 10, 5)
    with pytest.raises(ValueError):
        P.resize_pages(b, 0, 5)
    with pytest.raises(ValueError):
        P.part_names(b, "a/b")
    r = P.resize_pages(b, 306, 792, keep_aspect=False).first()
    assert (r.sx, r.sy, r.dx) == (0.5, 1.0, 0.0)
    sizes = spark.createDataFrame([(595.0, 842.0), (612.0, 792.0), (600.0, 600.0)], "w double, h double")
    assert [r[0] for r in sizes.select(P.match_page_size(F.col("w"), F.col("h"))).collect()] == ["A4", "Letter", "Custom"]


def test_pruning_keeps_what_still_has_a_target(spark):
    b = book(spark, 3)
    links = spark.createDataFrame([(0, 0, 2), (0, 1, None)], "doc_id long, page_no long, target_page long")
    assert P.prune_dangling(links, b.filter("page_no <> 2")).count() == 1
    assert P.prune_dangling(links, b.filter("page_no <> 1")).count() == 2
