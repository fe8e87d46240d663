"""Words are rows only after their page has been placed: what is exchanged grows with the texts, not with words times columns."""

import re

import pytest
from pyspark.sql import functions as F

from quireflow import plans
from quireflow.operators import layout as L
from quireflow.operators import tables as T
from quireflow.plans.views import Views

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents in more files than there are cores, as at size: nothing is spread by document first."""
    at = str(tmp_path_factory.mktemp("placing"))
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(8).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", ["text_lines", "page_text", "document_text_parts", "text_summary", "heading_lines", "paragraphs", "document_blocks", "block_counts", "blocks_html",
                                  "assign_cells", "table_rows", "tables_long", "tables_wide"])
def test_no_exchange_of_runs(spark, folder, name):
    plan = plans.queries()[name](spark, folder)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    heavy = ("run_no#", "left#", "pieces#", "text#", "_it#", "runs#") if name not in ("document_text_parts",) else ("run_no#", "left#", "pieces#", "_it#", "runs#")
    assert moved and not [m for m in moved if any(h in f" {m}" and re.search(rf"(^|[ ,]){h}", m) for h in heavy)]


def test_text_parts_read_their_pages_once(spark):
    pages = spark.range(40).select((F.col("id") % 4).alias("doc_id"), (F.col("id") * 5000).alias("page_no"), F.when(F.col("id") % 8 > 4, F.concat(F.lit("t"), "id")).otherwise("").alias("text"))
    pages = pages.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS doc_id, id AS page_no, 'n' AS text FROM range(2)"))
    parts = L.document_text_parts(pages)
    got = {}
    for r in sorted(parts.collect(), key=lambda r: r.page_no):
        got.setdefault(r.doc_id, []).append(r.part)
    texts = {}
    for r in sorted(pages.collect(), key=lambda r: r.page_no):
        seen = texts.setdefault(r.doc_id, [])
        seen.append(("\n" if any(seen) else "") + r.text)
    assert got == texts
    assert {r.doc_id: (r.pages, r.characters) for r in L.text_summary(pages).collect()} == {d: (len(t), sum(map(len, t))) for d, t in texts.items()}
    parts.collect()
    assert "ReusedExchange" in parts._jdf.queryExecution().executedPlan().toString()


def test_images_at_hand_are_numbered_as_from_blocks(spark):
    images = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (1, 3, 7), (2, 1, 0)], "doc_id long, page_no long, image_no long")
    b = images.select("doc_id", "page_no", F.col("image_no").alias("block_no"), F.col("image_no").alias("no"), F.lit("image").alias("kind"), F.lit(None).cast("long").alias("heading"),
                      F.lit(None).cast("array<struct<text:string,bold:boolean,italic:boolean,size:double>>").alias("runs"))
    none = spark.createDataFrame([], "doc_id long, page_no long, table_no long, html string")
    rows = lambda **k: sorted((r.doc_id, r.page_no, r.block_no, r.html) for r in T.block_html(b, none, **k).collect())
    assert rows() == rows(images=images)
    assert [re.search(r"image-(\d+)", r[3]).group(1) for r in rows()] == ["001", "002", "003", "001"]


def test_blocks_are_counted_without_their_texts(spark, folder):
    from quireflow.plans import page_layout
    from quireflow.plans.views import Views

    counts = plans.queries()["block_counts"](spark, folder)
    assert "italic" not in counts._jdf.queryExecution().optimizedPlan().toString()
    names = ["doc_id", "pages", "paragraphs", "headings", "images", "tables"]
    want = T.block_counts(page_layout.blocks(Views(spark, folder)))
    assert sorted(map(tuple, counts.select(names).collect())) == sorted(map(tuple, want.select(names).collect()))


def test_no_exchange_of_tokens(spark):
    plan = plans.queries()["html_table_cells"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert moved and not [m for m in moved if "tok_no#" in m or "raw#" in m]


def test_words_begin_where_they_stand(spark):
    """Leading, doubled and trailing spaces, and characters of two code units; each word's place is counted without a lambda over the line."""
    lines = ["  two words", "a  b c", "end  ", "\U0001f642 xé \U0001f642y", "one", "", "   ", "a b  c   d e "]
    v = Views(spark, FOLDER)
    sheet = spark.createDataFrame([(2, "en", 1, lines)], "doc_id long, lang string, page_no long, lines array<string>")
    got = [(r["run_no"], r["text"], r["left"]) for r in v.runs(sheet).orderBy("run_no").collect()]
    want = []
    for k, line in enumerate(lines):
        at, w = 0, 0
        for part in line.split(" "):
            if part:
                want.append((k * 1000 + w, part, 72.0 + (18 if k % 10 == 5 else 0) + 6 * at))
                w += 1
            at += len(part) + 1
    assert got == want
    plan = v.runs(sheet)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_text_lines_move_no_text(spark):
    plan = plans.queries()["text_lines"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "text, text#" not in plan and "array_sort" not in plan


def test_runs_are_not_sorted_to_meet_their_tables(spark):
    plan = plans.queries()["assign_cells"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
