"""Mergeable sketches, glyphs of shared font files, cleaning rules."""

import random

from pyspark.sql import functions as F

from quireflow.operators import usage as U


def test_stored_sketches_merge_to_any_level(spark):
    rng = random.Random(1)
    rows = [(d, d % 3, f"w{min(int(rng.paretovariate(0.5)), 50_000)}") for d in range(300) for _ in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source long, word string")
    stored = U.value_sketches(df, ["doc_id", "source"], F.col("word"))
    got = {r["source"]: r["estimate"] for r in U.merged_estimates(stored, ["source"]).collect()}
    for s in range(3):
        exact = len({w for _, k, w in rows if k == s})
        assert abs(got[s] - exact) <= 0.06 * exact


def test_glyphs_of_a_shared_file_and_files_kept_whole(spark):
    rows = [(1, "f", "aé😀", True), (2, "f", "ab", True), (2, "g", "xyz", True), (3, "g", None, False), (4, "h", "", True), (4, "f", "\U00010FFFF", True)]
    uses = spark.createDataFrame(rows, "doc_id long, file_id string, text string, readable boolean")
    bitmaps = U.glyph_bitmaps(uses)
    assert {r["doc_id"] for r in bitmaps.collect()} == {1, 2, 4}
    got = {tuple(r) for r in U.shared_glyphs(uses, bitmaps).collect()}
    points = {c for _, f, t, ok in rows if f == "f" for c in t}
    assert got == {("f", 3, False, len(points)), ("g", 2, True, None), ("h", 1, False, 0)}


def test_cleaning_rules(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    one = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, subtype string")
    notes = one(*[(1, s) for s in U.MARKUP_SUBTYPES], (1, "Link"), (1, "Widget"), (1, "FileAttachment"), (2, "Link"), (9, "Text"))
    fields = spark.createDataFrame([(2, "v", None), (2, None, "d"), (2, None, None), (1, "", None)], "doc_id long, value string, default_value string")
    runs = spark.createDataFrame([(1, 3), (1, 7), (1, 0), (2, 1)], "doc_id long, render_mode long")
    tables = {"annotations": notes, "fields": fields, "runs": runs, "info": docs, "xmp": docs.filter("doc_id = 1")}

    def report(**options):
        return {r["doc_id"]: r.asDict() for r in U.clean_documents(docs, tables, U.CleanOptions(**options)).collect()}

    off = report()
    assert set(off) == {1, 2, 3, None} and all(r["is_empty"] for r in off.values())
    got = report(comments=True, form_data=True)
    assert (got[1]["comments"], got[1]["attachments"], got[1]["form_fields"], got[1]["info_keys"]) == (18, 0, 1, 0)
    assert (got[2]["form_fields"], got[2]["is_empty"], got[3]["is_empty"]) == (2, False, True)
    assert (got[None]["comments"], got[None]["form_fields"]) == (18, 3)
    rest = report(attachments=True, hidden_text=True, metadata=True)
    assert (rest[1]["attachments"], rest[1]["hidden_text_runs"], rest[1]["info_keys"], rest[1]["xmp_packets"]) == (1, 2, 1, 1)
    assert rest[3]["info_keys"] == 1 and not rest[3]["is_empty"]


def test_small_sets_are_counted_as_they_are(spark):
    """Of 5,000 sets of 19 values, none may be off by more than a tenth: registers alone lose two values of some."""
    from quireflow.operators import reports as R

    df = spark.range(5000 * 19).select((F.col("id") % 5000).alias("k"), F.when(F.col("id") >= 5000, F.concat(F.lit("w"), "id")).otherwise("").alias("v"))
    df = df.unionByName(spark.sql("SELECT 5000L AS k, CAST(NULL AS STRING) AS v"))
    got = {tuple(r) for r in R.distinct_values(df, "k", "v", approximate=True).select("distinct_values", F.col("k") == 5000).distinct().collect()}
    assert got == {(19, False), (0, True)}
    old = df.groupBy("k").agg(F.approx_count_distinct("v", 0.02).alias("n")).filter("abs(n - 19) > 1.9 AND k < 5000")
    assert old.count() > 0


def test_characters_count_once_per_document_before_bits_are_sorted(spark):
    uses = spark.createDataFrame([(1, "f", "a", True)], "doc_id long, file_id string, text string, readable boolean")
    plan = U.glyph_bitmaps(uses)._jdf.queryExecution().sparkPlan().toString()
    steps = [s for line in plan.splitlines() for s in ("SortAggregate", "HashAggregate", "Generate") if s in line]
    assert steps[0] == "SortAggregate" and steps.index("HashAggregate") < steps.index("Generate")
