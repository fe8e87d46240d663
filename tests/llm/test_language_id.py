import zlib

import numpy as np
from pyspark.sql import functions as F

from quireflow.llm import language_id as L
from quireflow.llm.samples import held_out

EN, DE, FR = "the cat and the dog went to the house", "der hund und die katze gehen in das haus", "le chien et le chat vont dans la maison"


def corpus():
    texts = {"en": EN.split(), "de": DE.split(), "fr": FR.split()}
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        lang = list(texts)[i % 3]
        rows.append((i, " ".join(rng.choice(texts[lang], rng.integers(3, 30))).capitalize(), lang if i % 7 else None))
    return rows


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS lang_pred", "1 AS score", "2 AS id", "3 AS h")


def test_held_out_is_the_checksum(spark):
    got = spark.range(50).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)
    assert spark.sql("SELECT CAST(NULL AS long) AS id").select(held_out("id")).first()[0] is True


def test_learns_and_rejects_texts_without_letters(spark):
    odd = [(900, None, "en"), (901, "", "de"), (902, "12 34 --", "fr"), (903, "x", "en"), (None, EN, None), (5, EN.upper() * 3000, None), (5, EN.upper() * 3000, None)]
    frame = make(spark, corpus() + odd)
    model = L.fit(frame)
    assert model.languages == ["de", "en", "fr"]
    got = [(r["doc_id"], r["lang_pred"], r["score"], r["rejected"]) for r in L.identify(frame, model).collect()]
    assert len(got) == 247 and all(0 <= g[2] <= 1 for g in got)
    by = {g[0]: g for g in got}
    assert [by[i][1:] for i in (900, 901, 902)] == [("und", 0.0, True)] * 3 and by[5][1] == by[None][1] == "en"
    right = [by[i][1] == ["en", "de", "fr"][i % 3] for i in range(240) if i != 5]
    assert np.mean(right) > 0.97
    kept = L.keep_identified(frame)
    assert kept.columns == frame.columns and {900, 901, 902}.isdisjoint({r["doc_id"] for r in kept.collect()}) and kept.count() >= 230


def test_pieces_of_a_long_text_add_up(monkeypatch):
    text = (EN + " Äöü ") * 60
    table = np.random.default_rng(1).normal(size=(1 << 12, 3))
    want = L._sums([text, "", "a"], table)
    for step in (7, 100, 1001):
        monkeypatch.setattr(L, "STEP", step)
        got = L._sums([text, "", "a"], table)
        assert np.allclose(got[0], want[0]) and (got[1] == want[1]).all()


def test_held_out_accuracy_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = L.identify(docs, L.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(held_out("doc_id"))
    n, right, kept = found.agg(F.count("*"), F.sum((F.col("lang_pred") == F.col("lang")).cast("int")), F.sum((~F.col("rejected")).cast("int"))).first()
    assert right / n > 0.97 and kept / n > 0.99


def test_nothing_to_learn_and_empty_tables(spark):
    frame = make(spark, [(1, EN, None), (2, None, "en")])
    assert {tuple(r)[1:3] for r in L.identify(frame, L.fit(frame)).collect()} == {("und", 0.0)}
    empty = make(spark, [])
    assert L.identify(empty, L.fit(empty)).collect() == [] and L.keep_identified(empty).collect() == []
