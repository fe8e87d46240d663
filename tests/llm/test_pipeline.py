import hashlib
import random

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from quireflow.llm import byte_bpe
from llm_brute import brute_components, brute_fp, squeeze

R = random.Random(12)
EN, FR = "the cat and dog went to old house with many people who were there".split(), "le chien et la chat vont dans vieille maison avec des gens qui sont".split()


def prose(words, n):
    return " ".join(R.choice(words) + R.choice(["", "s", "er", "ly", "ait"]) for _ in range(n)) + "."


def table():
    items = [(i, prose(EN, 40)) for i in range(6)]
    rows = [(i, prose(EN if i % 2 else FR, R.randint(60, 200)), "en" if i % 2 else "fr") for i in range(120)]
    rows += [(200 + i, rows[i % 7][1].replace(" ", "  "), rows[i % 7][2]) for i in range(30)]  # copies
    rows += [(300 + i, rows[20 + i % 5][1] + f" ps{i}", None) for i in range(20)]  # near copies
    rows += [(400 + i, prose(EN, 50) + " " + items[i][1].upper() + " " + prose(EN, 30), "en") for i in range(6)]  # leaks
    rows += [(500, None, "en"), (501, "", None), (502, "1234 --", "fr"), (None, prose(EN, 50), "en")]
    return rows, items


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = table()
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("doc_id", "text", "lang", "'s' AS source", "length(text) AS n_chars", "1 AS ids")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, columns = [(i, t) for i, t, _ in rows], docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k == 0:
            kept = [(i, t) for i, t in kept if t and any(c.isalpha() for c in t)]
        elif k == 1:
            first = {}
            for i, t in kept:
                first.setdefault(squeeze(t), []).append((i is None, i, t))
            kept = [min(g, key=lambda x: (x[0], x[1] or 0))[1:] for g in first.values()]
        elif k == 2:
            marks = [(n, brute_fp(t)) for n, (_, t) in enumerate(sorted(kept, key=lambda r: (r[0] is None, r[0] or 0)))]
            order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))
            heads = brute_components(marks, 3)
            kept = [order[n] for n in heads if heads[n] == n]
        elif k == 3:
            lines = [" ".join(t.lower().replace(".", "").split()) for _, t in items]
            kept = [(i, t) for i, t in kept if not any(x in " ".join(t.lower().replace(".", "").split()) for x in lines)]
        if k < 4:
            assert docs.columns == columns
            assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in docs.collect()))) == sorted(map(repr, kept)), name
            docs.write.parquet(f"{tmp_path}/stage{k}")
            docs = spark.read.parquet(f"{tmp_path}/stage{k}")
    ranks = {t: r for r, t in enumerate(byte_bpe.read_ranks(corpus_pipeline.VOCABULARY))}
    oracle = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((repr(i), oracle.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in kept)
    assert sorted((repr(r["doc_id"]), list(r["ids"]), r["decoded_sha256"]) for r in docs.collect()) == want
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((repr(r["doc_id"]), list(r["ids"]), r["decoded_sha256"]) for r in whole.collect()) == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
