import re

import numpy as np
import pytest

from quireflow.llm import toxicity as T
from quireflow.llm import words as W

BAD = ["vexgrun", "vexgrin", "vexgrax", "dolt"]


def corpus(n=600, seed=0):
    rng = np.random.default_rng(seed)
    fine = [f"w{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    texts, labels, where = [], [], []
    for i in range(n):
        sents = [[str(x) for x in rng.choice(fine, rng.integers(4, 9))] for _ in range(rng.integers(1, 12))]
        toxic = i % 4 == 0
        k = int(rng.integers(len(sents)))
        if toxic:
            sents[k].insert(int(rng.integers(len(sents[k]))), str(rng.choice(BAD)))
        texts.append(" ".join(" ".join(s).capitalize() + "." for s in sents))
        labels.append(int(toxic))
        where.append(k if toxic else None)
    return texts, labels, where


def test_words_match_brute_force(monkeypatch):
    texts = ["", "Ab c-d  éà1", "x" * 50, " . ", "a b a"]
    for step in (3, 1 << 20):
        monkeypatch.setattr(W, "STEP", step)
        got = W.cut_words([t.lower().encode() for t in texts], (2,))
        want = [(i, m.start(), m.end(), m[0]) for i, t in enumerate(texts) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", t.lower().encode())]
        assert [tuple(map(int, x)) for x in zip(got.doc, got.start, got.end, strict=True)] == [x[:3] for x in want]
        names = {}
        for h, x in zip(got.hash.tolist(), want, strict=True):
            assert names.setdefault(x[3], h) == h
        assert len(set(names.values())) == len(names)
        alone = W.cut_words([b"ab", b"xx"])
        assert got.prefix[0][0] == alone.hash[0] and alone.hash[1] in got.prefix[0].tolist()
    assert W.cut_words([]).hash.size == 0


def test_instances_match_brute_force():
    group = [t.encode() for t in ("one two. two two! three\nfour", "", "...", "five", "one.two")]
    s, b, d, start, end = T._instances(group, 1 << 18)
    want = [(i, m.start() + len(m[0]) - len(m[0].lstrip()), m.end()) for i, t in enumerate(group) for m in re.finditer(rb"[^.!?\n]+", t) if m[0].strip()]
    assert [(int(a), int(x), int(y)) for a, x, y in zip(d, start, end, strict=True)] == want
    words = [len({w for w in re.findall(rb"\w+", group[i][a:z])} | {w[:4] for w in re.findall(rb"\w{5,}", group[i][a:z])}) for i, a, z in want]
    assert [int((s == k).sum()) for k in range(len(want))] == words


def test_learns_from_document_labels_and_finds_the_sentence():
    texts, labels, _ = corpus()
    model = T.train(texts, labels)
    other, truth, where = corpus(seed=5)
    scores, spans = T.score(model, other)
    assert ((scores >= 0.5) == np.array(truth, bool)).mean() > 0.99
    for t, k, found, y in zip(other, where, spans, truth, strict=True):
        if y:
            assert [t[a:z] + "." for a, z, _ in found] == [re.findall(r"[^.]+\.", t)[k].strip()]
    # A stem that only came with other endings, and a long clean text.
    fresh, _ = T.score(model, ["wak wbl vexgrobble wck.", ". ".join(other[i] for i in range(600) if not truth[i])])
    assert fresh[0] > 0.5 > fresh[1]


def test_spans_are_code_points():
    model = T.train(*corpus()[:2])
    text = "Ünï çödé 🙂 wak. Wal DOLT wbm wcn. Été."
    (found,) = T.score(model, [text])[1]
    assert [text[a:z] for a, z, _ in found] == ["Wal DOLT wbm wcn"]


def test_rows_labels_and_edge_cases(spark, docs):
    texts, labels, _ = corpus()
    frame = docs([*enumerate(texts), (5000, None), (5001, ""), (5002, "wak " * 200_000), (None, "a dolt."), (3, texts[3])])
    marks = spark.createDataFrame([*enumerate(labels), (5000, None), (None, 1), (9999, 1)], "doc_id long, toxic int").selectExpr("*", "1 AS text", "2 AS _text")
    model = T.fit(frame, marks)
    got = {}
    rows = T.assess(frame, model).collect()
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r["score"])
    assert len(rows) == 605 and len(got[3]) == 2 and got[5000] == got[5001] == [pytest.approx(model.leak)] and got[5002][0] < 0.5 < got[None][0]
    held = [i for i in range(600) if not __import__("zlib").crc32(str(i).encode()) % 5]
    assert np.mean([(got[i][0] >= 0.5) == labels[i] for i in held]) > 0.98


def test_nothing_to_learn_and_empty_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in T.assess(docs([(1, "x")]), T.fit(docs([(1, "x")]), none)).collect()] == [0.0]
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert T.assess(docs([]), T.fit(docs([]), one)).collect() == []
