import random

import numpy as np

from quireflow.llm import decontaminate as D

R = random.Random(6)
VOCAB = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "st", "x", "lo", "mi", "tu")]
COMMON = ["the", "of", "and", "to", "in", "is"]


def prose(n):
    return [R.choice(COMMON) if R.random() < 0.4 else R.choice(VOCAB) + R.choice(VOCAB) for _ in range(n)]


ITEMS = [(i, " ".join(prose(R.randint(12, 60)))) for i in range(90)]
ITEMS[3] = (3, "What is the " + " ".join(prose(20)) + "? The answer is " + " ".join(prose(6)))
ITEMS[4] = (4, " ".join(prose(300)))


def edited(words, every):
    return [("zz" + str(i)) if i % every == every - 1 else w for i, w in enumerate(words)]


def make(kind, k):
    words = ITEMS[k][1].split()
    if kind == "whole":
        return " ".join(prose(150) + words + prose(100))
    if kind == "loud":
        return " ".join(prose(30)) + " ||| " + " *** ".join(w.upper() + "!" for w in words)
    if kind == "edited":
        return " ".join(prose(90) + edited(words, 8) + prose(5))
    return " ".join(prose(300))


def test_subsequence_matches_table():
    for _ in range(200):
        a, b = [R.randrange(6) for _ in range(R.randint(1, 20))], [R.randrange(6) for _ in range(R.randint(0, 40))]
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                rows[i + 1][j + 1] = rows[i][j] + 1 if a[i] == b[j] else max(rows[i][j + 1], rows[i + 1][j])
        assert D.common_subsequence(a, b) == rows[-1][-1]


def test_answers():
    (a,) = D.read_items([(1, "Who wrote the long book? It was a b c")])
    assert len(a.answer) == 5 and len(a.words) == 10
    assert [len(i.answer) for i in D.read_items([(1, "one two three. four five six."), (2, "x"), (3, None), (4, " ?!")])] == [3, 1]


def test_groups_hold_every_word_of_long_items():
    groups = D.group_items(D.read_items(ITEMS))
    assert len(groups) == 3 and sum(len(g.queries) for g in groups) == 89 + 5
    assert all(g.queries.any(axis=1).all() for g in groups)


def test_finds_leaks_and_spares_clean_documents(docs, spark):
    kinds = ["whole", "loud", "edited", "clean"]
    rows = [(i, make(kinds[i % 4], i % 90)) for i in range(360)]
    rows += [(900, None), (901, ""), (902, "the of and " * 60_000), (None, ITEMS[5][1]), (903, ITEMS[6][1] + " " + ITEMS[7][1]), (903, ITEMS[6][1] + " " + ITEMS[7][1])]
    bench = spark.createDataFrame([*ITEMS, (None, "lone words that nobody repeats ever"), (77, None), (78, "")], "item_id long, text string").selectExpr("*", "'x' AS doc_id")
    found = [(r["doc_id"], r["item_id"]) for r in D.leaks(docs(rows), bench).collect()]
    want = [(i, i % 90) for i in range(360) if i % 4 != 3] + [(None, 5)] + [(903, 6), (903, 7)] * 2
    assert sorted(found, key=repr) == sorted(want, key=repr)
    kept = D.drop_leaks(docs(rows), bench)
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([i for i in range(360) if i % 4 == 3] + [900, 901, 902], key=repr)
    assert kept.columns == docs(rows).columns


def test_blocks_of_a_large_benchmark_find_the_same(docs, spark, monkeypatch):
    rows = [(i, make("whole", i)) for i in range(0, 90, 9)]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted((r["doc_id"], r["item_id"]) for r in D.leaks(docs(rows), bench).collect())
    monkeypatch.setattr(D, "ITEMS_AT_ONCE", 40)
    assert sorted((r["doc_id"], r["item_id"]) for r in D.leaks(docs(rows), bench).collect()) == want == [(i, i) for i in range(0, 90, 9)]


def test_sketch_is_the_product_over_all_passages(docs):
    rows = [(i, " ".join(prose(R.randint(0, 400)))) for i in range(40)]
    items = D.read_items(ITEMS)
    groups = D.group_items(items)
    passages, counts, sketches = D.sketch(docs(rows).repartition(5), groups, "text")
    matrix, total = [[] for _ in groups], 0
    for _, text in rows:
        words = D._word_hashes(text)
        for at in range(0, len(words), D.STRIDE):
            total += 1
            here = set(words[at : at + 2 * D.STRIDE])
            for g, m in zip(groups, matrix, strict=True):
                m.append([t in here for t in g.terms.tolist()])
    assert passages == total
    for g, m, count, y in zip(groups, matrix, counts, sketches, strict=True):
        n = np.array(m, float)
        assert (count == n.sum(axis=0)).all() and np.allclose(y, n.T @ (n @ g.random().astype(float)), rtol=1e-3, atol=1e-2)


def test_latent_recall_against_all_cosines(docs):
    """Every passage that is nearest to a query in the full space is found above the cut in the latent one."""
    rows = [(i, make("whole", i % 90)) for i in range(90)]
    items = D.read_items(ITEMS)
    groups = D.group_items(items)
    for g, n, y in zip(groups, *D.sketch(docs(rows), groups, "text")[1:], strict=True):
        D.decompose(g, 400, n, y)
        full = (g.queries * g.idf) / np.linalg.norm(g.queries * g.idf, axis=1)[:, None]
        noisy = g.queries.copy()
        noisy[:, np.random.default_rng(1).integers(0, len(g.terms), 12)] = 1
        z = (noisy * g.idf) @ g.space
        near = (z / np.linalg.norm(z, axis=1)[:, None] * g.latent).sum(axis=1)
        assert (near >= 0.5).mean() >= 0.9 and np.linalg.norm(full @ g.space, axis=1).min() > 0.9


def test_words_held_in_windows_match_sets():
    r = np.random.default_rng(3)
    for n in (0, 1, 7, 200):
        for kinds in (1, 5, 60):
            term, times = r.integers(0, kinds, n), r.integers(1, 4, kinds)
            lows, highs = np.sort(r.integers(0, n + 1, 30)), np.sort(r.integers(0, n + 1, 30))
            lows = np.minimum(lows, highs)
            want = [sum(times[t] for t in set(term[a:b].tolist())) for a, b in zip(lows, highs, strict=True)]
            assert D._held_in_windows(term, times, lows, highs).tolist() == want


def test_empty_tables(docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    bench = spark.createDataFrame(ITEMS[:3], "item_id long, text string")
    assert D.leaks(docs([(1, "a b c")]), none).collect() == [] and D.leaks(docs([]), bench).collect() == []
    assert [r["doc_id"] for r in D.drop_leaks(docs([(1, "a b c")]), none).collect()] == [1]


def rule(items, text):
    """The leaked items by the words alone, over all passages and items."""
    words, found = D._word_hashes(text or ""), set()
    for item in items:
        n = len(item.words)
        for at in range(0, len(words), D.STRIDE):
            region = words[max(at - n, 0) : at + 2 * D.STRIDE + n]
            here = set(region)
            if sum(w in here for w in item.words) >= 0.6 * n:
                share = D.common_subsequence(item.words, region) / n
                if share >= 0.8 or (share >= 0.6 and len(item.answer & here) >= 0.8 * len(item.answer)):
                    found.add(item.item_id)
    return found


def test_leaks_are_the_rule_over_all_passages(docs, spark):
    """Content words replaced, so that the order of the common ones makes the leak; few and many items."""
    r = random.Random(9)
    for n in (40, 2000):
        own = [f"{a}{b}" for a in VOCAB for b in ("ka", "po", "zu")]
        items = [(i, " ".join(r.choice(COMMON) if r.random() < 0.5 else r.choice(VOCAB) if r.random() < 0.6 else r.choice(own) for _ in range(r.randint(25, 60)))) for i in range(n)]
        read, rows = D.read_items(items), []
        for k in range(40):
            words = items[k][1].split()
            lone = [j for j, w in enumerate(words) if w not in COMMON]
            gone = set(sorted(lone, key=lambda j: words[j] in VOCAB)[: len(words) // 6])
            text = [r.choice(VOCAB) + "x" for _ in range(150)] + ["zz" if j in gone else w for j, w in enumerate(words)] + [r.choice(VOCAB) + "y" for _ in range(90)]
            rows.append((k, " ".join(text)))
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = {(x["doc_id"], x["item_id"]) for x in D.leaks(docs(rows), bench).collect()}
        want = {(k, i) for k, text in rows for i in rule(read, text)}
        print(n, "items:", len(got & want), "of", len(want), "leaks,", len(got - want), "others")
        assert len(want) >= 40 and got == want
