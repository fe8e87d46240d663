import random

import numpy as np
from llm_brute import brute_components, brute_fp

from quireflow.llm import simhash as S


TEXTS = [None, "", "one", "One TWO", "one two three", "one two  three", "ÄÖ äö x", "a " * 700, "the quick brown fox " * 100 + "end", "z\x0bq\x1cw r"]


def test_fingerprints_match_brute_force(docs):
    got = {r[0]: r[1] & (2**64 - 1) for r in S.fingerprints(docs(list(enumerate(TEXTS)))).collect()}
    assert got == {i: brute_fp(t) for i, t in enumerate(TEXTS)}


def signed(x):
    return x - 2**64 if x >> 63 else x


def fps_for(n, seed, correlated):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(n // 5)]
    out = set(base) | {0, 1, 7, 2**64 - 1}
    for b in base:
        for _ in range(4):
            x = b
            for bit in r.sample(range(8, 24) if correlated else range(64), r.randint(1, 5)):
                x ^= 1 << bit
            out.add(x)
    return sorted(out)


def test_pairs_match_brute_force_for_every_distance(spark):
    for distance, correlated in ((0, False), (1, True), (2, False), (3, True), (3, False)):
        fps = fps_for(150, distance, correlated)
        frame = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
        got = {frozenset((r[0], r[1])) for r in S.near_pairs(frame, distance).collect()}
        want = {frozenset((signed(a), signed(b))) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= distance}
        assert got == want


def test_unequal_thresholds_lose_no_pair(spark, monkeypatch):
    fps = fps_for(150, 9, False)
    frame = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    want = {frozenset((signed(a), signed(b))) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3}
    masks = S.bit_groups(np.eye(64), 3)
    for plan in ([2, -1, 0], [1, 0, 0], [1, 1, -1], [3, -1, -1]):
        monkeypatch.setattr(S, "plan_groups", lambda f, d, plan=plan: [(m, t) for m, t in zip(masks, plan, strict=True) if t >= 0])
        assert {frozenset((r[0], r[1])) for r in S.near_pairs(frame).collect()} == want


def test_allocation_is_cheapest():
    r = random.Random(1)
    for m in (1, 2, 3, 4):
        costs = [sorted(r.random() for _ in range(4)) for _ in range(m)]
        grid = [[]]
        for _ in range(m):
            grid = [[*g, e] for g in grid for e in range(-1, 4)]
        want = min(sum(costs[i][e] for i, e in enumerate(g) if e >= 0) for g in grid if sum(g) == 4 - m)
        assert abs(S.allocate(costs, 3)[0] - want) < 1e-9


def test_groups_hold_every_bit_once_and_correlated_bits_together():
    corr = np.eye(64)
    corr[np.ix_(range(0, 64, 4), range(0, 64, 4))] = 0.9
    masks = S.bit_groups(corr, 4)
    assert sum(masks) == 2**64 - 1 and sum(1 << b for b in range(0, 64, 4)) in masks


def test_components_match_brute_force(docs):
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = list(enumerate(TEXTS))
    for g in range(6):
        base = [r.choice(words) for _ in range(120)]
        for _ in range(8):
            t = list(base)
            for _ in range(r.randint(0, 6)):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((100 + len(rows), " ".join(t)))
    want = brute_components([(i, brute_fp(t)) for i, t in rows], 3)
    frame = docs(rows)
    got = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(frame).collect()}
    assert got == want and len(set(want.values())) < len(rows)
    kept = S.keep_one(frame)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in want if want[i] == i)
    assert kept.columns == frame.columns


def test_empty_and_null_ids(docs):
    assert S.near_duplicates(docs([])).collect() == []
    got = S.near_duplicates(docs([(None, "a b c d"), (None, "a b c d"), (5, "q r s t")])).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == [(5, 5), (None, None), (None, None)]


def test_long_chain_has_one_component(spark):
    from quireflow.llm.components import components

    edges = spark.range(400).selectExpr("id AS a", "id + 1 AS b").union(spark.sql("SELECT 1000L, 1001L UNION ALL SELECT 5L, 5L UNION ALL SELECT NULL, 3L"))
    got = {r[0]: r[1] for r in components(edges, "a", "b").collect()}
    assert got == {i: 0 for i in range(401)} | {1000: 1000, 1001: 1000}
