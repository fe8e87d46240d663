import math
import random

import numpy as np
import pytest

from quireflow.llm import queries as Q
from quireflow.llm import whitening as W


def frame(spark, rows, schema="vec_id long, embedding array<float>"):
    made = spark.createDataFrame(rows, schema)
    return made.selectExpr("*", "'x' AS id", "1 AS v", "2 AS x", "3 AS n", "4 AS component")


def exact(rows, k=32):
    """Ids, whole numbers, exact deviations and the eigenpairs of the covariance, from the rows themselves."""
    kept = [(i, v) for i, v in rows if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    kept = [(i, v) for i, v in kept if len(v) == max(len(w) for _, w in kept)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept], object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    y = np.array([[float(a) for a in row] for row in (n * x - s)]) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return [i for i, _ in kept], y, deviation, values[::-1][:k], vectors[:, ::-1][:, :k], values.sum()


def compare(rows, got):
    ids, y, deviation, values, vectors, trace = exact(rows)
    k = int((values > 1e-11 * values[0]).sum())
    assert len(got) == len(ids) * k
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert {i for i, _ in by} == set(ids) and {c for _, c in by} == set(range(1, k + 1))
    whitened = np.array([[by[i, c + 1]["whitened"] for c in range(k)] for i in ids])
    # With either sign, each component is the exact one; neighbours of nearly one eigenvalue only span the same plane.
    want = y @ (vectors[:, :k] / np.sqrt(values[:k]))
    gaps = np.abs(np.diff(np.r_[np.inf, values, 0.0]))
    for c in range(k):
        if min(gaps[c], gaps[c + 1]) > 1e-4 * values[0]:
            sign = np.sign(whitened[:, c] @ want[:, c])
            assert np.abs(whitened[:, c] * sign - want[:, c]).max() < 1e-7
    assert np.abs(whitened.T @ whitened / len(ids) - np.eye(k)).max() < 1e-6
    for i, d in zip(ids, deviation, strict=True):
        r = by[i, 1]
        assert r["n"] == len(ids) and r["deviation"] == (d if d < 1 << 63 else None) and 0 <= r["identity_error"] < 1e-6
    assert np.allclose([by[ids[0], c + 1]["explained"] for c in range(k)], values[:k] / trace, rtol=1e-6)


def messy(n, width, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1 + (d < 5) * 4) + (d == 2) * 50 for d in range(width)]) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [float("nan")] * width), (n + 3, [None] + [0.0] * (width - 1)), (n + 4, [1.0] * (width - 1)), (n + 5, [math.inf] + [0.0] * (width - 1))]
    return rows


@pytest.mark.parametrize("width", [3, 40, 70])
def test_matches_a_whole_decomposition(spark, width):
    rows = messy(400, width, width)
    compare(rows, W.whiten(frame(spark, rows).repartition(5)).collect())


def test_no_spread_one_row_no_row(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(50)], [(1, None)], [(1, [])]):
        assert W.whiten(frame(spark, rows)).collect() == []


def test_flat_directions_have_no_component(spark):
    rows = [(i, [float(i % 7), 2.0 * (i % 7), 5.0, float(i % 3)]) for i in range(60)]
    got = W.whiten(frame(spark, rows)).collect()
    assert {r["component"] for r in got} == {1, 2}
    compare(rows, got)


def test_repeated_and_null_ids_and_large_entries(spark):
    rows = [(None, [0.5, 1.0]), (None, [0.5, 1.0]), (7, [3.0, -1.0]), (7, [1e9, 2.0]), (8, [-2.0, 1e30])]
    got = W.whiten(frame(spark, rows)).collect()
    assert len(got) == 10 and all(math.isfinite(r["whitened"]) for r in got) and any(r["deviation"] is None for r in got)


def test_filter_converges_on_a_flat_spectrum_with_a_few_large_values():
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(rng.standard_normal((120, 120)))[0]
    values = np.r_[[900.0, 300, 299.999], np.linspace(1.05, 0.95, 117)]
    v = basis * values @ basis.T
    passes = []
    got, vectors, residual = W.leading(lambda q: passes.append(1) or v @ q, 120)
    assert np.allclose(got, values[:32], rtol=1e-9) and residual < W.ACCEPTED and len(passes) < 250
    assert np.abs(vectors.T @ vectors - np.eye(32)).max() < 1e-12


def test_equal_eigenvalues_across_the_border():
    v = np.diag(np.r_[np.full(50, 2.0), np.full(50, 1.0)])
    got, vectors, _ = W.leading(lambda q: v @ q, 100)
    assert np.allclose(got, 2.0) and np.abs(v @ vectors - 2 * vectors).max() < 1e-9


def test_transform_gives_the_same_numbers(spark):
    rows = messy(100, 6, 1)
    blocks = W.pack(frame(spark, rows))
    whole = {r["vec_id"]: r["whitened"] for r in W.transform(blocks, W.fit_blocks(blocks)).collect()}
    for r in W.whiten(frame(spark, rows)).collect():
        assert abs(abs(whole[r["vec_id"]][r["component"] - 1]) - abs(r["whitened"])) < 1e-9


def test_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    compare(rows, Q.QUERIES["op11_embedding_whitening"](spark, folder).collect())
