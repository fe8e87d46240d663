"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors are packed once into blocks of whole numbers in the shared folder. The covariance is never formed: every step is a
distributed pass that sums ``Xᵀ(XQ)`` over centred blocks for a thin ``Q``. A few Lanczos steps bound the spectrum; the three-term
recurrence of Chebyshev polynomials then damps what lies between the least eigenvalue and the last guard vector's, QR makes the block orthonormal again,
and Rayleigh-Ritz gives eigenpairs, until each residual is at double precision and a probe of the complement finds nothing larger.
Only matrices of the vectors' width by the block's reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import checkpointed

SCALE, OFFSET = 64, 1_000_000
COMPONENTS, GUARD = 32, 16
#: Entries beyond this many steps of 1/64 count as this many, so that sums of a block fit a long.
FARTHEST = 1 << 45
BLOCK_BYTES, PART_BYTES = 4 << 20, 32 << 20
#: Residuals as a share of the largest eigenvalue: sought, and accepted if rounding allows no better. Eigenvalues under ``FLAT`` of it count as zero.
SOUGHT, ACCEPTED, FLAT = 3e-14, 1e-11, 1e-12
LANCZOS, ROUNDS, MOST_DEGREE = 10, 60, 24
#: The most that the polynomial may grow the largest value more than the least wanted one.
SPREAD = 1e9

Apply = Callable[[np.ndarray], np.ndarray]


@dataclass
class Whitening:
    """``components`` are the unit eigenvectors as columns, by falling ``eigenvalues``; ``sums`` are over ``x - OFFSET``."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    residual: float = 0.0
    passes: int = 0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums]) if self.n else np.zeros(len(self.sums))

    @property
    def scaled(self) -> np.ndarray:
        return self.components / np.sqrt(self.eigenvalues)


@dataclass
class Blocks:
    """Packed vectors: ``rows`` are ``(ids, x, wide)``, ``x`` the numbers ``floor(64 c)`` of the block row by row."""

    rows: DataFrame
    width: int
    id_type: str

    @property
    def parts(self) -> int:
        return self.rows.rdd.getNumPartitions()


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def pack(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> Blocks:
    """Vectors that are null or hold null, NaN or infinite entries are left out, as are those of fewer entries than the longest."""
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(sound, F.lit(False)))
    width, count = rows.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    width = width or 0
    id_type = dict(rows.dtypes)["id"]
    schema = f"ids array<{id_type}>, x binary, wide boolean"
    out = _arrow(embeddings.sparkSession, schema)
    most = max(1, BLOCK_BYTES // (8 * max(1, width)))

    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        c = np.concatenate([part.column(1).flatten().to_numpy(zero_copy_only=False) for part in rows])
        x = np.clip(np.floor(SCALE * c), -FARTHEST, FARTHEST)
        wide = bool(len(x) and np.abs(x).max() >= 1 << 31)
        held = pa.concat_arrays([part.column(0) for part in rows])
        ids = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held).cast(out.field("ids").type)
        return pa.RecordBatch.from_arrays([ids, pa.array([x.astype(np.int64 if wide else np.int32).tobytes()], pa.binary()), pa.array([wide])], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                if held and n + part.num_rows > most:
                    yield block(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if held:
            yield block(held)

    # Every step reads all blocks, so they lie in as many partitions as their bytes call for, whatever the input's files.
    parts = max(embeddings.sparkSession.sparkContext.defaultParallelism, -(-8 * width * count // PART_BYTES))
    whole = rows.where(F.size("v") == width).coalesce(parts)
    return Blocks(checkpointed(whole.mapInArrow(run, schema)), width, id_type)


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, data, wide = (batch.column(c)[i] for c in range(3))
            yield ids.values, np.frombuffer(data.as_py(), np.int64 if wide.as_py() else np.int32).reshape(-1, width)


def _total(blocks: Blocks, of_block: Callable[[np.ndarray], np.ndarray], length: int) -> np.ndarray:
    """The sum of ``of_block`` over all blocks: in each task, then in about as many tasks as the root of their number, then here."""
    width = blocks.width

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for _, x in _matrices(batches, width):
            total += of_block(x.astype(np.float64))
        yield pa.RecordBatch.from_pydict({"total": [total.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            for data in batch.column(0):
                total += np.frombuffer(data.as_py())
        yield pa.RecordBatch.from_pydict({"total": [total.tobytes()]})

    sums = blocks.rows.mapInArrow(partial, "total binary").repartition(math.isqrt(blocks.parts) or 1).mapInArrow(add, "total binary")
    return sum((np.frombuffer(r["total"]) for r in sums.collect()), np.zeros(length))


def _counted(blocks: Blocks) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""
    width = blocks.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for _, x in _matrices(batches, width):
            n += len(x)
            sums = [a + int(b) for a, b in zip(sums, x.sum(axis=0, dtype=np.int64), strict=True)]
        total = pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_pydict({"dim": pa.array(range(width), pa.int32()), "total": total, "n": pa.array([n] * width, pa.int64())})

    found = blocks.rows.mapInArrow(run, "dim int, total decimal(38,0), n long").groupBy("dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    found = sorted(found, key=lambda r: r["dim"])
    return (found[0]["n"], [int(r["total"]) for r in found]) if found else (0, [])


def lanczos(apply: Apply, start: np.ndarray, steps: int, away: np.ndarray | None = None) -> tuple[float, float, float]:
    """``(low, high, largest)``: Ritz values with their residuals off and on at the ends, and the largest Ritz value; off the columns of ``away``."""
    clear = (lambda v: v - away @ (away.T @ v)) if away is not None else (lambda v: v)
    v = clear(clear(start))
    basis, alpha, beta = [v / np.linalg.norm(v)], [], []
    for _ in range(steps):
        w = clear(apply(basis[-1][:, None])[:, 0])
        alpha.append(float(basis[-1] @ w))
        for _ in range(2):
            for b in basis:
                w = w - (b @ w) * b
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * max(map(abs, alpha)) or len(alpha) == steps:
            break
        basis.append(w / beta[-1])
    theta, s = np.linalg.eigh(np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1))
    return float(theta[0] - beta[-1] * abs(s[-1, 0])), float(theta[-1] + beta[-1] * abs(s[-1, -1])), float(theta[-1])


def chebyshev(apply: Apply, q: np.ndarray, degree: int, low: float, cut: float, high: float) -> np.ndarray:
    """``q`` under the polynomial that is small from ``low`` to ``cut`` and one at ``high``; one pass per degree."""
    half, middle = (cut - low) / 2, (cut + low) / 2
    sigma = first = half / (high - middle)
    before, y = q, (apply(q) - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, y = y, (2 * after / half) * (apply(y) - middle * y) - sigma * after * before
        sigma = after
    return y


def _grown(theta: float, low: float, cut: float) -> float:
    """How much more than the damped part an eigenvalue grows per degree."""
    t = max(1.0, (2 * theta - cut - low) / (cut - low))
    return t + math.sqrt(t * t - 1)


def _degree(worst: float, theta: np.ndarray, wanted: int, low: float, cut: float) -> int:
    """As many passes as bring the worst residual down, but so few that the largest value does not drown the least wanted one in rounding."""
    top, least = _grown(float(theta[0]), low, cut), max(_grown(float(theta[wanted - 1]), low, cut), 1.01)
    degree = math.log(max(worst, SOUGHT) / SOUGHT * 10) / math.log(least)
    if top > least:
        degree = min(degree, math.log(SPREAD) / math.log(top / least))
    return int(min(max(degree, 2), MOST_DEGREE))


def leading(apply: Apply, width: int, k: int = COMPONENTS, guard: int = GUARD) -> tuple[np.ndarray, np.ndarray, float]:
    """``(eigenvalues, eigenvectors as columns, largest residual)`` of the ``k`` largest eigenvalues of the covariance that ``apply`` multiplies by.

    Eigenvectors are locked from the largest on as they converge, and the rest of the block is kept off them.
    """
    rng = np.random.default_rng(7)
    k = min(k, width)
    low, high, _ = lanczos(apply, rng.standard_normal(width), min(width, LANCZOS))
    if high <= 0:
        return np.zeros(k), np.eye(width, k), 0.0
    low, last, locked = max(0.0, low), math.inf, np.zeros((width, 0))

    def off(q: np.ndarray) -> np.ndarray:
        for _ in range(2):
            q = q - locked @ (locked.T @ q)
        return q

    def ritz(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        product = apply(q)
        small = q.T @ product
        theta, w = np.linalg.eigh((small + small.T) / 2)
        theta, w = theta[::-1], w[:, ::-1]
        q, product = q @ w, product @ w
        return theta, q, np.linalg.norm(off(product) - q * theta, axis=0) / high

    q = np.linalg.qr(rng.standard_normal((width, min(width, k + guard))))[0]
    for _ in range(ROUNDS):
        theta, q, residuals = ritz(q)
        high = max(high, float(theta[0]) * (1 + 1e-10))
        wanted = k - locked.shape[1]
        worst = float(residuals[:wanted].max())
        stuck = worst <= ACCEPTED and worst > last / 4
        done = wanted if stuck else int(np.argmax(np.r_[residuals[:wanted] > SOUGHT, True]))
        last = math.inf if done else worst
        cut = float(min(max(theta[-1], low + 1e-9 * high), high * (1 - 1e-9)))
        locked, q = np.c_[locked, q[:, :done]], q[:, done:]
        if done == wanted:
            # Once more as a whole, so that the locked ones are orthogonal and ordered to rounding.
            whole, locked = np.linalg.qr(np.c_[locked, q])[0], np.zeros((width, 0))
            theta, vectors, residuals = ritz(whole)
            if float(residuals[:k].max()) <= ACCEPTED:
                if vectors.shape[1] == width:
                    return theta[:k], vectors[:, :k], float(residuals[:k].max())
                beyond = lanczos(apply, rng.standard_normal(width), min(width - k, LANCZOS), vectors[:, :k])[2]
                if beyond <= theta[k - 1] + 1e-9 * high:
                    return theta[:k], vectors[:, :k], float(residuals[:k].max())
            q = vectors
            q[:, -1] = rng.standard_normal(width)
            q = np.linalg.qr(q)[0]
            continue
        degree = _degree(worst, theta[done:], wanted - done, low, cut)
        q = np.linalg.qr(off(chebyshev(lambda v: off(apply(v)), q, degree, low, cut, max(float(theta[done]), cut * (1 + 1e-9)))))[0]
    raise RuntimeError(f"no certified eigenvectors after {ROUNDS} rounds: residual {last:.3g} of the largest eigenvalue")


def fit_blocks(blocks: Blocks, k: int = COMPONENTS) -> Whitening:
    width = blocks.width
    n, sums = _counted(blocks) if width else (0, [])
    if not n:
        return Whitening(0, [0] * width, np.zeros((width, 0)), np.zeros(0), 0.0)
    model = Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0)
    mean = model.mean

    def apply(q: np.ndarray) -> np.ndarray:
        model.passes += 1

        def of_block(x: np.ndarray) -> np.ndarray:
            y = x - mean
            return (y.T @ (y @ q)).ravel()

        return _total(blocks, of_block, q.size).reshape(q.shape) / n

    model.trace = float(_total(blocks, lambda x: np.array([((x - mean) ** 2).sum()]), 1)[0]) / n
    values, vectors, model.residual = leading(apply, width, k)
    kept = values > FLAT * max(float(values[0]), 0.0)
    vectors = vectors[:, kept]
    signs = np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    model.eigenvalues, model.components = values[kept], vectors * signs
    return model


def identity_error(blocks: Blocks, model: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity, from one more pass."""
    mean, scaled, k = model.mean, model.scaled, model.components.shape[1]

    def of_block(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ scaled
        return np.r_[(w.T @ w).ravel(), w.sum(axis=0)]

    total = _total(blocks, of_block, k * k + k) / model.n
    return float(np.abs(total[: k * k].reshape(k, k) - np.outer(total[k * k :], total[k * k :]) - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """``sum((n x - S)²)`` exactly; null where it does not fit a long."""
    far = max(n * max(abs(int(x.min())), abs(int(x.max()))) + abs(s) for s in sums) if x.size else 0
    if x.shape[1] * far * far < 1 << 63:
        return ((n * x.astype(np.int64) - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = (sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x)
    return [d if d < 1 << 63 else None for d in exact]


def transform(blocks: Blocks, model: Whitening) -> DataFrame:
    """``(vec_id, whitened)``: one array of doubles per vector."""
    mean, scaled, width = model.mean, model.scaled, blocks.width

    schema = f"vec_id {blocks.id_type}, whitened array<double>"
    out = _arrow(blocks.rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _matrices(batches, width):
            w = (x - mean) @ scaled
            offsets = pa.array(np.arange(0, w.size + 1, max(1, w.shape[1]))[: len(w) + 1], pa.int32())
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, w.ravel()).cast(out.field(1).type)], schema=out)

    return blocks.rows.mapInArrow(run, schema)


def whiten(embeddings: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: a row per vector and component, numbered from 1.

    Entries become whole numbers ``x = floor(64 c) + 1000000``; ``deviation`` is the exact sum of ``(n x - S)²`` over dimensions, null if it does not
    fit a long. Vectors left out by ``pack`` have no rows. There are at most ``k`` components, and none for directions without variance: a
    table of equal vectors, or of one, gives an empty result, as an empty table does. Rows with the same or a null id are vectors of their
    own; other columns have no part in it. Components have either sign, the same for all rows.
    """
    blocks = pack(embeddings, id_col, vec_col)
    model = fit_blocks(blocks, k)
    schema = f"vec_id {blocks.id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = _arrow(embeddings.sparkSession, schema)
    found = model.components.shape[1]
    if not found:
        return embeddings.sparkSession.createDataFrame([], schema)
    n, sums, mean, scaled, width = model.n, model.sums, model.mean, model.scaled, blocks.width
    explained, error = model.eigenvalues / model.trace, identity_error(blocks, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, whole in _matrices(batches, width):
            for at in range(0, len(whole), 1024):
                x = whole[at : at + 1024]
                rows = np.repeat(np.arange(len(x)), found)
                columns = [
                    ids.slice(at, len(x)).take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(rows), n, np.int64)),
                    pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(rows)),
                    pa.array(((x - mean) @ scaled).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(rows), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return blocks.rows.mapInArrow(run, schema)
