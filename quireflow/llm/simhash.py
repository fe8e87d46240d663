"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within distance d agree, for any thresholds that sum to d - m + 1 over m groups of bits, within the threshold
in at least one group (a threshold of -1 switches a group off). Correlated bits are put into one group, and a
dynamic programme gives each group the threshold that makes the fewest expected rows; the candidates are probed by a
join on the group's bits and verified on all bits inside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .components import components

BITS = 64
SEED = 42
ROWS_AT_ONCE = 256
LANES = np.uint64(0x0101010101010101)
LAGS = 8


def _hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each shingle: words are cut at ASCII white space, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    cut = map(slice, starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, cut), repeat(SEED)), np.uint64, len(words) - width + 1)


def simhash(texts: list[str | None], width: int) -> np.ndarray:
    """One fingerprint per text: a bit is set if more than half of the shingle hashes set it; 0 without words."""
    parts = [_hashes(t, width) for t in texts]
    sizes = np.array([len(p) for p in parts])
    out = np.zeros(len(parts), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate(parts)
    # Eight one-byte counters per word: runs of at most 255 hashes are added up, then widened.
    cuts, first, at = [], [], 0
    for n in sizes[full]:
        first.append(len(cuts))
        cuts.extend(range(at, at + n, 255))
        at += n
    counts = np.empty((len(full), BITS), np.int64)
    for b in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(b)) & LANES, cuts)
        counts[:, b::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    out[full] = np.packbits(2 * counts > sizes[full][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, fp)``: the 64-bit fingerprint of each row's whole text, as a signed long; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                fp = simhash(part.column(1).to_pylist(), width).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _summed(fps: DataFrame, count) -> dict[int, int]:
    """``count(array of fingerprints)`` gives an integer vector for each batch; their sum over all rows, by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                total = total + count(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.int64())], ["at", "n"])

    rows = fps.select("fp").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    return {r["at"]: r["n"] for r in rows.collect()}


def _bits(fps: np.ndarray) -> np.ndarray:
    return ((fps[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)


def bit_correlation(fps: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """How many fingerprints there are, the share of each bit and the bits' correlations, over all of them."""

    def count(x: np.ndarray) -> np.ndarray:
        both = np.zeros((BITS, BITS), np.int64)
        for at in range(0, len(x), 4096):
            b = _bits(x[at : at + 4096])
            both += np.rint(b.T @ b).astype(np.int64)
        return np.r_[both.ravel(), len(x)]

    got = _summed(fps, count)
    n = got.get(BITS * BITS, 0)
    both = np.array([got.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS) / max(n, 1)
    p = np.diag(both)
    spread = np.sqrt(np.clip(p * (1 - p), 1e-9, None))
    return n, p, (both - np.outer(p, p)) / np.outer(spread, spread)


def bit_groups(correlation: np.ndarray, m: int) -> list[int]:
    """Masks of ``m`` groups of near equal width; each grows by the bit most correlated with it."""
    ties, left, masks = np.abs(correlation), set(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        pool = sorted(left)
        own = [max(pool, key=lambda b: (sum(ties[b, c] for c in pool if c != b), -b))]
        while len(own) < width:
            own.append(max((b for b in pool if b not in own), key=lambda b: (sum(ties[b, c] for c in own), -b)))
        left -= set(own)
        masks.append(sum(1 << b for b in own))
    return masks


def _near_share(fps: DataFrame, masks: list[int], distance: int, p: np.ndarray) -> list[list[float]]:
    """For each mask the estimated share of pairs within 0, 1, ... ``distance`` on it.

    Each fingerprint is paired with the next few in its batch, in an order that has nothing to do with its bits; where
    such pairs are too few to tell, the shares of the single bits give a floor.
    """

    def count(x: np.ndarray) -> np.ndarray:
        mixed = x[np.argsort((x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15), kind="stable")]
        out = np.zeros(len(masks) * (distance + 1) + 1, np.int64)
        for lag in range(1, LAGS + 1):
            diff = mixed[lag:] ^ mixed[:-lag]
            out[-1] += len(diff)
            for i, mask in enumerate(masks):
                d = np.bitwise_count(diff & np.uint64(mask))
                for e in range(distance + 1):
                    out[i * (distance + 1) + e] += np.count_nonzero(d <= e)
        return out

    got = _summed(fps, count)
    pairs = max(got.get(len(masks) * (distance + 1), 0), 1)
    shares = []
    for i, mask in enumerate(masks):
        spread = np.zeros(distance + 1)
        spread[0] = 1.0
        for b in range(BITS):
            if mask >> b & 1:
                q = 2 * p[b] * (1 - p[b])
                spread = spread * (1 - q) + np.r_[0, spread[:-1]] * q
        floor = np.cumsum(spread)
        shares.append([max(got.get(i * (distance + 1) + e, 0) / pairs, floor[e]) for e in range(distance + 1)])
    return shares


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds that sum to ``distance - m + 1`` at the least cost. ``costs[i][e]``: group i with threshold e; -1 is free."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for e in range(-1, distance + 1):
                more = cost + (own[e] if e >= 0 else 0.0)
                if total + e not in step or more < step[total + e][0]:
                    step[total + e] = (more, [*chosen, e])
        best = step
    return best[distance - len(costs) + 1]


def plan_groups(fps: DataFrame, distance: int) -> list[tuple[int, int]]:
    """``(mask, threshold)`` of each group in use: the cheapest plan over two to ``distance`` + 1 groups."""
    n, p, correlation = bit_correlation(fps)
    choices = [bit_groups(correlation, m) for m in range(2, distance + 2)] or [bit_groups(correlation, 1)]
    masks = [mask for c in choices for mask in c]
    shares = iter(_near_share(fps, masks, distance, p))
    plans = []
    for c in choices:
        costs = []
        for mask in c:
            width, share = mask.bit_count(), next(shares)
            probes = np.cumsum([comb(width, e) for e in range(distance + 1)])
            costs.append([n * (1 + probes[e] / 2) + n * n / 2 * share[e] for e in range(distance + 1)])
        cost, thresholds = allocate(costs, distance)
        plans.append((cost, [(mask, e) for mask, e in zip(c, thresholds, strict=True) if e >= 0]))
    return min(plans, key=lambda x: x[0])[1]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _flips(mask: int, threshold: int) -> list[int]:
    ones = [b for b in range(BITS) if mask >> b & 1]
    return [_signed(sum(1 << b for b in c)) for e in range(1, threshold + 1) for c in combinations(ones, e)]


def near_pairs(fps: DataFrame, distance: int = 3) -> DataFrame:
    """``(fp, near)``: all pairs of different fingerprints within ``distance``; ``fps`` holds each once.

    Every fingerprint is listed under its bits of each group and looks up the keys within that group's threshold that are not
    larger, so a pair meets once per group. A fingerprint has at most one partner for each way of flipping
    ``distance`` bits, so pairs grow with the number of fingerprints, however many lie close together.
    """
    groups = plan_groups(fps, distance)
    fp = F.col("fp")
    listed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("group"), fp.bitwiseAND(F.lit(_signed(m))).alias("key")) for i, (m, _) in enumerate(groups)])).alias("k"))
    listed = listed.select(F.col("fp").alias("near"), "k.group", "k.key")

    def asked(i: int, mask: int, threshold: int) -> Column:
        key = fp.bitwiseAND(F.lit(_signed(mask)))
        flips = _flips(mask, threshold)
        keys = F.array(key)
        if flips:
            around = F.transform(F.lit(flips).cast("array<bigint>"), lambda f: key.bitwiseXOR(f))
            keys = F.concat(keys, F.filter(around, lambda k: k < key))
        return F.transform(keys, lambda k: F.struct(F.lit(i).alias("group"), k.alias("key")))

    probes = fps.select("fp", F.explode(F.concat(*[asked(i, m, t) for i, (m, t) in enumerate(groups)])).alias("k"))
    probes = probes.select("fp", "k.group", "k.key")
    close = F.bit_count(probes["fp"].bitwiseXOR(listed["near"])) <= distance
    order = probes["fp"] != listed["near"]
    pairs = probes.join(listed, (probes["group"] == listed["group"]) & (probes["key"] == listed["key"]) & close & order)
    return pairs.select(F.greatest("fp", "near").alias("fp"), F.least("fp", "near").alias("near")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per row of ``docs``.

    Documents link when their fingerprints differ in at most ``distance`` bits; ``component_id`` is the smallest id that
    a document can reach, its own included. Texts without words (null, empty, white space) have fingerprint 0 and link
    to each other and to any fingerprint close to 0. Rows with equal ids or texts share a component as any equal fingerprints do;
    a component whose ids are all null has a null id. An empty table gives an empty result; other columns are ignored.
    """
    marked = checkpointed(fingerprints(docs, id_col, text_col, width))
    least = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(near_pairs(least.select("fp"), distance), "fp", "near")
    named = least.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    heads = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(heads, "component").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, with all columns.

    Rows with a null id are kept only where no row of their component has an id. Ids are taken to be unique; rows that repeat the
    smallest id stay together.
    """
    found = near_duplicates(docs, id_col, text_col, width, distance)
    heads = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_head_id"))
    return docs.join(heads, docs[id_col].cast("long").eqNullSafe(heads["_head_id"]), "left_semi")
