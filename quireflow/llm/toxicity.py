"""Toxicity by multiple-instance learning: sentences are the instances, documents carry the labels.

A sentence's probability is a logistic function of its different hashed words and word stems (first bytes); a document is toxic if any sentence is, so
its probability is a leaky noisy-or of its sentences. Gradients of the document likelihood reach the sentences that
explain it, which is how the model learns where the offence is. The leak takes up labels that no sentence explains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import held_out, smallest_hashes
from .words import cut_words, groups_of

ROWS_AT_ONCE = 256
STEMS = (4, 5, 6)
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n\r")] = True


@dataclass
class Model:
    weights: np.ndarray  # one per word bucket
    bias: float
    leak: float


def _instances(group: list[bytes], buckets: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different features of each sentence that has words: sentence (ascending) and bucket; per sentence its document and byte span.

    With ``weights`` features whose weight is zero are left out before they are sorted.
    """
    words = cut_words(group, STEMS)
    sizes = np.array([len(t) + 1 for t in group], np.int64)
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"\n".join([*group, b""]), np.uint8)
    stops = np.flatnonzero(_ENDS[data])
    sentence = np.searchsorted(stops, begins[words.doc] + words.start) if len(words.doc) else np.empty(0, np.int64)
    first = np.flatnonzero(np.diff(sentence, prepend=-1))
    number = np.cumsum(np.diff(sentence, prepend=-1) > 0) - 1
    last = np.r_[first[1:], len(sentence)] - 1 if len(first) else first
    length = words.end - words.start
    pairs = []
    for n, h in zip((0, *STEMS), (words.hash, *words.prefix), strict=True):
        bucket = (h & np.uint64(buckets - 1)).astype(np.int64)
        good = length > n if weights is None else (length > n) & (weights[bucket] != 0)
        pairs.append(number[good] * buckets + bucket[good])
    pair = np.unique(np.concatenate(pairs))
    return pair // buckets, pair % buckets, words.doc[first], words.start[first], words.end[last]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, values, n)


def _ascend(x: np.ndarray, s: np.ndarray, b: np.ndarray, d: np.ndarray, y: np.ndarray, epochs: int, rate: float, decay: float) -> np.ndarray:
    """Full-batch Adam on the document likelihood. ``x``: weights, bias, leak; ``s, b``: sentence and weight of each feature; ``d``: document of each sentence."""
    mean, power = np.zeros(len(x)), np.zeros(len(x))
    for epoch in range(1, epochs + 1):
        p = _sigmoid(x[-2] + _sums(x[b], s, len(d)))
        clean = np.exp(_sums(np.log1p(-np.minimum(p, 1 - 1e-12)), d, len(y)))
        leak = _sigmoid(x[-1])
        whole = np.maximum(1 - (1 - leak) * clean, 1e-9)
        # d likelihood / d logit: -p for a clean document, p (1 - P) / P for a toxic one; the same holds for the leak.
        pull = np.where(y, (1 - whole) / whole, -1.0)
        g = p * pull[d]
        step = np.r_[_sums(g[s], b, len(x) - 2) - decay * x[:-2], g.sum(), leak * pull.sum()]
        mean = 0.9 * mean + 0.1 * step
        power = 0.99 * power + 0.01 * step**2
        x = x + rate * (1 - epoch / (epochs + 1)) * mean / (1 - 0.9**epoch) / (np.sqrt(power / (1 - 0.99**epoch)) + 1e-3)
    return x


def train(texts: list[str], labels: list[int], buckets: int = 1 << 18, rounds: tuple[int, int] = (120, 400), least: int = 8, cut: float = 1.0) -> Model:
    """Fit to labelled texts. Only buckets found in ``least`` or more of them get a weight.

    A first round finds the features that matter; a second one fits those whose weight is over ``cut``, the bias and the leak.
    """
    sent, bucket, doc, offset, documents = [], [], [], 0, 0
    found_in = np.zeros(buckets, np.int64)
    for _, group in groups_of(texts):
        s, b, d, *_ = _instances(group, buckets)
        found_in += np.bincount(np.unique(d[s] * buckets + b) % buckets, minlength=buckets)
        sent.append((s + offset).astype(np.int32))
        bucket.append(b.astype(np.int32))
        doc.append((d + documents).astype(np.int32))
        offset += len(d)
        documents += len(group)
    s, b, d = np.concatenate(sent), np.concatenate(bucket), np.concatenate(doc)
    y = np.asarray(labels, bool)
    del sent, bucket, doc
    common = found_in >= least
    x = np.array([-6.0, -3.0])
    used = np.empty(0, np.int64)
    for epochs, decay in zip(rounds, (0.2, 0.02), strict=True):
        keep = common[b]
        s, b = s[keep], b[keep]
        start = np.zeros(buckets)
        start[used] = x[:-2]
        used, own = np.unique(b, return_inverse=True)
        x = _ascend(np.r_[start[used], x[-2:]], s, own, d, y, epochs, 0.2, decay)
        common = np.zeros(buckets, bool)
        common[used[x[:-2] > cut]] = True
    weights = np.zeros(buckets, np.float32)
    weights[used] = x[:-2]
    return Model(weights, float(x[-2]), float(_sigmoid(x[-1])))


def score(model: Model, texts: list[str | None], sentence_cut: float = 0.5) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Probability of each text, and ``(start, end, probability)`` of its offending sentences in code points."""
    out = np.full(len(texts), model.leak)
    spans: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    for first, group in groups_of(texts):
        s, b, d, start, end = _instances(group, len(model.weights), model.weights)
        p = _sigmoid(model.bias + _sums(model.weights[b], s, len(d)))
        clean = np.exp(_sums(np.log1p(-np.minimum(p, 1 - 1e-12)), d, len(group)))
        out[first : first + len(group)] = 1 - (1 - model.leak) * clean
        for k in np.flatnonzero(p >= sentence_cut):
            data = group[d[k]]
            head = len(data[: start[k]].decode())
            spans[first + d[k]].append((head, head + len(data[start[k] : end[k]].decode()), float(p[k])))
    return out, spans


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 4000, max_chars: int = 20_000
) -> Model:
    """Train on at most ``sample`` labelled rows of each class that are not held out; of them, those of at most ``max_chars`` characters."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(~held_out("_id") & F.col("_label").isin(0, 1))
    chosen = [smallest_hashes(known.where(F.col("_label") == k), "_id", sample) for k in (0, 1)]
    # At most 2 * sample rows of two numbers: a proven bound for the broadcast.
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    got = rows.join(F.broadcast(chosen[0].union(chosen[1])), "_id").where(F.length("_text") <= max_chars).collect()
    got = sorted((r["_id"], r["_label"], r["_text"]) for r in got)
    ys = [y for _, y, _ in got]
    if not got or len(set(ys)) < 2:
        return Model(np.zeros(1, np.float32), -40.0, float(ys[0]) if got else 0.0)
    return train([t for *_, t in got], ys)


def assess(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, offending)``, one row per row of ``docs``; ``offending``: array of (start, end, probability), sentences by position.

    Null and empty texts get the leak, the probability of a document without sentences. Only the text is an input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                scores, spans = score(shared.value, part.column(1).to_pylist())
                rows = [[{"start": a, "end": b, "p": p} for a, b, p in x] for x in spans]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array(rows, span)], ["doc_id", "score", "offending"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, offending array<struct<start: int, end: int, p: double>>")
