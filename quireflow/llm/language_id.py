"""Language identification: the mean of hashed subword embeddings under a linear softmax.

Subwords are the byte 2-, 3- and 4-grams of the lower-cased words, with their borders. The model is trained by plain stochastic
gradient descent in numpy on a bounded sample; a temperature and a rejection threshold are calibrated
on a part of the sample that training does not see. For prediction embeddings and softmax weights are multiplied
out, so a text costs one table look-up per subword.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import held_out, smallest_hashes

ROWS_AT_ONCE = 256
STEP = 1 << 19
SIZES = (2, 3, 4)
LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"

_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # a row of scores per subword bucket
    bias: np.ndarray
    temperature: float
    reject_below: float


def _grams(x: np.ndarray, starts: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and positions of the subwords that begin in the first ``starts`` bytes: no white space inside."""
    space = x == 32
    out, at = [], []
    value = x.astype(np.uint64)
    inner = np.zeros(len(x), bool)
    for n in range(2, max(SIZES) + 1):
        m = len(x) - n + 1
        if m <= 0:
            break
        value = value[:m] * np.uint64(257) + x[n - 1 :]
        if n > 2:
            inner = inner[:m] | space[n - 2 : n - 2 + m]
        else:
            inner = inner[:m]
        good = ~inner & ~(space[:m] & space[n - 1 :])
        good[starts:] = False
        pos = np.flatnonzero(good)
        h = (value[pos] ^ np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
        out.append((h >> np.uint64(64 - (buckets - 1).bit_length())).astype(np.int64))
        at.append(pos)
    return (np.concatenate(out), np.concatenate(at)) if out else (np.empty(0, np.int64), np.empty(0, np.int64))


def _bytes(text: str) -> np.ndarray:
    return _KEEP[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]


def _sums(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed table rows and the number of subwords of each text; long texts are added up piece by piece."""
    total, count = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), np.int64)
    over = max(SIZES) - 1
    pieces = []
    for i, t in enumerate(texts):
        x = _bytes(t)
        pieces += [(i, x[a : a + STEP + over], STEP if a + STEP < len(x) else len(x)) for a in range(0, len(x), STEP)]
    for i, x, starts in pieces:
        h, _ = _grams(x, starts, len(table))
        total[i] += table[h].sum(axis=0, dtype=np.float64)
        count[i] += len(h)
    return total, count


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: list[str], buckets: int = 1 << 16, width: int = 16, epochs: int = 6, rate: float = 0.5, keep: float = 0.999) -> Model:
    """Fit on four fifths of the sample, calibrate on the rest. ``keep``: the share of rightly named texts that pass the rejection threshold."""
    languages = sorted(set(labels))
    y = np.array([languages.index(v) for v in labels], np.int64)
    rng = np.random.default_rng(11)
    order = rng.permutation(len(texts))
    fit, check = order[len(order) // 5 :], order[: len(order) // 5]
    bags = {}
    for i in fit:
        h, _ = _grams(x := _bytes(texts[i]), len(x), buckets)
        bucket, n = np.unique(h, return_counts=True)
        bags[i] = (bucket, (n / max(n.sum(), 1)).astype(np.float32))
    e = rng.uniform(-1 / width, 1 / width, (buckets, width)).astype(np.float32)
    w = np.zeros((width, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    step, steps = 0, epochs * len(fit)
    for _ in range(epochs):
        for i in rng.permutation(fit):
            lr = np.float32(rate * (1 - step / steps))
            step += 1
            bucket, share = bags[i]
            if not len(bucket):
                continue
            mean = share @ e[bucket]
            g = _softmax(mean @ w + bias)
            g[y[i]] -= 1
            back = w @ g
            w -= lr * np.outer(mean, g)
            bias -= lr * g * np.float32(0.1)
            # Each subword moves by its share; the factor makes up for how little one share moves a mean.
            e[bucket] -= lr * np.float32(20) * share[:, None] * back[None, :]
    model = Model(languages, e @ w, bias.astype(float), 1.0, 0.0)
    if len(check):
        z = _logits(model, [texts[i] for i in check])
        rows = np.arange(len(check))
        loss = {t: -np.log(_softmax(z / t)[rows, y[check]] + 1e-12).mean() for t in np.geomspace(0.05, 5, 41)}
        model.temperature = float(min(loss, key=loss.get))
        p = _softmax(z / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y[check]]
        if len(right):
            model.reject_below = float(min(0.5, np.quantile(right, 1 - keep)))
    return model


def _logits(model: Model, texts: list[str]) -> np.ndarray:
    total, count = _sums(texts, model.table)
    return total / np.maximum(count, 1)[:, None] + model.bias


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, calibrated probability and whether the calibrated threshold rejects it."""
    known = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if model.languages else []
    lang, score, rejected = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    if known:
        p = _softmax(_logits(model, [texts[i] for i in known]) / model.temperature)
        for i, best, value in zip(known, p.argmax(axis=1), p.max(axis=1), strict=True):
            lang[i], score[i], rejected[i] = model.languages[best], value, value < model.reject_below
    return lang, score, rejected


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 6000, max_chars: int = 20_000) -> Model:
    """Train on at most ``sample`` rows that are not held out and have a language; of them, those of at most ``max_chars`` characters."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    chosen = smallest_hashes(rows.where(~held_out("id") & F.col("lang").isNotNull()), "id", sample)
    got = chosen.where(F.length("text").between(1, max_chars)).select("id", "text", "lang").collect()
    got = sorted((r for r in got if LETTER.search(r["text"])), key=lambda r: (r["id"], r["text"], r["lang"]))
    if not got:
        return Model([], np.zeros((1, 0), np.float32), np.zeros(0), 1.0, 0.0)
    return train([r["text"] for r in got], [r["lang"] for r in got])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)``, one row per row of ``docs``; whole texts.

    Null texts and texts without a letter are ``und`` with score 0 and rejected, as is everything if nothing was learned. Only
    the text is an input. The model has a fixed number of buckets, whatever the corpus.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                lang, score, rejected = predict(shared.value, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with all columns; judged row by row, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col))
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                *_, rejected = predict(shared.value, part.column(at_text).to_pylist())
                yield part.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)
