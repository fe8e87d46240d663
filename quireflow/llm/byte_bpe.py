"""Byte-level BPE with a sentencepiece engine whose model is written straight from a vocabulary of ranks.

The 256 bytes are mapped to 256 printable characters, every vocabulary entry becomes a normal piece with the score
-rank, and the model asks for BPE without any normalisation. Merging the best-scored pair first is then the same
as merging the lowest rank first. Nothing is trained.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_AT_ONCE = 256
CACHED_WORDS = 100_000
UNKNOWN = "␀"  # stands for no byte


def byte_characters() -> list[str]:
    """A character for each byte: itself if printable in Latin-1, else one from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file, by rank: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def model_proto(vocabulary: list[bytes]) -> bytes:
    """A serialised sentencepiece model: piece 0 is unknown, piece rank + 1 is the entry of that rank."""
    chars = byte_characters()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _message(1, _message(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _number(3, kind))

    normal, unknown, bpe = 1, 2, 2
    pieces = [piece(UNKNOWN, 0.0, unknown), *(piece("".join(map(chars.__getitem__, t)), -float(r), normal) for r, t in enumerate(vocabulary))]
    absent = (1 << 64) - 1  # -1: no such control piece
    trainer = _number(3, bpe) + _number(4, len(pieces)) + _number(40, 0) + b"".join(_number(f, absent) for f in (41, 42, 43)) + _message(45, UNKNOWN.encode())
    normaliser = _message(1, b"identity") + b"".join(_number(f, 0) for f in (3, 4, 5))
    return b"".join(pieces) + _message(2, trainer) + _message(3, normaliser)


class Codec:
    """Encodes and decodes with one vocabulary; each match of ``pattern`` is encoded on its own."""

    def __init__(self, vocabulary: list[bytes], pattern: str):
        self.vocabulary = vocabulary
        self.whole = {t: [r] for r, t in enumerate(vocabulary)}
        self.chars = dict(enumerate(byte_characters()))
        self.pattern = regex.compile(pattern)
        self.engine = sentencepiece.SentencePieceProcessor(model_proto=model_proto(vocabulary))
        self.seen: dict[str, list[int]] = {}

    def _learn(self, words: set[str]) -> None:
        """Encode words not met before, all in one call of the engine; at most ``CACHED_WORDS`` and one batch are remembered."""
        if len(self.seen) > CACHED_WORDS:
            self.seen.clear()
        new = list(words.difference(self.seen))
        data = [w.encode() for w in new]
        rest = []
        for w, d in zip(new, data, strict=True):
            ids = self.whole.get(d)
            if ids is None:
                rest.append((w, d.decode("latin-1").translate(self.chars)))
            else:
                self.seen[w] = ids
        for (w, _), pieces in zip(rest, self.engine.encode([x for _, x in rest], num_threads=1), strict=True):
            self.seen[w] = [i - 1 for i in pieces]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.pattern.findall(t or "") for t in texts]
        self._learn(set().union(*cut))
        known = self.seen.__getitem__
        return [list(chain.from_iterable(map(known, words))) for words in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per Python worker and vocabulary."""
    return Codec(read_ranks(path), pattern)


def _in_batches(columns: Callable[[pa.RecordBatch], pa.RecordBatch]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield columns(batch.slice(at, ROWS_AT_ONCE))

    return run


def _lists(ids: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, ends[-1])))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)``: the token ids of each row's whole text, without special tokens; null counts as empty.

    ``path`` names a rank file that every executor can open. Rows, their order and repeats stay as they are; an empty text has no ids.
    """

    def columns(part: pa.RecordBatch) -> pa.RecordBatch:
        ids = codec(path, pattern).encode(part.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([part.column(0), _lists(ids)], ["doc_id", "ids"])

    return _texts(docs, id_col, text_col).mapInArrow(_in_batches(columns), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids, decoded)``: the bytes that the ids stand for; null ids count as none."""

    def columns(part: pa.RecordBatch) -> pa.RecordBatch:
        lists = part.column(1)
        flat = lists.flatten().to_numpy(zero_copy_only=False).tolist()
        sizes = np.asarray(lists.value_lengths().fill_null(0))
        ends = np.cumsum(sizes)
        data = [codec(path, pattern).decode(flat[b - n : b]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(data, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(_in_batches(columns), "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` of its ids in one pass and one worker: ``(doc_id, ids, decoded)``."""

    def columns(part: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path, pattern)
        ids = own.encode(part.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([part.column(0), _lists(ids), pa.array(map(own.decode, ids), pa.binary())], ["doc_id", "ids", "decoded"])

    return _texts(docs, id_col, text_col).mapInArrow(_in_batches(columns), "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of decoded rows, and the columns named in ``more``."""
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    listed = F.concat_ws(",", ids.cast("array<string>"))
    return decoded.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *more
    )
