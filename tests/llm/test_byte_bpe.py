import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from quireflow.llm import byte_bpe as B

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def oracle():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None, "", " ", "a", "Hello world's end, they'll 123  see\n\n x", "ÄÖÜ ß été 日本語 テスト 🙂🙂 ñandú", "\x00\x01\x1c\x1d\x1e\x1f\x7f\x85\xa0  x​﻿",
    "<|endoftext|> <unk> ▁▁a ␀", "a" * 5000, "  \t\r\n  x  ", "x" * 70 + " " + "ab" * 3000, "İKǅ ½ ² ٣ ⅷ", "word'S 'tis 'll 've",
]


def test_ids_match_the_public_encoder(oracle):
    codec = B.codec(PATH, P.PATTERN)
    r = random.Random(4)
    alphabet = [*"abcde EXYZ  \n\t'0129.,;:#-_/\\\"sétñäß日本🙂\x1c\x85\xa0 ", "the", "ing", "tion"]
    texts = [t or "" for t in TEXTS] + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 200))) for _ in range(1500)]
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids == oracle.encode_ordinary(t), repr(t)
        assert codec.decode(ids) == t.encode()
    nulls = __import__("pyarrow").array([[1], None, [], [2, 3]])
    assert nulls.value_lengths().fill_null(0).to_pylist() == [1, 0, 0, 2]


def test_real_texts(spark, oracle):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: list(r["ids"]) for r in B.encode(rows, PATH, P.PATTERN).collect()}
    assert got == {r["doc_id"]: oracle.encode_ordinary(r["text"] or "") for r in rows.collect()}


def test_query_columns(docs, oracle):
    frame = docs([*enumerate(TEXTS), (None, "x"), (1, ""), (3, "a")])
    got = B.digests(B.decode(B.encode(frame, PATH, P.PATTERN), PATH, P.PATTERN))
    want = []
    for i, t in [*enumerate(TEXTS), (None, "x"), (1, ""), (3, "a")]:
        ids = oracle.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sorted(map(tuple, B.digests(B.round_trip(frame, PATH, P.PATTERN)).collect()), key=repr) == sorted(want, key=repr)
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]


def test_empty_table(docs):
    assert B.digests(B.decode(B.encode(docs([]), PATH, P.PATTERN), PATH, P.PATTERN)).collect() == []
