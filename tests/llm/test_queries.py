"""Each registered query on a whole given table against a plain version, an encoder or held-out rows."""

import base64
import hashlib
import zlib

import check
import public_tokenizers as P
import pytest
import tiktoken
from llm_brute import brute_components, brute_fp, runs_in_common

import __spark_entry__ as entry
from quireflow.llm import queries as Q
from quireflow.llm import words as W

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def rows_of(spark, name, folder=FOLDER):
    return entry.queries()[name](spark, folder).collect()


def test_all_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert {int(n[2:].split("_")[0]) for n in names if n[2].isdigit()} <= set(range(1, 14)) and "pipeline" in entry.queries()
    assert set(Q.ORACLES) <= set(entry.oracle_sql())


def test_op1_matches_its_oracle(spark):
    message, *_, ok = check.compare(spark, "op1_exact_dedup", Q.QUERIES["op1_exact_dedup"], Q.ORACLES["op1_exact_dedup"], FOLDER)
    assert ok, message


def test_op2_joins_all_that_share_fifty_words(spark, texts):
    rows = rows_of(spark, "op2_substring_dedup")
    classes = {r["doc_id"]: r["class_id"] for r in rows}
    want = runs_in_common({i: W.cut_words([W.lowered(t).encode()]).hash.tolist() for i, t in texts.items()}, 50)
    assert len(rows) == len(texts) and all(classes[i] == classes[want[i]] for i in texts)
    # Near copies may join more, not many.
    assert sum(classes[i] != want[i] for i in texts) <= 0.02 * len(texts)


def test_op4_names_held_out_languages(spark):
    rows = rows_of(spark, "op4_language_id", "/root/testdata/sf0.01")
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(langs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) > 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in rows)


def test_op6_matches_brute_force(spark, texts):
    marks = [(i, brute_fp(t)) for i, t in texts.items()]
    comp = brute_components(marks, 3)
    assert {tuple(r) for r in rows_of(spark, "op6_simhash_near_dedup")} == {(i, f"{fp:016x}", comp[i]) for i, fp in marks}


def test_op7_finds_every_whole_item(spark, texts):
    line = lambda t: W.cut_words([W.lowered(t).encode()]).hash.tobytes()
    items = {r["item_id"]: line(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    want = {(i, k) for i, t in texts.items() for d in [line(t)] for k, x in items.items() if x in d}
    got = {(r["doc_id"], r["item_id"]) for r in rows_of(spark, "op7_decontaminate")}
    assert want and got == want


def test_op9_matches_the_public_encoder(spark, texts):
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    oracle = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for i, t in texts.items():
        ids = oracle.encode_ordinary(t or "")
        want.add((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert {tuple(r) for r in rows_of(spark, "op9_byte_bpe")} == want


def test_op10_ranks_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    rows = rows_of(spark, "op10_toxicity", folder)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    caught = [p for p, y in held if y == 1]
    clean = [p for p, y in held if y == 0]
    assert sum(caught) > 0.8 * len(caught) and sum(clean) < 0.03 * len(clean)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)
