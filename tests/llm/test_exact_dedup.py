import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quireflow.llm.exact_dedup import drop_copies, exact_groups

ROWS = [
    (5, "a  b"), (3, "a\tb"), (9, "a b "), (1, None), (2, ""), (7, " a b"), (4, "a\r\n\x0b\x0cb"), (6, "ä" * 70_000), (8, "ä" * 70_000),
    (10, "A b"), (11, " "), (12, "\n"),
]


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return {(i, min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


def test_groups(docs):
    got = exact_groups(docs(ROWS).repartition(5)).select("doc_id", "keep_id", "group_size", "kept", "digest").collect()
    assert {tuple(r) for r in got} == expected(ROWS) and len(got) == len(ROWS)


def test_weak_digest_compares_content(docs):
    weak = lambda c: F.crc32(c.cast("binary")) % 2
    got = exact_groups(docs(ROWS).repartition(4), digest=weak).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert {tuple(r) for r in got} == {x[:4] for x in expected(ROWS)}


def test_repeated_rows_and_null_ids(docs):
    rows = [(1, "x"), (1, "x"), (1, "y"), (None, "z"), (None, "z"), (None, "x"), (2, "y")]
    got = sorted(map(tuple, exact_groups(docs(rows)).select("doc_id", "keep_id", "group_size", "kept").collect()), key=repr)
    assert got == sorted(
        [(1, 1, 4 - 0 - 1, True), (1, 1, 3, False), (1, 1, 2, True), (None, None, 2, True), (None, None, 2, False), (None, 1, 3, False), (2, 1, 2, False)], key=repr
    )
    kept = drop_copies(docs(rows))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(1, "x"), (1, "y"), (None, "z")], key=repr)
    assert kept.columns == docs(rows).columns


def test_hot_text_over_many_tasks(spark):
    frame = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'hot text', concat('t', id)) AS text").repartition(40)
    got = exact_groups(frame, salts=4)
    assert got.where("kept").count() == 2001
    assert got.where("keep_id = 0").agg(F.min("group_size"), F.count("*")).first()[:] == (1000, 1000)


def test_empty(docs):
    assert exact_groups(docs([])).collect() == [] and drop_copies(docs([])).collect() == []


def test_no_python_in_the_plan(docs):
    plan = exact_groups(docs(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Python", "Arrow", "Pandas") if x in plan], plan


@pytest.mark.parametrize("text", ["", " ", "x y", "\x1c"])
def test_only_ascii_space_is_white(docs, text):
    got = exact_groups(docs([(1, text), (2, text + " ")])).select("group_size").distinct().collect()
    assert got[0][0] == 1
