import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quireflow.llm import queries as Q
from quireflow.llm import shards as S


def frame(spark, rows, schema="doc_id long, text string, lang string, source string"):
    made = spark.createDataFrame(rows, schema)
    return made.selectExpr("*", "'x' AS size", "1 AS shard", "2 AS slot", "3 AS node", "4 AS p", "5 AS d0", "6 AS id", "7 AS times", "8 AS block")


def by_shard(rows, shards):
    out = {k: [] for k in range(shards)}
    for r in rows:
        out[r["shard"]].append(r)
    return out


def check_slots(groups):
    for rows in groups.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))


def facts(text):
    data = (text or "").encode()
    return len(data) + 16, zlib.crc32(data)


def messy(n, seed):
    rng = random.Random(seed)
    words = ["a", "é", "long word ", "x" * 50]
    return [(i, None if i % 17 == 0 else rng.choice(words) * int(rng.paretovariate(1.2)), rng.choice([None, "en", "de", "fr"]), f"source {min(int(rng.expovariate(1)), 5)}") for i in range(n)]


@pytest.mark.parametrize("shards", [1, 7])
def test_bytes_are_near_equal(spark, shards):
    rows = [r for r in messy(3000, shards) if len(r[1] or "") < 2000]
    got = S.assign(frame(spark, rows).repartition(5), shards).collect()
    texts = {r[0]: r[1] for r in rows}
    assert sorted(r["doc_id"] for r in got) == sorted(texts) and all((r["size"], r["text_crc32"]) == facts(texts[r["doc_id"]]) for r in got)
    groups = by_shard(got, shards)
    check_slots(groups)
    sizes = [sum(r["size"] for r in g) for g in groups.values()]
    largest = max(r["size"] for r in got)
    assert max(sizes) - min(sizes) <= 2 * largest + 0.02 * sum(sizes) / shards


def plain_tree(rows, shards):
    """The same tree by sorting: ``rows`` are ``(values, hash, size, id)``; returns ids per shard."""
    first = [[x for x in column if x is not None] for column in zip(*[r[0] for r in rows], strict=True)]
    spans = [max(1, max(c) - min(c)) if c else 1 for c in first]
    out = {}

    def split(rows, shard, k):
        if k == 1:
            out[shard] = {r[3] for r in rows}
            return
        total, half = sum(r[2] for r in rows), k // 2
        columns = [[r[0][d] for r in rows if r[0][d] is not None] for d in range(len(spans))]
        widths = [(max(c) - min(c)) / s if c else 0 for c, s in zip(columns, spans, strict=True)]
        dim = widths.index(max(widths))
        rows = sorted(rows, key=lambda r: (-S.LIMIT if r[0][dim] is None else r[0][dim], r[1]))
        goal, upto, at = max(1, total * half // k), 0, 0
        while upto + rows[at][2] < goal:
            upto += rows[at][2]
            at += 1
        at += goal - upto > upto + rows[at][2] - goal
        split(rows[:at], shard, half)
        split(rows[at:], shard + half, k - half)

    split(rows, 0, shards)
    return out


@pytest.mark.parametrize("shards", [5])
def test_tree_is_that_of_sorted_medians(spark, shards, monkeypatch):
    monkeypatch.setattr(S, "SLACK", 0)
    docs = frame(spark, messy(600, 9))
    slim = S.slim(docs).withColumn("bytes", F.expr("size * times")).collect()
    plain = plain_tree([([r["d0"], r["d1"], r["d2"], r["d3"]], r["h"], r["bytes"], r["id"]) for r in slim], shards)
    got = {k: {r["doc_id"] for r in g} for k, g in by_shard(S.assign(docs, shards).collect(), shards).items()}
    assert got == plain


def test_copies_of_one_row_fill_many_shards(spark):
    rows = [(1, "same text", "en", "s")] * 3000 + [(i, "t" * (i % 50), "de", "s") for i in range(2, 3000)]
    got = S.assign(frame(spark, rows).repartition(7), 8).collect()
    groups = by_shard(got, 8)
    check_slots(groups)
    sizes = [sum(r["size"] for r in g) for g in groups.values()]
    assert len(got) == len(rows) and max(sizes) - min(sizes) < 0.05 * sum(sizes) / 8
    assert len({r["shard"] for r in got if r["doc_id"] == 1}) > 2


def test_all_rows_alike_null_or_few(spark):
    for rows in ([(5, "x", None, None)] * 100, [(None, None, None, None)] * 100):
        groups = by_shard(S.assign(frame(spark, rows), 5).collect(), 5)
        check_slots(groups)
        assert {len(g) for g in groups.values()} == {20}
    few = S.assign(frame(spark, [(1, "a", "en", "s"), (2, "y" * 3_000_000, "de", "t")]), 4).collect()
    assert len(few) == 2 and len({r["shard"] for r in few}) == 2 and all(r["slot"] == 0 for r in few)
    assert S.assign(frame(spark, []), 4).collect() == []


def test_target_bytes_and_given_dimensions(spark):
    rows = [(i, "z" * 84, f"l{i % 3}", "s") for i in range(1000)]
    got = S.assign(frame(spark, rows), target_bytes=10_000, dims=["lang"]).collect()
    groups = by_shard(got, 10)
    assert all(9_000 <= sum(r["size"] for r in g) <= 11_000 for g in groups.values())
    # Split by language first: no shard but those at borders has two.
    assert sum(len({rows[r["doc_id"]][2] for r in g}) > 1 for g in groups.values()) <= 2


def test_same_result_whatever_the_layout(spark):
    docs = frame(spark, messy(500, 3) + messy(50, 3))
    one = sorted(map(tuple, S.assign(docs.repartition(1), 4).collect()))
    assert one == sorted(map(tuple, S.assign(docs.repartition(9), 4).collect()))


def test_whole_rows_are_written_to_their_shard(spark, tmp_path):
    docs = frame(spark, messy(400, 5))
    tree = S.fit(docs, 3)
    want = {r["doc_id"]: r["shard"] for r in S.assign(docs, 3).collect()}
    S.write_shards(docs.drop("shard"), f"{tmp_path}/out", tree, files=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert {r["doc_id"]: r["shard"] for r in back.collect()} == want
    digest = lambda df: df.select(F.bit_xor(F.xxhash64("doc_id", "text", "lang")), F.count("*")).first()
    assert digest(back) == digest(docs)


def test_no_python_in_the_plan(spark):
    plan = S.assign(frame(spark, messy(50, 1)), 4)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Python", "Arrow", "Pandas") if x in plan], plan


def test_unknown_dimension_is_refused(spark):
    with pytest.raises(TypeError, match="dimension"):
        S.assign(frame(spark, []).withColumn("x", F.lit(1.5)), 4, dims=["x"])


def test_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = Q.QUERIES["op12_sharding"](spark, folder).collect()
    docs = {r["doc_id"]: facts(r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == docs and len(rows) == len(docs)
    groups, sizes = by_shard(rows, 40), defaultdict(int)
    check_slots(groups)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None
    mean = sum(sizes.values()) / 40
    assert all(abs(s - mean) < 0.15 * mean for s in sizes.values())
