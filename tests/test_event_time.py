"""Streams in event time: shuffled triggers, late rows, state that shrinks."""

import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import Row

from quireflow.streaming import history as H
from quireflow.streaming import jobs as J
from quireflow.streaming import sessions as N
from quireflow.streaming import windows as W

START = dt.datetime(2024, 1, 1)
LATE = dt.timedelta(minutes=10)


def spread_over_files(spark, folder, batches, schema):
    """One file per trigger, in order of their times."""
    os.makedirs(folder)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/t{i}.tmp")
        name = next(f for f in os.listdir(f"{folder}/t{i}.tmp") if f.endswith(".parquet"))
        os.rename(f"{folder}/t{i}.tmp/{name}", f"{folder}/{i:03d}.parquet")
        stamp = time.time() - 1000 + i
        os.utime(f"{folder}/{i:03d}.parquet", (stamp, stamp))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(folder)


def jittered(rows, triggers, seed):
    """Rows in an order that is off by less than ten minutes, dealt over triggers."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.uniform(0, 590)))
    size = -(-len(rows) // triggers)
    batches = [rows[i : i + size] for i in range(0, len(rows), size)]
    for b in batches:
        rng.shuffle(b)
    return batches


EDITS = "doc_id long, ts timestamp, event_id long, op string, heap_bytes long"


def edits(n, seed):
    rng = random.Random(seed)
    ops = ["record"] * 5 + ["undo"] * 3 + ["redo", "redo", "save"]
    # Equal times are put in order by event_id; a third of all events are one document's.
    return [(rng.choice([0, 0, 1, 2, 3, 4]), START + dt.timedelta(seconds=rng.randrange(10_000)), i, rng.choice(ops), rng.randrange(1 << 24)) for i in range(n)]


@pytest.mark.parametrize("triggers", [1, 9])
def test_shuffled_triggers_equal_the_batch(spark, tmp_path, triggers):
    rows = edits(700, triggers)
    stream = spread_over_files(spark, f"{tmp_path}/in", jittered(rows, triggers, 3), EDITS)
    got = J.drain(H.edit_history_event_time(stream))
    closed = max(r[1] for r in rows) - LATE
    due = {r[2] for r in rows if r[1].replace(second=0) + dt.timedelta(minutes=1) <= closed}
    want = [tuple(r) for r in H.edit_history(spark.createDataFrame(rows, EDITS)).collect() if r["event_id"] in due]
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


def test_rows_older_than_ten_minutes_are_dropped(spark, tmp_path):
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    batches = [
        [(1, at(0), 0, "record", 1), (1, at(30), 1, "record", 1)],
        [(1, at(5), 2, "record", 1), (1, at(22), 3, "undo", 1), (2, at(31), 4, "record", 1)],  # the first of them is late
        [(1, at(60), 5, "record", 1)],
    ]
    got = J.drain(H.edit_history_event_time(spread_over_files(spark, f"{tmp_path}/in", batches, EDITS)))
    assert sorted((r["event_id"], r["undo_depth"]) for r in got.collect()) == [(0, 1), (1, 1), (3, 0), (4, 1)]


DOCS = "doc_id long, ts timestamp, event_id long, kind string"


def latest_open(rows):
    last = {}
    for doc, ts, event, kind in rows:
        last[doc] = max(last.get(doc, (ts, event, kind)), (ts, event, kind))
    return {(doc, ts) for doc, (ts, _, kind) in last.items() if kind == "opened"}


def test_open_documents_equal_the_batch_and_state_shrinks(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for doc in range(120):
        t = START + dt.timedelta(seconds=rng.randrange(9000))
        for k in range(rng.randrange(1, 5)):
            rows.append((doc, t, len(rows), ["opened", "closed"][k % 2]))
            t += dt.timedelta(seconds=rng.randrange(1, 300))
    # Long afterwards, so that the watermark passes every closing.
    end = [(500, START + dt.timedelta(hours=9), len(rows), "opened")]
    stream = spread_over_files(spark, f"{tmp_path}/in", [*jittered(rows, 6, 5), end], DOCS)
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    N.upsert(N.open_document_changes(stream), out, state, once=True).awaitTermination()
    want = latest_open(rows + end)
    schema = "doc_id long, since timestamp, deleted boolean"
    got = N.read_upserted(spark, out, ["doc_id"], schema, "deleted")
    assert {tuple(r) for r in got.collect()} == want
    batch = W.open_documents(spark.createDataFrame(rows + end, DOCS))
    assert {tuple(r) for r in batch.collect()} == want
    kept = spark.read.format("statestore").option("stateVarName", "latest").load(state)
    assert kept.count() == len(want) < 121
    # Only what changed is written: fewer rows than documents per trigger, and less than one per event.
    written = spark.read.schema(f"{schema}, batch long").parquet(out)
    assert written.count() < len(rows) and written.where("batch > 2").count() < written.count()
    N.compact(spark, out, f"{tmp_path}/compact", ["doc_id"], schema, "deleted")
    again = N.read_upserted(spark, f"{tmp_path}/compact", ["doc_id"], schema, "deleted")
    assert {tuple(r) for r in again.collect()} == want


def test_a_close_holds_off_an_older_opening_in_a_later_trigger(spark, tmp_path):
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    batches = [[(1, at(5), 1, "closed"), (2, at(5), 2, "opened")], [(1, at(4), 0, "opened")], [(3, at(40), 3, "closed")], [(2, at(6), 4, "closed")]]
    changes = N.open_document_changes(spread_over_files(spark, f"{tmp_path}/in", batches, DOCS))
    # The last closing is older than ten minutes when it comes and is dropped.
    assert {tuple(r) for r in N.drain_upserted(changes, ["doc_id"], "deleted").collect()} == {(2, at(5))}


def test_windows_are_upserted_and_leave_the_state(spark, tmp_path):
    rng = random.Random(4)
    rows = [(START + dt.timedelta(seconds=rng.randrange(20_000)), rng.choice(["email", "phone"])) for _ in range(600)]
    rows = [(i, ts, k) for i, (ts, k) in enumerate(rows)]
    stream = spread_over_files(spark, f"{tmp_path}/in", jittered(rows, 5, 6), "doc_id long, ts timestamp, kind string")
    want = W.pattern_counts(spark.createDataFrame(rows, "doc_id long, ts timestamp, kind string")).collect()
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    query = N.upsert(W.pattern_counts(stream), out, state, once=True)
    query.awaitTermination()
    got = N.read_upserted(spark, out, ["from_ts", "kind"], "from_ts timestamp, kind string, hits long").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < len(want) / 2


class Timers:
    def getCurrentWatermarkInMs(self):
        return self.watermark


class CountedState:
    """A document's state in memory; every call is counted."""

    def __init__(self):
        self.calls, self.value, self.entries, self.timers = 0, None, [], set()

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name in ("getValueState", "getListState", "getMapState"):
                return self
            if name == "get":
                return iter(self.entries) if self.listed else self.value
            if name in ("put", "appendList"):
                self.entries = args[0] if name == "put" else self.entries + args[0]
            elif name == "update":
                self.value = args[0]
            elif name == "clear":
                self.entries = []
            elif name == "registerTimer":
                self.timers.add(args[0])

        return call


def test_calls_follow_triggers_and_not_events(spark):
    # 2,000 events in as many minutes, in one trigger and one firing: a call or more for each event took hours at millions.
    processor, waiting, history, timers = H.OrderedHistoryProcessor(), CountedState(), CountedState(), Timers()
    waiting.listed, history.listed = True, False
    history.getListState = lambda *a: waiting
    processor.init(history)
    event = Row("micros", "event_id", "op", "heap_bytes")
    timers.watermark = 0
    list(processor.handleInputRows((7,), iter([event(i * 60_000_000, i, "record", 1) for i in range(2000)]), timers))
    timers.watermark = 1990 * 60_000
    out = list(processor.handleExpiredTimer((7,), timers, None))
    assert [r["event_id"] for r in out] == list(range(1990)) and out[-1]["undo_depth"] == 100
    assert waiting.calls + history.calls < 20 and history.timers == {60_000, 1991 * 60_000}
