"""Undo history per document: one step function, run over sorted batches or keyed stream state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import keyed_state
from .windows import LATE

MAX_DEPTH = 100
MAX_BYTES = 256 << 20

OUTPUT = "doc_id long, event_id long, can_undo boolean, can_redo boolean, state_id long, dirty boolean, undo_depth long"
_ENTRY = "array<struct<back:bigint,bytes:bigint>>"
_STATE = f"current bigint, next bigint, saved bigint, undo {_ENTRY}, redo {_ENTRY}"


class History:
    """Bounded: at most a hundred undo entries, so a document's state never grows with its events."""

    def __init__(self, current=0, next=1, saved=0, undo=(), redo=()):
        self.current, self.next, self.saved = current, next, saved
        self.undo, self.redo = [tuple(e) for e in undo], [tuple(e) for e in redo]

    def step(self, op: str, heap_bytes: int) -> None:
        if op == "record":
            self.undo.append((self.current, heap_bytes))
            self.current, self.next = self.next, self.next + 1
            self.redo.clear()
            self._evict()
        elif op == "undo" and self.undo:
            back, size = self.undo.pop()
            self.redo.append((self.current, size))
            self.current = back
        elif op == "redo" and self.redo:
            back, size = self.redo.pop()
            self.undo.append((self.current, size))
            self.current = back
        elif op == "save":
            self.saved = self.current

    def _evict(self) -> None:
        while len(self.undo) > MAX_DEPTH:
            self.undo.pop(0)
        held = sum(b for _, b in self.undo) + sum(b for _, b in self.redo)
        while len(self.undo) > 1 and held > MAX_BYTES:
            held -= self.undo.pop(0)[1]

    def row(self) -> tuple:
        return bool(self.undo), bool(self.redo), self.current, self.current != self.saved, len(self.undo)

    def walked(self, op: str, heap_bytes: int) -> tuple:
        self.step(op, heap_bytes)
        return self.row()

    def apply(self, pdf: pd.DataFrame) -> list[tuple]:
        rows = zip(pdf["doc_id"], pdf["event_id"], pdf["op"], pdf["heap_bytes"])
        return [(doc, event, *self.walked(op, int(size))) for doc, event, op, size in rows]


_COLUMNS = ["doc_id", "event_id", "can_undo", "can_redo", "state_id", "dirty", "undo_depth"]


def edit_history(events: DataFrame) -> DataFrame:
    """Every event with the history after it.

    Events are sorted by Spark (spilling to disk) and walked as they arrive: a task holds one
    Arrow batch and one bounded history, however many events a document has.
    """
    placed = events.select("doc_id", "event_id", "ts", "op", "heap_bytes").repartition("doc_id").sortWithinPartitions("doc_id", "ts", "event_id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, history = None, History()
        for pdf in batches:
            out: list[tuple] = []
            for doc, part in pdf.groupby("doc_id", sort=False):
                if doc != key:
                    key, history = doc, History()
                out += history.apply(part)
            yield pd.DataFrame(out, columns=_COLUMNS)

    return placed.mapInPandas(walk, OUTPUT)


class HistoryProcessor(StatefulProcessor):
    """The same steps over a stream; a trigger's events are put in time order first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("history", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        h = History(*self.state.get()) if self.state.exists() else History()
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = pd.DataFrame(h.apply(pdf), columns=_COLUMNS)
        self.state.update((h.current, h.next, h.saved, h.undo, h.redo))
        yield out

    def close(self) -> None:
        pass


def edit_history_stream(events: DataFrame) -> DataFrame:
    """Keyed streaming state. Bound a trigger with the source's ``maxFilesPerTrigger`` or
    ``maxBytesPerTrigger``: its events of one document are sorted together.
    """
    keyed_state(events.sparkSession)
    cols = events.select("doc_id", "event_id", "ts", "op", "heap_bytes")
    return cols.groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=HistoryProcessor(), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )


#: Event time that is held back and put in order together.
SLICE_MS = 60_000
#: Waiting events that are one entry of the state.
EVENTS_AT_ONCE = 4096
_ROW = Row(*_COLUMNS)
_WAITING = "ts array<bigint>, event array<bigint>, op array<string>, bytes array<bigint>"


def _slice_end(micros: int) -> int:
    """The end, in milliseconds, of the slice that an event lies in."""
    return (micros // (SLICE_MS * 1000) + 1) * SLICE_MS


class OrderedHistoryProcessor(StatefulProcessor):
    """History in event time: events wait until the watermark has passed the minute they lie in, and are then walked in order.

    State of a document: its bounded history and its waiting events, some thousands an entry, with a timer for the first minute among them. What a
    trigger brings is appended unread, and one timer walks all that is due, so the calls of a document follow the triggers and not its events. An event
    of a minute that was walked already is late and dropped, in whichever trigger it comes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("history", _STATE)
        self.waiting = handle.getListState("waiting", _WAITING)

    def _entries(self, events: list[tuple]) -> list[tuple]:
        """Entries of the state, after a timer for the first of their minutes."""
        self.handle.registerTimer(_slice_end(min(e[0] for e in events)))
        return [tuple(map(list, zip(*events[at : at + EVENTS_AT_ONCE]))) for at in range(0, len(events), EVENTS_AT_ONCE)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        events = [(r.micros, r.event_id, r.op, r.heap_bytes) for r in rows if _slice_end(r.micros) > passed]
        if events:
            self.waiting.appendList(self._entries(events))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        due, rest = [], []
        for entry in self.waiting.get():
            for event in zip(*entry):
                (due if _slice_end(event[0]) <= passed else rest).append(event)
        if due:
            held = self.state.get()
            history = History(*held) if held is not None else History()
            for _, event, op, size in sorted(due):
                yield _ROW(key[0], event, *history.walked(op, size))
            self.state.update((history.current, history.next, history.saved, history.undo, history.redo))
            if rest:
                self.waiting.put(self._entries(rest))
            else:
                self.waiting.clear()

    def close(self) -> None:
        pass


def edit_history_event_time(events: DataFrame, late: str = LATE) -> DataFrame:
    """The history after each event, in event time: the same rows in any order over any number of triggers give what :func:`edit_history` gives.

    A minute's events come out once the watermark, ``late`` behind the latest event, has passed that minute; what arrives for it later is dropped.
    """
    keyed_state(events.sparkSession)
    cols = events.select("doc_id", "event_id", "ts", F.unix_micros("ts").alias("micros"), "op", "heap_bytes").withWatermark("ts", late)
    return cols.groupBy("doc_id").transformWithState(
        statefulProcessor=OrderedHistoryProcessor(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
    )
