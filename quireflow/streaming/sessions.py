"""Open documents as keyed stream state that shrinks, and a keyed sink that takes changed rows only."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import checkpoint_dir, keyed_state
from .windows import LATE

CHANGES = "doc_id long, since_us long, deleted boolean"


class OpenProcessor(StatefulProcessor):
    """The latest event of a document. A closed one is kept only until the watermark has passed its time: what is older is dropped from then on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "ts bigint, event_id bigint, opened boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.latest.get()) if self.latest.exists() else None
        latest, passed = before, timerValues.getCurrentWatermarkInMs() * 1000
        for pdf in rows:
            micros = pdf["ts"].astype("datetime64[us]").astype("int64")
            # The engine drops rows behind the watermark of the trigger before; these are behind the present one.
            timely = [(int(t), int(e), k == "opened") for t, e, k in zip(micros, pdf["event_id"], pdf["kind"]) if t > passed]
            latest = max([*timely, latest] if latest else timely, default=None)
        if latest != before:
            self.latest.update(latest)
            if not latest[2]:
                self.handle.registerTimer(-(-latest[0] // 1000))
            if latest[2] or (before is not None and before[2]):
                yield pd.DataFrame({"doc_id": [key[0]], "since_us": [latest[0]], "deleted": [not latest[2]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.latest.exists():
            ts, _, opened = self.latest.get()
            if not opened and -(-ts // 1000) <= timerValues.getCurrentWatermarkInMs():
                self.latest.clear()
        yield from ()

    def close(self) -> None:
        pass


def open_document_changes(doc_events: DataFrame, late: str = LATE) -> DataFrame:
    """``(doc_id, since, deleted)`` whenever a document opens, opens anew or closes; closing twice changes nothing.

    Events may come in any order within ``late``. State holds the open documents and those closed within ``late``.
    """
    keyed_state(doc_events.sparkSession)
    cols = doc_events.select("doc_id", "ts", "event_id", "kind").withWatermark("ts", late)
    changes = cols.groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=OpenProcessor(), outputStructType=CHANGES, outputMode="Update", timeMode="EventTime"
    )
    return changes.select("doc_id", F.timestamp_micros("since_us").alias("since"), "deleted")


def upsert(changes: DataFrame, path: str, checkpoint: str | None = None, once: bool = False):
    """Start a query that adds each trigger's changed rows to the keyed table at ``path``; a repeated trigger replaces its own rows."""

    def each(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = changes.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint or f"{path}_checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_upserted(spark: SparkSession, path: str, key: list[str], schema: str, deleted: str | None = None) -> DataFrame:
    """The keyed table as it stands: of each key the row of its last trigger, without deleted ones.

    Rows of a key are combined before the shuffle, so a key that changed in every trigger is one row per task.
    """
    rows = spark.read.schema(f"{schema}, batch long").parquet(path)
    values = [c for c in rows.columns if c not in key and c != "batch"]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*key, "_v.*")
    return last.where(~F.col(deleted)).drop(deleted) if deleted else last


def compact(spark: SparkSession, path: str, to: str, key: list[str], schema: str, deleted: str | None = None) -> None:
    """Write the table as it stands to ``to`` as one trigger's rows, to go on from there."""
    rows = read_upserted(spark, path, key, schema, deleted)
    (rows.withColumn(deleted, F.lit(False)) if deleted else rows).write.parquet(f"{to}/batch=-1")


def drain_upserted(changes: DataFrame, key: list[str], deleted: str | None = None) -> DataFrame:
    """Run a stream of changes over what is there now and return the keyed table."""
    spark = changes.sparkSession
    base = f"{checkpoint_dir(spark)}/upserts_{uuid.uuid4().hex}"
    schema = ", ".join(f"`{c}` {t}" for c, t in changes.dtypes)
    upsert(changes, f"{base}/table", f"{base}/state", once=True).awaitTermination()
    return read_upserted(spark, f"{base}/table", key, schema, deleted)
