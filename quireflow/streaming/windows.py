"""Windowed and keyed views of edit and document events; each runs on batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import block_of, running

LATE = "10 minutes"


def _late(df: DataFrame, column: str = "ts") -> DataFrame:
    return df.withWatermark(column, LATE) if df.isStreaming else df


def autosave_ticks(events: DataFrame, history: DataFrame, every: int = 30) -> DataFrame:
    """A recovery copy per document at every tick of ``every`` seconds while it is dirty, up to the last event of all.

    ``history`` holds ``dirty`` after each event, as :func:`edit_history` gives it. ``event_id`` names the last event before the tick;
    a tick at the very time of an event still belongs to the state before it.
    """
    seen = events.select("doc_id", "event_id", "ts").join(history.select("doc_id", "event_id", "dirty"), ["doc_id", "event_id"])
    # The following event's time is the last one seen when the scan runs backwards, in blocks of an hour.
    backwards = [-F.unix_micros("ts"), -F.col("event_id")]
    block = F.floor(backwards[0] / F.lit(3_600_000_000))
    seen = running(seen, ["doc_id"], block, backwards, {"_next": ("last", F.col("ts"))}, inclusive=False)
    spans = seen.withColumn("_next", F.coalesce("_next", events.agg(F.max("ts")).scalar())).filter("dirty")
    tick = lambda c: F.floor(F.unix_micros(c) / F.lit(every * 1_000_000)).cast("long")
    # A tick is due after the event's time, at or before the next one's.
    first, final = tick("ts") + 1, tick("_next")
    numbers = F.when(first <= final, F.sequence(first, final))
    ticks = spans.select("doc_id", "event_id", F.explode(numbers).alias("_k"))
    return ticks.select("doc_id", F.timestamp_seconds(F.col("_k") * every).alias("tick"), "event_id")


def debounce(events: DataFrame, gap: str) -> DataFrame:
    """Once a document has been quiet for ``gap``: its last event and how many came before it.

    A stream keeps one open session per document. A batch finds the quiet spots with running values
    over blocks of an hour, so a document with most of the events is not sorted in one task.
    """
    if not events.isStreaming:
        return _quiet_spells(events, gap)
    g = _late(events).groupBy("doc_id", F.session_window("ts", gap)).agg(
        F.max(F.struct("ts", "event_id")).alias("_last"), F.count(F.lit(1)).alias("changes")
    )
    return g.select("doc_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("settled"), F.col("_last.event_id").alias("event_id"), "changes")


def _quiet_spells(events: DataFrame, gap: str) -> DataFrame:
    block, order = block_of(F.unix_seconds("ts"), 3600), [F.col("ts"), F.col("event_id")]
    slim = events.select("doc_id", "ts", "event_id")
    seen = running(slim, ["doc_id"], block, order, {"_prev": ("max", F.col("ts"))}, inclusive=False)
    starts = F.expr(f"_prev IS NULL OR ts >= _prev + INTERVAL {gap}").cast("long")
    spells = running(seen, ["doc_id"], block, order, {"_spell": ("sum", starts)})
    g = spells.groupBy("doc_id", "_spell").agg(
        F.min("ts").alias("started"), F.max(F.struct("ts", "event_id")).alias("_last"), F.count(F.lit(1)).alias("changes")
    )
    settled = F.col("_last.ts") + F.expr(f"INTERVAL {gap}")
    return g.select("doc_id", "started", settled.alias("settled"), F.col("_last.event_id").alias("event_id"), "changes")


def open_documents(doc_events: DataFrame) -> DataFrame:
    """Documents whose latest event is ``opened``; closing twice changes nothing."""
    g = doc_events.groupBy("doc_id").agg(F.max(F.struct("ts", "event_id", "kind")).alias("_l"))
    return g.filter(F.col("_l.kind") == "opened").select("doc_id", F.col("_l.ts").alias("since"))


def pattern_counts(hits: DataFrame, every: str = "10 minutes", slide: str = "5 minutes") -> DataFrame:
    """Hits per kind in sliding windows of the texts' time."""
    g = _late(hits).groupBy(F.window("ts", every, slide), "kind").agg(F.count(F.lit(1)).alias("hits"))
    return g.select(F.col("window.start").alias("from_ts"), "kind", "hits")


def edit_epochs(events: DataFrame) -> DataFrame:
    """Running epochs per document: a hard edit moves raw and bake, a soft one raw only and leaves
    a bake pending, a save bakes. A hot document is scanned in blocks of an hour.
    """
    op = F.col("op")
    hard, soft = op.isin("record", "undo", "redo"), op == "soft"
    block: Column = block_of(F.unix_seconds("ts"), 3600)
    return running(events, ["doc_id"], block, [F.col("ts"), F.col("event_id")], {
        "epoch": ("sum", F.when(hard | soft, 1).otherwise(0).cast("long")),
        "bake": ("sum", F.when(soft, 0).otherwise(1).cast("long")),
        "pending": ("last", soft),
    })


def recents(events: DataFrame, k: int = 20) -> DataFrame:
    """Each user's latest distinct paths, newest first, at most ``k``.

    A user's events become one row per path before they are ranked, and each task drops what
    cannot be among the first k.
    """
    latest = events.groupBy("user_id", "path").agg(F.max(F.struct("ts", "event_id")).alias("_l"))
    w = Window.partitionBy("user_id").orderBy(F.desc("_l"))
    ranked = latest.withColumn("position", F.row_number().over(w).cast("long")).filter(F.col("position") <= k)
    return ranked.select("user_id", "path", "position")
