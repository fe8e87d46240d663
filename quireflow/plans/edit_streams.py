"""Edit history, autosave, sessions, folders and batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import search as S
from ..operators.reports import recovery_list
from ..session import checkpoint_dir
from ..streaming import history as H
from ..streaming import jobs as J
from ..streaming import sessions as N
from ..streaming import windows as W
from .registry import query
from .text_search import ALL
from .views import SQL_VIEWS

_TS = "%Y-%m-%d %H:%M:%S.%f"
_stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")

_MAX = 256 << 20
# The stacks as lists, one event per recursion step; eviction keeps the longest allowed tail.
_TAIL = "list_filter(range(0, len({u})), lambda i: len({u}) - i <= 100 AND (len({u}) - i <= 1 OR list_sum([e.b FOR e IN {u}[i + 1:]]) <= {m}))[1]"
SQL_VIEWS["history"] = (("edit_events",), f"""
    WITH RECURSIVE e AS (SELECT doc_id, event_id, CASE op WHEN 'soft' THEN 'record' ELSE op END AS op, heap_bytes, row_number() OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS n FROM edit_events),
    h AS (
      SELECT doc_id, 0::BIGINT AS n, 0::BIGINT AS event_id, 0::BIGINT AS cur, 1::BIGINT AS nxt, 0::BIGINT AS saved, []::STRUCT(s BIGINT, b BIGINT)[] AS u, []::STRUCT(s BIGINT, b BIGINT)[] AS r FROM (SELECT DISTINCT doc_id FROM e)
      UNION ALL
      SELECT doc_id, n, event_id, CASE WHEN op = 'record' THEN nxt WHEN op = 'undo' AND len(u) > 0 THEN u[-1].s WHEN op = 'redo' AND len(r) > 0 THEN r[-1].s ELSE cur END,
        CASE WHEN op = 'record' THEN nxt + 1 ELSE nxt END, CASE WHEN op = 'save' THEN cur ELSE saved END,
        CASE WHEN op = 'record' THEN pushed[{_TAIL.format(u="pushed", m=_MAX)} + 1:] WHEN op = 'undo' AND len(u) > 0 THEN u[:-2] WHEN op = 'redo' AND len(r) > 0 THEN list_append(u, {{'s': cur, 'b': r[-1].b}}) ELSE u END,
        CASE WHEN op = 'record' THEN [] WHEN op = 'undo' AND len(u) > 0 THEN list_append(r, {{'s': cur, 'b': u[-1].b}}) WHEN op = 'redo' AND len(r) > 0 THEN r[:-2] ELSE r END
      FROM (SELECT h.doc_id, e.n, e.event_id, e.op, h.cur, h.nxt, h.saved, h.u, h.r, list_append(h.u, {{'s': h.cur, 'b': e.heap_bytes}}) AS pushed FROM h JOIN e ON e.doc_id = h.doc_id AND e.n = h.n + 1))
    SELECT doc_id, event_id, len(u) > 0 AS can_undo, len(r) > 0 AS can_redo, cur AS state_id, cur <> saved AS dirty, CAST(len(u) AS BIGINT) AS undo_depth FROM h WHERE n > 0""")


def _events(v, source=None):
    return v.edit_events(source).withColumn("op", F.when(F.col("op") == "soft", "record").otherwise(F.col("op")))


@query("edit_history", "M1 M2", "SELECT * FROM history", "history")
def edit_history(v):
    return H.edit_history(_events(v))


@query("edit_history_stream", "M1 M2", "SELECT * FROM history", "history")
def edit_history_stream(v):
    return J.drain(H.edit_history_stream(_events(v, v.stream("events"))))


@query("edit_history_event_time", "M1 M2", """
    SELECT h.* FROM history h JOIN edit_events e USING (doc_id, event_id)
    WHERE (epoch_us(e.ts) // 60000000 + 1) * 60000 <= (SELECT epoch_ms(max(ts)) - 600000 FROM edit_events)""", "edit_events history")  # fmt: skip
def edit_history_event_time(v):
    # Whole minutes that lie ten minutes before the last event.
    return J.drain(H.edit_history_event_time(_events(v, v.stream("events"))))


_EVERY = 6 * 3600


@query("autosave_ticks", "M3", f"""
    SELECT doc_id, strftime(epoch_ms(k * {_EVERY * 1000}), '{_TS}') AS tick, event_id FROM (
      SELECT doc_id, event_id, unnest(range(epoch_us(ts) // {_EVERY * 1_000_000} + 1, epoch_us(coalesce(following, (SELECT max(ts) FROM edit_events))) // {_EVERY * 1_000_000} + 1)) AS k FROM (
        SELECT h.doc_id, h.event_id, h.dirty, e.ts, lead(e.ts) OVER (PARTITION BY h.doc_id ORDER BY e.ts, h.event_id) AS following FROM history h JOIN edit_events e USING (doc_id, event_id)) WHERE dirty)""", "edit_events history")
def autosave_ticks(v):
    e = _events(v)
    return W.autosave_ticks(e, H.edit_history(e), _EVERY).withColumn("tick", _stamp("tick"))


SQL_VIEWS["sessions"] = (("edit_events",), f"""
    SELECT doc_id, strftime(min(ts), '{_TS}') AS started, strftime(max(ts) + INTERVAL 4 HOUR, '{_TS}') AS settled, arg_max(event_id, ts) AS event_id, count(*) AS changes FROM (
      SELECT *, sum(CASE WHEN ts >= prev + INTERVAL 4 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS k FROM (
        SELECT *, lag(ts) OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS prev FROM edit_events)) GROUP BY doc_id, k""")


def _settled(df):
    return df.withColumn("started", _stamp("started")).withColumn("settled", _stamp("settled"))


@query("debounce", "M4", "SELECT * FROM sessions", "sessions")
def debounce(v):
    return _settled(W.debounce(v.edit_events(), "4 hours"))


@query("debounce_stream", "M4", f"""
    SELECT * FROM sessions WHERE settled <= (SELECT strftime(max(ts) - INTERVAL 10 MINUTE, '{_TS}') FROM edit_events)""", "edit_events sessions")
def debounce_stream(v):
    # Append mode emits a session once the watermark passes its end.
    return _settled(J.drain(W.debounce(v.edit_events(v.stream("events")), "4 hours")))


SQL_VIEWS["open_docs"] = ((), f"""
    SELECT user_id AS doc_id, strftime(max(ts), '{_TS}') AS since FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY user_id HAVING arg_max(event_type, (ts, event_id)) = 'signup'""")


def _doc_events(v, source):
    e = source.filter(F.col("event_type").isin("signup", "purchase"))
    return e.select(F.col("user_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.when(F.col("event_type") == "signup", "opened").otherwise("closed").alias("kind"))


@query("open_documents", "M5", "SELECT * FROM open_docs", "open_docs")
def open_documents(v):
    return W.open_documents(_doc_events(v, v.table("events"))).withColumn("since", _stamp("since"))


@query("open_documents_stream", "M5", "SELECT * FROM open_docs", "open_docs")
def open_documents_stream(v):
    changes = N.open_document_changes(_doc_events(v, v.stream("events")))
    return N.drain_upserted(changes, ["doc_id"], "deleted").withColumn("since", _stamp("since"))


@query("watch_folder", "M6", "SELECT doc_id, count(*) AS hits FROM hit_list GROUP BY doc_id", "hit_list")
def watch_folder(v):
    out = f"{checkpoint_dir(v.spark)}/watch_{uuid.uuid4().hex}"
    schema = v.table("documents").schema
    find = lambda df: S.explode_hits(S.find_patterns(df, ALL), ["doc_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))
    J.watch_folder(v.spark, v.files_of("documents"), out, schema, find, once=True).awaitTermination()
    return v.spark.read.parquet(out).select("doc_id", "hits")


@query("batch_outcomes", "M7", """
    SELECT doc_id, CASE WHEN lang = 'fr' THEN 'redact' WHEN n > 10 AND lang <> 'fr' THEN 'split' END AS failed_step, CASE WHEN lang = 'fr' THEN 'language not supported' WHEN n > 10 THEN 'too many lines' END AS error,
      CASE WHEN lang = 'fr' OR n > 10 THEN 'failed' ELSE 'done' END AS status, CASE WHEN lang <> 'fr' THEN removed END AS removed, CASE WHEN lang <> 'fr' AND n <= 10 THEN n END AS parts
    FROM (SELECT d.doc_id, lang, len(string_split(text, chr(10)))::BIGINT AS n, coalesce(h.removed, 0)::BIGINT AS removed FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS removed FROM hit_list GROUP BY 1) h USING (doc_id))""", "hit_list")
def batch_outcomes(v):
    lines = F.size(F.split("text", "\n", -1))
    steps = [
        J.Step("redact", lambda df: S.redact_text(S.find_patterns(df, ALL)).drop("hits"), lambda: F.when(F.col("lang") == "fr", F.lit("language not supported"))),
        J.Step("split", lambda df: df.withColumn("parts", lines.cast("long")), lambda: F.when(lines > 10, F.lit("too many lines"))),
    ]
    return J.batch(v.table("documents", "doc_id", "text", "lang"), steps).select("doc_id", "failed_step", "error", "status", "removed", "parts")


SQL_VIEWS["hit_windows"] = (("hit_list",), f"""
    SELECT strftime(w, '{_TS}') AS from_ts, kind, count(*) AS hits FROM (
      SELECT kind, unnest([time_bucket(INTERVAL 5 MINUTE, ts), time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE]) AS w
      FROM (SELECT kind, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * doc_id AS ts FROM hit_list)) GROUP BY ALL""")


def _timed_hits(v, documents):
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    return S.explode_hits(S.find_patterns(documents.withColumn("ts", ts), ALL), ["doc_id", "ts"])


@query("pattern_windows", "M8", "SELECT * FROM hit_windows", "hit_windows")
def pattern_windows(v):
    return W.pattern_counts(_timed_hits(v, v.table("documents", "doc_id", "text"))).withColumn("from_ts", _stamp("from_ts"))


@query("pattern_windows_stream", "M8", "SELECT * FROM hit_windows", "hit_windows")
def pattern_windows_stream(v):
    # A trigger writes the windows it changed; those the watermark has passed leave the state.
    counts = W.pattern_counts(_timed_hits(v, v.stream("documents")))
    return N.drain_upserted(counts, ["from_ts", "kind"]).withColumn("from_ts", _stamp("from_ts"))


@query("edit_epochs", "W15", """
    SELECT doc_id, event_id, CAST(sum(CASE WHEN op <> 'save' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS epoch, CAST(sum(CASE WHEN op <> 'soft' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS bake, op = 'soft' AS pending
    FROM edit_events WINDOW w AS (PARTITION BY doc_id ORDER BY ts, event_id)""", "edit_events")
def edit_epochs(v):
    return W.edit_epochs(v.edit_events()).select("doc_id", "event_id", "epoch", "bake", "pending")


@query("recents", "O1", """
    SELECT user_id, path, position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, i DESC) AS position FROM (
      SELECT user_id, 'doc' || json_extract(props, '$.k') AS path, max(ts) AS t, arg_max(event_id, ts) AS i FROM events GROUP BY ALL)) WHERE position <= 20""")
def recents(v):
    e = v.table("events", "user_id", "ts", "event_id", "props")
    return W.recents(e.withColumn("path", F.concat(F.lit("doc"), F.get_json_object("props", "$.k"))))


@query("recovery_list", "J6", f"""
    SELECT doc_id, arg_max('/docs/' || event_id || '.pdf', ts) AS original_path, strftime(max(ts), '{_TS}') AS saved_at FROM edit_events WHERE op = 'save' AND doc_id % 4 <> 0 GROUP BY doc_id""", "edit_events")
def recovery_list_query(v):
    e = v.edit_events()
    path = F.concat(F.lit("/docs/"), "event_id", F.lit(".pdf"))
    saves = e.filter("op = 'save'").select("doc_id", path.alias("original_path"), F.col("ts").alias("saved_at"))
    return recovery_list(saves, e.filter("doc_id % 4 <> 0").select("doc_id")).withColumn("saved_at", _stamp("saved_at"))
