"""Repair of conversations: the cheapest edits that give a well-formed order of roles, by dynamic programming over runs.

A row's symbol is the class of its role and its fault. Equal neighbouring symbols are one run ``(symbol, length)``. What a
row costs between the four states of the grammar ``(s?(ua)+)?`` is a 4 x 4 matrix under minimum and sum, inserted turns
included; a run applies the matrix of its symbol ``length`` times through cached binary powers. From the last run to the first this
gives the cost that is left in each state, and from the first to the last the ASCII-least choices of that cost are
unrolled.

Rows are range-partitioned by conversation and turn, so that a conversation of any length is cut into segments of one partition each.
A conversation inside one partition is finished there. For the others each segment is one product matrix; these few are combined, and
every segment then learns the costs behind it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import checkpointed

#: States: nothing yet, after the system turn, after a user turn, after an assistant turn. Conversations end in the first or the last.
START, SYSTEM, USER, ASSISTANT = range(4)
INF = 1 << 60
END = (0, INF, INF, 0)
#: The only turn that may be inserted, or set by a new role, in each state, and the state after it.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
CUT_SHORT = 5
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
LEGAL = {"su", "ua", "au"}
#: Bytes of text in a partition of the sorted rows; a worker holds one partition's segment at a time.
PARTITION_BYTES = 32 << 20
#: Rows unrolled at once; a longer run is halved first.
UNROLL = 64

Vector = tuple[int, int, int, int]


def _kept(role: str, state: int) -> int | None:
    """The state after a kept turn of this initial, if the grammar allows it."""
    if role == "s":
        return SYSTEM if state == START else None
    if role == "u":
        return USER if state != USER else None
    return ASSISTANT if role == "a" and state == USER else None


def _inserted(v: Vector) -> Vector:
    """Costs left if turns may be inserted first."""
    start, system, user, assistant = v
    user = min(user, COST[INSERT] + assistant)
    return min(start, COST[INSERT] + user), min(system, COST[INSERT] + user), user, min(assistant, COST[INSERT] + user)


def _choices(symbol: tuple[str, int], state: int) -> list[tuple[str, int, int]]:
    """``(edit, cost, state after it)`` of the edits that take a row."""
    role, fault = symbol
    out = [(DELETE, COST[DELETE], state)]
    if fault in (SOUND, TRUNCATED):
        more = CUT_SHORT * (fault == TRUNCATED)
        if (to := _kept(role, state)) is not None:
            out.append((KEEP, COST[KEEP] + more, to))
        out.append((REROLE, COST[REROLE] + more, NEXT[state]))
    return out


@lru_cache(maxsize=None)  # initials outside s, u and a are one class, so there are at most 16 symbols and 64 powers of each
def _power(symbol: tuple[str, int], k: int) -> tuple[Vector, ...]:
    """The matrix of ``2**k`` rows of a symbol: row i gives the cost from state i to each state, inserts before each row included."""
    if k:
        half = _power(symbol, k - 1)
        return product(half, half)
    columns = []
    for end in range(4):
        after = [min((c for _, c, to in _choices(symbol, state) if to == end), default=INF) for state in range(4)]
        columns.append(_inserted(tuple(after)))
    return tuple(zip(*columns, strict=True))


def product(a: tuple[Vector, ...], b: tuple[Vector, ...]) -> tuple[Vector, ...]:
    return tuple(tuple(min(INF, *(x + b[m][j] for m, x in enumerate(row))) for j in range(4)) for row in a)


def _apply(matrix: tuple[Vector, ...], v: Vector) -> Vector:
    a, b, c, d = v
    return tuple(min(p + a, q + b, r + c, s + d, INF) for p, q, r, s in matrix)


def before_run(symbol: tuple[str, int], length: int, after: Vector) -> Vector:
    """Costs left before a run, from those behind it."""
    k = 0
    while length:
        if length & 1:
            after = _apply(_power(symbol, k), after)
        length >>= 1
        k += 1
    return after


IDENTITY = tuple(tuple(0 if i == j else INF for j in range(4)) for i in range(4))


def run_matrix(runs: Iterable[tuple[tuple[str, int], int]]) -> tuple[Vector, ...]:
    """The product over all runs of a segment."""
    out = IDENTITY
    for symbol, length in runs:
        k = 0
        while length:
            if length & 1:
                out = product(out, _power(symbol, k))
            length >>= 1
            k += 1
    return out


def _unroll_run(symbol: tuple[str, int], length: int, state: int, after: Vector) -> tuple[str, int]:
    """The ASCII-least cheapest edits of a run from ``state``, given the costs behind it, and the state behind it."""
    if length > UNROLL:
        half = length // 2
        first, state = _unroll_run(symbol, length - half, state, before_run(symbol, half, after))
        second, state = _unroll_run(symbol, half, state, after)
        return first + second, state
    left = [after]
    for _ in range(length):
        left.append(_apply(_power(symbol, 0), left[-1]))
    out = []
    for t in range(length, 0, -1):
        here, behind, taken = left[t], left[t - 1], False
        while not taken:
            if COST[DELETE] + behind[state] == here[state]:
                out.append(DELETE)
                break
            if COST[INSERT] + here[NEXT[state]] == here[state]:
                out.append(INSERT)
                state = NEXT[state]
                continue
            for edit, cost, to in sorted(_choices(symbol, state)):
                if cost + behind[to] == here[state]:
                    out.append(edit)
                    state, taken = to, True
                    break
    return "".join(out), state


@lru_cache(maxsize=1 << 15)
def _solved(runs: tuple[tuple[tuple[str, int], int], ...], state: int, end: Vector, last: bool) -> tuple[int, str, int]:
    """``(cost left at the start, audit, state at the end)``; ``end`` are the costs behind the runs, ``last`` if nothing follows."""
    after = [_inserted(end) if last else end]
    for symbol, length in reversed(runs):
        after.append(before_run(symbol, length, after[-1]))
    cost, audit = after[-1][state], []
    for (symbol, length), behind in zip(runs, reversed(after[:-1]), strict=True):
        edits, state = _unroll_run(symbol, length, state, behind)
        audit.append(edits)
    while last and end[state]:
        audit.append(INSERT)
        state = NEXT[state]
    return cost, "".join(audit), state


def solve(runs: list[tuple[tuple[str, int], int]], state: int = START, end: Vector = END, last: bool = True) -> tuple[int, str, int]:
    """As ``_solved``; short ones are remembered."""
    return (_solved if sum(n for _, n in runs) <= UNROLL else _solved.__wrapped__)(tuple(runs), state, end, last)


def runs_of(symbols: Iterable[tuple[tuple[str, int], int]]) -> list[tuple[tuple[str, int], int]]:
    """Neighbouring ``(symbol, rows)`` of one symbol as one run; initials that the grammar lacks are one class."""
    out: list[tuple[tuple[str, int], int]] = []
    for (role, fault), n in symbols:
        symbol = (role if role in ("s", "u", "a") else "", fault)
        if out and out[-1][0] == symbol:
            out[-1] = (symbol, out[-1][1] + n)
        elif n:
            out.append((symbol, n))
    return out


def _symbols(segment: list[tuple]) -> Iterator[tuple[str, str, int, int]]:
    """``(role, text, fault, rows)`` of stored rows ``(turn, role, text, times, fault, first)``: of repeated rows, all but a first one are duplicates."""
    for _, role, text, times, fault, first in segment:
        if fault == BLANK or times == 0:
            yield role, text, fault, times
            continue
        yield role, text, fault if first else DUPLICATE, 1
        if times > 1:
            yield role, text, DUPLICATE, times - 1


def edited(segment: list[tuple], audit: str, state: int) -> Iterator[tuple[str, int | None, str, str]]:
    """``(edit, turn, role, text)`` of each edit of a segment, in order; deleted rows come as they were, inserted turns have no turn number."""
    edits = iter(audit)
    each = ((row[0], role, text) for row in segment for role, text, _, n in _symbols([row]) for _ in range(n))
    for turn, role, text in each:
        while (edit := next(edits)) == INSERT:
            state = NEXT[state]
            yield INSERT, None, NAMES[state], ""
        if edit == REROLE:
            state = NEXT[state]
            yield REROLE, turn, NAMES[state], text
        elif edit == KEEP:
            state = _kept(role[:1], state)
            yield KEEP, turn, role, text
        else:
            yield DELETE, turn, role, text
    for edit in edits:
        state = NEXT[state]
        yield edit, None, NAMES[state], ""


def _figures(segment: list[tuple]) -> dict:
    """Counts of a segment, without what happens at its borders."""
    n = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0, SOUND: 0}
    illegal, initial, first_initial, rows = 0, None, None, 0
    for role, _, fault, times in _symbols(segment):
        n[fault] += times
        if not times:
            continue
        at = role[:1]
        rows += times
        illegal += (times - 1) * (at + at not in LEGAL) + (initial is not None and initial + at not in LEGAL)
        initial, first_initial = at, at if first_initial is None else first_initial
    turns = [turn for turn, _ in groupby(row[0] for row in segment if row[0] is not None and row[3])]
    return {"rows": rows, "blank": n[BLANK], "duplicate": n[DUPLICATE], "truncated": n[TRUNCATED], "illegal": illegal, "first_initial": first_initial,
            "last_initial": initial, "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(turns)}


class Digest:
    """SHA-256 of ``role:text`` lines that come one after another."""

    def __init__(self):
        self.sha, self.lines = hashlib.sha256(), 0

    def add(self, edits: Iterable[tuple[str, int | None, str, str]]) -> None:
        for edit, _, role, text in edits:
            if edit != DELETE:
                self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
                self.lines += 1


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
SUMMARY = "conv_id {id}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
TURNS = "conv_id {id}, position long, edit string, turn long, role string, text string"
ROWS = "array<struct<turn: long, role: string, text: string, times: long, fault: int, first: boolean>>"
FIGURES = ("struct<part: int, rows: long, blank: long, duplicate: long, truncated: long, illegal: long, first_initial: string, last_initial: string,"
           " low: long, high: long, turns: long, matrix: array<array<long>>>")  # fmt: skip


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return high - low + 1 - turns if low is not None else 0


def _finished(conv_id, f: dict, segment: list[tuple], want_turns: bool) -> Iterator[dict]:
    """Result rows of a conversation that lies in one segment."""
    cost, audit, _ = solve(runs_of(((r[:1], fault), n) for r, _, fault, n in _symbols(segment)))
    edits = edited(segment, audit, START)
    if want_turns:
        for position, (edit, turn, role, text) in enumerate(edits):
            yield {"conv_id": conv_id, "position": position, "edit": edit, "turn": turn, "role": role, "text": text}
        return
    digest = Digest()
    digest.add(edits)
    yield {"conv_id": conv_id, "gaps": _gaps(f["low"], f["high"], f["turns"]), "cost": cost, "audit": audit,
           "repaired_sha256": digest.sha.hexdigest()} | {k: f[k] for k in ("blank", "duplicate", "truncated", "illegal")}


def damage(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, times)``: rows damaged by ``crc32("conv_id:turn") % 20``, nulls in text form being one space.

    0 drops the row (it stays with times 0, to name its conversation), 1 empties the text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 doubles
    the row (times 2) and 4 sets the role to user.
    """
    words = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(words[0], F.lit(":"), words[1]).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(words[3], "[.!?]", "")).otherwise(words[3])
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(words[2]).alias("role"), text.alias("text"), times.cast("long").alias("times"))


def with_faults(rows: DataFrame) -> DataFrame:
    """One row per different ``(conv_id, turn, role, text)`` with ``times``, its ``fault`` and whether it is the ``first`` of its role and text.

    Repeats are combined before the shuffle. Role and text count as seen if an earlier turn has them (SHA-256 of the text stands for
    it); only groups of several turns are joined, so the joined side is small unless most texts repeat.
    """
    dropped = F.col("times") == 0
    blank_out = lambda c: F.when(~dropped, F.col(c))
    rows = rows.select("conv_id", blank_out("turn").cast("long").alias("turn"), *[F.coalesce(blank_out(c), F.lit("")).alias(c) for c in ("role", "text")], "times")
    units = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", BLANK).when(~last.rlike("[.!?]"), TRUNCATED).otherwise(SOUND)
    key = F.struct("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    # A null turn comes first: as a struct (false, null) it is less than any (true, turn).
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    groups = rows.where((F.col("times") > 0) & (last != "")).groupBy(key.alias("group")).agg(F.min(place).alias("least"), F.max(place).alias("most"))
    groups = groups.where("least < most").select("group", F.col("least").alias("least"))
    units = units.withColumn("fault", fault).withColumn("key", key)
    marked = units.join(groups, F.col("key") == F.col("group"), "left")
    first = F.coalesce(place == F.col("least"), F.lit(True))
    return marked.select("conv_id", "turn", "role", "text", "times", "fault", first.alias("first"))


def repair(rows: DataFrame, turns: bool = False, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The cheapest repair of each conversation of ``(conv_id, turn, role, text, times)``.

    By default one row per conversation: ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``. With ``turns``
    one row per edit: ``(conv_id, position, edit, turn, role, text)``, in which K and R rows and the inserted I rows are the repaired
    conversation and D rows what was taken out; inserted turns have a null turn.

    Rows of one conversation are ordered by turn, null turns first, then by role and text (bytes), so that ties have one result; ``times`` counts
    equal rows. Rows of times 0 only name their conversation: one with no other rows has zeros, an empty audit and the digest of
    nothing. Conversations with a null id are one conversation. A null role or text counts as empty. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    id_type = dict(rows.dtypes)["conv_id"]
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // partition_bytes))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = with_faults(rows).repartitionByRange(parts, *order[:3], F.substring("text", 1, 64)).sortWithinPartitions(*order)
    one = (SUMMARY if not turns else TURNS).format(id=id_type)
    parted = f"{one}, figures {FIGURES}, rows_of {ROWS}"
    # Finished conversations and the segments at the borders of partitions, with their rows: read more than once, so written first.
    found = checkpointed(placed.select("conv_id", "turn", "role", "text", "times", "fault", "first").mapInArrow(_segments(_arrow(spark, parted), turns), parted))
    names = [f.strip().split()[0] for f in one.split(",")]
    done = found.where("figures IS NULL").select(*names)
    return done.unionByName(_joined(found.where("figures IS NOT NULL"), one, turns).select(*names))


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _batches(rows: Iterable[dict], schema: pa.Schema, size_of=lambda r: 1, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    group, size = [], 0
    for row in rows:
        group.append(row)
        size += size_of(row)
        if size > most or len(group) >= 4096:
            yield pa.RecordBatch.from_pylist(group, schema)
            group, size = [], 0
    if group:
        yield pa.RecordBatch.from_pylist(group, schema)


def _segments(schema: pa.Schema, turns: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def stored() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    columns = [c.to_pylist() for c in batch.slice(at, 512).columns]
                    yield from zip(*columns, strict=True)

        def edge(conv_id, segment: list[tuple]) -> dict:
            matrix = run_matrix(runs_of(((r[:1], fault), n) for r, _, fault, n in _symbols(segment)))
            fields = ("turn", "role", "text", "times", "fault", "first")
            figures = {"part": part, "matrix": matrix} | _figures(segment)
            return {"conv_id": conv_id, "figures": figures, "rows_of": [dict(zip(fields, row, strict=True)) for row in segment]}

        def results() -> Iterator[dict]:
            held, first = None, True
            for conv_id, group in groupby(stored(), key=itemgetter(0)):
                if held is not None:
                    yield from [edge(*held)] if first else _finished(held[0], _figures(held[1]), held[1], turns)
                    first = False
                held = (conv_id, [row[1:] for row in group])
            if held is not None:
                yield edge(*held)

        yield from _batches(results(), schema, lambda r: sum(len(x["text"]) for x in r.get("rows_of") or []) + len(r.get("text") or ""))

    return run


def _joined(edges: DataFrame, one: str, turns: bool) -> DataFrame:
    """Conversations whose segments lie at borders of partitions: the costs behind each segment first, then edits and digest in order.

    Per conversation there is one small row per partition it spans. Their rows stream through one task in order, as a SHA-256
    is sequential; a worker holds one segment at a time.
    """
    key = F.struct("conv_id").alias("key")
    by_conv = edges.groupBy(key).agg(F.sort_array(F.collect_list("figures")).alias("segments"))
    # The figures go with the first segment only; the rows of all follow in order.
    heads = by_conv.select("key", F.lit(-1).alias("part"), F.lit(None).cast(ROWS).alias("rows_of"), "segments")
    tails = edges.select(key, F.col("figures.part"), "rows_of", F.lit(None).cast(heads.schema["segments"].dataType).alias("segments"))
    stream = heads.unionByName(tails).repartition("key").sortWithinPartitions("key", "part")

    schema = _arrow(edges.sparkSession, one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_whole(batches, turns), schema, lambda r: len(r.get("text") or "") + len(r.get("audit") or ""))

    return stream.mapInArrow(run, one)


def _whole(batches: Iterator[pa.RecordBatch], turns: bool) -> Iterator[dict]:
    """Results of conversations that come as one row of figures and then one row per segment."""

    def stored():
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.slice(i, 1).to_pylist()[0]

    for _, group in groupby(stored(), key=itemgetter("key")):
        head = next(group)
        segments = head["segments"]
        behind = [END]
        closed = _inserted(END)
        for k, s in enumerate(reversed(segments)):
            behind.append(_apply(tuple(map(tuple, s["matrix"])), closed if k == 0 else behind[-1]))
        behind.reverse()  # behind[k + 1] are the costs left after segment k
        total = {k: sum(s[k] for s in segments) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
        known = [s for s in segments if s["low"] is not None]
        total["turns"] -= sum(a["high"] == b["low"] for a, b in zip(known, known[1:], strict=False))
        spoken = [s for s in segments if s["rows"]]
        total["illegal"] += sum(a["last_initial"] + b["first_initial"] not in LEGAL for a, b in zip(spoken, spoken[1:], strict=False))
        state, audits, digest, position = START, [], Digest(), 0
        conv_id = head["key"]["conv_id"]
        for k, row in enumerate(group):
            segment = [tuple(x.values()) for x in row["rows_of"]]
            runs = runs_of(((r[:1], fault), n) for r, _, fault, n in _symbols(segment))
            _, audit, after = solve(runs, state, behind[k + 1], k == len(segments) - 1)
            edits = edited(segment, audit, state)
            if turns:
                for edit, turn, role, text in edits:
                    yield {"conv_id": conv_id, "position": position, "edit": edit, "turn": turn, "role": role, "text": text}
                    position += 1
            else:
                digest.add(edits)
                audits.append(audit)
            state = after
        if not turns:
            low, high = (known[0]["low"], known[-1]["high"]) if known else (None, None)
            yield {"conv_id": conv_id, "gaps": _gaps(low, high, total["turns"]), "cost": behind[0][START], "audit": "".join(audits),
                   "repaired_sha256": digest.sha.hexdigest()} | {k: total[k] for k in ("blank", "duplicate", "truncated", "illegal")}
