"""Literal search, sensitive-data patterns, overlap resolution and redaction of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import each
from ..functions.spans import ASCII_BOUNDARY, SPAN, literal_pattern, spans, spans_sql, sql_text

HIT = "struct<start:int,end:int,kind:string,text:string>"

# The built-in patterns. \d and \w are Unicode here, so an accented letter next
# to a number is part of the word; a boundary next to a digit is written as a lookaround.
_U = "(?U)"
PATTERNS = {
    "ssn": _U + r"(?<!\w)\d{3}-\d{2}-\d{4}(?!\w)",
    "credit_card": _U + r"(?<!\w)\d(?:[ -]?\d){12,18}(?!\w)",
    "email": _U + ASCII_BOUNDARY + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?!\w)",
    "phone": _U + r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)|(?<!\w)\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)",
}


def search(
    df: DataFrame, query: str, text: str = "text", case_sensitive: bool = False, whole_word: bool = False
) -> DataFrame:
    """One row per match: the other columns plus ``start`` and ``end`` (characters, half-open)."""
    keep = [c for c in df.columns if c != text]
    if query == "":
        return df.select(*keep, F.lit(0).alias("start"), F.lit(0).alias("end")).filter(F.lit(False))
    pattern = literal_pattern(query, case_sensitive, whole_word)
    # The cheap count first: rows without a match never reach the position fold.
    hit = df.filter(F.regexp_like(text, F.lit(pattern)))
    found = each(hit, keep, spans(text, pattern), "s")
    return found.select(*keep, F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


def matches_per_page(df: DataFrame, query: str, keys: list[str], text: str = "text", **options) -> DataFrame:
    """Match count per row of pages; pages without a match are left out."""
    pattern = literal_pattern(query, **options)
    counted = df.select(*keys, F.regexp_count(text, F.lit(pattern)).cast("long").alias("matches"))
    return counted.filter("matches > 0")


_DIGITS = "regexp_replace(s.text, '[^0-9]', '')"
_LUHN = f"length({_DIGITS}) BETWEEN 13 AND 19 AND luhn_check({_DIGITS})"


def resolve_overlaps(hits: str) -> Column:
    """Earliest first, longest on a tie; a hit survives when it starts at or after the last kept end.

    Kept hits go to a small buffer that is moved aside when full, so appending stays cheap.
    """
    ranked = f"array_sort(transform({hits}, (h, i) -> named_struct('start', h.start, 'neg', h.start - h.end, 'ord', i, 'h', h)))"
    start = f"named_struct('last', -1, 'done', CAST(array() AS array<array<{HIT}>>), 'cur', CAST(array() AS array<{HIT}>))"
    keep = (
        "named_struct('last', r.h.end, 'done', if(size(a.cur) >= 256, concat(a.done, array(a.cur)), a.done), "
        "'cur', if(size(a.cur) >= 256, array(r.h), concat(a.cur, array(r.h))))"
    )
    fold = f"aggregate({ranked}, {start}, (a, r) -> if(r.h.start < a.last, a, {keep}), a -> flatten(concat(a.done, array(a.cur))))"
    return F.expr(f"if(size({hits}) < 2, {hits}, {fold})")


def pattern_hits(text: str, kinds: list[str], custom: list[str] | None = None) -> Column:
    """``array<struct<start,end,kind,text>>`` of every match over the whole text, kind by kind."""
    groups = []
    for kind in kinds:
        if kind not in PATTERNS:
            raise ValueError(f"unknown pattern kind: {kind}")
        found = spans_sql(text, PATTERNS[kind])
        if kind == "credit_card":
            found = f"filter({found}, s -> {_LUHN})"
        # A text without the one character every match needs is not scanned for positions.
        needs = f"contains({text}, '@')" if kind == "email" else f"regexp_like({text}, {sql_text(PATTERNS[kind])})"
        groups.append((kind, f"if({needs}, {found}, CAST(array() AS array<{SPAN}>))"))
    groups += [("custom", spans_sql(text, p)) for p in custom or []]
    label = "transform({g}, s -> named_struct('start', s.start, 'end', s.end, 'kind', '{k}', 'text', s.text))"
    return F.expr(f"concat({', '.join(label.format(g=g, k=k) for k, g in groups)})")


def check_custom(df: DataFrame, custom: list[str]) -> None:
    """Refuse a malformed custom pattern by name, before any job runs."""
    pattern_class = df.sparkSession._jvm.java.util.regex.Pattern
    for p in custom:
        try:
            pattern_class.compile(p)
        except Exception as e:  # noqa: BLE001  the gateway wraps the JVM's syntax error
            raise ValueError(f"That pattern isn't valid: {p}") from e


def find_patterns(
    df: DataFrame, kinds: list[str], custom: list[str] | None = None, text: str = "text", out: str = "hits"
) -> DataFrame:
    """Add the resolved hits of each text as an array; a null text gives an empty array."""
    check_custom(df, custom or [])
    raw = df.withColumn("_raw", pattern_hits(text, kinds, custom))
    return raw.withColumn(out, resolve_overlaps("_raw")).drop("_raw")


def explode_hits(df: DataFrame, keep: list[str], hits: str = "hits") -> DataFrame:
    e = each(df, keep, F.col(hits), "h")
    return e.select(
        *keep, F.col("h.kind").alias("kind"), F.col("h.start").cast("long").alias("start"),
        F.col("h.end").cast("long").alias("end"), F.col("h.text").alias("preview"),
    )


def unreadable_rows(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Rows that could not be searched, so a failed page never looks clean."""
    return df.filter(F.col(text).isNull()).select(
        *keep, F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("start"),
        F.lit(None).cast("long").alias("end"), F.lit(None).cast("string").alias("preview"), F.lit(True).alias("unreadable"),
    )


def confirmed_hits(hits: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Only hits a reader has confirmed; nothing is selected by default."""
    return hits.join(decisions, keys, "left").filter(F.coalesce(F.col("confirmed"), F.lit(False))).drop("confirmed")


def redacted(text: str, hits: str) -> Column:
    """The text without the hit spans (sorted, disjoint): the pieces between them, joined.

    A substring would count characters from the start of the text for each hit; the text is cut into
    characters once instead, and slices of that are joined.
    """
    before = f"coalesce(get({hits}, i - 1).end, 0)"
    pieces = (
        f"transform(array(split({text}, '')), c -> array_join(concat(flatten(transform({hits}, (h, i) -> slice(c, {before} + 1, h.start - {before}))), "
        f"slice(c, element_at({hits}, -1).end + 1, size(c))), ''))[0]"
    )
    return F.expr(f"CASE WHEN size({hits}) = 0 THEN {text} ELSE {pieces} END")


def redact_text(df: DataFrame, text: str = "text", hits: str = "hits") -> DataFrame:
    """Add ``redacted`` and ``removed`` (how many spans went)."""
    return df.withColumn("redacted", redacted(text, hits)).withColumn("removed", F.size(hits).cast("long"))


def confirm_removed(texts: DataFrame, needles: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Per key: needles that leaked, controls that vanished, and whether the check passed.

    ``needles`` has the keys, ``needle`` and ``must_survive``. Needles are joined to their own
    text only and counted before the result is shuffled.
    """
    j = needles.join(texts.select(*keys, text), keys, "left")
    there = F.coalesce(F.contains(text, F.col("needle")), F.lit(False))
    out = j.groupBy(*keys).agg(
        F.count_if(~F.col("must_survive") & there).alias("leaked"),
        F.count_if(F.col("must_survive") & ~there).alias("vanished"),
    )
    return out.withColumn("passed", (F.col("leaked") == 0) & (F.col("vanished") == 0))
