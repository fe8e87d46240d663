"""All matches of a regular expression with their character positions, inside one row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


_BLOCK = 256
SPAN = "struct<start:int,end:int,text:string>"

# Two Unicode non-characters mark the matches; both are illegal in interchange text, and a
# text that holds one all the same has it replaced by U+FFFD (same length) for the search.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"

# \b written out: its meaning for non-ASCII letters differs between Java releases.
ASCII_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


_ADD = "(a, x) -> concat(a, array(element_at(a, -1) + length(x)))"
_SUMS = f"aggregate({{x}}, array(0), {_ADD})"

# Running lengths of the pieces ``p``, starting with 0. Appending copies the array, so they are
# summed in blocks: local sums, block offsets, then both together; the copying stays bounded.
_ENDS = (
    f"transform(array(transform(sequence(0, CAST((size(p) - 1) div {_BLOCK} AS INT)), k -> {_SUMS.format(x=f'slice(p, k * {_BLOCK} + 1, {_BLOCK})')})), b -> "
    "transform(array(aggregate(b, array(0), (a, x) -> concat(a, array(element_at(a, -1) + element_at(x, -1))))), o -> "
    f"concat(array(0), flatten(transform(b, (x, i) -> transform(slice(x, 2, {_BLOCK}), y -> y + o[i])))))[0])[0]"
)


def spans_sql(text: str, pattern: str) -> str:
    """SQL for :func:`spans`; ``text`` is a column name or SQL expression.

    The expression is written as SQL because building lambdas one call at a time from Python
    costs more than running them on a small table.
    """
    marked = f"regexp_replace(translate({text}, '{_OPEN}{_CLOSE}', '\ufffd\ufffd'), {sql_text(f'(?:{pattern})')}, '{_OPEN}$0{_CLOSE}')"
    # Odd pieces are gaps, even ones matches; e[k] is where the k-th piece ends.
    pairs = (
        "transform(sequence(1, CAST(size(p) div 2 AS INT)), i -> "
        "named_struct('start', e[2 * i - 1], 'end', e[2 * i], 'text', p[2 * i - 1]))"
    )
    none = f"CAST(array() AS array<{SPAN}>)"
    return (
        f"transform(array(split({marked}, '[{_OPEN}{_CLOSE}]', -1)), p -> if(p IS NULL OR size(p) < 3, {none}, "
        f"transform(array({_ENDS}), e -> {pairs})[0]))[0]"
    )


def spans(text: str, pattern: str) -> Column:
    """Half-open, non-overlapping ``array<struct<start,end,text>>`` of matches, left to right."""
    return F.expr(spans_sql(text, pattern))


def literal_pattern(query: str, case_sensitive: bool = False, whole_word: bool = False) -> str:
    """The expression for a literal query; whole words use the ASCII word boundary."""
    body = re.sub(r"([.*+?^${}()|\[\]\\/-])", r"\\\1", query)
    if whole_word:
        body = f"{ASCII_BOUNDARY}{body}{ASCII_BOUNDARY}"
    return body if case_sensitive else f"(?iu){body}"
