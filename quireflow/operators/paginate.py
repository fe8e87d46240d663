"""Monospace pagination of plain text: sheets, wrapped lines, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folds import each
from ..functions.spans import sql_text

# Scripts in which a line may break between any two characters.
_ANYWHERE = (
    r"[\x{1100}-\x{11FF}\x{2E80}-\x{2FDF}\x{3000}-\x{30FF}\x{3100}-\x{31FF}\x{3400}-\x{4DBF}"
    r"\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{2FA1F}]"
)
_TAB_STOP = 8


def clean_line_sql(line: str) -> str:
    """Tabs to eight-column stops; every other control character dropped."""
    bare = f"regexp_replace({line}, {sql_text(r'[\p{Cc}&&[^\t]]')}, '')"
    expand = (
        "transform(array(split(bare, '\t', -1)), s -> aggregate(slice(s, 2, size(s)), s[0], "
        f"(a, x) -> concat(a, repeat(' ', {_TAB_STOP} - length(a) % {_TAB_STOP}), x)))[0]"
    )
    return f"transform(array({bare}), bare -> if(contains(bare, '\t'), {expand}, bare))[0]"


def wrap_line_sql(line: str, cols: str) -> str:
    """Greedy wrap at spaces, between CJK characters, or inside an over-long word."""
    brk = f"(?:(?= |$)|(?<={_ANYWHERE})|(?={_ANYWHERE}))"
    c, rest = f"CAST({cols} AS STRING)", f"CAST({cols} - 1 AS STRING)"
    parts = [
        sql_text("(?s)^(?= ).{1,"), c, sql_text("}(?<! )" + brk + "|[^ ].{0,"), rest, sql_text("}" + brk + "|[^ ]{"), c, sql_text("}"),
    ]
    wrapped = f"transform(regexp_extract_all({line}, concat({', '.join(parts)}), 0), w -> rtrim(w))"
    return f"if(length({line}) <= {cols}, array({line}), {wrapped})"


def text_pages_sql(text: str, cols: str, lines_per_page: str) -> str:
    """``array<array<string>>``: the pages of a text, each an array of lines."""
    lines = (
        f"flatten(transform(split(regexp_replace(sheet, {sql_text(r'\n\z')}, ''), '\n', -1), raw -> "
        f"transform(array({clean_line_sql('raw')}), line -> {wrap_line_sql('line', cols)})[0]))"
    )
    chunks = (
        f"if(size(ls) = 0, CAST(array() AS array<array<string>>), transform(sequence(0, CAST((size(ls) - 1) div {lines_per_page} AS INT)), "
        f"k -> slice(ls, k * {lines_per_page} + 1, {lines_per_page})))"
    )
    normal = f"replace(replace({text}, '\r\n', '\n'), '\r', '\n')"
    pages = f"flatten(transform(split({normal}, '\f', -1), sheet -> transform(array({lines}), ls -> {chunks})[0]))"
    # Pages at the end with nothing on them are dropped.
    used = "coalesce(array_max(transform(ps, (p, i) -> if(exists(p, x -> x <> ''), i + 1, 0))), 0)"
    return f"transform(array({pages}), ps -> slice(ps, 1, {used}))[0]"


def paginate_text(df: DataFrame, text: str = "text", cols: int | str = 80, lines_per_page: int | str = 50) -> DataFrame:
    """One row per page: all other columns, ``page_no`` (0-based) and ``lines``.

    ``cols`` and ``lines_per_page`` may be SQL expressions over the row. Narrow: a text is one row,
    so no shuffle is needed to lay it out.
    """
    keep = [x for x in df.columns if x != text]
    return each(df, keep, F.expr(text_pages_sql(text, f"({cols})", f"({lines_per_page})")), "lines", "page_no")
