"""Number formats: Roman, alphabetic, list markers, page labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import let

# The Roman digits of each decimal place, 0-9.
_ONES = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
_TENS = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]
_HUNDREDS = ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"]

# Page-number formats.
PAGE_FORMATS = ["decimal", "decimal-slash-total", "page-x-of-n", "lower-roman", "upper-roman", "lower-alpha", "upper-alpha"]


def to_roman(n: Column) -> Column:
    """Upper-case Roman numeral of a positive integer; thousands repeat without limit. Null below 1."""

    def digit(names: list[str], place: int) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in names]), (F.floor(n / place) % 10 + 1).cast("int"))

    text = F.concat(
        F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), digit(_HUNDREDS, 100), digit(_TENS, 10), digit(_ONES, 1)
    )
    return F.when(n >= 1, text)


def to_alpha(n: Column) -> Column:
    """Bijective base 26: 1 -> a, 26 -> z, 27 -> aa, 28 -> ab. Null below 1."""
    # 14 letters hold every 64-bit integer.
    start = F.struct(n.cast("long").alias("n"), F.lit("").alias("s"))

    def step(acc: Column, _: Column) -> Column:
        rest = acc["n"] - 1
        return F.when(acc["n"] <= 0, acc).otherwise(
            F.struct(F.floor(rest / 26).cast("long").alias("n"), F.concat(F.char(97 + rest % 26), acc["s"]).alias("s"))
        )

    return F.when(n >= 1, F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda a: a["s"]))


def to_alpha_py(n: int) -> str:
    """The same numbering for names chosen before a job runs."""
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(97 + r) + out
    return out


def list_number(n: Column, fmt: Column | str) -> Column:
    """A list item's number; letters repeat (27 -> aa, 28 -> bb), unlike :func:`to_alpha`."""
    f = F.lit(fmt) if isinstance(fmt, str) else fmt
    i = F.greatest(n, F.lit(1)) - 1
    letter = F.repeat(F.char(97 + i % 26), (F.floor(i / 26) + 1).cast("int"))
    roman = F.coalesce(to_roman(n), F.lit(""))
    return (
        F.when(f == "lowerLetter", letter).when(f == "upperLetter", F.upper(letter))
        .when(f == "lowerRoman", F.lower(roman)).when(f == "upperRoman", roman)
        .when(f == "decimalZero", F.format_string("%02d", n)).otherwise(n.cast("string"))
    )


def list_marker(list_type: Column, value: Column) -> Column:
    """The marker drawn before a list item, or null for ``none``."""
    # Bullets and the number format of each list type.
    bullets = {"disc": "•", "circle": "◦", "square": "▪"}
    formats = {
        "lower-alpha": "lowerLetter", "lower-latin": "lowerLetter", "upper-alpha": "upperLetter", "upper-latin": "upperLetter",
        "lower-roman": "lowerRoman", "upper-roman": "upperRoman", "decimal-leading-zero": "decimalZero",
    }
    fmt = F.lit("decimal")
    for k, v in formats.items():
        fmt = F.when(list_type == k, v).otherwise(fmt)
    out = F.concat(list_number(value, fmt), F.lit("."))
    for k, v in bullets.items():
        out = F.when(list_type == k, v).otherwise(out)
    return F.when(list_type == "none", F.lit(None).cast("string")).otherwise(out)


def format_number(fmt: str, value: Column, total: Column) -> Column:
    if fmt not in PAGE_FORMATS:
        raise ValueError(f"unknown page-number format: {fmt}")
    v, t = value.cast("string"), total.cast("string")
    return {
        "decimal": lambda: v,
        "decimal-slash-total": lambda: F.concat(v, F.lit("/"), t),
        "page-x-of-n": lambda: F.concat(F.lit("Page "), v, F.lit(" of "), t),
        "lower-roman": lambda: F.lower(to_roman(value)),
        "upper-roman": lambda: to_roman(value),
        "lower-alpha": lambda: to_alpha(value),
        "upper-alpha": lambda: F.upper(to_alpha(value)),
    }[fmt]()


def bates_label(n: Column, prefix: str, suffix: str, padding: int) -> Column:
    """Zero-padded to at least ``padding`` digits, never cut."""
    digits = F.format_string(f"%0{padding}d", n) if padding > 0 else n.cast("string")
    return F.concat(F.lit(prefix), digits, F.lit(suffix))


def number_text(value: Column) -> Column:
    """At most three decimals, no trailing zeros, ``-0`` as ``0``."""
    body = let(F.format_string("%.3f", value), lambda s: F.regexp_replace(s, r"\.?0+$", ""))
    return F.when(body == "-0", "0").otherwise(body)


def range_string(pages: Column) -> Column:
    """0-based page list as 1-based text: [1,3] -> '2,4'."""
    return F.array_join(F.transform(pages, lambda p: (p + 1).cast("string")), ",")
