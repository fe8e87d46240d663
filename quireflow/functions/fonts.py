"""Font names: comparison keys, base-14 test, substitutes, classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import let

# Style words peeled off the end of a font name, tried in this order.
STYLE_SUFFIXES = [
    "psmt", "mt", "ps", "bolditalic", "boldoblique", "bold", "italic", "oblique", "regular", "semibold", "demibold",
    "medium", "light", "black", "heavy", "thin", "condensed", "narrow",
]
# Keys of the fonts every viewer has.
STANDARD_KEYS = [
    "helvetica", "arial", "times", "timesroman", "timesnewroman", "courier", "couriernew", "symbol", "zapfdingbats",
]
# Words that tell a font's class.
MONO_HINTS = ["courier", "mono", "consol", "menlo", "code"]
SERIF_HINTS = ["times", "georgia", "garamond", "serif", "roman", "minion", "book", "century"]
CLASS_MONO = ["mono", "courier", "consolas", "menlo", "monaco", "lucida console", "code", "typewriter", "fixed"]
CLASS_SERIF = [
    "times", "georgia", "cambria", "garamond", "palatino", "book antiqua", "baskerville", "constantia", "serif", "minion",
    "caslon", "bookman", "didot", "bodoni", "hoefler", "century", "goudy", "charter", "cochin", "new york",
]
# Families tried when one is missing, by class.
FALLBACK_FAMILIES = {
    "sans": ["Carlito", "Arial", "Liberation Sans", "Helvetica Neue", "Helvetica", "DejaVu Sans", "Noto Sans"],
    "serif": ["Times New Roman", "Liberation Serif", "Georgia", "Times", "DejaVu Serif", "Noto Serif"],
    "mono": ["Courier New", "Liberation Mono", "Menlo", "Consolas", "DejaVu Sans Mono", "Noto Sans Mono"],
}


def normalize_font_key(name: Column) -> Column:
    """Lower-case letters and digits after any subset tag, style words peeled off the end.

    The key is never peeled to nothing.
    """
    base = F.lower(F.regexp_replace(F.substring_index(name, "+", -1), "[^A-Za-z0-9]", ""))

    def peel(key: Column, _: Column) -> Column:
        out = key
        for suffix in reversed(STYLE_SUFFIXES):
            cut = F.left(key, F.length(key) - len(suffix))
            out = F.when(key.endswith(suffix), F.when(key == suffix, key).otherwise(cut)).otherwise(out)
        return out

    # The shortest style word has two letters, so half the length bounds the peeling.
    rounds = lambda k: F.sequence(F.lit(1), F.greatest(F.floor(F.length(k) / 2).cast("int"), F.lit(1)))
    return let(base, lambda k: F.aggregate(rounds(k), k, peel))


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def is_standard(name: Column) -> Column:
    return normalize_font_key(name).isin(*STANDARD_KEYS)


def fallback_substitute(name: Column) -> Column:
    """The base-14 face nearest in class, weight and slant."""
    low = F.lower(name)
    bold, italic = _any(low, ["bold", "black", "heavy"]), _any(low, ["italic", "oblique"])

    def face(family: str, plain: str, slant: str) -> Column:
        return (
            F.when(bold & italic, f"{family}-Bold{slant}").when(bold, f"{family}-Bold").when(italic, f"{family}-{slant}").otherwise(f"{family}{plain}")
        )

    return (
        F.when(_any(low, MONO_HINTS), face("Courier", "", "Oblique")).when(_any(low, SERIF_HINTS), face("Times", "-Roman", "Italic"))
        .otherwise(face("Helvetica", "", "Oblique"))
    )


def font_class(family: Column) -> Column:
    low = F.lower(family)
    serif = _any(low, CLASS_SERIF) & ~F.contains(low, F.lit("sans"))
    return F.when(_any(low, CLASS_MONO), "mono").when(serif, "serif").otherwise("sans")
