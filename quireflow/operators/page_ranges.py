"""Page-range texts: read once, before any job, into a short list of intervals."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PageSpec:
    """0-based, inclusive intervals in the order written; ``every`` means all pages."""

    tokens: tuple[tuple[str, int, int], ...] = ()
    every: bool = False
    swapped: bool = False

    def merged(self) -> list[tuple[int, int]]:
        out: list[list[int]] = []
        for lo, hi in sorted((a, b) for _, a, b in self.tokens if a <= b):
            if out and lo <= out[-1][1] + 1:
                out[-1][1] = max(out[-1][1], hi)
            else:
                out.append([lo, hi])
        return [(a, b) for a, b in out]

    def contains(self, page: Column) -> Column:
        if self.every:
            return F.lit(True)
        hit = F.lit(False)
        for lo, hi in self.merged():
            hit = hit | page.between(lo, hi)
        return hit

    def before(self, page: Column) -> Column:
        """How many selected pages come before ``page``: sums, not a ranking."""
        if self.every:
            return page.cast("long")
        n = F.lit(0).cast("long")
        for lo, hi in self.merged():
            n = n + F.greatest(F.lit(0), F.least(page, F.lit(hi + 1)) - lo)
        return n.cast("long")

    def error(self, count: Column) -> Column:
        """The complaint for a document of ``count`` pages, or null: the first bad token's."""
        out = F.lit(None).cast("string")
        for token, lo, hi in reversed(self.tokens):
            bad = (F.lit(lo) < 0) | (F.lit(hi) >= count) | (F.lit(lo) > F.lit(hi))
            if self.swapped:
                text = F.concat(F.lit("Pages must be between 1 and "), count.cast("string"), F.lit("."))
            elif "-" in token:
                text = F.concat(F.lit(f'Range "{token}" is outside 1–'), count.cast("string"), F.lit("."))
            else:
                text = F.concat(F.lit(f"Page {int(token)} is outside 1–"), count.cast("string"), F.lit("."))
            out = F.when(bad, text).otherwise(out)
        return out


def parse_pages(text: str, allow_all: bool = True, swap: bool = False) -> PageSpec:
    """``"1-3, 5"``: 1-based numbers and ranges; empty or ``all`` is every page when allowed.

    With ``swap`` a reversed range is turned round instead of refused.
    """
    body = text.strip().lower()
    if allow_all and body in ("", "all"):
        return PageSpec(every=True)
    tokens = []
    for tok in (t.strip() for t in body.split(",")):
        if not tok:
            continue
        m = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", tok)
        if not m:
            raise ValueError(f'"{tok}" isn\'t a page or range.')
        a, b = int(m[1]), int(m[2] or m[1])
        if swap:
            a, b = min(a, b), max(a, b)
        tokens.append((tok, a - 1, b - 1))
    if not tokens:
        raise ValueError("Enter at least one page.")
    return PageSpec(tuple(tokens), swapped=swap)


def parse_split_points(text: str) -> list[int]:
    """Distinct, sorted 1-based pages to split before."""
    tokens = [t.strip() for t in text.split(",") if t.strip()]
    if not tokens:
        raise ValueError("Enter at least one split point.")
    for t in tokens:
        if not t.isdigit():
            raise ValueError(f'"{t}" isn\'t a page number.')
    return sorted({int(t) for t in tokens})
