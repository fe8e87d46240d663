"""Secret scanning: fixed patterns, and a battery of randomness tests for everything else that looks encoded.

Candidates are maximal runs of encoding characters. Each is read in the smallest alphabet that holds it (hex, base32,
base64, its URL form) and tested as a sequence of symbols: chi-squared for uniform use of the alphabet, runs above and below
the middle, serial correlation. Fisher's method joins the three into the probability that a random string
would look at least this odd. A second probability asks how even a string drawn from ordinary letter frequencies would come out at that
length; since it falls with length, short candidates need more evidence. Candidates that pass the first are ranked by
the second, and a weighted Benjamini-Hochberg cut over the whole table holds the expected share of false finds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

ROWS_AT_ONCE = 256

# The base patterns with their least lengths (of group 2 for assignments), in the order of their kinds.
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "random")
ASSIGN_HINTS = ("passw", "secret", "token", "api")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
# Alphabets in the order they are tried.
HEXADECIMAL, UPPER_HEXADECIMAL = "0123456789abcdef", "0123456789ABCDEF"
UPPERCASE, LOWERCASE, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = (
    ("hex", HEXADECIMAL), ("hex", UPPER_HEXADECIMAL), ("base32", UPPERCASE + "234567"), ("base32", LOWERCASE + "234567"), ("base36", LOWERCASE + DIGITS), ("base36", UPPERCASE + DIGITS),
    ("base62", UPPERCASE + LOWERCASE + DIGITS), ("base64", UPPERCASE + LOWERCASE + DIGITS + "+/"), ("base64url", UPPERCASE + LOWERCASE + DIGITS + "-_"),
)
# Relative frequency of the letters a to z in English text, per cent.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.07)
BINS = 400  # of -log10 p, a tenth each


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, leftmost and not overlapping per kind, in code points."""
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def infer(token: str) -> tuple[str, list[int], int] | None:
    """``(encoding, symbols, alphabet size)`` in the smallest alphabet that fits; None for numbers, of which no text model can tell anything."""
    body = token.rstrip("=")
    if not any(c in UPPERCASE or c in LOWERCASE for c in body):
        return None
    for name, alphabet in ALPHABETS:
        at = {c: i for i, c in enumerate(alphabet)}
        if all(c in at for c in body):
            return name, [at[c] for c in body], len(alphabet)
    return None


def _tail(z: float) -> float:
    """Two-sided normal probability."""
    return math.erfc(abs(z) / math.sqrt(2))


def _below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def chi_squared(symbols: list[int], size: int) -> float:
    counts: dict[int, int] = {}
    for s in symbols:
        counts[s] = counts.get(s, 0) + 1
    return sum(c * c for c in counts.values()) * size / len(symbols) - len(symbols)


def uniformity_p(symbols: list[int], size: int) -> float:
    """Probability of a chi-squared at least this large for random symbols (exact mean and variance, cube-root normal)."""
    n, k = len(symbols), size - 1
    spread = math.sqrt(2 * k * (n - 1) / n)
    return _below(-(chi_squared(symbols, size) - k) / spread)


def runs_p(symbols: list[int], size: int) -> float:
    """Runs below and above the middle of the alphabet, two-sided."""
    up = [s * 2 >= size for s in symbols]
    n, a = len(up), sum(up)
    b = n - a
    if not a or not b or n < 2:
        return 2.0 ** (1 - n)
    mean = 1 + 2 * a * b / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + sum(x != y for x, y in zip(up, up[1:], strict=False))
    return _tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0


def serial_p(symbols: list[int]) -> float:
    """Correlation of neighbouring symbols, two-sided."""
    n = len(symbols)
    mean = sum(symbols) / n
    var = sum((s - mean) ** 2 for s in symbols)
    if var == 0:
        return 0.0
    r = sum((x - mean) * (y - mean) for x, y in zip(symbols, symbols[1:], strict=False)) / var
    return _tail((r + 1 / n) * math.sqrt(n))


def random_p(symbols: list[int], size: int) -> float:
    """Fisher's combination of the three tests: chi-squared with six degrees of freedom, in closed form."""
    tests = (uniformity_p(symbols, size), runs_p(symbols, size), serial_p(symbols))
    half = -sum(math.log(max(p, 1e-300)) for p in tests)
    return math.exp(-half) * (1 + half + half * half / 2)


def text_p(token: str) -> float:
    """Probability that a string of this length with the letter use of ordinary text comes out this even or more.

    Letters are compared without case, digits as ten more symbols of the share that even use would give them.
    """
    body = token.rstrip("=").lower()
    letters = [ord(c) - 97 for c in body if "a" <= c <= "z"]
    n = len(letters)
    changes = sum((x in DIGITS) != (y in DIGITS) for x, y in zip(body, body[1:], strict=False))
    digits = sum(c in DIGITS for c in body)
    total = sum(LETTERS)
    p = 1.0
    if n >= 2:
        q = [v / total for v in LETTERS]
        # Log-likelihood per letter: even use scores lower than text does; normal for sums of independent letters.
        scores = [math.log(v) for v in q]
        mean = sum(a * b for a, b in zip(q, scores, strict=True))
        var = sum(a * (b - mean) ** 2 for a, b in zip(q, scores, strict=True))
        p = _below((sum(scores[c] for c in letters) - n * mean) / math.sqrt(n * var))
    # In text digits stand in groups: a border between digit and letter at each place has at most this chance.
    border = 0.1
    expected = (len(body) - 1) * border
    spread = math.sqrt(max((len(body) - 1) * border * (1 - border), 1e-9))
    q = _below(-(changes - 0.5 - expected) / spread) if digits else 1.0
    half = -math.log(max(p, 1e-300)) - math.log(max(q, 1e-300))
    return math.exp(-half) * (1 + half)


def candidates(text: str, taken: list[tuple[int, int, int]], random_least: float) -> list[tuple[int, int, float]]:
    """``(start, end, text_p)`` of candidates outside the base spans that the battery does not reject."""
    out = []
    for m in CANDIDATE.finditer(text):
        if any(a < m.end() and m.start() < b for a, _, b in taken):
            continue
        read = infer(m[0])
        if read and random_p(read[1], read[2]) >= random_least:
            out.append((m.start(), m.end(), text_p(m[0])))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.01, random_least: float = 0.01, typical: int = 24) -> DataFrame:
    """``(doc_id, base, random)``: spans of the fixed patterns and of the tests, arrays of (start, kind, end) by start and kind.

    ``rate``: false discoveries allowed among the finds of the tests; ``random_least``: the battery's level; candidates weigh
    length / ``typical`` in the cut, so longer ones need a smaller share of evidence. Positions are code points, ends exclusive.
    Null texts count as empty. Rows, their order and repeats stay; other columns are ignored. The cut is taken over all
    candidates of the table; a fixed number of counts reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        found_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("bin", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                base, found = [], []
                for t in part.column(1).to_pylist():
                    spans = base_spans(t or "")
                    base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
                    weighed = ((a, b, p / min((b - a) / typical, 4.0)) for a, b, p in candidates(t or "", spans, random_least))
                    found.append([{"start": a, "end": b, "bin": min(int(-10 * math.log10(max(p, 1e-300))), BINS) if p < 1 else 0} for a, b, p in weighed])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base, base_type), pa.array(found, found_type)], ["doc_id", "base", "found"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, base array<struct<start: int, kind: int, end: int>>, found array<struct<start: int, end: int, bin: int>>"
    marked = checkpointed(rows.mapInArrow(run, schema))
    bins = marked.select(F.explode("found.bin").alias("bin")).groupBy("bin").count()
    least = significant_bin({r["bin"]: r["count"] for r in bins.collect()}, rate)
    picked = F.filter("found", lambda f: f["bin"] >= least)
    kind = F.lit(KINDS.index("random"))
    random = F.transform(picked, lambda f: F.struct(f["start"].alias("start"), kind.alias("kind"), f["end"].alias("end")))
    return marked.select("doc_id", "base", random.alias("random"))


def significant_bin(counts: dict[int, int], rate: float) -> int:
    """Benjamini-Hochberg on binned probabilities: the lowest bin whose largest p is within ``rate`` times its share of all."""
    total, above, best = sum(counts.values()), 0, BINS + 1
    for b in sorted(counts, reverse=True):
        above += counts[b]
        if 10 ** (-b / 10) <= rate * above / total:
            best = b
    return best


def span_texts(spans: Column) -> Column:
    """``kind:start:end`` of each span, by start and then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def kind_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
