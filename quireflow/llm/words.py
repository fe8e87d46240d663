"""Word hashes and byte positions of many texts at once, for operators that read every word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes handled in one step; a longer text is cut between words, so memory follows this and the longest text.
STEP = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)

#: Letters and digits of ASCII and every byte of a longer UTF-8 sequence belong to words.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Words:
    """``doc[i]`` is the number of word i's text, ``start[i]`` and ``end[i]`` its bytes in it, ``hash[i]`` its content.

    ``prefix[k][i]`` is the hash of its first bytes, as many as asked for, equal to the hash of a word of those bytes alone.
    """

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    prefix: list[np.ndarray]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; each seed gives another hash."""
    h = (h ^ np.uint64(seed)) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(29)
    return h


def _powers(n: int) -> np.ndarray:
    return np.r_[np.uint64(1), np.cumprod(np.full(max(n - 1, 0), BASE))]


def _cut(data: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    inside = WORD_BYTES[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, [np.empty(0, np.uint64)] * (1 + len(prefixes))
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    values = (data[inside].astype(np.uint64) + np.uint64(1)) * _powers(int(sizes.max()))[at]
    return starts, ends, [mix(np.add.reduceat(values if n is None else values * (at < n), first)) for n in (None, *prefixes)]


def _pieces(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    at = 0
    while len(data) - at > STEP:
        gap = np.flatnonzero(~WORD_BYTES[data[at : at + STEP]])
        if len(gap):
            end = at + int(gap[-1]) + 1
        else:
            gap = np.flatnonzero(~WORD_BYTES[data[at + STEP :]])
            end = at + STEP + int(gap[0]) + 1 if len(gap) else len(data)
        yield at, data[at:end]
        at = end
    yield at, data[at:]


def cut_words(texts: list[bytes], prefixes: tuple[int, ...] = ()) -> Words:
    """The words of all texts, in order."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    parts = [(at, *_cut(piece, prefixes)) for at, piece in _pieces(data)]
    start = np.concatenate([at + s for at, s, *_ in parts])
    end = np.concatenate([at + e for at, _, e, _ in parts])
    hashes = [np.concatenate([p[3][k] for p in parts]) for k in range(1 + len(prefixes))]
    if not len(start):
        return Words(start, start, end, hashes[0], hashes[1:])
    doc = np.searchsorted(begins, start, "right") - 1
    return Words(doc, start - begins[doc], end - begins[doc], hashes[0], hashes[1:])


def lowered(text: str | None) -> str:
    """Lower case of the same length, so that positions stay; null as empty."""
    text = text or ""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def groups_of(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """``(position of the first, lowered texts as UTF-8)`` in groups of about ``STEP`` bytes."""
    first, group, size = 0, [], 0
    for i, t in enumerate(texts):
        data = lowered(t).encode()
        if group and size + len(data) > STEP:
            yield first, group
            first, group, size = i, [], 0
        group.append(data)
        size += len(data) + 1
    if group:
        yield first, group
