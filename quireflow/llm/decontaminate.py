"""Benchmark decontamination by latent semantic retrieval.

Benchmark items, cut into query passages, are handled in groups of bounded size. For each group the corpus is seen as a matrix of
overlapping passages by the group's terms. One pass over all documents counts in how many passages each term occurs and sums the
sketch of a randomised singular value decomposition (N'N times a random matrix), task by task; the items are rows of the same
matrix, with the weight of the whole corpus, so that the latent space holds each of them. The decomposition of the small sketch
gives the space. A second pass counts how many of each item's words, common ones too, a document and then a passage with its surroundings
hold, and compares the words of each passage that holds enough of them with the item: longest common subsequence, and
the item's answer (what follows its last question or, without one, its last sentence). What it finds gets its cosine in the latent space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import cut_words, groups_of, lowered

ROWS_AT_ONCE = 256
STRIDE = 64  # words; a passage is two strides long, a query passage at most one
GROUP = 32  # query passages that share a latent space
CORPUS_RANK = 16  # directions beside those of the items
ITEMS_AT_ONCE, CHARS_AT_ONCE = 2_000, 4_000_000  # of the benchmark, for one run over the documents
SIEVE = 1 << 20


@dataclass
class Item:
    item_id: int | None
    words: list[int]
    answer: set[int]


@dataclass
class Group:
    """Query passages as rows of ``queries`` over ``terms`` (sorted word hashes), later in latent coordinates."""

    terms: np.ndarray
    queries: np.ndarray
    owner: list[int]
    seed: int
    idf: np.ndarray = field(default_factory=lambda: np.empty(0))
    space: np.ndarray = field(default_factory=lambda: np.empty(0))
    latent: np.ndarray = field(default_factory=lambda: np.empty(0))

    def rank(self) -> int:
        return min(len(self.terms), len(self.queries) + CORPUS_RANK)

    def random(self) -> np.ndarray:
        return np.random.default_rng(self.seed).normal(size=(len(self.terms), self.rank())).astype(np.float32)


def _word_hashes(text: str) -> list[int]:
    return cut_words([lowered(text).encode()]).hash.tolist()


def read_items(rows: list[tuple[int | None, str | None]]) -> list[Item]:
    """Items with at least one word; the answer is what follows the last question mark, else the last sentence, of three words or more."""
    items = []
    for item_id, text in rows:
        words = _word_hashes(text or "")
        if not words:
            continue
        parts = [h for h in map(_word_hashes, re.split(r"[?？]" if re.search(r"[?？].*\w", text, re.S) else r"[.!。！\n]", text)) if len(h) >= 3]
        items.append(Item(item_id, words, set(parts[-1] if parts else words)))
    return items


def group_items(items: list[Item], common: float = 0.01) -> list[Group]:
    """Cut items into query passages of at most ``STRIDE`` words and those into groups.

    Words found in more than ``common`` of the items carry no topic and are left out, unless a passage would keep under five terms.
    """
    holders: dict[int, int] = {}
    for item in items:
        for w in set(item.words):
            holders[w] = holders.get(w, 0) + 1
    limit = max(common * len(items), 1)
    passages = []
    for i, item in enumerate(items):
        pieces = -(-len(item.words) // STRIDE)
        size = -(-len(item.words) // pieces)
        for at in range(0, len(item.words), size):
            own = set(item.words[at : at + size])
            rare = {w for w in own if holders[w] <= limit}
            passages.append((i, rare if len(rare) >= 5 else own))
    groups = []
    for at in range(0, len(passages), GROUP):
        part = passages[at : at + GROUP]
        terms = np.array(sorted(set().union(*(p for _, p in part))), np.uint64)
        queries = np.zeros((len(part), len(terms)), np.float32)
        for row, (_, p) in zip(queries, part, strict=True):
            row[np.searchsorted(terms, np.array(sorted(p), np.uint64))] = 1
        groups.append(Group(terms, queries, [i for i, _ in part], at))
    return groups


@dataclass
class Cells:
    """Strides of a batch: which words hit a term of any group, and the stride they stand in."""

    hash: np.ndarray
    cell: np.ndarray
    last: np.ndarray  # per cell: whether it is the last of its document
    doc: np.ndarray  # per cell
    first_word: np.ndarray  # per cell: number of its first word in the batch
    words: np.ndarray  # all word hashes of the batch
    ends: np.ndarray  # per document: number of words up to and with it


class Vocabulary:
    """The terms of all groups in one sorted table; ``local[g]`` gives a term's place in group g, or -1."""

    def __init__(self, groups: list[Group]):
        self.terms = np.unique(np.concatenate([g.terms for g in groups]))
        self.sieve = np.zeros(SIEVE, bool)
        self.sieve[(self.terms & np.uint64(SIEVE - 1)).astype(np.int64)] = True
        self.local = np.full((len(groups), len(self.terms)), -1, np.int32)
        for own, g in zip(self.local, groups, strict=True):
            own[np.searchsorted(self.terms, g.terms)] = np.arange(len(g.terms))


def cut_cells(batch: list[bytes], vocabulary: Vocabulary) -> Cells:
    words = cut_words(batch)
    sizes = np.bincount(words.doc, minlength=len(batch))
    ends = np.cumsum(sizes)
    number = np.arange(len(words.hash)) - np.repeat(ends - sizes, sizes)
    cells = -(-sizes // STRIDE)
    base = np.cumsum(cells) - cells
    cell = base[words.doc] + number // STRIDE
    doc = np.repeat(np.arange(len(batch)), cells)
    inner = np.arange(int(cells.sum())) - base[doc]
    hit = vocabulary.sieve[(words.hash & np.uint64(SIEVE - 1)).astype(np.int64)]
    return Cells(words.hash[hit], cell[hit], inner == cells[doc] - 1, doc, (ends - sizes)[doc] + inner * STRIDE, words.hash, ends)


def passage_terms(cells: Cells, vocabulary: Vocabulary) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per group its different (passage, term) pairs, sorted; passage p holds stride p and the next one of its document."""
    n = len(vocabulary.terms)
    at = np.minimum(np.searchsorted(vocabulary.terms, cells.hash), n - 1)
    real = vocabulary.terms[at] == cells.hash
    # Stride by stride first: most words of a stride that are terms at all are so once.
    single = np.unique(cells.cell[real] * n + at[real])
    cell = single // n
    before = single[(cell > 0) & ~cells.last[np.maximum(cell - 1, 0)]] - n
    pair = np.unique(np.concatenate([single, before]))
    passage, term = pair // n, pair % n
    out = []
    for local in vocabulary.local:
        own = local[term]
        keep = own >= 0
        out.append((passage[keep], own[keep]))
    return out


def _row_sums(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``values`` over equal neighbours in ``rows``."""
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    return rows[first], np.add.reduceat(values, first, axis=0)


def sketch(docs: DataFrame, groups: list[Group], text_col: str) -> tuple[int, list[np.ndarray], list[np.ndarray]]:
    """Number of passages, and per group the terms' passage counts and N'N times the group's random matrix, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(groups)
    names = ["g", "t", "n", "y"]

    def frame(rows: dict) -> Iterator[pa.RecordBatch]:
        for g, (count, y) in rows.items():
            t = np.flatnonzero(count)
            if len(t):
                flat = pa.array(y[t].astype(np.float32).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1) * y.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), g), pa.int32()), pa.array(t, pa.int32()), pa.array(count[t], pa.int64()), lists], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = shared.value
        vocabulary, random = Vocabulary(groups), [g.random() for g in groups]
        sums = {i: (np.zeros(len(g.terms), np.int64), np.zeros((len(g.terms), g.rank()))) for i, g in enumerate(groups)}
        alone = [np.zeros(len(g.terms), np.int64) for g in groups]
        passages = 0
        for batch in batches:
            for _, texts in groups_of(batch.column(0).to_pylist()):
                cells = cut_cells(texts, vocabulary)
                passages += len(cells.doc)
                for i, (passage, term) in enumerate(passage_terms(cells, vocabulary)):
                    count, y = sums[i]
                    count += np.bincount(term, minlength=len(count))
                    # A passage with one term adds that term's own row; only the others need products.
                    many = np.bincount(passage)[passage] > 1
                    alone[i] += np.bincount(term[~many], minlength=len(count))
                    passage, term = passage[many], term[many]
                    if not len(passage):
                        continue
                    _, z = _row_sums(random[i][term], passage)
                    row = np.cumsum(np.diff(passage, prepend=passage[0]) > 0)
                    order = np.argsort(term, kind="stable")
                    t, part = _row_sums(z[row[order]], term[order])
                    y[t] += part
        for i, (_, y) in sums.items():
            y += alone[i][:, None] * random[i]
        yield from frame(sums)
        if passages:
            empty = pa.array([[]], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([passages], pa.int64()), empty], names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            y = batch.column(3)
            flat, offsets = y.flatten().to_numpy(zero_copy_only=False), y.offsets.to_numpy() - y.offsets[0].as_py()
            for k, (g, t, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                own = flat[offsets[k] : offsets[k + 1]]
                if (g, t) in total:
                    total[g, t][0] += n
                    total[g, t][1] += own
                else:
                    total[g, t] = [n, own.astype(np.float64)]
        if total:
            lists = pa.array([v[1] for v in total.values()], pa.list_(pa.float64()))
            keys = [pa.array([k[c] for k in total], pa.int32()) for c in range(2)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([v[0] for v in total.values()], pa.int64()), lists], names)

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "g int, t int, n long, y array<float>")
    rows = rows.repartition("g", "t").mapInArrow(add, "g int, t int, n long, y array<double>")
    passages, counts, sketches = 0, [np.zeros(len(g.terms)) for g in groups], [np.zeros((len(g.terms), g.rank())) for g in groups]
    for r in rows.collect():  # a row per term of the benchmark block
        if r["g"] < 0:
            passages += r["n"]
        else:
            counts[r["g"]][r["t"]] = r["n"]
            sketches[r["g"]][r["t"]] = r["y"]
    return passages, counts, sketches


def decompose(group: Group, passages: int, count: np.ndarray, y: np.ndarray) -> None:
    """Set the group's latent space: the left singular vectors that a Nystroem step takes from the sketch."""
    q, omega = group.queries.astype(float), group.random().astype(float)
    group.idf = np.log((passages + len(q) + 1) / (count + q.sum(axis=0)))
    weight = max(passages, 1)
    y = group.idf[:, None] * (y + weight * (q.T @ (q @ omega)))
    core = (omega / group.idf[:, None]).T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max() * 1e-9
    u, s, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    group.space = u[:, s > s[0] * 1e-6].astype(np.float32)
    latent = (q * group.idf) @ group.space
    group.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1), 1e-12)[:, None]).astype(np.float32)


def common_subsequence(pattern: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over the pattern."""
    places: dict[int, int] = {}
    for i, w in enumerate(pattern):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(pattern)) - 1
    row = full
    for w in text:
        if m := places.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(pattern) - row.bit_count()


class Holdings:
    """Which items hold each word, and how often: a dense row for words of many items, lists for the others."""

    def __init__(self, items: list[Item], many: int = 64):
        n = len(items)
        pair, count = np.unique(np.array([(w, i) for i, item in enumerate(items) for w in item.words], np.uint64), axis=0, return_counts=True)
        self.words, first = np.unique(pair[:, 0], return_index=True)
        self.item, self.count = pair[:, 1].astype(np.int64), count.astype(np.float32)
        self.first, self.length = first, np.diff(np.r_[first, len(pair)])
        dense = np.flatnonzero(self.length > many)
        self.row = np.full(len(self.words), -1, np.int64)
        self.row[dense] = np.arange(len(dense))
        self.dense = np.zeros((len(dense), n), np.float32)
        for r, w in enumerate(dense):
            own = slice(first[w], first[w] + self.length[w])
            self.dense[r, self.item[own]] = self.count[own]
        self.sieve = np.zeros(SIEVE, bool)
        self.sieve[(self.words & np.uint64(SIEVE - 1)).astype(np.int64)] = True

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``words`` any item holds, and their places in ``self.words``."""
        maybe = np.flatnonzero(self.sieve[(words & np.uint64(SIEVE - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.words, words[maybe]), len(self.words) - 1)
        real = self.words[at] == words[maybe]
        return maybe[real], at[real]

    def held(self, at: np.ndarray) -> np.ndarray:
        """How many of each item's words are among those at ``at``."""
        at = np.unique(at)
        row = self.row[at]
        out = self.dense[row[row >= 0]].sum(axis=0)
        at = at[row < 0]
        if len(at):
            size = self.length[at]
            flat = np.repeat(self.first[at] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            out = out + np.bincount(self.item[flat], self.count[flat], len(out))
        return out


def _held_in_windows(term: np.ndarray, times: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Per window ``lows[k]:highs[k]`` of ``term`` the sum of ``times`` over its different terms; both borders only rise.

    A repeat counts too much in the windows that hold the term's last place before as well; these are neighbours.
    """
    weight = times[term]
    total = np.r_[0, np.cumsum(weight)]
    order = np.argsort(term, kind="stable")
    same = np.flatnonzero(term[order[1:]] == term[order[:-1]])
    before, repeat = order[same], order[same + 1]
    first, last = np.searchsorted(highs, repeat, "right"), np.searchsorted(lows, before, "right")
    real = first < last
    surplus = np.bincount(first[real], weight[repeat][real], len(lows) + 1) - np.bincount(last[real], weight[repeat][real], len(lows) + 1)
    return total[highs] - total[lows] - np.cumsum(surplus)[:-1]


@dataclass
class Search:
    items: list[Item]
    groups: list[Group]
    whole: float = 0.8
    part: float = 0.6
    answer: float = 0.8

    def __post_init__(self) -> None:
        self.holdings = Holdings(self.items)
        self.scratch = np.full(len(self.holdings.words), -1, np.int64)  # places in one item's terms, while it is searched
        self.sizes = np.array([len(i.words) for i in self.items])
        self.queries: dict[int, list[tuple[int, int]]] = {}
        for g, group in enumerate(self.groups):
            for k, i in enumerate(group.owner):
                self.queries.setdefault(i, []).append((g, k))

    def find(self, texts: list[str | None]) -> list[dict[int, tuple[float, float, float]]]:
        """Per text the leaked items: position in ``items`` -> cosine, share of the item's words in common order, share of its answer."""
        out: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
        # Whole numbers of words against a share of the size: the check itself decides at the border.
        need = np.minimum(self.part, self.whole) * self.sizes - 1e-3
        for first, batch in groups_of(texts):
            words = cut_words(batch)
            ends = np.cumsum(np.bincount(words.doc, minlength=len(batch)))
            for doc, (begin, end) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)):
                own = words.hash[begin:end]
                if len(own):
                    hit, at = self.holdings.places(own)
                    for i in np.flatnonzero(self.holdings.held(at) >= need).tolist():
                        best = self._search(own, hit, at, i, float(need[i]))
                        if best:
                            out[first + doc][i] = best
        return out

    def _search(self, words: np.ndarray, hit: np.ndarray, at: np.ndarray, i: int, need: float) -> tuple[float, float, float] | None:
        """The best passage of a document for item ``i``, by share and then cosine. The words ``hit`` are any item's, at ``at`` in the table of these."""
        known, size, best = self.items[i], len(self.items[i].words), None
        terms, times = np.unique(np.array(known.words, np.uint64), return_counts=True)
        own = np.searchsorted(self.holdings.words, terms)
        self.scratch[own] = np.arange(len(terms))
        term = self.scratch[at]
        self.scratch[own] = -1
        hit, term = hit[term >= 0], term[term >= 0]
        starts = np.arange(0, len(words), STRIDE)
        begins, ends = np.maximum(starts - size, 0), np.minimum(starts + 2 * STRIDE + size, len(words))
        lows, highs = np.searchsorted(hit, begins), np.searchsorted(hit, ends)
        for k in np.flatnonzero(_held_in_windows(term, times, lows, highs) >= need).tolist():
            here = np.unique(term[lows[k] : highs[k]])
            share = common_subsequence(known.words, terms[term[lows[k] : highs[k]]].tolist()) / size
            held = set(terms[here].tolist())
            answer = len(known.answer & held) / len(known.answer)
            if (share >= self.whole or (share >= self.part and answer >= self.answer)) and (best is None or share >= best[1]):
                found = (self._cosine(words[starts[k] : starts[k] + 2 * STRIDE], i), share, answer)
                best = found if best is None or (share, found[0]) > (best[1], best[0]) else best
        return best

    def _cosine(self, passage: np.ndarray, item: int) -> float:
        """Of the passage and the nearest query of the item; 0 without any of its terms."""
        near = 0.0
        for g, k in self.queries[item]:
            group = self.groups[g]
            term = np.flatnonzero(np.isin(group.terms, passage))
            z = (group.space[term] * group.idf[term, None].astype(np.float32)).sum(axis=0)
            near = max(near, float(z @ group.latent[k] / max(np.linalg.norm(z), 1e-12)))
        return near


def searches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> Iterator[Search]:
    """A search per block of the benchmark. Blocks bound what the driver and the tasks hold; a larger benchmark takes more runs over the documents."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    n, chars = rows.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    blocks = max(-(-n // ITEMS_AT_ONCE), -(-(chars or 0) // CHARS_AT_ONCE))
    for k in range(blocks):
        block = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        items = read_items(sorted(map(tuple, block.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")))
        if not items:
            continue
        groups = group_items(items)
        passages, counts, sketches = sketch(docs, groups, text_col)
        for g, count, y in zip(groups, counts, sketches, strict=True):
            decompose(g, passages, count, y)
        yield Search(items, groups)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, cosine, common, answer)``: one row per document and benchmark item that it gives away.

    Whole texts are searched. A document leaks an item if it holds four fifths of the item's words in their order within a passage, or three
    fifths and four fifths of the answer's words. Null and empty texts on either side leak nothing; repeated rows repeat; items
    with equal ids keep one row each; empty tables give an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, cosine double, common double, answer double"
    found = docs.sparkSession.createDataFrame([], schema)
    for search in searches(docs, benchmark, text_col):
        found = found.union(rows.mapInArrow(_reporter(docs.sparkSession.sparkContext.broadcast(search)), schema))
    return found


def _reporter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                ids, items = part.column(0).to_pylist(), shared.value.items
                got = [(i, items[k].item_id, *v) for i, own in zip(ids, shared.value.find(part.column(1).to_pylist()), strict=True) for k, v in sorted(own.items())]
                columns = list(zip(*got, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "cosine", "common", "answer"])

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item, with all columns; judged row by row, without a shuffle of the texts."""
    at_text = docs.columns.index(text_col)
    kept = docs
    for search in searches(docs, benchmark, text_col):
        kept = kept.mapInArrow(_sieve(docs.sparkSession.sparkContext.broadcast(search), at_text), docs.schema)
    return kept


def _sieve(shared, at_text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                yield part.filter(pa.array([not x for x in shared.value.find(part.column(at_text).to_pylist())]))

    return run
