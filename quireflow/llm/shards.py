"""Sharding by a k-d tree over document metadata: shards of near-equal bytes, each a box of neighbouring documents.

A node with several shards to fill is split along its widest dimension, where the bytes on the left make up the share of the
shards that go left (the weighted median for an even number). All nodes of a level are split together by
histograms over a slim table of ids, sizes and metadata: each pass counts bytes per bin and keeps the bin in which a node's split lies,
a 1024th of the range, until that bin is small or one value; rows of one value are told apart by a hash of
the row, and copies of one row by their number. What reaches the driver is one row per node, so it grows with the number of shards and
not with the documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Counted for a document besides the UTF-8 bytes of its text.
OVERHEAD = 16
#: Bins of a histogram, and the parts that equal rows can be dealt in.
BINS, CHUNKS = 1024, 4096
#: A split is exact enough within this share of a shard.
SLACK = 0.001
#: Order numbers stay within 62 bits, so that differences fit a long; nulls come first.
LIMIT = 1 << 62
#: Rows numbered by one window, about.
BLOCK = 1 << 16
VALUE, HASH, CHUNK = range(3)


@dataclass
class Tree:
    """Nodes in arrays: ``left[i]`` is the left child (the right one follows) or -1 at a leaf, which has a ``shard``.

    A row goes left if its dimension ``dim`` is under ``value``, or equal to it and its hash under ``hash``, or both equal and its chunk under ``chunk``.
    """

    depth: int = 0
    left: list[int] = field(default_factory=list)
    shard: list[int] = field(default_factory=list)
    dim: list[int] = field(default_factory=list)
    value: list[int] = field(default_factory=list)
    hash: list[int] = field(default_factory=list)
    chunk: list[int] = field(default_factory=list)

    def add(self, shard: int) -> int:
        for name, start in (("left", -1), ("shard", shard), ("dim", 0), ("value", -LIMIT), ("hash", -LIMIT), ("chunk", 0)):
            getattr(self, name).append(start)
        return len(self.left) - 1


@dataclass
class _Split:
    """The search for one node's split: rows of ``phase`` between ``lo`` and ``hi`` remain, ``base`` bytes lie before them."""

    node: int
    shard: int
    count: int
    total: int
    dim: int = 0
    phase: int = VALUE
    lo: int = -LIMIT
    hi: int = LIMIT
    base: int = 0
    value: int = -LIMIT
    hash: int = -LIMIT

    @property
    def width(self) -> int:
        return (self.hi - self.lo) // BINS + 1

    @property
    def goal(self) -> int:
        return max(1, self.total * (self.count // 2) // self.count)

    def narrowed(self, before: int, weight: int, rows: int, low: int, high: int, slack: float) -> tuple[int, int, int, int] | None:
        """The cut ``(value, hash, chunk, bytes on the left)`` if this bin settles it, else None with the search narrowed to the bin."""
        above = self.base + before + weight
        below = above - weight
        if weight <= slack or rows == 1 or (low == high and self.phase == CHUNK):
            keep_right = self.goal - below <= above - self.goal
            at, left = (low, below) if keep_right else (high + 1, above)
            cut = [(at, -LIMIT, 0), (self.value, at, 0), (self.value, self.hash, at)][self.phase]
            return *cut, left
        self.base = below
        if low < high:
            self.lo, self.hi = low, high
        elif self.phase == VALUE:
            self.phase, self.value, self.lo, self.hi = HASH, low, -LIMIT, LIMIT
        else:
            self.phase, self.hash, self.lo, self.hi = CHUNK, low, 0, CHUNKS - 1
        return None


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) and the fixed overhead."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def order_number(col: Column, kind: str) -> Column:
    """A long within 62 bits that keeps the order: integers and times halved, of strings the first seven bytes; null stays null."""
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(col.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    if kind in ("tinyint", "smallint", "int", "bigint", "date", "timestamp", "boolean"):
        whole = F.unix_date(col) if kind == "date" else F.unix_micros(col) if kind == "timestamp" else col
        return F.shiftright(whole.cast("long"), 1)
    raise TypeError(f"a dimension must be an integer, a time or a string, not {kind}")


def _facts(docs: DataFrame, id_col: str, text_col: str, dims: list[str] | None) -> list[Column]:
    kinds = dict(docs.dtypes)
    names = [c for c in (id_col, "lang", "source") if c in kinds] if dims is None else dims
    numbers = [order_number(text_size(F.col(text_col)), "bigint"), *[order_number(F.col(c), kinds[c]) for c in names]]
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return [F.col(id_col).alias("id"), text_size(F.col(text_col)).alias("size"), crc.alias("crc"), *[n.alias(f"d{i}") for i, n in enumerate(numbers)]]


def _dims(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c[0] == "d" and c[1:].isdigit()]


def _row_hash(rows: DataFrame) -> Column:
    return F.shiftright(F.xxhash64("id", "size", "crc", *_dims(rows)), 1)


def slim(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: list[str] | None = None) -> DataFrame:
    """``(id, size, crc, d0 ..., h, p, times)``: rows equal in all of it are combined, then dealt in at most ``CHUNKS`` parts."""
    rows = docs.select(*_facts(docs, id_col, text_col, dims))
    units = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")).withColumn("h", _row_hash(rows))
    parts = F.least(F.col("n"), F.lit(CHUNKS))
    dealt = units.withColumn("parts", parts).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    times = F.expr("n div parts + IF(j < n % parts, 1, 0)")
    return dealt.select(*rows.columns, "h", F.expr(f"j * {CHUNKS} div parts").alias("p"), times.alias("times"))


def _numbers(values: list[int]) -> Column:
    """A constant array; written as one string, so that its length costs no plan nodes."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _at(values: list[int], index: Column) -> Column:
    return F.element_at(_numbers(values), (index + 1).cast("int"))


def node_of(tree: Tree, dims: list[Column], h: Column, p: Column) -> Column:
    """The leaf of a row, or the deepest node so far."""
    values = F.array(*[F.coalesce(d, F.lit(-LIMIT)) for d in dims])

    def step(node: Column, _: Column) -> Column:
        value, cut = F.element_at(values, (_at(tree.dim, node) + 1).cast("int")), _at(tree.value, node)
        own, part = _at(tree.hash, node), _at(tree.chunk, node)
        goes_left = (value < cut) | ((value == cut) & ((h < own) | ((h == own) & (p < part))))
        child = _at(tree.left, node)
        return F.when(child < 0, node).otherwise(child + F.when(goes_left, 0).otherwise(1))

    if not tree.depth:
        return F.lit(0).cast("long")
    return F.aggregate(F.sequence(F.lit(1), F.lit(tree.depth)), F.lit(0).cast("long"), step)


def _placed(rows: DataFrame, tree: Tree) -> DataFrame:
    return rows.withColumn("node", node_of(tree, [F.col(d) for d in _dims(rows)], F.col("h"), F.col("p")))


def _extents(rows: DataFrame, tree: Tree, open_nodes: list[_Split]) -> dict[int, list[tuple[int, int]]]:
    dims = _dims(rows)
    flags = [0] * len(tree.left)
    for s in open_nodes:
        flags[s.node] = 1
    ends = [f(d).alias(f"{d}_{name}") for d in dims for name, f in (("lo", F.min), ("hi", F.max))]
    found = _placed(rows, tree).where(_at(flags, F.col("node")) == 1).groupBy("node").agg(*ends).collect()
    return {r["node"]: [(r[f"{d}_lo"], r[f"{d}_hi"]) for d in dims] for r in found}


def _crossings(rows: DataFrame, tree: Tree, open_nodes: list[_Split]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """``(node, bytes before the bin, its bytes, its rows, its least and its largest key)`` of the bin in which each open split lies."""
    by = {s.node: s for s in open_nodes}
    columns = {}
    for name in ("dim", "phase", "lo", "hi", "width", "value", "hash"):
        columns[name] = _at([getattr(by[i], name) if i in by else 0 for i in range(len(tree.left))], F.col("node"))
    goal = _at([by[i].goal - by[i].base if i in by else -1 for i in range(len(tree.left))], F.col("node"))
    values = F.array(*[F.coalesce(F.col(d), F.lit(-LIMIT)) for d in _dims(rows)])
    tagged = _placed(rows, tree).withColumn("goal", goal).where("goal >= 0")
    tagged = tagged.withColumn("v", F.element_at(values, (columns["dim"] + 1).cast("int")))
    same = (F.col("v") == columns["value"]) & ((columns["phase"] == HASH) | (F.col("h") == columns["hash"]))
    key = F.when(columns["phase"] == VALUE, F.col("v")).when(same, F.when(columns["phase"] == HASH, F.col("h")).otherwise(F.col("p")))
    tagged = tagged.select("node", "goal", key.alias("key"), columns["lo"].alias("lo"), columns["hi"].alias("hi"), columns["width"].alias("width"), F.expr("size * times").alias("w"))
    # Nulls of a dimension are a bin of their own before the others.
    inside = tagged.where("key BETWEEN lo AND hi OR key = -%d" % LIMIT).withColumn("bin", F.expr("IF(key < lo, -1L, (key - lo) div width)"))
    bins = inside.groupBy("node", "goal", "bin").agg(F.sum("w").alias("w"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin"))
    found = bins.withColumn("upto", upto).where("upto >= goal AND upto - w < goal")
    for r in found.collect():
        yield r["node"], r["upto"] - r["w"], r["w"], r["n"], r["low"], r["high"]


def grow(rows: DataFrame, shards: int | None, target_bytes: int | None = None) -> tuple[Tree, int]:
    """The tree over a slim table and its number of rows; ``shards`` leaves, or as many as leaves of ``target_bytes`` need."""
    total, count = rows.agg(F.sum(F.expr("size * times")), F.sum("times")).first()
    total, count = total or 0, count or 0
    shards = shards or max(1, -(-total // target_bytes))
    tree, slack = Tree(), SLACK * total / shards
    level = [_Split(tree.add(0), 0, shards, total)]
    ranges = None
    while level := [s for s in level if s.count > 1]:
        extents = _extents(rows, tree, [s for s in level if s.total])
        ranges = ranges or next(iter(extents.values()), [])
        cuts: dict[int, tuple[int, int, int, int]] = {}
        for s in level:
            if s.node not in extents:
                cuts[s.node] = (-LIMIT, -LIMIT, 0, 0)  # no rows
                continue
            own = extents[s.node]
            widths = [(hi - lo) / max(1, all_hi - all_lo) if lo is not None else 0 for (lo, hi), (all_lo, all_hi) in zip(own, ranges, strict=True)]
            s.dim = max(range(len(own)), key=lambda i: widths[i])
            if own[s.dim][0] is not None:
                s.lo, s.hi = own[s.dim]
        while pending := [s for s in level if s.node not in cuts]:
            found = {node: bin_ for node, *bin_ in _crossings(rows, tree, pending)}
            for s in pending:
                if cut := s.narrowed(*found[s.node], slack):
                    cuts[s.node] = cut
        below = []
        for s in level:
            tree.dim[s.node], (tree.value[s.node], tree.hash[s.node], tree.chunk[s.node], left) = s.dim, cuts[s.node]
            half = s.count // 2
            tree.left[s.node] = tree.add(s.shard)
            tree.add(s.shard + half)
            below += [_Split(tree.left[s.node], s.shard, half, left), _Split(tree.left[s.node] + 1, s.shard + half, s.count - half, s.total - left)]
        tree.depth += 1
        level = below
    return tree, count


def _stored(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Written by column to the shared folder: each pass over the tree's levels reads few columns of it."""
    path = f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def fit(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", dims: list[str] | None = None) -> Tree:
    return grow(_stored(docs.sparkSession, slim(docs, id_col, text_col, dims)), shards, target_bytes)[0]


def assign(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", dims: list[str] | None = None) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)``, one row per row of ``docs``: a shard from 0, a slot from 0 without gaps in it.

    ``size`` is the UTF-8 bytes of the text (null: none) and 16. The tree's dimensions are the size and ``dims`` (by default the id, ``lang`` and
    ``source``, where there are such columns); nulls come before all values. Sizes of shards differ by the size of single documents and a
    thousandth of a shard per level. Rows equal in id, text and dimensions may fall into different shards; with more shards than rows some
    stay empty. An empty table gives an empty result; other columns have no part in it.
    """
    rows = _stored(docs.sparkSession, slim(docs, id_col, text_col, dims))
    tree, count = grow(rows, shards, target_bytes)
    placed = _placed(rows, tree).withColumn("shard", _at(tree.shard, F.col("node")).cast("int"))
    # Blocks of a hash prefix: as many as keep about BLOCK rows in each even if one shard had all rows.
    bits = max(0, (count // BLOCK).bit_length())
    placed = placed.withColumn("block", F.shiftright("h", 62 - bits) if bits else F.lit(0).cast("long"))
    sums = placed.groupBy("shard", "block").agg(F.sum("times").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    order = ["h", "id", "size", "crc", *_dims(rows), "p"]
    inside = Window.partitionBy("shard", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.join(offsets, ["shard", "block"]).withColumn("slot", F.col("offset") + F.coalesce(F.sum("times").over(inside), F.lit(0)))
    each = numbered.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    return each.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("slot") + F.col("copy")).alias("slot"))


def place(docs: DataFrame, tree: Tree, out: str = "shard", id_col: str = "doc_id", text_col: str = "text", dims: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` with their shard, without a shuffle; equal rows at a border are dealt by their position in the input."""
    facts = docs.sparkSession.createDataFrame([], docs.schema).select(*_facts(docs, id_col, text_col, dims))
    marked = docs.withColumn("_facts", F.struct(*_facts(docs, id_col, text_col, dims)))
    own = {c: F.col(f"_facts.{c}") for c in facts.columns}
    h = F.shiftright(F.xxhash64(own["id"], own["size"], own["crc"], *[own[d] for d in _dims(facts)]), 1)
    node = node_of(tree, [own[d] for d in _dims(facts)], h, F.monotonically_increasing_id() % CHUNKS)
    return marked.withColumn(out, _at(tree.shard, node).cast("int")).drop("_facts")


def write_shards(docs: DataFrame, path: str, tree: Tree, files: int = 1, id_col: str = "doc_id", text_col: str = "text", dims: list[str] | None = None) -> None:
    """One folder ``shard=N`` per shard with all columns, in ``files`` files each."""
    placed = place(docs, tree, "shard", id_col, text_col, dims)
    placed.repartition("shard", F.pmod(F.xxhash64(id_col, text_col), F.lit(files))).write.partitionBy("shard").parquet(path)
