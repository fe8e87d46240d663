"""Parent links over any depth: roots, paths, depth-first order.

Links are followed by pointer doubling, so a chain of n takes log2(n) rounds. Every round is
checkpointed: the plan does not grow, and a lost executor costs one round.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .scan import apart, dense_index


# Fixed value: levels of a qualified field name.
NAME_LEVELS = 32


def _jump(nodes: DataFrame) -> DataFrame:
    """One doubling round over ``(k, id, ptr, done)``; only open nodes are joined."""
    open_ = nodes.filter("NOT done")
    to = nodes.select("k", F.col("id").alias("ptr"), F.col("ptr").alias("_next"), F.col("done").alias("_done"))
    moved = open_.join(apart(to), ["k", "ptr"]).select("k", "id", F.col("_next").alias("ptr"), F.col("_done").alias("done"))
    return checkpointed(nodes.filter("done").unionByName(moved))


def _chase(nodes: DataFrame, rounds: int) -> DataFrame:
    for _ in range(rounds):
        if nodes.filter("NOT done").isEmpty():
            break
        nodes = _jump(nodes)
    return nodes


def pointer_roots(df: DataFrame, key: str, node: str, parent: str) -> DataFrame:
    """``(key, node, root)``: the end of each parent chain.

    A parent that is absent ends the chain at the node itself. A node on a cycle is its own
    root; a chain that runs into a cycle ends at the first cycle node it meets.
    """
    n = df.select(F.col(key).alias("k"), F.col(node).alias("id"), F.col(parent).alias("up"))
    ids = n.select("k", F.col("id").alias("up"), F.lit(True).alias("_there"))
    linked = n.join(apart(ids), ["k", "up"], "left")
    root = F.col("_there").isNull()
    start = checkpointed(linked.select("k", "id", F.when(root, F.col("id")).otherwise(F.col("up")).alias("ptr"), root.alias("done")))
    # A node pointing at a root is finished once its pointer is known to be one.
    largest = start.filter("NOT done").groupBy("k").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    rounds = math.ceil(math.log2(largest + 1)) + 1
    out = _chase(start, rounds)
    if not out.filter("NOT done").isEmpty():
        # After this many doublings only cycle nodes are pointed at by what is still open.
        cyclic = out.filter("NOT done").select("k", F.col("ptr").alias("id")).distinct().withColumn("_c", F.lit(True))
        cut = start.join(checkpointed(cyclic), ["k", "id"], "left")
        on = F.col("_c").isNotNull()
        cut = cut.select("k", "id", F.when(on, F.col("id")).otherwise(F.col("ptr")).alias("ptr"), (F.col("done") | on).alias("done"))
        out = _chase(checkpointed(cut), rounds)
    return out.select(F.col("k").alias(key), F.col("id").alias(node), F.col("ptr").alias("root"))


def node_paths(df: DataFrame, key: str, node: str, parent: str, label: Column, levels: int | None = None) -> DataFrame:
    """``(key, node, path)``: labels from the root down to the node; with ``levels``, the last so many of them.

    Without ``levels`` the links must hold no cycle.
    """
    n = df.select(F.col(key).alias("k"), F.col(node).alias("id"), F.col(parent).alias("up"), F.array(label).alias("path"))
    cur = checkpointed(n)
    covered = 1
    while (levels is None or covered < levels) and not cur.filter("up IS NOT NULL").isEmpty():
        above = cur.select("k", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        j = cur.join(apart(above), ["k", "up"], "left")
        cur = checkpointed(j.select("k", "id", F.col("_up").alias("up"), F.concat(F.coalesce("_path", F.expr("filter(path, x -> false)")), "path").alias("path")))
        covered *= 2
    path = F.col("path") if levels is None else F.slice("path", F.greatest(F.size("path") - levels, F.lit(0)) + 1, levels)
    return cur.select(F.col("k").alias(key), F.col("id").alias(node), path.alias("path"))


def qualified_names(fields: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, field_id, qualified)``: partial names joined by dots, empty ones skipped; a name has at most 32 levels, cycles or not."""
    paths = node_paths(fields, key, "field_id", "parent_id", F.col("t"), NAME_LEVELS)
    return paths.select(key, "field_id", F.array_join(F.filter("path", lambda t: t.isNotNull() & (t != "")), ".").alias("qualified"))


def outline_flatten(outline: DataFrame) -> DataFrame:
    """Bookmarks in depth-first order: ``position`` from 0 and ``depth``; siblings by ``seq``, then ``node_id``.

    A node whose parent is missing is a root, and so is each node on a cycle: the link to its parent is cut.
    """
    ends = pointer_roots(outline, "doc_id", "node_id", "parent_id").where("root = node_id").select("doc_id", "node_id", F.lit(True).alias("_root"))
    cut = outline.join(apart(ends), ["doc_id", "node_id"], "left").withColumn("_up", F.when(F.col("_root").isNull(), F.col("parent_id")))
    paths = node_paths(cut, "doc_id", "node_id", "_up", F.struct("seq", "node_id"))
    j = outline.join(apart(paths), ["doc_id", "node_id"]).withColumn("depth", (F.size("path") - 1).cast("long"))
    # Blocks are subtrees three levels down, so that one root with everything below it is still split.
    flat = dense_index(j, ["doc_id"], F.slice("path", 1, 3), [F.col("path")], "position")
    return flat.drop("path")


def outline_count(outline: DataFrame) -> DataFrame:
    return outline.groupBy("doc_id").agg(F.count(F.lit(1)).alias("bookmarks"))
