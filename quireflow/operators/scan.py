"""Running totals and ranks that never gather a whole group in one task.

A window over a key runs each key in a single task. Here a group is cut into blocks by
value (say, 65,536 page numbers each): block totals are combined before the shuffle, only the
totals are scanned per key, and the exact running value inside a block is added to what came
before it. Blocks come from the data, not from partition ids, so a recomputed
task gives the same answer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

BLOCK = 1 << 16


def block_of(order: Column | str, width: int = BLOCK) -> Column:
    col = F.col(order) if isinstance(order, str) else order
    return F.floor(col / F.lit(width))


def running(
    df: DataFrame,
    keys: list[str],
    block: Column,
    order: list[Column],
    aggs: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Add running columns per key. ``aggs`` maps a name to ``(kind, expression)``.

    Kinds: ``sum``, ``max``, ``last`` (last non-null). ``block`` must not decrease along
    ``order``. With ``inclusive=False`` a row sees only the rows before it.
    """
    bkeys = [*keys, "_blk"]
    tagged = df.withColumn("_blk", block)
    for i, (_, expr) in enumerate(aggs.values()):
        tagged = tagged.withColumn(f"_v{i}", expr)
    rank = F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])

    partials, priors = [], []
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    for i, (name, (kind, _)) in enumerate(aggs.items()):
        v = F.col(f"_v{i}")
        if kind == "sum":
            partials.append(F.sum(v).alias(f"_t{i}"))
            priors.append(F.sum(f"_t{i}").over(before).alias(f"_p{i}"))
        elif kind == "max":
            partials.append(F.max(v).alias(f"_t{i}"))
            priors.append(F.max(f"_t{i}").over(before).alias(f"_p{i}"))
        elif kind == "last":
            partials.append(F.max_by(v, F.when(v.isNotNull(), rank)).alias(f"_t{i}"))
            priors.append(F.last(f"_t{i}", ignorenulls=True).over(before).alias(f"_p{i}"))
        else:
            raise ValueError(f"unknown running kind: {kind}")
    totals = tagged.groupBy(*bkeys).agg(*partials).select(*bkeys, *priors)

    end = Window.currentRow if inclusive else -1
    within = Window.partitionBy(*bkeys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    out = tagged.join(apart(totals), bkeys, "left")
    for i, (name, (kind, _)) in enumerate(aggs.items()):
        p, v = F.col(f"_p{i}"), F.col(f"_v{i}")
        if kind == "sum":
            value = F.coalesce(p, F.lit(0)) + F.coalesce(F.sum(v).over(within), F.lit(0))
        elif kind == "max":
            value = F.greatest(p, F.max(v).over(within))
        else:
            value = F.coalesce(F.last(v, ignorenulls=True).over(within), p)
        out = out.withColumn(name, value)
    drop = ["_blk", *[f"{c}{i}" for i in range(len(aggs)) for c in ("_v", "_p")]]
    return out.drop(*drop)


def dense_index(
    df: DataFrame, keys: list[str], block: Column, order: list[Column], out: str
) -> DataFrame:
    """0-based rank of each row within its key, in ``order``."""
    ranked = running(df, keys, block, order, {out: ("sum", F.lit(1).cast("long"))})
    return ranked.withColumn(out, F.col(out) - 1)


def with_group_total(df: DataFrame, keys: list[str], total: Column, out: str) -> DataFrame:
    """Join one aggregate per key back on; partial sums are combined before the shuffle."""
    return df.join(df.groupBy(*keys).agg(total.alias(out)), keys, "left")


def apart(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: sorted and merged in tasks, never sent whole to the driver and to every executor.

    Spark guesses a table's size from its compressed file, so what a query makes of it may look small enough to broadcast.
    """
    return df.hint("merge")


def global_offsets(groups: DataFrame, order: list[str], size: str, out: str) -> DataFrame:
    """Exclusive prefix sum of ``size`` over all rows in ``order`` without a one-task sort.

    ``groups`` holds one row per group. Rows are range-partitioned and checkpointed, so the
    per-partition sums and the numbering see the same partitions even when a task is retried.
    Only one number per partition is combined centrally.
    """
    placed = checkpointed(groups.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    # One number per range partition is summed up in order; their count follows the cluster, not the data.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_pid").agg(F.sum(size).alias("_sum"))
    base = sums.select("_pid", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(base, "_pid").withColumn(out, F.col("_base") + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop("_pid", "_base")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
