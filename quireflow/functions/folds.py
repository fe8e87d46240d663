"""Row-local folds over arrays, built only from Spark's own array functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A fold appends into a small buffer and moves full buffers aside, so the copying done by
# each append stays bounded and a long array costs linear, not quadratic, time.
_BUFFER = 256
# Up to so many entries counting takes fewer steps of an expression than halving.
_SHORT = 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``.

    A plain reuse of the column inside a lambda would be evaluated per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_collect(
    items: Column,
    state: Column,
    state_type: str,
    out_type: str,
    step: Callable[[Column, Column], tuple[Column, Column]],
) -> Column:
    """Left fold that also emits values: ``step(state, item) -> (state, value or null)``.

    Returns the array of the non-null values in order.
    """
    empty = F.array().cast(f"array<{out_type}>")
    start = F.struct(
        state.cast(state_type).alias("s"),
        F.array().cast(f"array<array<{out_type}>>").alias("done"),
        empty.alias("cur"),
    )

    def merge(acc: Column, item: Column) -> Column:
        new_state, value = step(acc["s"], item)
        pair = F.struct(new_state.cast(state_type).alias("s"), value.cast(out_type).alias("v"))

        def push(p: Column) -> Column:
            full = F.size(acc["cur"]) >= _BUFFER
            none = p["v"].isNull()
            return F.struct(
                p["s"].alias("s"),
                F.when(~none & full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
                F.when(none, acc["cur"])
                .when(full, F.array(p["v"]))
                .otherwise(F.concat(acc["cur"], F.array(p["v"])))
                .alias("cur"),
            )

        return let(pair, push)

    return F.aggregate(
        items, start, merge, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["cur"])))
    )


def bisect(sorted_array: Column, x: Column, right: bool = False) -> Column:
    """How many entries of a sorted array are below ``x`` (with ``right``, at most ``x``): a long array is halved step by step, a short one counted."""
    few = F.size(F.filter(sorted_array, lambda at: at <= x if right else at < x))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(sorted_array) + 1)).cast("int"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["lo"] + acc["hi"], 1)
        at = F.get(sorted_array, middle)
        below = at <= x if right else at < x
        closed = acc["lo"] >= acc["hi"]
        lo = F.when(closed | ~below, acc["lo"]).otherwise(middle + 1)
        hi = F.when(closed | below, acc["hi"]).otherwise(middle)
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.size(sorted_array).alias("hi"))
    return F.when(F.size(sorted_array) <= _SHORT, few).otherwise(F.aggregate(steps, start, halve, lambda acc: acc["lo"]))


def each(df: DataFrame, keep: list, array: Column, item: str, pos: str = "_pos") -> DataFrame:
    """One row per array element, with its position.

    A plain explode makes the optimizer test ``size(array) > 0`` below it, which computes
    a costly array twice. The outer form is not rewritten so; its empty rows are dropped
    after it.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, item)).filter(F.col(pos).isNotNull())
