"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str | Column) -> Column:
    """True where crc32 of the id as text is divisible by five; rows without an id are held out too."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def smallest_hashes(rows: DataFrame, id_col: str, limit: int) -> DataFrame:
    """The rows whose hashed id is among the ``limit`` smallest: the same rows on every run, spread over the whole table."""
    h = F.xxhash64(F.col(id_col), F.lit(7))
    last = rows.select(h.alias("h")).orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    return rows.where(F.lit(False) if last is None else h <= last)
