"""Exact deduplication that no large group of copies can slow down.

Copies are combined three times, always by digest and full content: inside each task (the
map side of the first aggregation), then per salt, then over all salts. Only one row per
different text is left for each step, so a text that makes up a third of the corpus is at most one row
per task and, after that, one row per salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["digest", "check", "length"]


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _content_key(norm: Column, digest: Callable[[Column], Column]) -> list[Column]:
    return [digest(norm).alias("digest"), F.xxhash64(norm).alias("check"), F.length(norm).alias("length")]


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, digest, check, length)``, one row per row of ``docs``.

    Texts are equal when identical after ``normalised``; a null text equals an empty one. The row with the
    smallest id stays. Of rows that repeat both id and text exactly one is kept; rows with a null id stay only if no other row
    of their group has an id, and then one of them. An empty table gives an empty result; other columns are ignored.

    Rows find their group by digest, a second hash and the length. Should two different texts ever agree in all three,
    the job fails rather than merge them: the winners, combined by content, show it.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    key = _content_key(F.col("norm"), digest)
    salted = rows.select("doc_id", "norm", key[0], (F.spark_partition_id() % salts).alias("salt"))
    salted = salted.groupBy("digest", "salt", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    winners = salted.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    winners = winners.select("digest", *_content_key(F.col("norm"), digest)[1:], "keep_id", "group_size")
    # Grouped by the key as one value, so that the join below deals both of its sides anew and can split a hot key.
    winners = winners.groupBy(F.struct(*KEY).alias("key")).agg(
        F.count(F.lit(1)).alias("contents"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    ).select("key.*", "contents", "keep_id", "group_size")
    clash = F.raise_error(F.concat(F.lit("two texts share all hashes: "), F.col("digest").cast("string")))
    winners = winners.withColumn("group_size", F.when(F.col("contents") > 1, clash.cast("long")).otherwise(F.col("group_size")))
    members = rows.select("doc_id", *key).groupBy("doc_id", *KEY).agg(F.count(F.lit(1)).alias("times"))
    out = members.join(winners.drop("contents"), KEY).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), *KEY)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns."""
    # The id and the content key as one value: nulls compare equal in it, and one exchange serves the join and the aggregate.
    mine, theirs = "_exact_dedup_key", "_exact_dedup_kept"
    tagged = docs.withColumn(mine, F.struct(F.col(id_col).alias("doc_id"), *_content_key(normalised(F.col(text_col)), sha256)))
    kept = exact_groups(docs, id_col, text_col, salts).where("kept").select(F.struct("doc_id", *KEY).alias(theirs))
    return tagged.join(kept, tagged[mine] == kept[theirs], "left_semi").dropDuplicates([mine]).drop(mine)
