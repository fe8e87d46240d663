"""Running operators over lists and folders of documents, one outcome per document."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


@dataclass(frozen=True)
class Step:
    """A named DataFrame step; ``refuse`` gives a document's error text, or null to go on."""

    name: str
    apply: Callable[[DataFrame], DataFrame]
    refuse: Callable[[], Column] | None = None


def batch(documents: DataFrame, steps: list[Step]) -> DataFrame:
    """Apply the steps to every document. One that a step refuses keeps its columns as they were,
    skips the rest, and says why in ``error``; the job goes on. ``status`` is done or failed.

    A step adds or replaces columns and keeps one row per document.
    """
    df = documents.withColumn("error", F.lit(None).cast("string")).withColumn("failed_step", F.lit(None).cast("string"))
    for s in steps:
        if s.refuse is not None:
            why = F.when(F.col("error").isNull(), s.refuse())
            df = df.withColumn("_why", why)
            df = df.withColumn("failed_step", F.when(F.col("_why").isNotNull(), s.name).otherwise(F.col("failed_step")))
            df = df.withColumn("error", F.coalesce("error", "_why")).drop("_why")
        before = df.columns
        kept = {c: f"_was_{c}" for c in before if c not in ("error", "failed_step")}
        out = s.apply(df.withColumns({k: F.col(c) for c, k in kept.items()}))
        ok = F.col("error").isNull()
        restored = {c: F.when(ok, F.col(c)).otherwise(F.col(k)) for c, k in kept.items()}
        added = {c: F.when(ok, F.col(c)) for c in out.columns if c not in before and c not in kept.values()}
        df = out.withColumns({**restored, **added}).drop(*kept.values())
    return df.withColumn("status", F.when(F.col("error").isNull(), "done").otherwise("failed"))


def watch_folder(
    spark: SparkSession, path: str, out: str, schema, process: Callable[[DataFrame], DataFrame], glob: str = "*",
    fmt: str = "parquet", checkpoint: str | None = None, once: bool = False,
):
    """Apply ``process`` to every new file of a folder and append the result to ``out``.

    The checkpoint remembers files already taken, and a batch that is retried replaces
    its own output, so each file counts once. Returns the running query.
    """
    source = spark.readStream.schema(schema).option("pathGlobFilter", glob).format(fmt).load(path)

    def each(df: DataFrame, batch_id: int) -> None:
        process(df).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint or f"{out}_checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return its table.

    Append results are written as they come; complete results replace the ones before.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/stream_{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").start(f"{base}/table")
    else:
        q = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/table")).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/table")
