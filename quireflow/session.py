"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings every quireflow job relies on; sizes stay with the cluster's own config."""
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(*_STATE_STORE)
    )


def keyed_state(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB store; a session that was not configured gets it before its stream starts."""
    spark.conf.set(*_STATE_STORE)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; only a single-process session that names none gets its own."""
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="spark-quireflow-")
    spark.sparkContext.setCheckpointDir(shared)
    return shared


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint that outlives any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def written(df: DataFrame) -> DataFrame:
    """Rows that several branches start from, as a table in the shared checkpoint folder: they are made once, where a checkpoint makes them twice."""
    path = f"{checkpoint_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
