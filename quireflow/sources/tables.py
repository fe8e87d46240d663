"""Typed readers for the parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Scan one table; naming the columns wanted keeps the scan to those columns."""
    if name not in TABLES:
        raise ValueError(f"unknown table: {name}")
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return spread(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df


def table_bytes(spark: SparkSession, folder: str, name: str) -> int:
    """Bytes of a table's files, wherever Spark reads them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


# Tables whose rows are heavy to process, and the unique key to spread them by.
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core when a scan has fewer splits than the cluster has cores.

    Inputs of many splits are left as they are: no shuffle at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df.rdd.getNumPartitions() < cores
    return df.repartition(cores, key) if few and key in df.columns else df


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with their JSON properties parsed against a fixed schema."""
    from pyspark.sql import functions as F

    df = read_table(spark, folder, "events")
    return df.withColumn("props", F.from_json("props", "k bigint"))
