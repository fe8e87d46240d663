"""Sides of joins that grow with the input are not sent whole to the driver."""

import pytest

from quireflow import plans
from quireflow.operators.hierarchy import node_paths
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["merge_fields", "merge_outline", "merge_links", "insert_fields"])
def test_merging_broadcasts_no_table(spark, name):
    plan = plans.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_paths_do_not_broadcast(spark):
    n = spark.range(200).select(F.lit(1).alias("k"), F.col("id").alias("n"), (F.col("id") - 1).alias("up"))
    n = n.withColumn("up", F.when(F.col("n") > 0, F.col("up")))
    got = {r["n"]: len(r["path"]) for r in node_paths(n, "k", "n", "up", F.col("n")).collect()}
    assert got == {i: i + 1 for i in range(200)}


@pytest.mark.parametrize("name", ["insert_fields", "insert_links"])
def test_pages_are_laid_out_once(spark, name):
    """No branch of the plan reads texts again."""
    plan = plans.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "text:string" not in plan and "page_no:bigint" in plan
