"""Streams where a table is a folder of files, and in sessions without settings of their own."""

import os

import pytest

from quireflow import plans

FOLDER = "/root/testdata/sf0.001"
HDFS = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


@pytest.mark.parametrize("name", ["edit_history_event_time", "open_documents_stream"])
def test_keyed_state_brings_its_store(spark, name):
    bare = spark.newSession()
    bare.conf.set("spark.sql.streaming.stateStore.providerClass", HDFS)
    want = {"edit_history_event_time": "edit_history", "open_documents_stream": "open_documents"}[name]
    got = plans.queries()[name](bare, FOLDER)
    every = {tuple(r) for r in plans.queries()[want](spark, FOLDER).select(*got.columns).collect()}
    rows = {tuple(r) for r in got.collect()}
    assert rows and rows <= every


@pytest.mark.parametrize("name", ["pattern_windows_stream", "watch_folder", "edit_history_stream", "debounce_stream"])
def test_a_folder_of_files_is_one_table(spark, tmp_path, name):
    for t in ("documents", "events"):
        os.makedirs(f"{tmp_path}/{t}.parquet")
        rows = spark.read.parquet(f"{FOLDER}/{t}.parquet")
        rows.repartition(3).write.mode("append").parquet(f"{tmp_path}/{t}.parquet")
    got = plans.queries()[name](spark, str(tmp_path)).collect()
    want = plans.queries()[name](spark, FOLDER).collect()
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, want))
