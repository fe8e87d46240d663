import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def docs(spark):
    """Documents from ``(doc_id, text)`` pairs, with columns whose names clash with the operators' own."""

    def make(rows, schema="doc_id long, text string"):
        frame = spark.createDataFrame(rows, schema)
        return frame.selectExpr("*", "'x' AS digest", "1 AS fp", "2 AS kept", "3 AS component", "4 AS n", "5 AS key", "6 AS score", "7 AS node")

    return make

