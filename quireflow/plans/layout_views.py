"""Pagination and the derived page geometry itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query


@query("paginate_text", "T14", "SELECT doc_id, page_no, n_bytes, sha256(text) AS digest, rotate, width, height FROM doc_pages", "doc_pages")
def paginate(v):
    return v.doc_pages().select("doc_id", "page_no", "n_bytes", F.sha2("text", 256).alias("digest"), "rotate", "width", "height")


@query("text_runs", "S4", 'SELECT * FROM runs', "runs")
def text_runs(v):
    r = v.runs()
    return r.withColumn("render_mode", F.col("render_mode").cast("int"))


@query("ruling_lines", "S4", "SELECT * FROM rules", "rules")
def ruling_lines(v):
    return v.rules()
