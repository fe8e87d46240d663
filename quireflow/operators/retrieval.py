"""Chunks, nearest neighbours, citations, key-value lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import each


def chunk_text(df: DataFrame, text: str = "text", size: int = 800, overlap: int = 100) -> DataFrame:
    """Overlapping character windows over whole texts; the last one ends at the text's end."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the chunk")
    step = size - overlap
    keep = [c for c in df.columns if c != text]
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(step))
    e = df.filter(F.length(text) > 0).select(*keep, F.col(text).alias("_t"), F.posexplode(starts).alias("chunk_no", "start"))
    return e.select(
        *keep, F.col("chunk_no").cast("long").alias("chunk_no"), F.col("start").cast("long").alias("start"),
        F.least(F.col("start") + size, F.length("_t")).cast("long").alias("end"), F.substring("_t", F.col("start") + 1, F.lit(size)).alias("chunk"),
    )


def knn(vectors: DataFrame, questions: list[list[float]], k: int = 5, node: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k vectors most similar (cosine) to each question: ``(question, node, similarity, rank)``.

    Every task keeps its own k best per question, so what is shuffled does not grow with the
    vectors. Questions are asked by people: a short list carried with the task.
    """
    q = np.asarray(questions, dtype="float64")
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

    def best(batches):
        keep: list[pd.DataFrame] = []
        for pdf in batches:
            m = np.stack(pdf["v"].to_numpy()).astype("float64")
            sims = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)) @ q.T
            for j in range(sims.shape[1]):
                keep.append(pd.DataFrame({"question": j, "id": pdf["id"], "similarity": sims[:, j]}))
            merged = pd.concat(keep).sort_values(["question", "similarity", "id"], ascending=[True, False, True])
            keep = [merged.groupby("question").head(k)]
        yield from keep

    local = vectors.select(F.col(node).alias("id"), F.col(vector).alias("v")).mapInPandas(best, "question long, id long, similarity double")
    w = Window.partitionBy("question").orderBy(F.desc("similarity"), "id")
    ranked = local.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    return ranked.withColumnRenamed("id", node)


def cite_chunks(top: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Attach the source page and span to retrieved chunks."""
    cite = F.format_string("[doc %d, p. %d]", F.col("doc_id"), F.col("page_no") + 1)
    return top.join(chunks, key).withColumn("citation", cite)


def key_value_pairs(df: DataFrame, text: str = "text") -> DataFrame:
    """``key: value`` lines of each text, in order."""
    keep = [c for c in df.columns if c != text]
    lines = each(df, keep, F.split(text, "\n", -1), "_l", "line_no")
    pattern = r"^\s*([^:\n]*[^:\s])\s*:\s+(\S.*?)\s*$"
    hit = lines.filter(F.rlike("_l", F.lit(pattern)))
    return hit.select(*keep, F.col("line_no").cast("long").alias("line_no"), F.regexp_extract("_l", pattern, 1).alias("key"), F.regexp_extract("_l", pattern, 2).alias("value"))
