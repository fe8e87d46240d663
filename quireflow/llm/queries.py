"""The registered queries: each applies one operator to its whole table; SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe,
    conversations,
    decontaminate,
    exact_dedup,
    html_extract,
    language_id,
    secrets,
    shards,
    simhash,
    substring_dedup,
    toxicity,
    url_filter,
    whitening,
)
from .samples import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    "op1_exact_dedup",
    r"""
    WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
    g AS (SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, text_sha256 FROM n WINDOW w AS (PARTITION BY text_sha256))
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
)
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query("op6_simhash_near_dedup")
def op6_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path, pattern = _tokenizer()
    return byte_bpe.digests(byte_bpe.round_trip(table(spark, folder, "documents"), path, pattern))


@query("op8_html_extract")
def op8_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    found = html_extract.extract(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language_id.identify(docs, language_id.fit(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = toxicity.assess(docs, toxicity.fit(docs, table(spark, folder, "labels")))
    spans = F.concat_ws(",", F.transform("offending", lambda s: F.concat_ws(":", s["start"], s["end"])))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), spans.alias("offending"))


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query("op5_url_filter")
def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"), URL_RULES, url_filter.fit(spark))


@query("op3_secret_scan")
def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents"))
    counts = [secrets.kind_count(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    digest = F.sha2(secrets.span_texts(F.col("base")).cast("binary"), 256).alias("base_sha256")
    spans = secrets.span_texts(F.concat("base", "random")).alias("spans")
    return found.select("doc_id", *counts, digest, spans)


@query("op7_decontaminate")
def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op2_substring_dedup")
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.classes(table(spark, folder, "documents"))
    spans = F.transform("repeats", lambda s: F.concat_ws(":", s["start"], s["end"], s["of"]))
    return found.select("doc_id", "class_id", "n_links", F.array_join(spans, ",").alias("repeats"))


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, folder, "conversations")))


@query("op12_sharding")
def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    found = shards.assign(table(spark, folder, "documents"), shards=40)
    return found.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))
