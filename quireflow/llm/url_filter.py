"""URL filtering: rules by host and path, and a logistic regression on hashed character n-grams for the rest.

Scoring is one row expression of built-in functions. The weights, fitted to a small labelled table in numpy on
the driver, are an array literal of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 8192
SIZES = (3, 4)

# The small labelled table, host names in three forms of url each, so that the forms themselves say nothing.
BLOCKED = (
    "cheap-pills", "cheap-meds", "pills-online", "pharmacy-discount", "buy-viagra", "casino-win", "online-casino", "casino-slots", "win-poker", "slots-bonus", "free-bets",
    "bet-win", "sports-betting", "ads-track", "track-ads", "adserver", "click-track", "ad-click", "popads", "free-xxx", "adult-cams", "sexy-dating", "replica-watches",
    "payday-loans", "free-money", "lottery-winner", "crack-keygen", "warez-torrent", "free-win-bonus", "cheap-loans",
)
ALLOWED = (
    "library", "northern-news", "weblog", "documents", "encyclopedia", "university", "museum", "weather", "recipes", "garden", "science", "school", "city-council", "health",
    "forum", "travel", "music", "cinema", "coding", "bookshop", "journal", "review", "history", "nature", "people", "farm", "mountain", "theatre", "station", "thenation",
    "another", "tribune", "herald", "nation", "than", "therein", "thousand", "tennis", "theory", "orchestra", "parliament", "environment", "month", "athlete", "thirteenth", "tent",
)
FORMS = ("{}.example.com/en/123", "www.{}.example.org/fr/4567.html", "m.{}.example.net/de/89/", "blog.{}.example.com/es/1000", "{}.example.org/de/7", "{}.example.net/es/88.html")


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, with A-Z lower-cased, and path; both empty for a null url and one without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def _bucket_at(line: Column, kind: str, n: int):
    def bucket(at: Column) -> Column:
        return F.pmod(F.xxhash64(F.concat(F.lit(kind), F.substring(line, at, n))), F.lit(BUCKETS)).cast("int")

    return bucket


def _buckets(host: Column, path: Column) -> Column:
    """Buckets of the n-grams of host and path, each between border marks; host and path hash apart."""
    parts = []
    for kind, text in (("h", host), ("p", path)):
        line = F.concat(F.lit("^"), text, F.lit("$"))
        for n in SIZES:
            at = F.sequence(F.lit(1), F.greatest(F.length(line) - (n - 1), F.lit(1)))
            parts.append(F.transform(at, _bucket_at(line, kind, n)))
    return F.concat(*parts)


def train(bags: list[list[int]], labels: list[int], epochs: int = 800, rate: float = 4.0, decay: float = 3e-4) -> Model:
    """Logistic regression by gradient ascent; a text's features are the shares of its buckets, scaled by the root of their number."""
    x = np.zeros((len(bags), BUCKETS))
    for row, bag in zip(x, bags, strict=True):
        np.add.at(row, bag, 1 / np.sqrt(len(bag)))
    y, w, bias = np.array(labels, float), np.zeros(BUCKETS), 0.0
    for _ in range(epochs):
        g = y - 1 / (1 + np.exp(-(x @ w + bias)))
        w += rate * (x.T @ g / len(y) - decay * w)
        bias += rate * g.mean()
    return Model(w, float(bias))


def fit(spark: SparkSession, blocked: tuple[str, ...] = BLOCKED, allowed: tuple[str, ...] = ALLOWED, forms: tuple[str, ...] = FORMS) -> Model:
    """Fit to a small labelled table, at most a few thousand urls; its n-grams are cut and hashed by the expression that scores."""
    quoted = ", ".join(f"('{form.format(host)}', {y})" for y, hosts in ((1, blocked), (0, allowed)) for host in hosts for form in forms)
    rows = spark.sql(f"SELECT * FROM VALUES {quoted} AS t(url, label)")
    host, path = host_and_path(F.concat(F.lit("http://"), F.col("url")))
    got = rows.select("url", "label", _buckets(host, path).alias("bag")).orderBy("label", "url").collect()
    return train([r["bag"] for r in got], [r["label"] for r in got])


def block_probability(host: Column, path: Column, model: Model) -> Column:
    numbers = ",".join(f"{v:.9e}D" for v in model.weights.tolist())
    weights = F.expr(f"array({numbers})")
    bag = _buckets(host, path)
    total = F.aggregate(bag, F.lit(0.0), lambda s, b: s + F.get(weights, b))
    return 1 / (1 + F.exp(-(total / F.sqrt(F.size(bag)) + F.lit(model.bias))))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """``(action, rule)`` of the longest rule that fits, null without one; of equally long ones the first listed wins.

    ``rules``: (action, host and path). A rule fits its host and all subdomains if the path starts with the rule's.
    """
    action = text = None
    for kind, rule in sorted(rules, key=lambda r: -len(r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        action = F.when(fits, kind) if action is None else action.when(fits, kind)
        text = F.when(fits, rule) if text is None else text.when(fits, rule)
    if action is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return action, text


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: Model, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)``, one row per row of ``pages``, in one pass without a shuffle.

    The verdict is the rule's, else ``block`` where the model's probability is 0.5 or more, else ``allow``. A null url
    and one without ``://`` have an empty host and path and are judged by the model like any other. Repeated rows and null ids stay; other columns are ignored.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    action, rule = matching_rule(F.col("host"), F.col("path"), rules)
    score = block_probability(F.col("host"), F.col("path"), model)
    rows = rows.select("*", rule.alias("rule"), action.alias("action"), score.alias("score"))
    verdict = F.coalesce("action", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
