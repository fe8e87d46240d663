"""The list of queries: each is one Spark function and, where SQL can say it, one oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import SQL_VIEWS, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HANDLES: dict[str, str] = {}


def with_views(sql: str, names: tuple[str, ...]) -> str:
    """Prefix ``sql`` with the views it needs, dependencies first."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for dep in SQL_VIEWS[name][0]:
            need(dep)
        if name not in wanted:
            wanted.append(name)

    for n in names:
        need(n)
    if not wanted:
        return sql
    body = ",\n".join(f"{n} AS ({SQL_VIEWS[n][1]})" for n in wanted)
    text = sql.strip()
    if text.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {body},\n{text[15:]}"
    if text.upper().startswith("WITH "):
        return f"WITH {body},\n{text[5:]}"
    return f"WITH {body}\n{text}"


def query(name: str, handle: str, sql: str | None = None, views: tuple[str, ...] | str = ()):
    """Register ``fn(views) -> DataFrame`` under ``name`` for the survey handle(s) given."""
    if isinstance(views, str):
        views = tuple(views.split())

    def add(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: fn(Views(spark, folder))
        HANDLES[name] = handle
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return fn

    return add
