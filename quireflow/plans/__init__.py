"""Registered queries."""

from __future__ import annotations

import importlib

_MODULES = ("layout_views", "text_search", "page_layout", "page_algebra", "assembling", "forms_comments", "web_sources", "reports", "edit_streams", "scalar_functions")


def _load():
    from . import registry

    for m in _MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return registry


def queries():
    return dict(_load().QUERIES)


def oracle_sql():
    return dict(_load().ORACLES)


def handles():
    """Query name -> handle(s) in the operator inventory."""
    return dict(_load().HANDLES)
