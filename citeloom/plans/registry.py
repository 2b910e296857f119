"""All registered queries and their SQL counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .catalog import QUERIES, SQL

MODULES = ("graph", "ranking", "lookup", "aggregate", "text", "matching", "changes", "documents", "stateful", "printed", "whole", "selection", "entries", "wholetext", "providers", "merging", "resolution", "links", "words", "records", "evaluation", "writes", "merged", "grounding", "mentions", "audits", "keyed", "pairs")
for _m in MODULES:
    importlib.import_module(f"{__package__}.{_m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
