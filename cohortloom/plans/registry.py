"""All registered queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

SUBJECTS = ("quality", "probes", "lookups", "hierarchy", "samples", "scoring",
            "models", "neighbours", "texts", "arrivals")


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for subject in SUBJECTS:
        module = import_module(f"{__package__}.{subject}")
        for name, query in module.QUERIES.items():
            if name in found:
                raise ValueError(f"query registered twice: {name}")
            found[name] = query
    return found
