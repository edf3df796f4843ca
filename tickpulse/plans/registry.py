"""Registry of named queries: a Spark builder plus, where SQL can express it,
the equivalent DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql)
        return fn

    return deco


def load_all() -> dict[str, Entry]:
    # importing the catalog modules fills the registry
    from tickpulse.plans import (catalog_flows, catalog_relational, catalog_text,  # noqa: F401
                                 catalog_training)

    return REGISTRY
