"""The registered queries: each pairs a DataFrame query with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def catalogue() -> dict[str, Query]:
    from . import files, package, pages, structure

    return pages.QUERIES | structure.QUERIES | package.QUERIES | files.QUERIES
