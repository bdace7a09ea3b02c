"""All queries over the reference relations, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import images, kernels, records, series, shapes, threads

_BOOKS = [m.book for m in (threads, shapes, images, series, records, kernels)]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for book in _BOOKS for name, fn in book.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for book in _BOOKS for name, sql in book.oracles.items()}
