"""Registering queries together with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .relations import relation

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, *names: str, sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
        """The function gets the session, unless it takes none, and the relations ``names``; its name names the query."""

        def wrap(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return fn(*([] if names else [spark]), *[relation(spark, sf_dir, n) for n in names])

            self.queries[fn.__name__] = run
            if sql is not None:
                self.oracles[fn.__name__] = sql
            return fn

        return wrap


def r(column: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero: both engines agree on what remains."""
    return F.round(column, digits) + 0.0
