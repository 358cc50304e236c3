"""Registered queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from drayage.session import spread, tune

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    run: QueryFn
    sql: str | None


REGISTRY: dict[str, Registered] = {}

# The tables of a folder.
ALL_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


class Tables:
    """The tables of one folder, loaded on first use: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._loaded: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def spread(self, name: str) -> DataFrame:
        """A table dealt to all cores, for costly work per row."""
        return spread(getattr(self, name))

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._loaded:  # reading looks up the schema in a file
            self._loaded[name] = self.spark.read.parquet(self.path(name))
        return self._loaded[name]


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``fn(tables) -> DataFrame`` under ``name``.

    ``sql`` is the same result as SQL over the same tables; None where SQL
    cannot express it.
    """

    def wrap(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(tune(spark), folder))

        REGISTRY[name] = Registered(run, sql)
        return fn

    return wrap
