"""Named queries over the given tables: each returns one flat, stably named table."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .adapters import Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def flat(df: DataFrame) -> DataFrame:
    """Dates as ISO text, arrays joined by ``|`` and counts as bigint."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def as_callable(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(fn(Tables(spark, sf_dir)))
    run.__name__ = fn.__name__
    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalog  # noqa: F401  (registers the queries)
    return {name: as_callable(fn) for name, fn in QUERIES.items()}
