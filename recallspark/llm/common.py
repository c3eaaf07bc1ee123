"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import run_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once below ``spark.checkpoint.dir`` and read from there: cuts the lineage,
    outlives lost executors and gives the planner a true size."""
    path = run_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(c, UPPER, UPPER.lower())


def batches(rows: Iterable[pa.RecordBatch], text: str, max_chars: int = 2_000_000
            ) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Record batches cut so that one holds about ``max_chars`` bytes of text, with the texts
    (null: empty). A single longer text stays whole."""
    for batch in rows:
        texts = ["" if t is None else t for t in batch.column(text).to_pylist()]
        start, held = 0, 0
        for i, t in enumerate(texts):
            if held and held + len(t) > max_chars:
                yield batch.slice(start, i - start), texts[start:i]
                start, held = i, 0
            held += len(t) + 1
        if start < len(texts):
            yield batch.slice(start), texts[start:]
