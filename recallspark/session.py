"""Session helpers: the shared folder and tables written there."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from typing import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current is None:
        if named:
            sc.setCheckpointDir(named)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="recallspark-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a shared folder")
    return (named or sc.getCheckpointDir()).rstrip("/")


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one written table or stream."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


PACKED = "zstd"  # halves columns of hashes and ids, which the default leaves as they are


def written(df: DataFrame, name: str, packed: bool = False) -> DataFrame:
    """``df`` written once as a table below the shared folder. Its size is known from then on, so the
    planner can broadcast it where that pays and never has to make it again. ``packed`` is for large tables
    of ids, which are never broadcast."""
    path = run_dir(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        (df.write.option("compression", PACKED) if packed else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is written here go when it is written; a job of several steps then holds those of
    one step, not of all until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
