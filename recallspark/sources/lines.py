"""Large text exports, read by several tasks each and still in order.

Spark's text reader cuts a file into byte ranges and gives each line to the range where it starts. The
lines of a range come in order, so their places follow from one count per range, a table with as many
rows as there are ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import written

RANGE = ["path", "range"]


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """(path, range, at, line): ``at`` grows by one from line to line of a range."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"),
                                       F.explode(F.split("value", r"\R")).alias("line"))
    return raw.withColumn("at", F.monotonically_increasing_id())


def _earlier(column: str) -> Column:
    before = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(before), F.lit(0))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, line): every line of the files with its place in its file, from 0. A line break at the end
    of a file starts no further line; empty files have no lines."""
    lines = _placed(spark, path)
    ranges = lines.groupBy(*RANGE).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    ranges = written(ranges.select(*RANGE, (_earlier("n") - F.col("first")).alias("shift")), "ranges")
    return lines.join(ranges, RANGE).select("path", (F.col("at") + F.col("shift")).alias("seq"), "line")


def records(spark: SparkSession, path: str, start: str) -> DataFrame:
    """(path, record, text): the lines from one that matches ``start`` up to the next such line, of all ranges
    of a file. Lines before the first are record 0. A record is one row and no more meets in a group."""
    lines = _placed(spark, path).withColumn("start", F.col("line").rlike(start).cast("long"))
    ranges = lines.groupBy(*RANGE).agg(F.sum("start").alias("starts"))
    ranges = written(ranges.select(*RANGE, _earlier("starts").alias("before")), "ranges")
    so_far = Window.partitionBy(*RANGE).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # one range of bytes
    lines = lines.withColumn("own", F.sum("start").over(so_far)).join(ranges, RANGE)
    lines = lines.select("path", (F.col("before") + F.col("own")).alias("record"), F.struct("range", "at", "line").alias("l"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["line"]), "\n")
    return lines.groupBy("path", "record").agg(text.alias("text"))
