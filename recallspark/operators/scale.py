"""Building blocks that keep skewed data distributed.

* ``with_position`` numbers a total order without a one-task window.
* ``with_previous`` is ``lag`` over groups of any size.
* ``contains_pairs`` / ``substring_hits`` answer "text contains term" with equi-joins.
* ``first_per_key`` keeps one row per key with map-side combining.
* ``dealt`` marks a table that grows with the input, so that it is never sent whole through the driver.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import materialize, written


def with_position(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position of each row in the total order ``order``.

    A range-partitioned sort is written once to the checkpoint folder; the partition
    counts (one row per partition) then give every row its offset.
    """
    placed = materialize(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    row = F.col("__at") - F.shiftleft(part, 33)
    placed = placed.withColumn("__part", part).withColumn("__row", row)
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return (placed.join(F.broadcast(offsets), "__part")
            .withColumn(name, F.col("__offset") + F.col("__row") + 1)
            .drop("__part", "__row", "__at", "__offset"))


def with_previous(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """``lag(value)`` inside ``group`` ordered by ``order``, for groups of any size.

    The rows are range-partitioned and sorted once. Inside a partition each row takes the value of the row
    before it; the first row of a partition takes it from one carried row per partition.
    """
    rows = df.repartitionByRange(F.col(group), *order).sortWithinPartitions(group, *order)
    rows = rows.withColumn("__part", F.spark_partition_id()).withColumn("__before", F.col(value)).withColumn("__first", F.lit(False))

    def run(batches):
        last = None
        for batch in batches:
            own, key = batch.column(value), batch.column(group)
            if not batch.num_rows:
                continue
            start = (pa.nulls(1, own.type), pa.nulls(1, key.type)) if last is None else last
            before = pa.concat_arrays([start[0], own.slice(0, batch.num_rows - 1)])
            same = pc.fill_null(pc.equal(pa.concat_arrays([start[1], key.slice(0, batch.num_rows - 1)]), key), False)
            first = pa.array([last is None] + [False] * (batch.num_rows - 1))
            last = own.slice(batch.num_rows - 1), key.slice(batch.num_rows - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pc.if_else(same, before, pa.nulls(1, own.type)[0]), first], names=batch.schema.names)

    kinds = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    rows = materialize(rows.mapInArrow(run, kinds))
    ends = rows.groupBy("__part").agg(F.max_by(F.struct(F.col(group).alias("g"), F.col(value).alias("v")), F.struct(group, *order)).alias("e"))
    carried = ends.select((F.col("__part")).alias("__p"), F.lag("e").over(Window.orderBy("__part")).alias("__e"))  # a row per partition
    rows = rows.join(F.broadcast(carried), F.col("__first") & (F.col("__part") == F.col("__p")), "left")
    before = F.when(F.col("__e.g") == F.col(group), F.col("__e.v")).otherwise(F.col("__before"))
    return rows.withColumn(name, before).select(*df.columns, name)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is dealt out by its key. The planner takes a table for as large as its
    files, and columnar files of repeated words are many times smaller than their rows: without this it
    collects some of them at the driver."""
    return df.hint("merge")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, "__row.*").select(*df.columns)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int,
                  name: str = "rank") -> DataFrame:
    """The first ``n`` rows per group. The rank filter is applied before the shuffle as well
    (WindowGroupLimit), so a hot group sends at most ``n`` rows per task."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


AUTOMATON_CHARS = 2_000_000  # of all needles, some 100 MB of automaton in a worker


def _few_needles(needles: DataFrame) -> list[str] | None:
    """The needles, if they are short enough together for one automaton in every worker."""
    total = needles.agg(F.sum(F.length("needle"))).first()[0] or 0
    return [r[0] for r in needles.collect()] if total <= AUTOMATON_CHARS else None


def _found(rows: DataFrame, key: str, text: str, needles: list[str]) -> DataFrame:
    """(key, needle) for every row of ``rows`` whose ``text`` holds a needle, each needle once a row. One
    automaton over all needles walks each text once, whatever their number."""
    def run(batches):
        automaton = ahocorasick.Automaton()
        for n in needles:
            automaton.add_word(n, n)
        automaton.make_automaton()
        for batch in batches:
            at, hits = [], []
            for i, t in enumerate(batch.column(text)):
                t = t.as_py()
                own = {n for _, n in automaton.iter(t)} if t else ()
                at += [i] * len(own)
                hits += own
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), pa.array(hits, pa.string())], names=[key, "needle"])

    kind = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("needle", T.StringType())])
    if not needles:
        return rows.sparkSession.createDataFrame([], kind)
    return rows.select(*dict.fromkeys([key, text])).mapInArrow(run, kind)


def contains_pairs(hays: DataFrame, needles: DataFrame) -> DataFrame:
    """Every (hay, needle) where ``hay`` contains ``needle``; both are single-column tables.

    Distinct hays are walked by one automaton over the needles. Needles too long for that in all
    (``AUTOMATON_CHARS``) are matched by equality: each hay is cut into its substrings at the lengths that
    occur among them, and work is linear in the two inputs, however many strings share a beginning.
    """
    hays = hays.toDF("hay").where("hay <> ''").distinct()
    needles = written(needles.toDF("needle").where("needle <> ''").distinct(), "needles")
    few = _few_needles(needles)
    if few is not None:
        return _found(hays, "hay", "hay", few)
    return _equal_substrings(hays, needles)


def _equal_substrings(hays: DataFrame, needles: DataFrame) -> DataFrame:
    lengths = needles.agg(F.collect_set(F.length("needle")).alias("n")).scalar()
    last = F.length("hay") - F.col("n") + 1
    grams = (hays.select("hay", lengths.alias("lengths"))
             .select("hay", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("hay"))
             .select("hay", F.explode(F.array_distinct(F.transform(
                 F.sequence(F.lit(1), last), lambda i: F.col("hay").substr(i, F.col("n"))))).alias("needle")))
    return grams.join(needles, "needle").select("hay", "needle")


def either_way_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left, right) where one string contains the other; empty strings match nothing."""
    a = contains_pairs(left, right).select(F.col("hay").alias("left"), F.col("needle").alias("right"))
    b = contains_pairs(right, left).select(F.col("needle").alias("left"), F.col("hay").alias("right"))
    return a.unionByName(b.where(F.col("left") != F.col("right")))


def substring_hits(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """Distinct (id, needle) where the text holds a needle that has no white space; ids are unique.

    One automaton walks each text once and no word is shuffled. Needles too long for that in all are
    looked for in the distinct words of the corpus, since such a needle lies inside one word; the words
    that hold one are written and travel to the texts where they are few.
    """
    needles = written(needles.toDF("needle").where("needle <> ''").distinct(), "needles")
    few = _few_needles(needles)
    if few is not None:
        return _found(texts, "id", "text", few)
    words = texts.select("id", F.explode_outer(F.array_distinct(F.split("text", r"\s+"))).alias("word"))
    words = words.where("word <> ''")
    pairs = written(_equal_substrings(words.select(F.col("word").alias("hay")).distinct(), needles), "pairs")
    return words.join(pairs, words["word"] == pairs["hay"]).select("id", "needle").distinct()
