"""Exact deduplication by Grace hash partitioning.

Records are dealt by a hash of their text into buckets (Spark's shuffle files are the spill files).
Each bucket streams through an open-addressing table of bounded size that compares complete texts;
texts that find the table full are written to the shared folder and partitioned again with another
hash and as many buckets as their bytes ask for, until nothing is left over. Before each deal every
task collapses its own copies in a table of the same kind, so a text that makes up a third of all
rows reaches its bucket once per task, and member rows are never gathered: they meet their group by
an equi-join on the digest.

Defined cases: a null text is the empty text; null ids sort behind all others; of rows that repeat
the kept id one (any) stays; an empty table gives an empty result; two different texts with one
SHA-256 end the job with an error instead of being merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import partitions, stored

WHITE = r"[\x20\x09-\x0D]+"


class ContentTable:
    """Open addressing with linear probing over complete texts; full beyond ``max_bytes`` of text."""

    def __init__(self, max_bytes: int, hash_bits: int = 64):
        self.max_bytes, self.keep = max_bytes, (1 << hash_bits) - 1
        self.clear()

    def clear(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.texts: list[str] = []
        self.rows: list[list] = []
        self.bytes = 0

    def _probe(self, h: int, text: str) -> int:
        """The slot of the text, or the free slot where it belongs."""
        mask = len(self.slots) - 1
        at = (h ^ (h >> 32)) & mask
        while (i := self.slots[at]) >= 0 and not (self.hashes[i] == h and self.texts[i] == text):
            at = (at + 1) & mask
        return at

    def add(self, h: int, sha: str, text: str, keep, n: int, n_min: int) -> bool:
        """Counts the record; False when its text is new and the table is full."""
        h &= self.keep
        at = self._probe(h, text)
        i = self.slots[at]
        if i >= 0:
            row = self.rows[i]
            if keep == row[1]:
                row[3] += n_min
            elif keep is not None and (row[1] is None or keep < row[1]):
                row[1], row[3] = keep, n_min
            row[2] += n
            return True
        if self.texts and self.bytes + len(text) > self.max_bytes:
            return False
        self.slots[at] = len(self.texts)
        self.hashes.append(h)
        self.texts.append(text)
        self.rows.append([sha, keep, n, n_min])
        self.bytes += len(text) + 200
        if 2 * len(self.texts) > len(self.slots):
            self.slots = [-1] * (4 * len(self.slots))
            for j, (hj, tj) in enumerate(zip(self.hashes, self.texts)):
                self.slots[self._probe(hj, tj)] = j
        return True


FIELDS = ["h", "sha", "text", "keep_id", "n", "n_min"]


def _batch(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def _emit(rows: list[list], schema: pa.Schema, chunk_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size from lists in the order of FIELDS."""
    part, held = [], 0
    for r in rows:
        part.append(r)
        held += len(r[2] or "") + 100
        if held > chunk_bytes:
            yield _batch(list(zip(*part)), schema)
            part, held = [], 0
    if part:
        yield _batch(list(zip(*part)), schema)


def _records(batch: pa.RecordBatch):
    return zip(*(batch.column(c).to_pylist() for c in FIELDS))


def _combined(table_bytes: int, hash_bits: int):
    """Copies inside one task as one record; the table is emptied whenever it is full."""
    def run(rows):
        table, schema = ContentTable(table_bytes, hash_bits), None
        own: list[int] = []

        def out():
            done = [[h, r[0], t, r[1], r[2], r[3]] for h, t, r in zip(own, table.texts, table.rows)]
            table.clear()
            own.clear()
            return done

        for batch in rows:
            schema = batch.schema
            for rec in _records(batch):
                if not table.add(*rec):
                    yield from _emit(out(), schema)
                    table.add(*rec)
                if len(own) < len(table.texts):
                    own.append(rec[0])
        if schema is not None:
            yield from _emit(out(), schema)
    return run


def _bucket(table_bytes: int, hash_bits: int):
    """Groups of one bucket (text null), and the records that found its table full (text kept)."""
    def run(rows):
        table, schema = ContentTable(table_bytes, hash_bits), None
        for batch in rows:
            schema = batch.schema
            yield from _emit([list(rec) for rec in _records(batch) if not table.add(*rec)], schema)
        if schema is not None:
            shas = [r[0] for r in table.rows]
            if len(set(shas)) < len(shas):
                raise ValueError("two different texts with one SHA-256")
            yield from _emit([[None, r[0], None, r[1], r[2], r[3]] for r in table.rows], schema)
    return run


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = 64 << 20,
                hash_bits: int = 64) -> DataFrame:
    """(sha, keep_id, group_size, n_min) for each distinct normalised text; ``n_min`` counts the rows
    with the kept id. ``hash_bits`` weakens the table's hash (for tests of the comparison)."""
    spark = docs.sparkSession
    text = normalised(F.col(text_col))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    left = docs.select(text.alias("text"), F.col(id_col).alias("keep_id"))
    left = left.select(F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("sha"), "text", "keep_id",
                       F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("n_min"))
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in left.schema])  # each may be null
    done, level = [], 0
    while True:
        buckets = max(partitions(spark), math.ceil(2 * total / table_bytes))
        records = left.mapInArrow(_combined(table_bytes, hash_bits), kind)
        dealt = records.repartition(buckets, F.xxhash64("h", F.lit(level)))
        out = stored(dealt.mapInArrow(_bucket(table_bytes, hash_bits), kind), f"grace-{level}")
        done.append(out.where("text is null"))
        left = out.where("text is not null")
        total = left.agg(F.sum(F.octet_length("text"))).first()[0]
        if total is None:
            break
        level += 1
    groups = done[0]
    for d in done[1:]:
        groups = groups.unionByName(d)
    return groups.select("sha", "keep_id", F.col("n").alias("group_size"), "n_min")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    groups = text_groups(docs, id_col, text_col, **kw)
    rows = docs.select(F.col(id_col), F.sha2(normalised(F.col(text_col)), 256).alias("sha"))
    found = rows.join(groups, "sha").withColumn("__first", F.col(id_col).eqNullSafe(F.col("keep_id")))
    if groups.where("n_min > 1").isEmpty():
        return found.select(id_col, "keep_id", "group_size", F.col("__first").alias("kept"), F.col("sha").alias("text_sha256"))
    plain = found.where("not (__first and n_min > 1)").withColumn("kept", F.col("__first"))
    # rows that repeat the kept id: one of them stays
    ties = stored(found.where("__first and n_min > 1").withColumn("__row", F.monotonically_increasing_id()), "ties")
    one = ties.groupBy("sha").agg(F.min("__row").alias("__row")).select("sha", "__row", F.lit(True).alias("kept"))
    ties = ties.join(one, ["sha", "__row"], "left").withColumn("kept", F.coalesce("kept", F.lit(False))).drop("__row")
    return plain.unionByName(ties).select(id_col, "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents that stay, with all their columns."""
    groups = text_groups(docs, id_col, text_col, **kw).select(
        F.col("sha").alias("__sha"), F.col("keep_id").alias("__keep"), F.col("n_min").alias("__n"))
    rows = docs.withColumn("__sha", F.sha2(normalised(F.col(text_col)), 256))
    kept = rows.join(groups, "__sha").where(F.col(id_col).eqNullSafe(F.col("__keep")))
    if groups.where("__n > 1").isEmpty():
        return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
    one = kept.where("__n > 1").dropDuplicates(["__sha"])
    return kept.where("__n = 1").unionByName(one).select(*(F.col(f"`{c}`") for c in docs.columns))
