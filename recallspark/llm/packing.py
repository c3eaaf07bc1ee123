"""Packing of token sequences by minimum bin slack.

Lengths lie between 1 and the sequence size, so their counts (at most ``size`` rows) are all that
planning needs. For each bin the largest remaining length is set and a bitset subset-sum over the
remaining lengths finds the fullest combination that fits with it; the combination is taken as often
as the counts allow and removed. The plan has a bounded number of patterns at any number of
documents; pieces take their places in it by their rank among the pieces of their length, which is
worked out per bucket and length, so no length is ever gathered in one task.

Defined cases: a null text is the empty text (one piece holding the end id alone); repeated rows are
packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import batches, partitions, stored
from .units import ByteBpe, tokenizer

Pattern = list[tuple[int, int]]


def fullest(counts: dict[int, int], room: int) -> Pattern:
    """The multiset of available lengths with the largest sum of at most ``room``."""
    bits, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            k = min(k, left)
            steps.append((length, k, bits))
            bits |= (bits << (length * k)) & mask
            left -= k
            k *= 2
        if bits >> room & 1:
            break
    best, taken = bits.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> best & 1:
            taken[length] = taken.get(length, 0) + k
            best -= length * k
    return list(taken.items())


def slack_patterns(counts: dict[int, int], size: int) -> Iterator[tuple[Pattern, int]]:
    """(lengths with multiplicities, number of bins filled that way), until nothing is left."""
    counts = {x: n for x, n in counts.items() if n > 0}
    while counts:
        top = max(counts)
        rest = dict(counts)
        rest[top] -= 1
        taken = dict(fullest({x: n for x, n in rest.items() if n}, size - top))
        taken[top] = taken.get(top, 0) + 1
        times = min(counts[x] // n for x, n in taken.items())
        yield sorted(taken.items(), reverse=True), times
        for x, n in taken.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]


def slots(counts: dict[int, int], size: int) -> np.ndarray:
    """Rows (length, first rank, pieces per bin, first sequence, first offset), by length and rank."""
    rows, rank, sequence = [], dict.fromkeys(counts, 0), 0
    for pattern, times in slack_patterns(counts, size):
        offset = 0
        for length, n in pattern:
            rows.append((length, rank[length], n, sequence, offset))
            rank[length] += n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): documents longer than ``size`` tokens are cut, the first
    piece takes what the whole ones leave."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids_crc32", T.LongType())])
    end = np.array([end_id], np.uint32)

    def run(rows):
        bpe = tokenizer(ByteBpe, tokenizer_path)
        for batch, texts in batches(rows, text_col, 500_000):
            ids, offsets = bpe.ids_of(texts)
            at, piece, start, length, crc = [], [], [], [], []
            for i in range(len(texts)):
                own = np.concatenate((ids[offsets[i]:offsets[i + 1]], end))
                a, b, k = 0, len(own) % size or size, 0
                while a < len(own):
                    at.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(own[a:b]))
                    a, b, k = b, b + size, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[id_col, "piece", "start", "length", "ids_crc32"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pack(pieces: DataFrame, size: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    plan = slots(counts, size)
    order = [id_col, "piece", "start", "ids_crc32"]
    n_buckets = max(partitions(spark), sum(counts.values()) // 100_000)
    # equal rows are interchangeable and are dealt by their place, so they never fill one bucket
    place = F.pmod(F.xxhash64(*order, F.monotonically_increasing_id()), F.lit(n_buckets))
    dealt = stored(pieces.withColumn("__bucket", place), "dealt")
    sizes = dealt.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__bucket").orderBy(*order)
    ranked = (dealt.withColumn("__rank", F.row_number().over(within) - 1).join(before, ["length", "__bucket"])
              .withColumn("__rank", F.col("__rank") + F.col("__before")).select(*pieces.columns, "__rank"))
    names = [*pieces.columns, "sequence_id", "offset"]
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    most = 1 << 48  # ranks stay below; lengths above them in one sort key

    def place(rows):
        keys = plan[:, 0] * most + plan[:, 1]
        for batch in rows:
            length = batch.column("length").to_numpy()
            rank = batch.column("__rank").to_numpy()
            slot = plan[np.searchsorted(keys, length * most + rank, side="right") - 1]
            k = rank - slot[:, 1]
            sequence = slot[:, 3] + k // slot[:, 2]
            offset = slot[:, 4] + (k % slot[:, 2]) * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-2]), pa.array(sequence), pa.array(offset)], names=names)

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Every document in as few sequences of ``size`` tokens as the plan finds, one row per piece."""
    return pack(stored(token_pieces(docs, tokenizer_path, size, end_id, id_col, text_col), "pieces"), size, id_col)
