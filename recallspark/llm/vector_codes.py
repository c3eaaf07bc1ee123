"""Compression of vectors to one code byte per part, by exact integer Lloyd rounds on two trees.

Every component becomes an integer and every vector is cut into ``parts`` consecutive parts. The
vectors are written once as blocks: per block and part the rows stand in the order of a balanced
tree, whose nodes hold a bounding box, a count and a sum. In each round a second tree is laid over the
entries of each codebook and both are walked together: an entry node whose box is farther from a
row node's box than the farthest corner of another entry node can win no row there and is left out.
A row node with one entry left is assigned as a whole by its cached count and sum; leaves where
several entries are left compare integers row by row. Each task sums its own blocks, the sums (at
most entries x components) are added in Spark, and the next codebook goes to all tasks.

All arithmetic is on whole numbers, so the result does not depend on how rows are dealt.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do
vectors with another number of components than the first kept row; a part takes the components from
``dim * i // parts`` on, also where that is uneven; null ids sort behind all others; rows that repeat
an id are rows of their own, ordered by their vector; of equal distances the lower entry wins; fewer
rows than entries make a smaller codebook; an empty table gives an empty result. Components of which
``scale`` times the size passes 2**26 end the job with an error, since errors would leave 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import stored

LEAF, BLOCK_ROWS, MOST = 128, 4096, 1 << 26


def finite(vector: Column) -> Column:
    """Not null and without null, infinite or undefined components."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))


def bounds(dim: int, parts: int) -> list[int]:
    return [dim * i // parts for i in range(parts + 1)]


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    v = np.floor(x * scale)
    if v.size and np.abs(v).max() >= MOST:
        raise ValueError("component too large for exact 64-bit errors")
    return v.astype(np.int64)


def levels(n: int, leaf: int) -> list[list[int]]:
    """Bounds of the nodes of a balanced tree over ``n`` rows, level by level from the root."""
    out = [[0, n]]
    while max(b - a for a, b in zip(out[-1], out[-1][1:])) > leaf:
        out.append([x for a, b in zip(out[-1], out[-1][1:]) for x in (a, (a + b) // 2)] + [n])
    return out


def tree_order(x: np.ndarray, leaf: int) -> np.ndarray:
    """The rows in the order of their tree: every node is halved along its widest component."""
    order = np.arange(len(x))
    for level in levels(len(x), leaf)[:-1]:
        for a, b in zip(level, level[1:]):
            own = x[order[a:b]]
            if b - a > 1 and own.shape[1]:
                widest = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                order[a:b] = order[a:b][np.argsort(own[:, widest], kind="stable")]
    return order


class Tree:
    """Boxes, counts and sums of the nodes over rows in tree order; node k has the children 2k and 2k+1
    of the next level."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.x, self.levels = x, levels(len(x), leaf)
        starts = np.array(self.levels[-1][:-1])
        low, high = np.minimum.reduceat(x, starts, axis=0), np.maximum.reduceat(x, starts, axis=0)
        total = np.add.reduceat(x, starts, axis=0)
        self.boxes = [(low, high, total)]
        for _ in self.levels[1:]:
            low, high, total = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), total[::2] + total[1::2]
            self.boxes.insert(0, (low, high, total))


class Codebook:
    """The distinct entries of one part with a tree over them; of equal entries the lowest stands for all."""

    def __init__(self, entries: np.ndarray):
        first = {}
        for i, e in enumerate(map(bytes, np.ascontiguousarray(entries))):
            first.setdefault(e, i)
        index = np.array(sorted(first.values()))
        self.index = index[tree_order(entries[index], 1)]
        self.tree = Tree(entries[self.index], 1)
        self.starts = [np.array(level) for level in self.tree.levels]
        self.squares = (self.tree.x * self.tree.x).sum(axis=1)


def prune(low: np.ndarray, high: np.ndarray, book: Codebook, level: int, nodes: np.ndarray) -> np.ndarray:
    """The entry nodes that may hold a nearest entry of some row inside the box."""
    e_low, e_high, _ = book.tree.boxes[level]
    e_low, e_high = e_low[nodes], e_high[nodes]
    gap = np.maximum(np.maximum(e_low - high, low - e_high), 0)
    reach = np.maximum(e_high - low, high - e_low)
    return nodes[(gap * gap).sum(axis=1) <= (reach * reach).sum(axis=1).min()]


def nearest_entries(rows: np.ndarray, book: Codebook, left: np.ndarray) -> np.ndarray:
    """The nearest of the entries ``left`` (places in tree order) for each row, by exact integers."""
    left = left[np.argsort(book.index[left])]  # ties go to the lower entry
    entries = book.tree.x[left]
    if int(np.abs(rows).max(initial=0)) * int(np.abs(entries).max(initial=0)) * rows.shape[1] < 1 << 53:  # exact in a double
        cross = (rows.astype(np.float64) @ entries.T.astype(np.float64)).astype(np.int64)
    else:
        cross = rows @ entries.T
    return left[np.argmin(book.squares[left] - 2 * cross, axis=1)]


def assign(tree: Tree, book: Codebook):
    """(start, end, places, sum) of runs of rows: one place and a cached sum for a node that is assigned
    as a whole, or one place per row and no sum."""
    last = len(book.tree.levels) - 1
    todo = [(0, 0, 0, np.zeros(1, np.int64))]  # level and node of the rows, level and nodes of the entries
    while todo:
        level, k, e_level, nodes = todo.pop()
        low, high, total = (b[k] for b in tree.boxes[level])
        a, b = tree.levels[level][k], tree.levels[level][k + 1]
        nodes = prune(low, high, book, e_level, nodes)
        leaf = level == len(tree.levels) - 1
        while e_level < last and (leaf or len(nodes) <= 2):
            nodes = np.concatenate((2 * nodes, 2 * nodes + 1))
            e_level += 1
            nodes = prune(low, high, book, e_level, _present(book, e_level, nodes))
        if e_level == last and len(nodes) == 1:
            yield a, b, book.starts[last][nodes], total
        elif leaf:
            yield a, b, nearest_entries(tree.x[a:b], book, book.starts[last][nodes]), None
        else:
            if e_level < last:
                nodes, e_level = _present(book, e_level + 1, np.concatenate((2 * nodes, 2 * nodes + 1))), e_level + 1
            todo += [(level + 1, 2 * k, e_level, nodes), (level + 1, 2 * k + 1, e_level, nodes)]


def _present(book: Codebook, level: int, nodes: np.ndarray) -> np.ndarray:
    """``nodes`` without empty ones, in order."""
    ends = book.starts[level]
    return np.sort(nodes[ends[nodes + 1] > ends[nodes]])


def _blocks(vectors: DataFrame, dim: int, parts: int, scale: int) -> DataFrame:
    """(ids, labels, n, orders, rows): blocks of vectors as integers, each part in tree order."""
    id_type, label_type = vectors.schema["id"].dataType, vectors.schema["label"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("labels", T.ArrayType(label_type)),
                           T.StructField("n", T.IntegerType()), T.StructField("orders", T.BinaryType()), T.StructField("rows", T.BinaryType())])
    cuts = bounds(dim, parts)

    def block(ids: pa.Array, labels: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        n = len(x)
        orders = [tree_order(x[:, a:b], LEAF) for a, b in zip(cuts, cuts[1:])]
        rows = b"".join(x[o, a:b].astype("<i4").tobytes() for o, a, b in zip(orders, cuts, cuts[1:]))
        one = lambda v: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), v)
        return pa.RecordBatch.from_arrays([one(ids), one(labels), pa.array([n], pa.int32()), pa.array([np.stack(orders).astype("<i4").tobytes()], pa.binary()),
                                           pa.array([rows], pa.binary())], names=schema.names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(at, BLOCK_ROWS)
                x = piece.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(piece.num_rows, dim)
                held.append((piece.column("id"), piece.column("label"), integers(x, scale)))
                size += piece.num_rows
                if size >= BLOCK_ROWS:
                    yield block(*_joined(held))
                    held, size = [], 0
        if held:
            yield block(*_joined(held))

    return vectors.select("id", "label", "vector").mapInArrow(run, schema)


def _joined(held):
    ids, labels, x = zip(*held)
    return pa.concat_arrays(ids), pa.concat_arrays(labels), np.concatenate(x)


def _trees(n: int, rows: bytes, dim: int, parts: int):
    """The row tree of each part of a block."""
    flat, cuts = np.frombuffer(rows, "<i4"), bounds(dim, parts)
    for a, b in zip(cuts, cuts[1:]):
        yield Tree(flat[a * n:b * n].reshape(n, b - a).astype(np.int64), LEAF)


def _round(blocks: DataFrame, books: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """The entries after one assignment: componentwise floor of the mean, unused ones as they were."""
    parts = len(books)

    def run(batches):
        own = [Codebook(e) for e in books]
        sums, counts = [np.zeros_like(e) for e in books], [np.zeros(len(e), np.int64) for e in books]
        for batch in batches:
            for n, rows in zip(batch.column("n").to_pylist(), batch.column("rows")):
                for p, tree in enumerate(_trees(n, rows.as_py(), dim, parts)):
                    for a, b, places, total in assign(tree, own[p]):
                        entry = own[p].index[places]
                        if total is not None:
                            sums[p][entry[0]] += total
                            counts[p][entry[0]] += b - a
                        else:
                            np.add.at(sums[p], entry, tree.x[a:b])
                            counts[p] += np.bincount(entry, minlength=len(counts[p]))
        for p in range(parts):
            used = np.flatnonzero(counts[p])
            width = sums[p].shape[1] + 1  # the count is place 0
            values = np.concatenate((counts[p][used, None], sums[p][used]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used) * width, p, np.int32)), pa.array(np.repeat(used, width).astype(np.int32)),
                                              pa.array(np.tile(np.arange(width), len(used)).astype(np.int32)), pa.array(values.ravel())],
                                             names=["part", "entry", "place", "value"])

    found = blocks.select("n", "rows").mapInArrow(run, "part int, entry int, place int, value long")
    found = found.groupBy("part", "entry", "place").agg(F.sum("value").alias("value")).collect()  # at most entries x (components + parts) rows
    totals = [np.zeros((len(e), e.shape[1] + 1), np.int64) for e in books]
    for part, entry, place, value in found:
        totals[part][entry, place] = value
    return [np.where(t[:, :1] > 0, t[:, 1:] // np.maximum(t[:, :1], 1), e) for t, e in zip(totals, books)]


def _codes(blocks: DataFrame, books: list[np.ndarray], dim: int, id_type: T.DataType, label_type: T.DataType) -> DataFrame:
    """(id, label, code, error) of every row by the given codebooks."""
    parts = len(books)
    schema = T.StructType([T.StructField("id", id_type), T.StructField("label", label_type), T.StructField("code", T.StringType()),
                           T.StructField("error", T.LongType())])

    def run(batches):
        own = [Codebook(e) for e in books]
        for batch in batches:
            for k, n in enumerate(batch.column("n").to_pylist()):
                orders = np.frombuffer(batch.column("orders")[k].as_py(), "<i4").reshape(parts, n)
                codes, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
                for p, tree in enumerate(_trees(n, batch.column("rows")[k].as_py(), dim, parts)):
                    for a, b, places, _ in assign(tree, own[p]):
                        off = tree.x[a:b] - own[p].tree.x[places]
                        codes[orders[p, a:b], p] = own[p].index[places]
                        error[orders[p, a:b]] += (off * off).sum(axis=1)
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids").slice(k, 1).flatten(), batch.column("labels").slice(k, 1).flatten(),
                     pa.array([text[i:i + 2 * parts] for i in range(0, 2 * parts * n, 2 * parts)], pa.string()), pa.array(error)], names=schema.names)

    return blocks.mapInArrow(run, schema)


def codebooks(vectors: DataFrame, parts: int, entries: int, scale: int) -> list[np.ndarray] | None:
    """The first codebooks: the parts of the rows with the smallest ids; None without rows."""
    seeds = vectors.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    if not seeds:
        return None
    dim = len(seeds[0]["vector"])
    x = integers(np.array([r["vector"] for r in seeds], np.float64).reshape(len(seeds), dim), scale)
    cuts = bounds(dim, parts)
    return [x[:, a:b] for a, b in zip(cuts, cuts[1:])]


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id",
             vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) for every usable row."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte per part")
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    kept = kept.where(finite(F.col("vector")))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(1).select(F.size("vector")).first()
    dim = first[0] if first else 0
    kept = kept.where(F.size("vector") == dim)
    id_type, label_type = kept.schema["id"].dataType, kept.schema["label"].dataType
    books = codebooks(kept, parts, entries, scale) or [np.zeros((1, b - a), np.int64) for a, b in zip(bounds(dim, parts), bounds(dim, parts)[1:])]
    blocks = stored(_blocks(kept, dim, parts, scale), "vector-blocks")
    for _ in range(rounds):
        books = _round(blocks, books, dim)
    digest = hashlib.sha256(",".join(str(v) for e in books for v in e.ravel().tolist()).encode()).hexdigest()
    coded = stored(_codes(blocks, books, dim, id_type, label_type), "codes")
    errors = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    found = coded.join(errors, F.col("label").eqNullSafe(F.col("__label")))
    return found.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
