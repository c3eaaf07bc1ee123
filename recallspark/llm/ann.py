"""Approximate nearest neighbours by cosine on robust-pruned directed graphs.

Equal vectors are one node that carries its smallest ids. The nodes are dealt by hash into shards of
about ``shard_rows``; every shard builds a graph: greedy beam searches propose neighbours, relaxed
distance pruning keeps the diverse ones, edges are also set backwards and pruned again. A block of
queries meets a shard's graph in one task, a beam search finds its candidates there, and their
cosines are worked out on the original vectors in double precision. Where the beam's end is within
rounding of its k-th best, as among near copies, the query meets the whole shard in double precision
instead. The best of all shards are merged. Every row is indexed and every shard is searched.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows
without an id, take no part; vectors are compared within their own number of components; an id that
occurs with several vectors is searched with each and listed once with its best score; repeated rows
count once; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

DEGREE, BEAM, RELAX = 32, 64, 1.2
ROUNDING = 1e-5  # of a cosine in single precision


def usable(vector: Column) -> Column:
    """Finite, not null and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def beam_search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, starts: np.ndarray, width: int, step: int = 4) -> np.ndarray:
    """Nodes found nearest to each row of ``q``, nearest first, -1 where there are fewer."""
    b, n = len(q), len(x)
    rows = np.arange(b)[:, None]
    seen = np.zeros((b, n + 1), bool)
    ids = np.tile(starts, (b, 1))
    seen[rows, ids] = True
    near = q @ x[starts].T
    done = np.zeros(ids.shape, bool)
    if ids.shape[1] < width:
        more = width - ids.shape[1]
        ids = np.pad(ids, ((0, 0), (0, more)), constant_values=-1)
        near = np.pad(near, ((0, 0), (0, more)), constant_values=-np.inf)
        done = np.pad(done, ((0, 0), (0, more)), constant_values=True)
    while True:
        order = np.argsort(-near, axis=1, kind="stable")[:, :width]
        ids, near, done = ids[rows, order], near[rows, order], done[rows, order]
        pick = np.argsort(done, axis=1, kind="stable")[:, :step]  # the nearest that are not expanded yet
        open_ = ~done[rows, pick]
        live = np.flatnonzero(open_.any(axis=1))
        if not len(live):
            return ids
        done[rows, pick] = True
        new = np.where(open_[live][:, :, None], graph[ids[live][np.arange(len(live))[:, None], pick[live]]], -1).reshape(len(live), -1)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[seen[live[:, None], new]] = -1
        seen[live[:, None], new] = True
        seen[:, n] = False  # -1 stands for no node
        d = np.full((b, new.shape[1]), -np.inf, np.float32)
        d[live] = np.where(new >= 0, np.matmul(x[new], q[live][:, :, None])[:, :, 0], -np.inf)
        wide = np.full((b, new.shape[1]), -1, ids.dtype)
        wide[live] = new
        ids = np.concatenate((ids, wide), axis=1)
        near = np.concatenate((near, d), axis=1)
        done = np.concatenate((done, wide < 0), axis=1)


def robust_prune(x: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """For each node the nearest candidates, without those that are ``relax`` times nearer to one
    already chosen than to the node."""
    m = len(own)
    rows = np.arange(m)
    cand = np.where(candidates == own[:, None], -1, candidates)
    vec = x[cand]
    far = np.where(cand >= 0, 2 - 2 * np.matmul(vec, x[own][:, :, None])[:, :, 0], np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    cand, far, vec = cand[rows[:, None], order], far[rows[:, None], order], vec[rows[:, None], order]
    alive = np.isfinite(far)
    out = np.full((m, degree), -1, candidates.dtype)
    for k in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        out[:, k] = np.where(some, cand[rows, first], -1)
        alive[rows, first] = False
        between = 2 - 2 * np.matmul(vec, vec[rows, first][:, :, None])[:, :, 0]
        alive &= ~(some[:, None] & (relax * relax * between <= far))
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, width: int = BEAM, relax: float = RELAX, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours with -1 for none, start nodes) over unit vectors."""
    n = len(x)
    rng = np.random.default_rng(seed)
    graph = rng.integers(0, n, (n, degree))
    starts = np.unique(np.append(rng.integers(0, n, 7), np.argmax(x @ x.mean(axis=0))))
    for factor, beam in ((1.0, width // 2), (relax, width)):
        order = rng.permutation(n)
        for a in range(0, n, 256):
            own = order[a:a + 256]
            found = beam_search(x, graph, x[own], starts, beam)
            graph[own] = robust_prune(x, own, np.concatenate((found, graph[own]), axis=1), degree, factor)
            target, source = graph[own].ravel(), np.repeat(own, degree)
            target, source = target[target >= 0], source[target >= 0]
            order_t = np.argsort(target, kind="stable")
            target, source = target[order_t], source[order_t]
            nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
            back = np.full((len(nodes), counts.max() if len(nodes) else 0), -1, graph.dtype)
            back[np.repeat(np.arange(len(nodes)), counts), np.arange(len(target)) - np.repeat(first, counts)] = source
            both = np.concatenate((graph[nodes], back), axis=1)
            room = (both >= 0).sum(axis=1) <= degree
            packed = -np.sort(-both[room], axis=1)[:, :degree]  # -1 goes to the end
            graph[nodes[room]] = packed
            for k in range(0, (~room).sum(), 1024):
                part = np.flatnonzero(~room)[k:k + 1024]
                graph[nodes[part]] = robust_prune(x, nodes[part], both[part], degree, factor)
    return graph, starts


def _graphs(nodes: DataFrame, degree: int, width: int, relax: float) -> DataFrame:
    """One row per shard: its vectors, ids, graph and start nodes as blocks of bytes."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first_id", kind="stable")
        raw = np.stack(pdf["vector"]).astype(np.float64)
        unit = (raw / np.linalg.norm(raw, axis=1, keepdims=True)).astype(np.float32)
        graph, starts = build_graph(unit, degree, width, relax)
        sizes = pdf["ids"].map(len).to_numpy(np.int64)
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1].to_numpy(), "dim": pdf["dim"].iloc[:1].to_numpy(), "vectors": [raw.tobytes()],
                             "ids": [np.concatenate(pdf["ids"].tolist()).astype(np.int64).tobytes()], "sizes": [sizes.tobytes()],
                             "graph": [graph.astype(np.int32).tobytes()], "starts": [starts.astype(np.int64).tobytes()]})

    return nodes.groupBy("shard", "dim").applyInPandas(
        build, "shard long, dim int, vectors binary, ids binary, sizes binary, graph binary, starts binary")


def _search(k: int, degree: int, width: int):
    def run(shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        s = shard.iloc[0]
        raw = np.frombuffer(s["vectors"], np.float64).reshape(-1, int(s["dim"]))
        norms = np.sqrt((raw * raw).sum(axis=1))
        unit = (raw / norms[:, None]).astype(np.float32)
        ids, sizes = np.frombuffer(s["ids"], np.int64), np.frombuffer(s["sizes"], np.int64)
        ends = np.cumsum(sizes)
        graph = np.frombuffer(s["graph"], np.int32).reshape(-1, degree).astype(np.int64)
        starts = np.frombuffer(s["starts"], np.int64)
        out = []
        q_raw = np.stack(queries["vector"]).astype(np.float64)
        q_norm = np.sqrt((q_raw * q_raw).sum(axis=1))
        for a in range(0, len(q_raw), 256):
            q = q_raw[a:a + 256]
            q_unit = (q / q_norm[a:a + 256, None]).astype(np.float32)
            found = beam_search(unit, graph, q_unit, starts, width)
            for j, own in enumerate(queries["query_id"].iloc[a:a + 256].tolist()):
                node = found[j][found[j] >= 0]
                near = unit[node] @ q_unit[j]
                if len(raw) > len(node) >= width and near[min(k, width - 1)] - near[-1] <= ROUNDING:
                    node = np.arange(len(raw))
                    score = raw @ q[j] / (norms * q_norm[a + j])
                    if len(score) > k:  # the k + 1 best nodes and their ties; one may hold the query's own id alone
                        node = np.flatnonzero(score >= np.partition(score, -k - 1)[-k - 1])
                        score = score[node]
                else:
                    score = raw[node] @ q[j] / (norms[node] * q_norm[a + j])
                pick = [(-v, i) for v, m in zip(score.tolist(), node.tolist()) for i in ids[ends[m] - sizes[m]:ends[m]].tolist() if i != own]
                out += [(own, i, -v) for v, i in sorted(pick)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            shard_rows: int = 8192, block_rows: int = 2048, degree: int = DEGREE, width: int = BEAM, relax: float = RELAX) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row of ``queries``."""
    def valid(df):
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        return df.where(F.col("id").isNotNull() & usable(F.col("vector"))).distinct()

    # k + 1 ids of equal vectors are all that a query can be given, one of them may be its own
    w = Window.partitionBy("vector").orderBy("id")
    nodes = valid(vectors).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).groupBy("vector").agg(
        F.array_sort(F.collect_list("id")).alias("ids"))
    nodes = stored(nodes.select("vector", "ids", F.size("vector").alias("dim"), F.element_at("ids", 1).alias("first_id")), "nodes")
    n_shards = max(1, math.ceil(nodes.count() / shard_rows))
    shard = F.pmod(F.xxhash64("vector"), F.lit(n_shards))
    graphs = stored(_graphs(nodes.withColumn("shard", shard), degree, width, relax), "graphs")
    asked = stored(valid(queries), "queries")
    n_blocks = max(1, math.ceil(asked.count() / block_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    blocks = asked.select(F.col("id").alias("query_id"), "vector", F.size("vector").alias("dim"),
                          F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("block"), every(n_shards).alias("shard"))
    sides = graphs.withColumn("block", every(n_blocks))
    keys = ["shard", "block", "dim"]
    found = sides.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(
        _search(k, degree, width), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
