"""Near-duplicate detection with a MinHash LSH forest.

Every text becomes the set of its word shingles and a MinHash signature. Texts with equal sets are
one node. Each tree of the forest orders the nodes by another sequence of signature values; nodes
that share the first ``depth`` values are neighbours of one region. A region with more than
``limit`` nodes is cut at deeper common prefixes (8, then 16 values) until its parts are small, what
still is too large is dealt by a hash, and every part also gets the region's hub: the node whose
signature agrees with most of the region. Inside a part all pairs that are not yet connected are
confirmed on the full shingle sets, so no pair is accepted on its signature alone.

The trees run in two rounds. The second one leaves out regions whose nodes are already in one
component. Cut regions that still are more than one component after that are finished exactly on the
differences between their nodes' sets and a centre, the shingles of most of a sample of them. Of two
nodes over the threshold whose differences have nothing in common, both are linked with the node that
differs least from the centre, and that node is compared with all. Any other two share differences, and
so one of their rarest. Nodes that share one are compared; copies of a template, whose changes are
their own, hardly ever do. Where few of a large group are not linked with the least different node,
these meet the others block by block; a large group with many of them gets a centre of its own and goes
through the same again. A pair that shares a region of any size is therefore compared or already
connected, whatever the sample.

A pair just at the threshold of 0.85 shares a prefix of 4 in one of 16 trees with probability
1 - (1 - 0.85**4)**16 = 0.999993, nearer pairs with more.

Defined cases: texts without words have an empty set and are linked with nothing; null ids are
ignored by the smallest id of a component unless it has no other; repeated rows are equal sets; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import batches, stored
from .components import connected_components
from .units import code_points

TREES, DEPTH = 16, 4
SLOTS = TREES * DEPTH
ORDER_BITS = 18
_MULT, _MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FACTORS = np.random.default_rng(7).integers(1 << 40, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str], words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: words between white space, A-Z in lower case."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    cp = code_points(texts).astype(np.uint64)
    n = len(cp)
    if not n:
        return [np.zeros(0, np.uint64)] * len(texts)
    cp += np.where((cp >= 65) & (cp <= 90), np.uint64(32), np.uint64(0))
    ink = ~((cp == 32) | ((cp >= 9) & (cp <= 13)))
    ends = np.cumsum(lengths)
    begin = ends - lengths
    start = ink.copy()
    start[1:] &= ~ink[:-1]
    heads = begin[lengths > 0]
    start[heads] = ink[heads]
    at = np.flatnonzero(start)
    if not len(at):
        return [np.zeros(0, np.uint64)] * len(texts)
    # a word's hash is a polynomial in its own positions; white space counts as nothing
    place = np.arange(n) - np.repeat(at, np.diff(np.append(at, n))) if at[0] == 0 else np.concatenate(
        (np.zeros(at[0], np.int64), np.arange(at[0], n) - np.repeat(at, np.diff(np.append(at, n)))))
    powers = np.cumprod(np.full(int(place.max()) + 1, _MULT, np.uint64))
    value = np.where(ink, (cp + np.uint64(0x1F3)) * _MIX * powers[place], np.uint64(0))
    word = _mixed(np.add.reduceat(value, at))
    first = np.searchsorted(at, begin, side="left")
    last = np.searchsorted(at, ends, side="left")
    salt = powers_of(words + 1)
    sized = np.arange(words + 1, dtype=np.uint64) * salt[words]
    gram = np.zeros(len(word), np.uint64)
    for j in range(words):
        gram[:len(word) - j] += word[j:] * salt[j]
    gram = _mixed(gram + sized[words])
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= words:
            out.append(np.unique(gram[a:b - words + 1]))
        elif b > a:
            out.append(_mixed(np.add.reduce(word[a:b] * salt[:b - a], keepdims=True) + sized[b - a:b - a + 1]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def powers_of(n: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * _MULT) | np.uint64(1)


def signature(own: np.ndarray) -> np.ndarray:
    """The smallest value of each of the hash functions, as 32 bits."""
    best = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), 2048):
        np.minimum(best, (own[k:k + 2048, None] * _FACTORS).min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(">u4")


def node_key(own: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    a, b = own.sum(dtype=np.uint64), _mixed(own ^ _MIX).sum(dtype=np.uint64)
    return np.append(_mixed(np.atleast_1d(a)), b).astype(">u8").tobytes()


def _with_sets(docs: DataFrame, id_col: str, text_col: str, words: int, what: str) -> DataFrame:
    """Per document: node and n_shingles, and its signature or its whole set."""
    kind = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("text_hash", T.LongType()),
                         T.StructField("n_shingles", T.LongType()), T.StructField("node", T.BinaryType()),
                         T.StructField(what, T.BinaryType())])
    rows = docs.select(id_col, F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def run(parts):
        for batch, texts in batches(parts, "text", 500_000):
            sets = shingle_sets(texts, words)
            data = [(s.astype("<u8") if what == "shingles" else signature(s)).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([node_key(s) if len(s) else None for s in sets], pa.binary()), pa.array(data, pa.binary())],
                names=[f.name for f in kind])

    return rows.mapInArrow(run, kind)


def _regions(nodes: DataFrame, trees: range, limit: int, max_shingles: int) -> tuple[DataFrame, DataFrame | None]:
    """(part, node, hub): the parts of every region with more than one node, over the given trees; and
    (k4, node, centre) of the regions that are cut with their hubs, None without any."""
    twice = F.concat("signature", "signature")
    key = lambda t, d: F.xxhash64(F.lit(t), F.substring(twice, 4 * DEPTH * t + 1, 4 * d))
    rows = nodes.select("node", "n_shingles", F.explode(F.array(*(
        F.struct(key(t, DEPTH).alias("k4"), key(t, 8).alias("k8"), key(t, 16).alias("k16")) for t in trees))).alias("k"))
    rows = rows.select("node", "n_shingles", "k.*")
    sizes = rows.groupBy("k4").agg(F.count(F.lit(1)).alias("c4"), F.sum("n_shingles").alias("s4")).where("c4 > 1")
    rows = stored(rows.join(sizes, "k4"), "regions")
    fits = lambda c, s: (F.col(c) <= limit) & (F.col(s) <= max_shingles)
    small = rows.where(fits("c4", "s4")).select(F.col("k4").alias("part"), "node", F.lit(False).alias("hub"))
    large = rows.where(~fits("c4", "s4"))
    if large.isEmpty():
        return small, None
    hubs = stored(_hubs(large.select("k4", "node"), nodes.select("node", "signature"), limit), "hubs")
    cut = large.select("k4", "node").join(hubs.select("k4", F.col("node").alias("centre")), "k4")
    for c, s, keys in (("c8", "s8", ["k4", "k8"]), ("c16", "s16", ["k4", "k16"])):
        n = large.groupBy(*keys).agg(F.count(F.lit(1)).alias(c), F.sum("n_shingles").alias(s))
        large = large.join(n, keys)
    parts = F.greatest(F.ceil(F.col("c16") / limit), F.ceil(F.col("s16") / max_shingles))
    part = (F.when(fits("c8", "s8"), F.xxhash64("k4", "k8"))
            .when(fits("c16", "s16"), F.xxhash64("k4", "k16", F.lit(1)))
            .otherwise(F.xxhash64("k4", "k16", F.pmod(F.xxhash64("node"), parts))))
    large = stored(large.select(part.alias("part"), "k4", "node"), "parts")
    extra = large.select("part", "k4").distinct().join(hubs, "k4").select("part", "node", F.lit(True).alias("hub"))
    return small.unionByName(large.select("part", "node", F.lit(False).alias("hub"))).unionByName(extra), cut


def _hubs(members: DataFrame, signatures: DataFrame, sample: int) -> DataFrame:
    """(k4, node) the member that agrees with most of its region: slot by slot the most frequent value
    among ``sample`` members gives a centre, the nearest of all members to it is the hub."""
    w = Window.partitionBy("k4").orderBy(F.xxhash64("node"))
    some = members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= sample).join(signatures, "node")

    def centre(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(pdf["signature"]), ">u4").reshape(len(pdf), SLOTS)
        best = []
        for column in sig.T:
            values, counts = np.unique(column, return_counts=True)
            best.append(values[counts.argmax()])
        return pd.DataFrame({"k4": pdf["k4"].iloc[:1], "centre": [np.array(best, ">u4").tobytes()]})

    centres = some.groupBy("k4").applyInPandas(centre, "k4 long, centre binary")

    def agreement(frames):
        for pdf in frames:
            a, b = (np.frombuffer(b"".join(pdf[c]), ">u4").reshape(len(pdf), SLOTS) for c in ("signature", "centre"))
            yield pd.DataFrame({"k4": pdf["k4"], "node": pdf["node"], "same": (a == b).sum(axis=1)})

    near = members.join(centres, "k4").join(signatures, "node").select("k4", "node", "signature", "centre")
    near = near.mapInPandas(agreement, "k4 long, node binary, same long")
    return near.groupBy("k4").agg(F.max_by("node", F.struct("same", "node")).alias("node"))


def confirmed_links(sets: list[np.ndarray], component: list[int], threshold: int = 85) -> list[tuple[int, int]]:
    """Pairs with 100 * intersection >= threshold * union that join components, by trying every pair of
    different components. ``component`` holds what is known to be connected."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, at = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    label = np.array(component)
    links = []
    inside = np.zeros(len(flat), bool)
    for i in range(m):
        other = np.flatnonzero((label != label[i]) & (100 * np.minimum(sizes, sizes[i]) >= threshold * np.maximum(sizes, sizes[i])))
        if not len(other):
            continue
        own = at[ends[i] - sizes[i]:ends[i]]
        inside[own] = True
        for j in other:
            if label[j] != label[i]:
                both = int(inside[at[ends[j] - sizes[j]:ends[j]]].sum())
                if 100 * both >= threshold * (sizes[i] + sizes[j] - both):
                    links.append((i, int(j)))
                    label[label == label[j]] = label[i]
        inside[own] = False
    return links


def stars(edges: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    """The components of a few edges as edges to their smallest node."""
    above: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while above.get(x, x) != x:
            above[x] = above.get(above[x], above[x])
            x = above[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        above[a], above[b] = a, a
    return [(x, top(x)) for x in above if top(x) != x]


def _sets(docs, wanted, id_col, text_col, words) -> DataFrame:
    """(node, shingles) of the nodes of ``wanted`` (node, __doc)."""
    ids = wanted.select("__doc").distinct()
    texts = docs.join(ids, docs[id_col].eqNullSafe(ids["__doc"]), "left_semi")
    sets = _with_sets(texts, id_col, text_col, words, "shingles").select("node", "shingles").dropDuplicates(["node"])
    return stored(sets.join(wanted.select("node"), "node", "left_semi"), "sets")


def _open(parts: DataFrame) -> DataFrame:
    """The parts that hold more than one root."""
    open_ = parts.groupBy("part").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("part")
    return stored(parts.join(open_, "part", "left_semi"), "open")


def _links(parts: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Confirmed edges (a, b) between the roots of nodes that meet in a part (part, node, hub, root)."""
    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["hub", "node"], ascending=[False, True]).drop_duplicates("node")
        own = [np.frombuffer(b, "<u8") for b in pdf["shingles"]]
        root = pdf["root"].tolist()
        found = confirmed_links(own, pd.factorize(pdf["root"])[0].tolist(), threshold)
        return pd.DataFrame(stars([(root[i], root[j]) for i, j in found]), columns=["a", "b"])

    members = parts.join(sets, "node")
    return stored(members.groupBy("part").applyInPandas(link, "a binary, b binary"), "links")


def _round(docs, nodes, trees, known, limit, max_shingles, threshold, id_col, text_col, words) -> tuple[DataFrame, DataFrame | None]:
    """Edges (a, b) between the roots of nodes whose link is confirmed, in regions that are not yet one
    component, and the regions that were cut; the root of a node is itself as long as nothing is known."""
    parts, cut = _regions(nodes, trees, limit, max_shingles)
    if known is not None:
        parts = parts.join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    else:
        parts = parts.withColumn("root", F.col("node"))
    parts = _open(parts)
    wanted = stored(parts.select("node").distinct().join(nodes.select("node", F.col("doc").alias("__doc")), "node"), "wanted")
    return _links(parts, _sets(docs, wanted, id_col, text_col, words), threshold), cut


def _centres(pairs: DataFrame, sets: DataFrame, sample: int = 64) -> DataFrame:
    """(centre, middle): the shingles that more than half of some of a centre's nodes hold."""
    w = Window.partitionBy("centre").orderBy(F.xxhash64("node"))
    some = pairs.select("centre", "node").withColumn("r", F.row_number().over(w)).where(F.col("r") <= sample).join(sets, "node")

    def most(pdf: pd.DataFrame) -> pd.DataFrame:
        values, counts = np.unique(np.concatenate([np.frombuffer(b, "<u8") for b in pdf["shingles"]]), return_counts=True)
        return pd.DataFrame({"centre": pdf["centre"].iloc[:1], "middle": [values[2 * counts > len(pdf)].tobytes()]})

    return stored(some.groupBy("centre").applyInPandas(most, "centre binary, middle binary"), "centres")


def _differences(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(centre, node, root, near, least, n, share, delta) of pairs (centre, node, root): the shingles that
    node and centre do not share, whether node is linked with the centre's least different node and the
    root of that, the node's size, and how many of the differences it must share with another node that
    it may be linked with."""
    def differ(frames):
        for pdf in frames:
            delta, size, cost = [], [], []
            for a, c in zip(pdf["shingles"], pdf["middle"]):
                a, c = np.frombuffer(a, "<u8"), np.frombuffer(c, "<u8")
                d = np.setxor1d(a, c, assume_unique=True)
                beyond = (len(a) + len(d) - len(c)) // 2
                delta.append(d.tobytes())
                size.append(len(a))
                cost.append(100 * (len(d) - beyond) + threshold * beyond)
            yield pd.DataFrame({"centre": pdf["centre"], "node": pdf["node"], "root": pdf["root"], "n": size, "cost": cost, "delta": delta})

    rows = pairs.join(sets, "node").join(_centres(pairs, sets), "centre")
    rows = stored(rows.mapInPandas(differ, "centre binary, node binary, root binary, n long, cost long, delta binary"), "deltas")
    first = rows.groupBy("centre").agg(F.min_by(F.struct("root", "n", "delta"), F.struct("cost", "node")).alias("m"))
    first = first.select("centre", F.col("m.root").alias("least"), F.col("m.n").alias("m_n"), F.col("m.delta").alias("m_delta"))

    def judge(frames):
        for pdf in frames:
            near, share = [], []
            for n, d, m_n, m in zip(pdf["n"], pdf["delta"], pdf["m_n"], pdf["m_delta"]):
                d, m = np.frombuffer(d, "<u8"), np.frombuffer(m, "<u8")
                apart = len(np.setxor1d(d, m, assume_unique=True))
                both = (n + m_n - apart) // 2
                linked = 100 * both >= threshold * (n + m_n - both)
                if linked:  # the other is not: it differs from the least different node by more than the pair may differ
                    at_least = -(((100 - threshold) * (n - both) - 100 * (len(d) - len(m))) // 200)
                else:  # the other differs at most so much from this one
                    at_least = len(d) - (100 - threshold) * n // threshold
                near.append(linked)
                share.append(max(1, at_least))
            yield pdf[["centre", "node", "root", "least", "n", "delta"]].assign(near=near, share=share)

    kind = "centre binary, node binary, root binary, least binary, n long, delta binary, near boolean, share long"
    return stored(rows.drop("cost").join(first, "centre").mapInPandas(judge, kind), "differences")


def _rarest(rows: DataFrame) -> DataFrame:
    """(centre, token, node, root, near, n): the rarest differences of each node, so many that two nodes
    which share as many as they must have one of them in common. Any fixed order serves; theirs is by how
    often the top bits of the hash occur, then by hash."""
    bits = np.uint64(64 - ORDER_BITS)

    def tops(frames):
        counts = np.zeros(1 << ORDER_BITS, np.int64)
        for pdf in frames:
            for b in pdf["delta"]:
                np.add.at(counts, (np.frombuffer(b, "<u8") >> bits).astype(np.int64), 1)
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"top": at, "n": counts[at]})

    often = np.zeros(1 << ORDER_BITS, np.int64)
    found = rows.select("delta").mapInPandas(tops, "top long, n long").groupBy("top").agg(F.sum("n").alias("n")).toPandas()
    often[found["top"].to_numpy()] = found["n"].to_numpy()

    def first(frames):
        for pdf in frames:
            for centre, node, root, near, n, share, b in zip(*(pdf[c] for c in ("centre", "node", "root", "near", "n", "share", "delta"))):
                own = np.frombuffer(b, "<u8")
                order = np.lexsort((own, often[(own >> bits).astype(np.int64)]))[:max(0, len(own) - share + 1)]
                if len(order):
                    yield pd.DataFrame({"centre": centre, "token": own[order].view(np.int64), "node": node, "root": root, "near": near, "n": n})

    return stored(rows.mapInPandas(first, "centre binary, token long, node binary, root binary, near boolean, n long"), "rarest")


def _blocks(rows: DataFrame, limit: int, max_shingles: int) -> DataFrame:
    """(part, node, root) of groups (group, node, root, n) that stay too large: every two blocks make a part."""
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    blocks = F.greatest(F.ceil(2 * F.col("c") / limit), F.ceil(2 * F.col("s") / max_shingles), F.lit(2)).cast("long")
    rows = rows.join(sizes.select("group", blocks.alias("blocks")), "group").withColumn("x", F.pmod(F.xxhash64("node"), "blocks"))
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("x <> y")
    return rows.select(F.xxhash64("group", F.least("x", "y"), F.greatest("x", "y")).alias("part"), "node", "root")


def _rest(docs, nodes, cut, roots, limit, max_shingles, threshold, id_col, text_col, words, levels: int = 3) -> DataFrame | None:
    """Edges (a, b) between the roots of all nodes over the threshold in cut regions that hold more than
    one root; None if there is no such region."""
    left = _open(cut.select(F.col("k4").alias("part"), "node", "centre").join(roots.select("node", "root"), "node"))
    if left.isEmpty():
        return None
    ids = nodes.select("node", F.col("doc").alias("__doc"))
    sets = _sets(docs, stored(left.select("node").unionByName(left.select(F.col("centre").alias("node"))).distinct().join(ids, "node"), "wanted"),
                 id_col, text_col, words)
    pairs = stored(left.select("centre", "node", "root").distinct(), "pairs")
    parts, links = [], []
    for level in range(levels):
        differences = _differences(pairs, sets, threshold)
        links.append(differences.where("near and root <> least").select(F.col("root").alias("a"), F.col("least").alias("b")).distinct())
        rare = _rarest(differences)
        far = ~F.col("near")
        groups = rare.groupBy("centre", "token").agg(
            F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"),
            F.count_if(far).alias("c_far"), F.coalesce(F.sum(F.when(far, F.col("n"))), F.lit(0)).alias("s_far"),
            F.bit_xor(F.xxhash64("node")).alias("who")).where("a <> b and c_far > 0")
        # shingles of the same nodes make one group
        fits = (F.col("c") <= limit) & (F.col("s") <= max_shingles)
        few = (F.col("c_far") <= limit // 2) & (F.col("s_far") <= max_shingles // 2)
        blocks = F.when(fits, 1).when(few, F.greatest(F.ceil(2 * (F.col("c") - F.col("c_far")) / limit), F.ceil(2 * F.col("s") / max_shingles)))
        groups = groups.select("centre", "token", F.xxhash64("centre", "who", "c", "s").alias("group"), blocks.cast("long").alias("blocks"))
        rows = stored(rare.join(groups, ["centre", "token"]).select("group", "blocks", "node", "root", "near", "n").distinct(), "groups")
        # nodes linked with the least different one are dealt into blocks, those that are not meet every block
        all_blocks = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
        own = F.when(F.col("near"), F.array(F.pmod(F.xxhash64("node"), "blocks"))).otherwise(all_blocks)
        dealt = rows.where("blocks is not null").withColumn("block", F.explode(own))
        parts.append(dealt.select(F.xxhash64("group", "block").alias("part"), "node", "root"))
        large = rows.where("blocks is null").select("group", "node", "root", "n")
        if level == levels - 1:
            parts.append(_blocks(large, limit, max_shingles))
        elif large.isEmpty():
            break
        else:
            hubs = _hubs(large.select(F.col("group").alias("k4"), "node"), nodes.select("node", "signature"), limit)
            large = large.join(hubs.select(F.col("k4").alias("group"), F.col("node").alias("centre")), "group")
            pairs = stored(large.select("centre", "node", "root").distinct(), "pairs")
    all_parts = parts[0]
    for more in parts[1:]:
        all_parts = all_parts.unionByName(more)
    found = _links(_open(all_parts.withColumn("hub", F.lit(False))), sets, threshold)
    for more in links:
        found = found.unionByName(more)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: int = 85,
                    limit: int = 256, max_shingles: int = 1_000_000) -> DataFrame:
    """One row per document: id, text_hash, n_shingles, component_id, kept."""
    rows = stored(_with_sets(docs, id_col, text_col, words, "signature"), "signatures")
    nodes = stored(rows.where("node is not null").groupBy("node").agg(
        F.min(id_col).alias("doc"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")), "nodes")
    rows = rows.drop("signature")
    more = (limit, max_shingles, threshold, id_col, text_col, words)
    links, cut = _round(docs, nodes, range(0, 4), None, *more)
    known = stored(connected_components(links), "known")
    links, more_cut = _round(docs, nodes, range(4, TREES), known, *more)
    joined = connected_components(links).select("node", F.col("root").alias("__top"))
    known = known.select("node", F.col("root").alias("__mid"))
    roots = nodes.select("node", "doc").join(known, "node", "left").withColumn("__mid", F.coalesce("__mid", "node"))
    roots = roots.join(joined.withColumnRenamed("node", "__mid"), "__mid", "left").withColumn("root", F.coalesce("__top", "__mid"))
    cuts = [c for c in (cut, more_cut) if c is not None]
    if cuts:
        roots = stored(roots.select("node", "doc", "root"), "roots")
        links = _rest(docs, nodes, cuts[0] if len(cuts) == 1 else cuts[0].unionByName(cuts[1]), roots, *more)
        if links is not None:
            last = connected_components(links).select(F.col("node").alias("root"), F.col("root").alias("__last"))
            roots = roots.join(last, "root", "left").select("node", "doc", F.coalesce("__last", "root").alias("root"))
    smallest = roots.groupBy("root").agg(F.min("doc").alias("component_id"))
    labels = roots.join(smallest, "root").select("node", "root", "component_id")
    found = rows.join(labels, "node", "left").withColumn(
        "component_id", F.when(F.col("node").isNull(), F.col(id_col)).otherwise(F.col("component_id")))
    return found.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))).select(
        id_col, "text_hash", "n_shingles", "component_id", "kept", "root")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One document of each component, with all its columns; texts without words stay."""
    found = stored(near_duplicates(docs, id_col, text_col, **kw).where("kept"), "kept")
    # rows that repeat the kept id of a component: one of them stays
    repeated = found.where("root is not null").groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root")
    one = found.join(repeated, "root", "left_semi").groupBy("root").agg(F.min("text_hash").alias("text_hash"), F.first(id_col).alias(id_col))
    clean = found.join(repeated, "root", "left_anti").select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash"))
    rows = docs.withColumn("__h", F.xxhash64(text_col))
    same = lambda side: rows["__h"].eqNullSafe(side["__hash"]) & rows[id_col].eqNullSafe(side["__id"])
    many = one.select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash"))
    kept = rows.join(clean, same(clean), "left_semi").unionByName(
        rows.join(many, same(many), "left_semi").dropDuplicates([id_col, "__h"]))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
