"""Vector codes against plain integer rounds."""

import hashlib
import math
import random

import numpy as np
import pytest

from recallspark.llm import vector_codes

ROWS = "vec_id long, embedding array<double>, label int, id long, vector string, rows string, part int, entry int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "v", "r", 2, 3) for i, v, label in rows], ROWS)


def plain(rows, parts=4, entries=256, rounds=4):
    """Every row against every entry, in Python's own whole numbers."""
    ok = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not ok:
        return []
    dim = len(ok[0][1])
    ok = [r for r in ok if len(r[1]) == dim]
    cuts = [dim * p // parts for p in range(parts + 1)]
    x = [[[math.floor(1024 * c) for c in v[a:b]] for a, b in zip(cuts, cuts[1:])] for _, v, _ in ok]
    books = [[x[k][p] for k in range(min(entries, len(x)))] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    nearest = lambda row, p: min(range(len(books[p])), key=lambda e: (far(row[p], books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for row in x:
                own.setdefault(nearest(row, p), []).append(row[p])
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e])] if e in own else old for e, old in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    codes = [[nearest(row, p) for p in range(parts)] for row in x]
    errors = [sum(far(row[p], books[p][c]) for p, c in enumerate(code)) for row, code in zip(x, codes)]
    by_label = {}
    for (_, _, label), e in zip(ok, errors):
        by_label[label] = by_label.get(label, 0) + e
    return [(i, "".join(f"{c:02x}" for c in code), e, by_label[label], digest) for (i, _, label), code, e in zip(ok, codes, errors)]


def clustered(n, dim, seed, spread=0.05):
    rng = random.Random(seed)
    centres = [[rng.uniform(-2, 2) for _ in range(dim)] for _ in range(12)]
    return [(i, [c + rng.gauss(0, spread) for c in centres[rng.randrange(12)]], rng.choice([None, 1, 2, 3])) for i in range(n)]


ODD = [(None, [0.5, 1.0, 0.25, -1.0, 3.0, 2.0, 1.0, 0.0], 1), (3, None, 1), (4, [1.0, None] + [1.0] * 6, 2), (5, [float("nan")] * 8, 2),
       (6, [float("-inf")] * 8, None), (7, [0.0] * 8, None), (8, [], 1), (9, [1.0, 2.0], 1), (7, [0.0] * 8, 2), (7, [-0.25] * 8, 2)]


@pytest.mark.parametrize("rows,entries", [
    (clustered(900, 8, 1), 32), (clustered(700, 12, 2, 1.0), 256), (clustered(300, 10, 3), 16),
    ([(i, [0.1] * 8, i % 2) for i in range(400)] + [(1000 + i, [i / 7] * 8, None) for i in range(40)] + ODD, 64), (ODD, 256), ([(1, [], 1)], 4)])
def test_codes(spark, rows, entries):
    """Clusters, no clusters, uneven parts, one vector in most of the rows, odd rows."""
    got = vector_codes.compress(frame(spark, rows).repartition(3), entries=entries)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(rows, entries=entries), key=str)


def test_empty(spark):
    assert vector_codes.compress(frame(spark, [])).collect() == []
    assert vector_codes.compress(frame(spark, [(1, None, 1)])).collect() == []


def test_trees_spare_work():
    """On clustered rows whole nodes are assigned by their sums, and every row gets its nearest entry."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-3000, 3000, (40, 6))
    x = centres[rng.integers(0, 8, 4096)] + rng.integers(-20, 20, (4096, 6))
    x = x[vector_codes.tree_order(x, vector_codes.LEAF)]
    tree, book = vector_codes.Tree(x, vector_codes.LEAF), vector_codes.Codebook(centres)
    whole, code = 0, np.zeros(len(x), np.int64)
    for a, b, places, total in vector_codes.assign(tree, book):
        code[a:b] = book.index[places]
        if total is not None:
            whole += b - a
            assert (total == x[a:b].sum(axis=0)).all()
    far = ((x[:, None] - centres) ** 2).sum(axis=2)
    assert (code == far.argmin(axis=1)).all()
    assert whole > 2000


def test_large_components(spark):
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(frame(spark, [(1, [1e9] * 4, 1)])).collect()
