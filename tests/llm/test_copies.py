"""Exact and near deduplication against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from recallspark.llm import exact_dedup, near_dedup
from recallspark.llm.components import connected_components
from tests.llm.rows import frame, near_copies, odd_texts

LAST = float("inf")


def grouped(texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        once = False
        for i in ids:
            first = i == keep and not once
            once |= first
            out.append((i, keep, len(ids), first, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("table_bytes,hash_bits", [(64 << 20, 64), (1000, 2)])
def test_exact_groups(spark, table_bytes, hash_bits):
    """A small table overflows into further levels, a weak hash leaves it to the texts to differ."""
    texts = odd_texts() + [(100 + i, f"copy {i % 7}") for i in range(300)] + [(7, "copy 1"), (7, "copy 1"), (-1, "copy  2")]
    got = exact_dedup.duplicate_groups(frame(spark, texts), table_bytes=table_bytes, hash_bits=hash_bits)
    assert sorted([tuple(r) for r in got.collect()], key=str) == grouped(texts)
    kept = exact_dedup.drop_duplicates(frame(spark, texts), table_bytes=table_bytes)
    assert kept.columns == frame(spark, []).columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([r[0] for r in grouped(texts) if r[3]], key=str)


def near_groups(texts):
    sets = []
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]) and label[i] != label[j]:
                label = [label[i] if x == label[j] else x for x in label]
    smallest = {}
    for (i, _), x, s in zip(texts, label, sets):
        if s and i is not None:
            smallest[x] = min(smallest.get(x, LAST), i)
    return sorted([(i, len(s), smallest.get(x) if s else i) for (i, _), x, s in zip(texts, label, sets)], key=str)


@pytest.mark.parametrize("limit", [256, 5])
def test_near_groups(spark, limit):
    """A small limit cuts every region into parts that only the hub and the other trees connect."""
    texts = near_copies() + [(1000 + (i or 0) if i is not None else None, t) for i, t in odd_texts()]
    got = near_dedup.near_duplicates(frame(spark, texts), limit=limit)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()], key=str) == near_groups(texts)
    kept = near_dedup.drop_near_duplicates(frame(spark, texts), limit=limit)
    want = near_groups(texts)
    classes = {c for i, n, c in want if n}
    empty = [i for i, n, _ in want if not n]
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([*classes, *empty], key=str)


def test_near_pairs_on_one_template(spark):
    """Different texts on one template fill regions far over the limit; the near pairs among them just
    reach the threshold and are near to no hub."""
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    template, texts = words(300), []
    for _ in range(90):
        common = template + words(24)
        texts += [" ".join(common + words(27)) for _ in range(2)]
    want = near_groups(list(enumerate(texts)))
    assert len({c for _, _, c in want}) == 90
    got = near_dedup.near_duplicates(frame(spark, list(enumerate(texts))), limit=8)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()], key=str) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 400)] + [(500, 500), (7, None), (300, 301)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 400)}}
    assert len(got) == 361


def test_empty_tables(spark):
    docs = frame(spark, [])
    assert exact_dedup.duplicate_groups(docs).collect() == [] and exact_dedup.drop_duplicates(docs).collect() == []
    assert near_dedup.near_duplicates(docs).collect() == [] and near_dedup.drop_near_duplicates(docs).collect() == []
