"""Ranked search with score bounds: exact, and without a pair for every text that holds a word."""

import datetime as dt
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recallspark.operators import retrieval as R


def plain(texts, queries, k, allowed=None):
    """Every text against every question."""
    toks = {i: re.findall(r"[a-z0-9]+", t.lower()) for i, t in texts}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(w for ws in toks.values() for w in set(ws))
    out = []
    for q, text in queries:
        scored = []
        for i, ws in toks.items():
            if allowed and not allowed(q, i):
                continue
            tf, score, hit = Counter(ws), 0.0, False
            for w, qf in Counter(x for x in text.lower().split() if len(x) > 2).items():
                if tf[w]:
                    hit = True
                    idf = max(math.log((n - df[w] + 0.5) / (df[w] + 0.5)), 1e-6)
                    score += qf * idf * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / avg))
            if hit:
                scored.append((-round(score, 9), i))
        out += [(q, i, r + 1, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def corpus(n, seed):
    rng = random.Random(seed)
    return [(f"t{i:05d}", " ".join(["common"] * rng.randint(1, 3) + rng.choices([f"w{j}" for j in range(30)] + ["often"] * 20, k=rng.randint(0, 12))))
            for i in range(n)]


QUESTIONS = [("a", "common"), ("b", "common often"), ("c", "common w1 w2"), ("d", "w3 w3 w4 missing"), ("e", "nothing"), ("f", "often w5 common w6 w7"), ("g", "")]


@pytest.mark.parametrize("k", [1, 3, 20, 5000])
def test_best_texts_are_exact(spark, k):
    texts = corpus(800, k)
    got = R.best_texts(spark.createDataFrame(texts, "id string, text string"), spark.createDataFrame(QUESTIONS, "query_id string, text string"), k)
    got = sorted((r.query_id, r.rank, r.id, round(r.score, 8)) for r in got.collect())
    assert got == sorted((q, r, i, round(s, 8)) for q, i, r, s in plain(texts, QUESTIONS, k))


def test_scope_and_cells(spark):
    """A question finds the texts of its scope only, the best for each cell; figures are of all texts."""
    texts = corpus(600, 9)
    scope, cell = lambda i: f"s{int(i[1:]) % 3}", lambda i: int(i[1:]) % 2
    places = spark.createDataFrame([(i, scope(i), cell(i)) for i, _ in texts if int(i[1:]) % 5], "id string, area string, kind int")
    asked = [(q, t, f"s{k % 3}") for k, (q, t) in enumerate(QUESTIONS)]
    got = R.best_texts(spark.createDataFrame(texts, "id string, text string"), spark.createDataFrame(asked, "query_id string, text string, area string"),
                       4, places, ["area"], ["kind"])
    mine = {q: s for q, _, s in asked}
    want = []
    for kind in (0, 1):
        want += plain(texts, QUESTIONS, 4, lambda q, i: int(i[1:]) % 5 and scope(i) == mine[q] and cell(i) == kind)
    assert sorted((r.query_id, r.rank, r.id) for r in got.collect()) == sorted((q, r, i) for q, i, r, _ in want)


@pytest.mark.parametrize("alike", [True, False])
def test_a_word_of_all_texts_makes_few_pairs(spark, alike):
    """4000 texts hold the word of 50 questions: their product would be 200000 pairs. Texts of equal
    length are told apart by id alone, texts of many lengths by the blocks of their weight."""
    n, k = 4000, 5
    texts = spark.range(n).select(F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("id"), F.concat_ws(
        " ", F.lit("order"), F.concat(F.lit("rare"), (F.col("id") % 100).cast("string")),
        F.lit("x y") if alike else F.repeat(F.lit("pad "), (F.col("id") % 500).cast("int"))).alias("text"))
    queries = spark.range(50).select(F.col("id").cast("string").alias("query_id"), F.when(F.col("id") % 2 == 0, "order").otherwise(
        F.concat(F.lit("order rare"), F.col("id").cast("string"))).alias("text"))
    terms = R.question_terms(queries)
    index = R.index_for(texts, terms)
    _, pairs = R.contenders(index, R.asked_terms(index, terms), k, None, [], [])
    assert pairs.count() <= 26 * k * 50  # at most k texts for each way to hold the asked words; the product is 200000
    assert R.best_texts(texts, queries, k).count() == 50 * k


def test_word_starts_keep_the_newest(spark, monkeypatch):
    """Every object holds a start: the newest are exact and a question meets few objects."""
    rng = random.Random(3)
    words = ["pedido", "urgente", "factura", "Pedidos", "contrato"]
    kos = [(f"k{i:03}", "pedido x", " ".join(rng.choices(words, k=2)), None, [], dt.date(2026, 1, 1 + rng.randint(0, 20)) if i % 9 else None) for i in range(400)]
    asked = [(f"q{i}", " ".join(rng.choices(words + ["nada"], k=2))) for i in range(60)]
    df = spark.createDataFrame(kos, "id string, title string, statement string, project string, people array<string>, date date")
    rows = []
    plain = R.top_per_group
    monkeypatch.setattr(R, "top_per_group", lambda d, group, *more: rows.append(d.count() if group == ["query_id"] else 0) or plain(d, group, *more))
    got = {(r.query_id, r["rank"]): r.id for r in R.prefix_search(df, spark.createDataFrame(asked, "query_id string, text string"), 5).collect()}
    want = {}
    for q, text in asked:
        hits = [k for k in kos if any(w.lower()[:6] in f"{k[1]} {k[2]}".lower() for w in text.split() if len(w) > 3)]
        hits.sort(key=lambda k: (-(k[5] or dt.date(1, 1, 1)).toordinal(), k[0]))
        want |= {(q, n + 1): k[0] for n, k in enumerate(hits[:5])}
    assert got == want and max(rows) <= 60 * 2 * 5


def test_long_questions_meet_few_texts(spark):
    """No single word of a question tells much; what several words add up to keeps most texts out."""
    rng = random.Random(5)
    strong = " " + " ".join(["ww1 ww2 ww3 ww4 ww5 ww6 ww7 ww8"] * 3)
    texts = [(f"t{i:04}", " ".join(f"ww{rng.randint(0, 59)}" for _ in range(20 + i % 7)) + (strong if i % 100 == 0 else "")) for i in range(1500)]
    asked = [(f"q{j}", " ".join(f"ww{(i + j) % 10}" for i in range(8))) for j in range(6)]
    docs, queries = spark.createDataFrame(texts, "id string, text string"), spark.createDataFrame(asked, "query_id string, text string")
    terms = R.question_terms(queries)
    index = R.index_for(docs, terms)
    _, pairs = R.contenders(index, R.asked_terms(index, terms), 5, None, [], [])
    assert pairs.count() <= 6 * 100
    got = R.best_texts(docs, queries, 5)
    assert sorted((r.query_id, r["rank"], r.id) for r in got.collect()) == sorted((q, r, i) for q, i, r, _ in plain(texts, asked, 5))
