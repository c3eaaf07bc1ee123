"""Similar titles and previous rows against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from recallspark.operators import citations as C, scale as S


def test_all_similar_titles_are_found(spark):
    rng = random.Random(6)
    vocabulary = ["the", "of", "a"] * 20 + [f"w{i}" for i in range(60)]
    pick = lambda n: list(dict.fromkeys(rng.choices(vocabulary, k=n)))
    titles = [(f"t{i}", pick(rng.randint(1, 12))) for i in range(300)] + [("none", [])]
    refs = []
    for i in range(150):
        base = list(rng.choice(titles)[1])
        rng.shuffle(base)
        refs.append((f"r{i}", list(dict.fromkeys(base[:rng.randint(0, len(base))] + pick(rng.randint(0, 8))))))
    got = C.similar_titles(spark.createDataFrame(refs, "rid string, words array<string>"),
                           spark.createDataFrame(titles, "tid string, title_words array<string>"))
    want = {(r, t, len(set(a) & set(b))) for r, a in refs for t, b in titles if b and 100 * len(set(a) & set(b)) >= 55 * len(b)}
    assert {(x.rid, x.tid, x.shared) for x in got.collect()} == want and len(want) > 200


@pytest.mark.parametrize("rare", [0, 3, 1000])
def test_the_most_similar_title(spark, monkeypatch, rare):
    monkeypatch.setattr(C, "RARE", rare)
    rng = random.Random(7)
    vocabulary = ["the", "of", "a"] * 20 + [f"w{i}" for i in range(40)]
    titles = {" ".join(rng.choices(vocabulary, k=rng.randint(1, 9))) for _ in range(300)}
    titles |= {f"study of the {w} {k}" for w in ("ring", "bolt") for k in range(40)}
    refs = [(i, " ".join(rng.choices(vocabulary, k=3) + rng.choice(sorted(titles)).split() + rng.choices(vocabulary, k=2))) for i in range(150)]
    refs += [(1000 + k, f"x study of one {w} {k}") for k in range(50) for w in ("ring",)] + [(2000, ""), (2001, "nothing here")]
    r = spark.createDataFrame(refs, "rid long, nraw string").withColumn("words", F.array_remove(F.array_distinct(F.split("nraw", " ")), ""))
    t = spark.createDataFrame([(x,) for x in titles], "ntitle string").withColumn("title_words", F.array_distinct(F.split("ntitle", " ")))
    share = lambda x, c: len(set(x.split()) & set(c.split())) / len(set(x.split()))
    want = {i: max((share(x, c), len(x), x) for x in titles) for i, c in refs}
    got = {x.rid: x.ntitle for x in C.most_similar_title(r, t, ["rid"]).collect()}
    assert got == {i: w[2] for i, w in want.items() if w[0] >= 0.55}
    inside = {(i, x) for i, c in refs for x in titles if f" {x} " in f" {c} "}
    assert {(x.rid, x.ntitle) for x in C.verbatim_titles(r, t, ["rid"]).collect()} == inside and len(inside) > 150


def test_titles_alike_but_for_a_number_make_few_pairs(spark, monkeypatch):
    """Titles and citations that differ in a number meet as one set of words, not each with each."""
    met, plain = [], C.similar_titles

    def counted(refs, titles, *more):
        met.append((refs.count(), titles.count()))
        return plain(refs, titles, *more)

    monkeypatch.setattr(C, "similar_titles", counted)
    words = lambda c: F.split(c, " ").alias
    r = spark.range(300).select(F.col("id").alias("rid"), F.concat(F.lit("a study of the ring "), "id").alias("c")).select("rid", words("c")("words"))
    t = spark.range(400).select(F.concat(F.lit("study of the ring "), "id").alias("ntitle")).select("ntitle", words("ntitle")("title_words"))
    got = {x.rid: x.ntitle for x in C.most_similar_title(r, t, ["rid"]).collect()}
    assert got == {i: f"study of the ring {i}" for i in range(300)} and met == [(1, 1)]


def test_a_title_that_is_not_verbatim(spark):
    works = spark.createDataFrame([("10.1/a", "Deep learning for protein folding", "Li", "2020"), ("10.1/b", "Deep sea fishing", "Mar", "2019"),
                                   ("10.1/c", "Protein folding", "Li", "2020")], "doi string, title string, family string, year string")
    refs = spark.createDataFrame([("d", 0, "Li. Deep-learning and protein folding: a study of learning, 2021", None, "2021", "Li"),
                                  ("d", 1, "Mar. About something else. 2019", None, "2019", "Mar"), ("d", 2, "X. Fishing in the sea. 2019", None, "2019", "X"),
                                  ("d", 3, "Nobody 1999", None, "1999", "Nobody"), ("d", 4, "Deep learning for protein folding", None, None, None)],
                                 "doc_id string, pos int, raw string, doi string, year string, author string")
    got = {r.pos: r.work_doi for r in C.doi_join(refs, works).collect()}
    assert got == {0: "10.1/c", 1: "10.1/b", 2: "10.1/b", 3: None, 4: "10.1/a"}  # a title that stands word by word comes first


@pytest.mark.parametrize("partitions", [1, 7])
def test_previous_rows(spark, partitions):
    """One group in most of the rows, groups that end at a boundary, null groups and values."""
    rng = random.Random(partitions)
    rows = [(rng.choice(["hot"] * 20 + ["b", "c", None]), i, rng.choice([None, f"v{i}"])) for i in range(3000)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = S.with_previous(spark.createDataFrame(rows, "g string, n int, v string").orderBy(F.rand(1)), "g", ["n"], "v", "before").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    last, want = {}, []
    for g, n, v in rows:
        want.append((g, n, v, last.get(g) if g is not None else None))
        last[g] = v
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert S.with_previous(spark.createDataFrame([], "g string, n int, v string"), "g", ["n"], "v", "before").collect() == []
