"""Quality classifier, neighbours and the pipeline."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from recallspark.llm import ann, quality
from recallspark.llm.common import table
from tests.llm.rows import frame, odd_texts

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    good = y == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_held_out_quality(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = quality.score_documents(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(rows["score"].to_numpy(), rows["quality"].to_numpy()) > 0.9
    assert (rows["predicted"] == (rows["score"] >= 0.3)).all() and rows["score"].between(0, 1).all()
    good = rows[rows["quality"] == 1]
    assert good["predicted"].mean() > 0.9


def test_scores_depend_on_the_text_alone(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    score = quality.quality_score(docs, labels)
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s")).withColumn("doc_id", F.col("doc_id") + 1000)
    a = [r[0] for r in docs.orderBy("doc_id").select(score).collect()]
    b = [r[0] for r in other.orderBy("doc_id").select(score).collect()]
    assert a == b


def test_odd_rows_and_no_labels(spark):
    docs, labels = frame(spark, odd_texts()), table(spark, SMALL, "labels")
    assert quality.score_documents(docs, labels).count() == len(odd_texts())
    got = quality.score_documents(docs, labels.where("false")).collect()
    assert {r.score for r in got} == {0.5} and quality.score_documents(frame(spark, []), labels).collect() == []
    assert quality.keep_good(docs, labels).columns == docs.columns


def exact(ids, x, queries, k=5):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit[queries] @ unit.T
    out = {}
    for q, row in zip(queries, near):
        order = sorted((-round(s, 12), i) for s, i in zip(row, ids) if i != ids[q])
        out[ids[q]] = [i for _, i in order[:k]]
    return out


def test_recall_against_brute_force(spark):
    vectors = table(spark, SF, "embeddings")
    pdf = vectors.orderBy("vec_id").toPandas()
    want = exact(pdf["vec_id"].tolist(), np.stack(pdf["embedding"]).astype(float), np.flatnonzero(pdf["vec_id"] % 5 == 0))
    for shard_rows in (8192, 90):
        got = ann.nearest(vectors, vectors.where("vec_id % 5 = 0"), shard_rows=shard_rows, block_rows=40).collect()
        hits = sum(r.vec_id in want[r.query_id] for r in got)
        assert len(got) == 5 * len(want) and hits >= 0.95 * len(got)
        assert all(r["rank"] in range(1, 6) for r in got)


def test_near_copies_beyond_the_beam(spark):
    """The cosines of a group of near copies differ by less than single precision tells."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 16))
    x[:500] = x[0] * (1 + 1e-4 * rng.normal(size=(500, 16)))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = exact(list(range(1200)), x, np.arange(0, 500, 50))
    got = ann.nearest(vectors, vectors.where("vec_id % 50 = 0 and vec_id < 500")).collect()
    assert len(got) == 50 and sum(r.vec_id in want[r.query_id] for r in got) >= 48


def test_equal_and_unusable_vectors(spark):
    rows = [(i, [1.0, 2.0, float(i // 40)]) for i in range(160)] + [(500, None), (501, []), (502, [0.0, 0.0, 0.0]), (503, [1.0, None, 2.0]),
            (504, [1.0, float("nan"), 1.0]), (505, [float("inf"), 1.0, 1.0]), (None, [1.0, 2.0, 0.0]), (3, [1.0, 2.0, 0.0]), (600, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'s' AS shard", "1 AS dim", "2 AS id")
    got = {}
    for r in ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), shard_rows=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {q: [v for _, v in sorted(x)] for q, x in got.items()} == {
        0: [1, 2, 3, 4, 5], 50: [40, 41, 42, 43, 44], 100: [80, 81, 82, 83, 84], 150: [120, 121, 122, 123, 124]}
    assert ann.nearest(vectors.where("false"), vectors.where("false")).collect() == []


def test_stages_keep_columns_and_agree_with_run(spark):
    docs = table(spark, SMALL, "documents")
    seen = {r.doc_id for r in docs.collect()}
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, SMALL)
        assert step.columns == docs.columns
        left = {r.doc_id for r in step.collect()}
        assert left <= seen
        seen = left
    packed = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in packed} == seen
    labels = {r.doc_id: r.quality for r in table(spark, SMALL, "labels").collect()}
    good = [i for i, q in labels.items() if q == 1]
    first = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, SMALL).collect()}
    assert sum(i in first for i in good) >= 0.9 * len(good)


def test_features_against_plain_sums(spark):
    """Context vectors and document features, word by word in Python."""
    texts = [t for _, t in odd_texts()] + ["a b a, c", "a  b\nb b!", ""]
    d = quality.DIMS
    sums = np.zeros((quality.WORDS, d))
    rows = []
    for t in texts:
        word, sign, offsets = quality.words_of([t or ""])
        rows.append((word.tolist(), sign.tolist()))
        assert offsets.tolist() == [0, len(word)]
        for i, w in enumerate(word):
            for j in (i - 1, i + 1):
                if 0 <= j < len(word):
                    for k in range(quality.NONZERO):
                        sums[w, quality.INDEX_AT[word[j], k]] += quality.INDEX_SIGN[word[j], k]
    context = quality.context_sums(frame(spark, list(enumerate(texts))).repartition(2))
    want = sums / (np.linalg.norm(sums, axis=1, keepdims=True) + 1)
    assert np.allclose(context, want, atol=1e-6)
    got = quality.features([t or "" for t in texts], context)
    for x, (word, sign) in zip(got, rows):
        n = len(word)
        plain = np.zeros(2 * d + 4)
        if n:
            plain[:d] = np.mean([want[w] for w in word], axis=0)
            plain[d:2 * d] = np.mean([quality.INDEX[w] for w in word], axis=0)
            plain[-4:] = [sum(a == b for a, b in zip(word, word[1:])) / n, np.log1p(n), len(set(word)) / n, sum(sign) / n]
        assert np.allclose(x, plain, atol=1e-4)


def test_a_sampled_id_with_several_texts(spark):
    """One text per id is learned, the same one whatever the order of the rows."""
    docs = [(i % 7, f"text {i} " + "good " * (i % 7)) for i in range(60)] + [(None, "x")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, quality int")
    key = lambda rows: sorted((r.doc_id or -1, round(r.score, 12)) for r in rows)
    a = quality.score_documents(frame(spark, docs), labels).collect()
    b = quality.score_documents(frame(spark, docs[::-1]).repartition(3), labels).collect()
    assert key(a) == key(b) and len(a) == 61


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, extra columns with names used inside; and an empty table."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, node string, length long, piece int, keep_id long"
    rows = [(i, t, "en", "s", 1, "n", 2, 3, 4) for i, t in odd_texts()]
    for name, own in (("odd", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(own, kind).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert bool(out) == bool(own)
        kept = {r.doc_id for r in out}
        assert kept <= {i for i, _ in odd_texts()}
