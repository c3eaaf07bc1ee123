"""Lookups, ranked text search, substring search, vectors and their fusion."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed, text as TX
from ..session import materialize, written
from .scale import contains_pairs, substring_hits, top_per_group


def newest(c: str = "date") -> Column:
    return F.desc(c)


# -- lookups -------------------------------------------------------------------


def filter_kos(kos: DataFrame, ko_type: str | None = None, status: str | None = None, person: str | None = None,
               project: str | None = None, area: str | None = None, limit: int | None = None) -> DataFrame:
    """Equality on type, status and area; case-insensitive substring on people and project."""
    for name, value in (("ko_type", ko_type), ("status", status), ("area", area)):
        if value is not None:
            kos = kos.where(F.col(name) == value)
    if person is not None:
        kos = kos.where(F.exists("people", lambda p: F.contains(F.lower(p), F.lit(person.lower()))))
    if project is not None:
        kos = kos.where(F.contains(F.lower("project"), F.lit(project.lower())))
    return kos if limit is None else kos.orderBy(newest(), "id").limit(limit)


def list_documents(docs: DataFrame, limit: int) -> DataFrame:
    return docs.orderBy(newest(), "id").limit(limit)


def find_entities(entities: DataFrame, fragment: str) -> DataFrame:
    f = F.lit(fragment.lower())
    return entities.where(F.contains(F.lower("name"), f) | F.exists("aliases", lambda a: F.contains(F.lower(a), f)))


def list_entities(entities: DataFrame, entity_type: str | None = None) -> DataFrame:
    if entity_type is not None:
        entities = entities.where(F.col("entity_type") == entity_type)
    return entities.orderBy("entity_type", "name")


def timeline(kos: DataFrame) -> DataFrame:
    """Events by date."""
    return kos.where("ko_type = 'event'").orderBy("date", "id")


def dated_list(kos: DataFrame, ko_type: str) -> DataFrame:
    """Listing of one type with its people in one text."""
    return (kos.where(F.col("ko_type") == ko_type).orderBy(newest(), "id")
            .select("id", "date", "status", "statement", F.array_join("people", ", ").alias("who")))


def digest_docs(docs: DataFrame, excerpt: int = 240) -> DataFrame:
    """Catalogue row per document with a short excerpt."""
    return docs.select("id", "title", "path", "doc_type", "date", F.substring("body", 1, excerpt).alias("excerpt"))


# -- inverted index ------------------------------------------------------------


def doc_text(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.concat_ws(" ", "title", "body").alias("text"))


def ko_text(kos: DataFrame) -> DataFrame:
    return kos.select("id", F.concat_ws(" ", "title", "statement").alias("text"))


def build_postings(texts: DataFrame) -> DataFrame:
    """(id, term, tf, dl) over the whole texts."""
    toks = texts.select("id", TX.tokens(F.col("text")).alias("toks"))
    return (toks.select("id", F.size("toks").alias("dl"), F.explode_outer("toks").alias("term")).where("term is not null")
            .groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")).select("id", "term", "tf", "dl"))


def question_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qf): folded search terms; a repeated term counts again."""
    terms = queries.select("query_id", F.explode(TX.query_terms(F.col("text"))).alias("w"))
    return (terms.select("query_id", TX.fold(F.col("w")).alias("term"))
            .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf")))


@dataclass
class SearchIndex:
    """Postings of the terms a set of questions needs, with the corpus figures."""

    postings: DataFrame
    n_docs: int
    avg_length: float


def index_for(texts: DataFrame, terms: DataFrame) -> SearchIndex:
    """One pass over the corpus. Only postings of asked terms are kept, and a row with the empty
    term carries each document's length, so the corpus is tokenised once."""
    wanted = terms.select("term").union(terms.sparkSession.createDataFrame([("",)], "term string")).distinct()
    toks = texts.select("id", TX.tokens(F.col("text")).alias("toks"))
    rows = toks.select("id", F.size("toks").alias("dl"), F.explode_outer(F.array_append("toks", F.lit(""))).alias("term"))
    kept = rows.join(written(wanted, "terms"), "term", "left_semi")
    postings = materialize(kept.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))
    figures = postings.where("term = ''").agg(F.count(F.lit(1)), F.avg("dl")).first()
    return SearchIndex(postings.where("term <> ''"), figures[0], figures[1] or 1.0)


BLOCKS = 64  # blocks of postings per unit of weight
SLACK = 1e-8  # scores are rounded to nine digits


def weight(index: SearchIndex) -> Column:
    """What a posting adds to a score per unit of its term's weight."""
    k1, b = fixed.BM25_K1, fixed.BM25_B
    tf, dl = F.col("tf"), F.col("dl")
    return (tf * (k1 + 1.0)) / (tf + k1 * (1.0 - b + b * dl / F.lit(index.avg_length)))


def asked_terms(index: SearchIndex, terms: DataFrame) -> DataFrame:
    """(query_id, term, coef, ...): the weight of each term that occurs, times how often it was asked."""
    n = F.lit(float(index.n_docs))
    seen = index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(fixed.BM25_IDF_FLOOR))
    return terms.join(seen, "term").withColumn("coef", F.col("qf") * idf).drop("qf", "df")


def contenders(index: SearchIndex, asked: DataFrame, k: int, places: DataFrame | None, scope: list[str], within: list[str]
               ) -> tuple[DataFrame, DataFrame]:
    """(postings, pairs): the postings that can matter, and the (query_id, *cell, id) that can be among
    the best ``k`` of their cell.

    * Texts of one length that hold the asked terms equally often have equal scores for every question,
      so only the ``k`` smallest ids of them are kept.
    * The k-th greatest contribution of any one term is a lower bound of the k-th score. Terms that
      cannot reach it together, such as a word that all texts hold, make no pair.
    * The postings of the other terms lie in blocks of similar weight; a question meets only the blocks
      whose greatest weight, with all its other terms at their greatest, can reach the bound.
    * What a text of those blocks adds up to is no more than its score, so the k-th greatest such sum is a
      better bound, and only texts that can reach it are scored.
    """
    cell = [*scope, *within]
    held = index.postings.groupBy("id", "dl").agg(F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("held"))
    if places is not None:
        held = held.join(places, "id")
    alike = Window.partitionBy(*cell, "dl", "held").orderBy("id")
    held = held.withColumn("__r", F.row_number().over(alike)).where(F.col("__r") <= k)
    rows = held.select(*cell, "id", "dl", F.explode("held").alias("h")).select(*cell, "id", "dl", "h.*")
    rows = written(rows.withColumn("weight", weight(index)).withColumn("block", F.floor(F.col("weight") * BLOCKS)), "contenders")

    best = top_per_group(rows.select(*cell, "term", "weight"), [*cell, "term"], [F.desc("weight")], k)
    best = best.groupBy(*cell, "term").agg(F.max("weight").alias("most"), F.when(F.count(F.lit(1)) >= k, F.min("weight")).otherwise(0.0).alias("kth"))
    asked = asked.join(best, [*scope, "term"]).withColumn("bound", F.col("coef") * F.col("most"))
    question = Window.partitionBy("query_id", *cell)
    asked = (asked.withColumn("least", F.max(F.col("coef") * F.col("kth")).over(question) - SLACK)
             .withColumn("total", F.sum("bound").over(question))
             .withColumn("reach", F.sum("bound").over(question.orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0))))
    needed = asked.where("reach >= least")
    rest = needed.groupBy("query_id", *cell).agg(F.sum("bound").alias("__in"))
    needed = needed.join(rest, ["query_id", *cell]).withColumn("rest", F.col("total") - F.col("__in"))
    lowest = F.greatest(F.floor((F.col("least") - (F.col("total") - F.col("bound"))) / F.col("coef") * BLOCKS) - 1, F.lit(0).cast("long"))
    wanted = needed.withColumn("block", F.explode(F.sequence(lowest, F.greatest(lowest, F.floor(F.col("most") * BLOCKS)))))
    pairs = rows.join(wanted.select("query_id", *cell, "term", "block", "coef", "rest", "least"), [*cell, "term", "block"])
    pairs = pairs.groupBy("query_id", *cell, "id").agg(
        F.sum(F.col("coef") * F.col("weight")).alias("part"), F.first("rest").alias("rest"), F.first("least").alias("least"))
    best = top_per_group(pairs.select("query_id", *cell, "part"), ["query_id", *cell], [F.desc("part")], k)
    best = best.groupBy("query_id", *cell).agg(F.when(F.count(F.lit(1)) >= k, F.min("part") - SLACK).otherwise(0.0).alias("__kth"))
    pairs = pairs.join(best, ["query_id", *cell]).where("part + rest >= greatest(least, __kth)")
    return rows, pairs.select("query_id", *cell, "id")


def best_texts(texts: DataFrame, queries: DataFrame, k: int, places: DataFrame | None = None, scope: list[str] | None = None,
               within: list[str] | None = None, name: str = "rank") -> DataFrame:
    """(query_id, *scope, *within, id, score, rank): the best ``k`` texts per question, exactly, ties by id.

    The figures of the corpus come from all ``texts``. ``places`` (id, *scope, *within) names the texts that
    may be found: a question finds those of its own values of ``scope``, which ``queries`` has too, and the
    best ``k`` for each value of ``within``.
    """
    scope, within = scope or [], within or []
    terms = question_terms(queries)
    index = index_for(texts, terms)
    asked = asked_terms(index, terms)
    if scope:
        asked = asked.join(queries.select("query_id", *scope).distinct(), "query_id")
    asked = written(asked, "asked")
    rows, pairs = contenders(index, asked, k, places, scope, within)
    cell = [*scope, *within]
    scored = pairs.join(rows, [*cell, "id"]).join(asked, ["query_id", *scope, "term"])
    scored = scored.groupBy("query_id", *cell, "id").agg(F.round(F.sum(F.col("coef") * F.col("weight")), 9).alias("score"))
    return top_per_group(scored, ["query_id", *cell], [F.desc("score"), F.asc("id")], k, name)


def bm25_documents(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    return best_texts(doc_text(docs), queries, k)


def bm25_kos(kos: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    return best_texts(ko_text(kos), queries, k)


def hits_join(hits: DataFrame, base: DataFrame, columns: list[str]) -> DataFrame:
    """Hits with columns of the rows they point at."""
    return hits.join(base.select("id", *columns), "id")


# -- substring search --------------------------------------------------------------


def term_overlap_search(texts: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Number of search terms (repeats counted) that occur anywhere in the text."""
    terms = (queries.select("query_id", F.explode(TX.query_terms(F.lower("text"))).alias("needle"))
             .groupBy("query_id", "needle").agg(F.count(F.lit(1)).alias("n")))
    low = texts.select("id", F.lower("text").alias("text"))
    hits = substring_hits(low, terms.select("needle"))
    scored = hits.join(terms, "needle").groupBy("query_id", "id").agg(F.sum("n").alias("score"))
    return top_per_group(scored, ["query_id"], [F.desc("score"), F.asc("id")], k)


def question_starts(queries: DataFrame) -> DataFrame:
    """(query_id, needle): the six-letter starts of the words of a question."""
    return queries.select("query_id", F.explode(TX.prefixes(F.col("text"))).alias("needle")).distinct()


def start_hits(texts: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, needle) where the text holds a word start, once for all questions that ask for it."""
    return substring_hits(texts.select("id", F.lower("text").alias("text")), starts.select("needle"))


def prefix_text(kos: DataFrame, with_people: bool = True) -> DataFrame:
    parts = ["title", "statement", F.coalesce("project", F.lit(""))]
    if with_people:
        parts.append(F.array_join("people", " "))
    return kos.select("id", F.concat_ws(" ", *parts).alias("text"))


def prefix_search(kos: DataFrame, queries: DataFrame, k: int, with_people: bool = True) -> DataFrame:
    """Newest objects that match a word start of the question. The newest ``k`` of a question are among the
    newest ``k`` of its word starts, so only those meet the questions."""
    starts = question_starts(queries)
    dated = prefix_text(kos.withColumn("id", F.struct("date", "id")), with_people)
    hits = start_hits(dated, starts).select("needle", "id.date", "id.id")
    hits = top_per_group(hits, ["needle"], [newest(), F.asc("id")], k, "__r").drop("__r")
    hits = hits.join(starts, "needle").select("query_id", "id", "date").distinct()
    return top_per_group(hits, ["query_id"], [newest(), F.asc("id")], k)


# -- questions -------------------------------------------------------------------------


def classify_intent(queries: DataFrame) -> DataFrame:
    out = queries.withColumn("intent", TX.intent(F.col("text")))
    return out.withColumn("memories", TX.memory_plan(F.col("intent")))


def name_tokens(queries: DataFrame) -> DataFrame:
    """Capitalised words of three characters or more: (query_id, needle), lower-cased."""
    words = F.split(F.regexp_replace("text", "[¿?]", " "), r"\s+")
    clean = F.transform(words, lambda w: F.regexp_replace(w, r"^[.,;:()]+|[.,;:()]+$", ""))
    keep = F.filter(clean, lambda w: (F.length(w) >= 3) & w.rlike(r"^\p{Lu}"))
    return queries.select("query_id", F.explode(keep).alias("w")).select("query_id", F.lower("w").alias("needle")).distinct()


def query_entities(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, entity_id, name, entity_type) whose name or alias contains a capitalised word."""
    asked = name_tokens(queries)
    names = (entities.select("id", "name", "entity_type",
                             F.explode(F.concat(F.array("name"), "aliases")).alias("label"))
             .withColumn("low", F.lower("label")))
    pairs = contains_pairs(names.select("low"), asked.select("needle"))
    return (pairs.join(asked, "needle").join(names, F.col("hay") == F.col("low"))
            .select("query_id", F.col("id").alias("entity_id"), "name", "entity_type").distinct())


# -- vectors ------------------------------------------------------------------------------


def chunk_documents(docs: DataFrame, words: int = 200) -> DataFrame:
    """Ordered chunks of a fixed number of words."""
    w = docs.select("id", F.filter(F.split("body", r"\s+"), lambda x: x != "").alias("w"))
    n = F.ceil(F.size("w") / F.lit(words)).cast("int")
    starts = F.when(F.size("w") == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - 1))
    parts = F.transform(starts, lambda i: F.array_join(F.slice("w", i * words + 1, words), " "))
    return w.select("id", F.posexplode(parts).alias("ordinal", "content"))


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, data_rows: int = 8192, block_rows: int = 2048) -> DataFrame:
    """Exact cosine neighbours: (query_id, id, similarity, rank).

    Blocks of about ``data_rows`` vectors meet blocks of questions in one task each; a matrix product
    gives their cosines and only the best ``k`` of the block per question leave the task. A zero
    vector has no similarity.
    """
    n_data = max(1, math.ceil(vectors.count() / data_rows))
    n_asked = max(1, math.ceil(queries.count() / block_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    data = vectors.select("id", F.col("embedding").cast("array<double>").alias("v"), block("id", n_data).alias("b"), every(n_asked).alias("q"))
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("v"), block("query_id", n_asked).alias("q"),
                           every(n_data).alias("b"))

    def unit(column: pd.Series) -> np.ndarray:
        x = np.stack(column)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.where(norm > 0, x / np.where(norm > 0, norm, 1), np.nan)

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "id": [], "similarity": []})
        left = left.sort_values("id", kind="stable")
        near = np.round(unit(right["v"]) @ unit(left["v"]).T, 9)
        pick = np.argsort(np.where(np.isnan(near), np.inf, -near), axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(right)), pick.shape[1])
        return pd.DataFrame({"query_id": right["query_id"].to_numpy()[rows], "id": left["id"].to_numpy()[pick.ravel()],
                             "similarity": near[rows, pick.ravel()]})

    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, similarity double"
    found = data.groupBy("b", "q").cogroup(asked.groupBy("b", "q")).applyInPandas(best, kinds)
    found = found.withColumn("similarity", F.nanvl("similarity", F.lit(None).cast("double")))
    return top_per_group(found, ["query_id"], [F.desc("similarity"), F.asc("id")], k)


def centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """Mean vector per label: (query_id, embedding)."""
    flat = vectors.select(F.col(label).cast("string").alias("query_id"), F.posexplode("embedding").alias("i", "x"))
    mean = flat.groupBy("query_id", "i").agg(F.round(F.avg("x"), 12).alias("x"))
    return (mean.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("e"))
            .select("query_id", F.transform("e", lambda p: p["x"]).alias("embedding")))


def hybrid_search(text_hits: DataFrame, vector_hits: DataFrame, k: int, c: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists."""
    both = text_hits.select("query_id", "id", "rank").unionByName(vector_hits.select("query_id", "id", "rank"))
    fused = both.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (F.lit(float(c)) + F.col("rank"))), 9).alias("score"))
    return top_per_group(fused, ["query_id"], [F.desc("score"), F.asc("id")], k)


# -- decisions in time -----------------------------------------------------------------------


def neighbours(kos: DataFrame, wanted: DataFrame, key: str, k: int = 3) -> DataFrame:
    """(id, side, rank, other_id): the ``k`` decisions at or before and after each wanted decision.

    Per (key, day) only the last and first few decisions can matter. They are cut there, and
    the days of a key, at most one row per date, are then looked over in order.
    """
    base = kos.where("ko_type = 'decision'").where(F.col(key).isNotNull()).select(key, "date", "id")
    base = base.join(wanted.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")
    days = base.select(key, "date").distinct()
    last = top_per_group(base, [key, "date"], [F.desc("id")], k + 1)
    first = top_per_group(base, [key, "date"], [F.asc("id")], k)
    per_day = lambda df, name: df.groupBy(key, "date").agg(
        F.sort_array(F.collect_list(F.struct("date", "id"))).alias(name))
    packed = days.join(per_day(last, "tail"), [key, "date"]).join(per_day(first, "head"), [key, "date"])

    w = Window.partitionBy(key).orderBy("date")
    before = F.flatten(F.collect_list("tail").over(w.rowsBetween(-k, 0)))
    after = F.slice(F.flatten(F.collect_list("head").over(w.rowsBetween(1, k))), 1, k)
    around = packed.select(key, "date", before.alias("before"), after.alias("after"))
    mine = wanted.where(F.col(key).isNotNull()).select("id", key, "date").join(around, [key, "date"])
    prior = F.slice(F.reverse(F.filter("before", lambda s: s["id"] != F.col("id"))), 1, k)
    rows = mine.select("id", F.explode(F.array(F.struct(F.lit("before").alias("side"), prior.alias("o")),
                                               F.struct(F.lit("after").alias("side"), F.col("after").alias("o")))).alias("s"))
    return (rows.select("id", "s.side", F.posexplode("s.o").alias("rank", "o"))
            .select("id", "side", (F.col("rank") + 1).alias("rank"), F.col("o.id").alias("other_id")))


def decision_neighbours(kos: DataFrame, wanted: DataFrame) -> DataFrame:
    """Neighbours inside the project; a project with a single decision falls back to the area."""
    decisions = kos.where("ko_type = 'decision'")
    sizes = decisions.where("project is not null").groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    sized = wanted.select("id", "project", "area", "date").join(sizes, "project", "left")
    alone = F.coalesce("n", F.lit(0)) < 2
    by_project = neighbours(kos, sized.where(~alone), "project")
    by_area = neighbours(kos, sized.where(alone), "area")
    return by_project.unionByName(by_area)


def same_source_items(kos: DataFrame, wanted: DataFrame) -> DataFrame:
    """Questions and tasks from the same document as each wanted decision."""
    others = kos.where("ko_type in ('question','task')").select(
        F.col("id").alias("other_id"), "ko_type", "source_doc")
    return (wanted.where("source_doc is not null").select("id", "source_doc").join(others, "source_doc")
            .where(F.col("id") != F.col("other_id")).select("id", "other_id", "ko_type"))


def best_text_decision(kos: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id): the decision with the best text score, else the newest by word starts."""
    decisions = kos.where("ko_type = 'decision'").select("id")
    direct = materialize(best_texts(ko_text(kos), queries, 1, decisions).select("query_id", "id"))
    rest = queries.join(direct.select("query_id"), "query_id", "left_anti")
    by_start = prefix_search(kos.where("ko_type = 'decision'"), rest, 1).select("query_id", "id")
    return direct.unionByName(by_start)


