"""Context packs, material per topic and decision dossiers, for whole tables of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import fixed
from ..operators.graph import incident_edges
from ..operators.retrieval import (best_text_decision, best_texts, bm25_documents, classify_intent, decision_neighbours, doc_text,
                                   ko_text, newest, prefix_text, query_entities, question_starts, same_source_items, start_hits)
from ..operators.scale import contains_pairs, first_per_key, top_per_group
from ..session import materialize

# section: (object type, required status)
SECTIONS = {"decisions": ("decision", None), "commitments": ("task", "active"), "episodic": ("event", None),
            "questions": ("question", "active")}



def _typed(kos: DataFrame) -> DataFrame:
    """(section, id, date, people) of every object that can fill a section."""
    cases = None
    for section, (ko_type, status) in SECTIONS.items():
        hit = F.col("ko_type") == ko_type
        if status is not None:
            hit = hit & (F.col("status") == status)
        cases = F.when(hit, section) if cases is None else cases.when(hit, section)
    return kos.select(cases.alias("section"), "id", "date", "people").where("section is not null")


def question_sections(routed: DataFrame) -> DataFrame:
    """(query_id, section, place): the memories of the plan, then always the open questions."""
    plan = F.concat("memories", F.array(F.lit("questions")))
    return routed.select("query_id", F.posexplode(plan).alias("place", "section"))


def person_candidates(kos: DataFrame, matched: DataFrame, k: int) -> DataFrame:
    """Objects that name a matched entity, newest first per question and section."""
    named = _typed(kos).select("section", "id", "date", F.explode("people").alias("who")).withColumn("low", F.lower("who"))
    asked = matched.select("query_id", "name", F.lower("name").alias("needle"))
    pairs = contains_pairs(named.select("low"), asked.select("needle"))
    wanted = pairs.join(asked, "needle").select(F.col("hay").alias("low"), "query_id", "name")
    rows = named.join(wanted, "low").groupBy("query_id", "section", "id", "date").agg(F.min("name").alias("name"))
    return top_per_group(rows, ["query_id", "section"], [F.asc("name"), newest(), F.asc("id")], k)


def merge_pack_sections(candidates: DataFrame, max_kos: int) -> DataFrame:
    """Ordered union: a section uses its best source only, an object stays in its first section."""
    best = Window.partitionBy("query_id", "section")
    chosen = candidates.withColumn("top", F.min("source").over(best)).where(F.col("source") == F.col("top"))
    once = first_per_key(chosen.select("query_id", "id", "place", "section", "rank"), ["query_id", "id"],
                         [F.col("place"), F.col("rank")])
    return top_per_group(once.withColumnRenamed("rank", "pos"), ["query_id"],
                         [F.asc("place"), F.asc("pos"), F.asc("id")], max_kos)


def context_pack(queries: DataFrame, kos: DataFrame, docs: DataFrame, entities: DataFrame, edges: DataFrame,
                 max_kos: int = fixed.PACK_MAX_KOS, max_docs: int = fixed.PACK_MAX_DOCS) -> DataFrame:
    """(query_id, section, rank, item_id). Entities and relationships are sets and carry rank 0."""
    routed = materialize(classify_intent(queries))
    sections = question_sections(routed)
    matched = materialize(query_entities(queries, entities))
    typed = _typed(kos).select("section", "id")
    places = typed.unionByName(kos.select(F.lit("kos").alias("section"), "id"))
    text = best_texts(ko_text(kos), queries, 20, places, within=["section"])

    by_person = person_candidates(kos, matched, max_kos).select(
        "query_id", "section", "id", "rank", F.lit(0).alias("source"))
    by_text = text.select("query_id", "section", "id", "rank", F.lit(1).alias("source"))
    recent = top_per_group(_typed(kos), ["section"], [newest(), F.asc("id")], 10).select(
        "section", "id", "rank", F.lit(2).alias("source"))
    by_date = sections.select("query_id", "section").join(recent, "section").select(
        "query_id", "section", "id", "rank", "source")
    candidates = (by_person.unionByName(by_text).unionByName(by_date)
                  .join(sections, ["query_id", "section"]))
    objects = merge_pack_sections(candidates, max_kos).select("query_id", "section", "rank", F.col("id").alias("item_id"))

    asks_docs = routed.where(F.array_contains("memories", "documents")).select("query_id", "text")
    documents = bm25_documents(docs, asks_docs, max_docs).select(
        "query_id", F.lit("documents").alias("section"), "rank", F.col("id").alias("item_id"))
    ents = matched.select("query_id", F.lit("entities").alias("section"), F.lit(0).alias("rank"),
                          F.col("entity_id").alias("item_id"))
    rels = (incident_edges(edges).join(matched.select("query_id", F.col("entity_id").alias("node_id")), "node_id")
            .select("query_id", F.lit("relationships").alias("section"), F.lit(0).alias("rank"),
                    F.col("id").alias("item_id")).distinct())
    return objects.unionByName(documents).unionByName(ents).unionByName(rels)


def gather_material(topics: DataFrame, kos: DataFrame, docs: DataFrame, limit: int = 12, max_docs: int = 6) -> DataFrame:
    """(query_id, section, rank, item_id, date, text) of what the memory holds on each topic.

    ``topics`` has (query_id, text) and may have ``area``: hits are then kept inside the area,
    and a type without any falls back to the newest of the area. So do documents, which may have
    ``area`` too: the best of the area by text, then by word starts, then its newest.
    """
    if "area" not in topics.columns:
        topics = topics.withColumn("area", F.lit(None).cast("string"))
    topics = topics.select("query_id", "text", F.col("area").alias("wish"))
    kinds = {"decision": "decisions", "task": "tasks", "event": "events", "question": "questions"}
    section = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    slim = kos.where(F.col("ko_type").isin(list(kinds))).select("id", section[F.col("ko_type")].alias("section"), "date", "statement", "area")
    ranked = topic_hits(topics, ko_text(kos), prefix_text(kos, with_people=False), slim, limit, ["section"])
    objects = ranked.join(slim.select("id", "date", "statement"), "id").select(
        "query_id", "section", "rank", F.col("id").alias("item_id"), "date", F.col("statement").alias("text"))
    return objects.unionByName(topic_documents(topics, docs, max_docs))


def topic_hits(topics: DataFrame, texts: DataFrame, start_texts: DataFrame, items: DataFrame, k: int, within: list[str]) -> DataFrame:
    """(query_id, *within, id, rank): the best ``k`` of ``items`` (id, date, area, *within) per topic (query_id,
    text, wish): by text, else by word starts, newest first, else the newest of the area that the topic wishes."""
    key = ["query_id", *within]
    every = F.lit(None).cast("string")
    places = items.select("id", "date", *within, F.explode(F.array_distinct(F.array(every, F.col("area")))).alias("wish"))  # once for all topics, once for its area
    asked = topics.withColumn("wish", F.coalesce("wish", F.lit("")))
    text = materialize(best_texts(texts, asked, k, places.drop("date").withColumn("wish", F.coalesce("wish", F.lit(""))), ["wish"], within, "ord")
                       .select(*key, "id", "ord"))
    asked_starts = question_starts(topics).join(topics.select("query_id", "wish"), "query_id")
    # of each word start only as many as a topic can need, newest first
    starts = start_hits(start_texts, asked_starts).join(places, "id").withColumn(
        "ord", -F.datediff("date", F.lit("1970-01-01")))
    starts = top_per_group(starts, ["needle", *within, "wish"], [F.asc("ord"), F.asc("id")], k, "__r")
    starts = starts.withColumnRenamed("needle", "__needle").withColumnRenamed("wish", "__wish")
    starts = starts.join(asked_starts, (F.col("__needle") == F.col("needle")) & F.col("__wish").eqNullSafe(F.col("wish")))
    starts = starts.select(*key, "id", "ord").distinct()
    left = lambda more, have: more.join(have.select(*key).distinct(), key, "left_anti")
    starts = materialize(top_per_group(left(starts, text), key, [F.asc("ord"), F.asc("id")], k, "__r").drop("__r"))
    hits = text.unionByName(starts)
    recent = top_per_group(items.where("area is not null"), [*within, "area"], [newest(), F.asc("id")], k, "ord")
    newest_of_area = recent.join(topics.select("query_id", F.col("wish").alias("area")), "area").select(*key, "id", "ord")
    hits = hits.unionByName(left(newest_of_area, hits))
    return top_per_group(hits, key, [F.asc("ord"), F.asc("id")], k).select(*key, "id", "rank")


def topic_documents(topics: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Best documents per topic (query_id, text, wish): text hits, else word starts newest first, else the
    newest of the area."""
    area = F.col("area") if "area" in docs.columns else F.lit(None).cast("string")
    items = docs.select("id", "date", area.alias("area"))
    ranked = topic_hits(topics, doc_text(docs), doc_text(docs), items, k, [])
    width = F.when(F.col("doc_type") == "paper", 400).otherwise(600)
    section = F.when(F.col("doc_type") == "paper", "papers").otherwise("documents")
    return (ranked.join(docs.select("id", "date", "doc_type", "body"), "id")
            .select("query_id", section.alias("section"), "rank", F.col("id").alias("item_id"), "date",
                    F.substring("body", F.lit(1), width).alias("text")))


def decision_dossier(queries: DataFrame, kos: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, section, rank, item_id): the decision a question is about and what surrounds it.

    Tasks and questions of the same document are a set and carry rank 0.
    """
    chosen = materialize(best_text_decision(kos, queries).join(kos, "id"))
    decision = chosen.select("query_id", F.lit("decision").alias("section"), F.lit(1).alias("rank"), F.col("id").alias("item_id"))
    source = (chosen.select("query_id", F.col("source_doc").alias("id")).join(docs.select("id"), "id")
              .select("query_id", F.lit("source").alias("section"), F.lit(1).alias("rank"), F.col("id").alias("item_id")))
    one = chosen.select("id", "project", "area", "date", "source_doc").dropDuplicates(["id"])
    link = chosen.select("query_id", "id")
    around = (decision_neighbours(kos, one).join(link, "id")
              .select("query_id", F.col("side").alias("section"), "rank", F.col("other_id").alias("item_id")))
    same = (same_source_items(kos, one).join(link, "id")
            .select("query_id", F.concat("ko_type", F.lit("s")).alias("section"), F.lit(0).alias("rank"),
                    F.col("other_id").alias("item_id")))
    titled = chosen.select("query_id", F.col("title").alias("text"))
    hyp = best_texts(ko_text(kos), titled, 20, kos.where("ko_type = 'hypothesis'").select("id"))
    hyp = hyp.select("query_id", F.lit("hypotheses").alias("section"), "rank", F.col("id").alias("item_id"))
    return decision.unionByName(source).unionByName(around).unionByName(same).unionByName(hyp)
