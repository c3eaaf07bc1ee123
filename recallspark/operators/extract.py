"""Documents to knowledge objects, entities and relationships."""

from __future__ import annotations

from functools import reduce
from typing import Callable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.text import empty_strings, natural_id
from ..schemas import EDGE_COLUMNS, ENTITY_COLUMNS, KO_COLUMNS
from .areas import classify_documents, ko_inherit_area
from .scale import dealt
from .tables import delete_derived, mark_extractor, merge_relationships, upsert_entities

EXTRACTOR_OUTPUT = (
    "knowledge_objects array<struct<ko_type:string,title:string,statement:string,"
    "people:array<string>,project:string,confidence:string,tags:array<string>>>,"
    "entities array<struct<name:string,entity_type:string>>,"
    "relationships array<struct<source:string,target:string,rel_type:string>>")


def mark_of(line: Column) -> Column:
    """(ko_type, text) of the first mark that fits the line, NULL if none does."""
    out = None
    for ko_type, pattern in fixed.LINE_MARKS:
        value = F.struct(F.lit(ko_type).alias("ko_type"),
                         F.trim(F.regexp_extract(line, pattern, 1)).alias("text"))
        hit = line.rlike(pattern)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def marks_in(body: Column) -> Column:
    """Array of (line_no, mark) of a text, each line tested once; most lines hold no sign of a mark."""
    def tested(line: Column, i: Column) -> Column:
        signs = reduce(lambda a, b: a | b, (F.contains(line, F.lit(sign)) for sign in fixed.MARK_SIGNS))
        return F.struct(i.alias("line_no"), F.when(signs, mark_of(line)).alias("mark"))

    tested = F.transform(F.split(body, r"\R"), tested)
    return F.filter(tested, lambda m: m["mark"].isNotNull())


def marked_lines(docs: DataFrame) -> DataFrame:
    """(doc columns, line_no, ko_type, text) for every marked line of the body.

    The outer explode keeps the optimizer from adding a size test that would read every
    line a second time; documents without marks go with the NULL test behind it.
    """
    marks = docs.select("*", F.explode_outer(marks_in(F.col("body"))).alias("m")).drop("body")
    return marks.where("m is not null").select("*", "m.line_no", "m.mark.ko_type", "m.mark.text").drop("m")


def extract_all(docs: DataFrame) -> DataFrame:
    """Marked lines and the meeting event in one pass over the documents."""
    event = F.array(F.struct(F.lit(-1).alias("line_no"), F.struct(
        F.lit("event").alias("ko_type"), F.concat(F.lit("Reunión registrada: "), "title").alias("text")).alias("mark")))
    every = F.when(F.col("doc_type") == "meeting", F.concat(event, marks_in(F.col("body")))).otherwise(marks_in(F.col("body")))
    rows = docs.select("*", F.explode_outer(every).alias("m")).drop("body").where("m is not null")
    is_event = F.col("m.line_no") < 0
    kind, source = F.col("m.mark.ko_type"), F.col("id")
    return _finish(
        rows.withColumn("ko_type", kind).withColumn("source_doc", source)
        .withColumn("id", F.when(is_event, natural_id("ko", source, F.lit("event")))
                    .otherwise(natural_id("ko", source, F.col("m.line_no"), kind)))
        .withColumn("statement", F.col("m.mark.text"))
        .withColumn("title", F.when(is_event, F.col("title")).otherwise(F.substring("statement", 1, 80)))
        .withColumn("confidence", F.when(kind.isin("decision", "event"), "confirmed").otherwise("probable")))


def _finish(df: DataFrame) -> DataFrame:
    return (df.withColumn("status", F.lit("active")).withColumn("valid_from", F.col("date"))
            .withColumn("valid_to", F.lit(None).cast("date")).select(*KO_COLUMNS))


def extract_marked_lines(docs: DataFrame) -> DataFrame:
    """Knowledge objects from the marked lines."""
    out = (marked_lines(docs)
           .withColumn("source_doc", F.col("id"))
           .withColumn("id", natural_id("ko", F.col("source_doc"), F.col("line_no"), F.col("ko_type")))
           .withColumn("title", F.substring("text", 1, 80))
           .withColumn("statement", F.col("text"))
           .withColumn("confidence", F.when(F.col("ko_type") == "decision", "confirmed").otherwise("probable")))
    return _finish(out)


def extract_meeting_events(docs: DataFrame) -> DataFrame:
    """One confirmed event per meeting document."""
    out = (docs.where("doc_type = 'meeting'")
           .withColumn("source_doc", F.col("id"))
           .withColumn("id", natural_id("ko", F.col("source_doc"), F.lit("event")))
           .withColumn("ko_type", F.lit("event"))
           .withColumn("statement", F.concat(F.lit("Reunión registrada: "), F.col("title")))
           .withColumn("confidence", F.lit("confirmed")))
    return _finish(out)


def entity_id(name: Column, entity_type: Column) -> Column:
    return natural_id("ent", name, entity_type)


def extract_entities(docs: DataFrame) -> DataFrame:
    """Distinct people, organizations and projects named by the documents."""
    def typed(values: Column, kind: str) -> Column:
        return F.transform(F.coalesce(values, empty_strings()),
                           lambda v: F.struct(v.alias("name"), F.lit(kind).alias("entity_type")))
    project = F.filter(F.array(F.col("project")), lambda p: p.isNotNull())
    every = F.concat(typed(F.col("people"), "person"), typed(F.col("organizations"), "organization"),
                     typed(project, "project"))
    pairs = docs.select(F.explode(every).alias("e")).select("e.*").distinct()
    return (pairs.withColumn("id", entity_id(F.col("name"), F.col("entity_type")))
            .withColumn("aliases", empty_strings()).select(*ENTITY_COLUMNS))


def link_people_projects(docs: DataFrame) -> DataFrame:
    """``participates_in`` edge from every person of a document to its project."""
    rows = docs.where("project is not null").select(F.explode("people").alias("person"), "project", "date", F.col("id").alias("source_doc"))
    # Names are compared before ids are made of them, so fewer bytes travel; rows are dealt by document once,
    # which also serves what is joined or merged by document afterwards.
    rows = rows.withColumn("person", F.coalesce("person", F.lit(""))).repartition("source_doc").dropDuplicates(["person", "project", "source_doc"])
    out = (rows.withColumn("source_id", entity_id(F.col("person"), F.lit("person")))
           .withColumn("target_id", entity_id(F.col("project"), F.lit("project")))
           .withColumn("rel_type", F.lit("participates_in"))
           .withColumn("id", natural_id("rel", F.col("source_id"), F.col("target_id"),
                                        F.col("rel_type"), F.col("source_doc")))
           .withColumn("valid_from", F.col("date")).withColumn("valid_to", F.lit(None).cast("date"))
           .withColumn("confidence", F.lit("probable")))
    return out.select(*EDGE_COLUMNS)


def number_of_marks() -> Column:
    """How many rows ``extract_marked_lines`` makes of a document."""
    return F.size(marks_in(F.col("body")))


def number_of_links() -> Column:
    """How many rows ``link_people_projects`` makes of a document."""
    names = F.transform("people", lambda p: F.coalesce(p, F.lit("")))
    return F.when(F.col("project").isNotNull(), F.size(F.array_distinct(names)))


def run_extractor(docs: DataFrame, extractor: Callable[[Iterator], Iterator]) -> DataFrame:
    """Call a user function on Arrow batches of documents.

    The function receives pandas frames (id, title, date, doc_type, body) and yields frames
    (id, output) where ``output`` is the JSON text described by ``EXTRACTOR_OUTPUT``.
    """
    batch = docs.select("id", "title", F.col("date").cast("string").alias("date"), "doc_type", "body")
    return batch.mapInPandas(extractor, "id string, output string")


def strip_fences(c: Column) -> Column:
    text = F.trim(c)
    inner = F.regexp_replace(F.regexp_replace(text, r"^```[a-z]*\n?", ""), r"\n?```$", "")
    return F.trim(F.when(text.startswith("```"), inner).otherwise(text))


def normalise_extractor_output(outputs: DataFrame, docs: DataFrame, title_chars: int | None = None
                               ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Extractor JSON per document to (knowledge objects, entities, relationships) with defaults.
    Titles stay whole unless ``title_chars`` cuts them."""
    title = F.coalesce("k.title", F.lit(""))
    title = title if title_chars is None else F.substring(title, 1, title_chars)
    parsed = (outputs.withColumn("p", F.from_json(strip_fences(F.col("output")), EXTRACTOR_OUTPUT))
              .select(F.col("id").alias("source_doc"), "p.*"))
    head = docs.select(F.col("id").alias("source_doc"), "date", F.col("project").alias("doc_project"))
    # The outer explode keeps the optimizer from adding a size test, which would travel below the output's own
    # expression and make and parse every text again.
    # A document meets its head before its objects are taken apart, so its id travels once and not with each of them.
    kos = (parsed.select("source_doc", "knowledge_objects").join(dealt(head), "source_doc")
           .select("source_doc", "date", "doc_project", F.posexplode_outer("knowledge_objects").alias("n", "k")).where("n is not null")
           .select(natural_id("ko", F.col("source_doc"), F.lit("x"), F.col("n")).alias("id"),
                   F.coalesce("k.ko_type", F.lit("fact")).alias("ko_type"),
                   title.alias("title"),
                   F.coalesce("k.statement", F.lit("")).alias("statement"), "date",
                   F.coalesce("k.people", empty_strings()).alias("people"),
                   F.coalesce(F.when(F.col("k.project") != "", F.col("k.project")), F.col("doc_project")).alias("project"),
                   F.coalesce("k.confidence", F.lit("probable")).alias("confidence"), "source_doc",
                   F.coalesce("k.tags", empty_strings()).alias("tags"),
                   F.lit(None).cast("string").alias("area")))
    named = (parsed.select(F.explode_outer("entities").alias("e"))
             .where("e.name is not null")
             .select(F.col("e.name").alias("name"), F.coalesce("e.entity_type", F.lit("concept")).alias("entity_type"))
             .withColumn("id", entity_id(F.col("name"), F.col("entity_type"))))
    entities = (named.select("id", "name", "entity_type").distinct()
                .withColumn("aliases", empty_strings()).select(*ENTITY_COLUMNS))
    return _finish(kos), entities, remap_extracted_ids(parsed, head.select("source_doc", "date"))


def remap_extracted_ids(parsed: DataFrame, dates: DataFrame) -> DataFrame:
    """Entity names inside a document to ids; an edge with an unknown end is dropped.

    A name listed twice in one document means its last listing. ``parsed`` (source_doc, entities,
    relationships) and ``dates`` (source_doc, date) are each grouped by document once, and the names of a
    document are looked up in its own row.
    """
    no_names, no_rels = (F.array().cast(parsed.schema[c].dataType) for c in ("entities", "relationships"))
    listed = F.transform(F.coalesce("entities", no_names), lambda e, n: F.struct(
        n.alias("n"), e["name"].alias("name"), F.coalesce(e["entity_type"], F.lit("concept")).alias("kind")))
    held = parsed.groupBy("source_doc").agg(F.sort_array(F.flatten(F.collect_list(listed))).alias("names"),
                                            F.flatten(F.collect_list(F.coalesce("relationships", no_rels))).alias("rels"))
    last = lambda name: F.try_element_at(F.filter("names", lambda x: x["name"] == name), F.lit(-1))
    known = lambda name: F.transform(F.array(last(name)), lambda x: F.when(x.isNotNull(), entity_id(x["name"], x["kind"])))[0]
    ends = F.transform("rels", lambda r: F.struct(known(r["source"]).alias("source_id"), known(r["target"]).alias("target_id"),
                                                  F.coalesce(r["rel_type"], F.lit("related_to")).alias("rel_type")))
    rows = held.join(dates.groupBy("source_doc").agg(F.min("date").alias("date")), "source_doc")
    rows = rows.select("source_doc", "date", F.explode(F.array_distinct(ends)).alias("r")).select("source_doc", "date", "r.*")
    return (rows.where("source_id is not null and target_id is not null")
            .withColumn("id", natural_id("rel", F.col("source_id"), F.col("target_id"),
                                         F.col("rel_type"), F.col("source_doc")))
            .withColumn("valid_from", F.col("date")).withColumn("valid_to", F.lit(None).cast("date"))
            .withColumn("confidence", F.lit("probable"))
            .select(*EDGE_COLUMNS))


def allowed_areas(requested: DataFrame, never: DataFrame) -> DataFrame:
    """Areas open to an external extractor; the forbidden list always wins."""
    return requested.select("area").distinct().join(never.select("area"), "area", "left_anti")


def pending_enrichment(docs: DataFrame, areas: DataFrame, done_by: str, limit: int | None = None) -> DataFrame:
    """Documents of the allowed areas not yet processed by ``done_by``, newest first."""
    done = F.coalesce(F.element_at("metadata", F.lit("extractor")), F.lit(""))
    out = docs.join(areas.select("area"), "area", "left_semi").where(done != done_by)
    return out if limit is None else out.orderBy(F.desc("date"), "id").limit(limit)


def replace_with_enriched(docs: DataFrame, kos: DataFrame, edges: DataFrame, entities: DataFrame,
                          outputs: DataFrame, name: str, areas: DataFrame | None = None) -> dict[str, DataFrame]:
    """Swap what the pending documents yielded for the new extractor's rows.

    Stored entities stay as they are, edges are merged by their four-column key. With the area map
    every document and object is labelled anew. Running it again with the same output gives the same tables.
    """
    new_kos, new_entities, new_edges = normalise_extractor_output(outputs, docs)
    ids = outputs.select("id").distinct()
    kept_kos, kept_edges, removed = delete_derived(kos, edges, ids)
    done = docs.join(ids, "id", "left_semi")
    rest = docs.join(ids, "id", "left_anti")
    linked = link_people_projects(done)
    documents, all_kos = rest.unionByName(mark_extractor(done, name)), kept_kos.unionByName(new_kos)
    if areas is not None:
        documents = classify_documents(documents, areas).select(*docs.columns)
        all_kos = ko_inherit_area(all_kos, documents, areas).select(*kos.columns)
    return {"documents": documents, "kos": all_kos, "relationships": merge_relationships(kept_edges, new_edges.unionByName(linked)),
            "entities": upsert_entities(entities, new_entities), "removed": removed}
