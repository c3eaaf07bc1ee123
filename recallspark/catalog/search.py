"""Queries over lookups, ranked search, packs, dossiers and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..adapters import AS_OF, Tables
from ..functions import text as TX
from ..operators import extract as X, retrieval as R
from ..plans import packs as K
from ..registry import query
from ..session import written


@query
def filter_kos(t: Tables) -> DataFrame:
    return R.filter_kos(t.kos(), ko_type="task", status="active", project="nation_1", person="customer#").select("id", "date", "project")


@query
def date_windows(t: Tables) -> DataFrame:
    windows = TX.date_windows(F.col("date"), AS_OF)
    return t.kos().groupBy("ko_type").agg(*[F.count_if(c).alias(name) for name, c in windows.items()])


@query
def list_documents(t: Tables) -> DataFrame:
    return R.list_documents(t.docs(), 100).select("id", "date", "path")


@query
def find_entities(t: Tables) -> DataFrame:
    return R.find_entities(t.entities(), "plan nation_1").select("id", "name", "entity_type")


@query
def list_entities(t: Tables) -> DataFrame:
    return R.list_entities(t.entities(), "organization").select("id", "name")


@query
def timeline(t: Tables) -> DataFrame:
    return R.timeline(t.kos()).select("id", "date", "title")


@query
def dated_lists(t: Tables) -> DataFrame:
    return R.dated_list(t.kos(), "decision")


@query
def digest_docs(t: Tables) -> DataFrame:
    return R.digest_docs(t.docs())


@query
def clean_query_terms(t: Tables) -> DataFrame:
    q = t.bench_queries()
    return q.select("query_id", TX.query_terms(F.col("text")).alias("terms"), F.size(TX.query_terms(F.col("text"))).alias("n"))


@query
def as_list(t: Tables) -> DataFrame:
    items = TX.as_list(F.col("html"))
    return t.read("pages").select("page_id", F.size(items).alias("n"), F.md5(F.array_join(items, "|")).alias("digest"))


@query
def infer_doc_type(t: Tables) -> DataFrame:
    d = t.docs().withColumn("path", F.concat(F.when(F.col("source") == "src0", "brain/meetings/").when(
        F.col("source") == "src1", "brain/Decisions/").when(F.col("source") == "src2", "x/research/").otherwise(""), "path"))
    return d.select("id", TX.infer_doc_type(F.col("path")).alias("doc_type"))


@query
def parse_flexible_date(t: Tables) -> DataFrame:
    o = t.read("orders").withColumn("d", F.to_date("o_orderdate"))
    shapes = F.array(F.date_format("d", "yyyy-MM-dd HH"), F.date_format("d", "d-M-yyyy"), F.date_format("d", "dd/MM/yyyy"),
                     F.date_format("d", "yyyy/MM/dd"), F.lit("31/02/2001"), F.lit(" pronto "))
    raw = F.element_at(shapes, (F.col("o_orderkey") % 6 + 1).cast("int"))
    return o.select("o_orderkey", TX.parse_flexible_date(raw).alias("day"))


@query
def sender_name(t: Tables) -> DataFrame:
    return t.mail().select("id", TX.sender_name(F.col("from")).alias("name"))


# -- ranked search ------------------------------------------------------------------


@query
def build_postings(t: Tables) -> DataFrame:
    return R.build_postings(R.doc_text(t.docs())).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("dl").alias("longest"))


@query
def bm25_documents(t: Tables) -> DataFrame:
    return R.bm25_documents(t.docs(), t.bench_queries(), 5)


@query
def bm25_kos(t: Tables) -> DataFrame:
    return R.bm25_kos(t.kos(), t.questions().select("query_id", "text"), 20)


@query
def hits_join(t: Tables) -> DataFrame:
    return R.hits_join(R.bm25_documents(t.docs(), t.bench_queries(), 5), t.docs(), ["path", "date"]).select("query_id", "rank", "path", "date")


@query
def topk_retrieval(t: Tables) -> DataFrame:
    return R.bm25_documents(t.docs(), t.bench_queries(), 20).select("query_id", "rank", "id")


@query
def term_overlap_search(t: Tables) -> DataFrame:
    return R.term_overlap_search(R.doc_text(t.docs()), t.bench_queries(), 5)


@query
def prefix_search(t: Tables) -> DataFrame:
    return R.prefix_search(t.kos(), t.questions().select("query_id", "text"), 12).select("query_id", "rank", "id")


@query
def classify_intent(t: Tables) -> DataFrame:
    return R.classify_intent(t.questions()).select("query_id", "intent", "memories")


@query
def query_entities(t: Tables) -> DataFrame:
    return R.query_entities(t.questions(), t.entities())


@query
def context_pack(t: Tables) -> DataFrame:
    return K.context_pack(t.questions().select("query_id", "text"), t.written("kos"), t.docs(), t.entities(), t.edges())


@query
def pack_caps(t: Tables) -> DataFrame:
    pack = K.context_pack(t.questions().select("query_id", "text"), t.written("kos"), t.docs(), t.entities(), t.edges())
    kos = pack.where("section in ('decisions','commitments','episodic','kos','questions')")
    return kos.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last"))


@query
def merge_pack_sections(t: Tables) -> DataFrame:
    q = t.questions().select("query_id", "text")
    text = R.bm25_kos(t.kos(), q, 20).select("query_id", "id", "rank")
    a = text.select("query_id", "id", "rank", F.lit("kos").alias("section"), F.lit(1).alias("source"), F.lit(0).alias("place"))
    b = R.prefix_search(t.kos(), q, 12).select("query_id", "id", "rank", F.lit("starts").alias("section"), F.lit(1).alias("source"),
                                               F.lit(1).alias("place"))
    return K.merge_pack_sections(a.unionByName(b), 25).select("query_id", "section", "rank", "id")


@query
def gather_material(t: Tables) -> DataFrame:
    """Topics with words that objects hold, with word starts only, and with neither; two of three wish an area."""
    nations = t.read("nation").join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "n_nationkey", "r_name")
    word = F.element_at(F.array(F.lit("entrega"), F.lit("pedidos"), F.lit("nada")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    wish = F.when(F.col("n_nationkey") % 5 > 1, F.col("r_name"))
    segment = F.when(F.col("n_nationkey") % 3 == 0, F.lower("segment"))
    topics = t.questions().join(nations, "n_name").select("query_id", F.concat_ws(" ", word, segment).alias("text"), wish.alias("area"))
    lang_area = F.create_map(*[F.lit(x) for x in ("en", "AMERICA", "fr", "EUROPE", "de", "ASIA", "es", "AFRICA")])
    docs = t.docs().withColumn("area", lang_area[F.element_at("tags", 1)])
    return K.gather_material(topics, t.written("kos"), docs).select("query_id", "section", "rank", "item_id", "date", "text")


@query
def decision_dossier(t: Tables) -> DataFrame:
    return K.decision_dossier(t.questions().select("query_id", "text"), t.written("kos"), t.docs())


@query
def decision_neighbours(t: Tables) -> DataFrame:
    kos = t.written("kos")
    return R.decision_neighbours(kos, kos.where("ko_type = 'decision'"))


@query
def same_source_items(t: Tables) -> DataFrame:
    return R.same_source_items(t.kos(), t.kos().where("ko_type = 'decision'"))


# -- vectors -----------------------------------------------------------------------------


@query
def chunk_documents(t: Tables) -> DataFrame:
    return R.chunk_documents(t.docs()).select("id", "ordinal", F.length("content").alias("n_chars"), F.md5("content").alias("digest"))


@query
def vector_topk(t: Tables) -> DataFrame:
    return R.vector_topk(t.vectors(), R.centroids(t.vectors()), 10).select("query_id", "rank", "id", F.round("similarity", 6).alias("similarity"))


@query
def hybrid_search(t: Tables) -> DataFrame:
    q = t.bench_queries()
    asked = t.vectors().select(F.substring_index("id", "-", -1).alias("query_id"), "embedding").join(q.select("query_id"), "query_id", "left_semi")
    text = R.bm25_documents(t.docs(), q, 20)
    return R.hybrid_search(text, R.vector_topk(t.vectors(), asked, 20), 10)


# -- enrichment ------------------------------------------------------------------------------


def _outputs(n: DataFrame) -> DataFrame:
    """Extractor output as a table: one JSON text per note, built from its columns."""
    fact = F.struct(F.lit("fact").alias("ko_type"), F.concat(F.lit("Dato "), "id").alias("title"), F.col("body").alias("statement"),
                    F.col("people"), F.lit(None).cast("string").alias("project"), F.lit("tentative").alias("confidence"),
                    F.array(F.lit("x")).alias("tags"))
    bare = F.struct(F.lit(None).cast("string").alias("ko_type"), F.lit("t").alias("title"), F.lit("s").alias("statement"),
                    F.lit(None).cast("array<string>").alias("people"), F.lit("P").alias("project"),
                    F.lit(None).cast("string").alias("confidence"), F.lit(None).cast("array<string>").alias("tags"))
    who = F.element_at("people", 1)
    ents = F.array(F.struct(who.alias("name"), F.lit("person").alias("entity_type")),
                   F.struct(F.col("project").alias("name"), F.lit(None).cast("string").alias("entity_type")))
    rels = F.array(F.struct(who.alias("source"), F.col("project").alias("target"), F.lit("leads").alias("rel_type")),
                   F.struct(who.alias("source"), F.lit("nadie").alias("target"), F.lit("leads").alias("rel_type")))
    body = F.to_json(F.struct(F.array(fact, bare).alias("knowledge_objects"), ents.alias("entities"), rels.alias("relationships")))
    return n.select("id", F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("output"))


@query
def normalise_extractor_output(t: Tables) -> DataFrame:
    """The notes are written once, for the extractor's output and for what it is joined with."""
    notes = written(t.notes().select("id", "date", "project", "people", "body"), "notes", packed=True)
    kos, _, _ = X.normalise_extractor_output(_outputs(notes), notes)
    return kos.select("source_doc", "ko_type", "title", "statement", "people", "project", "confidence")


@query
def remap_extracted_ids(t: Tables) -> DataFrame:
    _, _, edges = X.normalise_extractor_output(_outputs(t.notes()), t.notes())
    return edges.select("source_id", "target_id", "rel_type", "source_doc", "valid_from")


@query
def allowed_areas(t: Tables) -> DataFrame:
    asked = t.areas().select(F.col("id").alias("area"))
    never = t.overrides().where("status = 'pausada'").select("area")
    return X.allowed_areas(asked, never)


@query
def pending_enrichment(t: Tables) -> DataFrame:
    never = t.overrides().where("status = 'pausada'").select("area")
    allowed = X.allowed_areas(t.areas().select(F.col("id").alias("area")), never)
    docs = t.notes().withColumn("area", F.element_at("organizations", 1))
    docs = docs.withColumn("metadata", F.create_map(F.lit("extractor"), F.when(F.col("doc_type") == "meeting", "Model")))
    return X.pending_enrichment(docs, allowed, "Model").select("id", "area")


@query
def replace_with_enriched(t: Tables) -> DataFrame:
    """The notes are written once; the extractor's output is that of the meetings among them."""
    notes = t.written("notes")
    meetings = notes.where("doc_type = 'meeting'")
    out = X.replace_with_enriched(meetings, X.extract_marked_lines(notes), X.link_people_projects(notes), X.extract_entities(notes),
                                  _outputs(meetings), "Model")
    counts = out["kos"].groupBy("ko_type").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("ko:"), "ko_type").alias("what"), "n")
    rels = out["relationships"].groupBy("rel_type").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("rel:"), "rel_type").alias("what"), "n")
    gone = out["removed"].select(F.concat(F.lit("removed:"), "what").alias("what"), F.col("removed").alias("n"))
    return counts.unionByName(rels).unionByName(gone)
