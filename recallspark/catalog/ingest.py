"""Queries over sources: notes, files, pages, transcripts, chats, accounts, references, plans, folders."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..adapters import AS_OF, Tables
from ..operators import areas as A, citations as C, extract as X, folders as D
from ..registry import query
from ..session import run_dir
from ..sources import accounts as AC, conversations as CV, files as FS, notes as N, plan_sheets as PS, references as RF, snapshot as SN

# -- notes and files ---------------------------------------------------------------


def _raw_notes(t: Tables) -> DataFrame:
    """Markdown texts with a header, written from the note columns."""
    n = t.notes()
    line = lambda k, c: F.concat(F.lit(f"{k}: "), c, F.lit("\n"))
    titled = F.when(F.col("doc_type") == "meeting", line("title", F.concat(F.lit('"'), "title", F.lit(' x"')))).otherwise("")
    dated = F.when(F.col("l_flag") != "N", line("date", F.col("date").cast("string"))).otherwise("")
    head = F.concat(F.lit("---\n"), titled, dated, line("type", F.when(F.col("doc_type") == "meeting", "meeting").otherwise(F.lit("''"))),
                    line("people", F.concat(F.lit("[\""), F.element_at("people", 1), F.lit('", Ana]'))),
                    line("project", F.col("project")), F.lit("---\n\n"))
    path = F.concat(F.lit("vault/"), F.when(F.col("source") == "MACHINERY", "Papers/").when(F.col("source") == "BUILDING", "templates/").otherwise(""),
                    F.col("id"), F.lit(".md"))
    n = n.withColumn("l_flag", F.element_at(F.split("id", "-"), 3))
    n = n.withColumn("l_flag", F.when(F.col("l_flag") == "1", "N").otherwise("Y"))
    return n.select(path.alias("path"), F.concat(head, "body").alias("text"))


@query
def scan_notes(t: Tables) -> DataFrame:
    d = N.parse_notes(_raw_notes(t), AS_OF)
    return d.select("path", "title", "doc_type", "date", F.md5("body").alias("digest"), "people", "project", F.size("metadata").alias("fields"))


@query
def parse_front_matter(t: Tables) -> DataFrame:
    return N.parse_front_matter(_raw_notes(t)).select("path", "names", F.element_at("values", -1).alias("last"))


def _file_rows(t: Tables) -> DataFrame:
    d = t.read("documents")
    k = F.col("doc_id")
    ext = F.element_at(F.array(F.lit(".md"), F.lit(".txt"), F.lit(".jpg"), F.lit(".pdf")), (k % 4 + 1).cast("int"))
    folder = F.when(k % 10 == 0, "node_modules/").when(k % 10 == 1, ".hidden/").when(k % 10 == 2, "Meetings/").otherwise("")
    return d.select(F.concat(F.lit("desk/"), folder, F.when(k % 10 == 3, "~$").otherwise(""), k.cast("string"), ext).alias("path"),
                    F.date_sub(F.lit(AS_OF), (k % 200).cast("int")).cast("timestamp").alias("mtime"),
                    (F.col("n_chars") * 1000).alias("length"), F.col("text").alias("body"))


@query
def scan_files(t: Tables) -> DataFrame:
    return FS.select_files(_file_rows(t)).select("path", "length")


@query
def normalise_file_doc(t: Tables) -> DataFrame:
    docs = FS.normalise_file_doc(FS.select_files(_file_rows(t)), "desk")
    return docs.select("path", "title", "doc_type", "date", F.md5("body").alias("digest"))


@query
def html_to_text(t: Tables) -> DataFrame:
    return FS.html_to_text(t.read("pages")).select("page_id", "text")


# -- conversations ---------------------------------------------------------------------


@query
def speaker_counts(t: Tables) -> DataFrame:
    return CV.speaker_counts(t.transcript_lines()).select("id", "speaker", "n")


@query
def parse_transcript(t: Tables) -> DataFrame:
    return CV.parse_transcript(t.transcript_lines())


@query
def detect_transcript(t: Tables) -> DataFrame:
    return CV.detect_transcript(CV.parse_transcript(t.transcript_lines())).select("id", "is_transcript")


@query
def parse_chat_log(t: Tables) -> DataFrame:
    return CV.parse_chat_log(t.chat_lines())


@query
def scan_chat(t: Tables) -> DataFrame:
    """The lines as two files per chat, read by ranges of bytes and put in order again."""
    path = run_dir(t.spark, "chats")
    lines = t.chat_lines().withColumn("part", F.col("seq") % 2)
    lines.repartition("chat", "part").sortWithinPartitions("chat", "part", "seq").select("chat", "part", "line").write.partitionBy("chat", "part").text(path)
    name = lambda k: F.regexp_extract("path", rf"/{k}=([^/]*)/", 1)
    read = CV.scan_chat(t.spark, path).select(name("chat").alias("chat"), name("part").cast("long").alias("part"), "seq", "line")
    return read.groupBy("chat", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line") * (F.col("seq") % 1000 + 1)).alias("digest"))


@query
def chat_days_to_docs(t: Tables) -> DataFrame:
    docs = CV.chat_days_to_docs(CV.parse_chat_log(t.chat_lines()), "whatsapp")
    return docs.select("path", "title", "date", "people", F.element_at("metadata", F.lit("messages")).alias("messages"), F.md5("body").alias("digest"))


@query
def newest_days_per_chat(t: Tables) -> DataFrame:
    days = CV.parse_chat_log(t.chat_lines()).select("chat", "date").distinct()
    return CV.newest_days_per_chat(days, 10)


@query
def parse_slack_messages(t: Tables) -> DataFrame:
    e = t.read("events")
    messages = e.select(F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("chat"), F.col("event_id").alias("seq"),
                        F.to_date("ts").alias("date"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user"),
                        F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("text"),
                        F.when(F.col("event_type") == "error", "bot_message").alias("subtype"))
    u = e.select("user_id").distinct()
    users = u.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("id"),
                     F.when(F.col("user_id") % 3 < 2, F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("name"),
                     F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("Real "), F.col("user_id").cast("string"))).otherwise("").alias("real_name"))
    return CV.parse_slack_messages(messages, users)


# -- accounts -----------------------------------------------------------------------------


def _calendar(t: Tables) -> DataFrame:
    e = t.read("events")
    u = F.col("user_id").cast("string")
    yes = lambda i: (F.col("event_id") % 4) == i
    guests = F.array(
        F.struct(F.concat(F.lit("u"), u, F.lit("@example.com")).alias("email"), F.when(yes(0), F.concat(F.lit("User "), u)).alias("displayName"),
                 F.lit(False).alias("self"), yes(3).alias("resource")),
        F.struct(F.lit("me@example.com").alias("email"), F.lit("Yo").alias("displayName"), F.lit(True).alias("self"), F.lit(False).alias("resource")))
    day = F.date_format("ts", "yyyy-MM-dd")
    row = F.struct(
        F.concat(F.lit("ev"), F.col("event_id").cast("string")).alias("id"),
        F.when(F.col("event_type") == "error", "cancelled").otherwise("confirmed").alias("status"),
        F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("summary"), F.when(yes(1), "Sala").alias("location"),
        F.when(yes(2), F.col("props")).alias("description"),
        F.struct(F.when(yes(0), day).alias("date"), F.when(~yes(0), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("dateTime")).alias("start"),
        F.struct(F.lit("org@example.com").alias("email")).alias("organizer"), guests.alias("attendees"))
    return AC.from_rows(e.select(F.to_json(row).alias("json")), AC.CALENDAR_EVENT)


@query
def normalise_calendar(t: Tables) -> DataFrame:
    return AC.normalise_calendar(_calendar(t), "acct").select("path", "title", "doc_type", "date", "people", "body")


@query
def calendar_window(t: Tables) -> DataFrame:
    docs = AC.normalise_calendar(_calendar(t), "acct")
    return AC.calendar_window(docs, dt.date(2024, 1, 12), 3, 5).select("path", "date")


def _cloud_files(t: Tables) -> DataFrame:
    d = t.read("documents")
    k = F.col("doc_id")
    kind = F.when(F.col("lang") == "en", "text/plain").when(F.col("lang") == "de", "image/png").otherwise("text/markdown")
    day = F.date_sub(F.lit(AS_OF), (k % 300).cast("int")).cast("string")
    return d.select(k.cast("string").alias("id"), F.concat("source", F.lit(" file")).alias("name"), kind.alias("mimeType"),
                    F.when(k % 3 > 0, F.concat(day, F.lit("T10:00:00Z"))).alias("modifiedTime"), F.concat(day, F.lit("T08:00:00Z")).alias("createdTime"),
                    F.lit(None).cast("string").alias("webViewLink"), F.col("text").alias("content"), F.col("source").alias("account"))


@query
def normalise_drive_files(t: Tables) -> DataFrame:
    return AC.normalise_drive_files(_cloud_files(t), "acct").select("path", "title", "date", F.md5("body").alias("digest"))


@query
def incremental_drive(t: Tables) -> DataFrame:
    """Two runs: over the files as they were on a day, then over all; the cursors are kept in between."""
    files = _cloud_files(t)
    table, cursors = run_dir(t.spark, "drive"), run_dir(t.spark, "drive-cursors")
    AC.read_changed(files.where("modifiedTime is null or modifiedTime <= '2001-04-01T00:00:00Z'"), table, cursors)
    AC.read_changed(files, table, cursors)
    read = t.spark.read.parquet(table).groupBy("account", "run").agg(F.count(F.lit(1)).alias("n"))
    return read.join(t.spark.read.parquet(cursors), ["account", "run"])


@query
def normalise_email(t: Tables) -> DataFrame:
    o = t.order_facts()
    k = F.col("o_orderkey").cast("string")
    stamp = F.concat(F.date_format("day", "EEE, d MMM yyyy"), F.lit(" 09:14:05 "), F.when(F.col("o_orderkey") % 2 == 0, "-0300").otherwise("GMT"))
    header = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    headers = F.array(header("From", F.concat(F.lit('"'), "c_name", F.lit('" <c@example.com>'))), header("TO", F.lit("me@example.com")),
                      header("Date", F.when(F.col("o_orderkey") % 5 == 0, "ayer").otherwise(stamp)),
                      header("subject", F.lit("first")), header("Subject", F.concat(F.lit("pedido "), k)))
    row = F.struct(k.alias("id"), F.lit("corto").alias("snippet"), F.array(F.lit("INBOX")).alias("labelIds"),
                   F.struct(headers.alias("headers")).alias("payload"))
    mail = AC.normalise_email(AC.from_rows(o.select(F.to_json(row).alias("json")), AC.MESSAGE), "acct")
    return mail.select("id", "from", "to", "subject", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "labels")


@query
def email_to_doc(t: Tables) -> DataFrame:
    mail = t.mail()
    captured = mail.where("snippet = 'favor confirmar la entrega'").select("id")
    return AC.email_to_doc(mail, captured).select("title", "doc_type", "date", "body", "people")


def _papers(t: Tables) -> DataFrame:
    p = t.read("part")
    k = F.col("p_partkey").cast("string")
    row = F.struct(
        k.alias("id"), F.when(F.col("p_partkey") % 2 == 0, "PMC").alias("source"),
        F.when(F.col("p_partkey") % 10 == 9, " ").otherwise(F.concat(F.lit("Estudio de "), "p_name", F.lit("."))).alias("title"),
        F.col("p_brand").alias("authorString"), F.when(F.col("p_size") > 5, (F.lit(1960) + F.col("p_size")).cast("string")).otherwise("s/f").alias("pubYear"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("10.1/"), k)).alias("doi"), F.lit("Y").alias("isOpenAccess"),
        F.struct(F.struct(F.col("p_type").alias("title")).alias("journal")).alias("journalInfo"))
    return AC.from_rows(p.select(F.to_json(row).alias("json")), AC.PAPER)


@query
def normalise_papers(t: Tables) -> DataFrame:
    return AC.normalise_papers(_papers(t)).select("path", "title", "date", "body", F.element_at("metadata", F.lit("open_access")).alias("open_access"))


# -- references -------------------------------------------------------------------------------


def _bibtex(t: Tables) -> DataFrame:
    p = t.read("part")
    k = F.col("p_partkey").cast("string")
    one = F.concat(F.lit("@Article{key"), k, F.lit(",\n  title = {El {"), "p_name", F.lit("} y   otros.},\n  AUTHOR = \"Autor "), k,
                   F.lit("\",\n  year={"), (F.lit(1960) + F.col("p_size")).cast("string"), F.lit("},\n  journal = {"), "p_type", F.lit("},\n"),
                   F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("  doi = {https://doi.org/10.5/"), k, F.lit("},\n"))).otherwise(""),
                   F.lit("}\n\n@book{alt"), k, F.lit(", title={"), "p_brand", F.lit("}, booktitle = {Libro}}\n"))
    return p.select(k.alias("id"), one.alias("text"))


@query
def scan_bibtex(t: Tables) -> DataFrame:
    return RF.scan_bibtex(_bibtex(t)).select("key", "type", "title", "author", "year", "journal", "doi")


@query
def scan_library(t: Tables) -> DataFrame:
    """All entries in a few large files, each read by ranges of bytes."""
    path = run_dir(t.spark, "library")
    _bibtex(t).select("text").repartition(2).write.text(path)
    return RF.scan_library(t.spark, path, "bib").select("key", "type", "title", "author", "year", "journal", "doi")


@query
def scan_csl_json(t: Tables) -> DataFrame:
    p = t.read("part")
    k = F.col("p_partkey").cast("string")
    item = F.struct(F.lit("article-journal").alias("type"), k.alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("container-title"),
                    F.concat(F.lit("10.7/"), k).alias("DOI"),
                    F.array(F.struct(F.lit("Ana").alias("given"), F.col("p_brand").alias("family")), F.struct(F.lit(None).cast("string").alias("given"), F.lit("Solo").alias("family"))).alias("author"),
                    F.struct(F.array(F.array(F.lit(1960) + F.col("p_size"), F.lit(2))).alias("date-parts")).alias("issued"))
    texts = p.select(k.alias("id"), F.to_json(F.array(item)).alias("text"))
    return RF.scan_csl_json(texts).select("key", "type", "title", "author", "year", "journal", "doi")


@query
def normalise_reference(t: Tables) -> DataFrame:
    return RF.normalise_reference(RF.scan_bibtex(_bibtex(t))).select("path", "title", "date", "body", F.element_at("metadata", F.lit("doi")).alias("doi"))


@query
def extract_references(t: Tables) -> DataFrame:
    return C.extract_references(t.biblio()).select("doc_id", "raw", "doi", "year", "author")


@query
def distinct_rules(t: Tables) -> DataFrame:
    """First mention of every DOI over the whole corpus, whatever its case."""
    refs = C.extract_references(t.biblio()).where("doi is not null").select("doc_id", "pos", "doi")
    return D.distinct_rules(refs, ["doi"], [F.col("doc_id"), F.col("pos")]).select("doc_id", "doi")


@query
def doi_join(t: Tables) -> DataFrame:
    return C.doi_join(C.extract_references(t.biblio()), t.works()).select("doc_id", "raw", "work_doi", "work_year")


@query
def verify_references(t: Tables) -> DataFrame:
    return C.verify_references(C.extract_references(t.biblio()), t.works()).select("doc_id", "raw", "verdict", "detail")


@query
def reference_summary(t: Tables) -> DataFrame:
    return C.reference_summary(C.verify_references(C.extract_references(t.biblio()), t.works()))


# -- plans ------------------------------------------------------------------------------------


def _plan_starts(t: Tables) -> DataFrame:
    return t.read("lineitem").select(F.concat(F.lit("plan-"), "l_returnflag").alias("file")).distinct().withColumn("plan_start", F.lit(AS_OF))


@query
def scan_plan_rows(t: Tables) -> DataFrame:
    rows = PS.scan_plan_rows(t.plan_sheets(), _plan_starts(t))
    return rows.select("file", "sheet", "row", "activity", "phase", "week", "due", "status", "responsible", "deliverable", "priority")


@query
def pick_best_sheet(t: Tables) -> DataFrame:
    best = PS.pick_best_sheet(PS.scan_plan_rows(t.plan_sheets(), _plan_starts(t)))
    return best.groupBy("file", "sheet").agg(F.count(F.lit(1)).alias("n"))


def _plans(t: Tables) -> DataFrame:
    files = _plan_starts(t).select("file")
    return files.select("file", F.concat(F.lit("doc-"), "file").alias("doc_id"), F.lit(AS_OF).alias("doc_date"), F.lit("tesis").alias("project_id"),
                        F.lit("Tesis").alias("project"), F.array(F.lit("Luz")).alias("people"), F.lit("ASIA").alias("area"))


@query
def import_plan_tasks(t: Tables) -> DataFrame:
    rows = PS.scan_plan_rows(t.plan_sheets(), _plan_starts(t))
    tasks = PS.import_plan_tasks(rows, _plans(t))
    return tasks.select("id", "title", "date", "valid_to", "tags", "project")


@query
def load_project_dim(t: Tables) -> DataFrame:
    p = PS.load_project_dim(t.projects())
    return p.select("id", "name", "area", "deadline", F.size("milestones").alias("n"), F.get("milestones", F.lit(0))["due"].alias("first_due"), "keywords")


# -- folders and collections ------------------------------------------------------------------------


def _stats(t: Tables) -> DataFrame:
    return D.folder_stats(t.files(), A.load_area_dim(t.areas()), AS_OF)


@query
def folder_stats(t: Tables) -> DataFrame:
    return _stats(t).select("folder", "total", "supported", "recent", "bytes", "types", "area_guess", "area_hits")


@query
def score_folders(t: Tables) -> DataFrame:
    return D.score_folders(_stats(t)).select("folder", "score", "verdict", "reasons")


@query
def rank_folders(t: Tables) -> DataFrame:
    return D.rank_folders(D.score_folders(_stats(t))).select("rank", "folder", "verdict", "score")


@query
def sources_not_registered(t: Tables) -> DataFrame:
    folders = t.files().select(F.concat_ws("/", "root", "folder").alias("path")).distinct()
    done = t.read("documents").groupBy("source").agg(F.count_if(F.col("lang") == "de").alias("de")).select(
        F.concat(F.lit("/home/Documents/"), "source").alias("path"), "de")
    return D.sources_not_registered(folders, done.where("de = 0"), folders.where("path like '%src1'"))


@query
def token_overlap(t: Tables) -> DataFrame:
    """Folders whose file names share a word with an area."""
    vocab = D.area_vocabulary(A.load_area_dim(t.areas()))
    words = t.files().select("folder", F.explode(D.name_words(F.col("name"))).alias("word"))
    return words.join(vocab, "word").groupBy("folder", "area").agg(F.count(F.lit(1)).alias("n"))


@query
def set_difference(t: Tables) -> DataFrame:
    """Names found in the notes that the graph does not hold yet."""
    return X.extract_entities(t.notes()).select("name").subtract(t.entities().select("name"))


@query
def group_documents(t: Tables) -> DataFrame:
    return D.group_documents(t.docs())


@query
def collection_heads(t: Tables) -> DataFrame:
    return D.collection_heads(D.group_documents(t.docs()))


@query
def replace_collections(t: Tables) -> DataFrame:
    path = run_dir(t.spark, "collections")
    D.replace_collections(D.group_documents(t.notes()), path)
    D.replace_collections(D.group_documents(t.docs()), path)
    return D.collection_heads(t.spark.read.parquet(path)).select("collection", "n_docs")


@query
def collection_members(t: Tables) -> DataFrame:
    members = D.group_documents(t.docs()).unionByName(D.group_documents(t.notes()))
    return D.collection_members(members, t.docs()).select("collection", "doc_id", "date", "path")


# -- snapshot ---------------------------------------------------------------------------------------


@query
def cited_documents(t: Tables) -> DataFrame:
    return SN.cited_documents(t.docs(), t.kos()).select("id", "path")


def _snapshot(t: Tables) -> dict[str, DataFrame]:
    path = run_dir(t.spark, "snapshot")
    SN.export_memory(t.docs(), t.kos(), t.entities(), t.edges(), path, include_bodies=False)
    return SN.read_snapshot(t.spark, path)


@query
def export_snapshot(t: Tables) -> DataFrame:
    s = _snapshot(t)
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in s.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def read_snapshot(t: Tables) -> DataFrame:
    s = _snapshot(t)
    return A.area_counts(s["documents"], s["kos"])
