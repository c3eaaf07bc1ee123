"""Calendar events, cloud files, mail messages and papers, from JSON rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed
from ..functions.text import empty_strings, natural_id, sender_name, strip

CALENDAR_EVENT = (
    "id string, status string, summary string, location string, description string, htmlLink string, "
    "start struct<date:string,dateTime:string>, organizer struct<displayName:string,email:string>, "
    "attendees array<struct<email:string,displayName:string,self:boolean,resource:boolean>>")
CLOUD_FILE = "id string, name string, mimeType string, modifiedTime string, createdTime string, webViewLink string"
MESSAGE = ("id string, snippet string, labelIds array<string>, "
           "payload struct<headers:array<struct<name:string,value:string>>>")
PAPER = ("id string, source string, pmid string, title string, authorString string, pubYear string, doi string, "
         "isOpenAccess string, journalTitle string, abstractText string, "
         "journalInfo struct<journal:struct<title:string>>")


def from_rows(rows: DataFrame, schema: str, column: str = "json") -> DataFrame:
    """JSON text column to columns."""
    return rows.withColumn("r", F.from_json(column, schema)).select(*[c for c in rows.columns if c != column], "r.*")


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def _document(df: DataFrame, path: Column, title: Column, doc_type: Column, date: Column, body: Column,
              people: Column, metadata: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(natural_id("doc", path).alias("id"), path.alias("path"), title.alias("title"),
                     doc_type.alias("doc_type"), date.alias("date"), body.alias("body"), people.alias("people"),
                     empty_strings().alias("organizations"), none.alias("project"), empty_strings().alias("tags"),
                     metadata.alias("metadata"), none.alias("area"))


def _labelled(label: str, c: Column) -> Column:
    return F.when(_filled(c).isNotNull(), F.concat(F.lit(label), c))


def normalise_calendar(events: DataFrame, account: str) -> DataFrame:
    """Events to documents: cancelled, untitled and undated ones are left out, and an event
    with guests is a meeting."""
    day = F.substring(F.coalesce(_filled(F.col("start.date")), F.col("start.dateTime"), F.lit("")), 1, 10)
    guests = F.filter(F.coalesce("attendees", F.array().cast(
        "array<struct<email:string,displayName:string,self:boolean,resource:boolean>>")),
        lambda a: ~F.coalesce(a["resource"], F.lit(False)) & ~F.coalesce(a["self"], F.lit(False)))
    names = F.transform(guests, lambda a: F.coalesce(
        _filled(a["displayName"]), F.substring_index(F.coalesce(a["email"], F.lit("")), "@", 1)))
    e = (events.withColumn("title", strip(F.coalesce("summary", F.lit("")))).withColumn("day", day)
         .withColumn("people", names)
         .where("coalesce(status, '') <> 'cancelled' and title <> '' and day <> ''"))
    organizer = F.coalesce(_filled(F.col("organizer.displayName")), F.col("organizer.email"))
    body = F.concat_ws(
        "\n", F.concat(F.lit("# "), "title"), F.lit(""), _labelled("Inicio: ", F.col("start.dateTime")),
        _labelled("Asistentes: ", F.array_join("people", ", ")), _labelled("Organiza: ", organizer),
        _labelled("Lugar: ", F.col("location")), _labelled("\n", F.col("description")))
    return _document(
        e, F.concat(F.lit(f"gcal://{account}/"), F.coalesce("id", F.lit(""))), F.col("title"),
        F.when(F.size("people") > 0, "meeting").otherwise("note"), F.try_to_date("day", "yyyy-MM-dd"), body,
        F.col("people"),
        F.create_map(F.lit("source"), F.lit("google-calendar"), F.lit("account"), F.lit(account),
                     F.lit("event_id"), F.col("id"), F.lit("html_link"), F.col("htmlLink")))


def calendar_window(docs: DataFrame, as_of: dt.date, back: int = 30, ahead: int = 30) -> DataFrame:
    return docs.where(F.col("date").between(F.date_sub(F.lit(as_of), back), F.date_add(F.lit(as_of), ahead)))


def normalise_drive_files(files: DataFrame, account: str, max_chars: int | None = None) -> DataFrame:
    """Files of the allowed types with content to documents."""
    ok = files.where(F.col("mimeType").isin(fixed.CLOUD_FILE_TYPES) & (strip(F.coalesce("content", F.lit(""))) != ""))
    body = F.col("content") if max_chars is None else F.substring("content", 1, max_chars)
    day = F.substring(F.coalesce(_filled(F.col("modifiedTime")), F.col("createdTime"), F.lit("")), 1, 10)
    return _document(
        ok, F.concat(F.lit(f"gdrive://{account}/"), "id"), F.coalesce("name", F.lit("(sin título)")), F.lit("note"),
        F.try_to_date(day, "yyyy-MM-dd"), body, empty_strings(),
        F.create_map(F.lit("source"), F.lit("google-drive"), F.lit("account"), F.lit(account), F.lit("file_id"),
                     F.col("id"), F.lit("mime_type"), F.col("mimeType"), F.lit("web_link"), F.col("webViewLink"),
                     F.lit("modified_time"), F.col("modifiedTime")))


def changed_since(files: DataFrame, cursors: DataFrame) -> DataFrame:
    """Files modified after their account's cursor; an account without a cursor is read whole."""
    return (files.join(cursors.select("account", "cursor"), "account", "left")
            .where("cursor is null or modifiedTime > cursor").drop("cursor"))


def next_cursors(files: DataFrame, cursors: DataFrame) -> DataFrame:
    seen = files.groupBy("account").agg(F.max("modifiedTime").alias("cursor"))
    return seen.unionByName(cursors.select("account", "cursor")).groupBy("account").agg(F.max("cursor").alias("cursor"))


def read_changed(files: DataFrame, table: str, cursors: str) -> int:
    """One run over the files of all accounts: rows that changed since the last run go to a folder of their
    own below ``table``, then the cursors, one row per account, to one below ``cursors``; the run's number.

    The cursors move only after the rows are written. A run that ended in between writes both folders again.
    """
    spark = files.sparkSession
    run, known = last_cursors(spark, cursors)
    fresh, path = changed_since(files, known), f"{table}/run={run + 1}"
    fresh.write.mode("overwrite").parquet(path)
    next_cursors(spark.read.schema(fresh.schema).parquet(path), known).write.mode("overwrite").parquet(f"{cursors}/run={run + 1}")
    return run + 1


def last_cursors(spark: SparkSession, cursors: str) -> tuple[int, DataFrame]:
    """The last run and its cursors; 0 and no rows before the first."""
    kind = "account string, cursor string, run int"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cursors)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return 0, spark.createDataFrame([], kind)
    every = spark.read.schema(kind).parquet(cursors)
    run = every.agg(F.max("run")).first()[0] or 0
    return run, every.where(F.col("run") == run)


def mail_time(c: Column) -> Column:
    """Mail header date to a timestamp: day name and comments dropped, zone names to offsets."""
    t = F.regexp_replace(strip(c), r"^[A-Za-z]{3},?\s+", "")
    t = F.regexp_replace(t, r"\s*\([^)]*\)\s*$", "")
    t = F.regexp_replace(t, r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    t = F.regexp_replace(t, r"\s+", " ")
    return F.coalesce(F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss Z")),
                      F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm Z")))


def normalise_email(messages: DataFrame, account: str) -> DataFrame:
    """Message rows to flat mail; header names are case-insensitive and the last one counts."""
    headers = F.coalesce("payload.headers", F.array().cast("array<struct<name:string,value:string>>"))

    def header(name: str) -> Column:
        found = F.filter(headers, lambda h: F.lower(h["name"]) == name)
        return F.when(F.size(found) > 0, F.element_at(found, -1)["value"])

    blank = F.lit("")
    return messages.select(
        F.coalesce("id", blank).alias("id"), F.lit(account).alias("account"),
        F.coalesce(header("from"), blank).alias("from"), F.coalesce(header("to"), blank).alias("to"),
        F.coalesce(header("subject"), F.lit("(sin asunto)")).alias("subject"), mail_time(header("date")).alias("date"),
        F.coalesce("snippet", blank).alias("snippet"), F.coalesce("labelIds", empty_strings()).alias("labels"))


def email_to_doc(mail: DataFrame, captured: DataFrame) -> DataFrame:
    """Mails chosen for capture to documents."""
    m = mail.join(captured.select("id"), "id", "left_semi")
    text = strip(F.coalesce(_filled(F.col("body")), F.col("snippet"), F.lit("")))
    sender = sender_name(F.col("from"))
    return _document(
        m, F.concat(F.lit("mail://"), "account", F.lit("/"), "id"),
        F.coalesce(_filled(F.col("subject")), F.lit("(sin asunto)")), F.lit("email"),
        F.coalesce(F.to_date("date"), F.lit(dt.date(1970, 1, 1))), F.concat(F.lit("De: "), "from", F.lit("\n\n"), text),
        F.array(sender),
        F.create_map(F.lit("source"), F.lit("gmail-capture"), F.lit("account"), F.col("account"), F.lit("from"),
                     F.col("from"), F.lit("message_id"), F.col("id")))


def paper_body(title: Column, authors: Column, journal: Column, year: Column, doi: Column, abstract: Column) -> Column:
    return F.concat_ws(
        "\n", F.concat(F.lit("# "), title), F.lit(""), _labelled("Autores: ", authors),
        F.when(_filled(journal).isNotNull(), F.concat(F.lit("Revista: "), journal, F.lit(" ("), year, F.lit(")"))),
        _labelled("DOI: https://doi.org/", doi), _labelled("\n## Abstract\n", abstract))


def normalise_papers(papers: DataFrame) -> DataFrame:
    """Search results to paper documents; untitled ones are left out."""
    journal = F.coalesce(_filled(F.col("journalInfo.journal.title")), _filled(F.col("journalTitle")), F.lit(""))
    p = (papers.withColumn("t", F.regexp_replace(strip(F.coalesce("title", F.lit(""))), r"\.+$", ""))
         .withColumn("y", F.coalesce("pubYear", F.lit(""))).withColumn("j", journal).where("t <> ''"))
    date = F.coalesce(F.when(F.col("y").rlike(r"^\d+$"), F.try_to_date(F.concat("y", F.lit("-01-01")), "yyyy-MM-dd")),
                      F.lit(dt.date(1900, 1, 1)))
    return _document(
        p, F.concat(F.lit("europepmc://"), F.coalesce("source", F.lit("MED")), F.lit("/"), F.coalesce("id", F.lit(""))),
        F.substring("t", 1, 200), F.lit("paper"), date,
        paper_body(F.col("t"), F.col("authorString"), F.col("j"), F.col("y"), F.col("doi"), F.col("abstractText")),
        empty_strings(),
        F.create_map(F.lit("source"), F.lit("europepmc"), F.lit("doi"), F.col("doi"), F.lit("year"), F.col("y"),
                     F.lit("journal"), F.col("j"), F.lit("open_access"),
                     (F.coalesce("isOpenAccess", F.lit("")) == "Y").cast("string"), F.lit("pmid"), F.col("pmid")))
