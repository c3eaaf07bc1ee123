"""Reference libraries: BibTeX and CSL-JSON exports to paper documents."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import empty_strings, last_value, strip
from .accounts import _document, paper_body
from .lines import records

ENTRY_START = r"@\w+\s*\{\s*[^,]+,"
FIELD = r"(\w+)\s*=\s*(?:\{((?:[^{}]++|\{[^{}]*+\})*+)\}|\"([^\"]*)\")"
CSL = ("array<struct<type:string,id:string,title:string,`container-title`:string,DOI:string,"
       "author:array<struct<given:string,family:string>>,issued:struct<`date-parts`:array<array<string>>>>>")
ENTRY_COLUMNS = ["source_id", "type", "key", "title", "author", "year", "journal", "doi", "abstract"]


def scan_bibtex(texts: DataFrame) -> DataFrame:
    """(id, text) to one row per entry; an entry ends where the next one starts."""
    cut = F.split("text", rf"(?={ENTRY_START})")
    e = (texts.select(F.col("id").alias("source_id"), F.explode(cut).alias("block"))
         .where(F.col("block").rlike(rf"\A{ENTRY_START}")))
    rest = F.regexp_replace("block", rf"\A{ENTRY_START}", "")
    e = (e.withColumn("type", F.lower(F.regexp_extract("block", r"\A@(\w+)", 1)))
         .withColumn("key", strip(F.regexp_extract("block", r"\A@\w+\s*\{\s*([^,]+),", 1)))
         .withColumn("names", F.transform(F.regexp_extract_all(rest, F.lit(FIELD), F.lit(1)), F.lower))
         .withColumn("braced", F.regexp_extract_all(rest, F.lit(FIELD), F.lit(2)))
         .withColumn("quoted", F.regexp_extract_all(rest, F.lit(FIELD), F.lit(3)))
         .withColumn("values", F.zip_with("braced", "quoted", lambda a, b: F.regexp_replace(
             strip(F.when(a != "", a).otherwise(b)), r"\s+", " "))))
    get = lambda k: last_value(F.col("names"), F.col("values"), k)
    full = lambda k: F.when(get(k) != "", get(k))
    return e.select("source_id", "type", "key", get("title").alias("title"), get("author").alias("author"),
                    get("year").alias("year"),
                    F.coalesce(full("journal"), full("journaltitle"), full("booktitle")).alias("journal"),
                    get("doi").alias("doi"), get("abstract").alias("abstract"))


def scan_csl_json(texts: DataFrame) -> DataFrame:
    """(id, text) with a JSON list of references to one row per reference."""
    r = (texts.select(F.col("id").alias("source_id"), F.explode(F.from_json("text", CSL)).alias("r")))
    names = F.transform(F.coalesce("r.author", F.array().cast("array<struct<given:string,family:string>>")),
                        lambda a: F.concat_ws(" ", F.when(a["given"] != "", a["given"]), F.when(a["family"] != "", a["family"])))
    parts = F.get(F.get(F.col("r.issued.date-parts"), F.lit(0)), F.lit(0))
    blank = F.lit("")
    return r.select("source_id", F.coalesce("r.type", F.lit("article")).alias("type"), F.coalesce("r.id", blank).alias("key"),
                    F.coalesce("r.title", blank).alias("title"), F.array_join(names, ", ").alias("author"),
                    F.coalesce(parts, blank).alias("year"), F.coalesce(F.col("r.container-title"), blank).alias("journal"),
                    F.coalesce("r.DOI", blank).alias("doi"), F.lit(None).cast("string").alias("abstract"))


def scan_library(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Reference files of one kind, ``bib`` or ``json``. A BibTeX file is read by several tasks: it is cut at
    lines that start an entry, and what starts inside a line is cut with its record. A JSON list is one row."""
    if kind == "bib":
        parts = records(spark, path, rf"^{ENTRY_START}").select(F.col("path").alias("id"), "text")
        return scan_bibtex(parts)
    return scan_csl_json(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("id"), F.col("value").alias("text")))


def normalise_reference(entries: DataFrame) -> DataFrame:
    """Entries to paper documents; untitled ones are left out."""
    blank = F.lit("")
    title = F.regexp_replace(strip(F.regexp_replace(F.coalesce("title", blank), r"[{}]", "")), r"\.+$", "")
    e = (entries.withColumn("t", title).where("t <> ''")
         .withColumn("y", F.regexp_extract(F.coalesce("year", blank), r"(\d{4})", 1))
         .withColumn("j", F.coalesce("journal", blank))
         .withColumn("d", F.replace(F.coalesce("doi", blank), F.lit("https://doi.org/"), F.lit(""))))
    date = F.coalesce(F.when(F.col("y") != "", F.try_to_date(F.concat("y", F.lit("-01-01")), "yyyy-MM-dd")),
                      F.lit(dt.date(1900, 1, 1)))
    return _document(
        e, F.concat(F.lit("zotero://"), "key"), F.substring("t", 1, 200), F.lit("paper"), date,
        paper_body(F.col("t"), F.col("author"), F.col("j"), F.col("y"), F.col("d"), F.col("abstract")), empty_strings(),
        F.create_map(F.lit("source"), F.lit("zotero"), F.lit("doi"), F.when(F.col("d") != "", F.col("d")), F.lit("year"),
                     F.col("y"), F.lit("journal"), F.col("j"), F.lit("entry_type"), F.col("type")))
