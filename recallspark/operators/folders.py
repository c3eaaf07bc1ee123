"""Folder advice and document collections."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.text import empty_strings
from .scale import first_per_key, with_position

TOKEN = r"([\p{L}\p{N}]+)"
SUPPORTED = fixed.TEXT_EXTENSIONS + fixed.OFFICE_EXTENSIONS


def name_words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(1)), lambda w: F.length(w) > 2))


def area_vocabulary(dim: DataFrame) -> DataFrame:
    """(map_order, area, word) from the keywords, projects, people and name of each area."""
    labels = F.concat("keywords", "projects", F.coalesce("people", empty_strings()), F.array("name"))
    return (dim.select("map_order", F.col("id").alias("area"), F.explode(labels).alias("label"))
            .select("map_order", "area", F.explode(name_words(F.col("label"))).alias("word")).distinct())


def visible_files(files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Listing without hidden, temporary and noisy entries, and without those below ``max_depth``
    folders where a depth is asked for."""
    dirs = F.filter(F.split("subpath", "/"), lambda d: d != "")
    shallow = F.lit(True) if max_depth is None else F.size(dirs) <= max_depth
    noise = F.array(*[F.lit(d) for d in fixed.NOISE_DIRS])
    hidden = F.exists(dirs, lambda d: d.startswith(".") | d.startswith("~$"))
    return files.where(~F.col("name").startswith(".") & ~F.col("name").startswith("~$") & ~hidden
                       & ~F.arrays_overlap(dirs, noise) & shallow
                       & ~F.col("folder").startswith(".") & ~F.col("folder").isin(fixed.NOISE_DIRS))


def folder_stats(files: DataFrame, dim: DataFrame, as_of: dt.date, recent_days: int = 90) -> DataFrame:
    """Per folder: files, supported, recent, bytes, types, and the area its names point at.

    A supported file counts one for each area that shares a word with its name, and the
    folder's own name counts five.
    """
    key = ["root", "folder"]
    f = visible_files(files).withColumn("ext", F.lower(F.regexp_extract("name", r".(\.[^.]*)$", 1)))
    ok = F.col("ext").isin(SUPPORTED)
    fresh = ok & (F.to_date("mtime") >= F.date_sub(F.lit(as_of), recent_days))
    base = f.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("supported"), F.count_if(fresh).alias("recent"),
        F.coalesce(F.sum(F.when(ok, F.col("size"))), F.lit(0)).alias("bytes"))
    per_ext = f.where(ok).groupBy(*key, "ext").agg(F.count(F.lit(1)).alias("n"))
    types = per_ext.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ext", "n"))),
                                      lambda e: F.concat(e["ext"], F.lit("="), e["n"].cast("string"))), ",").alias("types"))
    vocab = area_vocabulary(dim)
    stem = F.regexp_replace("name", r"(?<=.)\.[^.]*$", "")
    shape = f.where(ok).groupBy(*key, F.array_sort(name_words(stem)).alias("words")).agg(F.count(F.lit(1)).alias("n"))
    file_hits = (shape.select(*key, "words", "n", F.explode("words").alias("word")).join(vocab, "word")
                 .select(*key, "words", "n", "area", "map_order").distinct()
                 .groupBy(*key, "area", "map_order").agg(F.sum("n").alias("hits")))
    own = (base.select(*key, F.explode(name_words(F.col("folder"))).alias("word")).join(vocab, "word")
           .select(*key, "area", "map_order").distinct().withColumn("hits", F.lit(5).cast("bigint")))
    hits = file_hits.unionByName(own).groupBy(*key, "area", "map_order").agg(F.sum("hits").alias("hits"))
    best = hits.groupBy(*key).agg(F.max_by(F.struct("area", "hits"), F.struct("hits", -F.col("map_order"))).alias("b")).select(
        *key, F.col("b.area").alias("area_guess"), F.col("b.hits").alias("area_hits"))
    return (base.join(types, key, "left").join(best, key, "left")
            .withColumn("types", F.coalesce("types", F.lit(""))))


def score_folders(stats: DataFrame) -> DataFrame:
    """Score, verdict and reasons of each folder."""
    s, r, guess = F.col("supported"), F.col("recent"), F.col("area_guess").isNotNull()
    score = F.least(F.lit(40), s) + F.least(F.lit(30), r * 3) + F.when(guess, F.least(F.lit(30), F.col("area_hits") * 5)).otherwise(0)
    thin = (s / F.col("total") < 0.05) & (s < 5)
    verdict = (F.when(s == 0, "ignorar").when(thin, "ignorar").when((s >= 5) & ((r > 0) | guess), "conectar").otherwise("revisar"))
    note = (F.when(s == 0, "sin archivos de texto/oficina soportados").when(thin, "casi todo son binarios/fotos/instaladores")
            .when(verdict == "revisar", "pocas señales; decide tú"))
    found = F.array(F.when(s > 0, F.concat(s.cast("string"), F.lit(" archivos soportados"))),
                    F.when(r > 0, F.concat(r.cast("string"), F.lit(" modificados en los últimos 90 días"))),
                    F.when((s > 0) & guess, F.concat(F.lit("calza con el área «"), "area_guess", F.lit("»"))), note)
    return (stats.withColumn("score", F.when(s == 0, F.lit(0)).otherwise(score).cast("bigint")).withColumn("verdict", verdict)
            .withColumn("reasons", F.filter(found, lambda x: x.isNotNull())))


def rank_folders(scored: DataFrame) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(v) for v in fixed.FOLDER_VERDICTS]), F.col("verdict"))
    return with_position(scored, [place, F.desc("score"), F.lower("folder"), F.asc("root")], "rank")


def sources_not_registered(folders: DataFrame, registered: DataFrame, ignored: DataFrame) -> DataFrame:
    """Candidate folders that are neither connected nor ignored."""
    known = registered.select("path").unionByName(ignored.select("path")).distinct()
    return folders.join(known, "path", "left_anti")


# -- collections ------------------------------------------------------------------


def collection_name(docs: DataFrame) -> Column:
    """Where a document comes from: source alias, account, vault, parent folder."""
    meta = lambda k: F.element_at("metadata", F.lit(k))
    parent = F.element_at(F.concat(F.array(F.lit("")), F.split(F.regexp_replace("path", r"/?[^/]*$", ""), "/")), -1)
    account = F.coalesce(meta("account"), F.lit("?"))
    return (F.when(F.coalesce(meta("source_alias"), F.lit("")) != "", meta("source_alias"))
            .when(meta("source") == "google-calendar", F.concat(F.lit("Calendario ("), account, F.lit(")")))
            .when(meta("source") == "google-drive", F.concat(F.lit("Drive ("), account, F.lit(")")))
            .when(F.col("path").startswith("brain"), "Vault")
            .when(parent != "", parent).otherwise("Sin clasificar"))


def group_documents(docs: DataFrame) -> DataFrame:
    """(collection, doc_id) membership rows; a collection of any size stays distributed."""
    return docs.select(collection_name(docs).alias("collection"), F.col("id").alias("doc_id"))


def collection_heads(members: DataFrame) -> DataFrame:
    return (members.groupBy("collection").agg(F.count(F.lit(1)).alias("n_docs"))
            .withColumn("rationale", F.lit("agrupado por carpeta/fuente de origen")))


def replace_collections(members: DataFrame, path: str) -> None:
    """Overwrites the stored grouping."""
    members.write.mode("overwrite").parquet(path)


def collection_members(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Members with their document; ids that do not exist are dropped."""
    d = docs.select(F.col("id").alias("doc_id"), "date", "title", "path")
    return members.join(d, "doc_id").select("collection", "doc_id", "date", "title", "path")


def distinct_rules(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key, case-insensitive on text keys."""
    low = {k: F.lower(F.col(k)) for k in keys}
    marked = df.select("*", *[c.alias(f"__{k}") for k, c in low.items()])
    return first_per_key(marked, [f"__{k}" for k in keys], order).select(*df.columns)
