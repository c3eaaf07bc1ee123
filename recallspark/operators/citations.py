"""Citations in texts and their check against a table of registered works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.text import is_title_case, plain_ascii, strip
from ..session import written
from .scale import dealt, first_per_key

UNFOUND, OK, DIFFERS = "no_encontrado", "verificado", "discrepancia"


def _trim_doi(c: Column) -> Column:
    return F.regexp_replace(c, r"\.+$", "")


def extract_references(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, raw, doi, year, author): numbered entries, then loose DOIs not yet seen."""
    whole = docs.select(F.col("id").alias("doc_id"), "body")
    entries = (whole.select("doc_id", F.posexplode(F.regexp_extract_all(
        "body", F.lit(fixed.NUMBERED_ENTRY_PATTERN), F.lit(2))).alias("pos", "entry"))
        .withColumn("entry", strip(F.col("entry"))))
    first = strip(F.substring_index(F.substring_index("entry", ",", 1), " ", 1))
    doi = _trim_doi(F.regexp_extract("entry", fixed.DOI_PATTERN, 0))
    year = F.regexp_extract("entry", fixed.YEAR_PATTERN, 1)
    numbered = entries.select(
        "doc_id", "pos", F.col("entry").alias("raw"), F.when(doi != "", doi).alias("doi"),
        F.when(year != "", year).alias("year"), F.when(is_title_case(first), first).alias("author"))
    none = F.lit(None).cast("string")
    found = (whole.select("doc_id", F.posexplode(F.regexp_extract_all("body", F.lit(f"({fixed.DOI_PATTERN})"), F.lit(1)))
                          .alias("pos", "doi"))
             .withColumn("doi", _trim_doi(F.col("doi"))).withColumn("low", F.lower("doi")))
    first_seen = found.groupBy("doc_id", "low").agg(F.min(F.struct("pos", "doi")).alias("f"))
    used = numbered.where("doi is not null").select("doc_id", F.lower("doi").alias("low")).distinct()
    loose = first_seen.join(dealt(used), ["doc_id", "low"], "left_anti").select(
        "doc_id", (F.col("f.pos") + 1_000_000).alias("pos"), F.col("f.doi").alias("raw"), F.col("f.doi").alias("doi"),
        none.alias("year"), none.alias("author"))
    return numbered.unionByName(loose)


def title_share(title: Column, raw: Column) -> Column:
    """Share of the distinct words of a title that the citation holds, wherever they stand."""
    own = F.array_distinct(F.split(_words(title), " "))
    return F.size(F.array_intersect(own, F.split(_words(raw), " "))) / F.size(own)


def similar_titles(refs: DataFrame, titles: DataFrame, percent: int = round(100 * fixed.TITLE_RATIO_MIN),
                   size: Column | None = None) -> DataFrame:
    """Every pair of a citation (columns and ``words``) and a title (columns and ``title_words``) whose words
    stand in the citation to ``percent`` in a hundred, with ``shared``; a pair may come more than once.
    ``size`` counts the words of a title, if ``title_words`` has not all of them.

    A title that needs m of its n words must share one of its n - m + 1 rarest, so titles are found by
    those alone, and only by citations with as many words as the title needs. Work follows the titles that
    share a rare word, not all of them.
    """
    need = _needed(F.size("title_words") if size is None else size, percent)
    titles = titles.withColumn("need", need).where((F.size("title_words") > 0) & (F.size("title_words") >= F.col("need")))
    often = titles.select(F.explode("title_words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    rows = titles.withColumn("word", F.explode("title_words")).join(dealt(written(often, "title-words")), "word")
    keep = [c for c in titles.columns if c != "title_words"]
    rows = rows.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("often", "word"))).alias("w"))
    rows = written(rows.withColumn("title_words", F.transform("w", lambda x: x["word"])).drop("w"), "titles")
    by_word = rows.withColumn("word", F.explode(F.slice("title_words", 1, F.size("title_words") - F.col("need") + 1)))
    asked = refs.withColumn("word", F.explode("words"))
    shared = F.size(F.array_intersect("title_words", "words"))
    pairs = asked.join(dealt(by_word), (asked["word"] == by_word["word"]) & (F.size(asked["words"]) >= by_word["need"]))
    return pairs.withColumn("shared", shared).where(F.col("shared") >= F.col("need")).drop("word", "need")


def _needed(size: Column, percent: int) -> Column:
    return F.floor((size * percent + 99) / 100).cast("int")


RARE = 20  # a word of so many titles at most is looked up title by title


def most_similar_title(refs: DataFrame, titles: DataFrame, key: list[str], percent: int = round(100 * fixed.TITLE_RATIO_MIN)) -> DataFrame:
    """(*key, ntitle): the title with the greatest share of its words in the citation (*key, words), at least
    ``percent`` in a hundred; then the longest, then the last one. ``titles`` has one row per ``ntitle``, and
    ``title_words``.

    Titles that share a rare word with the citation are few and each is looked at. The share of any other
    follows from its frequent words and its number of words, so of titles alike in both only the best one is
    kept. It meets the distinct sets of frequent words of the citations, not each citation: titles that differ
    in a number alone make no pair of their own.
    """
    titles = titles.select("ntitle", "title_words", F.size("title_words").alias("n")).where("n > 0")
    word = F.explode("title_words").alias("word")
    often = written(titles.select(word).groupBy("word").agg(F.count(F.lit(1)).alias("often")), "title-words")
    own = titles.select("ntitle", "n", word).join(dealt(often), "word")
    own = own.groupBy("ntitle", "n").agg(
        F.collect_list(F.when(F.col("often") <= RARE, F.col("word"))).alias("rare"),
        F.sort_array(F.collect_list(F.when(F.col("often") > RARE, F.col("word")))).alias("title_words"))
    own = written(own.withColumn("need", _needed(F.col("n"), percent)), "titles")
    asked = refs.select(*key, "words")
    best = F.struct("share", F.length("ntitle"), "ntitle")

    by_word = own.select("ntitle", "n", "need", F.concat("rare", "title_words").alias("all"), F.explode("rare").alias("word"))
    near = asked.withColumn("word", F.explode("words")).join(dealt(by_word), "word")
    near = near.withColumn("shared", F.size(F.array_intersect("all", "words"))).where("shared >= need")
    near = near.select(*key, "ntitle", (F.col("shared") / F.col("n")).alias("share"))

    alike = own.where(F.size("title_words") >= F.col("need")).groupBy("title_words", "n").agg(
        F.max_by("ntitle", F.struct(F.length("ntitle"), "ntitle")).alias("ntitle"))
    frequent = (asked.select(*key, F.explode("words").alias("word")).join(dealt(often.where(F.col("often") > RARE).select("word")), "word")
                .groupBy(*key).agg(F.sort_array(F.collect_list("word")).alias("words")))
    frequent = written(frequent, "frequent")
    pairs = similar_titles(frequent.select("words").distinct(), alike, percent, F.col("n"))
    pairs = pairs.withColumn("share", F.col("shared") / F.col("n")).groupBy("words").agg(F.max(best).alias("best"))
    common = frequent.join(dealt(pairs), "words").select(*key, "best.ntitle", "best.share")
    return near.unionByName(common).groupBy(*key).agg(F.max_by("ntitle", best).alias("ntitle"))


def verbatim_titles(refs: DataFrame, titles: DataFrame, key: list[str]) -> DataFrame:
    """(*key, ntitle) where the words of a title stand in ``nraw`` in a row. Both hold words with one space
    between; runs of as many words as some title has are matched by equality."""
    count = F.size(F.split("ntitle", " "))
    titles = titles.select("ntitle").where("ntitle <> ''")
    lengths = titles.agg(F.collect_set(count)).first()[0]
    sizes = F.array(*(F.lit(n) for n in sorted(lengths))).cast("array<int>")
    rows = refs.select(*key, F.split("nraw", " ").alias("w")).select(*key, "w", F.explode(sizes).alias("n")).where(F.col("n") <= F.size("w"))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))
    return rows.select(*key, F.explode(F.array_distinct(runs)).alias("ntitle")).join(dealt(titles), "ntitle").select(*key, "ntitle")


def doi_join(refs: DataFrame, works: DataFrame) -> DataFrame:
    """Adds the registered work of every citation: (work_doi, work_title, work_family, work_year).

    A citation with a DOI means that work. One without takes, in this order, the work whose
    title its words contain with the same author and year, any work whose title they contain
    (the longest), the work of the most similar title (at least ``TITLE_RATIO_MIN`` of its words),
    or a work of the same author and year. Works are reduced to one row per key before each join.
    """
    work = F.struct(F.col("doi").alias("work_doi"), F.col("title").alias("work_title"),
                    F.col("family").alias("work_family"), F.col("year").alias("work_year"))
    w = (works.withColumn("work", work).withColumn("low", F.lower("doi"))
         .withColumn("ntitle", _words(F.col("title"))).withColumn("nfamily", plain_ascii(F.col("family"))))
    by_doi = first_per_key(w.select("low", "work"), ["low"], [F.col("work.work_doi")])
    direct = (refs.where("doi is not null").withColumn("low", F.lower("doi"))
              .join(dealt(by_doi), "low", "left").drop("low"))

    rest = written(refs.where("doi is null").withColumn("nraw", _words(F.col("raw")))
                   .withColumn("nfamily", plain_ascii(F.coalesce("author", F.lit("")))), "without-doi")
    per_title = written(first_per_key(w.select("ntitle", "work"), ["ntitle"], [F.col("work.work_doi")]), "per-title")
    per_all = first_per_key(w.select("ntitle", "nfamily", "year", "work"), ["ntitle", "nfamily", "year"], [F.col("work.work_doi")])
    per_author = first_per_key(w.select("nfamily", "year", "work"), ["nfamily", "year"], [F.col("work.work_doi")])
    distinct_words = lambda c: F.array_remove(F.array_distinct(F.split(c, " ")), "")
    key = ["doc_id", "pos"]
    similar = most_similar_title(rest.select(*key, distinct_words("nraw").alias("words")),
                                 per_title.select("ntitle", distinct_words("ntitle").alias("title_words")), key)
    similar = similar.join(dealt(per_title), "ntitle").select(*key, F.col("work").alias("similar"))
    long_title = F.struct(F.length("ntitle"), "ntitle")
    mine = written(verbatim_titles(rest, per_title, key).join(dealt(per_title), "ntitle"), "verbatim")
    titled = mine.groupBy(*key).agg(F.max_by("work", long_title).alias("titled"))
    exact = (mine.drop("work").join(dealt(rest.select(*key, "nfamily", "year")), key).join(dealt(per_all), ["ntitle", "nfamily", "year"])
             .groupBy(*key).agg(F.max_by("work", long_title).alias("exact")))
    found = (rest.join(dealt(exact), key, "left").join(dealt(titled), key, "left").join(dealt(similar), key, "left")
             .join(dealt(per_author.withColumnRenamed("work", "by_author")), ["nfamily", "year"], "left"))
    found = found.withColumn("work", F.coalesce("exact", "titled", "similar", "by_author"))
    return direct.unionByName(found.select(*direct.columns)).select(*refs.columns, "work.*")


def _words(c: Column) -> Column:
    return F.trim(F.regexp_replace(plain_ascii(c), " +", " "))


def verify_references(refs: DataFrame, works: DataFrame) -> DataFrame:
    """Adds verdict and detail: title (only without a DOI), year and author are compared."""
    j = doi_join(refs, works)
    have = F.col("work_doi").isNotNull()
    nt, nr = plain_ascii(F.col("work_title")), plain_ascii(F.col("raw"))
    asks = have & F.col("doi").isNull() & (F.coalesce("work_title", F.lit("")) != "") & ~F.contains(nr, nt)
    na, nf = plain_ascii(F.col("author")), plain_ascii(F.col("work_family"))
    bad_title = F.when(asks & (title_share(F.col("work_title"), F.col("raw")) < fixed.TITLE_RATIO_MIN),
                       F.concat(F.lit("título distinto ("), F.substring("work_title", 1, 70), F.lit("…)")))
    bad_year = F.when((F.col("work_year") != "") & (F.col("year") != F.col("work_year")),
                      F.concat(F.lit("año: cita "), "year", F.lit(" vs fuente "), "work_year"))
    bad_author = F.when((F.col("work_family") != "") & ~F.contains(nf, na) & ~F.contains(na, nf),
                        F.concat(F.lit("autor: cita "), "author", F.lit(" vs fuente "), "work_family"))
    issues = F.concat_ws("; ", bad_title, bad_year, bad_author)
    return (j.withColumn("detail", F.when(have, issues).otherwise("sin resultados"))
            .withColumn("verdict", F.when(~have, UNFOUND).when(issues == "", OK).otherwise(DIFFERS)))


def reference_summary(verified: DataFrame) -> DataFrame:
    """Verified and total citations per document."""
    return verified.groupBy("doc_id").agg(F.count_if(F.col("verdict") == OK).alias("ok"), F.count(F.lit(1)).alias("total"))
