"""Area dictionary, classification, per-area signals and ranking."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.text import empty_strings, reason_label
from ..session import materialize

NO_AREA = "_sin_area"
MAX_TERMS = 20_000


@dataclass(frozen=True)
class Area:
    id: str
    name: str
    keywords: tuple[str, ...] = ()
    people: tuple[str, ...] = ()
    projects: tuple[str, ...] = field(default=())


def load_area_dim(raw: DataFrame) -> DataFrame:
    """Area rows with an id and a name, keywords lower-cased; ``map_order`` settles ties."""
    lists = {c: F.coalesce(c, empty_strings()).alias(c) for c in ("people", "projects")}
    keywords = F.transform(F.coalesce("keywords", empty_strings()), F.lower).alias("keywords")
    ok = raw.where("coalesce(id,'') <> '' and coalesce(name,'') <> ''")
    return ok.select("map_order", "id", "name", keywords, lists["people"], lists["projects"])


def area_terms(dim: DataFrame) -> DataFrame:
    """The dictionary as rows: (map_order, area, kind, term, points), lower-cased terms."""
    def kind(name: str, col: str) -> Column:
        return F.transform(col, lambda t: F.struct(F.lit(name).alias("kind"), F.lower(t).alias("term"),
                                                   F.lit(fixed.AREA_POINTS[name]).alias("points")))
    every = F.concat(kind("keyword", "keywords"), kind("person", "people"), kind("project", "projects"))
    return (dim.select("map_order", F.col("id").alias("area"), F.explode(every).alias("t"))
            .select("map_order", "area", "t.*").where("term <> ''"))


def classify_area(docs: DataFrame, dim: DataFrame, text: Column, people: Column | str = "people",
                  project: Column | str = "project") -> DataFrame:
    """Adds ``area``: keyword in text +2, person +3, project +4 per term; the best area wins.

    A score below 2 gives NULL and equal scores go to the first area of the map. The dictionary is the
    hand-written area map; it rides along as a constant, so the text is scanned once and never shuffled.
    A map of more than ``MAX_TERMS`` terms is refused.
    """
    terms = area_terms(dim).limit(MAX_TERMS + 1).collect()
    if len(terms) > MAX_TERMS:
        raise ValueError(f"an area map has at most {MAX_TERMS} terms")
    people = F.col(people) if isinstance(people, str) else people
    project = F.col(project) if isinstance(project, str) else project
    prepared = (docs.withColumn("__text", F.lower(text))
                .withColumn("__people", F.filter(F.transform(F.coalesce(people, empty_strings()), F.lower),
                                                 lambda p: p != ""))
                .withColumn("__project", F.lower(F.coalesce(project, F.lit("")))))
    best = prepared.withColumn("__best", _best_area(terms))
    label = F.when(F.col("__best.score") >= fixed.AREA_MIN_SCORE, F.col("__best.area"))
    return best.withColumn("area", label).drop("__text", "__people", "__project", "__best")


def _best_area(rows) -> Column:
    """Score of every area, then the best by (score, map order).

    The dictionary is one constant array walked by higher-order functions: the generated
    code stays small however many terms the map has.
    """
    by_area: dict[tuple, list] = {}
    for r in rows:
        by_area.setdefault((r["map_order"], r["area"]), []).append(r)
    if not by_area:
        return F.struct(F.lit(0).alias("score"), F.lit(0).alias("o"), F.lit(None).cast("string").alias("area"))
    packed = F.array(*[
        F.struct(F.lit(-order).alias("o"), F.lit(area).alias("area"), *[
            _constant([t["term"] for t in terms if t["kind"] == kind]).alias(kind) for kind in fixed.AREA_POINTS])
        for (order, area), terms in sorted(by_area.items(), key=lambda kv: kv[0][0])])
    text, project = F.col("__text"), F.col("__project")

    def named(term: Column) -> Column:
        return F.contains(text, term) | F.exists("__people", lambda p: F.contains(p, term) | F.contains(term, p))

    tests = {"keyword": lambda t: F.contains(text, t), "person": named,
             "project": lambda t: F.contains(text, t) | F.contains(project, t)}

    def score(area: Column) -> Column:
        return sum((F.size(F.filter(area[kind], test)) * fixed.AREA_POINTS[kind] for kind, test in tests.items()), F.lit(0))

    return F.array_max(F.transform(packed, lambda a: F.struct(
        score(a).alias("score"), a["o"].alias("o"), a["area"].alias("area"))))


def _constant(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def document_text(body_chars: int | None = None) -> Column:
    """Text a document is classified on: title, path and body (whole unless cut)."""
    body = F.col("body") if body_chars is None else F.substring("body", 1, body_chars)
    return F.concat_ws("\n", "title", "path", body)


def classify_documents(docs: DataFrame, dim: DataFrame, body_chars: int | None = None) -> DataFrame:
    return classify_area(docs, dim, document_text(body_chars))


def ko_inherit_area(kos: DataFrame, docs: DataFrame, dim: DataFrame) -> DataFrame:
    """Area of the source document, else the object's own classification."""
    own = classify_area(kos, dim, F.concat_ws("\n", "title", "statement")).withColumnRenamed("area", "own_area")
    of_doc = docs.select(F.col("id").alias("source_doc"), F.col("area").alias("doc_area"))
    return (own.join(of_doc, "source_doc", "left")
            .withColumn("area", F.coalesce("doc_area", "own_area")).select(*kos.columns))


def area_counts(docs: DataFrame, kos: DataFrame) -> DataFrame:
    """Documents, objects, open tasks and decisions per area."""
    area = F.coalesce("area", F.lit(NO_AREA)).alias("area")
    one = (docs.select(area, F.lit(1).alias("d"), F.lit(0).alias("k"), F.lit(0).alias("t"), F.lit(0).alias("c"))
           .unionByName(kos.select(
               area, F.lit(0).alias("d"), F.lit(1).alias("k"),
               F.when((F.col("ko_type") == "task") & (F.col("status") == "active"), 1).otherwise(0).alias("t"),
               F.when(F.col("ko_type") == "decision", 1).otherwise(0).alias("c"))))
    return one.groupBy("area").agg(F.sum("d").alias("documents"), F.sum("k").alias("kos"),
                                   F.sum("t").alias("tasks_open"), F.sum("c").alias("decisions"))


def mail_hits_by_area(triaged: DataFrame, dim: DataFrame) -> DataFrame:
    """P1-P2 mail per area, classified on subject and sender."""
    urgent = triaged.where("priority <= 2")
    labelled = classify_area(urgent, dim, F.concat_ws(" ", "subject", "from"), empty_strings(), F.lit(""))
    counted = labelled.groupBy("area").agg(F.count(F.lit(1)).alias("mail"))
    return materialize(counted).where("area is not null")


def area_signals(kos: DataFrame, dim: DataFrame, mail_hits: DataFrame, as_of: dt.date) -> DataFrame:
    """One conditional pass over the objects; areas without any stay with zeros."""
    today, day = F.lit(as_of), F.col("date")
    task = (F.col("ko_type") == "task") & (F.col("status") == "active")
    # The counts (one row per area) are written before they meet the area map. Otherwise the
    # map's filters travel through the join key into the classification of every document.
    counted = kos.groupBy(F.coalesce("area", F.lit(NO_AREA)).alias("area")).agg(
        F.count_if(task).alias("tasks"),
        F.count_if((F.col("ko_type") == "event") & day.between(today, F.date_add(today, 7))).alias("events"),
        F.count_if((F.col("ko_type") == "decision") & (day >= F.date_sub(today, 14))).alias("decisions"),
        F.count_if((F.col("ko_type") == "question") & (F.col("status") == "active")).alias("questions"),
        F.count_if(task & (F.col("valid_to") < today)).alias("overdue"))
    counted = materialize(counted)
    out = (dim.select("map_order", F.col("id").alias("area"), "name")
           .join(counted, "area", "left").join(mail_hits, "area", "left"))
    return out.fillna(0, list(fixed.AREA_WEIGHTS))


def area_score(signals: DataFrame, overrides: DataFrame) -> DataFrame:
    """Weighted sum of the signals times the manual weight (never below 0.1)."""
    auto = sum((F.col(k) * w for k, w in fixed.AREA_WEIGHTS.items()), F.lit(0))
    out = signals.join(overrides.select("area", "weight", "pin", "status"), "area", "left")
    weight = F.when(F.col("weight").isNull(), 1.0).otherwise(F.greatest("weight", F.lit(0.1)))
    return (out.withColumn("weight", weight).withColumn("score_auto", auto)
            .withColumn("score", F.bround(F.col("score_auto") * F.col("weight"), 1))
            .withColumn("status", F.coalesce("status", F.lit("activa"))))


def rank_areas(scored: DataFrame) -> DataFrame:
    """Pinned by pin, then active by score, then paused by score; ties in map order.

    One row per area of the hand-kept map: the window covers the dimension only.
    """
    paused = F.col("status") == "pausada"
    tier = F.when(paused, 2).when(F.col("pin").isNotNull(), 0).otherwise(1)
    order = Window.orderBy(tier, F.when(tier == 0, F.col("pin")),
                           F.when(tier != 0, -F.col("score")), "map_order")
    return scored.withColumn("rank", F.row_number().over(order))


def area_reason(c: dict[str, Column] | None = None) -> Column:
    return reason_label([(F.col(k), v) for k, v in fixed.AREA_LABELS.items()], "sin actividad")


def area_cards(ranked: DataFrame, counts: DataFrame) -> DataFrame:
    out = ranked.join(counts.select("area", "documents", "kos", "tasks_open",
                                    F.col("decisions").alias("n_decisions")), "area", "left")
    return (out.fillna(0, ["documents", "kos", "tasks_open", "n_decisions"])
            .withColumn("signals_label", area_reason())
            .select("rank", "area", "name", "score", "weight", "pin", "status", "signals_label",
                    "documents", "kos", "tasks_open", "n_decisions"))
