"""Mail triage against the knowledge graph."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.text import sender_name
from ..session import materialize
from .graph import relation_count
from .scale import either_way_pairs, with_position


def known_people(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(low, name, degree) of the people in the graph."""
    people = entities.where("entity_type = 'person'").select("id", "name")
    return (people.join(relation_count(edges), "id", "left")
            .select(F.lower("name").alias("low"), "name", F.coalesce("degree", F.lit(0)).alias("degree")))


def match_senders(mail: DataFrame, known: DataFrame, pinned: DataFrame) -> DataFrame:
    """One row per distinct sender: the matching person (first by name) and the pinned flag.

    Sender and person match when one name contains the other.
    """
    senders = mail.select(F.lower(sender_name(F.col("from"))).alias("sender")).where("sender <> ''").distinct()
    people = (known.select("low", "name", "degree", F.lit(False).alias("pin"))
              .unionByName(pinned.select(F.lower("name").alias("low"), "name", F.lit(None).cast("bigint").alias("degree"),
                                         F.lit(True).alias("pin"))))
    pairs = either_way_pairs(senders, people.select("low"))
    hits = (pairs.join(people, pairs["right"] == people["low"])
            .groupBy(F.col("left").alias("sender"))
            .agg(F.min_by(F.when(~F.col("pin"), F.struct("low", "degree")),
                          F.when(~F.col("pin"), F.struct("name", "degree"))).alias("hit"),
                 F.bool_or("pin").alias("is_pinned")))
    return (senders.join(hits, "sender", "left")
            .select("sender", F.col("hit.low").alias("person"), F.col("hit.degree").alias("degree"),
                    F.coalesce("is_pinned", F.lit(False)).alias("is_pinned")))


def score_mail(mail: DataFrame, senders: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Adds score, priority (1 best to 5) and reasons. Stateless, so it also runs on a stream."""
    p = fixed.TRIAGE_POINTS
    text = F.concat_ws(" ", F.coalesce("subject", F.lit("")), F.coalesce("snippet", F.lit("")))
    known = F.col("person").isNotNull()
    fresh = F.lit(as_of).cast("timestamp").cast("double") - F.col("date").cast("timestamp").cast("double") < 86_400
    labels = F.array(*[F.lit(x) for x in fixed.NOISE_LABELS])
    per_rel = F.least(F.lit(p["relation_cap"]), F.col("degree") * p["per_relation"])
    person = F.concat(F.lit("remitente en tu knowledge graph ("), F.col("person"), F.lit(", "),
                      F.col("degree").cast("string"), F.lit(" relaciones)"))
    rules: list[tuple[Column, Column, Column]] = [
        (F.col("is_pinned"), F.lit(p["pinned"]), F.lit("persona fijada por ti")),
        (known, F.lit(p["known"]) + per_rel, person),
        (text.rlike(fixed.URGENCY_PATTERN), F.lit(p["urgency"]), F.lit("lenguaje de urgencia/plazo")),
        (text.rlike(fixed.ACTION_PATTERN), F.lit(p["action"]), F.lit("pide una acción tuya")),
        (fresh, F.lit(p["fresh"]), F.lit("recibido en las últimas 24 h")),
        (F.concat_ws(" ", F.col("from"), text).rlike(fixed.NOISE_PATTERN), F.lit(p["noise"]),
         F.lit("parece correo automático/newsletter")),
        (F.arrays_overlap("labels", labels), F.lit(p["label"]), F.lit("categoría promociones/social/updates")),
    ]
    with_sender = mail.withColumn("sender", F.lower(sender_name(F.col("from")))).join(senders, "sender", "left")
    score, reasons = F.lit(0), []
    for i, (hit, points, reason) in enumerate(rules):
        with_sender = with_sender.withColumn(f"__r{i}", F.coalesce(hit, F.lit(False)))
        score = score + F.when(F.col(f"__r{i}"), points).otherwise(0)
        reasons.append(F.when(F.col(f"__r{i}"), reason))
    found = F.filter(F.array(*reasons), lambda r: r.isNotNull())
    def level(points: Column) -> Column:
        out = None
        for number, floor in fixed.PRIORITY_FLOORS:
            out = F.when(points >= floor, number) if out is None else out.when(points >= floor, number)
        return out.otherwise(fixed.LOWEST_PRIORITY)

    # A filter on the priority is moved below the score. Named inside a function, the score is made once there too,
    # and not anew for each floor.
    priority = F.get(F.transform(F.array("score"), level), 0)
    return (with_sender.withColumn("score", score.cast("int"))
            .withColumn("priority", priority)
            .withColumn("reasons", F.when(F.size(found) == 0, F.array(F.lit("sin señales fuertes"))).otherwise(found))
            .drop(*[f"__r{i}" for i in range(len(rules))], "person", "degree", "is_pinned", "sender"))


def triage_mail(mail: DataFrame, entities: DataFrame, edges: DataFrame, pinned: DataFrame,
                as_of: dt.datetime) -> DataFrame:
    senders = materialize(match_senders(mail, known_people(entities, edges), pinned))
    return score_mail(mail, senders, as_of)


def rank_mail(triaged: DataFrame) -> DataFrame:
    """Priority, then score, then id, numbered over the whole inbox."""
    return with_position(triaged, [F.asc("priority"), F.desc("score"), F.asc("id")], "rank")


def triage_summary(triaged: DataFrame) -> DataFrame:
    return triaged.agg(F.count(F.lit(1)).alias("mails"), F.count_if(F.col("priority") <= 2).alias("p1_p2"))


def slim_triage(triaged: DataFrame) -> DataFrame:
    """What may be stored of a mail: metadata only, the day instead of the time."""
    suggested = F.col("suggested_action") if "suggested_action" in triaged.columns else F.lit("")
    return triaged.select("id", "priority", "from", "subject", F.to_date("date").alias("date"),
                          "account", "reasons", suggested.alias("suggested_action"))
