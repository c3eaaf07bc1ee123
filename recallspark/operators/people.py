"""People: signals, ranking, suggestions, unknown senders, brief items."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.text import reason_label, sender_name
from .graph import relation_count
from .scale import contains_pairs, either_way_pairs, top_per_group, with_position


def mail_by_person(people: DataFrame, triaged: DataFrame) -> DataFrame:
    """P1-P2 mails per person; a sender counts for every person whose name it contains or is in."""
    senders = (triaged.where("priority <= 2").select(F.lower(sender_name(F.col("from"))).alias("sender"))
               .groupBy("sender").agg(F.count(F.lit(1)).alias("n")))
    low = people.select(F.lower("name").alias("low"))
    pairs = either_way_pairs(senders.select("sender"), low)
    return (pairs.join(senders, pairs["left"] == senders["sender"])
            .groupBy(F.col("right").alias("low")).agg(F.sum("n").alias("mail")))


def person_signals(entities: DataFrame, edges: DataFrame, kos: DataFrame, triaged: DataFrame,
                   overrides: DataFrame, as_of: dt.date) -> DataFrame:
    """Degree, mentions of the last 30 days, coming events and urgent mail per person."""
    today = F.lit(as_of)
    people = entities.where("entity_type = 'person'").select("id", "name").withColumn("low", F.lower("name"))
    mentions = (kos.where(F.col("date") >= F.date_sub(today, 30))
                .select("ko_type", "date", F.explode(F.array_distinct("people")).alias("name"))
                .groupBy("name").agg(
                    F.count(F.lit(1)).alias("recent"),
                    F.count_if((F.col("ko_type") == "event") & (F.col("date") >= today)).alias("upcoming")))
    over = overrides.select("name", F.col("pin").alias("pinned"), "role").dropDuplicates(["name"])
    out = (people.join(relation_count(edges), "id", "left").join(mentions, "name", "left")
           .join(mail_by_person(people, triaged), "low", "left")
           .join(over, "name", "left")
           .fillna(0, ["degree", "recent", "upcoming", "mail"]).fillna(False, ["pinned"]))
    score = sum((F.col(k) * w for k, w in fixed.PERSON_WEIGHTS.items()), F.lit(0))
    return out.withColumn("score", score)


def rank_people(signals: DataFrame) -> DataFrame:
    """Pinned first, then score, then name. The order covers every person of the graph, so it
    is numbered with a range-partitioned sort."""
    return with_position(signals, [F.desc("pinned"), F.desc("score"), F.asc("low"), F.asc("id")], "rank")


def suggest_people(signals: DataFrame) -> DataFrame:
    return (signals.where(~F.col("pinned") & (F.col("score") >= fixed.SUGGEST_MIN_SCORE))
            .orderBy(F.desc("score"), "low", "id").limit(fixed.SUGGEST_MAX))


def unknown_senders(triaged: DataFrame, entities: DataFrame) -> DataFrame:
    """Frequent senders (priority 3 or better, two mails or more) that match no known person."""
    senders = (triaged.where("priority <= 3").select(sender_name(F.col("from")).alias("name"))
               .where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("mails"))
               .withColumn("low", F.lower("name")))
    people = entities.where("entity_type = 'person'").select(F.lower("name").alias("low"))
    known = either_way_pairs(senders.select("low"), people).select(F.col("left").alias("low")).distinct()
    return (senders.join(known, "low", "left_anti").where("mails >= 2")
            .orderBy(F.desc("mails"), "name").limit(fixed.SUGGEST_MAX).select("name", "mails"))


def person_reason() -> Column:
    return reason_label([(F.col(k), v) for k, v in fixed.PERSON_LABELS.items()], "sin señales")


def person_brief_items(kos: DataFrame, pinned: DataFrame, as_of: dt.date, horizon_days: int = 14) -> DataFrame:
    """Active events (inside the horizon), tasks and questions naming each pinned person.

    The name is matched as a substring, on the distinct names only.
    """
    today = F.lit(as_of)
    active = kos.where("status = 'active' and ko_type in ('event','task','question')")
    active = active.where((F.col("ko_type") != "event")
                          | F.col("date").between(today, F.date_add(today, horizon_days)))
    named = active.select("id", "ko_type", "date", "title", "statement", F.explode("people").alias("who"))
    named = named.withColumn("low", F.lower("who"))
    pairs = contains_pairs(named.select("low"), pinned.select(F.lower("name")))
    wanted = pairs.join(pinned.select("name", F.lower("name").alias("needle")), "needle")
    return (named.join(wanted.select(F.col("hay").alias("low"), "name"), "low")
            .select("name", "id", "ko_type", "date", "title", "statement").distinct())


def top_items_per_person(items: DataFrame, events: int = 1, tasks: int = 4, questions: int = 2) -> DataFrame:
    """Next event, newest tasks and questions per person."""
    age = F.when(F.col("ko_type") == "event", F.datediff("date", F.lit("1970-01-01"))).otherwise(
        -F.datediff("date", F.lit("1970-01-01")))
    ranked = top_per_group(items, ["name", "ko_type"], [age, F.col("id")], max(events, tasks, questions))
    cap = F.when(F.col("ko_type") == "event", events).when(F.col("ko_type") == "task", tasks).otherwise(questions)
    return ranked.where(F.col("rank") <= cap)
