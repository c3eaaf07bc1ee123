"""Knowledge graph: degree, incident edges, validity, decision chain, map tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..functions.text import short_label
from .scale import first_per_key, with_previous


def node_degree(edges: DataFrame) -> DataFrame:
    """Edge ends per node; a self loop counts twice."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def incident_edges(edges: DataFrame) -> DataFrame:
    """One row per (node, edge); a self loop appears once."""
    ends = F.array_distinct(F.array("source_id", "target_id"))
    return edges.select(F.explode(ends).alias("node_id"), "*")


def edges_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch the given nodes: endpoints are exploded, so the join is an equality."""
    wanted = nodes.select(F.col("id").alias("node_id")).distinct()
    return incident_edges(edges).join(wanted, "node_id")


def relation_count(edges: DataFrame) -> DataFrame:
    """Number of edges that touch each node (a self loop once)."""
    return incident_edges(edges).groupBy(F.col("node_id").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def edge_names(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Readable ends ``name (type)``; an unknown end keeps its id."""
    names = entities.select(
        "id", F.concat(F.col("name"), F.lit(" ("), F.col("entity_type"), F.lit(")")).alias("label"))
    src = names.select(F.col("id").alias("source_id"), F.col("label").alias("s"))
    dst = names.select(F.col("id").alias("target_id"), F.col("label").alias("t"))
    return (edges.join(src, "source_id", "left").join(dst, "target_id", "left")
            .withColumn("source_name", F.coalesce("s", "source_id"))
            .withColumn("target_name", F.coalesce("t", "target_id")).drop("s", "t"))


def valid_at(edges: DataFrame, day: dt.date) -> DataFrame:
    """Edges true on a date; an open end means still valid."""
    return edges.where((F.col("valid_from") <= F.lit(day))
                       & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.lit(day))))


def name_index(entities: DataFrame) -> DataFrame:
    """Lower-cased name to entity id; the first by (type, name) wins."""
    named = entities.select(F.lower("name").alias("low"), F.col("id").alias("entity_id"), "entity_type", "name")
    first = first_per_key(named, ["low"], [F.col("entity_type"), F.col("name"), F.col("entity_id")])
    return first.select("low", "entity_id")


def decision_links(kos: DataFrame, entities: DataFrame) -> DataFrame:
    """``decided`` (person to decision) and ``shapes`` (decision to project) links."""
    index = name_index(entities)
    decisions = kos.where("ko_type = 'decision'")
    people = decisions.select("id", "date", F.explode("people").alias("who")).withColumn("low", F.lower("who"))
    decided = people.join(index, "low").select(
        F.col("entity_id").alias("source"), F.col("id").alias("target"), F.lit("decided").alias("type"),
        F.col("date").alias("valid_from"))
    projects = decisions.where("project is not null").select("id", "date", F.lower("project").alias("low"))
    shapes = projects.join(index, "low").select(
        F.col("id").alias("source"), F.col("entity_id").alias("target"), F.lit("shapes").alias("type"),
        F.col("date").alias("valid_from"))
    return decided.unionByName(shapes)


def decision_chain(kos: DataFrame) -> DataFrame:
    """``precedes`` link from the previous decision of the same project."""
    decisions = kos.where("ko_type = 'decision' and project is not null").select("id", "project", "date")
    chained = with_previous(decisions, "project", ["date", "id"], "id", "previous")
    return chained.where("previous is not null").select(
        F.col("previous").alias("source"), F.col("id").alias("target"), F.lit("precedes").alias("type"),
        F.col("date").alias("valid_from"))


def graph_tables(entities: DataFrame, edges: DataFrame, kos: DataFrame, pinned: DataFrame
                 ) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of the memory map: entities and decisions, relations and decision links."""
    pins = pinned.select(F.col("name"), F.lit(True).alias("pin")).distinct()
    ents = (entities.join(node_degree(edges), "id", "left").join(pins, "name", "left")
            .select("id", "name", F.col("entity_type").alias("type"),
                    F.coalesce("degree", F.lit(0)).alias("degree"),
                    F.coalesce("pin", F.lit(False)).alias("pinned"), F.lit(None).cast("date").alias("date")))
    links = decision_links(kos, entities)
    matched = links.where("type = 'decided'").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    decisions = (kos.where("ko_type = 'decision'").join(matched, "id", "left")
                 .select("id", short_label(F.col("title")).alias("name"), F.lit("decision").alias("type"),
                         (F.lit(1) + F.coalesce("n", F.lit(0))).alias("degree"),
                         F.lit(False).alias("pinned"), "date"))
    base = edges.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"),
                        F.col("rel_type").alias("type"), "valid_from", "valid_to")
    more = links.unionByName(decision_chain(kos)).withColumn("valid_to", F.lit(None).cast("date"))
    return ents.unionByName(decisions), base.unionByName(more)
