"""Frozen copies of the memory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.graph import node_degree

TABLES = ["nodes", "links", "entities", "relationships", "kos", "documents"]


def cited_documents(docs: DataFrame, kos: DataFrame) -> DataFrame:
    """Documents that at least one object names as its source."""
    cited = kos.where("source_doc is not null").select(F.col("source_doc").alias("id")).distinct()
    return docs.join(cited, "id", "left_semi")


def snapshot_tables(docs: DataFrame, kos: DataFrame, entities: DataFrame, edges: DataFrame,
                    include_bodies: bool = True) -> dict[str, DataFrame]:
    nodes = (entities.join(node_degree(edges), "id", "left")
             .select("id", "name", F.col("entity_type").alias("type"), F.coalesce("degree", F.lit(0)).alias("degree")))
    links = edges.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"),
                         F.col("rel_type").alias("type"), "valid_from", "valid_to")
    kept = cited_documents(docs, kos)
    if not include_bodies:
        kept = kept.withColumn("body", F.lit(""))
    return {"nodes": nodes, "links": links, "entities": entities, "relationships": edges, "kos": kos, "documents": kept}


def export_snapshot(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{path}/{name}")


def export_memory(docs: DataFrame, kos: DataFrame, entities: DataFrame, edges: DataFrame, path: str,
                  include_bodies: bool = True, fmt: str = "parquet") -> None:
    """The snapshot of the memory tables. Objects, entities and relationships are exported first; nodes,
    links and the cited documents follow from the exported rows, so each table is made once."""
    stored = {"entities": entities, "relationships": edges, "kos": kos}
    export_snapshot(stored, path, fmt)
    read = {name: docs.sparkSession.read.format(fmt).schema(df.schema).load(f"{path}/{name}") for name, df in stored.items()}
    tables = snapshot_tables(docs, read["kos"], read["entities"], read["relationships"], include_bodies)
    export_snapshot({name: df for name, df in tables.items() if name not in stored}, path, fmt)


def read_snapshot(spark: SparkSession, path: str, schemas: dict[str, str] | None = None,
                  fmt: str = "parquet") -> dict[str, DataFrame]:
    """The exported tables; every job runs on them as on the live ones."""
    out = {}
    for name in TABLES:
        reader = spark.read.format(fmt)
        if schemas and name in schemas:
            reader = reader.schema(schemas[name])
        out[name] = reader.load(f"{path}/{name}")
    return out
