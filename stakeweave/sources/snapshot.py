"""Snapshots for exchange between instances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "stakeweave-snapshot-1"
#: Identifiers by which an importing instance finds its own rows.
REFERENCE = ("id", "name", "wikidata_id", "sec_cik", "lei_id", "companies_house_id")


def export_snapshot(entities: DataFrame, persons: DataFrame, owns: DataFrame, path: str) -> None:
    """Entities, persons and edges with references to both ends, as one NDJSON dataset with a kind a row."""
    ref = F.struct(*[F.col(c) for c in REFERENCE if c in entities.columns])
    nodes = entities.select(F.col("id").alias("_id"), F.to_json(ref).alias("ref")).unionByName(
        persons.select(F.col("id").alias("_id"), F.to_json(F.struct("id", F.col("full_name").alias("name"), "wikidata_id")).alias("ref"))
    )
    a, b = (nodes.select(F.col("_id").alias(f"_{k}"), F.col("ref").alias(f"{k}_ref")) for k in ("from", "to"))
    edges = owns.join(a, F.col("from_id") == F.col("_from")).join(b, F.col("to_id") == F.col("_to")).drop("_from", "_to")
    row = lambda frame, kind: frame.select(F.lit(FORMAT).alias("format"), F.lit(kind).alias("kind"), F.to_json(F.struct("*")).alias("body"))
    row(entities, "entity").unionByName(row(persons, "person")).unionByName(row(edges, "owns")).write.mode("overwrite").json(path)


def read_snapshot(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """Rows of one kind; a row of another format fails the read."""
    rows = spark.read.schema("format string, kind string, body string").json(path)
    checked = F.when(F.col("format") == FORMAT, F.col("body")).otherwise(F.raise_error(F.concat(F.lit("unknown snapshot format: "), F.coalesce("format", F.lit("none")))))
    return rows.where(F.col("kind") == kind).select(F.from_json(checked, schema).alias("r")).select("r.*")


def snapshot_counts(entities: DataFrame, persons: DataFrame, owns: DataFrame) -> DataFrame:
    parts = [f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, f in (("entities", entities), ("persons", persons), ("owns", owns))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
