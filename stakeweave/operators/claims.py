"""Claims and provenance."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stakeweave.functions.hashing import claim_key

DEFAULT_CREDIBILITY = 80


def with_claim_key(claims: DataFrame) -> DataFrame:
    return claims.withColumn("claim_key", claim_key(F.col("kind"), F.col("from_id"), F.col("to_id"), F.col("source_id")))


def claim_rows(edges: DataFrame, kind: str, now: Column) -> DataFrame:
    """The claims that edges make: identity, values and when they were seen."""
    has = lambda c, t: F.col(c) if c in edges.columns else F.lit(None).cast(t)
    return with_claim_key(
        edges.select(
            F.lit(kind).alias("kind"), "from_id", "to_id", "source_id", has("stake_percent", "double").alias("stake_percent"),
            has("voting_power_pct", "double").alias("voting_power_pct"), has("ownership_type", "string").alias("ownership_type"),
            has("role", "string").alias("role"), has("since", "string").alias("since"), has("until", "string").alias("until"),
            has("source_url", "string").alias("source_url"), has("source_date", "string").alias("source_date"),
            F.coalesce(has("credibility_score", "int"), F.lit(DEFAULT_CREDIBILITY)).alias("credibility_score"), now.alias("last_seen_at"),
        ).where("source_id IS NOT NULL")
    )


def upsert_claims(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored claims with ``new`` ones folded in: first sight is kept, everything else is the latest's."""
    rows = stored.withColumn("_new", F.lit(0)).unionByName(
        new.withColumn("first_seen_at", F.col("last_seen_at")).withColumn("_new", F.lit(1)).select(*stored.columns, "_new")
    )
    values = [c for c in stored.columns if c not in ("claim_key", "first_seen_at")]
    latest = F.max_by(F.struct(*values), F.struct("_new", F.coalesce("last_seen_at", F.lit("")), F.coalesce("source_url", F.lit("")), F.coalesce("stake_percent", F.lit(-1.0))))
    folded = rows.groupBy("claim_key").agg(F.min("first_seen_at").alias("first_seen_at"), latest.alias("_v"))
    return folded.select("claim_key", *[F.col(f"_v.{c}").alias(c) for c in values], "first_seen_at").select(*stored.columns)


def best_claim(claims: DataFrame, *keys: str) -> DataFrame:
    """One claim per key: most credible, then the latest source date, then the smallest link."""
    order = Window.partitionBy(*keys).orderBy(
        F.coalesce("credibility_score", F.lit(0)).desc(), F.coalesce("source_date", F.lit("")).desc(), F.coalesce("source_url", F.lit(""))
    )
    return claims.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def claims_for(claims: DataFrame, from_id: str | None = None, to_id: str | None = None, kind: str | None = None) -> DataFrame:
    """Claims that match all given filters, most credible first; without a filter none."""
    wanted = {"from_id": from_id, "to_id": to_id, "kind": kind}
    tests = [F.col(c) == v for c, v in wanted.items() if v is not None]
    if not tests:
        return claims.limit(0)
    return claims.where(reduce(and_, tests)).orderBy(F.coalesce("credibility_score", F.lit(0)).desc(), F.coalesce("source_date", F.lit("")).desc(), F.coalesce("source_url", F.lit("")))


# An entity's hard identifiers, the source that assigns each, and its record's address.
ID_SOURCES = (
    ("wikidata_id", "Wikidata", "https://www.wikidata.org/wiki/"),
    ("sec_cik", "SEC EDGAR", "https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK="),
    ("lei_id", "GLEIF", "https://search.gleif.org/#/record/"),
    ("companies_house_id", "UK PSC", "https://find-and-update.company-information.service.gov.uk/company/"),
)


def own_record_sources(entities: DataFrame, sources: DataFrame) -> DataFrame:
    """A row for each hard identifier whose source is known, else one for the stamped source."""
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("_name"), "type", "credibility_score")
    ids = F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).alias("value"), F.lit(url).alias("url")) for c, name, url in ID_SOURCES])
    exploded = entities.select(F.col("id").alias("entity_id"), F.explode(ids).alias("x")).where("x.value IS NOT NULL AND x.value <> ''")
    linked = exploded.join(s, F.col("x.name") == F.col("_name")).select(
        "entity_id", "source_id", "_name", "type", "credibility_score", F.concat("x.url", "x.value").alias("source_url")
    )
    stamped = entities.where("source_id IS NOT NULL").select(F.col("id").alias("entity_id"), "source_id").join(s, "source_id")
    fallback = stamped.join(linked.select("entity_id"), "entity_id", "left_anti").select(
        "entity_id", "source_id", "_name", "type", "credibility_score", F.lit(None).cast("string").alias("source_url")
    )
    return linked.unionByName(fallback).withColumnRenamed("_name", "name")


def dedup_provenance(rows: DataFrame, key: str, sources: DataFrame) -> DataFrame:
    """One row per node, source and link: the latest source date, then the latest visit; unknown sources drop their rows.

    Rows are folded by these three before the sources' columns join them.
    """
    latest = F.max(F.struct(F.coalesce("source_date", F.lit("")).alias("d"), F.coalesce("last_scraped_at", F.lit("")).alias("l"))).alias("_latest")
    folded = rows.groupBy(key, "source_id", "source_url").agg(latest)
    s = sources.select(F.col("id").alias("source_id"), "name", "type", "credibility_score")
    return folded.join(s, "source_id").select(
        key, "source_id", "name", "type", "credibility_score", "source_url", F.nullif(F.col("_latest.d"), F.lit("")).alias("source_date"),
        F.nullif(F.col("_latest.l"), F.lit("")).alias("last_scraped_at"),
    )


def entity_provenance(claims: DataFrame, entities: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources behind every entity: claims about it (an unknown source drops the claim) and its own record."""
    about = claims.select(F.col("to_id").alias("entity_id"), "source_id", "source_url", "source_date", F.col("last_seen_at").alias("last_scraped_at"))
    missing = F.lit(None).cast("string")
    own = own_record_sources(entities, sources).select("entity_id", "source_id", "source_url", missing.alias("source_date"), missing.alias("last_scraped_at"))
    return dedup_provenance(about.unionByName(own), "entity_id", sources)


def person_provenance(owns: DataFrame, roles: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources behind every person's edges, one row per source and link."""

    def branch(edges: DataFrame) -> DataFrame:
        has = lambda c: F.col(c) if c in edges.columns else F.lit(None).cast("string")
        return edges.where("source_id IS NOT NULL").select(
            F.col("from_id").alias("person_id"), "source_id", has("source_url").alias("source_url"), has("source_date").alias("source_date"),
            has("last_scraped_at").alias("last_scraped_at"),
        )

    return dedup_provenance(branch(owns).unionByName(branch(roles)), "person_id", sources)
