"""Rewrites of whole tables: types, countries, sources, nominees, search text, places."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeweave.functions.classify import derive_ownership_type
from stakeweave.functions.names import backfilled_search_text, is_nominee_name
from stakeweave.operators.edges import dedup_owns
from stakeweave.operators.tree import checkpoint_folder

# Spellings of countries that the code table lacks.
COUNTRY_VARIANTS = {
    "UAE": "AE", "South Korea": "KR", "Korea, Republic of": "KR", "Republic of Korea": "KR", "North Korea": "KP",
    "Korea, Democratic People's Republic of": "KP", "Czechia": "CZ", "United States of America": "US", "USA": "US", "Russian Federation": "RU",
    "Viet Nam": "VN", "Türkiye": "TR", "Turkiye": "TR", "The Netherlands": "NL", "Ivory Coast": "CI", "Côte d'Ivoire": "CI",
    "Republic of Ireland": "IE", "Great Britain": "GB", "Taiwan, Province of China": "TW", "Hong Kong SAR": "HK", "Macau": "MO",
    "Brunei Darussalam": "BN", "Lao People's Democratic Republic": "LA", "Syrian Arab Republic": "SY", "Moldova, Republic of": "MD",
    "Tanzania, United Republic of": "TZ", "Iran, Islamic Republic of": "IR", "Venezuela, Bolivarian Republic of": "VE",
    "Bolivia, Plurinational State of": "BO",
}


def migrate_ownership_types(edges: DataFrame) -> DataFrame:
    """Types derived anew from disclosed stakes; a majority without one becomes unknown; others stay."""
    kind = (
        F.when(F.col("stake_percent").isNotNull(), derive_ownership_type(F.col("stake_percent")))
        .when(F.col("ownership_type") == "majority", "unknown").otherwise(F.col("ownership_type"))
    )
    return edges.withColumn("ownership_type", kind)


def normalize_countries(entities: DataFrame, codes: DataFrame) -> DataFrame:
    """Country names, variants and known codes as two-letter codes; ``codes`` has ``code, name``.  All else stays."""
    spark = entities.sparkSession
    extra = spark.createDataFrame([(v, k) for k, v in COUNTRY_VARIANTS.items()], "code string, name string")
    table = codes.select("code", "name").unionByName(extra).groupBy(F.lower("name").alias("_name")).agg(F.min("code").alias("_code"))
    joined = entities.join(table, F.lower(F.trim("country")) == F.col("_name"), "left")
    known = codes.select(F.upper("code").alias("_known")).distinct()
    joined = joined.join(known, F.upper(F.trim("country")) == F.col("_known"), "left")
    return joined.withColumn("country", F.coalesce("_code", "_known", "country")).select(*entities.columns)


def backfill_sources(entities: DataFrame, sources: DataFrame) -> DataFrame:
    """A missing source is the one that assigns the entity's identifier."""
    ids = sources.groupBy("name").agg(F.min("id").alias("id"))
    wikidata, sec = (ids.where(F.col("name") == n).select(F.col("id").alias(c), F.lit(True).alias(f"{c}_k")) for n, c in (("Wikidata", "_w"), ("SEC EDGAR", "_s")))
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    rows = entities.withColumn("_q", has("wikidata_id")).withColumn("_c", has("sec_cik"))
    rows = rows.join(wikidata, F.col("_q") == F.col("_w_k"), "left").join(sec, F.col("_c") == F.col("_s_k"), "left")
    return rows.withColumn("source_id", F.coalesce("source_id", "_w", "_s")).select(*entities.columns)


def flag_nominees(entities: DataFrame) -> DataFrame:
    """Holders of record by name; a flag once set stays."""
    return entities.withColumn("is_nominee", F.coalesce("is_nominee", F.lit(False)) | is_nominee_name(F.col("name")))


def housekeeping(entities: DataFrame, owns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What follows every import: nominees are flagged, and of active edges of one pair the best one stays."""
    ended = owns.where("until IS NOT NULL")
    return flag_nominees(entities), dedup_owns(owns).select(*owns.columns).unionByName(ended)


def stamp_freshness(entities: DataFrame, targets: DataFrame, now: Column) -> DataFrame:
    """Targets of a visit (``id, depth``) with its time; of several passes over one target the deepest counts, and a depth never falls."""
    seen = targets.where("id IS NOT NULL").groupBy("id").agg(F.max(F.coalesce("depth", F.lit(0))).alias("_depth"))
    rows = entities.join(seen, "id", "left")
    hit = F.col("_depth").isNotNull()
    return rows.withColumns(
        {
            "last_scraped_at": F.when(hit, now).otherwise(F.col("last_scraped_at")), "on_demand_scraped": F.when(hit, True).otherwise(F.col("on_demand_scraped")),
            "scrape_depth": F.greatest("scrape_depth", "_depth"),
        }
    ).select(*entities.columns)


def without_meta(frame: DataFrame) -> DataFrame:
    """``frame`` without the columns that the store adds, whose names begin with ``@``."""
    return frame.select(*[F.col(f"`{c}`") for c in frame.columns if not c.startswith("@")])


def backfill_search_text(entities: DataFrame) -> DataFrame:
    text = backfilled_search_text(F.col("name"), F.col("description"), F.col("aliases"))
    return entities.withColumn("search_text", F.coalesce("search_text", text))


def geocode(entities: DataFrame, places: DataFrame) -> DataFrame:
    """Missing positions from ``places`` (``place, lat, lng``): the full address first, else city and country."""
    rows = entities.withColumn("_full", F.lower(F.trim("hq_address"))).withColumn("_town", F.lower(F.concat_ws(", ", F.nullif("hq_city", F.lit("")), F.nullif("hq_country", F.lit("")))))
    p = places.groupBy(F.lower("place").alias("place")).agg(F.min(F.struct("lat", "lng")).alias("at"))
    a, b = (p.select(F.col("place").alias(f"_{x}p"), F.col("at").alias(f"_{x}")) for x in "ab")
    rows = rows.join(a, F.col("_full") == F.col("_ap"), "left").join(b, F.col("_town") == F.col("_bp"), "left")
    missing, at = F.col("hq_lat").isNull(), F.coalesce("_a", "_b")
    return (
        rows.withColumn("hq_geo_precision", F.when(missing & F.col("_a").isNotNull(), "exact").when(missing & F.col("_b").isNotNull(), "approx").otherwise(F.col("hq_geo_precision")))
        .withColumn("hq_lng", F.when(missing, at["lng"]).otherwise(F.col("hq_lng"))).withColumn("hq_lat", F.when(missing, at["lat"]).otherwise(F.col("hq_lat")))
        .select(*entities.columns)
    )


def purge_company(entities: DataFrame, edges: DataFrame, persons: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables without the entities of ``name``, their edges (an edge is a row, whatever its id), and the neighbours that no other edge touches."""
    gone = entities.where(F.lower("name") == name.lower()).select("id").distinct()
    # Written, so that the planner knows how few they are before it deals the edges.
    path = f"{checkpoint_folder(entities.sparkSession)}/purged-{uuid.uuid4().hex}"
    gone.write.parquet(path)
    gone = entities.sparkSession.read.schema(gone.schema).parquet(path)
    marked = edges
    for end in ("from_id", "to_id"):
        marked = marked.join(gone.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    marked = marked.withColumn("_hit", F.coalesce("_from_id", F.lit(False)) | F.coalesce("_to_id", F.lit(False)))
    left = marked.where(~F.col("_hit")).select(*edges.columns)
    # One pass over the edges: a row for each end, of which tasks keep one an id.
    ends = marked.select(F.explode(F.array("from_id", "to_id")).alias("id"), "_hit").groupBy("id").agg(F.every("_hit").alias("alone"))
    orphans = ends.where("alone AND id IS NOT NULL").select("id").unionByName(gone).distinct()
    return entities.join(orphans, "id", "left_anti"), left, persons.join(orphans, "id", "left_anti")
