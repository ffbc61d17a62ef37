"""Wikidata: saved query results, one row per combination of optional properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeweave.functions.classify import infer_entity_type
from stakeweave.functions.names import normalize_cik, normalize_lei, parse_point, qid, wikidata_url

ROW_SCHEMA = "map<string,struct<value:string>>"


def value(row: Column, key: str) -> Column:
    return F.nullif(F.element_at(row, key)["value"], F.lit(""))


def company_facts(rows: DataFrame) -> DataFrame:
    """One row per company (``id, n, row``): the first value of each scalar in row order, distinct values of each list."""
    r = F.col("row")
    first = lambda key: F.min_by(value(r, key), F.when(value(r, key).isNotNull(), F.col("n")))
    every = lambda key, f=lambda x: x: F.array_sort(F.collect_set(f(value(r, key))))
    flat = rows.groupBy("id").agg(
        first("itemLabel").alias("name"), first("description").alias("description"), first("countryCode").alias("country"), first("inception").alias("inception"),
        first("website").alias("website"), first("employees").alias("employees"), first("revenue").alias("revenue"), first("lei").alias("lei"), first("cik").alias("cik"),
        first("hqLabel").alias("hq_city"), first("coord").alias("coord"), every("instance", qid).alias("instances"), every("alias").alias("aliases"),
        every("countryCode").alias("countries"),
    )
    point = parse_point(F.col("coord"))
    return flat.select(
        "id", "name", "description", F.upper("country").alias("country"), F.substring("inception", 1, 4).try_cast("int").alias("founded"), "website",
        F.col("employees").try_cast("double").cast("int").alias("employees"), F.col("revenue").try_cast("double").alias("revenue"),
        normalize_lei(F.col("lei")).alias("lei_id"), normalize_cik(F.col("cik")).alias("sec_cik"), "hq_city", point["lat"].alias("hq_lat"), point["lng"].alias("hq_lng"),
        infer_entity_type(F.col("instances")).alias("type"), "aliases", "countries", F.col("id").alias("wikidata_id"), wikidata_url(F.col("id")).alias("source_url"),
    )


def people_of(rows: DataFrame, roles: dict[str, str]) -> DataFrame:
    """``id, person_id, person, role, since, until`` over several role properties, one row each."""
    out = None
    r = F.col("row")
    for key, role in roles.items():
        part = rows.where(value(r, key).isNotNull()).select(
            "id", qid(value(r, key)).alias("person_id"), value(r, f"{key}Label").alias("person"), F.lit(role).alias("role"),
            F.substring(value(r, f"{key}Start"), 1, 10).alias("since"), F.substring(value(r, f"{key}End"), 1, 10).alias("until"),
        )
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def person_details(rows: DataFrame) -> DataFrame:
    """Persons with distinct nationalities and aliases joined, and any one value of each scalar (the least)."""
    r = F.col("row")
    one = lambda key: F.min(value(r, key))
    return rows.groupBy("id").agg(
        one("personLabel").alias("full_name"), F.substring(one("birth"), 1, 10).alias("birth_date"), one("birthPlace").alias("birth_place"),
        F.array_sort(F.collect_set(value(r, "nationality"))).alias("nationalities"), F.array_sort(F.collect_set(value(r, "alias"))).alias("alias"),
    )
