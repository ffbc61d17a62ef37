"""Company registers: persons with significant control, basic company data, officer lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stakeweave.functions.classify import company_type, control
from stakeweave.functions.dates import day_first_to_iso, partial_birth_date
from stakeweave.functions.names import blank_to_null, is_nominee_name, is_person_name, normalize_entity_name, split_full_name, strip

PSC_SCHEMA = (
    "company_number string, data struct<kind:string,name:string,nationality:string,notified_on:string,ceased_on:string,"
    "name_elements:struct<forename:string,middle_name:string,surname:string>,date_of_birth:struct<year:int,month:int>,natures_of_control:array<string>,"
    "address:struct<premises:string,address_line_1:string,address_line_2:string,locality:string,region:string,postal_code:string,country:string>,"
    "identification:struct<registration_number:string,country_registered:string>,links:struct<self:string>>"
)
# Kinds of controllers.
PERSON_KINDS = ("individual-person-with-significant-control", "individual-beneficial-owner")
ENTITY_KINDS = ("corporate-entity-person-with-significant-control", "legal-person-person-with-significant-control")
# Parts of the United Kingdom as address countries.
UK_PARTS = "england|wales|scotland|northern ireland|united kingdom|great britain"
CONTROL_URL = "https://find-and-update.company-information.service.gov.uk/company/"


def _iso2(name: Column, named: Column) -> Column:
    """Parts of the United Kingdom, then the code of a known name, then two letters as they are."""
    n = F.lower(strip(name))
    return F.when(n.isin("uk", "gb") | n.rlike(UK_PARTS), "GB").otherwise(F.coalesce(named, F.when(F.length(n) == 2, F.upper(n))))


def control_rows(records: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Accepted records with names, ids and control; records without a company, a known kind or a name are dropped.

    ``codes`` (``code, name``) tells the codes of countries; without it only two-letter countries and the United Kingdom have one.
    """
    country = F.lower(strip(F.col("data.address.country")))
    if codes is None:
        records = records.withColumn("_code", F.lit(None).cast("string"))
    else:
        table = codes.groupBy(F.lower(F.trim("name")).alias("_name")).agg(F.min("code").alias("_code"))
        records = records.join(table, country == F.col("_name"), "left")
    d = F.col("data")
    parts = F.concat_ws(" ", *[F.nullif(d["name_elements"][c], F.lit("")) for c in ("forename", "middle_name", "surname")])
    number = blank_to_null(d["identification"]["registration_number"])
    registered = F.lower(F.coalesce(d["identification"]["country_registered"], F.lit("")))
    british = registered.rlike("england|wales|scotland|united kingdom") | registered.isin("uk", "gb")
    link = F.concat(F.lit("chpsc:"), F.coalesce(strip(d["links"]["self"]), F.lit("")))
    person = d["kind"].isin(*PERSON_KINDS)
    own_number = F.when(british & ~person, number)
    address = F.nullif(
        F.concat_ws(", ", *[blank_to_null(d["address"][c]) for c in ("premises", "address_line_1", "address_line_2", "locality", "region", "postal_code", "country")]),
        F.lit(""),
    )
    rows = records.where(d["kind"].isin(*PERSON_KINDS, *ENTITY_KINDS)).select(
        blank_to_null(F.col("company_number")).alias("company_number"), person.alias("is_person"), F.coalesce(blank_to_null(d["name"]), blank_to_null(parts)).alias("name"),
        F.coalesce(F.concat(F.lit("gb-coh:"), own_number), link).alias("owner_id"), own_number.alias("owner_number"), control(d["natures_of_control"]).alias("c"),
        F.nullif(d["notified_on"], F.lit("")).alias("since"), F.nullif(d["ceased_on"], F.lit("")).alias("until"), d["nationality"].alias("nationality"),
        partial_birth_date(d["date_of_birth"]["year"], d["date_of_birth"]["month"]).alias("birth_date"), d["identification"]["country_registered"].alias("country"),
        address.alias("address"), blank_to_null(d["address"]["locality"]).alias("city"), _iso2(d["address"]["country"], F.col("_code")).alias("address_country"),
    )
    return rows.where("company_number IS NOT NULL AND name IS NOT NULL")


def control_persons(rows: DataFrame) -> DataFrame:
    name = split_full_name(F.col("name"))
    people = rows.where("is_person").select(
        F.col("owner_id").alias("id"), name["first"].alias("first_name"), name["last"].alias("last_name"), F.col("name").alias("full_name"),
        F.col("name").alias("search_text"), F.coalesce("nationality", F.lit("")).alias("nationality"), "birth_date",
    )
    return _first_record(people)


def _first_record(rows: DataFrame) -> DataFrame:
    """One row for each id: the first of its records, named ones before others, with its gaps filled from those that follow."""
    rest = [c for c in rows.columns if c != "id"]
    named = "name" if "name" in rest else "full_name"
    order = F.struct(F.col(named).isNull(), *rest)
    return rows.groupBy("id").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in rest])


def control_entities(rows: DataFrame, source_id: str, credibility: int) -> DataFrame:
    """Controlled companies by number alone, and controlling entities with what their records say."""
    missing = F.lit(None).cast("string")
    owned = rows.select(F.concat(F.lit("gb-coh:"), "company_number").alias("id"), F.col("company_number").alias("companies_house_id"), missing.alias("name"),
                        missing.alias("country"), missing.alias("registered_address"), missing.alias("hq_city"), missing.alias("hq_country"))
    owners = rows.where("NOT is_person").select(
        F.col("owner_id").alias("id"), F.col("owner_number").alias("companies_house_id"), "name", "country", F.col("address").alias("registered_address"),
        F.col("city").alias("hq_city"), F.col("address_country").alias("hq_country"),
    )
    both = owned.unionByName(owners)
    return _first_record(both).select(
        "*", normalize_entity_name(F.col("name")).alias("name_normalized"), is_nominee_name(F.col("name")).alias("is_nominee"),
        F.lit(source_id).alias("source_id"), F.lit(credibility).alias("name_credibility"),
    )


def control_edges(rows: DataFrame, source_id: str, credibility: int) -> DataFrame:
    return rows.select(
        F.sha1(F.concat_ws("|", "owner_id", "company_number", F.coalesce("since", F.lit("")))).alias("edge_id"), F.col("owner_id").alias("from_id"),
        F.when(F.col("is_person"), "person").otherwise("entity").alias("from_kind"), F.concat(F.lit("gb-coh:"), "company_number").alias("to_id"),
        F.col("c.stake").alias("stake_percent"), F.col("c.voting").alias("voting_power_pct"), F.col("c.ownership_type").alias("ownership_type"),
        F.col("c.interest_types").alias("interest_types"), "since", "until", F.lit(source_id).alias("source_id"), F.lit(credibility).alias("credibility_score"),
        F.concat(F.lit(CONTROL_URL), "company_number", F.lit("/persons-with-significant-control")).alias("source_url"), F.col("since").alias("source_date"),
    )


# Address columns in display order.
ADDRESS_COLUMNS = ("CareOf", "POBox", "AddressLine1", "AddressLine2", "PostTown", "County", "Country", "PostCode")


def read_company_csv(spark: SparkSession, path: str) -> DataFrame:
    """The CSV with trimmed header names; quoted fields may hold line breaks."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.toDF(*[c.strip().replace(".", "_") for c in raw.columns])


def company_updates(rows: DataFrame, credibility: int) -> DataFrame:
    """Updates for companies that exist; they are never added from this file."""
    has = lambda c: blank_to_null(F.col(c)) if c in rows.columns else F.lit(None).cast("string")
    name = has("CompanyName")
    former = F.filter(F.array(*[has(f"PreviousName_{k}_CompanyName") for k in range(1, 11)]), lambda x: x.isNotNull() & (F.lower(x) != F.lower(name)))
    low = F.transform(former, F.lower)
    aliases = F.filter(former, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
    address = F.nullif(F.concat_ws(", ", *[has(f"RegAddress_{c}") for c in ADDRESS_COLUMNS]), F.lit(""))
    founded = day_first_to_iso(has("IncorporationDate"))
    return rows.where(has("CompanyNumber").isNotNull() & name.isNotNull()).select(
        F.concat(F.lit("gb-coh:"), has("CompanyNumber")).alias("id"), name.alias("name"), normalize_entity_name(name).alias("name_normalized"),
        F.concat_ws(" ", name, aliases).alias("search_text"), company_type(has("CompanyCategory")).alias("type"), F.lit("GB").alias("country"),
        has("RegAddress_PostTown").alias("hq_city"), F.lit("GB").alias("hq_country"), F.substring(founded, 1, 4).try_cast("int").alias("founded"),
        founded.alias("founded_date"), address.alias("registered_address"), address.alias("hq_address"), has("CompanyNumber").alias("companies_house_id"),
        aliases.alias("aliases"), is_nominee_name(name).alias("is_nominee"), F.lit(credibility).alias("name_credibility"),
    )


def officers(rows: DataFrame) -> DataFrame:
    """Officers (``name, position, start_date, end_date``), the first row of each name, told apart as persons or entities."""
    order = Window.partitionBy("company_id", "name").orderBy("row")
    first = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "row")
    return first.withColumn("is_person", is_person_name(F.col("name")))
