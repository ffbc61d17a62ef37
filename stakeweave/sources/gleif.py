"""Legal-entity records, their relationships, successions and deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeweave.functions.classify import legal_form_type
from stakeweave.functions.dates import founded_year, full_date, iso_prefix
from stakeweave.functions.names import is_nominee_name, normalize_entity_name, squeeze, strip
from stakeweave.sources.records import as_list, unwrap

_W = "struct<`$`:string>"
_ADDRESS = f"struct<FirstAddressLine:{_W},AdditionalAddressLine:string,City:{_W},PostalCode:{_W},Country:{_W}>"
LEI_SCHEMA = (
    f"LEI {_W}, Entity struct<LegalName:{_W},LegalJurisdiction:{_W},EntityStatus:{_W},EntityCreationDate:{_W},"
    f"LegalForm:struct<EntityLegalFormCode:{_W},OtherLegalForm:{_W}>,LegalAddress:{_ADDRESS},HeadquartersAddress:{_ADDRESS},"
    f"RegistrationAuthority:struct<RegistrationAuthorityID:{_W},RegistrationAuthorityEntityID:{_W}>,SuccessorEntity:string>, "
    f"Registration struct<RegistrationStatus:{_W}>"
)
_NODE = f"struct<NodeID:{_W},NodeIDType:{_W}>"
RR_SCHEMA = (
    f"RelationshipRecord struct<Relationship:struct<StartNode:{_NODE},EndNode:{_NODE},RelationshipType:{_W},RelationshipStatus:{_W},"
    "RelationshipPeriods:struct<RelationshipPeriod:string>>>"
)
# Consolidation types and what they say of directness; the authority whose numbers are company numbers.
CONSOLIDATION = {"IS_DIRECTLY_CONSOLIDATED_BY": "direct", "IS_ULTIMATELY_CONSOLIDATED_BY": "indirect"}
COMPANIES_HOUSE_AUTHORITY = "RA000585"
RECORD_URL = "https://search.gleif.org/#/record/"


def _lines(address: Column) -> Column:
    """All street lines; further lines come as one value or a list of values."""
    more = F.transform(F.coalesce(as_list(address["AdditionalAddressLine"], _W), F.array().cast(f"array<{_W}>")), unwrap)
    return F.filter(F.concat(F.array(unwrap(address["FirstAddressLine"])), more), lambda x: x.isNotNull())


def display_address(address: Column) -> Column:
    parts = F.concat(_lines(address), F.filter(F.array(*[unwrap(address[c]) for c in ("City", "PostalCode", "Country")]), lambda x: x.isNotNull()))
    return F.nullif(F.array_join(parts, ", "), F.lit(""))


def matching_address(address: Column) -> Column:
    """Lower-case words of the legal address; a key, not for display."""
    joined = F.concat_ws(" ", *[unwrap(address[c]) for c in ("FirstAddressLine", "City", "PostalCode", "Country")])
    return F.nullif(strip(squeeze(F.regexp_replace(F.lower(joined), "(?U)[^\\w\\s]", " "))), F.lit(""))


def _country(entity: Column) -> Column:
    code = F.coalesce(unwrap(entity["LegalJurisdiction"]), unwrap(entity["HeadquartersAddress"]["Country"]))
    return F.upper(F.substring(F.get(F.split(code, "-"), F.lit(0)), 1, 2))


def lei_entities(records: DataFrame, source_id: str, credibility: int, forms: DataFrame, authorities: DataFrame) -> DataFrame:
    """Entity rows of records that have an LEI and a name; code tables have ``code, name``, and unknown codes stay."""
    e = F.col("Entity")
    rows = records.select(
        unwrap(F.col("LEI")).alias("lei_id"), unwrap(e["LegalName"]).alias("name"), unwrap(e["LegalForm"]["EntityLegalFormCode"]).alias("_form"),
        unwrap(e["LegalForm"]["OtherLegalForm"]).alias("_other"), unwrap(e["RegistrationAuthority"]["RegistrationAuthorityID"]).alias("_authority"),
        unwrap(e["RegistrationAuthority"]["RegistrationAuthorityEntityID"]).alias("registration_number"), unwrap(e["EntityCreationDate"]).alias("_created"),
        _country(e).alias("country"), matching_address(e["LegalAddress"]).alias("registered_address"), display_address(e["LegalAddress"]).alias("address"),
        unwrap(e["HeadquartersAddress"]["City"]).alias("hq_city"), F.upper(F.substring(unwrap(e["HeadquartersAddress"]["Country"]), 1, 2)).alias("hq_country"),
        display_address(e["HeadquartersAddress"]).alias("hq_address"), unwrap(e["EntityStatus"]).alias("_status"),
        unwrap(F.col("Registration")["RegistrationStatus"]).alias("gleif_registration_status"),
    ).where("lei_id IS NOT NULL AND name IS NOT NULL")
    f, a = (t.select(F.col("code").alias(f"_{k}c"), F.col("name").alias(f"_{k}n")) for k, t in (("f", forms), ("a", authorities)))
    rows = rows.join(f, F.col("_form") == F.col("_fc"), "left").join(a, F.col("_authority") == F.col("_ac"), "left")
    return rows.select(
        F.concat(F.lit("lei:"), "lei_id").alias("id"), "name", normalize_entity_name(F.col("name")).alias("name_normalized"), F.col("name").alias("search_text"),
        F.lit(credibility).alias("name_credibility"), "country", "registered_address", "address", F.coalesce("_fn", "_other", "_form").alias("legal_form"),
        F.coalesce("_an", "_authority").alias("registration_authority"), "registration_number", founded_year(F.col("_created")).alias("founded"),
        full_date(F.col("_created")).alias("founded_date"), "lei_id", F.lit(source_id).alias("source_id"), F.concat(F.lit(RECORD_URL), "lei_id").alias("source_url"),
        is_nominee_name(F.col("name")).alias("is_nominee"), "hq_city", "hq_country", "hq_address",
        F.when(F.col("_authority") == COMPANIES_HOUSE_AUTHORITY, F.col("registration_number")).alias("companies_house_id"),
        legal_form_type(F.col("_other")).alias("type"), (F.coalesce("_status", F.lit("")) != "INACTIVE").alias("active"), "gleif_registration_status",
    )


def successions(records: DataFrame) -> DataFrame:
    """``from_lei, to_lei, from_name, to_name`` of every declared successor; names come from the same records."""
    named = records.select(unwrap(F.col("LEI")).alias("lei"), unwrap(F.col("Entity")["LegalName"]).alias("name")).where("lei IS NOT NULL")
    listed = as_list(F.col("Entity")["SuccessorEntity"], f"struct<SuccessorLEI:{_W}>")
    pairs = records.select(unwrap(F.col("LEI")).alias("from_lei"), F.explode(listed).alias("s")).select("from_lei", unwrap(F.col("s")["SuccessorLEI"]).alias("to_lei"))
    pairs = pairs.where("from_lei IS NOT NULL AND to_lei IS NOT NULL AND from_lei <> to_lei").distinct()
    a, b = (named.groupBy(F.col("lei").alias(f"{k}_lei")).agg(F.min("name").alias(f"{k}_name")) for k in ("from", "to"))
    return pairs.join(a, "from_lei", "left").join(b, "to_lei", "left").select("from_lei", "to_lei", "from_name", "to_name")


def _relationships(records: DataFrame) -> DataFrame:
    rel = F.col("RelationshipRecord")["Relationship"]

    def lei(node: Column) -> Column:
        return F.when(F.coalesce(unwrap(node["NodeIDType"]), F.lit("LEI")) == "LEI", unwrap(node["NodeID"]))

    period = f"struct<PeriodType:{_W},StartDate:{_W},EndDate:{_W}>"
    periods = as_list(rel["RelationshipPeriods"]["RelationshipPeriod"], period)
    wanted = F.get(F.filter(periods, lambda p: unwrap(p["PeriodType"]) == "RELATIONSHIP_PERIOD"), F.lit(0))
    marker = F.element_at(F.create_map(*[F.lit(x) for pair in CONSOLIDATION.items() for x in pair]), unwrap(rel["RelationshipType"]))
    order = [c for c in ("_sequence",) if c in records.columns]
    return records.select(
        *order, lei(rel["EndNode"]).alias("parent_lei"), lei(rel["StartNode"]).alias("child_lei"), marker.alias("direct_or_indirect"),
        unwrap(rel["RelationshipStatus"]).alias("status"), iso_prefix(unwrap(wanted["StartDate"])).alias("since"), iso_prefix(unwrap(wanted["EndDate"])).alias("until"),
    ).where("direct_or_indirect IS NOT NULL AND parent_lei IS NOT NULL AND child_lei IS NOT NULL AND parent_lei <> child_lei")


def owns_edges(records: DataFrame, source_id: str, credibility: int) -> DataFrame:
    """Consolidation edges of active relationships (a missing status counts as active)."""
    rows = _relationships(records).where("status IS NULL OR status = 'ACTIVE'")
    return rows.select(
        *[c for c in ("_sequence",) if c in rows.columns], F.concat_ws("|", "parent_lei", "child_lei", "direct_or_indirect").alias("edge_id"), F.concat(F.lit("lei:"), "parent_lei").alias("from_id"),
        F.concat(F.lit("lei:"), "child_lei").alias("to_id"), "direct_or_indirect", F.lit("controlling").alias("ownership_type"),
        F.array(F.lit("accountingConsolidation")).alias("interest_types"), "since", "until", F.lit(source_id).alias("source_id"),
        F.lit(credibility).alias("credibility_score"), F.concat(F.lit(RECORD_URL), "child_lei").alias("source_url"), F.col("since").alias("source_date"),
    )


def delta_edges(records: DataFrame, source_id: str, credibility: int, today: Column) -> tuple[DataFrame, DataFrame]:
    """Upserts of active relationships, and closures (``from_id, to_id, direct_or_indirect, until``) of inactive ones; other states are ignored."""
    rows = _relationships(records)
    closed = rows.where("status = 'INACTIVE'").select(
        F.concat(F.lit("lei:"), "parent_lei").alias("from_id"), F.concat(F.lit("lei:"), "child_lei").alias("to_id"), "direct_or_indirect",
        F.coalesce("until", today).alias("until"),
    )
    return owns_edges(records, source_id, credibility).withColumn("until", F.lit(None).cast("string")), closed
