"""Queries over register records that are made from the driver's tables: written as JSON, parsed and mapped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeweave.functions import classify, names, similarity
from stakeweave.operators import edges as ed
from stakeweave.operators import moderation as mo
from stakeweave.operators import resolution as rs
from stakeweave.operators import search as se
from stakeweave.operators.claims import upsert_claims, with_claim_key
from stakeweave.operators.tree import checkpoint_folder
from stakeweave.plans.registry import _SHOWN, _driver, query
from stakeweave.sources import filings, gleif, registers, snapshot, wikidata
from stakeweave.streaming.deltas import apply_delta


def _w(column):
    return F.struct(column.cast("string").alias("$"))


def _parsed(rows: DataFrame, schema: str) -> DataFrame:
    """Rows of one JSON text each, parsed with a reader's schema."""
    return rows.select(F.from_json("json", schema).alias("r")).select("r.*")


def _lei_records(spark, sf_dir) -> DataFrame:
    s, n = _driver(spark, sf_dir, "supplier"), _driver(spark, sf_dir, "nation")
    k = F.col("s_suppkey")
    lei = lambda x: F.concat(F.lit("LEI"), F.lpad(x.cast("string"), 17, "0"))
    address = F.struct(
        _w(F.concat(F.lit("Main St. "), k.cast("string"))).alias("FirstAddressLine"), F.array(_w(F.lit("Floor 2")), _w(F.lit(" "))).alias("AdditionalAddressLine"),
        _w(F.col("n_name")).alias("City"), _w(F.lit("E1")).alias("PostalCode"), _w(F.lit("GB")).alias("Country"),
    )
    entity = F.struct(
        _w(F.concat("s_name", F.lit(" Ltd."))).alias("LegalName"), _w(F.when(k % 3 == 0, F.lit("US-DE"))).alias("LegalJurisdiction"),
        _w(F.when(k % 4 == 0, "INACTIVE").otherwise("ACTIVE")).alias("EntityStatus"), _w(F.when(k % 5 != 0, F.concat((k % 30 + 1990).cast("string"), F.lit("-02-03T00:00:00Z")))).alias("EntityCreationDate"),
        F.struct(_w(F.when(k % 2 == 0, F.lit("H0PO"))).alias("EntityLegalFormCode"), _w(F.when(k % 7 == 1, F.lit("Unit Trust"))).alias("OtherLegalForm")).alias("LegalForm"),
        address.alias("LegalAddress"), address.alias("HeadquartersAddress"),
        F.struct(_w(F.when(k % 3 == 1, F.lit("RA000585")).otherwise(F.lit("RA1"))).alias("RegistrationAuthorityID"), _w(F.concat(F.lit("N"), k.cast("string"))).alias("RegistrationAuthorityEntityID"))
        .alias("RegistrationAuthority"),
        F.when(k % 6 == 0, F.array(F.struct(_w(lei(k + 1)).alias("SuccessorLEI")), F.struct(_w(lei(k)).alias("SuccessorLEI")))).alias("SuccessorEntity"),
    )
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.to_json(F.struct(_w(lei(k)).alias("LEI"), entity.alias("Entity"))).alias("json"))
    return _parsed(rows, gleif.LEI_SCHEMA)


@query(
    """SELECT 'lei:LEI' || lpad(CAST(s_suppkey AS STRING), 17, '0') AS id, s_name || ' Ltd.' AS name, lower(s_name) AS name_normalized,
  CASE WHEN s_suppkey % 3 = 0 THEN 'US' ELSE 'GB' END AS country, 'Main St. ' || CAST(s_suppkey AS STRING) || ', Floor 2, ' || n_name || ', E1, GB' AS address,
  'main st ' || CAST(s_suppkey AS STRING) || ' ' || lower(n_name) || ' e1 gb' AS registered_address,
  CASE WHEN s_suppkey % 2 = 0 THEN 'Private Limited Company' WHEN s_suppkey % 7 = 1 THEN 'Unit Trust' END AS legal_form, CASE WHEN s_suppkey % 7 = 1 THEN 'fund' END AS type,
  CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 30 + 1990 AS INT) END AS founded, CASE WHEN s_suppkey % 3 = 1 THEN 'N' || CAST(s_suppkey AS STRING) END AS companies_house_id,
  s_suppkey % 4 <> 0 AS active FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
)
def lei_entities(t, spark, sf_dir):
    forms = spark.createDataFrame([("H0PO", "Private Limited Company")], "code string, name string")
    rows = gleif.lei_entities(_lei_records(spark, sf_dir), "3-MEDIUM", 92, forms, forms.limit(0))
    return rows.select("id", "name", "name_normalized", "country", "address", "registered_address", "legal_form", "type", "founded", "companies_house_id", "active")


@query(
    """SELECT 'LEI' || lpad(CAST(a.s_suppkey AS STRING), 17, '0') AS from_lei, 'LEI' || lpad(CAST(a.s_suppkey + 1 AS STRING), 17, '0') AS to_lei, a.s_name || ' Ltd.' AS from_name,
  b.s_name || ' Ltd.' AS to_name FROM supplier a LEFT JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 WHERE a.s_suppkey % 6 = 0"""
)
def lei_successions(t, spark, sf_dir):
    return gleif.successions(_lei_records(spark, sf_dir))


def _relations(spark, sf_dir) -> DataFrame:
    o = _driver(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    day = F.concat(F.substring(F.col("o_orderdate").cast("string"), 1, 10), F.lit("T00:00:00Z"))
    node = lambda x, kind: F.struct(_w(F.concat(F.lit("L"), x.cast("string"))).alias("NodeID"), _w(kind).alias("NodeIDType"))
    one = F.struct(_w(F.lit("RELATIONSHIP_PERIOD")).alias("PeriodType"), _w(day).alias("StartDate"), _w(F.when(k % 5 == 0, day)).alias("EndDate"))
    other = F.struct(_w(F.lit("ACCOUNTING_PERIOD")).alias("PeriodType"), _w(F.lit("1999-01-01")).alias("StartDate"), _w(F.lit(None)).alias("EndDate"))
    kinds = F.when(k % 3 == 0, "IS_DIRECTLY_CONSOLIDATED_BY").when(k % 3 == 1, "IS_ULTIMATELY_CONSOLIDATED_BY").otherwise("IS_FUND-MANAGED_BY")

    def made(periods):
        rel = F.struct(node(F.col("o_custkey"), F.lit("LEI")).alias("StartNode"), node(k % 50, F.when(k % 11 == 0, F.lit("ISIN")).otherwise(F.lit("LEI"))).alias("EndNode"),
                       _w(kinds).alias("RelationshipType"), _w(F.when(F.col("o_orderstatus") == "F", "INACTIVE").otherwise("ACTIVE")).alias("RelationshipStatus"),
                       F.struct(periods.alias("RelationshipPeriod")).alias("RelationshipPeriods"))
        return F.to_json(F.struct(F.struct(rel.alias("Relationship")).alias("RelationshipRecord")))

    # One period comes as an object in half of the records and in a list in the others.
    return _parsed(o.select(F.when(k % 2 == 0, made(one)).otherwise(made(F.array(other, one))).alias("json")), gleif.RR_SCHEMA)


_RELATIONS = """SELECT 'lei:L' || CAST(o_orderkey % 50 AS STRING) AS from_id, 'lei:L' || CAST(o_custkey AS STRING) AS to_id, CASE o_orderkey % 3 WHEN 0 THEN 'direct' ELSE 'indirect' END
  AS direct_or_indirect, substr(CAST(o_orderdate AS STRING), 1, 10) AS since, CASE WHEN o_orderkey % 5 = 0 THEN substr(CAST(o_orderdate AS STRING), 1, 10) END AS until, o_orderstatus FROM orders
  WHERE o_orderkey % 3 <> 2 AND o_orderkey % 11 <> 0 AND o_orderkey % 50 <> o_custkey"""


@query(f"SELECT from_id, to_id, direct_or_indirect, since, until FROM ({_RELATIONS}) WHERE o_orderstatus <> 'F'")
def relationship_edges(t, spark, sf_dir):
    return gleif.owns_edges(_relations(spark, sf_dir), "3-MEDIUM", 92).select("from_id", "to_id", "direct_or_indirect", "since", "until")


@query(f"SELECT from_id, to_id, direct_or_indirect, COALESCE(until, '2025-01-01') AS until FROM ({_RELATIONS}) WHERE o_orderstatus = 'F'")
def relationship_closures(t, spark, sf_dir):
    return gleif.delta_edges(_relations(spark, sf_dir), "3-MEDIUM", 92, F.lit("2025-01-01"))[1]


@query(
    """WITH base AS (SELECT * FROM owns WHERE edge_id LIKE 'H%'), up AS (SELECT * FROM base WHERE CAST(substr(edge_id, 2) AS BIGINT) % 2 = 0),
shut AS (SELECT * FROM base WHERE CAST(substr(edge_id, 2) AS BIGINT) % 3 = 0)
SELECT b.from_id, b.to_id, b.direct_or_indirect, CASE WHEN s.edge_id IS NOT NULL THEN '2025-02-02' WHEN u.edge_id IS NOT NULL THEN NULL
  WHEN CAST(substr(b.edge_id, 2) AS BIGINT) % 4 = 1 THEN '2020-01-01' END AS until, b.since FROM base b LEFT JOIN up u ON u.edge_id = b.edge_id LEFT JOIN shut s ON s.edge_id = b.edge_id
UNION ALL SELECT 'sup:new', to_id, direct_or_indirect, NULL, '2024-05-05' FROM up WHERE edge_id = 'H2'""",
    "owns",
)
def applied_delta(t, spark, sf_dir):
    """Upserts reopen edges and keep a known start; closures come after them."""
    k = F.substring("edge_id", 2, 10).cast("long")
    base = t("owns").where("edge_id LIKE 'H%'").select("edge_id", "from_id", "to_id", "direct_or_indirect", "since", F.when(k % 4 == 1, "2020-01-01").alias("until"))
    up = base.where(k % 2 == 0).withColumn("since", F.lit("2024-05-05")).withColumn("until", F.lit(None).cast("string"))
    up = up.unionByName(up.where("edge_id = 'H2'").withColumn("from_id", F.lit("sup:new")))
    shut = base.where(k % 3 == 0).select("from_id", "to_id", "direct_or_indirect", F.lit("2025-02-02").alias("until"))
    return apply_delta(base, up, shut).select("from_id", "to_id", "direct_or_indirect", "until", "since")


def _controllers(spark, sf_dir) -> DataFrame:
    c, n = _driver(spark, sf_dir, "customer"), _driver(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    data = F.struct(
        F.when(k % 3 == 0, "corporate-entity-person-with-significant-control").when(k % 7 == 1, "super-secure-person-with-significant-control")
        .otherwise("individual-person-with-significant-control").alias("kind"),
        F.when(k % 2 == 0, F.col("c_name")).alias("name"), F.col("n_name").alias("nationality"), F.lit("2016-04-06").alias("notified_on"), F.when(k % 4 == 0, F.lit("2020-01-01")).alias("ceased_on"),
        F.struct(F.lit("Ann").alias("forename"), F.lit(None).cast("string").alias("middle_name"), F.concat(F.lit("Case"), k.cast("string")).alias("surname")).alias("name_elements"),
        F.struct((k % 40 + 1950).cast("int").alias("year"), F.when(k % 5 != 0, (k % 12 + 1).cast("int")).alias("month")).alias("date_of_birth"),
        F.when(k % 4 == 0, F.array(F.lit("ownership-of-shares-75-to-100-percent"))).when(k % 4 == 1, F.array(F.lit("ownership-of-shares-25-to-50-percent"), F.lit("voting-rights-50-to-75-percent")))
        .when(k % 4 == 2, F.array(F.lit("significant-influence-or-control"))).alias("natures_of_control"),
        F.struct(F.lit(" 5 ").alias("premises"), F.lit("Leeds").alias("locality"), F.lit("England & Wales").alias("country")).alias("address"),
        F.struct(F.when(k % 2 == 0, F.concat(F.lit("R"), k.cast("string"))).alias("registration_number"), F.lit("England").alias("country_registered")).alias("identification"),
        F.struct(F.concat(F.lit("/psc/"), k.cast("string")).alias("self")).alias("links"),
    )
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.to_json(F.struct((k % 97).cast("string").alias("company_number"), data.alias("data"))).alias("json"))
    return registers.control_rows(_parsed(rows, registers.PSC_SCHEMA))


_OWNER = "CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'gb-coh:R' || CAST(c_custkey AS STRING) ELSE 'chpsc:/psc/' || CAST(c_custkey AS STRING) END"


@query(
    f"""SELECT {_OWNER} AS from_id, CASE WHEN c_custkey % 3 = 0 THEN 'entity' ELSE 'person' END AS from_kind, 'gb-coh:' || CAST(c_custkey % 97 AS STRING) AS to_id,
  CAST(CASE c_custkey % 4 WHEN 0 THEN 75 WHEN 1 THEN 25 END AS DOUBLE) AS stake_percent, CAST(CASE c_custkey % 4 WHEN 1 THEN 50 END AS DOUBLE) AS voting_power_pct,
  CASE c_custkey % 4 WHEN 0 THEN 'majority' WHEN 3 THEN 'minority' ELSE 'controlling' END AS ownership_type, CASE WHEN c_custkey % 4 = 0 THEN '2020-01-01' END AS until FROM customer
WHERE c_custkey % 3 = 0 OR c_custkey % 7 <> 1"""
)
def control_edges(t, spark, sf_dir):
    return registers.control_edges(_controllers(spark, sf_dir), "4-NOT SPECIFIED", 85).select(
        "from_id", "from_kind", "to_id", "stake_percent", "voting_power_pct", "ownership_type", "until"
    )


@query(
    """SELECT 'chpsc:/psc/' || CAST(c_custkey AS STRING) AS id, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'Ann' END AS first_name,
  CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Case' || CAST(c_custkey AS STRING) END AS last_name,
  CAST(c_custkey % 40 + 1950 AS STRING) || CASE WHEN c_custkey % 5 <> 0 THEN '-' || lpad(CAST(c_custkey % 12 + 1 AS STRING), 2, '0') ELSE '' END AS birth_date
FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 7 <> 1"""
)
def control_persons(t, spark, sf_dir):
    return registers.control_persons(_controllers(spark, sf_dir)).select("id", "first_name", "last_name", "birth_date")


@query(
    f"""SELECT id, MAX(name) AS name, MAX(city) AS hq_city, MAX(country) AS hq_country FROM (
  SELECT 'gb-coh:' || CAST(c_custkey % 97 AS STRING) AS id, NULL AS name, NULL AS city, NULL AS country FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 7 <> 1
  UNION ALL SELECT {_OWNER}, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Ann Case' || CAST(c_custkey AS STRING) END, 'Leeds', 'GB' FROM customer WHERE c_custkey % 3 = 0) GROUP BY id"""
)
def control_entities(t, spark, sf_dir):
    return registers.control_entities(_controllers(spark, sf_dir), "4-NOT SPECIFIED", 85).select("id", "name", "hq_city", "hq_country")


@query(
    """SELECT 'gb-coh:' || CAST(p_partkey AS STRING) AS id, p_name AS name, p_name || ' ' || p_brand AS search_text, CASE WHEN p_size % 2 = 0 THEN 'nonprofit' ELSE 'company' END AS type,
  CAST(1950 + p_size AS INT) AS founded, CAST(1950 + p_size AS STRING) || '-03-04' AS founded_date, p_type || ', Leeds' AS registered_address FROM part"""
)
def company_updates(t, spark, sf_dir):
    p = _driver(spark, sf_dir, "part")
    rows = p.select(
        F.concat(F.lit(" "), "p_name").alias("CompanyName"), F.col("p_partkey").cast("string").alias("CompanyNumber"), F.when(F.col("p_size") % 2 == 0, "Community Interest Company").alias("CompanyCategory"),
        F.concat(F.lit("4/3/"), (F.col("p_size") + 1950).cast("string")).alias("IncorporationDate"), F.lit("Leeds").alias("RegAddress_PostTown"), F.col("p_type").alias("RegAddress_AddressLine1"),
        F.col("p_brand").alias("PreviousName_1_CompanyName"), F.upper("p_brand").alias("PreviousName_2_CompanyName"), F.upper("p_name").alias("PreviousName_3_CompanyName"),
    )
    return registers.company_updates(rows, 90).select("id", "name", "search_text", "type", "founded", "founded_date", "registered_address")


@query(
    """SELECT company_id, name, position, FALSE AS is_person FROM (SELECT o_custkey % 40 AS company_id, o_orderpriority AS name, o_orderstatus AS position,
  ROW_NUMBER() OVER (PARTITION BY o_custkey % 40, o_orderpriority ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1"""
)
def first_officers(t, spark, sf_dir):
    o = _driver(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("company_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("position"), F.col("o_orderkey").alias("row"))
    return registers.officers(o).select("company_id", "name", "position", "is_person")


@query(
    """SELECT id, name, country, founded, aliases FROM (SELECT 'Q' || CAST(o_custkey AS STRING) AS id, FIRST(o_orderpriority ORDER BY o_orderkey) AS name,
  upper(FIRST(o_orderstatus ORDER BY o_orderkey)) AS country, CAST(substr(CAST(FIRST(o_orderdate ORDER BY o_orderkey) AS STRING), 1, 4) AS INT) AS founded,
  array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS aliases FROM orders GROUP BY o_custkey)"""
)
def wikidata_companies(t, spark, sf_dir):
    o = _driver(spark, sf_dir, "orders")
    v = lambda c: F.struct(F.col(c).cast("string").alias("value"))
    row = F.create_map(F.lit("itemLabel"), v("o_orderpriority"), F.lit("countryCode"), v("o_orderstatus"), F.lit("inception"), v("o_orderdate"), F.lit("alias"), v("o_orderstatus"))
    rows = o.select(F.concat(F.lit("Q"), F.col("o_custkey").cast("string")).alias("id"), F.col("o_orderkey").alias("n"), row.alias("row"))
    return wikidata.company_facts(rows).select("id", "name", "country", "founded", F.array_join("aliases", ",").alias("aliases"))


@query(
    """SELECT 'Q' || CAST(o_custkey AS STRING) AS id, MIN(o_orderpriority) AS full_name, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS nationalities
FROM orders GROUP BY o_custkey"""
)
def wikidata_persons(t, spark, sf_dir):
    v = lambda c: F.struct(F.col(c).cast("string").alias("value"))
    rows = _driver(spark, sf_dir, "orders").select(
        F.concat(F.lit("Q"), F.col("o_custkey").cast("string")).alias("id"), F.create_map(F.lit("personLabel"), v("o_orderpriority"), F.lit("nationality"), v("o_orderstatus")).alias("row")
    )
    return wikidata.person_details(rows).select("id", "full_name", F.array_join("nationalities", ",").alias("nationalities"))


def _holding_filings(spark, sf_dir) -> DataFrame:
    e = _driver(spark, sf_dir, "events")
    k = F.col("event_id")
    percent = F.when(k % 4 == 0, "0.0").when(k % 9 == 0, "n/a").otherwise(F.format_string("%d.5", k % 90))
    xml = F.concat(F.lit('<r xmlns="urn:x"><issuer><issuerCik>'), (F.col("user_id") % 10).cast("string"), F.lit("</issuerCik><issuerName>I</issuerName></issuer><classPercent>"), percent, F.lit("</classPercent></r>"))
    return e.select((F.col("user_id") % 7).cast("string").alias("cik"), F.lpad(k.cast("string"), 9, "0").alias("accession"), F.col("ts").cast("string").substr(1, 10).alias("filed"), xml.alias("xml"))


@query(
    """WITH f AS (SELECT CAST(user_id % 7 AS STRING) AS cik, lpad(CAST(user_id % 10 AS STRING), 10, '0') AS issuer_cik, substr(CAST(ts AS STRING), 1, 10) AS filed, event_id,
  CASE WHEN event_id % 4 = 0 THEN 0.0 WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 90 + 0.5 END AS percent FROM events),
live AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cik, issuer_cik ORDER BY filed DESC, event_id DESC) AS n FROM f WHERE percent > 0) WHERE n = 1)
SELECT l.cik, l.issuer_cik, CAST(l.percent AS DOUBLE) AS stake_percent, l.filed AS since, (SELECT MAX(z.filed) FROM f z WHERE z.cik = l.cik AND z.issuer_cik = l.issuer_cik AND z.percent = 0
  AND z.filed >= l.filed) AS until FROM live l"""
)
def filer_holdings(t, spark, sf_dir):
    rows = filings.latest_holdings(filings.holding_xml(_holding_filings(spark, sf_dir)))
    return rows.select("cik", "issuer_cik", "stake_percent", "since", "until")


@query("SELECT CAST(o_custkey AS STRING) AS cik, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS shares_outstanding FROM orders WHERE o_totalprice > 0 GROUP BY 1")
def shares_outstanding(t, spark, sf_dir):
    o = _driver(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("cik"), F.col("o_orderdate").alias("end"), F.col("o_totalprice").alias("val"), F.col("o_orderkey").alias("filed"))
    return filings.latest_fact(o).select("cik", "shares_outstanding")


@query(
    """SELECT page_id, CAST(0 AS INT) AS "row", 'Owner ' || CAST(page_id AS STRING) AS name, CAST(100000 + page_id AS BIGINT) AS shares, CAST(page_id % 90 + 1.5 AS DOUBLE) AS percent FROM pages
UNION ALL SELECT page_id, 1, 'Jane Roe', 25000, 0.4 FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT page_id, 1, 'Jane Roe', 2500000, 33.1 FROM pages WHERE page_id % 2 = 1"""
)
def proxy_owner_tables(t, spark, sf_dir):
    """Pages with a table inside a layout table and padded columns, or with two share classes and a row for each."""
    p = _driver(spark, sf_dir, "pages")
    k = F.col("page_id")
    row = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    single = F.concat(
        F.lit("<table><tr><td>layout <table>" + row("", "Name of Beneficial Owner", "Shares", "Percent of class") + "<tr><td></td><td>Owner "), k.cast("string"), F.lit(" (1)</td><td>"),
        (k + 100000).cast("string"), F.lit("</td><td>"), (k % 90 + 1).cast("string"), F.lit(".5%</td></tr>" + row("", "Jane Roe 410 Terry Ave N", "25,000 (2)", "*") + row("", "5,000", "7.2%")
              + row("", "Executive Officers:", "", "") + row("", "All directors and executive officers as a group (12 persons)", "90,000", "12.0%") + "</table></td></tr></table>"),
    )
    dual = F.concat(
        F.lit("<table>" + row("Name", "Class", "Class A and B shares", "Voting power") + "<tr><td>Owner "), k.cast("string"), F.lit("</td><td>Class A</td><td>"), (k + 100000).cast("string"), F.lit("</td><td>"),
        (k % 90 + 1).cast("string"), F.lit(".5%</td></tr>" + row("Jane Roe", "Class A", "100,000", "3.0%") + row("", "Class B", "2,500,000", "33.1%", "31.0%")
              + row("All directors and executive officers as a group (9 persons)", "Class A", "9,000,000", "71.0%") + "</table>"),
    )
    table = F.when(k % 2 == 0, single).otherwise(dual)
    return filings.proxy_owners(p.select("page_id", F.concat("html", table).alias("html")), "page_id", "html")


@query()
def ticker_matches(t, spark, sf_dir):
    """Similarity by matching blocks has no SQL form."""
    tickers = _driver(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cik_str"), F.concat("s_name", F.lit(" Holdings, Inc.")).alias("title"))
    return filings.match_tickers(_driver(spark, sf_dir, "supplier").select(F.col("s_name").alias("q")), tickers)


@query()
def name_similarities(t, spark, sf_dir):
    p = _driver(spark, sf_dir, "part")
    return p.select("p_partkey", similarity.ticker_similarity(F.col("p_name"), F.col("p_type")).alias("similarity"), similarity.proxy_similarity(F.col("p_name"), F.lit("red")).alias("proxy"))


# Scalar functions


@query(
    """SELECT o_orderkey, lpad(CAST(o_custkey AS STRING), 10, '0') AS cik, 'Q' || CAST(o_custkey AS STRING) AS qid, CAST(o_custkey % 90 + 0.5 AS DOUBLE) AS lat,
  'https://www.sec.gov/Archives/edgar/data/' || CAST(o_custkey AS STRING) || '/' || lpad(CAST(o_orderkey AS STRING), 10, '0') || '20' || '1' || '/' || lpad(CAST(o_orderkey AS STRING), 10, '0') || '-20-1-index.htm' AS url,
  lpad(CAST(o_orderkey AS STRING), 10, '0') AS filer FROM orders"""
)
def identifier_forms(t, spark, sf_dir):
    c, k = F.col("o_custkey").cast("string"), F.col("o_orderkey")
    accession = F.concat(F.lpad(k.cast("string"), 10, "0"), F.lit("-20-1"))
    point = names.parse_point(F.concat(F.lit("Point(8.25 "), (F.col("o_custkey") % 90).cast("string"), F.lit(".5)")))
    return _driver(spark, sf_dir, "orders").select(
        "o_orderkey", names.normalize_cik(F.concat(F.lit(" #"), c)).alias("cik"), names.qid(F.concat(F.lit("http://www.wikidata.org/entity/Q"), c, F.lit("/"))).alias("qid"),
        point["lat"].alias("lat"), names.filing_index_url(c, accession).alias("url"), names.cik_from_accession(accession).alias("filer"),
    )


@query(
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'CEO' WHEN 1 THEN 'CFO' WHEN 2 THEN 'General Counsel' WHEN 3 THEN 'Chairman' WHEN 4 THEN 'President' ELSE 'Vice President' END AS role,
  CASE o_orderkey % 4 WHEN 0 THEN 'foundation' WHEN 1 THEN 'fund' WHEN 2 THEN 'nonprofit' END AS form_type, o_orderkey % 3 = 0 AS is_nominee, o_orderkey % 2 = 0 AS is_person,
  CASE o_orderkey % 3 WHEN 0 THEN 'fund' WHEN 1 THEN 'government' ELSE 'company' END AS class_type FROM orders"""
)
def classified_texts(t, spark, sf_dir):
    k = F.col("o_orderkey")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    title = pick("Chief Executive Officer", "CFO", "General Counsel and Secretary", "Chairman", "President and Director", "Vice President")
    classes = F.when(k % 3 == 0, F.array(F.lit("Q327333"), F.lit("Q791974"))).when(k % 3 == 1, F.array(F.lit("Q327333"))).otherwise(F.array(F.lit("Q1")))
    return _driver(spark, sf_dir, "orders").select(
        "o_orderkey", names.title_to_role(title).alias("role"), classify.legal_form_type(pick("Private Stiftung", "Unit Trust", "e.V.", "GmbH")).alias("form_type"),
        names.is_nominee_name(pick("Cede & Co", "Acme", "Acme Cedeco")).alias("is_nominee"), names.is_person_name(pick("Ann Lee Case", "Acme Fund Case")).alias("is_person"),
        classify.infer_entity_type(classes).alias("class_type"),
    )


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) END AS percent, o_orderkey % 2 = 0 AS is_individual,
  CASE o_orderkey % 3 WHEN 0 THEN 0.4 WHEN 1 THEN CAST(o_orderkey % 50 AS DOUBLE) END AS cell, ROUND(o_custkey * 100.0 / 4096, 4) AS stake FROM orders"""
)
def filing_texts(t, spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("<p>PERCENT OF CLASS&nbsp;REPRESENTED by amount in row 11  "), (k % 100).cast("string"), F.lit("%</p> type of reporting person: "), F.when(k % 2 == 0, "IN").otherwise("CO"))
    cell = F.when(k % 3 == 0, F.lit("*")).when(k % 3 == 1, F.concat((k % 50).cast("string"), F.lit("% (2)"))).otherwise(F.lit("—"))
    return _driver(spark, sf_dir, "orders").select(
        "o_orderkey", classify.percent_from_text(text).alias("percent"), classify.reporter_is_individual(text).alias("is_individual"), classify.parse_percent_cell(cell).alias("cell"),
        classify.stake_from_shares(F.col("o_custkey"), F.lit(4096)).alias("stake"),
    )


@query(
    """SELECT o_orderkey, 'Larry C' || CAST(o_custkey AS STRING) || '|C' || CAST(o_custkey AS STRING) || ' Larry|Lawrence C' || CAST(o_custkey AS STRING) || '|C' || CAST(o_custkey AS STRING) || ' Lawrence' AS variants,
  'The Acme ' || CAST(o_custkey AS STRING) || ', Inc.|Acme ' || CAST(o_custkey AS STRING) || ', Inc.|The Acme ' || CAST(o_custkey AS STRING) || ' Inc|Acme ' || CAST(o_custkey AS STRING) || ' Inc' AS entity_variants,
  'Timothy D C' || CAST(o_custkey AS STRING) AS sec_name, o_orderkey % 2 = 0 AS reordered FROM orders"""
)
def name_variants(t, spark, sf_dir):
    c = F.col("o_custkey").cast("string")
    name = F.concat(F.lit("Larry C"), c)
    return _driver(spark, sf_dir, "orders").select(
        "o_orderkey", F.array_join(names.person_name_variants(name), "|").alias("variants"),
        F.array_join(names.entity_name_variants(F.concat(F.lit("The Acme "), c, F.lit(", Inc."))), "|").alias("entity_variants"),
        names.normalize_sec_name(F.concat(F.lit("C"), c, F.lit(" TIMOTHY D"))).alias("sec_name"),
        names.is_reordering(name, F.concat(F.lit("C"), c, F.when(F.col("o_orderkey") % 2 == 0, F.lit(" Larry")).otherwise(F.lit(" Lars")))).alias("reordered"),
    )


# Stores


@query(
    """SELECT kind, from_id, to_id, source_id, MIN(seen_at) AS first_seen_at, MAX(seen_at) AS last_seen_at, arg_max(stake_percent, (seen_at, source_url, stake_percent)) AS stake_percent
FROM claim GROUP BY kind, from_id, to_id, source_id""",
    "claim",
)
def upserted_claims(t, spark, sf_dir):
    rows = with_claim_key(t("claim").withColumn("last_seen_at", F.col("seen_at")).withColumn("first_seen_at", F.col("seen_at")).drop("seen_at"))
    got = upsert_claims(rows.limit(0), rows.drop("first_seen_at"))
    return got.select("kind", "from_id", "to_id", "source_id", "first_seen_at", "last_seen_at", "stake_percent")


@query(
    """WITH k AS (SELECT id, FIRST_VALUE(id) OVER (PARTITION BY lei_id ORDER BY COALESCE(name_credibility, 0) DESC, CASE WHEN verified THEN 0 ELSE 1 END, id) AS keep FROM entity WHERE lei_id <> ''),
m AS (SELECT e.*, COALESCE(k.keep, e.id) AS keep FROM entity e LEFT JOIN k ON k.id = e.id)
SELECT keep AS id, MAX(CASE WHEN id = keep THEN name END) AS name, MAX(COALESCE(name_credibility, 0)) AS name_credibility, BOOL_OR(verified) AS verified,
  FIRST(sec_cik ORDER BY CASE WHEN id = keep THEN 0 ELSE 1 END, id) FILTER (sec_cik <> '') AS sec_cik,
  FIRST(wikidata_id ORDER BY CASE WHEN id = keep THEN 0 ELSE 1 END, id) FILTER (wikidata_id <> '') AS wikidata_id FROM m GROUP BY keep""",
    "entity",
)
def merged_entities(t, spark, sf_dir):
    e = t("entity")
    plan = rs.merge_plan(e, spark.createDataFrame([], "a string, b string"), ("lei_id",))
    return rs.merge_entities(e, plan).select("id", "name", "name_credibility", "verified", "sec_cik", "wikidata_id")


@query("SELECT 'entities' AS kind, COUNT(*) AS n FROM entity UNION ALL SELECT 'persons', COUNT(*) FROM person UNION ALL SELECT 'owns', COUNT(*) FROM owns", "entity", "person", "owns")
def snapshot_counts(t, spark, sf_dir):
    return snapshot.snapshot_counts(t("entity"), t("person"), t("owns"))


@query(
    """SELECT f.id, CASE WHEN f.status = 'open' AND f.target_kind = 'owns' AND EXISTS (SELECT 1 FROM flag g WHERE g.category = 'error' AND g.status = 'open' AND g.target_kind = 'owns'
  AND g.from_id = f.from_id AND g.to_id = f.to_id) THEN 'resolved' ELSE f.status END AS status FROM flag f""",
    "flag",
)
def resolved_flags(t, spark, sf_dir):
    flags = t("flag")
    chosen = flags.where("category = 'error' AND status = 'open' AND target_kind = 'owns'")
    return mo.suppress(t("suppression").limit(0), flags, t("owns"), chosen)[1].select("id", "status")


@query(
    """SELECT edge_id FROM owns o WHERE NOT (until IS NULL AND EXISTS (SELECT 1 FROM flag g WHERE g.category = 'error' AND g.status = 'open' AND g.from_id = o.from_id AND g.to_id = o.to_id))""",
    "owns", "flag",
)
def edges_after_suppression(t, spark, sf_dir):
    chosen = t("flag").where("category = 'error' AND status = 'open' AND target_kind = 'owns'")
    return mo.suppress(t("suppression").limit(0), t("flag"), t("owns"), chosen)[2].select("edge_id")


@query(
    """SELECT COALESCE(p.from_id, n.from_id) AS from_id, COALESCE(p.to_id, n.to_id) AS to_id, COALESCE(n.stake_percent, p.stake_percent) AS stake_percent,
  COALESCE(n.ownership_type, p.ownership_type) AS ownership_type FROM pin p FULL JOIN (SELECT from_id, to_id, CASE WHEN edge_id LIKE '%1' THEN 12.5 END AS stake_percent, 'minority' AS ownership_type
  FROM owns WHERE edge_id LIKE 'H%') n ON n.from_id = p.from_id AND n.to_id = p.to_id""",
    "pin", "owns",
)
def upserted_pins(t, spark, sf_dir):
    new = t("owns").where("edge_id LIKE 'H%'").select("from_id", "to_id", F.when(F.col("edge_id").like("%1"), 12.5).alias("stake_percent"), F.lit("minority").alias("ownership_type"))
    return mo.upsert_pins(t("pin"), new)


@query(
    """WITH hit AS (SELECT o.* FROM owns o JOIN entity e ON (e.id = o.from_id OR e.id = o.to_id) WHERE e.name = 'red widget'), rest AS (SELECT * FROM owns WHERE edge_id NOT IN (SELECT edge_id FROM hit))
SELECT id FROM entity e WHERE name <> 'red widget' AND NOT (EXISTS (SELECT 1 FROM hit WHERE hit.from_id = e.id OR hit.to_id = e.id)
  AND NOT EXISTS (SELECT 1 FROM rest WHERE rest.from_id = e.id OR rest.to_id = e.id))""",
    "owns", "entity",
)
def purged_entities(t, spark, sf_dir):
    from stakeweave.operators.maintenance import purge_company

    return purge_company(t("entity"), t("owns"), t("person"), "red widget")[0].select("id")


@query(
    r"""WITH q AS (SELECT * FROM (VALUES ('q1', 'red'), ('q1', 'widget')) AS v(query_id, token)), idx AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(name), '[\p{L}\p{M}\p{N}_]+')) AS token FROM entity),
hits AS (SELECT id, COUNT(*) AS h FROM q JOIN idx USING (token) GROUP BY id), staged AS (
  SELECT id, 0 AS stage, ROW_NUMBER() OVER (ORDER BY id) AS place FROM entity WHERE name = 'red widget' QUALIFY place <= 10
  UNION ALL SELECT id, 1, ROW_NUMBER() OVER (ORDER BY h DESC, id) AS place FROM hits JOIN entity USING (id) WHERE wikidata_id IS NOT NULL QUALIFY place <= 15
  UNION ALL SELECT id, 2, ROW_NUMBER() OVER (ORDER BY h DESC, id) AS place FROM hits QUALIFY place <= 30),
ranked AS (SELECT s.id, e.name, CASE WHEN e.name = 'red widget' THEN 0 ELSE 1 END AS inexact, (CASE WHEN contains(e.name, 'red') THEN 1 ELSE 0 END) + (CASE WHEN contains(e.name, 'widget') THEN 1 ELSE 0 END) AS hits,
  CASE WHEN e.name = 'red widget' THEN 0 WHEN starts_with(e.name, 'red widget') THEN 1 WHEN contains(e.name, 'red widget') THEN 2 ELSE 3 END AS tier,
  CASE WHEN wikidata_id IS NOT NULL THEN 0 ELSE 1 END AS plain, length(e.name) AS len, s.stage, s.place FROM staged s JOIN entity e USING (id)),
once AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY inexact, hits DESC, tier, plain, CASE WHEN tier <= 2 THEN len ELSE 0 END, stage, place, id) AS n FROM ranked)
SELECT 'q1' AS query_id, CAST(ROW_NUMBER() OVER (ORDER BY inexact, hits DESC, tier, plain, CASE WHEN tier <= 2 THEN len ELSE 0 END, stage, place, id) AS INT) AS position, id, name FROM once WHERE n = 1
QUALIFY position <= 20""",
    "entity",
)
def ranked_search(t, spark, sf_dir):
    e = t("entity").withColumn("name_normalized", F.col("name"))
    q = spark.createDataFrame([("q1", "red widget", None, "red widget")], "query_id string, q string, country string, nn string")
    found = se.entity_candidates(e, se.token_index(e, "id", "name"), q)
    return se.rank(found, e.select("id", "name", "name_normalized", "wikidata_id"), q.select("query_id", "q", "nn")).select("query_id", "position", "id", "name")


@query(
    """SELECT keep_id, keep_name, dup_name, MIN(dup_id) AS dup_id, CAST(COUNT(*) AS INT) AS count FROM (SELECT k.id AS dup_id, k.keep AS keep_id, a.name AS keep_name, b.name AS dup_name FROM (
  SELECT id, FIRST_VALUE(id) OVER (PARTITION BY lei_id ORDER BY COALESCE(name_credibility, 0) DESC, CASE WHEN verified THEN 0 ELSE 1 END, id) AS keep FROM entity WHERE lei_id <> '') k
  JOIN entity a ON a.id = k.keep JOIN entity b ON b.id = k.id WHERE k.id <> k.keep) GROUP BY 1, 2, 3""",
    "entity",
)
def merge_log(t, spark, sf_dir):
    e = t("entity")
    plan = rs.merge_plan(e, spark.createDataFrame([], "a string, b string"), ("lei_id",))
    rows = rs.merge_log_rows(plan, e, F.lit("2024-01-01"))
    return rows.orderBy(F.desc("at"), "keep_id", "dup_name").select("keep_id", "keep_name", "dup_name", "dup_id", "count")


@query(
    """SELECT kind, a, b FROM not_duplicate UNION SELECT 'entity', x.id, y.id FROM (SELECT id, wikidata_id FROM entity WHERE wikidata_id <> '') x JOIN (SELECT id, wikidata_id FROM entity) y
  ON x.wikidata_id = y.wikidata_id AND x.id < y.id""",
    "not_duplicate", "entity",
)
def separated_pairs(t, spark, sf_dir):
    groups = t("entity").where("wikidata_id <> ''").select(F.col("wikidata_id").alias("group"), "id")
    return rs.keep_separate(t("not_duplicate"), groups, "entity", F.lit("2024-02-02")).select("kind", "a", "b")


@query("SELECT to_id, COUNT(*) AS n, COUNT(*) FILTER (until IS NULL) AS active FROM owns WHERE from_id <> to_id GROUP BY to_id", "owns")
def edge_totals(t, spark, sf_dir):
    rows = ed.without_self_loops(t("owns"))
    return rows.groupBy("to_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(ed.is_active(), 1)).alias("active"))



@query(
    """SELECT q, cik, MIN(id) AS id FROM (SELECT e.name || ' ' || e.country AS q, '1' AS cik, s.id, length(s.name) AS n, MAX(length(s.name)) OVER (PARTITION BY e.name || ' ' || e.country) AS m
  FROM (SELECT DISTINCT name, country FROM entity) e JOIN entity s ON starts_with(e.name || ' ' || e.country, s.name || ' ') AND length(s.name) >= 4 AND s.sec_cik IS NULL)
WHERE n = m GROUP BY q, cik""",
    "entity",
)
def prefix_matches(t, spark, sf_dir):
    from stakeweave.operators.matching import prefix_match

    e = t("entity")
    asked = e.select(F.concat_ws(" ", "name", "country").alias("q"), F.lit("1").alias("cik")).distinct()
    return prefix_match(asked, e.select("id", "name", "sec_cik"))


@query(
    """SELECT o.edge_id, CASE WHEN o.until IS NULL AND o.from_id LIKE 'sup:%' AND e.name IS NOT NULL AND o.to_id <> o.from_id AND NOT EXISTS (SELECT 1 FROM owns x WHERE x.until IS NULL
  AND x.from_id = o.from_id AND x.to_id = o.to_id AND x.edge_id < o.edge_id) THEN 33.0::DOUBLE END AS voting_power_pct FROM owns o LEFT JOIN entity e ON e.id = o.from_id""",
    "owns", "entity",
)
def voting_power(t, spark, sf_dir):
    from stakeweave.operators.matching import write_voting_power

    e, o = t("entity"), t("owns").withColumn("voting_power_pct", F.lit(None).cast("double"))
    listed = ed.without_self_loops(o.where("until IS NULL")).join(e.select(F.col("id").alias("from_id"), "name"), "from_id")
    listed = listed.select(F.col("to_id").alias("company_id"), F.concat("name", F.lit(".")).alias("name"), F.lit(33.0).alias("percent")).distinct()
    return write_voting_power(listed, e, o)[0].select("edge_id", "voting_power_pct")


@query(
    """WITH RECURSIVE kids AS (SELECT from_id, to_id FROM (SELECT from_id, to_id, ROW_NUMBER() OVER (PARTITION BY from_id ORDER BY to_id) AS n FROM (SELECT DISTINCT from_id, to_id FROM owns)) WHERE n <= 3),
walk(id, level) AS (SELECT 'sup:0', 0 UNION SELECT k.to_id, w.level + 1 FROM walk w JOIN kids k ON k.from_id = w.id WHERE w.level < 3)
SELECT id, CAST(MIN(level) AS INT) AS level FROM walk GROUP BY id""",
    "owns",
)
def capped_expansion(t, spark, sf_dir):
    from stakeweave.operators.matching import expand

    return expand(spark.createDataFrame([("sup:0",)], "id string"), t("owns"), 3, 3)


@query("SELECT edge_id, COALESCE(until, CASE WHEN source_id = '5-LOW' AND from_id LIKE 'sup:%' THEN '2030-01-01' END) AS until FROM owns", "owns")
def closed_edges(t, spark, sf_dir):
    from stakeweave.operators.upsert import close

    o = t("owns")
    return close(o, o.where("source_id = '5-LOW' AND from_id LIKE 'sup:%'").select("edge_id", F.lit("2030-01-01").alias("until")), ["edge_id"]).select("edge_id", "until")


@query("SELECT id FROM entity WHERE id NOT LIKE 'par:%7' UNION ALL SELECT 'made:1'", "entity")
def created_and_deleted(t, spark, sf_dir):
    from stakeweave.operators.upsert import create, delete

    e = t("entity").select("id", "name")
    made = create(e, spark.createDataFrame([("made:1", "M"), ("sup:0", "again")], e.schema), ["id"])
    return delete(made, e.where("id LIKE 'par:%7'"), ["id"]).select("id")



@query(
    f"""WITH {_SHOWN}, o AS (SELECT to_id AS id, COUNT(*) AS n, ROUND(SUM(stake_percent), 4) AS pct FROM owner GROUP BY 1), s AS (SELECT from_id AS id, COUNT(*) AS n FROM owner GROUP BY 1),
x AS (SELECT a.to_id AS id, COUNT(*) AS n FROM owner a JOIN owner b ON a.from_id = b.to_id AND a.to_id = b.from_id GROUP BY 1),
r AS (SELECT from_id AS id, COUNT(*) AS n FROM succeeded_by WHERE to_id NOT IN (SELECT node_id FROM hidden) GROUP BY 1)
SELECT e.id, e.name, LEAST(COALESCE(o.n, 0), 200) AS owners, o.pct AS disclosed_pct, LEAST(COALESCE(s.n, 0), 200) AS subsidiaries, COALESCE(x.n, 0) AS cross_holdings,
  COALESCE(r.n, 0) AS successors FROM entity e LEFT JOIN o USING (id) LEFT JOIN s USING (id) LEFT JOIN x USING (id) LEFT JOIN r USING (id)
WHERE e.id NOT IN (SELECT node_id FROM hidden)""",
    "owns", "suppression", "pin", "entity", "succeeded_by",
)
def entity_profiles(t, spark, sf_dir):
    """Nested profiles, flattened to the sizes of their sections."""
    from stakeweave.operators.profile import entity_profiles as profiles

    rows = profiles(t("entity"), t("owns"), t("has_role"), t("dual_listed_with"), t("succeeded_by"), t("suppression"), t("pin"))
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long").alias(c)
    return rows.select(
        "id", "entity.name", size("owners"), F.col("ownership.disclosed_pct").alias("disclosed_pct"), size("subsidiaries"), size("cross_holdings"),
        F.when(F.col("succeeded_by").isNull(), 0).otherwise(F.size("succeeded_by")).cast("long").alias("successors"),
    )


@query(
    """WITH hidden AS (SELECT node_id FROM suppression WHERE target_kind = 'node'), pos AS (SELECT from_id AS id, COUNT(DISTINCT r.to_id || '|' || r.role) AS n FROM has_role r JOIN entity e ON e.id = r.to_id
  WHERE r.until IS NULL AND r.to_id NOT IN (SELECT node_id FROM hidden) AND r.from_id NOT IN (SELECT node_id FROM hidden) AND NOT EXISTS (SELECT 1 FROM suppression s WHERE s.target_kind = 'role'
  AND s.from_id = r.from_id AND s.to_id = r.to_id AND (s.role IS NULL OR s.role = r.role)) GROUP BY 1),
held AS (SELECT o.from_id AS id, COUNT(DISTINCT o.to_id) AS n FROM owns o JOIN entity e ON e.id = o.to_id WHERE o.until IS NULL AND NOT EXISTS (SELECT 1 FROM suppression s WHERE s.target_kind = 'owns'
  AND s.from_id = o.from_id AND s.to_id = o.to_id) AND o.to_id NOT IN (SELECT node_id FROM hidden) AND o.from_id NOT IN (SELECT node_id FROM hidden) GROUP BY 1)
SELECT p.id, p.full_name, COALESCE(pos.n, 0) AS positions, COALESCE(held.n, 0) AS holdings FROM person p LEFT JOIN pos USING (id) LEFT JOIN held USING (id)
WHERE p.id NOT IN (SELECT node_id FROM hidden)""",
    "person", "has_role", "owns", "entity", "suppression",
)
def person_profiles(t, spark, sf_dir):
    from stakeweave.operators.profile import person_profiles as profiles

    rows = profiles(t("person"), t("entity"), t("owns"), t("has_role"), t("suppression"), t("pin"))
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long").alias(c)
    return rows.select("id", "person.full_name", size("positions"), size("holdings"))


# Streams


def _stream_folder(spark) -> str:
    """A folder of its own below the checkpoint folder, which driver and executors share."""
    import uuid

    return f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"


@query()
def streamed_lockouts(t, spark, sf_dir):
    """Attempts of every user through the stateful limiter with escalating lockouts; state has no SQL form."""
    from stakeweave.streaming.limits import rate_limit

    events = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet(f"{sf_dir}/events.parquet*")
    keyed = events.select(F.col("user_id").cast("string").alias("key"), (F.unix_micros("ts") / 1e6).alias("ts"))
    folder = _stream_folder(spark)
    out = rate_limit(keyed, 2).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query(
    """SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY 1, 2"""
)
def streamed_hourly_counts(t, spark, sf_dir):
    """Hourly counts of events in complete mode: the micro-batch form of a report over event time."""
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet(f"{sf_dir}/events.parquet*")
    hourly = events.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    folder = _stream_folder(spark)

    def put(batch, number):
        batch.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", "total").write.mode("overwrite").parquet(f"{folder}/out")

    out = hourly.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{folder}/state")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")
