"""Queries by name, each with oracle SQL where SQL can express it.

A query is ``(spark, sf_dir) -> DataFrame`` over the graph tables of ``fixture``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stakeweave.functions import classify, dates, hashing, names
from stakeweave.operators import claims as cl
from stakeweave.operators import edges as ed
from stakeweave.operators import maintenance as mt
from stakeweave.operators import moderation as mo
from stakeweave.operators import persons as pe
from stakeweave.operators import resolution as rs
from stakeweave.operators import search as se
from stakeweave.operators import tree as tr
from stakeweave.operators.upsert import update_only, upsert, upsert_edges
from stakeweave.plans.fixture import graph_table, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *tables: str):
    """Register a function ``(t, spark, sf_dir)``; ``t(name)`` gives a graph table."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: graph_table(spark, sf_dir, name), spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = with_tables(sql, *tables) if tables else sql
        return f

    return add


def _driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The state that a profile shows: active, no self loops, suppressions out, pins in, largest stake per owner.
_SHOWN = """
hidden AS (SELECT node_id FROM suppression WHERE target_kind = 'node'),
shown AS (
  SELECT o.edge_id, o.from_id, o.to_id, o.since, COALESCE(p.stake_percent, o.stake_percent) AS stake_percent
  FROM owns o LEFT JOIN pin p ON o.from_id = p.from_id AND o.to_id = p.to_id
  WHERE o.until IS NULL AND o.from_id <> o.to_id
    AND NOT EXISTS (SELECT 1 FROM suppression s WHERE s.target_kind = 'owns' AND s.from_id = o.from_id AND s.to_id = o.to_id)
    AND o.from_id NOT IN (SELECT node_id FROM hidden) AND o.to_id NOT IN (SELECT node_id FROM hidden)),
owner AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY from_id, to_id
  ORDER BY COALESCE(NULLIF(stake_percent, 0), -1) DESC, edge_id) AS n FROM shown) WHERE n = 1)"""
_GRAPH = ("owns", "suppression", "pin")


def _owners(t) -> DataFrame:
    return ed.current_owners(t("owns"), t("suppression"), t("pin"))


@query(
    f"""WITH {_SHOWN}, g AS (SELECT to_id, ROUND(SUM(stake_percent), 4) AS disclosed_pct,
  CAST(SUM(CASE WHEN stake_percent IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unknown_owners, COUNT(*) AS n_owners FROM owner GROUP BY to_id)
SELECT to_id AS entity_id, disclosed_pct, CASE WHEN unknown_owners = 0 AND disclosed_pct <= 100.5 AND ROUND(100 - disclosed_pct, 4) >= 0.5
  THEN ROUND(100 - disclosed_pct, 4) END AS free_float_pct, unknown_owners, COALESCE(disclosed_pct > 100.5, FALSE) AS exceeds_100, n_owners FROM g""",
    *_GRAPH,
)
def ownership_summary(t, spark, sf_dir):
    return ed.ownership_summary(_owners(t))


@query(f"WITH {_SHOWN} SELECT to_id AS entity_id, from_id AS owner_id, stake_percent, since, edge_id FROM owner", *_GRAPH)
def current_owners(t, spark, sf_dir):
    return _owners(t).select(F.col("to_id").alias("entity_id"), F.col("from_id").alias("owner_id"), "stake_percent", "since", "edge_id")


@query(f"WITH {_SHOWN} SELECT a.to_id AS entity_id, a.from_id AS other_id FROM owner a JOIN owner b ON a.from_id = b.to_id AND a.to_id = b.from_id", *_GRAPH)
def profile_cross_holdings(t, spark, sf_dir):
    return ed.profile_cross_holdings(_owners(t))


@query(
    """SELECT to_id AS entity_id, from_id AS owner_id, edge_id, truncated FROM (
  SELECT *, COUNT(*) OVER (PARTITION BY to_id) > 5 AS truncated, ROW_NUMBER() OVER (PARTITION BY to_id ORDER BY edge_id) AS n FROM owns WHERE until IS NULL) x
WHERE n <= 5 AND NOT EXISTS (SELECT 1 FROM suppression s WHERE s.target_kind = 'owns' AND s.from_id = x.from_id AND s.to_id = x.to_id)""",
    "owns", "suppression",
)
def owners_limited(t, spark, sf_dir):
    """The limit comes before suppression, so fewer may return."""
    rows = ed.limited(t("owns").where(ed.is_active()), "to_id", [F.col("edge_id")], 5)
    return ed.drop_suppressed(rows, t("suppression"), "owns").select(F.col("to_id").alias("entity_id"), F.col("from_id").alias("owner_id"), "edge_id", "truncated")


@query(
    """SELECT from_id, to_id, edge_id, stake_percent FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY from_id, to_id
  ORDER BY COALESCE(stake_percent, -1) DESC, CASE WHEN direct_or_indirect IS NULL THEN 1 ELSE 0 END, edge_id) AS n FROM owns WHERE until IS NULL) WHERE n = 1""",
    "owns",
)
def owns_dedup(t, spark, sf_dir):
    return ed.dedup_owns(t("owns")).select("from_id", "to_id", "edge_id", "stake_percent")


@query(
    """SELECT CAST(SUM(n) AS BIGINT) AS active_edges, COUNT(*) AS distinct_pairs, CAST(SUM(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_pairs,
  CAST(SUM(n - 1) AS BIGINT) AS redundant_edges FROM (SELECT from_id, to_id, COUNT(*) AS n FROM owns WHERE until IS NULL GROUP BY 1, 2)""",
    "owns",
)
def owns_duplicate_stats(t, spark, sf_dir):
    return ed.duplicate_owns_stats(t("owns"))


@query("SELECT a.from_id AS a, a.to_id AS b, a.edge_id AS edge_ab, b.edge_id AS edge_ba FROM owns a JOIN owns b ON a.from_id = b.to_id AND a.to_id = b.from_id WHERE a.from_id < a.to_id", "owns")
def cross_holdings(t, spark, sf_dir):
    return ed.cross_holdings(t("owns"))


@query("SELECT COUNT(*) AS self_loops FROM owns WHERE from_id = to_id", "owns")
def self_loop_count(t, spark, sf_dir):
    return ed.self_loops(t("owns")).agg(F.count(F.lit(1)).alias("self_loops"))


@query(
    """SELECT e.id, CAST(COALESCE(o.n, 0) AS BIGINT) AS owners, CAST(COALESCE(s.n, 0) AS BIGINT) AS subsidiaries, CAST(COALESCE(x.n, 0) AS BIGINT) AS executives,
  CAST(COALESCE(d.n, 0) AS BIGINT) AS dual_listed, CAST(COALESCE(f.n, 0) AS BIGINT) AS succeeded_by, CAST(COALESCE(r.n, 0) AS BIGINT) AS replaces
FROM entity e LEFT JOIN (SELECT to_id, COUNT(DISTINCT from_id) AS n FROM owns WHERE until IS NULL GROUP BY 1) o ON e.id = o.to_id
LEFT JOIN (SELECT from_id, COUNT(DISTINCT to_id) AS n FROM owns WHERE until IS NULL GROUP BY 1) s ON e.id = s.from_id
LEFT JOIN (SELECT to_id, COUNT(DISTINCT from_id) AS n FROM has_role WHERE until IS NULL GROUP BY 1) x ON e.id = x.to_id
LEFT JOIN (SELECT from_id, COUNT(DISTINCT to_id) AS n FROM dual_listed_with GROUP BY 1) d ON e.id = d.from_id
LEFT JOIN (SELECT from_id, COUNT(DISTINCT to_id) AS n FROM succeeded_by GROUP BY 1) f ON e.id = f.from_id
LEFT JOIN (SELECT to_id, COUNT(DISTINCT from_id) AS n FROM succeeded_by GROUP BY 1) r ON e.id = r.to_id""",
    "entity", "owns", "has_role", "dual_listed_with", "succeeded_by",
)
def section_counts(t, spark, sf_dir):
    return ed.section_counts(t("entity"), t("owns"), t("has_role"), t("dual_listed_with"), t("succeeded_by"))


@query(
    """SELECT from_id AS entity_id, to_id AS subsidiary_id, n_edges, best_stake FROM (SELECT from_id, to_id, COUNT(*) AS n_edges, MAX(stake_percent) AS best_stake,
  ROW_NUMBER() OVER (PARTITION BY from_id ORDER BY to_id) AS n FROM owns WHERE until IS NULL GROUP BY from_id, to_id) WHERE n <= 10""",
    "owns",
)
def subsidiaries_grouped(t, spark, sf_dir):
    """Edges collected per neighbour first, so the limit counts neighbours."""
    rows = ed.edges_by_neighbour(t("owns").where(ed.is_active()), "from_id", "to_id", 10)
    return rows.select(
        F.col("from_id").alias("entity_id"), F.col("to_id").alias("subsidiary_id"), F.size("rels").cast("long").alias("n_edges"),
        F.array_max(F.transform("rels", lambda r: r["stake_percent"])).alias("best_stake"),
    )


_TREE = """WITH RECURSIVE tree(root_id, node_id, depth, path) AS (
  SELECT from_id, to_id, 1, [edge_id] FROM owns WHERE from_id = 'sup:0' {filter}
  UNION ALL SELECT t.root_id, o.to_id, t.depth + 1, list_append(t.path, o.edge_id) FROM tree t JOIN owns o ON o.from_id = t.node_id
  WHERE t.depth < 3 AND NOT list_contains(t.path, o.edge_id) {filter2})
SELECT root_id, node_id, CAST(depth AS INT) AS depth, array_to_string(path, '>') AS path FROM tree"""


def _tree(t, spark, include_indirect):
    found = tr.ownership_tree(t("owns"), spark.createDataFrame([("sup:0",)], "id string"), 3, include_indirect)
    return found.select("root_id", "node_id", F.col("depth").cast("int").alias("depth"), F.array_join("edge_path", ">").alias("path"))


@query(
    _TREE.format(filter="AND COALESCE(direct_or_indirect, '') <> 'indirect'", filter2="AND COALESCE(o.direct_or_indirect, '') <> 'indirect'"), "owns"
)
def ownership_tree(t, spark, sf_dir):
    return _tree(t, spark, False)


@query(_TREE.format(filter="", filter2=""), "owns")
def ownership_tree_with_indirect(t, spark, sf_dir):
    return _tree(t, spark, True)


@query(
    """WITH RECURSIVE h AS (SELECT from_id, to_id FROM owns WHERE edge_id LIKE 'H%'),
down(seed, id) AS (SELECT id, id FROM (VALUES ('sup:1'), ('sup:5')) AS v(id) UNION SELECT d.seed, h.to_id FROM down d JOIN h ON h.from_id = d.id),
up(seed, id) AS (SELECT id, id FROM (VALUES ('sup:1'), ('sup:5')) AS v(id) UNION SELECT u.seed, h.from_id FROM up u JOIN h ON h.to_id = u.id)
SELECT seed, id FROM down UNION SELECT seed, id FROM up""",
    "owns",
)
def family_closure(t, spark, sf_dir):
    seeds = spark.createDataFrame([("sup:1",), ("sup:5",)], "id string")
    return tr.family(t("owns").where(F.col("edge_id").startswith("H")), seeds)


@query(
    """WITH RECURSIVE ids AS (SELECT old_id AS id FROM merged_id UNION ALL SELECT 'sup:0' UNION ALL SELECT 'nobody'),
walk(id, place, hops) AS (SELECT id, id, 0 FROM ids UNION ALL SELECT w.id, m.new_id, w.hops + 1 FROM walk w JOIN merged_id m ON m.old_id = w.place
  WHERE w.hops < 5 AND w.place NOT IN (SELECT id FROM entity))
SELECT i.id, MIN(e.id) AS current_id FROM ids i LEFT JOIN walk w ON w.id = i.id LEFT JOIN entity e ON e.id = w.place GROUP BY i.id""",
    "merged_id", "entity",
)
def forwarding_ids(t, spark, sf_dir):
    ids = t("merged_id").select(F.col("old_id").alias("id")).unionByName(spark.createDataFrame([("sup:0",), ("nobody",)], "id string"))
    return tr.resolve_forwarding(t("merged_id"), t("entity"), ids)


@query(
    """SELECT entity_id, kind, party_id, since, until, stake_percent, role, until IS NULL AS active FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id, kind ORDER BY edge_id) AS n FROM (
    SELECT to_id AS entity_id, 'ownership_in' AS kind, from_id AS party_id, since, until, stake_percent, CAST(NULL AS STRING) AS role, edge_id FROM owns
    UNION ALL SELECT from_id, 'ownership_out', to_id, since, until, stake_percent, NULL, edge_id FROM owns
    UNION ALL SELECT to_id, 'role', from_id, since, until, NULL, role, edge_id FROM has_role)) WHERE n <= 20""",
    "owns", "has_role",
)
def ownership_history(t, spark, sf_dir):
    return ed.history(t("owns"), t("has_role"), 20).select("entity_id", "kind", "party_id", "since", "until", "stake_percent", "role", "active")


_ROLES = """WITH hidden AS (SELECT node_id FROM suppression WHERE target_kind = 'node'),
held AS (SELECT r.* FROM has_role r WHERE r.until IS NULL AND NOT EXISTS (SELECT 1 FROM suppression s WHERE s.target_kind = 'role' AND s.from_id = r.from_id
  AND s.to_id = r.to_id AND (s.role IS NULL OR s.role = r.role)) AND r.to_id NOT IN (SELECT node_id FROM hidden) AND r.from_id NOT IN (SELECT node_id FROM hidden))
"""


@query(
    _ROLES + """SELECT x.from_id AS person_id, x.to_id AS entity_id, e.name AS entity_name, x.role, x.since FROM (SELECT *, ROW_NUMBER() OVER (
  PARTITION BY from_id, to_id, role ORDER BY COALESCE(since, '') DESC, edge_id) AS n FROM held) x JOIN entity e ON e.id = x.to_id WHERE n = 1""",
    "has_role", "suppression", "entity",
)
def person_positions(t, spark, sf_dir):
    rows = ed.person_positions(t("has_role"), t("entity"), t("suppression"))
    return rows.select(F.col("from_id").alias("person_id"), F.col("to_id").alias("entity_id"), "entity_name", "role", "since")


@query(
    _ROLES + """SELECT to_id AS entity_id, from_id AS person_id, role, since, edge_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY to_id, from_id, role ORDER BY edge_id) AS n
  FROM held) WHERE n = 1""",
    "has_role", "suppression",
)
def entity_executives(t, spark, sf_dir):
    return ed.executives(t("has_role"), t("suppression")).select(F.col("to_id").alias("entity_id"), F.col("from_id").alias("person_id"), "role", "since", "edge_id")


@query(
    """WITH hidden AS (SELECT node_id FROM suppression WHERE target_kind = 'node'), best AS (SELECT * FROM (SELECT o.*, ROW_NUMBER() OVER (PARTITION BY from_id, to_id
  ORDER BY COALESCE(NULLIF(stake_percent, 0), -1) DESC, edge_id) AS n FROM owns o WHERE until IS NULL
  AND NOT EXISTS (SELECT 1 FROM suppression s WHERE s.target_kind = 'owns' AND s.from_id = o.from_id AND s.to_id = o.to_id)
  AND to_id NOT IN (SELECT node_id FROM hidden) AND from_id NOT IN (SELECT node_id FROM hidden)) WHERE n = 1)
SELECT b.from_id AS person_id, b.to_id AS entity_id, e.name AS entity_name, COALESCE(p.stake_percent, b.stake_percent) AS stake_percent FROM best b
JOIN entity e ON e.id = b.to_id LEFT JOIN pin p ON p.from_id = b.from_id AND p.to_id = b.to_id""",
    "owns", "entity", "suppression", "pin",
)
def person_holdings(t, spark, sf_dir):
    rows = ed.person_holdings(t("owns"), t("entity"), t("suppression"), t("pin"))
    return rows.select(F.col("from_id").alias("person_id"), F.col("to_id").alias("entity_id"), "entity_name", "stake_percent")


@query(
    """SELECT to_id, from_id FROM (SELECT to_id, from_id, ROW_NUMBER() OVER (PARTITION BY to_id ORDER BY from_id) AS n FROM (SELECT DISTINCT from_id, to_id FROM has_role r
  WHERE NOT EXISTS (SELECT 1 FROM claim c WHERE c.from_id = r.from_id AND c.to_id = r.to_id AND c.source_id = '1-URGENT'))) WHERE n <= 15""",
    "has_role", "claim",
)
def role_without_stake(t, spark, sf_dir):
    return ed.role_without_stake(t("has_role"), t("claim").where("source_id = '1-URGENT'")).select("to_id", "from_id")


@query(
    """SELECT to_id, from_id, role, since FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY to_id ORDER BY CASE WHEN until IS NULL THEN 0 ELSE 1 END,
  COALESCE(since, '') DESC, edge_id) AS n FROM has_role WHERE role = 'CEO') WHERE n <= 3""",
    "has_role",
)
def chief_executives(t, spark, sf_dir):
    return ed.current_first(t("has_role").where("role = 'CEO'"), "to_id").select("to_id", "from_id", "role", "since")


@query("SELECT from_id, to_id FROM succeeded_by UNION SELECT to_id, from_id FROM succeeded_by", "succeeded_by")
def symmetric_edges(t, spark, sf_dir):
    return ed.make_symmetric(t("succeeded_by"))


@query(
    """SELECT s.from_id AS entity_id, s.to_id AS successor_id, e.name AS successor_name, s.since FROM succeeded_by s JOIN entity e ON e.id = s.to_id
WHERE s.to_id NOT IN (SELECT node_id FROM suppression WHERE target_kind = 'node')""",
    "succeeded_by", "entity", "suppression",
)
def succession_rows(t, spark, sf_dir):
    rows = ed.drop_hidden_nodes(t("succeeded_by"), t("suppression"), "to_id").join(t("entity").select(F.col("id").alias("to_id"), "name"), "to_id")
    return rows.select(F.col("from_id").alias("entity_id"), F.col("to_id").alias("successor_id"), F.col("name").alias("successor_name"), "since")


# Listings and rollups


@query("SELECT country, COUNT(*) AS n FROM entity WHERE country IS NOT NULL AND country <> '' GROUP BY country", "entity")
def country_rollup(t, spark, sf_dir):
    return t("entity").where("country IS NOT NULL AND country <> ''").groupBy("country").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "country")


@query("SELECT id, name FROM entity WHERE country = 'ECONOMY' ORDER BY name, id LIMIT 200", "entity")
def entities_of_country(t, spark, sf_dir):
    return t("entity").where("country = 'ECONOMY'").orderBy("name", "id").limit(200).select("id", "name")


@query("SELECT id, name, country FROM entity WHERE country = 'NATION_3'", "entity")
def geographic_search(t, spark, sf_dir):
    return t("entity").where("country = 'NATION_3'").select("id", "name", "country").orderBy("name", "id")


@query("SELECT id, name FROM entity ORDER BY id LIMIT 50 OFFSET 20", "entity")
def entity_page(t, spark, sf_dir):
    return t("entity").select("id", "name").orderBy("id").offset(20).limit(50)


@query("SELECT id, name, credibility_score FROM source ORDER BY credibility_score DESC LIMIT 3 OFFSET 1", "source")
def source_page(t, spark, sf_dir):
    return t("source").select("id", "name", "credibility_score").orderBy(F.col("credibility_score").desc(), "id").offset(1).limit(3)


@query(
    """SELECT 'companies' AS kind, COUNT(*) AS n FROM entity UNION ALL SELECT 'people', COUNT(*) FROM person UNION ALL SELECT 'relationships', COUNT(*) FROM owns
UNION ALL SELECT 'sources', COUNT(*) FROM source""",
    "entity", "person", "owns", "source",
)
def type_counts(t, spark, sf_dir):
    parts = [t(n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, n in (("companies", "entity"), ("people", "person"), ("relationships", "owns"), ("sources", "source"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT DISTINCT country FROM entity", "entity")
def distinct_countries(t, spark, sf_dir):
    return t("entity").select("country").distinct()


@query("SELECT id, name FROM entity WHERE id LIKE 'sup:1%'", "entity")
def prefix_filter(t, spark, sf_dir):
    return t("entity").where(F.col("id").startswith("sup:1")).select("id", "name")


# Claims and provenance


@query(
    """SELECT from_id, to_id, source_id, stake_percent, source_date, source_url FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY from_id, to_id
  ORDER BY COALESCE(credibility_score, 0) DESC, COALESCE(source_date, '') DESC, source_url) AS n FROM claim) WHERE n = 1""",
    "claim",
)
def best_claim(t, spark, sf_dir):
    return cl.best_claim(t("claim"), "from_id", "to_id").select("from_id", "to_id", "source_id", "stake_percent", "source_date", "source_url")


@query(
    """SELECT kind, from_id, to_id, source_id, sha1(CAST(length(kind) AS STRING) || ':' || kind || '|' || CAST(length(from_id) AS STRING) || ':' || from_id || '|' ||
  CAST(length(to_id) AS STRING) || ':' || to_id || '|' || CAST(length(source_id) AS STRING) || ':' || source_id) AS claim_key, MIN(seen_at) AS first_seen_at,
  MAX(seen_at) AS last_seen_at, COUNT(*) AS n FROM claim GROUP BY kind, from_id, to_id, source_id""",
    "claim",
)
def claim_identity(t, spark, sf_dir):
    rows = cl.with_claim_key(t("claim"))
    return rows.groupBy("kind", "from_id", "to_id", "source_id", "claim_key").agg(
        F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"), F.count(F.lit(1)).alias("n")
    )


@query("SELECT from_id, source_id, stake_percent, source_date, source_url FROM claim WHERE to_id = 'sup:3' AND kind = 'owns'", "claim")
def claims_for_entity(t, spark, sf_dir):
    return cl.claims_for(t("claim"), to_id="sup:3", kind="owns").select("from_id", "source_id", "stake_percent", "source_date", "source_url")


_OWN = """WITH ids AS (SELECT id AS entity_id, 'Wikidata' AS name, 'https://www.wikidata.org/wiki/' || wikidata_id AS source_url FROM entity WHERE wikidata_id <> ''
  UNION ALL SELECT id, 'SEC EDGAR', 'https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK=' || sec_cik FROM entity WHERE sec_cik <> ''
  UNION ALL SELECT id, 'GLEIF', 'https://search.gleif.org/#/record/' || lei_id FROM entity WHERE lei_id <> ''
  UNION ALL SELECT id, 'UK PSC', 'https://find-and-update.company-information.service.gov.uk/company/' || companies_house_id FROM entity WHERE companies_house_id <> ''),
linked AS (SELECT i.entity_id, s.id AS source_id, s.name, s.credibility_score, i.source_url FROM ids i JOIN source s ON s.name = i.name),
own AS (SELECT * FROM linked UNION ALL SELECT e.id, s.id, s.name, s.credibility_score, NULL FROM entity e JOIN source s ON s.id = e.source_id
  WHERE e.id NOT IN (SELECT entity_id FROM linked))
"""


@query(_OWN + "SELECT entity_id, source_id, name, credibility_score, source_url FROM own", "entity", "source")
def own_record_sources(t, spark, sf_dir):
    return cl.own_record_sources(t("entity"), t("source")).select("entity_id", "source_id", "name", "credibility_score", "source_url")


@query(
    _OWN + """, rows_ AS (SELECT c.to_id AS entity_id, s.id AS source_id, s.name, s.credibility_score, c.source_url, c.source_date FROM claim c JOIN source s ON s.id = c.source_id
  UNION ALL SELECT entity_id, source_id, name, credibility_score, source_url, NULL FROM own)
SELECT entity_id, source_id, name, credibility_score, source_url, MAX(source_date) AS source_date FROM rows_ GROUP BY 1, 2, 3, 4, 5""",
    "entity", "source", "claim",
)
def entity_provenance(t, spark, sf_dir):
    rows = cl.entity_provenance(t("claim").withColumnRenamed("seen_at", "last_seen_at"), t("entity"), t("source"))
    return rows.select("entity_id", "source_id", "name", "credibility_score", "source_url", "source_date")


@query(
    """SELECT DISTINCT x.from_id AS person_id, s.id AS source_id, s.name, s.credibility_score FROM (SELECT from_id, source_id FROM owns UNION ALL SELECT from_id, source_id FROM has_role) x
JOIN source s ON s.id = x.source_id""",
    "owns", "has_role", "source",
)
def person_provenance(t, spark, sf_dir):
    return cl.person_provenance(t("owns"), t("has_role"), t("source")).select("person_id", "source_id", "name", "credibility_score")


# Resolution


@query(
    """SELECT name, n, CASE WHEN lei OR coh OR cik OR qid THEN 'definitive' WHEN addr THEN 'high' WHEN nc = 1 AND nf = 1 THEN 'medium' ELSE 'low' END AS confidence FROM (
  SELECT name, COUNT(*) AS n, COUNT(lei_id) >= 2 AND COUNT(DISTINCT lei_id) < COUNT(lei_id) AS lei, COUNT(companies_house_id) >= 2 AND
    COUNT(DISTINCT companies_house_id) < COUNT(companies_house_id) AS coh, COUNT(sec_cik) >= 2 AND COUNT(DISTINCT sec_cik) < COUNT(sec_cik) AS cik,
    COUNT(wikidata_id) >= 2 AND COUNT(DISTINCT wikidata_id) < COUNT(wikidata_id) AS qid,
    COUNT(registered_address) >= 2 AND COUNT(DISTINCT registered_address) < COUNT(registered_address) AS addr, COUNT(DISTINCT country) AS nc, COUNT(DISTINCT founded) AS nf
  FROM entity GROUP BY name) WHERE n > 1""",
    "entity",
)
def duplicate_names(t, spark, sf_dir):
    return rs.duplicate_names(t("entity"), "name")


@query(
    "SELECT COUNT(*) AS duplicate_name_groups, CAST(SUM(n - 1) AS BIGINT) AS redundant_nodes FROM (SELECT name, COUNT(*) AS n FROM entity GROUP BY name) WHERE n > 1", "entity"
)
def duplicate_name_totals(t, spark, sf_dir):
    return rs.duplicate_name_totals(t("entity"), "name")


_DUP_IDS = " UNION ALL ".join(
    f"SELECT '{c}' AS id_kind, {c} AS value, COUNT(*) AS n, MIN(id) AS keep_id FROM entity WHERE {c} <> '' GROUP BY {c} HAVING COUNT(*) > 1" for c in rs.HARD_IDS
)


@query(_DUP_IDS, "entity")
def duplicate_identifiers(t, spark, sf_dir):
    return rs.duplicate_ids(t("entity"))


@query("SELECT id, keep_id FROM (SELECT id, MIN(id) OVER (PARTITION BY wikidata_id) AS keep_id FROM entity WHERE wikidata_id <> '') WHERE id <> keep_id", "entity")
def bulk_delete_plan(t, spark, sf_dir):
    return rs.bulk_delete_plan(t("entity"), "wikidata_id")


@query(
    """WITH ranked AS (SELECT id, lei_id, FIRST_VALUE(id) OVER (PARTITION BY lei_id ORDER BY COALESCE(name_credibility, 0) DESC, CASE WHEN verified THEN 0 ELSE 1 END, id) AS keep_id
  FROM entity WHERE lei_id <> '')
SELECT id AS dup_id, keep_id, 'lei_id' AS reason FROM ranked r WHERE id <> keep_id AND NOT EXISTS (SELECT 1 FROM not_duplicate n
  WHERE (n.a = r.id AND n.b = r.keep_id) OR (n.a = r.keep_id AND n.b = r.id))""",
    "entity", "not_duplicate",
)
def lei_merge_plan(t, spark, sf_dir):
    return rs.merge_plan(t("entity"), t("not_duplicate"), ("lei_id",)).select("dup_id", "keep_id", "reason")


@query(
    """WITH plan AS (SELECT * FROM (SELECT id, FIRST_VALUE(id) OVER (PARTITION BY lei_id ORDER BY COALESCE(name_credibility, 0) DESC, CASE WHEN verified THEN 0 ELSE 1 END, id) AS keep_id
  FROM entity WHERE lei_id <> '') WHERE id <> keep_id),
moved AS (SELECT o.edge_id, COALESCE(f.keep_id, o.from_id) AS from_id, COALESCE(g.keep_id, o.to_id) AS to_id, o.until, o.stake_percent, f.id IS NOT NULL OR g.id IS NOT NULL AS moved
  FROM owns o LEFT JOIN plan f ON f.id = o.from_id LEFT JOIN plan g ON g.id = o.to_id)
SELECT edge_id, from_id, to_id, stake_percent FROM moved WHERE NOT (moved AND from_id = to_id)""",
    "entity", "owns",
)
def merged_edges(t, spark, sf_dir):
    plan = rs.merge_plan(t("entity"), spark.createDataFrame([], "a string, b string"), ("lei_id",))
    return rs.rewrite_endpoints(t("owns"), plan).select("edge_id", "from_id", "to_id", "stake_percent")


@query(
    """SELECT c.id AS key, COALESCE(q.id, s.id, l.id, h.id) AS entity_id, CASE WHEN q.id IS NOT NULL THEN 'wikidata_id' WHEN s.id IS NOT NULL THEN 'sec_cik'
  WHEN l.id IS NOT NULL THEN 'lei_id' WHEN h.id IS NOT NULL THEN 'companies_house_id' END AS matched_on FROM entity c
LEFT JOIN (SELECT wikidata_id AS v, MIN(id) AS id FROM entity WHERE wikidata_id <> '' GROUP BY 1) q ON q.v = c.wikidata_id
LEFT JOIN (SELECT sec_cik AS v, MIN(id) AS id FROM entity WHERE sec_cik <> '' GROUP BY 1) s ON s.v = c.sec_cik
LEFT JOIN (SELECT lei_id AS v, MIN(id) AS id FROM entity WHERE lei_id <> '' GROUP BY 1) l ON l.v = c.lei_id
LEFT JOIN (SELECT companies_house_id AS v, MIN(id) AS id FROM entity WHERE companies_house_id <> '' GROUP BY 1) h ON h.v = c.companies_house_id""",
    "entity",
)
def resolve_identifiers(t, spark, sf_dir):
    e = t("entity")
    found = e.select(F.col("id").alias("key"), "wikidata_id", "sec_cik", "lei_id", "companies_house_id")
    return rs.resolve_by_identifier(found, e.drop("name"), "key")


@query(
    """SELECT n.a, x.name AS a_name, n.b, y.name AS b_name, n.at FROM not_duplicate n JOIN entity x ON x.id = n.a JOIN entity y ON y.id = n.b WHERE n.kind = 'entity'
ORDER BY n.at DESC, n.a, n.b LIMIT 100""",
    "not_duplicate", "entity",
)
def kept_separate(t, spark, sf_dir):
    return rs.kept_separate_listing(t("not_duplicate"), t("entity"), "entity")


@query(
    """WITH left_ AS (SELECT * FROM owns WHERE source_id <> '3-MEDIUM')
SELECT e.id FROM entity e WHERE COALESCE(e.source_id, '') <> '3-MEDIUM' OR EXISTS (SELECT 1 FROM left_ l WHERE l.from_id = e.id OR l.to_id = e.id)
  OR EXISTS (SELECT 1 FROM has_role r WHERE r.source_id <> '3-MEDIUM' AND (r.from_id = e.id OR r.to_id = e.id))""",
    "owns", "entity", "has_role",
)
def wipe_source_nodes(t, spark, sf_dir):
    return rs.wipe_source(t("owns"), t("entity"), [t("has_role")], "3-MEDIUM")[1].select("id")


@query(
    """WITH p AS (SELECT id, full_name, birth_place FROM person) SELECT birth_place, COUNT(*) AS n FROM p WHERE birth_place <> '' GROUP BY birth_place HAVING COUNT(*) > 1""",
    "person",
)
def shared_birth_places(t, spark, sf_dir):
    return t("person").where("birth_place <> ''").groupBy("birth_place").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(
    """WITH p AS (SELECT id, ['Bob', 'Robert', 'Larry', 'Laurence', 'Ann'][k % 5 + 1] AS given, k % 97 AS s, CASE WHEN k % 11 = 0 THEN '1970-01-01' END AS birth,
  regexp_replace(lower(birth_place), '[^a-z0-9]', '', 'g') AS place, k % 13 = 0 AS notable FROM (SELECT *, CAST(regexp_extract(full_name, '([0-9]+)$', 1) AS BIGINT) AS k FROM person)),
links AS (SELECT from_id AS id, to_id AS e FROM has_role WHERE from_id IN (SELECT id FROM p) UNION SELECT to_id, from_id FROM has_role WHERE to_id IN (SELECT id FROM p)),
member AS (SELECT 0 AS stage, birth || '|' || place AS key, id FROM p WHERE birth <> '' AND place <> '' UNION ALL SELECT 1, given || ' ' || CAST(s AS STRING), id FROM p),
-- Of these given names only nicknames and common stems are compatible.
pair AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.s = b.s AND a.id < b.id AND a.given <> b.given AND (CASE WHEN a.given IN ('Bob', 'Robert') THEN 1 WHEN a.given = 'Ann' THEN 3 ELSE 2 END)
  = (CASE WHEN b.given IN ('Bob', 'Robert') THEN 1 WHEN b.given = 'Ann' THEN 3 ELSE 2 END) JOIN links x ON x.id = a.id JOIN links y ON y.id = b.id AND y.e = x.e),
sets AS (SELECT stage, string_agg(id, ',' ORDER BY id) AS members FROM member GROUP BY stage, key HAVING COUNT(*) > 1 UNION ALL SELECT 2, a || ',' || b FROM pair),
one AS (SELECT members, MIN(stage) AS stage FROM sets GROUP BY members),
rows AS (SELECT members, stage, unnest(string_split(members, ',')) AS id FROM one),
deg AS (SELECT id, COUNT(*) AS n FROM links GROUP BY id),
shared AS (SELECT DISTINCT members FROM (SELECT members, e FROM rows JOIN links USING (id) GROUP BY members, e HAVING COUNT(*) > 1)),
facts AS (SELECT members, MIN(stage) AS stage, COUNT(birth) > 1 AND MIN(birth) = MAX(birth) AS same, first(id ORDER BY NOT notable, COALESCE(n, 0) DESC, length(given) + length(CAST(s AS STRING)), id) AS keep_id
  FROM rows JOIN p USING (id) LEFT JOIN deg USING (id) GROUP BY members)
SELECT f.members, CASE WHEN stage = 2 THEN CASE WHEN same THEN 'high' ELSE 'medium' END WHEN s.members IS NOT NULL OR same THEN 'high' ELSE 'low' END AS confidence, FALSE AS likely_distinct,
  CASE stage WHEN 0 THEN 'same birth date + place' WHEN 1 THEN 'same name/alias (order/spelling/title)' ELSE 'same surname + shared company (name variant)' END
  || CASE WHEN s.members IS NOT NULL AND stage <> 2 THEN ', share a company' ELSE '' END || CASE WHEN same AND stage <> 0 THEN ', same birth date' ELSE '' END AS reason, keep_id
FROM facts f LEFT JOIN shared s USING (members)""",
    "person", "has_role",
)
def person_duplicates(t, spark, sf_dir):
    """Groups over persons whose given names repeat."""
    p = t("person")
    k = F.regexp_extract("full_name", "([0-9]+)$", 1).cast("long")
    people = p.select(
        "id", F.concat(F.element_at(F.array(*map(F.lit, ("Bob", "Robert", "Larry", "Laurence", "Ann"))), (k % 5 + 1).cast("int")), F.lit(" Case"), (k % 97).cast("string")).alias("full_name"),
        F.lit(None).cast("string").alias("first_name"), F.lit(None).cast("string").alias("last_name"), F.when(k % 11 == 0, F.lit("1970-01-01")).alias("birth_date"),
        "birth_place", F.when(k % 13 == 0, F.concat(F.lit("Q"), k.cast("string"))).alias("wikidata_id"), F.array().cast("array<string>").alias("alias"),
    )
    groups = pe.duplicate_groups(people, [t("has_role")], spark.createDataFrame([], "a string, b string"))
    return groups.withColumn("members", F.concat_ws(",", "members"))


# Search


@query(r"SELECT token, COUNT(*) AS n_docs FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) AS token FROM documents) GROUP BY token")
def token_document_frequency(t, spark, sf_dir):
    return se.document_frequency(se.token_index(_driver(spark, sf_dir, "documents"), "doc_id", "text"))


_SEARCHES = [("q1", "red widget", None), ("q2", "ring small", "ECONOMY"), ("q3", "supplier#000000007", None), ("q4", "edge", None)]


@query()
def entity_search(t, spark, sf_dir):
    e = t("entity").withColumn("name_normalized", names.normalize_entity_name(F.col("name")))
    queries = spark.createDataFrame(_SEARCHES, "query_id string, q string, country string").withColumn("nn", names.normalize_entity_name(F.col("q")))
    index = se.token_index(e.withColumn("text", F.concat_ws(" ", "name", "description")), "id", "text")
    hidden = t("suppression").where("target_kind = 'node'").select(F.col("node_id").alias("id"))
    return se.rank(se.entity_candidates(e, index, queries), e.select("id", "name", "name_normalized", "wikidata_id"), queries.select("query_id", "q", "nn"), hidden)


@query(
    r"""WITH idx AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(name || ' ' || description), '[\p{L}\p{M}\p{N}_]+')) AS token FROM entity),
q AS (SELECT * FROM (VALUES ('q1', 'red'), ('q1', 'widget'), ('q2', 'small'), ('q2', 'ring'), ('q3', 'custodian')) AS v(query_id, token))
SELECT query_id, id, COUNT(*) AS hits FROM q JOIN idx USING (token) GROUP BY query_id, id""",
    "entity",
)
def full_text_matches(t, spark, sf_dir):
    index = se.token_index(t("entity").withColumn("text", F.concat_ws(" ", "name", "description")), "id", "text")
    queries = spark.createDataFrame([("q1", "Red widget"), ("q2", "small RING"), ("q3", "custodian")], "query_id string, q string")
    return se.match_any(index, queries, "id")


# Moderation


@query(
    """SELECT target_kind, from_id, to_id, role, node_id, category, COUNT(*) AS n, MAX(created_at) AS created_at, arg_max(NULLIF(note, ''), (created_at, id)) AS note,
  array_to_string(list_sort(list(id)), ',') AS ids FROM (SELECT * FROM flag ORDER BY created_at DESC, id DESC LIMIT 1000) GROUP BY 1, 2, 3, 4, 5, 6""",
    "flag",
)
def flag_groups(t, spark, sf_dir):
    return mo.group_flags(t("flag")).withColumn("ids", F.array_join("ids", ","))


@query("SELECT target_kind, from_id, to_id, role, node_id, COUNT(*) AS n FROM flag WHERE status = 'open' GROUP BY 1, 2, 3, 4, 5", "flag")
def open_flags(t, spark, sf_dir):
    return mo.open_flag_counts(t("flag"))


@query("SELECT id, note, created_at FROM flag WHERE status = 'open' AND target_kind = 'owns' AND category = 'error' ORDER BY created_at DESC, id DESC LIMIT 100", "flag")
def flag_listing(t, spark, sf_dir):
    return mo.list_flags(t("flag"), "open", "owns", "error", 100).select("id", "note", "created_at")


@query(
    """SELECT id FROM (SELECT id, ROW_NUMBER() OVER (PARTITION BY target_kind, from_id, to_id, role, node_id, category, reporter_id ORDER BY created_at, id) AS n FROM flag
  WHERE status IN ('open', 'reviewing')) WHERE n = 1""",
    "flag",
)
def collapsed_reports(t, spark, sf_dir):
    return mo.collapse_reports(t("flag")).select("id")


@query(
    """SELECT id, in_window, in_window > 2 AS limited FROM (SELECT id, COUNT(*) OVER (PARTITION BY reporter_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING
  AND CURRENT ROW) AS in_window FROM flag)""",
    "flag",
)
def flag_rate_limit(t, spark, sf_dir):
    return mo.rate_limited(t("flag"), "reporter_id", "ts", 2).select("id", "in_window", "limited")


@query(
    """SELECT id, CASE WHEN status = 'running' AND epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(started_at)) > 1800 THEN 'stale' ELSE status END AS status
FROM scrape_run ORDER BY started_at DESC, id LIMIT 500""",
    "scrape_run",
)
def run_log(t, spark, sf_dir):
    return mo.run_listing(t("scrape_run"), F.lit("2024-01-31 00:00:00").cast("timestamp")).select("id", "status")


@query("SELECT from_id, to_id, COALESCE(p.stake_percent, o.stake_percent) AS stake_percent, p.ownership_type FROM owns o LEFT JOIN pin p USING (from_id, to_id)", "owns", "pin")
def pinned_edges(t, spark, sf_dir):
    return ed.apply_pins(t("owns"), t("pin")).select("from_id", "to_id", "stake_percent", "ownership_type")


# Scalar functions on columns of the driver's tables

_TYPE_OF = "CASE WHEN {s} >= 99 THEN 'full' WHEN {s} > 50 THEN 'majority' WHEN {s} >= 20 THEN 'controlling' ELSE 'minority' END"


@query(f"SELECT edge_id, CASE WHEN stake_percent IS NULL THEN 'unknown' ELSE {_TYPE_OF.format(s='stake_percent')} END AS ownership_type FROM owns", "owns")
def ownership_types(t, spark, sf_dir):
    return t("owns").select("edge_id", classify.derive_ownership_type(F.col("stake_percent")).alias("ownership_type"))


@query(
    f"""SELECT edge_id, CASE WHEN stake_percent IS NOT NULL THEN {_TYPE_OF.format(s='stake_percent')} WHEN direct_or_indirect = 'indirect' THEN 'controlling' ELSE 'unknown' END
  AS ownership_type FROM owns""",
    "owns",
)
def migrated_types(t, spark, sf_dir):
    stored = F.when(F.col("direct_or_indirect") == "indirect", "controlling").otherwise("majority")
    return mt.migrate_ownership_types(t("owns").withColumn("ownership_type", stored)).select("edge_id", "ownership_type")


@query(
    r"""SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(lower(name || ' Company, Ltd.'), '[,.]', '', 'g'),
  '\b(inc|corp|corporation|llc|llp|ltd|limited|co|company|plc|sa|ag|nv|bv|lp)\b\.?', '', 'g'), '\s+', ' ', 'g')) AS normalized FROM entity""",
    "entity",
)
def normalized_names(t, spark, sf_dir):
    return t("entity").select("id", names.normalize_entity_name(F.concat("name", F.lit(" Company, Ltd."))).alias("normalized"))


@query(
    r"""SELECT id, array_to_string(list_sort(regexp_extract_all(lower(full_name || ' Mr. Page'), '[a-z0-9]+')), ' ') AS all_tokens FROM person""", "person"
)
def name_tokens(t, spark, sf_dir):
    words = F.array_sort(F.regexp_extract_all(F.lower(F.concat("full_name", F.lit(" Mr. Page"))), F.lit("([a-z0-9]+)")))
    return t("person").select("id", F.concat_ws(" ", words).alias("all_tokens"))


@query(
    """SELECT id, array_to_string(list_sort(list_filter(regexp_extract_all(lower(full_name || ' Mr. Page'), '[a-z0-9]+'), lambda x: x NOT IN ('mr', 'mrs', 'ms', 'miss', 'dr', 'sir',
  'prof', 'mx', 'madam', 'hon', 'rev'))), ' ') AS name_key FROM person""",
    "person",
)
def person_name_keys(t, spark, sf_dir):
    return t("person").select("id", F.concat_ws(" ", names.name_key(F.concat("full_name", F.lit(" Mr. Page")))).alias("name_key"))


@query("SELECT id, description LIKE '%custodian%' AS is_nominee FROM entity", "entity")
def nominee_flags(t, spark, sf_dir):
    e = t("entity").select("id", F.col("description").alias("name"), F.lit(None).cast("boolean").alias("is_nominee"))
    return mt.flag_nominees(e).select("id", "is_nominee")


@query(
    "SELECT id, COALESCE(source_id, CASE WHEN wikidata_id <> '' THEN '1-URGENT' END, CASE WHEN sec_cik <> '' THEN '2-HIGH' END) AS source_id FROM entity", "entity"
)
def backfilled_sources(t, spark, sf_dir):
    return mt.backfill_sources(t("entity"), t("source")).select("id", "source_id")


@query("SELECT id, name || ' ' || COALESCE(description, '') || ' ' AS search_text FROM entity", "entity")
def backfilled_search_text(t, spark, sf_dir):
    e = t("entity").withColumns({"aliases": F.array().cast("array<string>"), "search_text": F.lit(None).cast("string")})
    return mt.backfill_search_text(e).select("id", "search_text")


@query(
    "SELECT id, CASE lower(trim(country)) WHEN 'economy' THEN 'EC' WHEN 'nation_3' THEN 'NT' ELSE country END AS country FROM entity", "entity"
)
def normalized_countries(t, spark, sf_dir):
    codes = spark.createDataFrame([("EC", "Economy"), ("NT", "NATION_3")], "code string, name string")
    return mt.normalize_countries(t("entity").select("id", "country"), codes)


@query(
    "SELECT event_id, substr(CAST(ts AS STRING), 1, 10) AS day, CAST(substr(CAST(ts AS STRING), 1, 4) AS INT) AS year, sha256(event_type || ':' || CAST(user_id AS STRING))[1:32] AS fp FROM events"
)
def event_dates_and_prints(t, spark, sf_dir):
    stamp = F.col("ts").cast("string")
    return _driver(spark, sf_dir, "events").select(
        "event_id", dates.iso_prefix(stamp).alias("day"), dates.founded_year(stamp).alias("year"),
        hashing.reporter_fingerprint(F.col("event_type"), F.col("user_id").cast("string")).alias("fp"),
    )


@query(
    """SELECT event_id, CASE WHEN gap <= 1.5 THEN 'LastDay' WHEN gap <= 6.5 THEN 'LastWeek' WHEN gap <= 29 THEN 'LastMonth' END AS window_name FROM (
  SELECT event_id, (epoch(TIMESTAMP '2024-02-05 00:00:00') - floor(epoch(ts))) / 86400.0 AS gap FROM events)"""
)
def catchup_windows(t, spark, sf_dir):
    last = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return _driver(spark, sf_dir, "events").select("event_id", dates.catchup_interval(last, F.lit("2024-02-05 00:00:00")).alias("window_name"))


@query(
    """SELECT event_id, CASE WHEN event_id % 5 = 0 AND age < 86400 THEN 'cooldown' WHEN event_id % 5 = 0 THEN 'forced' WHEN event_id % 7 = 0 THEN 'absent'
  WHEN event_id % 3 = 0 THEN 'never_on_demand' WHEN age > 20 * 86400 THEN 'stale' WHEN 2 > event_id % 4 THEN 'deepen' ELSE 'fresh' END AS reason FROM (
  SELECT event_id, epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(ts)) AS age FROM events)"""
)
def scrape_decisions(t, spark, sf_dir):
    e = F.col("event_id")
    reason = dates.decide_scrape(
        F.when(e % 7 != 0, F.lit("x")), e % 3 != 0, F.col("ts"), (e % 4).cast("int"), F.lit(2), e % 5 == 0, F.lit("2024-01-31 00:00:00").cast("timestamp"), 20, 24
    )
    return _driver(spark, sf_dir, "events").select("event_id", reason.alias("reason"))


# Upserts


@query(
    """WITH delta AS (SELECT id, name || ' new' AS name, 'X' AS country FROM entity WHERE id LIKE 'sup:%1' UNION ALL SELECT 'new:1', 'Fresh', 'Y')
SELECT COALESCE(e.id, d.id) AS id, COALESCE(d.name, e.name) AS name, COALESCE(e.country, d.country) AS country FROM entity e FULL JOIN delta d ON d.id = e.id""",
    "entity",
)
def upserted_entities(t, spark, sf_dir):
    current = t("entity").select("id", "name", "country")
    delta = current.where("id LIKE 'sup:%1'").select("id", F.concat("name", F.lit(" new")).alias("name"), F.lit("X").alias("country"))
    delta = delta.unionByName(spark.createDataFrame([("new:1", "Fresh", "Y")], delta.schema))
    return upsert(current, delta, ["id"], {"name": "new_first", "country": "existing_first"})


@query(
    """SELECT e.id, CASE WHEN e.id LIKE 'sup:%2' THEN NULL ELSE e.name END AS name FROM entity e""",
    "entity",
)
def updated_entities(t, spark, sf_dir):
    current = t("entity").select("id", "name")
    delta = current.where("id LIKE 'sup:%2'").select("id", F.lit(None).cast("string").alias("name"))
    return update_only(current, delta.unionByName(spark.createDataFrame([("nobody", "x")], delta.schema)), ["id"])


@query(
    """WITH delta AS (SELECT 'N' || edge_id AS edge_id, from_id, to_id, 77.0 AS stake_percent, '2020-01-01' AS since, CAST(NULL AS STRING) AS until FROM owns WHERE edge_id LIKE 'H%')
SELECT COALESCE(o.edge_id, d.edge_id) AS edge_id, COALESCE(o.from_id, d.from_id) AS from_id, COALESCE(o.to_id, d.to_id) AS to_id, COALESCE(d.stake_percent, o.stake_percent) AS stake_percent,
  COALESCE(o.since, d.since) AS since FROM (SELECT * FROM owns WHERE until IS NULL) o FULL JOIN delta d ON d.from_id = o.from_id AND d.to_id = o.to_id
UNION ALL SELECT edge_id, from_id, to_id, stake_percent, since FROM owns WHERE until IS NOT NULL""",
    "owns",
)
def upserted_edges(t, spark, sf_dir):
    current = t("owns").select("edge_id", "from_id", "to_id", "stake_percent", "since", "until")
    h = current.where("edge_id LIKE 'H%'")
    delta = h.select(F.concat(F.lit("N"), "edge_id").alias("edge_id"), "from_id", "to_id", F.lit(77.0).alias("stake_percent"), F.lit("2020-01-01").alias("since"), F.lit(None).cast("string").alias("until"))
    return upsert_edges(current, delta, ["from_id", "to_id"]).select("edge_id", "from_id", "to_id", "stake_percent", "since")
