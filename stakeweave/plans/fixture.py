"""Graph tables derived from the order tables, in SQL that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Driver tables that each graph table reads.
_NEEDS = {
    "entity": ("supplier", "nation", "part"),
    "person": ("customer", "nation"),
    "source": ("orders",),
    "owns": ("lineitem", "orders", "supplier"),
    "has_role": ("lineitem", "orders"),
    "succeeded_by": ("supplier",),
    "dual_listed_with": ("supplier",),
    "claim": ("lineitem", "orders"),
    "flag": ("events",),
    "suppression": ("supplier",),
    "pin": ("supplier",),
    "merged_id": ("supplier",),
    "scrape_run": ("events",),
    "not_duplicate": ("supplier",),
}

SQL = {
    "entity": """
SELECT 'sup:' || CAST(s_suppkey AS STRING) AS id, s_name AS name, n_name AS country, CAST(NULL AS STRING) AS registered_address,
  CAST(NULL AS INT) AS founded, CASE WHEN s_suppkey % 3 = 0 THEN 'Q' || CAST(s_suppkey % 40 AS STRING) END AS wikidata_id,
  CASE WHEN s_suppkey % 7 = 0 THEN lpad(CAST(s_suppkey AS STRING), 10, '0') END AS sec_cik,
  CASE WHEN s_suppkey % 2 = 0 THEN 'LEI' || lpad(CAST(s_suppkey % 60 AS STRING), 17, '0') END AS lei_id,
  CASE WHEN s_suppkey % 5 = 0 THEN lpad(CAST(s_suppkey AS STRING), 8, '0') END AS companies_house_id,
  CASE WHEN s_suppkey % 4 = 1 THEN '3-MEDIUM' END AS source_id, CAST(s_suppkey % 3 AS INT) AS name_credibility, s_suppkey % 6 = 0 AS verified,
  CASE WHEN s_suppkey % 8 = 3 THEN 'custodian of record' ELSE 'supplies parts' END AS description
FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL
SELECT 'par:' || CAST(p_partkey AS STRING), p_name, p_type, p_brand, p_size, CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING),
  CAST(NULL AS STRING), CAST(NULL AS STRING), 0, FALSE, p_brand || ' ' || p_type
FROM part""",
    "person": """
SELECT 'cus:' || CAST(c_custkey AS STRING) AS id, c_name AS full_name, n_name AS nationality, c_mktsegment AS birth_place
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "source": """
SELECT o_orderpriority AS id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Wikidata' WHEN '2' THEN 'SEC EDGAR' WHEN '3' THEN 'GLEIF' WHEN '4' THEN 'UK PSC' ELSE 'Manual' END AS name,
  CASE WHEN o_orderpriority < '3' THEN 'registry' ELSE 'user' END AS type,
  100 - 4 * CAST(substr(o_orderpriority, 1, 1) AS INT) AS credibility_score FROM orders GROUP BY o_orderpriority""",
    "owns": """
SELECT 'L' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS edge_id,
  'cus:' || CAST(o_custkey AS STRING) AS from_id, 'par:' || CAST(l_partkey AS STRING) AS to_id, CASE WHEN l_tax < 0.075 THEN l_quantity END AS stake_percent,
  CAST(NULL AS STRING) AS direct_or_indirect, substr(CAST(o_orderdate AS STRING), 1, 10) AS since,
  CASE WHEN l_linestatus = 'F' THEN substr(CAST(l_shipdate AS STRING), 1, 10) END AS until, o_orderpriority AS source_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL
SELECT 'H' || CAST(s_suppkey AS STRING), 'sup:' || CAST(CAST(FLOOR((s_suppkey - 1) / 2) AS BIGINT) AS STRING), 'sup:' || CAST(s_suppkey AS STRING), CAST(60 AS DOUBLE),
  'direct', '2010-01-01', CAST(NULL AS STRING), '3-MEDIUM' FROM supplier WHERE s_suppkey > 0
UNION ALL
SELECT 'U' || CAST(s_suppkey AS STRING), 'sup:0', 'sup:' || CAST(s_suppkey AS STRING), CAST(NULL AS DOUBLE), 'indirect', CAST(NULL AS STRING), CAST(NULL AS STRING), '3-MEDIUM'
FROM supplier WHERE s_suppkey >= 3
UNION ALL
SELECT 'X' || CAST(s_suppkey AS STRING), 'sup:' || CAST(s_suppkey AS STRING), 'sup:' || CAST(CAST(FLOOR((s_suppkey - 1) / 2) AS BIGINT) AS STRING), CAST(10 AS DOUBLE),
  CAST(NULL AS STRING), '2015-06-30', CAST(NULL AS STRING), '2-HIGH' FROM supplier WHERE s_suppkey > 0 AND s_suppkey % 5 = 0
UNION ALL
SELECT 'S' || CAST(s_suppkey AS STRING), 'sup:' || CAST(s_suppkey AS STRING), 'sup:' || CAST(s_suppkey AS STRING), CAST(5 AS DOUBLE), CAST(NULL AS STRING), '2012-03-01',
  CAST(NULL AS STRING), '5-LOW' FROM supplier WHERE s_suppkey % 4 = 0
UNION ALL
SELECT 'D' || CAST(s_suppkey AS STRING), 'sup:' || CAST(CAST(FLOOR((s_suppkey - 1) / 2) AS BIGINT) AS STRING), 'sup:' || CAST(s_suppkey AS STRING), CAST(60 AS DOUBLE),
  CAST(NULL AS STRING), '2011-01-01', CAST(NULL AS STRING), '5-LOW' FROM supplier WHERE s_suppkey > 0 AND s_suppkey % 3 = 0""",
    "has_role": """
SELECT 'R' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS edge_id, 'cus:' || CAST(o_custkey AS STRING) AS from_id,
  'sup:' || CAST(l_suppkey AS STRING) AS to_id, CASE l_returnflag WHEN 'A' THEN 'CEO' WHEN 'N' THEN 'director' ELSE 'CFO' END AS role,
  substr(CAST(o_orderdate AS STRING), 1, 10) AS since, CASE WHEN l_linestatus = 'F' THEN substr(CAST(l_shipdate AS STRING), 1, 10) END AS until, o_orderpriority AS source_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "succeeded_by": """
SELECT 'sup:' || CAST(s_suppkey AS STRING) AS from_id, 'sup:' || CAST(s_suppkey + 1 AS STRING) AS to_id, '2001-01-01' AS since FROM supplier
WHERE s_suppkey % 6 = 0 AND s_suppkey + 1 < (SELECT COUNT(*) FROM supplier)""",
    "dual_listed_with": """
SELECT 'sup:' || CAST(s_suppkey AS STRING) AS from_id, 'sup:' || CAST(s_suppkey + 1 AS STRING) AS to_id FROM supplier WHERE s_suppkey % 10 = 0
UNION ALL SELECT 'sup:' || CAST(s_suppkey + 1 AS STRING), 'sup:' || CAST(s_suppkey AS STRING) FROM supplier WHERE s_suppkey % 10 = 0""",
    "claim": """
SELECT 'owns' AS kind, 'cus:' || CAST(o_custkey AS STRING) AS from_id, 'sup:' || CAST(l_suppkey AS STRING) AS to_id, o_orderpriority AS source_id,
  l_quantity AS stake_percent, substr(CAST(l_shipdate AS STRING), 1, 10) AS source_date,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 98 WHEN '2' THEN 97 WHEN '3' THEN 92 WHEN '4' THEN 85 ELSE 80 END AS credibility_score,
  'order-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) AS source_url,
  substr(CAST(o_orderdate AS STRING), 1, 10) AS seen_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "flag": """
SELECT 'flag:' || lpad(CAST(event_id AS STRING), 9, '0') AS id, CASE event_type WHEN 'view' THEN 'node' WHEN 'click' THEN 'role' ELSE 'owns' END AS target_kind, event_type AS category,
  CASE WHEN event_id % 3 = 0 THEN props END AS note, CASE event_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'reviewing' WHEN 2 THEN 'resolved' ELSE 'dismissed' END AS status,
  CASE WHEN user_id % 2 = 0 THEN 'anonymous' ELSE 'user' END AS reporter_kind, CAST(user_id AS STRING) AS reporter_id,
  CASE WHEN event_type <> 'view' THEN 'sup:' || CAST(event_id % 10 AS STRING) END AS from_id,
  CASE WHEN event_type <> 'view' THEN 'sup:' || CAST(event_id % 7 AS STRING) END AS to_id,
  CASE WHEN event_type = 'view' THEN 'sup:' || CAST(event_id % 12 AS STRING) END AS node_id, CASE WHEN event_type = 'click' THEN 'CEO' END AS role,
  substr(CAST(ts AS STRING), 1, 19) AS created_at, ts
FROM events""",
    "suppression": """
SELECT 'owns' AS target_kind, 'sup:' || CAST(CAST(FLOOR((s_suppkey - 1) / 2) AS BIGINT) AS STRING) AS from_id, 'sup:' || CAST(s_suppkey AS STRING) AS to_id,
  CAST(NULL AS STRING) AS role, CAST(NULL AS STRING) AS node_id FROM supplier WHERE s_suppkey % 11 = 10
UNION ALL SELECT 'node', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), 'sup:' || CAST(s_suppkey AS STRING) FROM supplier WHERE s_suppkey % 13 = 5
UNION ALL SELECT 'role', 'cus:' || CAST(s_suppkey AS STRING), 'sup:' || CAST(s_suppkey AS STRING), 'CEO', CAST(NULL AS STRING) FROM supplier""",
    "pin": """
SELECT 'sup:' || CAST(CAST(FLOOR((s_suppkey - 1) / 2) AS BIGINT) AS STRING) AS from_id, 'sup:' || CAST(s_suppkey AS STRING) AS to_id, CAST(51 AS DOUBLE) AS stake_percent,
  'majority' AS ownership_type FROM supplier WHERE s_suppkey % 9 = 1""",
    "merged_id": """
SELECT 'old:' || CAST(s_suppkey AS STRING) AS old_id, CASE WHEN s_suppkey % 4 = 3 THEN 'sup:' || CAST(s_suppkey AS STRING) ELSE 'old:' || CAST(s_suppkey + 1 AS STRING) END AS new_id
FROM supplier
UNION ALL SELECT 'loop:a', 'loop:b' UNION ALL SELECT 'loop:b', 'loop:a'""",
    "scrape_run": """
SELECT 'run:' || lpad(CAST(event_id AS STRING), 9, '0') AS id, event_type AS source, CASE WHEN event_id % 5 = 0 THEN 'running' WHEN event_id % 5 = 1 THEN 'error' ELSE 'done' END AS status,
  ts AS started_at FROM events""",
    "not_duplicate": """
SELECT 'entity' AS kind, 'sup:' || CAST(s_suppkey AS STRING) AS a, 'sup:' || CAST(s_suppkey + 40 AS STRING) AS b, '2024-01-01' AS at FROM supplier WHERE s_suppkey % 10 = 4""",
}


def graph_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One graph table over the Parquet tables of ``sf_dir``."""
    text = SQL[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _NEEDS[name]}
    for t in tables:
        text = _braced(text, t)
    return spark.sql(text, **tables)


def _braced(text: str, table: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", text)


def with_tables(query: str, *names: str) -> str:
    """Oracle SQL: ``query`` behind the named graph tables as common table expressions."""
    head = ",\n".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in names)
    start = query.lstrip()
    if start.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{start[len('WITH RECURSIVE ') :]}"
    if start.upper().startswith("WITH "):
        return f"WITH {head},\n{start[len('WITH ') :]}"
    return f"WITH {head}\n{query}"
