"""Queries over what is written and read back: array documents, tables in buckets, the stored index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stakeweave.operators import resolution as rs
from stakeweave.operators import runs
from stakeweave.operators import search as se
from stakeweave.operators.search_index import SearchIndex
from stakeweave.operators.store import Store
from stakeweave.operators.tree import checkpoint_folder
from stakeweave.operators.upsert import upsert
from stakeweave.plans.registry import _driver, query
from stakeweave.sources import records


def _folder(spark, name):
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT p_partkey AS id, p_name AS name, p_size AS size, 'a \"quoted\" } brace [' || p_brand AS remark FROM part")
def array_document_records(t, spark, sf_dir):
    """All parts written as one document with one array, and cut into records again."""
    p = _driver(spark, sf_dir, "part")
    remark = F.concat(F.lit('a "quoted" } brace ['), "p_brand")
    body = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.struct(F.col("p_name").alias("name")).alias("n"), F.col("p_size").alias("size"), remark.alias("remark")))
    # One file: its head, records and tail, with commas between them (the last comma stands behind the document).
    rows = p.select(F.lit(1).alias("at"), F.col("p_partkey").alias("k"), body.alias("value"))
    ends = spark.createDataFrame([(0, 0, '{"about": {"x": 1}, "records": [0'), (2, 0, '{}], "more": [{"id": 1}]}')], "at int, k long, value string")
    path = _folder(spark, "document")
    rows.unionByName(ends).orderBy("at", "k").coalesce(1).select("value").write.option("lineSep", ",").text(path)
    found = records.read_records(spark, path, "id long, n struct<name:string>, size int, remark string", array=True)
    return found.where("id IS NOT NULL").select("id", F.col("n.name").alias("name"), "size", "remark")


@query(
    """SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name IN (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%')"""
)
def mentioning_records(t, spark, sf_dir):
    """Raw records that mention any of the listed names, before they are parsed."""
    s, n, r = (_driver(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    lines = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.to_json(F.struct("s_suppkey", F.struct("n_name").alias("place"))).alias("value"))
    names = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).where("r_name LIKE 'A%'").select(F.concat(F.lit('"'), "n_name", F.lit('"')).alias("id"))
    hits = records.mentioning(lines, [x.id for x in names.collect()])  # a list that a user gives
    return hits.select(F.from_json("value", "s_suppkey long, place struct<n_name:string>").alias("r")).select("r.s_suppkey", "r.place.n_name")


@query(
    """SELECT edge_id, from_id, to_id, CASE WHEN stake_percent > 60 THEN 60 ELSE stake_percent END AS stake_percent, CASE WHEN stake_percent > 60 THEN '2030-01-01' ELSE since END AS since FROM owns
UNION ALL SELECT 'new:' || CAST(s_suppkey AS STRING), 'sup:' || CAST(s_suppkey AS STRING), 'par:1', 5.0, '2030-01-01' FROM supplier""",
    "owns",
)
def stored_upserts(t, spark, sf_dir):
    """All edges in buckets of their id; a batch of changed and new edges rewrites the buckets that it touches."""
    owns = t("owns").select("edge_id", "from_id", "to_id", F.col("stake_percent").cast("double").alias("stake_percent"), "since")
    store = Store(spark, _folder(spark, "store"))
    store.create({"owns": (owns, ["edge_id"], 16)})
    # Changed edges are read from their buckets: the edges' own plan runs once, for the first version.
    changed = store.read("owns").where("stake_percent > 60").withColumns({"stake_percent": F.lit(60.0), "since": F.lit("2030-01-01")})
    k = F.col("s_suppkey").cast("string")
    new = _driver(spark, sf_dir, "supplier").select(F.concat(F.lit("new:"), k).alias("edge_id"), F.concat(F.lit("sup:"), k).alias("from_id"), F.lit("par:1").alias("to_id"), F.lit(5.0).alias("stake_percent"),
                                                    F.lit("2030-01-01").alias("since"))
    store.change({"owns": (changed.unionByName(new), lambda old, delta: upsert(old, delta, ["edge_id"], default="overwrite"))})
    return store.read("owns")


_ASKED = [(1, "ring small brass"), (2, "supplier works"), (3, "renamed"), (4, "lavender")]


@query(
    r"""WITH named AS (SELECT id, CASE WHEN founded > 25 THEN name || ' renamed works' ELSE name END AS name FROM entity WHERE country <> 'NATION_3'),
q AS (SELECT * FROM (VALUES (1, 'ring'), (1, 'small'), (1, 'brass'), (2, 'supplier'), (2, 'works'), (3, 'renamed'), (4, 'lavender')) v(query_id, token)),
w AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(name), '[\p{L}\p{M}\p{N}_]+')) AS token FROM named)
SELECT query_id, id, COUNT(*) AS hits FROM w JOIN q USING (token) GROUP BY query_id, id""",
    "entity",
)
def stored_index_hits(t, spark, sf_dir):
    """The names of all entities in a stored index; a segment renames some and drops others."""
    names = t("entity").select("id", F.col("name").alias("text"), "country", "founded")
    index = SearchIndex(Store(spark, _folder(spark, "index")), buckets=16)
    index.build(names.select("id", "text"))
    new = names.where("founded > 25 AND country <> 'NATION_3'").select("id", F.concat("text", F.lit(" renamed works")).alias("text"))
    index.change(new, names.where("country = 'NATION_3'").select("id"))
    queries = spark.createDataFrame(_ASKED, "query_id int, q string")
    return se.match_any(index.words_of(queries), queries, "id")


@query(
    """WITH plan AS (SELECT id AS dup_id, keep_id FROM (SELECT id, FIRST_VALUE(id) OVER (PARTITION BY lei_id ORDER BY COALESCE(name_credibility, 0) DESC, CASE WHEN verified THEN 0 ELSE 1 END, id) AS keep_id
  FROM entity WHERE lei_id <> '') r WHERE id <> keep_id AND NOT EXISTS (SELECT 1 FROM not_duplicate n WHERE (n.a = r.id AND n.b = r.keep_id) OR (n.a = r.keep_id AND n.b = r.id))),
moved AS (SELECT o.*, COALESCE(a.keep_id, o.from_id) AS f, COALESCE(b.keep_id, o.to_id) AS t, a.keep_id IS NOT NULL OR b.keep_id IS NOT NULL AS moved
  FROM owns o LEFT JOIN plan a ON a.dup_id = o.from_id LEFT JOIN plan b ON b.dup_id = o.to_id),
kept AS (SELECT * FROM moved WHERE NOT (moved AND f = t)),
pairs AS (SELECT DISTINCT f, t, TRUE AS hit FROM kept WHERE moved),
one AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY f, t, until IS NULL ORDER BY moved, edge_id) AS n FROM kept),
-- Of a pair's active edges the best stays; a moved one was there only where the survivor had none.
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY f, t, until IS NULL ORDER BY COALESCE(stake_percent, -1) DESC, direct_or_indirect IS NULL, edge_id) AS n2
  FROM one WHERE NOT moved OR until IS NOT NULL OR n = 1)
SELECT edge_id, f AS from_id, t AS to_id FROM best LEFT JOIN pairs USING (f, t) WHERE hit IS NULL OR until IS NOT NULL OR n2 = 1""",
    "entity", "owns", "not_duplicate",
)
def stored_merges(t, spark, sf_dir):
    """Entities of one identifier merged in a store: edges, fields, forwarding ids and the log in one version."""
    e = t("entity").withColumn("aliases", F.array().cast("array<string>"))
    store = Store(spark, _folder(spark, "graph"))
    none = spark.createDataFrame([], "claim_key string, kind string, from_id string, to_id string, source_id string, last_seen_at string, first_seen_at string")
    runs.create_graph(store, {"entity": e, "owns": t("owns"), "claim": none}, 16)
    runs.apply_merges(store, rs.merge_plan(e, t("not_duplicate"), ("lei_id",)), F.lit("2024-01-01"))
    return store.read("owns").select("edge_id", "from_id", "to_id")
