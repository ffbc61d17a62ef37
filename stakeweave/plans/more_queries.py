"""Queries of operators that stand between those of the other two modules: limits, scoped merges, imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from stakeweave.operators import maintenance as mt
from stakeweave.operators import persons as pe
from stakeweave.operators import resolution as rs
from stakeweave.operators import tree as tr
from stakeweave.operators.imports import fold_in
from stakeweave.plans.registry import _driver, query
from stakeweave.sources import filings


@query(
    """WITH RECURSIVE tree(root_id, node_id, depth, path) AS (
  SELECT from_id, to_id, 1, [edge_id] FROM owns WHERE from_id IN ('sup:0', 'sup:1', 'sup:2') AND COALESCE(direct_or_indirect, '') <> 'indirect'
  UNION ALL SELECT t.root_id, o.to_id, t.depth + 1, list_append(t.path, o.edge_id) FROM tree t JOIN owns o ON o.from_id = t.node_id
  WHERE t.depth < 4 AND NOT list_contains(t.path, o.edge_id) AND COALESCE(o.direct_or_indirect, '') <> 'indirect')
SELECT root_id, node_id, CAST(depth AS INT) AS depth, array_to_string(path, '>') AS path, truncated FROM (SELECT *, COUNT(*) OVER (PARTITION BY root_id) > 9 AS truncated,
  ROW_NUMBER() OVER (PARTITION BY root_id ORDER BY depth, array_to_string(path, '>')) AS n FROM tree) WHERE n <= 9""",
    "owns",
)
def limited_tree(t, spark, sf_dir):
    roots = spark.createDataFrame([("sup:0",), ("sup:1",), ("sup:2",)], "id string")
    found = tr.ownership_tree(t("owns"), roots, 4, most=9)
    return found.select("root_id", "node_id", F.col("depth").cast("int").alias("depth"), F.array_join("edge_path", ">").alias("path"), "truncated")


_PLAN = """ranked AS (
  SELECT id AS dup_id, FIRST_VALUE(id) OVER (PARTITION BY lei_id ORDER BY COALESCE(name_credibility, 0) DESC, CASE WHEN verified THEN 0 ELSE 1 END, id) AS keep_id, 0 AS rank FROM entity WHERE lei_id <> ''
  UNION ALL SELECT id, FIRST_VALUE(id) OVER (PARTITION BY wikidata_id ORDER BY COALESCE(name_credibility, 0) DESC, CASE WHEN verified THEN 0 ELSE 1 END, id), 1 FROM entity WHERE wikidata_id <> ''),
plan AS (SELECT dup_id, arg_min(keep_id, rank) AS keep_id, CASE MIN(rank) WHEN 0 THEN 'lei_id' ELSE 'wikidata_id' END AS reason FROM ranked r WHERE dup_id <> keep_id
  AND NOT EXISTS (SELECT 1 FROM not_duplicate n WHERE (n.a = r.dup_id AND n.b = r.keep_id) OR (n.a = r.keep_id AND n.b = r.dup_id)) GROUP BY dup_id)"""


@query(
    f"""WITH RECURSIVE {_PLAN},
walk(dup_id, place, path) AS (SELECT dup_id, keep_id, [dup_id] FROM plan
  UNION ALL SELECT w.dup_id, p.keep_id, list_append(w.path, w.place) FROM walk w JOIN plan p ON p.dup_id = w.place WHERE NOT list_contains(w.path, w.place)),
ends AS (SELECT dup_id, arg_max(place, len(path)) AS place, arg_max(path, len(path)) AS path FROM walk GROUP BY dup_id),
done AS (SELECT dup_id, CASE WHEN list_contains(path, place) THEN list_min(path[list_position(path, place) :]) ELSE place END AS keep_id FROM ends)
SELECT d.dup_id, d.keep_id, p.reason FROM done d JOIN plan p USING (dup_id) WHERE d.dup_id <> d.keep_id""",
    "entity", "not_duplicate",
)
def merge_plan_of_all_identifiers(t, spark, sf_dir):
    """Chains over two identifiers end at their last survivor; cycles fold into their smallest id."""
    return rs.merge_plan(t("entity"), t("not_duplicate"))


@query(
    """WITH touched AS (SELECT id FROM entity WHERE id LIKE 'par:%7'), members AS (SELECT * FROM entity WHERE name IN (SELECT name FROM entity WHERE id IN (SELECT id FROM touched))),
graded AS (SELECT name FROM members GROUP BY name HAVING COUNT(*) > 1 AND (
  (COUNT(lei_id) >= 2 AND COUNT(DISTINCT lei_id) < COUNT(lei_id)) OR (COUNT(companies_house_id) >= 2 AND COUNT(DISTINCT companies_house_id) < COUNT(companies_house_id))
  OR (COUNT(sec_cik) >= 2 AND COUNT(DISTINCT sec_cik) < COUNT(sec_cik)) OR (COUNT(wikidata_id) >= 2 AND COUNT(DISTINCT wikidata_id) < COUNT(wikidata_id))
  OR (COUNT(registered_address) >= 2 AND COUNT(DISTINCT registered_address) < COUNT(registered_address)))),
plan AS (SELECT id AS dup_id, FIRST_VALUE(id) OVER (PARTITION BY name ORDER BY COALESCE(name_credibility, 0) DESC, CASE WHEN verified THEN 0 ELSE 1 END, id) AS keep_id
  FROM members WHERE name IN (SELECT name FROM graded))
SELECT dup_id, keep_id, COUNT(*) OVER () AS total FROM plan p WHERE dup_id <> keep_id
  AND NOT EXISTS (SELECT 1 FROM not_duplicate n WHERE (n.a = p.dup_id AND n.b = p.keep_id) OR (n.a = p.keep_id AND n.b = p.dup_id)) ORDER BY keep_id, dup_id LIMIT 100""",
    "entity", "not_duplicate",
)
def scoped_merges(t, spark, sf_dir):
    """Sure merges around touched entities; the report shows 100 of them and counts all."""
    e = t("entity")
    plan = rs.scoped_merge_plan(e, e.where("id LIKE 'par:%7'").select("id"), t("not_duplicate"), "name")
    return rs.merge_report(plan, 100).select("dup_id", "keep_id", "total")


@query(
    """WITH top AS (SELECT name, COUNT(*) AS n FROM entity GROUP BY name HAVING COUNT(*) > 1 ORDER BY n DESC, name LIMIT 20)
SELECT name, top.n, id, country FROM (SELECT e.*, ROW_NUMBER() OVER (PARTITION BY e.name ORDER BY e.id) AS place FROM entity e WHERE e.name IN (SELECT name FROM top)) JOIN top USING (name) WHERE place <= 25""",
    "entity",
)
def duplicate_name_members(t, spark, sf_dir):
    """The 20 largest groups of one name with their first 25 members."""
    found = rs.duplicate_name_report(t("entity"), "name", None, 20)
    return found.select("name", "n", F.explode("members").alias("m")).select("name", "n", "m.id", "m.country")


@query(
    """SELECT e.id, CASE WHEN d.depth IS NOT NULL THEN '2024-03-01' ELSE s.old_stamp END AS last_scraped_at, COALESCE(d.depth IS NOT NULL, FALSE) AS on_demand_scraped,
  CASE WHEN d.depth IS NULL THEN s.old_depth WHEN s.old_depth IS NULL THEN d.depth ELSE greatest(s.old_depth, d.depth) END AS scrape_depth
FROM entity e LEFT JOIN (SELECT to_id, MAX(length(role) % 5) AS depth FROM has_role WHERE role <> 'CFO' OR to_id LIKE '%1' GROUP BY to_id) d ON d.to_id = e.id
LEFT JOIN (SELECT id, CASE WHEN id LIKE '%3' THEN '2020-01-01' END AS old_stamp, CASE WHEN id LIKE '%3' THEN 4 END AS old_depth FROM entity) s ON s.id = e.id""",
    "entity", "has_role",
)
def stamped_freshness(t, spark, sf_dir):
    """Visited entities with the time and the deepest pass so far."""
    old = F.col("id").like("%3")
    e = t("entity").select(
        "id", F.when(old, F.lit("2020-01-01")).alias("last_scraped_at"), F.lit(False).alias("on_demand_scraped"), F.when(old, F.lit(4)).alias("scrape_depth")
    )
    visits = t("has_role").where("role <> 'CFO' OR to_id LIKE '%1'").select(F.col("to_id").alias("id"), (F.length("role") % 5).alias("depth"))
    return mt.stamp_freshness(e, visits, F.lit("2024-03-01"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_name || ' & Sons' END AS investor, CASE WHEN p_partkey % 3 <> 0 THEN lpad(CAST(p_partkey AS STRING), 10, '0') END AS investor_cik,
  CASE WHEN p_partkey % 4 <> 0 THEN 'https://www.sec.gov/Archives/edgar/data/' || CAST(p_partkey AS STRING) || '/d.htm' END AS document_url FROM part"""
)
def filing_index_pages(t, spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    filer = F.concat(F.lit('<span class="companyName">Acme (Subject) CIK=9</span> <span CLASS="companyName"> '), "p_name", F.lit(" &amp; Sons\n (Filed by)</span> <a href=x?CIK="), k, F.lit("&x>"))
    row = F.concat(F.lit('<td><a href="/Archives/edgar/data/'), k, F.lit('/x.xml">x</a></td><td>XML</td> <td><a href="/Archives/edgar/data/'), k, F.lit('/d.htm">d.htm</a></td>\n<td scope="row">SC 13G</td>'))
    html = F.concat(F.when(F.col("p_partkey") % 3 != 0, filer).otherwise(F.lit("<p>")), F.when(F.col("p_partkey") % 4 != 0, row).otherwise(F.lit("</p>")))
    return filings.filing_index(_driver(spark, sf_dir, "part").select("p_partkey", html.alias("html")))


@query()
def company_search(t, spark, sf_dir):
    """Three look-ups in order; similarity by matching blocks has no SQL form."""
    s = _driver(spark, sf_dir, "supplier")
    key, name = F.col("s_suppkey"), F.col("s_name")
    tickers = s.where("s_suppkey % 3 = 0").select(key.alias("cik_str"), name.alias("title"))
    queries = s.select(name.alias("q"))
    indexed = s.where("s_suppkey % 3 = 1").select(name.alias("q"), key.cast("string").alias("cik"), F.concat(name, F.lit(" Inc")).alias("name"), F.lit(0).alias("form_rank"))
    hits = s.select(name.alias("q"), key.cast("string").alias("cik"), F.when(key % 2 == 0, name).otherwise(F.lit("Another")).alias("name"), F.lit(0).alias("form_rank"))
    return filings.find_companies(queries, tickers, indexed, hits)


_FOLD = "'cus:' || CAST(c_custkey - c_custkey % 3 AS STRING)"


def _person_plan(spark, sf_dir):
    k = F.col("c_custkey")
    name = lambda x: F.concat(F.lit("cus:"), x.cast("string"))
    return _driver(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(name(k).alias("dup_id"), name(k - k % 3).alias("keep_id"))


@query(
    f"""SELECT r.edge_id, COALESCE({_FOLD}, r.from_id) AS from_id, r.to_id, r.role FROM has_role r
LEFT JOIN customer c ON r.from_id = 'cus:' || CAST(c.c_custkey AS STRING) AND c.c_custkey % 3 <> 0""",
    "has_role",
)
def moved_roles(t, spark, sf_dir):
    """Roles of merged persons: every tenure moves, none is folded."""
    return pe.move_roles(t("has_role"), _person_plan(spark, sf_dir)).select("edge_id", "from_id", "to_id", "role")


@query(
    f"""WITH rel AS (SELECT edge_id, from_id, 'cus:' || substr(to_id, 5) AS to_id, CASE WHEN role = 'CEO' THEN NULL ELSE role END AS relation FROM has_role),
dup AS (SELECT 'cus:' || CAST(c_custkey AS STRING) AS dup_id, {_FOLD} AS keep_id FROM customer WHERE c_custkey % 3 <> 0),
moved AS (SELECT edge_id, COALESCE(f.keep_id, from_id) AS from_id, COALESCE(g.keep_id, to_id) AS to_id, relation, f.dup_id IS NOT NULL OR g.dup_id IS NOT NULL AS moved
  FROM rel LEFT JOIN dup f ON f.dup_id = rel.from_id LEFT JOIN dup g ON g.dup_id = rel.to_id)
SELECT arg_min(edge_id, (moved, edge_id)) AS edge_id, from_id, to_id, arg_min(relation, (moved, edge_id)) FILTER (relation IS NOT NULL) AS relation
FROM moved WHERE NOT (moved AND from_id = to_id) GROUP BY from_id, to_id""",
    "has_role",
)
def folded_relations(t, spark, sf_dir):
    """Relations of merged persons, one a pair in each direction."""
    r = t("has_role").select("edge_id", "from_id", F.concat(F.lit("cus:"), F.substring("to_id", 5, 20)).alias("to_id"), F.when(F.col("role") != "CEO", F.col("role")).alias("relation"))
    return pe.fold_relations(r, _person_plan(spark, sf_dir))


@query(
    """SELECT edge_id FROM (SELECT edge_id, ROW_NUMBER() OVER (PARTITION BY from_id, to_id ORDER BY COALESCE(stake_percent, -1) DESC, CASE WHEN direct_or_indirect IS NULL THEN 1 ELSE 0 END,
  edge_id) AS n FROM owns WHERE until IS NULL) WHERE n = 1 UNION ALL SELECT edge_id FROM owns WHERE until IS NOT NULL""",
    "owns",
)
def housekept_edges(t, spark, sf_dir):
    """Edges after an import's housekeeping."""
    e = t("entity").withColumn("is_nominee", F.lit(None).cast("boolean"))
    return mt.housekeeping(e, t("owns"))[1].select("edge_id")


@query(
    """SELECT 'peer:' || e.id AS remote_id, COALESCE(q.id, s.id, l.id, h.id, 'peer:' || e.id) AS id FROM entity e
LEFT JOIN (SELECT wikidata_id AS v, MIN(id) AS id FROM entity WHERE wikidata_id <> '' GROUP BY 1) q ON q.v = e.wikidata_id
LEFT JOIN (SELECT sec_cik AS v, MIN(id) AS id FROM entity WHERE sec_cik <> '' GROUP BY 1) s ON s.v = e.sec_cik
LEFT JOIN (SELECT lei_id AS v, MIN(id) AS id FROM entity WHERE lei_id <> '' GROUP BY 1) l ON l.v = e.lei_id
LEFT JOIN (SELECT companies_house_id AS v, MIN(id) AS id FROM entity WHERE companies_house_id <> '' GROUP BY 1) h ON h.v = e.companies_house_id""",
    "entity",
)
def reconciled_ids(t, spark, sf_dir):
    """A peer's entities under local ids."""
    e = t("entity")
    remote = e.withColumn("id", F.concat(F.lit("peer:"), "id"))
    return rs.reconcile(e, remote, t("owns"))[2]


@query(
    """SELECT o.edge_id, o.from_id, o.to_id, COALESCE(d.stake, o.stake_percent) AS stake_percent FROM owns o LEFT JOIN (SELECT from_id, to_id, 12.5 AS stake FROM owns WHERE edge_id LIKE 'H%') d
  ON d.from_id = o.from_id AND d.to_id = o.to_id WHERE o.until IS NOT NULL OR o.edge_id IN (SELECT edge_id FROM (SELECT edge_id, ROW_NUMBER() OVER (PARTITION BY a.from_id, a.to_id
  ORDER BY COALESCE(h.stake, a.stake_percent, -1) DESC, CASE WHEN direct_or_indirect IS NULL THEN 1 ELSE 0 END, edge_id) AS n
  FROM owns a LEFT JOIN (SELECT from_id, to_id, 12.5 AS stake FROM owns WHERE edge_id LIKE 'H%') h ON h.from_id = a.from_id AND h.to_id = a.to_id WHERE until IS NULL) WHERE n = 1)""",
    "owns",
)
def imported_edges(t, spark, sf_dir):
    """A source's edges folded in: refreshed by pair, then one active edge a pair."""
    new = t("owns").where("edge_id LIKE 'H%'").select("edge_id", "from_id", "to_id", F.lit(12.5).alias("stake_percent"), F.lit("3-MEDIUM").alias("source_id"))
    claims = spark.createDataFrame([], "kind string, from_id string, to_id string, source_id string, claim_key string, stake_percent double, source_url string, last_seen_at string, first_seen_at string")
    tables = {"entity": t("entity").withColumn("is_nominee", F.lit(None).cast("boolean")), "owns": t("owns"), "claim": claims}
    found = fold_in(tables, F.lit("2024-01-01"), owns=new)
    return found["owns"].select("edge_id", "from_id", "to_id", "stake_percent")
