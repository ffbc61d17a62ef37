"""Name matching against stored nodes, voting-power write-back, and capped expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stakeweave.functions.names import entity_name_variants, is_reordering, normalize_entity_name, person_name_variants
from stakeweave.operators.edges import limited
from stakeweave.operators.tree import cut


def prefix_match(queries: DataFrame, stored: DataFrame, least: int = 4) -> DataFrame:
    """``q, cik, id``: stored names of ``least`` characters or more that are a query's leading words, the longest first.

    A stored CIK must be missing or equal.  Every leading run of a query's words is one key, so this is an
    equal join and not a comparison of all pairs.
    """
    words = F.split("q", " ")
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    keys = queries.where(F.contains("q", F.lit(" "))).select("q", "cik", F.explode(runs).alias("_key"))
    names = stored.where(F.length("name") >= least).select("id", F.col("name").alias("_key"), F.col("sec_cik").alias("_cik"))
    found = keys.join(names, "_key").where(F.col("_cik").isNull() | (F.col("_cik") == F.col("cik")))
    best = Window.partitionBy("q", "cik").orderBy(F.length("_key").desc(), "id")
    return found.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("q", "cik", "id")


def owner_candidates(names: DataFrame, key: str) -> DataFrame:
    """``key, variant, place`` of all forms under which an owner's name may be stored, the likeliest first."""
    forms = F.concat(person_name_variants(F.col("name")), entity_name_variants(F.col("name")), F.array(normalize_entity_name(F.col("name"))))
    return names.select(key, "name", F.posexplode(F.array_distinct(forms)).alias("place", "variant"))


def write_voting_power(listed: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with ``voting_power_pct`` from a proxy's owners, and what became of every listed owner.

    ``listed`` has ``company_id, name, percent``.  An owner is the active owner of the company whose name,
    or normalised name, is a variant of the listed one.  Only the one column of the edge changes.
    """
    rows = listed.withColumn("_row", F.concat_ws("|", "company_id", "name"))
    forms = owner_candidates(rows, "_row").select("_row", "variant", "place").join(rows.select("_row", "company_id", "name", "percent"), "_row")
    owners = edges.where("until IS NULL").select("edge_id", F.col("from_id").alias("id"), F.col("to_id").alias("company_id")).join(nodes.select("id", F.col("name").alias("stored")), "id")
    keyed = owners.withColumn("variant", F.explode(F.array_distinct(F.array("stored", normalize_entity_name(F.col("stored"))))))
    found = forms.join(keyed, ["company_id", "variant"])
    best = found.withColumn("_n", F.row_number().over(Window.partitionBy("_row").orderBy("place", "edge_id"))).where("_n = 1")
    report = rows.join(best.select("_row", "edge_id", "stored"), "_row", "left").select(
        "company_id", "name", "edge_id",
        F.when(F.col("percent").isNull(), "no percentage").when(F.col("edge_id").isNull(), "not found").otherwise("updated").alias("outcome"),
        F.coalesce(is_reordering(F.col("name"), F.col("stored")), F.lit(False)).alias("reordered"),
    )
    new = best.where("percent IS NOT NULL").groupBy("edge_id").agg(F.max("percent").alias("_power"))
    out = edges.join(new, "edge_id", "left").withColumn("voting_power_pct", F.coalesce("_power", "voting_power_pct")).select(*edges.columns)
    return out, report


def expand(seeds: DataFrame, children: DataFrame, depth: int = 3, most: int = 15) -> DataFrame:
    """``id, level`` of nodes within ``depth`` levels of the seeds, at most ``most`` children a node, each node once."""
    capped = limited(children.select("from_id", "to_id").distinct(), "from_id", [F.col("to_id")], most).select("from_id", "to_id")
    capped = cut(capped)
    found = seeds.select("id", F.lit(0).alias("level"))
    frontier = seeds.select("id")
    for level in range(1, max(0, min(depth, 3)) + 1):
        grown = frontier.join(capped, F.col("id") == F.col("from_id")).select(F.col("to_id").alias("id")).distinct()
        frontier = cut(grown.join(found.select("id"), "id", "left_anti"))
        found = found.unionByName(frontier.withColumn("level", F.lit(level)))
    return found
