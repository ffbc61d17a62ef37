"""Imports as runs over a store: what a source says is folded in, then the sure merges around it follow.

A run makes one version of the store with everything that the source says, and one more if entities are
merged: moved edges and claims, united fields, forwarding ids, the log and the deletes of a plan appear together.  A run that stops between
the two is made whole by the next one, and running it again on the same records changes no row: ids that were merged are
told in their survivors' ids before they are folded in.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stakeweave.operators.claims import claim_rows, upsert_claims, with_claim_key
from stakeweave.operators.edges import dedup_owns
from stakeweave.operators.maintenance import flag_nominees
from stakeweave.operators.resolution import HARD_IDS, collapse_plan, merge_entities, merge_log_rows, merge_plan, rewrite_endpoints, scoped_merge_plan
from stakeweave.operators.store import Store, Version
from stakeweave.operators.tree import collapse_forwarding, cut
from stakeweave.operators.upsert import upsert, upsert_edges
from stakeweave.sources import gleif, registers

#: The tables of a graph and their keys.  Edges lie by their pair, so what a pair decides is decided within a bucket.
KEYS = {
    "entity": ["id"], "person": ["id"], "owns": ["from_id", "to_id"], "claim": ["claim_key"], "merged_id": ["old_id"], "merge_log": ["keep_id", "dup_name"],
    "not_duplicate": ["a", "b"],
}
_NEW = {
    "merged_id": "old_id string, new_id string", "merge_log": "keep_id string, keep_name string, dup_name string, dup_id string, count int, at string",
    "not_duplicate": "kind string, a string, b string, at string",
}


def create_graph(store: Store, tables: Mapping[str, DataFrame], buckets: int = 64, fence: int | None = None) -> Version:
    """A graph's tables in a store; those of merges are empty where they aren't given."""
    given = {**{k: store.spark.createDataFrame([], s) for k, s in _NEW.items()}, **tables}
    return store.create({name: (rows, KEYS[name], buckets) for name, rows in given.items()}, fence=fence)


@dataclass(frozen=True)
class Said:
    """What a source says: nodes and edges to fold in, and ``updates`` of entities that are never added."""

    entities: DataFrame | None = None
    persons: DataFrame | None = None
    owns: DataFrame | None = None
    updates: DataFrame | None = None
    kind: str = "owns"


def said_by_control(records: DataFrame, source_id: str, credibility: int, codes: DataFrame | None = None) -> Said:
    """The register of persons with significant control."""
    rows = registers.control_rows(records, codes)
    return Said(registers.control_entities(rows, source_id, credibility), registers.control_persons(rows), registers.control_edges(rows, source_id, credibility))


def said_by_legal_entities(records: DataFrame, source_id: str, credibility: int, forms: DataFrame, categories: DataFrame) -> Said:
    return Said(entities=gleif.lei_entities(records, source_id, credibility, forms, categories))


def said_by_relationships(records: DataFrame, source_id: str, credibility: int) -> Said:
    return Said(owns=gleif.owns_edges(records, source_id, credibility))


def said_by_companies(rows: DataFrame, credibility: int) -> Said:
    """The company register's file, which adds no company."""
    return Said(updates=registers.company_updates(rows, credibility))


def said_by_holdings(holdings: DataFrame, entities: DataFrame, source_id: str, credibility: int) -> Said:
    """Newest stakes of filers (``latest_holdings``): both sides are known by their number at the commission, or get an entity."""
    known = entities.where("sec_cik <> ''").groupBy(F.col("sec_cik").alias("_cik")).agg(F.min("id").alias("_id"))

    def ids(rows: DataFrame, column: str, name: str) -> DataFrame:
        found = rows.join(known, F.col(column) == F.col("_cik"), "left").withColumn(name, F.coalesce("_id", F.concat(F.lit("sec:"), column)))
        return found.drop("_cik", "_id")

    rows = ids(ids(holdings, "cik", "from_id"), "issuer_cik", "to_id")
    issuers = rows.select(F.col("to_id").alias("id"), F.col("issuer_cik").alias("sec_cik"), F.col("issuer").alias("name"))
    filers = rows.select(F.col("from_id").alias("id"), F.col("cik").alias("sec_cik"), F.lit(None).cast("string").alias("name"))
    nodes = issuers.unionByName(filers).groupBy("id").agg(F.min("sec_cik").alias("sec_cik"), F.min("name").alias("name"))
    edges = rows.select(
        F.concat_ws("|", "from_id", "to_id").alias("edge_id"), "from_id", "to_id", "stake_percent", "since", "until",
        F.lit(source_id).alias("source_id"), F.lit(credibility).alias("credibility_score"), F.col("since").alias("source_date"),
    )
    return Said(entities=nodes, owns=edges)


def _current(rows: DataFrame, merged: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with merged ids told as their survivors'; ``_moved`` tells which rows had any."""
    out = rows.withColumn("_moved", F.lit(False))
    for c in columns:
        m = merged.select(F.col("old_id").alias("_old"), F.col("new_id").alias("_now"))
        out = out.join(m, F.col(c) == F.col("_old"), "left").withColumn("_moved", F.col("_moved") | F.col("_now").isNotNull())
        out = out.withColumn(c, F.coalesce("_now", c)).drop("_old", "_now")
    return out


def _named(rows: DataFrame) -> tuple[DataFrame, list[str], dict[str, str]]:
    """Rows, their key, and the rule by which names follow their credibility; a row without a name has none."""
    if not {"name", "name_credibility"} <= set(rows.columns):
        return rows, ["id"], {}
    rows = rows.withColumn("name_credibility", F.when(F.col("name").isNotNull(), F.col("name_credibility")))
    return rows, ["id"], {c: "credible" for c in ("name", "name_normalized", "name_credibility") if c in rows.columns}


def fold_said(store: Store, said: Said, now: Column, fence: int | None = None) -> tuple[Version, DataFrame]:
    """The version with what a source says, and the ids of the entities that it speaks of (column ``id``)."""
    base = store.latest()
    merged = store.read("merged_id", base)
    changes, touched = {}, []
    known = lambda rows, table: rows.select(*[c for c in store.read(table, base).columns if c in rows.columns], *[c for c in ("_moved",) if c in rows.columns])

    def fold_nodes(stored: DataFrame, delta: DataFrame) -> DataFrame:
        # What is said of a merged id fills gaps; what is said of an id itself counts, its name if no more credible source gave one.
        own, other = delta.where("NOT _moved").drop("_moved"), delta.where("_moved").drop("_moved")
        return upsert(upsert(stored, *_named(own), default="nonempty_new"), other, ["id"], default="existing_first")

    def fold_entities(stored: DataFrame, delta: DataFrame) -> DataFrame:
        told = delta.where("NOT _update").drop("_update")
        out = fold_nodes(stored, told)
        if said.updates is not None:
            updates = delta.where("_update").drop("_update", "_moved").select("id", *[c for c in delta.columns if c in said.updates.columns and c != "id"])
            there = updates.join(out.select("id"), "id", "left_semi")
            out = upsert(out, *_named(there), default="new_first")
        return flag_nominees(out).select(*stored.columns)

    if said.entities is not None or said.updates is not None:
        parts = []
        for rows, update in ((said.entities, False), (said.updates, True)):
            if rows is not None:
                parts.append(known(_current(rows, merged, "id"), "entity").withColumn("_update", F.lit(update)))
        delta = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        changes["entity"] = (delta, fold_entities)
        touched.append(delta.select("id"))
    if said.persons is not None:
        changes["person"] = (known(said.persons.withColumn("_moved", F.lit(False)), "person"), fold_nodes)
    if said.owns is not None:
        edges = _current(said.owns, merged, "from_id", "to_id").where("NOT (_moved AND from_id = to_id)").drop("_moved")
        columns = store.read("owns", base).columns
        edges = edges.select("*", *[F.lit(None).cast(store.read("owns", base).schema[c].dataType).alias(c) for c in columns if c not in edges.columns])
        live = dedup_owns(edges).unionByName(edges.where("until IS NOT NULL"))

        def fold_edges(stored: DataFrame, delta: DataFrame) -> DataFrame:
            # Ended edges are told by their id, active ones by their pair.
            ended = upsert(stored.where("until IS NOT NULL"), delta.where("until IS NOT NULL"), ["edge_id"], default="new_first")
            active = upsert_edges(stored.where("until IS NULL").join(ended.select("edge_id"), "edge_id", "left_anti").select(*stored.columns), delta.where("until IS NULL"), ["from_id", "to_id"])
            return dedup_owns(active).select(*stored.columns).unionByName(ended.select(*stored.columns))

        changes["owns"] = (live.select(*columns), fold_edges)
        touched += [edges.select(F.col(c).alias("id")) for c in ("from_id", "to_id")]
        stored = store.read("claim", base).columns
        claims = claim_rows(edges, said.kind, now)
        changes["claim"] = (claims.select(*[c for c in stored if c in claims.columns]), upsert_claims)
    version = store.change(changes, fence=fence, base=base)
    ids = touched[0] if touched else store.spark.createDataFrame([], "id string")
    for more in touched[1:]:
        ids = ids.unionByName(more)
    return version, ids.distinct()


def apply_merges(store: Store, plan: DataFrame, at: Column, fence: int | None = None) -> Version:
    """A plan (``dup_id, keep_id``) carried out in one version: entities, edges, claims, forwarding ids and the log."""
    base = store.latest()
    plan = cut(collapse_plan(plan.select("dup_id", "keep_id", F.lit("merge").alias("reason"))).select("dup_id", "keep_id"))
    ids = lambda: plan.select(F.col("dup_id").alias("id")).unionByName(plan.select(F.col("keep_id").alias("id"))).distinct()
    named = cut(store.lookup("entity", ids(), base))
    # Of a plan, only what is still there is merged.
    there = named.select("id")
    plan = cut(plan.join(there.withColumnRenamed("id", "dup_id"), "dup_id", "left_semi").join(there.withColumnRenamed("id", "keep_id"), "keep_id", "left_semi"))
    if plan.isEmpty():
        return base
    both = ids()
    named = named.join(both, "id", "left_semi")
    made = {}
    table = base.tables["entity"]
    buckets = store.touched(table, both)
    rows = store.read("entity", base, buckets)
    kept = rows.join(both, "id", "left_anti").select(*rows.columns)
    made["entity"] = store.write(table, merge_entities(named, plan).select(*rows.columns).unionByName(kept), buckets)

    def moved(name: str, rewrite) -> None:
        """Rows with a merged end lie in other buckets afterwards; both the old and the new ones are written."""
        table, rows = base.tables[name], store.read(name, base)
        gone = plan.select(F.col("dup_id").alias("_gone"))
        hit = rows.join(gone, F.col("from_id") == F.col("_gone"), "left_semi").unionByName(rows.join(gone, F.col("to_id") == F.col("_gone"), "left_semi"))
        places = sorted({*store.touched(table, hit), *store.touched(table, rewrite(hit))})
        if places:
            made[name] = store.write(table, rewrite(store.read(name, base, places)).select(*rows.columns), places)

    # Pairs that lose or gain an edge are found by their ends alone; other pairs stay as they are.
    owns, table = store.read("owns", base), base.tables["owns"]
    ends = owns.select("from_id", "to_id")
    gone = [ends.join(plan.select(F.col("dup_id").alias(c)), c, "left_semi").select("from_id", "to_id") for c in ("from_id", "to_id")]
    old = cut(gone[0].unionByName(gone[1]).distinct())
    new = cut(rewrite_endpoints(old, plan).distinct())
    if buckets := sorted({*store.touched(table, old), *store.touched(table, new)}):
        # Both branches read one shuffle of the rows; all that a moved edge may meet is in the first.
        marks = old.unionByName(new).distinct().withColumn("_mark", F.lit(True))
        told = store.read("owns", base, buckets).withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
        told = told.withColumn("_hit", F.max("_mark").over(Window.partitionBy("from_id", "to_id"))).where("NOT _mark")
        tidied = _tidy(rewrite_endpoints(told.where("_hit").select(*owns.columns), plan, ("from_id", "to_id")))
        made["owns"] = store.write(table, tidied.unionByName(told.where("NOT _hit").select(*owns.columns)), buckets)
    moved("claim", lambda rows: _one_claim(with_claim_key(rewrite_endpoints(rows, plan).drop("claim_key"))).select(*rows.columns))
    new = plan.select(F.col("dup_id").alias("old_id"), F.col("keep_id").alias("new_id"))
    table = base.tables["merged_id"]
    stale = store.read("merged_id", base).join(new.select(F.col("old_id").alias("new_id")), "new_id", "left_semi")
    buckets = store.touched(table, new.select("old_id").unionByName(stale.select("old_id")))
    made["merged_id"] = store.write(table, collapse_forwarding(store.read("merged_id", base, buckets), new), buckets)
    log, table = merge_log_rows(plan, named, at), base.tables["merge_log"]
    buckets = store.touched(table, log)
    made["merge_log"] = store.write(table, _counted(store.read("merge_log", base, buckets), log), buckets)
    return store.commit(base, made, fence=fence)


def _tidy(edges: DataFrame) -> DataFrame:
    """Of active edges of one pair the best one stays, as after every import."""
    return dedup_owns(edges).select(*edges.columns).unionByName(edges.where("until IS NOT NULL"))


def _one_claim(claims: DataFrame) -> DataFrame:
    """Claims that merged ends made equal are one: seen first when the first was, else what the latest says."""
    values = [c for c in claims.columns if c not in ("claim_key", "first_seen_at")]
    last = F.max(F.struct("last_seen_at", *[c for c in values if c != "last_seen_at"]))
    return claims.groupBy("claim_key").agg(F.min("first_seen_at").alias("first_seen_at"), last.alias("v")).select("claim_key", "first_seen_at", "v.*")


def _counted(log: DataFrame, new: DataFrame) -> DataFrame:
    """Log rows with those of one survivor and lost name counted together; the latest says when and which id."""
    rows = log.withColumn("_new", F.lit(0)).unionByName(new.select(*log.columns).withColumn("_new", F.lit(1)))
    last = F.max_by(F.struct("keep_name", "dup_id", "at"), F.struct("_new", "at", "dup_id"))
    folded = rows.groupBy("keep_id", "dup_name").agg(F.sum("count").cast("int").alias("count"), last.alias("v"))
    return folded.select("keep_id", "dup_name", "count", "v.*").select(*log.columns)


def touched_merge_plan(entities: DataFrame, touched: DataFrame, separate: DataFrame, name: str = "name_normalized") -> DataFrame:
    """Sure merges around touched entities: those of one identifier, then those of one name."""
    hit = entities.join(touched.select("id"), "id", "left_semi")
    some = None
    for column in HARD_IDS:
        values = hit.where(F.coalesce(F.col(column), F.lit("")) != "").select(column).distinct()
        part = entities.join(values, column, "left_semi").select(*entities.columns)
        some = part if some is None else some.unionByName(part)
    by_id = merge_plan(some.dropDuplicates(["id"]), separate).select("dup_id", "keep_id")
    by_name = scoped_merge_plan(entities, touched, separate, name).select("dup_id", "keep_id")
    every = by_id.withColumn("_n", F.lit(0)).unionByName(by_name.withColumn("_n", F.lit(1)))
    return every.groupBy("dup_id").agg(F.min_by("keep_id", F.struct("_n", "keep_id")).alias("keep_id"))


def run_import(store: Store, said: Said, now: str, fence: int | None = None) -> dict:
    """Folds in what a source says and merges what is surely one around it; tells what came of it."""
    version, touched = fold_said(store, said, F.lit(now), fence)
    touched = cut(touched)
    entities = store.read("entity", version)
    separate = store.read("not_duplicate", version).select("a", "b")
    plan = cut(touched_merge_plan(entities, touched, separate))
    merges = plan.count()
    if merges:
        version = apply_merges(store, plan, F.lit(now), fence)
    return {"version": version.number, "touched": touched, "merges": merges}
