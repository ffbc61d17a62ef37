"""Edges: predicates, overlays, deduplication, expansion and counts.

Edge tables have ``edge_id, from_id, to_id`` and properties.  Every choice among equals
ends in ``edge_id``.  Overlay tables (suppressions and pins) are joined without a
broadcast hint: adaptive execution broadcasts them by their measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FREE_FLOAT_MIN = 0.5
OVER_100_TOLERANCE = 0.5


def is_active() -> Column:
    return F.col("until").isNull()


def is_direct() -> Column:
    return F.coalesce(F.col("direct_or_indirect") != "indirect", F.lit(True))


def without_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("from_id <> to_id")


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("from_id = to_id")


def drop_suppressed(edges: DataFrame, suppressions: DataFrame, kind: str) -> DataFrame:
    """Edges that no suppression of ``kind`` names; a suppression without a role hides every role."""
    hidden = suppressions.where(F.col("target_kind") == kind)
    keys = hidden.select(F.col("from_id").alias("_s_from"), F.col("to_id").alias("_s_to"), F.col("role").alias("_s_role"))
    same = (F.col("from_id") == F.col("_s_from")) & (F.col("to_id") == F.col("_s_to"))
    if kind == "role":
        same &= F.col("_s_role").isNull() | (F.col("_s_role") == F.col("role"))
    return edges.join(keys, same, "left_anti")


def drop_hidden_nodes(rows: DataFrame, suppressions: DataFrame, *columns: str) -> DataFrame:
    """Rows none of whose node columns is a suppressed node."""
    for column in columns:
        nodes = suppressions.where("target_kind = 'node'").select(F.col("node_id").alias("_hidden")).distinct()
        rows = rows.join(nodes, F.col(column) == F.col("_hidden"), "left_anti")
    return rows


def apply_pins(edges: DataFrame, pins: DataFrame) -> DataFrame:
    """A pin's fields that are not null replace the edge's."""
    p = pins.select(
        F.col("from_id").alias("_p_from"), F.col("to_id").alias("_p_to"),
        F.col("stake_percent").alias("_p_stake"), F.col("ownership_type").alias("_p_type"),
    )
    joined = edges.join(p, (F.col("from_id") == F.col("_p_from")) & (F.col("to_id") == F.col("_p_to")), "left")
    kept = [c for c in edges.columns if c not in ("stake_percent", "ownership_type")]
    out = joined.select(
        *kept, F.coalesce("_p_stake", "stake_percent").alias("stake_percent"),
        (F.coalesce("_p_type", "ownership_type") if "ownership_type" in edges.columns else F.col("_p_type")).alias("ownership_type"),
    )
    return out


def largest_stake(edges: DataFrame, *keys: str) -> DataFrame:
    """One edge per key: the largest stake, a missing or zero stake last."""
    order = Window.partitionBy(*keys).orderBy(F.coalesce(F.nullif("stake_percent", F.lit(0.0)), F.lit(-1.0)).desc(), "edge_id")
    return edges.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def latest_tenure(roles: DataFrame, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.coalesce("since", F.lit("")).desc(), "edge_id")
    return roles.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def dedup_owns(edges: DataFrame) -> DataFrame:
    """Active edges, one per pair: the largest stake, then one that states direct or indirect."""
    order = Window.partitionBy("from_id", "to_id").orderBy(
        F.coalesce("stake_percent", F.lit(-1.0)).desc(), F.col("direct_or_indirect").isNull(), "edge_id"
    )
    return edges.where(is_active()).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def duplicate_owns_stats(edges: DataFrame) -> DataFrame:
    """Active edges, distinct pairs, pairs with more than one edge, and the edges too many."""
    pairs = edges.where(is_active()).groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("active_edges"), F.count(F.lit(1)).alias("distinct_pairs"),
        F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("duplicate_pairs"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant_edges"),
    )


def current_owners(edges: DataFrame, suppressions: DataFrame, pins: DataFrame) -> DataFrame:
    """Active owners of every entity as a profile shows them: no self loops, overlays applied, largest stake."""
    active = without_self_loops(edges.where(is_active()))
    shown = drop_hidden_nodes(drop_suppressed(active, suppressions, "owns"), suppressions, "from_id", "to_id")
    return largest_stake(apply_pins(shown, pins), "from_id", "to_id")


def ownership_summary(owners: DataFrame) -> DataFrame:
    """Per owned entity: disclosed share, free float, owners without a stake, and whether shares exceed 100."""
    grouped = owners.groupBy("to_id").agg(
        F.round(F.sum("stake_percent"), 4).alias("disclosed_pct"),
        F.sum(F.col("stake_percent").isNull().cast("long")).alias("unknown_owners"),
        F.count(F.lit(1)).alias("n_owners"),
    )
    exceeds = F.coalesce(F.col("disclosed_pct") > 100.0 + OVER_100_TOLERANCE, F.lit(False))
    rest = F.round(100.0 - F.col("disclosed_pct"), 4)
    shown = (F.col("unknown_owners") == 0) & ~exceeds & (rest >= FREE_FLOAT_MIN)
    return grouped.select(
        F.col("to_id").alias("entity_id"), "disclosed_pct", F.when(shown, rest).alias("free_float_pct"), "unknown_owners",
        exceeds.alias("exceeds_100"), "n_owners",
    )


def cross_holdings(edges: DataFrame) -> DataFrame:
    """Pairs of entities that own each other, ended edges and repeats included."""
    a = edges.select(F.col("edge_id").alias("edge_ab"), F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    b = edges.select(F.col("edge_id").alias("edge_ba"), F.col("from_id").alias("b"), F.col("to_id").alias("a"))
    return a.join(b, ["a", "b"]).where("a < b").select("a", "b", "edge_ab", "edge_ba")


def profile_cross_holdings(owners: DataFrame) -> DataFrame:
    """Neighbours that are both owner and subsidiary, from owners as a profile shows them."""
    owned = owners.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    return owners.join(owned, ["from_id", "to_id"], "left_semi").select(F.col("to_id").alias("entity_id"), F.col("from_id").alias("other_id"))


def section_counts(entities: DataFrame, owns: DataFrame, roles: DataFrame, dual: DataFrame, succession: DataFrame) -> DataFrame:
    """Distinct neighbours of every entity in each section of its profile."""
    active, held = owns.where(is_active()), roles.where(is_active())

    def count(edges: DataFrame, node: str, other: str, name: str) -> DataFrame:
        return edges.groupBy(F.col(node).alias("id")).agg(F.count_distinct(other).alias(name))

    parts = [
        count(active, "to_id", "from_id", "owners"), count(active, "from_id", "to_id", "subsidiaries"), count(held, "to_id", "from_id", "executives"),
        count(dual, "from_id", "to_id", "dual_listed"), count(succession, "from_id", "to_id", "succeeded_by"), count(succession, "to_id", "from_id", "replaces"),
    ]
    out = entities.select("id")
    for part in parts:
        out = out.join(part, "id", "left")
    return out.select("id", *[F.coalesce(part.columns[1], F.lit(0)).cast("long").alias(part.columns[1]) for part in parts])


def edges_by_neighbour(edges: DataFrame, node: str, other: str, most: int | None = None) -> DataFrame:
    """Edges collected per neighbour of a node, so that a limit counts neighbours and not edges."""
    grouped = edges.groupBy(node, other).agg(F.array_sort(F.collect_list(F.struct("edge_id", "stake_percent", "since", "until"))).alias("rels"))
    if most is None:
        return grouped
    order = Window.partitionBy(node).orderBy(other)
    return grouped.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def limited(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows of each key in order, and whether more exist."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    # One row more than asked tells whether there are more; a hub's other rows are dropped before they are shuffled.
    some = rows.withColumn("_n", place).where(F.col("_n") <= most + 1)
    told = some.withColumn("truncated", F.max("_n").over(Window.partitionBy(key)) > most)
    return told.where(F.col("_n") <= most).drop("_n")


def history(owns: DataFrame, roles: DataFrame, most: int) -> DataFrame:
    """Ownership in and out and roles of every entity; each kind is limited on its own, ended edges included."""
    parts = []
    for kind, edges, node, other in (
        ("ownership_in", owns, "to_id", "from_id"), ("ownership_out", owns, "from_id", "to_id"), ("role", roles, "to_id", "from_id"),
    ):
        missing = F.lit(None)
        part = edges.select(
            F.col(node).alias("entity_id"), F.lit(kind).alias("kind"), F.col(other).alias("party_id"), "since", "until",
            (F.col("stake_percent") if "stake_percent" in edges.columns else missing.cast("double")).alias("stake_percent"),
            (F.col("role") if "role" in edges.columns else missing.cast("string")).alias("role"), "edge_id",
        )
        parts.append(limited(part, "entity_id", [F.col("edge_id")], most))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("active", F.col("until").isNull())


def person_positions(roles: DataFrame, entities: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Current positions of every person: one per entity and role, the latest tenure."""
    shown = drop_hidden_nodes(drop_suppressed(roles.where(is_active()), suppressions, "role"), suppressions, "to_id", "from_id")
    named = entities.select(F.col("id").alias("to_id"), F.col("name").alias("entity_name"))
    return latest_tenure(shown, "from_id", "to_id", "role").join(named, "to_id")


def person_holdings(owns: DataFrame, entities: DataFrame, suppressions: DataFrame, pins: DataFrame) -> DataFrame:
    """Current holdings of every person; pins apply after the largest stake is chosen."""
    shown = drop_hidden_nodes(drop_suppressed(owns.where(is_active()), suppressions, "owns"), suppressions, "to_id", "from_id")
    named = entities.select(F.col("id").alias("to_id"), F.col("name").alias("entity_name"))
    return apply_pins(largest_stake(shown, "from_id", "to_id"), pins).join(named, "to_id")


def executives(roles: DataFrame, suppressions: DataFrame) -> DataFrame:
    """One row per entity, person and role: the first by edge id."""
    shown = drop_hidden_nodes(drop_suppressed(roles.where(is_active()), suppressions, "role"), suppressions, "from_id", "to_id")
    order = Window.partitionBy("to_id", "from_id", "role").orderBy("edge_id")
    return shown.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def role_without_stake(roles: DataFrame, owns: DataFrame, most: int = 15) -> DataFrame:
    """People with a role but no ownership edge at the same entity, at most ``most`` an entity."""
    out = roles.select("from_id", "to_id").join(owns.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")
    # Ranks without gaps count people, not roles, so only what the limit leaves is made distinct: no task holds a table of all its pairs.
    place = F.dense_rank().over(Window.partitionBy("to_id").orderBy("from_id"))
    return out.withColumn("_n", place).where(F.col("_n") <= most).select("from_id", "to_id").distinct()


def current_first(roles: DataFrame, key: str, most: int = 3) -> DataFrame:
    """Current tenures before ended ones, later ones first, at most ``most`` a key."""
    return limited(roles, key, [F.col("until").isNotNull(), F.coalesce("since", F.lit("")).desc(), F.col("edge_id")], most).drop("truncated")


def make_symmetric(pairs: DataFrame) -> DataFrame:
    """Every pair in both directions, once each."""
    swapped = pairs.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    return pairs.select("from_id", "to_id").unionByName(swapped).distinct()
