"""Paths and reachability: ownership trees, families, forwarding ids.

Recursion is an iterative join that stops at a clamped depth or an empty frontier; each
round's frontier is checkpointed, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stakeweave.operators.edges import is_direct, limited

MAX_DEPTH = 10


def cut(frame: DataFrame) -> DataFrame:
    """``frame`` checkpointed in the session's shared folder."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local master may do without one (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="stakeweave-"))
    return context.getCheckpointDir()


def ownership_tree(edges: DataFrame, roots: DataFrame, depth: int = 3, include_indirect: bool = False, most: int | None = None) -> DataFrame:
    """All trails of 1 to ``depth`` edges from each root (column ``id``); no trail repeats an edge.

    Indirect edges are left out before the search, which is the same as testing every hop.  With ``most`` a root keeps
    its first trails, shorter ones first, then by their edges; ``truncated`` tells whether it has more.  As no trail
    beyond a level's first ``most + 1`` can be among them, each level goes on from these alone.

    ``edges`` are read once, whatever the depth: three columns of the direct ones are written to the checkpoint folder, and
    every level joins its frontier with these.
    """
    depth = max(1, min(int(depth), MAX_DEPTH))
    kept = edges if include_indirect else edges.where(is_direct())
    step = kept.select(F.col("from_id").alias("_from"), F.col("to_id").alias("_to"), F.col("edge_id").alias("_edge"))
    step = cut(step.where("_from IS NOT NULL")) if depth > 1 else step
    frontier = roots.select(F.col("id").alias("root_id"), F.col("id").alias("node_id"), F.array().cast("array<string>").alias("edge_path"),
                            F.array("id").alias("node_path"))
    found = None
    for level in range(1, depth + 1):
        grown = frontier.join(step, F.col("node_id") == F.col("_from")).where(~F.array_contains("edge_path", F.col("_edge")))
        frontier = grown.select(
            "root_id", F.col("_to").alias("node_id"), F.array_append("edge_path", F.col("_edge")).alias("edge_path"),
            F.array_append("node_path", F.col("_to")).alias("node_path"),
        )
        if most is not None:
            place = F.row_number().over(Window.partitionBy("root_id").orderBy(F.array_join("edge_path", ">")))
            frontier = cut(frontier.withColumn("_n", place).where(F.col("_n") <= most + 1).drop("_n"))
        elif level < depth and level % 3 == 0:
            frontier = cut(frontier)
        part = frontier.withColumn("depth", F.lit(level))
        found = part if found is None else found.unionByName(part)
    if most is None:
        return found
    return limited(found, "root_id", [F.col("depth"), F.array_join("edge_path", ">")], most)


def reachable(pairs: DataFrame, seeds: DataFrame, start: str, end: str) -> DataFrame:
    """Distinct ``seed, id`` reached from each seed (column ``id``) along ``start -> end``, the seed included.

    Rounds go on until nothing new is found; known ids end cycles.
    """
    step = pairs.select(F.col(start).alias("_from"), F.col(end).alias("_to")).distinct()
    known = cut(seeds.select(F.col("id").alias("seed"), "id").distinct())
    frontier = known
    while True:
        grown = frontier.join(step, F.col("id") == F.col("_from")).select("seed", F.col("_to").alias("id")).distinct()
        frontier = cut(grown.join(known, ["seed", "id"], "left_anti"))
        if frontier.isEmpty():
            return known
        known = cut(known.unionByName(frontier))


def family(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds with all their descendants and all their ancestors, not the siblings of ancestors."""
    down = reachable(pairs, seeds, "from_id", "to_id")
    up = reachable(pairs, seeds, "to_id", "from_id")
    return down.unionByName(up).distinct()


def resolve_forwarding(merged: DataFrame, live: DataFrame, ids: DataFrame, hops: int = 5) -> DataFrame:
    """``id, current_id``: a live id is itself; else forwarding is followed for up to ``hops``; a cycle or a dead end is null."""
    alive = live.select(F.col("id").alias("_live")).distinct()
    step = merged.select(F.col("old_id").alias("_old"), F.col("new_id").alias("_new"))
    at = ids.select("id", F.col("id").alias("_at"))
    at = at.join(alive, F.col("_at") == F.col("_live"), "left").select("id", "_at", F.col("_live").alias("current_id"))
    for _ in range(hops):
        moved = at.join(step, F.col("_at") == F.col("_old"), "left").select("id", F.col("_new").alias("_next"), "_at", "current_id")
        moved = moved.join(alive, F.col("_next") == F.col("_live"), "left")
        at = moved.select("id", F.when(F.col("current_id").isNull(), F.col("_next")).otherwise(F.col("_at")).alias("_at"),
                          F.coalesce("current_id", "_live").alias("current_id"))
    return at.select("id", "current_id")


def collapse_forwarding(merged: DataFrame, new: DataFrame) -> DataFrame:
    """``merged`` after the merges in ``new``: rows that pointed at a merged id point at its survivor; new rows win."""
    moved = new.select(F.col("old_id").alias("_m_old"), F.col("new_id").alias("_m_new"))
    kept = merged.join(new.select("old_id"), "old_id", "left_anti").join(moved, F.col("new_id") == F.col("_m_old"), "left")
    kept = kept.withColumn("new_id", F.coalesce("_m_new", "new_id")).drop("_m_old", "_m_new")
    return kept.unionByName(new.select(*merged.columns))
