"""Whole profiles as nested rows: every section is its own plan, limited per entity, then joined by id.

Sections add up; they never multiply.  A section holds at most ``most`` neighbours, so no row
grows without bound, while the counts beside it are complete.  The ownership that a profile shows is written once and read by its sections.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeweave.operators.edges import (
    current_owners, drop_hidden_nodes, executives, limited, ownership_summary, person_holdings, person_positions, profile_cross_holdings, section_counts,
)
from stakeweave.operators.tree import checkpoint_folder

SECTION_LIMIT = 200


def _section(rows: DataFrame, node: str, other: str, fields: list[str], name: str, most: int) -> DataFrame:
    """``id, name``: the neighbours of each node in order of id, at most ``most``."""
    capped = limited(rows, node, [F.col(other)], most)
    item = F.struct(F.col(other).alias("id"), *fields)
    return capped.groupBy(F.col(node).alias("id")).agg(F.sort_array(F.collect_list(item)).alias(name))


def _written(rows: DataFrame) -> DataFrame:
    """``rows`` from the checkpoint folder, as columns of which each reader takes what it needs."""
    path = f"{checkpoint_folder(rows.sparkSession)}/shown-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def entity_profiles(
    entities: DataFrame, owns: DataFrame, roles: DataFrame, dual: DataFrame, succession: DataFrame, suppressions: DataFrame, pins: DataFrame, most: int = SECTION_LIMIT
) -> DataFrame:
    """One row per entity that is not hidden: itself, counts, owners, ownership, cross holdings, subsidiaries, executives, listings, succession."""
    shown = _written(current_owners(owns, suppressions, pins).select("from_id", "to_id", "stake_percent", "since"))
    counts = section_counts(entities, owns, roles, dual, succession)
    counts = counts.select("id", F.struct(*[c for c in counts.columns if c != "id"]).alias("counts"))
    summary = ownership_summary(shown)
    summary = summary.select(F.col("entity_id").alias("id"), F.struct(*[c for c in summary.columns if c != "entity_id"]).alias("ownership"))
    seen = lambda edges, column: drop_hidden_nodes(edges, suppressions, column)
    sections = [
        _section(shown, "to_id", "from_id", ["stake_percent", "since"], "owners", most),
        _section(shown, "from_id", "to_id", ["stake_percent", "since"], "subsidiaries", most),
        _section(executives(roles, suppressions), "to_id", "from_id", ["role", "since"], "executives", most),
        _section(profile_cross_holdings(shown), "entity_id", "other_id", [], "cross_holdings", most),
        _section(dual, "from_id", "to_id", [], "dual_listed", most),
        _section(seen(succession, "to_id"), "from_id", "to_id", ["since"], "succeeded_by", most),
        _section(seen(succession, "from_id"), "to_id", "from_id", ["since"], "replaces", most),
    ]
    head = drop_hidden_nodes(entities, suppressions, "id").select("id", F.struct(*entities.columns).alias("entity"))
    return reduce(lambda a, b: a.join(b, "id", "left"), [counts, summary, *sections], head)


def person_profiles(persons: DataFrame, entities: DataFrame, owns: DataFrame, roles: DataFrame, suppressions: DataFrame, pins: DataFrame, most: int = SECTION_LIMIT) -> DataFrame:
    """One row per person that is not hidden: itself, current positions and current holdings."""
    positions = _section(person_positions(roles, entities, suppressions), "from_id", "to_id", ["entity_name", "role", "since"], "positions", most)
    holdings = _section(person_holdings(owns, entities, suppressions, pins), "from_id", "to_id", ["entity_name", "stake_percent"], "holdings", most)
    head = drop_hidden_nodes(persons, suppressions, "id").select("id", F.struct(*persons.columns).alias("person"))
    return head.join(positions, "id", "left").join(holdings, "id", "left")
