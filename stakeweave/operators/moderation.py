"""Flags, suppressions, pins and the run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOTE_LENGTH = 1000
TARGET = ("target_kind", "from_id", "to_id", "role", "node_id")


def target_is(node_id: str | None = None, from_id: str | None = None, to_id: str | None = None, role: str | None = None) -> Column:
    """Rows about one node, or one edge with its role if given."""
    if node_id is not None:
        return F.col("node_id") == node_id
    out = (F.col("from_id") == from_id) & (F.col("to_id") == to_id)
    return out if role is None else out & (F.col("role") == role)


def list_flags(flags: DataFrame, status: str | None = None, kind: str | None = None, category: str | None = None, most: int = 1000) -> DataFrame:
    """Flags that match all given filters, newest first."""
    for column, value in (("status", status), ("target_kind", kind), ("category", category)):
        if value is not None:
            flags = flags.where(F.col(column) == value)
    return flags.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(most)


def group_flags(flags: DataFrame, newest: int = 1000) -> DataFrame:
    """The newest flags by target and category: count, latest time, first note; most reported first."""
    rows = list_flags(flags, most=newest)
    keys = [*TARGET, "category"]
    note = F.nullif("note", F.lit(""))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("created_at").alias("created_at"),
        F.max_by(note, F.when(note.isNotNull(), F.struct("created_at", "id"))).alias("note"), F.array_sort(F.collect_list("id")).alias("ids"),
    ).orderBy(F.col("n").desc(), F.col("created_at").desc())


def open_flag_counts(flags: DataFrame) -> DataFrame:
    return flags.where("status = 'open'").groupBy(*TARGET).agg(F.count(F.lit(1)).alias("n"))


def collapse_reports(flags: DataFrame) -> DataFrame:
    """Open or reviewed reports of one reporter about one target and category, the first of each."""
    order = Window.partitionBy(*TARGET, "category", "reporter_id").orderBy("created_at", "id")
    return flags.where("status IN ('open', 'reviewing')").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def create_flag(flags: DataFrame, new: DataFrame) -> DataFrame:
    cut = new.withColumn("note", F.substring("note", 1, NOTE_LENGTH))
    return flags.unionByName(cut, allowMissingColumns=True)


def set_flag_status(flags: DataFrame, ids: list[str], status: str) -> DataFrame:
    return flags.withColumn("status", F.when(F.col("id").isin(ids), status).otherwise(F.col("status")))


def delete_flags(flags: DataFrame, ids: list[str]) -> DataFrame:
    return flags.where(~F.col("id").isin(ids))


def suppress(suppressions: DataFrame, flags: DataFrame, edges: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables after the targets of ``chosen`` flags are suppressed: a node is hidden, an active edge goes as well, its open flags are resolved."""
    targets = chosen.select(*TARGET).distinct()
    new = targets.join(suppressions, _same(targets, suppressions), "left_anti")
    hidden = suppressions.unionByName(new, allowMissingColumns=True)
    gone = targets.where("target_kind <> 'node'").select(F.col("from_id").alias("_f"), F.col("to_id").alias("_t"), F.col("role").alias("_r"))
    match = (F.col("from_id") == F.col("_f")) & (F.col("to_id") == F.col("_t")) & F.col("until").isNull()
    if "role" in edges.columns:
        match &= F.col("_r").isNull() | (F.col("_r") == F.col("role"))
    left = edges.join(gone, match, "left_anti")
    t = targets.select(*[F.col(c).alias(f"_{c}") for c in TARGET], F.lit(True).alias("_hit"))
    same = F.lit(True)
    for c in TARGET:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    resolved = flags.join(t, same, "left").withColumn("status", F.when(F.col("_hit") & (F.col("status") == "open"), "resolved").otherwise(F.col("status")))
    return hidden, resolved.select(*flags.columns), left


def _same(a: DataFrame, b: DataFrame) -> Column:
    out = F.lit(True)
    for c in TARGET:
        out &= a[c].eqNullSafe(b[c])
    return out


def upsert_pins(pins: DataFrame, new: DataFrame) -> DataFrame:
    """A new pin's values replace those of an existing pin where they are not null."""
    n = new.select("from_id", "to_id", F.col("stake_percent").alias("_s"), F.col("ownership_type").alias("_t"))
    both = pins.join(n, ["from_id", "to_id"], "full")
    out = both.withColumn("stake_percent", F.coalesce("_s", "stake_percent")).withColumn("ownership_type", F.coalesce("_t", "ownership_type"))
    return out.select(*pins.columns)


def remove_suppressions(suppressions: DataFrame, ids: list[str]) -> DataFrame:
    return suppressions.where(~F.col("id").isin(ids))


def remove_pins(pins: DataFrame, ids: list[str]) -> DataFrame:
    return pins.where(~F.col("id").isin(ids))


def run_listing(runs: DataFrame, now: Column, most: int = 500, stale_after: int = 1800) -> DataFrame:
    """Newest runs first; a run that has been running too long is stale."""
    age = F.unix_seconds(now) - F.unix_seconds(F.col("started_at").cast("timestamp"))
    status = F.when((F.col("status") == "running") & (age > stale_after), "stale").otherwise(F.col("status"))
    return runs.withColumn("status", status).orderBy(F.col("started_at").desc(), "id").limit(most)


def prune_runs(runs: DataFrame, keep: int = 500) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), "id").limit(keep)


def rate_limited(events: DataFrame, key: str, stamp: str, most: int, seconds: int = 3600) -> DataFrame:
    """Events with the number of their key's events in the window that ends with each, and whether it is over the limit."""
    window = Window.partitionBy(key).orderBy(F.unix_micros(F.col(stamp).cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("in_window", F.count(F.lit(1)).over(window)).withColumn("limited", F.col("in_window") > most)
