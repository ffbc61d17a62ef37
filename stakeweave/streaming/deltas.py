"""Relationship deltas: idempotent upserts and retirements in micro-batches, over tables in buckets."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stakeweave.functions.dates import WINDOWS, catchup_interval
from stakeweave.operators.store import Store
from stakeweave.operators.upsert import last_of_key
from stakeweave.sources.gleif import RR_SCHEMA, delta_edges

_KEY = ["from_id", "to_id", "direct_or_indirect"]


def apply_delta(edges: DataFrame, upserts: DataFrame, closures: DataFrame, sequence: str | None = None) -> DataFrame:
    """All upserts, then all closures.  A reopened edge loses its end, a known start stays, nothing is deleted.

    Of several upserts of one edge the last by ``sequence`` counts, or the greatest where there is none.
    """
    new = last_of_key(upserts, _KEY, sequence)
    n = new.select(*_KEY, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c not in _KEY], F.lit(True).alias("_new"))
    both = edges.join(n, _KEY, "full")
    out = []
    for c in edges.columns:
        if c in _KEY or c not in new.columns:
            out.append(F.col(c))
        elif c == "until":
            out.append(F.when(F.col("_new"), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c))
        elif c in ("since", "edge_id"):
            out.append(F.coalesce(c, f"_n_{c}").alias(c))
        else:
            out.append(F.coalesce(f"_n_{c}", c).alias(c))
    merged = both.select(*out)
    ends = closures.groupBy(*_KEY).agg(F.max("until").alias("_until"))
    return merged.join(ends, _KEY, "left").withColumn("until", F.coalesce("_until", "until")).select(*edges.columns)


def in_file_order(records: DataFrame) -> DataFrame:
    """Records of files with ``_sequence``: where they stand, files in order of their change and name."""
    at = F.struct("_metadata.file_modification_time", "_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id())
    return records.select("*", at.alias("_sequence"))


def fold_delta(store: Store, name: str, upserts: DataFrame, closures: DataFrame, tags: dict[str, str] | None = None, fence: int | None = None) -> None:
    """Upserts and closures into the edge table ``name`` of a store: only buckets with their keys are read and written."""
    marked = upserts.withColumn("_closes", F.lit(False)).unionByName(closures.withColumn("_closes", F.lit(True)), allowMissingColumns=True)
    sequence = "_sequence" if "_sequence" in upserts.columns else None

    def fold(stored: DataFrame, delta: DataFrame) -> DataFrame:
        return apply_delta(stored, delta.where("NOT _closes").select(*upserts.columns), delta.where("_closes").select(*closures.columns), sequence)

    store.change({name: (marked, fold)}, tags, fence)


def stream_deltas(
    spark: SparkSession, folder: str, store: Store, name: str, checkpoint: str, source_id: str, credibility: int = 92, today: str | None = None
) -> StreamingQuery:
    """Apply every NDJSON delta file that lands in ``folder`` to the edge table ``name`` of ``store``, once each.

    A batch's number is part of the version that it makes, so a batch that is replayed after a crash finds that it
    has been applied.
    """
    day = F.lit(today) if today else F.current_date().cast("string")
    tag = f"batch:{name}:{checkpoint}"

    def batch(frame: DataFrame, number: int) -> None:
        if int(store.latest().tags.get(tag, -1)) >= number:
            return
        # Rows of one file block come in order, and blocks are told apart by where they begin.
        ordered = frame.withColumn("_sequence", F.struct("_file", F.monotonically_increasing_id())).drop("_file")
        upserts, closures = delta_edges(ordered, source_id, credibility, day)
        fold_delta(store, name, upserts, closures, {tag: str(number)})

    place = F.struct("_metadata.file_modification_time", "_metadata.file_name", "_metadata.file_block_start")
    stream = spark.readStream.schema(RR_SCHEMA).json(folder).select("*", place.alias("_file"))
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def catch_up(
    store: Store, name: str, published: DataFrame, source: str, source_id: str, credibility: int = 92, today: str | None = None, fence: int | None = None
) -> dict:
    """Bring the edge table ``name`` up to the newest of ``published`` (``published, window, path``; a row a file).

    The store remembers which publication it has seen last.  The narrowest window that covers the gap since then
    is applied; where its file is missing, a wider one is.  If none covers the gap or is there, or the
    table was never loaded in full, nothing changes but for a note in the store that asks for a full load.
    Returns what was done: ``status`` is old, applied or reload.
    """
    base = store.latest()
    seen = base.tags.get(f"published:{source}")
    rows = published.where(F.try_to_timestamp(F.trim("published"), F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()).select(F.trim("published").alias("published"), "window", "path")
    current = rows.agg(F.max("published")).first()[0]
    if current is None or (seen is not None and current <= seen):
        return {"status": "old", "published": seen}
    window = store.spark.range(1).select(catchup_interval(F.lit(seen).cast("string"), F.lit(current)).alias("w")).first().w
    names = [w for w, _ in WINDOWS]
    wide = names[names.index(window) :] if window else []
    found = {r.window: r.path for r in rows.where(F.col("published") == current).collect()} if name in base.tables else {}  # a row for each window
    day = F.lit(today) if today else F.current_date().cast("string")
    for w in wide:
        if w not in found:
            continue
        try:
            records = in_file_order(store.spark.read.schema(RR_SCHEMA).json(found[w]))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        upserts, closures = delta_edges(records, source_id, credibility, day)
        fold_delta(store, name, upserts, closures, {f"published:{source}": current, f"reload:{source}": ""}, fence)
        return {"status": "applied", "window": w, "published": current}
    store.commit(base, {}, {f"reload:{source}": current}, fence)
    return {"status": "reload", "published": seen}


def stream_publications(
    spark: SparkSession, folder: str, store: Store, name: str, checkpoint: str, source: str, source_id: str, credibility: int = 92, today: str | None = None
) -> StreamingQuery:
    """``catch_up`` for the announcements (NDJSON of ``published, window, path``) that land in ``folder``.

    What was seen last is kept with the data, so replayed, late and repeated announcements do nothing.
    """

    def batch(frame: DataFrame, _: int) -> None:
        catch_up(store, name, frame, source, source_id, credibility, today)

    stream = spark.readStream.schema("published string, window string, path string").json(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
