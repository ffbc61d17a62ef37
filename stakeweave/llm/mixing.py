"""Mixing sources to target weights by Sainte-Laguë apportionment of token blocks.

Every source gets integer numbers of equal-token blocks, awarded one after another to
the highest quotient ``target / (2 * seats + 1)``; the award is computed in closed form
plus at most one step a source.  A source's rows are dealt to shards by a seeded hash,
its blocks are apportioned among them by the same rule with the shards' sizes as
weights, and inside a shard the rows stand in seeded order as one circle of tokens: the
quota takes whole turns of the circle and one run of blocks from a seeded start.

A source has one shard for about ``shard_rows`` rows.  Shards are gathered in at most ``GROUPS`` groups a
source: the driver apportions a source's blocks among the groups, tasks those of a group among its shards.
So the driver holds a row for each source and group, however many rows there are.

Defined results: a null or blank text has size 0 and takes 0 words; null is a source of
its own, last in order; rows that are equal in id, text and source are folded before they are
shuffled and interchangeable; equal quotients go to the earlier source or shard; a text may be of any length; an
empty table gives an empty result; other columns are ignored (``mixed_documents`` carries them through).
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stakeweave.llm.common import cut, text_or_empty, word_count


#: Groups of a source's shards.
GROUPS = 1024


def apportion(weights: Sequence[float], seats: int) -> np.ndarray:
    """Sainte-Laguë seats of each weight; equal quotients go to the earlier weight."""
    w = np.asarray(weights, float)
    won = np.zeros(len(w), np.int64)
    if seats <= 0 or w.sum() <= 0:
        return won
    # Any divisor below the final one awards no more than the final one does.
    won = np.maximum(np.floor(w / w.sum() * seats - 0.5), 0).astype(np.int64)
    quotients = [(-x / (2 * s + 1), i) for i, (x, s) in enumerate(zip(w, won, strict=True)) if x > 0]
    heapq.heapify(quotients)
    left = seats - int(won.sum())
    while left > 0:
        _, i = heapq.heappop(quotients)
        won[i] += 1
        left -= 1
        heapq.heappush(quotients, (-w[i] / (2 * won[i] + 1), i))
    return won


def fill_targets(sizes: Sequence[int], weights: Sequence[float], limit: float = 3.0) -> np.ndarray:
    """Targets in proportion to ``weights`` that sum to the sizes and stop at ``limit`` times a size.

    The excess of capped sources is shared again by weight until none is above its cap.
    """
    s, w = np.asarray(sizes, float), np.asarray(weights, float)
    target, capped, total = np.zeros(len(s)), np.zeros(len(s), bool), s.sum()
    while not capped.all():
        rest = total - (limit * s[capped]).sum()
        target[~capped] = rest * w[~capped] / w[~capped].sum()
        over = ~capped & (target > limit * s)
        target[over] = limit * s[over]
        if not over.any():
            break
        capped |= over
    return target


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (1.0, 2.0, 3.0),
    block: int = 16,
    shard_rows: int = 5_000,
    limit: float = 3.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``id, size, source_size, target, taken`` of every row; ``taken`` counts repeated words."""
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    picked = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("tie"))
    sized = cut(picked.groupBy("id", "source", "size", "tie").agg(F.count(F.lit(1)).alias("copies")))
    whole = F.col("size") * F.col("copies")
    totals = sized.groupBy("source").agg(F.sum(whole).alias("size"), F.count(F.lit(1)).alias("n"))
    totals = totals.toPandas()  # a row for each source
    totals = totals.assign(last=totals["source"].isna()).sort_values(
        ["last", "source"], key=lambda c: c if c.name == "last" else c.map(lambda x: x if isinstance(x, str) else "")
    )
    sizes = totals["size"].astype("int64").tolist()
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], limit)
    seats = apportion(targets, round(float(sum(targets)) / block)) if len(sizes) else np.zeros(0, np.int64)
    names = [x if isinstance(x, str) else None for x in totals["source"]]
    source_rows = [
        (name, int(size), float(target), max(1, -(-int(n) // shard_rows)))
        for name, size, target, n in zip(names, sizes, targets, totals["n"], strict=True)
    ]
    sources = spark.createDataFrame(source_rows, "s_source string, source_size long, target double, shards int")
    kind = sized.schema["id"].dataType.simpleString()
    dealt = sized.join(sources, sized["source"].eqNullSafe(sources["s_source"])).select(
        "id", "source", "size", "source_size", "target", "copies", "tie",
        F.xxhash64("id", "size", "tie", F.lit(seed)).alias("order"),
        F.pmod(F.xxhash64("id", "tie", F.lit(seed + 1)), F.col("shards")).cast("int").alias("shard"),
    )
    parts = dealt.groupBy("source", "shard").agg(F.sum(whole).alias("total"))
    parts = cut(parts.withColumn("part", F.col("shard") % GROUPS))  # a row for each shard
    held = parts.groupBy("source", "part").agg(F.sum("total").alias("total")).toPandas()  # at most GROUPS rows a source
    quota_of = dict(zip(names, seats.tolist(), strict=True))
    given = []
    held = held.assign(source=[x if isinstance(x, str) else None for x in held["source"]]).sort_values("part", kind="stable")
    for name, rows in held.groupby("source", dropna=False, sort=False):
        name = name if isinstance(name, str) else None
        won = apportion(rows["total"].astype("int64").tolist(), quota_of[name])
        given += [(name, int(g), int(n)) for g, n in zip(rows["part"], won, strict=True)]
    given = spark.createDataFrame(given, "g_source string, g_part int, quota long")

    def share(rows: pd.DataFrame) -> pd.DataFrame:
        """Blocks of the shards of one group, and each shard's turns."""
        rows = rows.sort_values("p_shard")
        won = apportion(rows["p_total"].tolist(), int(rows["quota"].iloc[0]))
        turns = [_turns(int(n), int(w) * block, block, limit, seed, int(k)) for n, w, k in zip(rows["p_total"], won, rows["p_shard"], strict=True)]
        return rows[["p_source", "p_shard", "p_total"]].assign(**{c: [t[i] for t in turns] for i, c in enumerate(("turns", "start", "run"))})

    asked = parts.join(given, F.col("source").eqNullSafe(F.col("g_source")) & (F.col("part") == F.col("g_part"))).select(
        F.col("source").alias("p_source"), "part", F.col("shard").alias("p_shard"), F.col("total").alias("p_total"), "quota"
    )
    schema = "p_source string, p_shard int, p_total long, turns long, start long, run long"
    chosen = asked.groupBy("p_source", "part").applyInPandas(share, schema)
    place = Window.partitionBy("source", "shard").orderBy("order", "id", "size", "tie")
    ends = F.sum(whole).over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = dealt.withColumn("last", ends).join(
        chosen, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("shard") == F.col("p_shard"))
    )
    # Copies stand one behind the other.
    placed = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("behind"))
    placed = placed.withColumn("end", F.col("last") - F.col("behind") * F.col("size"))

    def overlap(low, high):
        return F.greatest(F.lit(0).cast("long"), F.least(F.col("end"), high) - F.greatest(F.col("end") - F.col("size"), low))

    stop = F.col("start") + F.col("run")
    once = overlap(F.col("start"), F.least(stop, F.col("p_total"))) + overlap(F.lit(0).cast("long"), stop - F.col("p_total"))
    return placed.select(
        F.col("id").cast(kind).alias(id_col), "size", "source_size", "target",
        (F.col("turns") * F.col("size") + once).cast("long").alias("taken"),
    )


def _turns(size: int, quota: int, block: int, limit: float, seed: int, shard: int) -> tuple[int, int, int]:
    """Whole turns of a shard's circle of ``size`` tokens, and the start and length of a last run."""
    if size <= 0:
        return 0, 0, 0
    quota = min(quota, int(limit * size))
    blocks = -(-size // block)
    start = int(np.random.default_rng([seed, shard, size]).integers(blocks)) * block
    return quota // size, start, quota % size


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: a row once for each time that at least half of its words are taken.

    A row of which the mix takes some words but never half stays out; a row without
    words stays out.  Columns are those of ``docs``.  Ids may repeat or be null: rows are
    matched by a key over id, text and source.
    """
    # The row travels as one column, so no name of its columns can clash.
    keyed = docs.select(F.xxhash64("doc_id", "text", "source").alias("key"), "text", "source", F.struct("*").alias("row"))
    ranked = mix_sources(keyed.select("key", "text", "source"), id_col="key", **options)
    times = ranked.select("key", F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int").alias("times"))
    # Equal rows share a key; their copies are interchangeable, so the largest count serves each.
    times = times.groupBy("key").agg(F.max("times").alias("times")).where("times > 0")
    taken = keyed.join(times, "key").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
