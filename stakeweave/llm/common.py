"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule, as a Java regular expression class.
SPACES = "[\\x20\\x09-\\x0D]"
SPACE_CHARS = (" ", "\t", "\n", "\x0b", "\f", "\r")


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local master may do without one (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="stakeweave-"))
    return context.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """``frame`` as reliably checkpointed rows, so that later jobs don't compute it again."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def positions(frame: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Checkpointed rows of ``frame`` with their place (from 0) in ``order``.

    Rows are dealt to ranges and sorted there; a range's first place is the number of rows in
    the ranges before it, of which the driver holds one count a range.
    """
    spark = frame.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = frame.repartitionByRange(spread, *order).sortWithinPartitions(*order)
    # The id's upper bits are the range, the lower 33 the place in it.
    marked = cut(dealt.withColumn(name, F.monotonically_increasing_id()))
    part, first, starts = F.shiftright(name, 33), 0, []
    for row in marked.groupBy(part.alias("part")).count().orderBy("part").collect():
        starts.append((row["part"], first))
        first += row["count"]
    starts = spark.createDataFrame(starts, f"{name}_part long, {name}_first long")
    placed = marked.join(F.broadcast(starts), part == F.col(f"{name}_part"))  # a row for each range
    place = F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + F.col(f"{name}_first")
    return placed.withColumn(name, place).drop(f"{name}_part", f"{name}_first")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters that are no white space."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
