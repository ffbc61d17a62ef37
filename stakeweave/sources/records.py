"""Files of records: NDJSON, JSON documents with one large array, id lists."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stakeweave.functions.names import strip
from stakeweave.sources.arrays import array_records


def mentioning(lines: DataFrame, ids: list[str], column: str = "value") -> DataFrame:
    """Rows whose text holds any of ``ids``, by one automaton over all of them: a scan of the text, however many they are."""
    shared = lines.sparkSession.sparkContext.broadcast(sorted({i for i in ids if i}))  # the list that was given

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for one in shared.value:
            automaton.add_word(one, True)
        automaton.make_automaton()
        hit = lambda text: text is not None and next(automaton.iter(text), None) is not None
        for batch in batches:
            if len(automaton):
                at = batch.schema.get_field_index(column)
                yield batch.filter(pa.array([hit(x) for x in batch.column(at).to_pylist()], pa.bool_()))

    return lines.mapInArrow(run, lines.schema)


def read_records(spark: SparkSession, path: str, schema: str, array: bool = False, only: list[str] | None = None) -> DataFrame:
    """Records of NDJSON files, or with ``array`` of documents that hold them in one array, of any size.

    With ``only``, records that mention none of these ids are dropped before they are parsed.
    A record that does not parse has its text in ``_corrupt``.
    """
    lines = array_records(spark, path) if array else spark.read.text(path).where(F.trim("value") != "")
    if only is not None:
        lines = mentioning(lines, only)
    parsed = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.select("r.*", F.coalesce("r._bad", F.when(F.col("r").isNull(), F.col("value"))).alias("_corrupt")).drop("_bad")


def unwrap(node: Column) -> Column:
    """The value of a wrapped scalar, trimmed; blank is null."""
    return F.nullif(strip(node["$"]), F.lit(""))


def as_list(text: Column, item: str) -> Column:
    """JSON text of one object or a list of them as an array; null stays null."""
    bare = F.trim(text)
    listed = F.when(bare.startswith("["), bare).otherwise(F.concat(F.lit("["), bare, F.lit("]")))
    return F.from_json(listed, f"array<{item}>")


def read_id_list(spark: SparkSession, text: str | None = None, path: str | None = None) -> DataFrame:
    """Ids of a comma list and of a file with one a line; what follows # is a remark."""
    parts = spark.createDataFrame([(x,) for x in (text or "").split(",")], "value string")
    if path is not None:
        parts = parts.unionByName(spark.read.text(path))
    return parts.select(F.trim(F.get(F.split("value", "#"), F.lit(0))).alias("id")).where("id <> ''").distinct()


def write_id_list(ids: DataFrame, path: str) -> None:
    """Sorted ids, one a line."""
    ids.select(F.col("id").alias("value")).distinct().repartitionByRange(8, "value").sortWithinPartitions("value").write.mode("overwrite").text(path)
