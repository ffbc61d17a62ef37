"""A stored word index: blocks of sorted ids by word, in buckets of a hash of the word, with segments for changes.

Each segment is a table of a ``Store``: a row is a word, a block's number and the block's ids in order.  A search reads the
buckets of its words from every segment and no other file.  A change writes one small segment with the new rows' words,
and notes the changed ids with the segment's number: what older segments say of them no longer counts.  A merge makes one
segment of all and empties the notes.  Segment, notes and merge appear in one version each.

A word's ids are dealt to blocks by a hash, as many as its number of ids asks for, so no block grows with the
corpus and a word that every row has is spread over many tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stakeweave.operators.search import tokens
from stakeweave.operators.store import Store, Table, Version

#: About how many ids a block holds.
BLOCK_IDS = 1024
_SPREAD = 64


class SearchIndex:
    """The words of texts by id; ``name`` tells several indexes of one store apart."""

    def __init__(self, store: Store, name: str = "words", buckets: int = 64):
        self.store, self.name, self.buckets = store, name, buckets

    # Segments

    def _segments(self, version: Version) -> list[int]:
        head = f"{self.name}-"
        return sorted(int(t[len(head) :]) for t in version.tables if t.startswith(head) and t[len(head) :].isdigit())

    def _notes(self, version: Version) -> DataFrame:
        """``id, segment``: ids of which only that segment and later ones speak."""
        return self.store.read(f"{self.name}-changed", version)

    def _blocks(self, words: DataFrame) -> DataFrame:
        """``token, block, ids`` of distinct ``token, id`` rows."""
        count = words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        block = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK_IDS)).cast("int")
        return words.join(count, "token").groupBy("token", block.alias("block")).agg(F.array_sort(F.collect_list("id")).alias("ids"))

    def _segment(self, words: DataFrame) -> Table:
        rows = self._blocks(words)
        return self.store.write(Table(rows.schema.json(), ["token"], self.buckets), rows, deal=F.pmod("block", F.lit(_SPREAD)))

    @staticmethod
    def _words(rows: DataFrame) -> DataFrame:
        return rows.where("id IS NOT NULL").select("id", F.explode(tokens(F.col("text"))).alias("token")).distinct()

    # Changes

    def build(self, rows: DataFrame, fence: int | None = None) -> Version:
        """The index of ``rows`` (``id, text``) in place of what was there."""
        base = self.store.latest()
        number = max(self._segments(base), default=0) + 1
        notes = self.store.spark.createDataFrame([], f"id {rows.schema['id'].dataType.simpleString()}, segment int")
        tables: dict[str, Table | None] = {f"{self.name}-{n}": None for n in self._segments(base)}
        tables |= {f"{self.name}-{number}": self._segment(self._words(rows)), f"{self.name}-changed": Table(notes.schema.json(), ["id"], self.buckets)}
        return self.store.commit(base, tables, fence=fence)

    def change(self, rows: DataFrame, gone: DataFrame | None = None, fence: int | None = None) -> Version:
        """New texts of ``rows`` (``id, text``), and ids ``gone`` that are no longer there, as one more segment."""
        base = self.store.latest()
        number = max(self._segments(base)) + 1
        ids = rows.select("id") if gone is None else rows.select("id").unionByName(gone.select("id"))
        changed = f"{self.name}-changed"
        notes = ids.where("id IS NOT NULL").distinct().withColumn("segment", F.lit(number))
        buckets = self.store.touched(base.tables[changed], notes)
        held = self.store.read(changed, base, buckets).unionByName(notes).groupBy("id").agg(F.max("segment").alias("segment"))
        tables = {f"{self.name}-{number}": self._segment(self._words(rows))}
        if buckets:
            tables[changed] = self.store.write(base.tables[changed], held, buckets)
        return self.store.commit(base, tables, fence=fence)

    def merge(self, fence: int | None = None) -> Version:
        """One segment of all."""
        base = self.store.latest()
        segments = self._segments(base)
        number = segments[-1] + 1
        schema = StructType.fromJson(json.loads(base.tables[f"{self.name}-changed"].schema))
        tables: dict[str, Table | None] = {f"{self.name}-{n}": None for n in segments}
        tables |= {f"{self.name}-{number}": self._segment(self.words(version=base)), f"{self.name}-changed": Table(schema.json(), ["id"], self.buckets)}
        return self.store.commit(base, tables, fence=fence)

    # Reading

    def words(self, wanted: Iterable[str] | None = None, version: Version | None = None) -> DataFrame:
        """``token, id`` of all words, or of those ``wanted``: from the files of their buckets alone."""
        version = version or self.store.latest()
        spark, out = self.store.spark, None
        asked = None if wanted is None else spark.createDataFrame([(w,) for w in sorted(set(wanted))], "token string")
        for n in self._segments(version):
            name = f"{self.name}-{n}"
            buckets = None if asked is None else self.store.touched(version.tables[name], asked)
            rows = self.store.read(name, version, buckets).select("token", F.explode("ids").alias("id"), F.lit(n).alias("said"))
            if asked is not None:
                rows = rows.join(asked, "token", "left_semi")
            out = rows if out is None else out.unionByName(rows)
        notes = self._notes(version).select(F.col("id").alias("_id"), "segment")
        return out.join(notes, (F.col("id") == F.col("_id")) & (F.col("said") < F.col("segment")), "left_anti").select("token", "id")

    def words_of(self, queries: DataFrame, column: str = "q", version: Version | None = None) -> DataFrame:
        """``token, id`` for the words of ``queries``, a list as short as people type; give this to ``match_any`` and ``entity_candidates``."""
        wanted = [r.t for r in queries.select(F.explode(tokens(F.col(column))).alias("t")).distinct().collect()]
        return self.words(wanted, version)

    def document_frequency(self, wanted: Iterable[str] | None = None) -> DataFrame:
        return self.words(wanted).groupBy("token").agg(F.count(F.lit(1)).alias("n_docs"))
