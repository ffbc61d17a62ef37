"""Large JSON documents whose records stand in one array, cut into records by all tasks at once.

Spark's text reader deals out byte ranges of the file when a line ends at ``}``: every piece begins right behind a
closing brace, so a range needs only two things from what stands before it: whether it begins inside a quoted
text, and how deep its brackets are nested.  Both come from sums:

1. Each range tells how many quotes it holds, and for either parity of quotes before it, by how much its brackets change the depth, how
   low the depth goes, and where an array first opens.
2. Running sums over the ranges of a file (one small row each) fix the parity, then the depth, then where the first array begins and ends
   and in which range a record that is still open at a range's start began.
3. Each range, knowing its start, cuts out its records; the parts of a record that crosses ranges are joined by the range where it began.

The records are the objects that are elements of the document's first array.  Elements of another kind are skipped, what
follows the array is ignored, and a record that the file breaks off is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_QUOTE, _SLASH, _OPEN, _CLOSE, _ARRAY = 34, 92, 123, 125, 91
_STEP = np.zeros(256, np.int8)
_STEP[[_OPEN, _ARRAY]] = 1
_STEP[[_CLOSE, 93]] = -1
#: What ends a piece; the reader takes it away.
_END = "}"


def structure(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of all brackets, the number of quotes before each, and the number of all quotes.

    A quote behind an odd run of backslashes is part of a text.
    """
    quotes = np.flatnonzero(raw == _QUOTE)
    if (raw == _SLASH).any():
        place = np.arange(len(raw))
        plain = np.maximum.accumulate(np.where(raw != _SLASH, place, -1))
        before = np.where(quotes > 0, plain[quotes - 1], -1)
        quotes = quotes[(quotes - 1 - before) % 2 == 0]
    brackets = np.flatnonzero(_STEP[raw])
    return brackets, np.searchsorted(quotes, brackets), len(quotes)


@dataclass
class Range:
    """What a range does to its successors, for an even and for an odd number of quotes before it."""

    quotes: int = 0
    size: int = 0
    depth: list[int] = field(default_factory=lambda: [0, 0])
    low: list[int] = field(default_factory=lambda: [0, 0])
    first: list[int | None] = field(default_factory=lambda: [None, None])  # depth inside the array that opens first
    low_after: list[int | None] = field(default_factory=lambda: [None, None])  # the least depth from there on

    def add(self, raw: np.ndarray) -> None:
        brackets, before, quotes = structure(raw)
        step, arrays = _STEP[raw[brackets]].astype(np.int64), raw[brackets] == _ARRAY
        for odd in (0, 1):
            bare = (before + self.quotes + odd) % 2 == 0
            depth = self.depth[odd] + np.cumsum(np.where(bare, step, 0))
            opens = np.flatnonzero(bare & arrays)
            after = 0 if self.first[odd] is not None else None
            if after is None and len(opens):
                after = int(opens[0])
                self.first[odd] = self.low_after[odd] = int(depth[after])
            if len(depth):
                self.low[odd] = min(self.low[odd], int(depth.min()))
                if after is not None:
                    self.low_after[odd] = min(self.low_after[odd], int(depth[after:].min()))
                self.depth[odd] = int(depth[-1])
        self.quotes += quotes
        self.size += len(raw)


@dataclass
class Cutter:
    """Cuts the records of one range whose start is known; ``array`` is the depth inside the array, or nothing where it opens later."""

    quotes: int
    depth: int
    array: int | None
    inside: bool  # the array has opened before this range
    held: list[bytes] = field(default_factory=list)
    begun: bool = False  # an own record is open
    over: bool = False

    def __post_init__(self) -> None:
        self.late = self.inside and self.depth > self.array  # an element of an earlier range is open

    def add(self, raw: np.ndarray) -> Iterator[tuple[bool, bool, bytes]]:
        """``(begins here, ends here, text)`` of records and parts of records that end in these bytes."""
        if self.over:
            return
        brackets, before, quotes = structure(raw)
        bare = (before + self.quotes) % 2 == 0
        brackets = brackets[bare]
        kind = raw[brackets]
        depth = self.depth + np.cumsum(_STEP[kind].astype(np.int64))
        self.quotes += quotes
        stop = len(brackets)
        if not self.inside and self.array is not None and (kind == _ARRAY).any():
            opened = int(np.argmax(kind == _ARRAY))
            self.inside = True
        else:
            opened = 0
        if self.inside and (out := np.flatnonzero(depth[opened:] < self.array)).size:
            stop = opened + int(out[0])
            self.over = True
        live = slice(opened, stop)
        at = 0
        if self.inside or self.late or self.begun:
            starts = brackets[live][(kind[live] == _OPEN) & (depth[live] == self.array + 1)]
            ends = brackets[live][(kind[live] == _CLOSE) & (depth[live] == self.array)]
            if self.late or self.begun:
                # The element that is open at the start: its end is the first return to the array's depth.
                back = np.flatnonzero(depth[live] == self.array)
                if not len(back):
                    self.held.append(raw.tobytes())
                    self._move(depth, stop)
                    return
                at = int(brackets[live][back[0]]) + 1
                if kind[live][back[0]] == _CLOSE:
                    yield self.begun, True, b"".join([*self.held, raw[:at].tobytes()])
                    ends = ends[1:]
                self.held, self.late, self.begun = [], False, False
            for a, b in zip(starts, ends, strict=False):
                yield True, True, raw[a : b + 1].tobytes()
            if len(starts) > len(ends) and not self.over:
                self.held, self.begun = [raw[starts[-1] :].tobytes()], True
        self._move(depth, stop)

    def _move(self, depth: np.ndarray, stop: int) -> None:
        if self.over:
            self.inside = self.late = self.begun = False
            self.held = []
        elif len(depth):
            self.depth = int(depth[-1])

    def rest(self) -> tuple[bool, bool, bytes] | None:
        """The part of a record that is open at the end of the range."""
        if self.begun or (self.late and self.held):
            return self.begun, False, b"".join(self.held)
        return None


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch, np.ndarray, bool]]:
    """Bytes of one range at a time, whole pieces with their ends, with the range's key and first row."""
    last = None
    for batch in batches:
        start = batch.column(1).to_numpy()
        path = batch.column(0)
        cuts = [0]
        for i in np.flatnonzero(np.diff(start)) + 1:
            cuts.append(int(i))
        files = path.dictionary_encode().indices.to_numpy()
        cuts = sorted({*cuts, *(np.flatnonzero(np.diff(files)) + 1).tolist(), batch.num_rows})
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            key = (part.column(0)[0].as_py(), part.column(1)[0].as_py())
            raw = np.frombuffer(b"".join(x + _END.encode() for x in part.column(2).to_pylist()), np.uint8)
            yield key, part, raw, key != last
            last = key


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", _END).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("raw"),
        F.col("_metadata.file_size").alias("file_size"),
    )


_RANGE = "path string, start long, file_size long, quotes long, size long, " + ", ".join(f"{n}{k} long" for n in ("depth", "low", "first", "low_after") for k in (0, 1))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    own = key = size = None

    def row() -> tuple:
        return (*key, size, own.quotes, own.size, *own.depth, *own.low, *own.first, *own.low_after)

    for k, part, raw, new in _runs(batches):
        if new:
            if own is not None:
                rows.append(row())
            own, key, size = Range(), k, part.column(3)[0].as_py()
        own.add(raw)
    if own is not None:
        rows.append(row())
    names = [x.split()[0] for x in _RANGE.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(columns)], names=names)


def range_starts(spark: SparkSession, path: str) -> DataFrame:
    """``path, start, quotes, depth, array, inside, done, begun_in, open_end`` of every range of the files at ``path``.

    A file has a row for each of its ranges here (8,000 for a terabyte), so a window over one file's ranges is small.
    """
    rows = _pieces(spark, path).mapInArrow(_ranges, _RANGE)
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("path")
    odd = F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2
    rows = rows.withColumn("odd", odd)
    chosen = [F.when(F.col("odd") == 1, F.col(f"{n}1")).otherwise(F.col(f"{n}0")).alias(n) for n in ("depth", "low", "first", "low_after")]
    rows = rows.select("path", "start", "file_size", "size", F.col("odd").alias("quotes"), *chosen)
    rows = rows.withColumn("begin", F.coalesce(F.sum("depth").over(earlier), F.lit(0)))
    rows = rows.withColumn("array", F.first(F.col("begin") + F.col("first"), ignorenulls=True).over(every.orderBy("start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = rows.withColumn("opened_here", F.col("first").isNotNull() & F.coalesce(F.max(F.col("first").isNotNull()).over(earlier), F.lit(False)).eqNullSafe(False))
    inside = F.coalesce(F.max(F.col("first").isNotNull()).over(earlier), F.lit(False))
    rows = rows.withColumn("inside", inside)
    # The array ends where the depth first falls below its own, looked at from its opening on.
    low = F.when(F.col("opened_here"), F.col("low_after")).when(F.col("inside"), F.col("low"))
    rows = rows.withColumn("closes", F.coalesce(F.col("begin") + low < F.col("array"), F.lit(False)))
    rows = rows.withColumn("done", F.coalesce(F.max("closes").over(earlier), F.lit(False)))
    # An open element began in the last range whose depth came down to the array's.
    touches = F.col("opened_here") | (F.col("inside") & (F.col("begin") + F.col("low") <= F.col("array")))
    rows = rows.withColumn("touches", touches).withColumn("begun_in", F.max(F.when(F.col("touches"), F.col("start"))).over(earlier))
    # The reader doesn't tell whether the last piece had an end; the file's size does (a byte order mark of three bytes is skipped).
    missing = F.col("file_size") - F.sum("size").over(every)
    last = F.col("start") == F.max("start").over(every)
    rows = rows.withColumn("open_end", last & missing.isin(-1, 2))
    return rows.select("path", "start", "quotes", F.col("begin").alias("depth"), "array", "inside", "done", "begun_in", "open_end")


_PART = "path string, begun_in long, start long, begins boolean, ends boolean, raw binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _PART.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    cutter, key, home, held, tail = None, None, None, np.zeros(0, np.uint8), False

    def rows_of(found) -> list[tuple]:
        # A record that began here is known by this range, a part of an earlier one by that range.
        return [(key[0], key[1] if begins else home, key[1], begins, ends, text) for begins, ends, text in found]

    def finish() -> list[tuple]:
        if cutter is None:
            return []
        rows = rows_of(cutter.add(held[: len(held) - tail])) if len(held) else []
        rest = cutter.rest()
        return rows + (rows_of([rest]) if rest else [])

    for k, part, raw, new in _runs(batches):
        if new:
            if rows := finish():
                yield made(rows)
            quotes, depth, array, inside, done, home, tail = (part.column(i)[0].as_py() for i in range(4, 11))
            cutter, key, held = Cutter(quotes, depth, array, inside), k, np.zeros(0, np.uint8)
            cutter.over = done or array is None
            cutter.late = cutter.late and not cutter.over
        # One buffer waits, so that the last one can lose an end that the file doesn't have.
        if len(held) and (rows := rows_of(cutter.add(held))):
            yield made(rows)
        held = raw
    if rows := finish():
        yield made(rows)


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the text of every record of the array documents at ``path`` (a file, folder or pattern on any file system)."""
    # A row for each range of about 128 MB; the join must not move the pieces, whose order counts.
    starts = F.broadcast(range_starts(spark, path))
    rows = _pieces(spark, path).join(starts, ["path", "start"])
    rows = rows.select("path", "start", "raw", "file_size", "quotes", "depth", "array", "inside", "done", "begun_in", "open_end")
    parts = rows.mapInArrow(_cut, _PART)
    whole = parts.where("begins AND ends").select(F.col("raw").cast("string").alias("value"))
    # At most one open record for each range: a part or two of each are shuffled.
    broken = parts.where("NOT (begins AND ends)").groupBy("path", "begun_in").agg(
        F.array_sort(F.collect_list(F.struct("start", "raw"))).alias("parts"), F.max("begins").alias("begins"), F.max("ends").alias("ends")
    )
    joined = F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, p["raw"]))
    return whole.unionByName(broken.where("begins AND ends").select(joined.cast("string").alias("value")))


def split_records(spark: SparkSession, path: str, folder: str) -> str:
    """The records of array documents as NDJSON files below ``folder``, which Spark can read in parallel; returns ``folder``.

    A record that is spread over lines comes to stand on one.
    """
    # JSON knows line ends inside texts in escaped form only, so bare ones are white space.
    array_records(spark, path).select(F.regexp_replace("value", "[\r\n]+", " ").alias("value")).write.mode("errorifexists").text(folder)
    return folder


def unzip(spark: SparkSession, path: str, target: str, suffix: str = ".json") -> str:
    """The first member with ``suffix`` of a zip, copied to ``target`` as a stream between file systems; returns ``target``.

    Deflated bytes can only be read from their start, so this is one stream; what follows is not.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, sink = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, target))
    archive = jvm.java.util.zip.ZipInputStream(source.getFileSystem(conf).open(source))
    try:
        while (entry := archive.getNextEntry()) is not None:
            if entry.getName().lower().endswith(suffix):
                # Closes both streams.
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(archive, sink.getFileSystem(conf).create(sink, False), conf, True)
                return target
    finally:
        archive.close()
    raise ValueError(f"{path} has no member that ends in {suffix}")
