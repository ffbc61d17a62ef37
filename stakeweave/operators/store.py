"""Tables that change together: hash buckets of their keys, one manifest a version.

A store holds several tables.  Each is dealt into buckets by a hash of its key, and a bucket is a folder of Parquet
files.  A version is one small file, the manifest, that names the folder of every bucket of every table.  A change writes new
folders for the buckets that it touches, then one new manifest that carries the other buckets by reference; the
manifest is renamed into place, so all tables change at once, and a crash before that leaves the version before.

The driver holds a manifest: a name for each bucket, whatever the tables' sizes.  A version's number can be taken once: of two
writers that start from one version the second fails and may try again.  This needs a file system whose rename
doesn't replace a file that is there (such as HDFS); on a local disk, and wherever writers come and go, an ``ImportLock`` keeps them apart, and its
fencing number, which the store remembers, shuts out one that has lost its lock.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer was faster, or this one's lock was lost."""


class Files:
    """Small text files below a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._path = lambda name: self._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}" if name else root)
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Writes a file that isn't there yet; it appears whole or not at all.  False if another was faster."""
        target, draft = self._path(name), self._path(f"_drafts/{uuid.uuid4().hex}")
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not self._fs.exists(target) and self._fs.rename(draft, target):
            return True
        self._fs.delete(draft, False)
        return False

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def age(self, name: str) -> float:
        """Seconds since a file or folder was changed."""
        now = self._jvm.java.lang.System.currentTimeMillis()
        return (now - self._fs.getFileStatus(self._path(name)).getModificationTime()) / 1000


@dataclass(frozen=True)
class Table:
    """A table of one version: its columns, its key, and the folder of each bucket that holds rows."""

    schema: str
    keys: list[str]
    buckets: int
    paths: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Version:
    number: int = 0
    fence: int = 0
    tables: Mapping[str, Table] = field(default_factory=dict)
    tags: Mapping[str, str] = field(default_factory=dict)


class Store:
    """Tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root, Files(spark, root)

    # Versions

    def latest(self) -> Version:
        names = self.files.names("versions")
        return self.version(int(names[-1].split(".")[0])) if names else Version()

    def version(self, number: int) -> Version:
        raw = json.loads(self.files.read(f"versions/{number:012d}.json"))
        return Version(raw["number"], raw["fence"], {k: Table(**t) for k, t in raw["tables"].items()}, raw["tags"])

    def commit(self, base: Version, tables: Mapping[str, Table | None], tags: Mapping[str, str] | None = None, fence: int | None = None) -> Version:
        """The version after ``base``, with ``tables`` in place of those of the same names; one given as None goes."""
        fence = base.fence if fence is None else fence
        if fence < base.fence:
            raise Conflict(f"lock number {fence} has been followed by {base.fence}")
        named = {k: t for k, t in {**base.tables, **tables}.items() if t is not None}
        made = Version(base.number + 1, fence, named, {**base.tags, **(tags or {})})
        body = {"number": made.number, "fence": made.fence, "tags": made.tags, "tables": {k: vars(t) for k, t in made.tables.items()}}
        if not self.files.put_new(f"versions/{made.number:012d}.json", json.dumps(body)):
            raise Conflict(f"version {made.number} has been written by another")
        return made

    # Rows

    @staticmethod
    def bucket_of(table: Table) -> Column:
        return F.pmod(F.xxhash64(*table.keys), F.lit(table.buckets)).cast("int")

    def touched(self, table: Table, keys: DataFrame) -> list[int]:
        """Buckets that hold the keys of ``keys``; at most as many as the table has."""
        return sorted(r.b for r in keys.select(self.bucket_of(table).alias("b")).distinct().collect())

    def read(self, name: str, version: Version | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table's rows, or those of some buckets; no other file is opened."""
        table = (version or self.latest()).tables[name]
        schema = StructType.fromJson(json.loads(table.schema))
        wanted = table.paths if buckets is None else {str(b): table.paths[str(b)] for b in buckets if str(b) in table.paths}
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in wanted.values()])

    def lookup(self, name: str, keys: DataFrame, version: Version | None = None) -> DataFrame:
        """Rows of the keys in ``keys``, from the buckets that hold them."""
        version = version or self.latest()
        table = version.tables[name]
        return self.read(name, version, self.touched(table, keys)).join(keys.select(*table.keys).distinct(), table.keys, "left_semi")

    def write(self, table: Table, rows: DataFrame, buckets: list[int] | None = None, deal: Column | None = None) -> Table:
        """``table`` with ``rows`` as all that ``buckets`` (or all of them) hold; nothing shows before a commit.

        A bucket is one task's work and one file; where one key has very many rows, ``deal`` spreads them over several.
        """
        schema = StructType.fromJson(json.loads(table.schema))
        folder = f"data/{uuid.uuid4().hex}"
        dealt = rows.select(*schema.names).withColumn("_bucket", self.bucket_of(table)).repartition("_bucket", *([] if deal is None else [deal])).sortWithinPartitions("_bucket", *table.keys)
        dealt.write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        new = {n.split("=")[1]: f"{folder}/{n}" for n in self.files.names(folder) if n.startswith("_bucket=")}
        replaced = set(table.paths) if buckets is None else {str(b) for b in buckets}
        if strange := set(new) - replaced if buckets is not None else set():
            raise ValueError(f"rows of buckets {sorted(strange)} are not among those that change")
        return replace(table, paths={**{b: p for b, p in table.paths.items() if b not in replaced}, **new})

    def create(self, tables: Mapping[str, tuple[DataFrame, list[str], int]], tags: Mapping[str, str] | None = None, fence: int | None = None) -> Version:
        """Adds tables, each given by its rows, key and number of buckets; all appear in one version."""
        base = self.latest()
        made = {name: self.write(Table(rows.schema.json(), keys, buckets), rows) for name, (rows, keys, buckets) in tables.items()}
        return self.commit(base, made, tags, fence)

    def change(
        self, changes: Mapping[str, tuple[DataFrame, Callable[[DataFrame, DataFrame], DataFrame]]], tags: Mapping[str, str] | None = None,
        fence: int | None = None, base: Version | None = None,
    ) -> Version:
        """Folds rows into tables, all in one version.

        For each table: rows that hold at least its key, and a function of (stored rows of the touched buckets, those rows) that
        gives the new rows of these buckets.  Tables that no row touches are carried over.
        """
        base = base or self.latest()
        made = {}
        for name, (delta, fold) in changes.items():
            table = base.tables[name]
            buckets = self.touched(table, delta)
            if buckets:
                made[name] = self.write(table, fold(self.read(name, base, buckets), delta), buckets)
        return self.commit(base, made, tags, fence)

    # Upkeep

    def rebucket(self, name: str, buckets: int, fence: int | None = None) -> Version:
        """Deals a table that has grown into another number of buckets, and each bucket into one file."""
        base = self.latest()
        table = replace(base.tables[name], buckets=buckets)
        return self.commit(base, {name: self.write(table, self.read(name, base))}, fence=fence)

    def vacuum(self, keep: int = 2, least_age: float = 7 * 86400) -> list[str]:
        """Deletes versions before the last ``keep`` and folders that no later one names, if they are older than ``least_age`` seconds.

        The age keeps what a writer has not committed yet.
        """
        names = self.files.names("versions")
        old = [n for n in names[:-keep] if self.files.age(f"versions/{n}") >= least_age]
        kept = [self.version(int(n.split(".")[0])) for n in names if n not in old]
        for n in old:
            self.files.delete(f"versions/{n}")
        used = {p.split("/")[1] for v in kept for t in v.tables.values() for p in t.paths.values()}
        gone = [f"data/{n}" for n in self.files.names("data") if n not in used and self.files.age(f"data/{n}") >= least_age]
        for path in gone:
            self.files.delete(path)
        return gone
