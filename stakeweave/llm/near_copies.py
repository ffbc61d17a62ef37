"""SimHash near-dedup with an exact check: near copies at Jaccard similarity 0.8 over five-word shingles.

1. Arrow batches turn each text into its set of shingle hashes: a hash of the whole set, a SimHash fingerprint and
   ``BANDS`` hashes of ``ROWS`` least values each.  Texts with equal sets are folded before anything is compared.
2. Fingerprints within ``RADIUS`` bits are found in vantage-point trees, as ``simhash`` does; each link that
   comes out of them is a bucket of the sets that have its two fingerprints.
3. Sets that are less alike than that differ in up to about 15 bits, where no ball of a vantage-point tree is
   small enough to prune anything.  So sets that share a band are a bucket as well: two sets of
   similarity s share one with probability ``1 - (1 - s**ROWS)**BANDS``, 0.9996 at 0.8, more above.
4. Buckets with the same members are looked at once.  In each, every set is compared exactly with
   all that aren't joined to it yet, so what comes out is a spanning forest of the links at ``LEAST`` or
   more, never all pairs.  A bucket of more than ``BLOCK`` sets is dealt to blocks that share its least
   set; if its sets are in several classes after that, its blocks are compared with each other too.
5. The forests are joined into components; the first row of each stays.

Jaccard similarities are those of the sets of shingle hashes; two given shingles, or sets, that differ share a 64-bit hash with probability 2**-64.

Words are those of the other operators (split at white space, A-Z in lower case), so line breaks don't
matter.  Defined results: a text of fewer than five words has its whole run as its shingle; texts without
words are copies of each other, and a null text reads as empty; the first row is first by id, null first, then by hashes
of its text and of its columns, and of equal rows one stays; a text may be of any length; an empty table gives
an empty result; other columns are carried through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeweave.llm.common import cut
from stakeweave.llm.kernels import LOWER, chunks, find_words, mix, released, shingle_hash, span_hash, text_buffer
from stakeweave.llm.simhash import components, fingerprints, links

SIZE, LEAST, BANDS, ROWS, RADIUS = 5, 0.8, 20, 5, 2
#: Sets of one bucket that one task compares at once.
BLOCK = 1024
#: Keys (some 50 bytes each) that are broadcast to the texts; more of them are joined by a shuffle.
FEW = 1 << 18
_K = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, in order, and the ``len + 1`` offsets of the texts in them."""
    row, start, end = find_words(text := LOWER[data], offsets)
    n = len(offsets) - 1
    h, own = shingle_hash(span_hash(text, start, end), row, n, size)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[new], np.searchsorted(own[new], np.arange(n + 1))


def band_hashes(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each set, and of each of its bands; without words all are zero."""
    some = np.flatnonzero(np.diff(at))
    whole, bands = np.zeros(len(at) - 1, np.uint64), np.zeros((len(at) - 1, BANDS), np.uint64)
    if not len(some):
        return whole, bands
    heads = at[some]
    whole[some] = mix(np.add.reduceat(mix(sets + _K), heads) + np.diff(at)[some].astype(np.uint64))
    draw = np.random.default_rng(20240301).integers(1, 1 << 63, (BANDS, ROWS, 2)).astype(np.uint64)
    for band in range(BANDS):
        h = np.full(len(some), band + 1, np.uint64)
        for add, times in draw[band]:
            h = mix(h * _K + np.minimum.reduceat((sets ^ add) * (times | np.uint64(1)), heads))
        bands[some, band] = h
    return whole, bands


def near_links(sets: np.ndarray, at: np.ndarray, least: float = LEAST) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets whose Jaccard similarity is ``least`` or more."""
    size = np.diff(at)
    owner = np.repeat(np.arange(len(size)), size)
    left = np.ones(len(size), bool)
    found: list[tuple[int, int]] = []
    for root in range(len(size)):
        todo = [root] if left[root] else []
        left[root] = False
        while todo and left.any():
            one = todo.pop()
            live = left & (size >= least * size[one]) & (size * least <= size[one])
            if not live.any():
                continue
            part = live[owner]
            own = sets[at[one] : at[one + 1]]
            place = np.minimum(np.searchsorted(own, sets[part]), len(own) - 1)
            shared = np.bincount(owner[part][own[place] == sets[part]], minlength=len(size))
            near = np.flatnonzero(live & (shared >= least * (size + size[one] - shared) - 1e-9))
            left[near] = False
            found += [(one, int(x)) for x in near]
            todo += near.tolist()
    return found


def with_keys(docs: DataFrame) -> DataFrame:
    """``key`` (id, hash of the text, hash of the columns), ``text`` and the whole ``row``."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    key = F.struct(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"), F.xxhash64(*plain).alias("r"))
    return docs.select(key.alias("key"), F.col("text").cast("string").alias("text"), F.struct("*").alias("row"))


def near_classes(keyed: DataFrame, most: int = BLOCK) -> DataFrame:
    """``key, set, root`` of every row: the hash of its set of shingles and the hash that names its class.

    ``keyed`` has ``key`` (a struct of ``i, h, r``) and ``text``.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in chunks(offsets):
                text, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                whole, bands = band_hashes(*shingle_sets(text, at))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
                sim = pa.array(fingerprints(text, at, SIZE).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(whole.view(np.int64)), sim, lists], names=["key", "set", "fp", "bands"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task holds whole buckets.
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        bucket = table["bucket"].to_numpy()
        order = np.argsort(bucket, kind="stable")
        for members in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            rows = table.take(pa.array(members))
            sets = rows["set"].to_numpy()
            pairs = near_links(*shingle_sets(*text_buffer(rows["text"])))
            if pairs:
                a, b = np.array(pairs).T
                yield pa.RecordBatch.from_arrays([pa.array(sets[a]), pa.array(sets[b])], names=["a", "b"])

    kind = keyed.schema["key"].dataType.simpleString()
    rows = cut(keyed.select("key", "text").mapInArrow(released(sketch), f"key {kind}, set long, fp long, bands array<long>"))
    # One row of each set; no text is held beside its sketch.
    distinct = cut(rows.groupBy("set").agg(F.min("key").alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    worded = distinct.where("set <> 0").select("set", "fp", "bands")
    near = cut(links(worded.select("fp").distinct(), RADIUS))
    ends = near.select(F.explode(F.array("a", "b")).alias("fp"), F.xxhash64("a", "b").alias("bucket"))
    buckets = (
        worded.join(ends, "fp").select("set", "bucket")
        .unionByName(worded.select("set", F.xxhash64("fp").alias("bucket")))
        .unionByName(worded.select("set", F.explode("bands").alias("bucket")))
    )
    counted = buckets.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("set").alias("least"), F.bit_xor(F.xxhash64("set")).alias("mark")
    ).where("n > 1")
    looked = counted.groupBy("n", "least", "mark").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "least")
    members = cut(buckets.distinct().join(looked, "bucket"))
    spread = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compared(groups: DataFrame) -> DataFrame:
        """``a, b``: links found among the sets of each bucket; only what has a candidate is shuffled with its text."""
        wanted = cut(groups.join(distinct.select("set", "first"), "set").select("bucket", "set", *_parts("first")))
        if wanted.count() <= FEW:
            wanted = F.broadcast(wanted)
        # Equal rows give a set twice, which links it to itself.
        full = keyed.join(wanted, _same()).select("bucket", "set", "text")
        return cut(full.repartition(spread, "bucket").mapInArrow(released(compare), "a long, b long").where("a <> b"))

    # A large bucket is dealt to blocks that each hold its least set as well.
    blocks = F.ceil(F.col("n") / most).cast("int")
    block = F.pmod(F.xxhash64("set", F.lit(5)), blocks).cast("int")
    large = members.where(F.col("n") > most).withColumn("block", block)
    each = F.explode(F.sequence(F.lit(0), blocks - 1))
    hubs = looked.where(F.col("n") > most).select("bucket", "least", each.alias("block")).select(F.col("least").alias("set"), F.xxhash64("bucket", "block").alias("bucket"))
    groups = members.where(F.col("n") <= most).select("set", "bucket").unionByName(large.select("set", F.xxhash64("bucket", "block").alias("bucket"))).unionByName(hubs)
    found = compared(groups.distinct())
    roots = cut(components(found))
    # What the blocks and the other buckets have not joined is compared block against block, so no link is lost.
    classes = large.join(roots, F.col("set") == F.col("node"), "left").withColumn("class", F.coalesce("root", "set"))
    apart = cut(classes.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("bucket"))
    if not apart.isEmpty():
        pairs = large.join(apart, "bucket").select("set", "bucket", "block", each.alias("other")).where("block <> other")
        found = found.unionByName(compared(pairs.select("set", F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("bucket"))))
        roots = cut(components(found))
    classes = distinct.join(roots, distinct["set"] == roots["node"], "left").select("set", F.coalesce("root", "set").alias("root"))
    return rows.select("key", "set").join(classes, "set")


def _parts(key: str) -> list[Column]:
    return [F.col(f"{key}.{x}").alias(f"first_{x}") for x in "ihr"]


def _same() -> Column:
    return F.col("key.i").eqNullSafe(F.col("first_i")) & (F.col("key.h") == F.col("first_h")) & (F.col("key.r") == F.col("first_r"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies, with all their columns."""
    keyed = with_keys(docs)
    classes = cut(near_classes(keyed.select("key", "text")))
    firsts = classes.groupBy("root").agg(F.min("key").alias("first"))
    lost = cut(classes.join(firsts, "root").where("key <> first").select(*_parts("key")).distinct())
    if lost.count() <= FEW:
        kept = keyed.select("key", "row").join(F.broadcast(lost), _same(), "left_anti")
    else:
        kept = keyed.select("key", "row").join(firsts.select(*_parts("first")), _same(), "left_semi")
    if not classes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["key"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
