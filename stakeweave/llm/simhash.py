"""SimHash near-duplicate groups by exact Hamming search in vantage-point trees.

1. Arrow batches turn each text into one 64-bit fingerprint: bit k is set when more than
   half of the text's shingle hashes (XXH64, seed 42) have it set.
2. Equal fingerprints are folded into one row before anything is compared, so a group of
   exact copies costs one fingerprint whatever its size.
3. A vantage-point tree over a bounded sample of fingerprints cuts the space into shards.
   Fingerprint p goes to the inner side of a node with pivot v and radius m when
   d(p, v) <= m, else to the outer side; an outer one with d(p, v) <= m + r also visits
   the inner side.  If d(p, q) <= r and a node parts p from q, the triangle inequality puts the
   outer one within m + r of the pivot, so the two still meet: every pair within r
   shares a shard, and no pair is lost.
4. Each shard is cut again by a tree of its own until its leaves are small; a leaf
   compares its fingerprints exactly in blocks and gives a spanning forest of its links,
   never all pairs.
5. The forests are joined into components by alternating star contraction, with each
   round checkpointed.
6. Rows get their component by fingerprint; the few fingerprints that many rows share are joined by broadcast.

Defined results: a null text reads as empty; a text without words has fingerprint zero
and links like any other; repeated rows give a row each; a null id never names a
component unless every id of the component is null; an empty table gives an empty result; a text is read whole (a
worker holds its words while it is hashed, about 45 bytes for each of the text); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeweave.llm.common import cut
from stakeweave.llm.kernels import LOWER, chunks, find_words, released, text_buffer

SEED = 42
#: Fingerprints in the sample that shapes the shards, and expected ones in a shard.
SAMPLE = 1 << 17
SHARD = 8192
#: Fingerprints that may be joined by broadcast.
HOT = 2000
LEAF = 1024
_BITS = 1 << 16  # shingles whose bits are unpacked at once


def fingerprints(data: np.ndarray, offsets: np.ndarray, size: int = 3) -> np.ndarray:
    """The fingerprint of each text that ``offsets`` cuts ``data`` into."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    n = len(offsets) - 1
    out = np.zeros(n, np.uint64)
    for first, last in chunks(offsets):
        text = LOWER[data[offsets[first] : offsets[last]]]
        row, start, end = find_words(text, offsets[first : last + 1] - offsets[first])
        if not len(row):
            continue
        # The words of the chunk, each followed by one space.
        length = end - start + 1
        at = np.cumsum(length) - length
        joined = np.full(int(length.sum()), 0x20, np.uint8)
        take = np.ones(len(joined), bool)
        take[at + length - 1] = False
        source = np.repeat(start - at, length) + np.arange(len(joined))
        joined[take] = text[source[take]]
        raw = memoryview(joined.tobytes())
        stop = at + length - 1
        count = np.bincount(row, minlength=last - first)
        begin = np.cumsum(count) - count
        whole = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :]) if len(row) >= size else np.zeros(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < size))
        a = np.concatenate([at[whole], at[begin[short]]])
        b = np.concatenate([stop[whole + size - 1], stop[begin[short] + count[short] - 1]])
        owner = np.concatenate([row[whole], short])
        order = np.argsort(owner, kind="stable")
        a, b, owner = a[order].tolist(), b[order].tolist(), owner[order]
        sums = np.zeros((last - first, 64), np.int64)
        for lo in range(0, len(a), _BITS):
            hi = min(lo + _BITS, len(a))
            h = np.array([digest(raw[x:y], SEED) for x, y in zip(a[lo:hi], b[lo:hi], strict=True)], np.uint64)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            own = owner[lo:hi]
            heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            sums[own[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
        total = np.bincount(owner, minlength=last - first)
        set_bits = 2 * sums > total[:, None]
        out[first:last] = np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprint_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``id, fp`` of every row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints(*text_buffer(batch.column(1)), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(released(run), f"id {rows.schema['id'].dataType.simpleString()}, fp long")


class VpTree:
    """Pivots, radii and children; a child below zero is the leaf ``-child - 1``."""

    def __init__(self, points: np.ndarray, radius: int, leaf: int, seed: int = 7):
        self.radius = radius
        self.pivot: list[int] = []
        self.bound: list[int] = []
        self.child: list[list[int]] = []
        self.leaves = 0
        self._draw = np.random.default_rng(seed)
        self.root = self._grow(points, leaf)

    def _grow(self, points: np.ndarray, leaf: int) -> int:
        best = None
        if len(points) > leaf:
            trial = points if len(points) <= 4096 else self._draw.choice(points, 4096, replace=False)
            for pivot in self._draw.choice(points, min(6, len(points)), replace=False):
                held = np.bincount(np.bitwise_count(trial ^ pivot), minlength=66 + self.radius)
                below = np.cumsum(held)
                inner, outer = below[self.radius : 65 + self.radius], below[-1] - below[:65]
                cost = np.where(below[:65] < below[-1], inner.astype(float) ** 2 + outer.astype(float) ** 2, np.inf)
                m = int(np.argmin(cost))
                if cost[m] < 0.95 * below[-1] ** 2 and (best is None or cost[m] < best[0]):
                    best = (cost[m], pivot, m)
        if best is None:
            self.leaves += 1
            return -self.leaves
        _, pivot, m = best
        d = np.bitwise_count(points ^ pivot)
        node = len(self.pivot)
        self.pivot.append(int(pivot))
        self.bound.append(m)
        self.child.append([0, 0])
        self.child[node] = [self._grow(points[d <= m + self.radius], leaf), self._grow(points[d > m], leaf)]
        return node

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf numbers and places in ``points`` of all their visits."""
        leaves, places = [], []
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                leaves.append(np.full(len(at), -node - 1, np.int64))
                places.append(at)
                continue
            d = np.bitwise_count(points[at] ^ np.uint64(self.pivot[node])).astype(np.int64)
            todo.append((self.child[node][0], at[d <= self.bound[node] + self.radius]))
            todo.append((self.child[node][1], at[d > self.bound[node]]))
        if not leaves:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(leaves), np.concatenate(places)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        live = ra != rb
        if not live.any():
            break
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    return root


def shard_links(points: np.ndarray, radius: int, leaf: int = LEAF, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as index pairs, of the links between distinct ``points`` within ``radius``."""
    found_a, found_b = [], []
    tree = VpTree(points, radius, leaf)
    leaves, places = tree.route(points)
    order = np.argsort(leaves, kind="stable")
    cuts = np.flatnonzero(np.diff(leaves[order])) + 1
    for members in np.split(places[order], cuts):
        fp = points[members]
        for i in range(0, len(members), block):
            for j in range(i, len(members), block):
                near = np.bitwise_count(fp[i : i + block, None] ^ fp[None, j : j + block]) <= radius
                a, b = np.nonzero(near)
                if i == j:
                    a, b = a[a < b], b[a < b]
                if len(a):
                    found_a.append(members[i + a])
                    found_b.append(members[j + b])
                if sum(map(len, found_a)) > 1 << 21:  # fold what is known before going on
                    a, b = _forest(len(points), np.concatenate(found_a), np.concatenate(found_b))
                    found_a, found_b = [a], [b]
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _forest(len(points), np.concatenate(found_a), np.concatenate(found_b))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    root = _roots(n, a, b)
    node = np.flatnonzero(root != np.arange(n))
    return node, root[node]


def links(distinct: DataFrame, radius: int = 2, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """``a, b``: forests that join all fingerprints of ``distinct`` (column ``fp``) within ``radius``."""
    n = distinct.count()
    share = min(1.0, sample / max(n, 1))
    picked = distinct.where(F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # About ``sample`` longs, whatever the size of the table; the hash makes the choice repeatable.
    points = np.sort(picked.select("fp").toPandas()["fp"].to_numpy(np.int64)).view(np.uint64)
    # At least 16 of the sample make a shard, so the tree stays small; larger shards are cut again where they are compared.
    tree = VpTree(points, radius, max(16, int(shard * share)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            leaves, places = tree.route(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(leaves), pa.array(fp[places])], names=["shard", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task holds whole shards, one long a member; each shard is compared on its own.
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not held:
            return
        shards, fp = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
        order = np.lexsort((fp, shards))
        shards, fp = shards[order], fp[order]
        for members in np.split(fp, np.flatnonzero(np.diff(shards)) + 1):
            a, b = shard_links(members.view(np.uint64), radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(members[a]), pa.array(members[b])], names=["a", "b"])

    routed = distinct.select("fp").mapInArrow(released(route), "shard long, fp long")
    spread = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return routed.repartition(max(spread, min(tree.leaves, 4 * spread)), "shard").mapInArrow(released(compare), "a long, b long")


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root``: the smallest node that each node of ``pairs`` (columns ``a, b``) reaches.

    Alternating large and small stars: every round keeps connectivity and the rounds are
    logarithmic in the number of nodes.  Nodes that are their own root are included.
    """
    edges = cut(
        pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    )
    seen = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = cut(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        )
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def simhash_groups(
    docs: DataFrame, radius: int = 2, size: int = 3, id_col: str = "doc_id", text_col: str = "text",
    sample: int = SAMPLE, shard: int = SHARD,
) -> DataFrame:
    """``id, fingerprint, component_id`` of every row of ``docs``."""
    rows = cut(fingerprint_rows(docs, id_col, text_col, size))
    distinct = cut(rows.groupBy("fp").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")))
    roots = cut(components(links(distinct, radius, sample, shard)))
    grouped = roots.join(distinct, roots["node"] == distinct["fp"]).select("node", "root", "first_id")
    named = grouped.groupBy("root").agg(F.min("first_id").alias("component"))
    of_node = grouped.join(named, "root").select("node", "component")
    classes = distinct.join(of_node, distinct["fp"] == of_node["node"], "left").select(
        F.col("fp").alias("c_fp"), F.when(F.col("node").isNotNull(), F.col("component")).otherwise(F.col("first_id")).alias("component_id"), "copies"
    )
    # Fingerprints with a share of 1 / HOT of all rows or more are at most HOT; their rows need not meet in one task.
    least = distinct.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0] / HOT
    hot, rest = classes.where(F.col("copies") >= least), classes.where(F.col("copies") < least)
    hot = F.broadcast(hot.drop("copies"))
    same = F.col("fp") == F.col("c_fp")
    joined = rows.join(hot, same).unionByName(rows.join(hot, same, "left_anti").join(rest.drop("copies"), same))
    return joined.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
