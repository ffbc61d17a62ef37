"""Document fingerprints by consistent weighted sampling.

A text is the multiset of its word shingles; a shingle's weight is how often it occurs.
Sample k of a text is its term of least ``c / (y * exp(r))`` with
``t = floor(log(weight) / r + b)``, ``y = exp(r * (t - b))``, where r and c are Gamma(2, 1) and b is
uniform, all fixed by the term and k.  A sample is the pair (term, t); two texts agree
in a sample with probability equal to their generalised Jaccard similarity, the sum of
least weights over the sum of greatest.

The draws of a term come from three tables of 4096 rows, each indexed by its own bits of
the term's hash, so they need no random generator per term.  Terms that share all 36
bits share draws; samples still tell them apart by the whole hash.

Texts stand in the order of ids and are dealt to ranges of it, whose bounds are keys read once from a sample; so
a range means the same in every job.  Each range gets the first text of the next one as well, and every
text meets its next one there: the texts are shuffled once.

Defined results: a null text reads as empty; a text without words has a fingerprint of
zeros and is wholly like another such text (1) and unlike any other (0); null ids come
first; rows with one id stand in order of a hash of their text, and rows equal in both are
folded into one with their number before they are shuffled, each but the last followed by
itself; the last row's next is the first (a single row's is itself); a text may be of any length; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeweave.llm.common import cut
from stakeweave.llm.kernels import LOWER, chunks, find_words, mix, released, shingle_hash, span_hash, text_buffer

SAMPLES = 64
_ROWS = 4096
_BLOCK = 4096  # terms drawn at once
_tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _draws(samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, log c and b for each row and sample, from a fixed seed."""
    if samples not in _tables:
        draw = np.random.default_rng(20240229)
        r = draw.gamma(2.0, 1.0, (_ROWS, samples)).astype(np.float32)
        log_c = np.log(draw.gamma(2.0, 1.0, (_ROWS, samples))).astype(np.float32)
        b = draw.random((_ROWS, samples), np.float32)
        _tables[samples] = (np.maximum(r, 1e-6), log_c, b)
    return _tables[samples]


def signatures(data: np.ndarray, offsets: np.ndarray, size: int = 5, samples: int = SAMPLES) -> np.ndarray:
    """One row of ``samples`` 32-bit sample hashes for each text that ``offsets`` cuts ``data`` into."""
    n = len(offsets) - 1
    out = np.zeros((n, samples), np.uint32)
    r_of, log_c_of, b_of = _draws(samples)
    low = np.uint64(_ROWS - 1)
    for first, last in chunks(offsets):
        text = LOWER[data[offsets[first] : offsets[last]]]
        row, start, end = find_words(text, offsets[first : last + 1] - offsets[first])
        if not len(row):
            continue
        h, own = shingle_hash(span_hash(text, start, end), row, last - first, size)
        order = np.lexsort((h, own))
        h, own = h[order], own[order]
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])]))
        weight = np.diff(np.append(new, len(h))).astype(np.float32)
        h, own = h[new], own[new]
        best = np.full((last - first, samples), np.inf, np.float32)
        won = np.zeros((last - first, samples), np.uint64)
        for lo in range(0, len(h), _BLOCK):
            term, rows, w = h[lo : lo + _BLOCK], own[lo : lo + _BLOCK], weight[lo : lo + _BLOCK]
            r, log_c = r_of[(term & low).astype(np.int64)], log_c_of[(term >> np.uint64(12) & low).astype(np.int64)]
            b = b_of[(term >> np.uint64(24) & low).astype(np.int64)]
            heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            # log a = log c - r * (t - b) - r; t is 0 for weight 1.
            t = np.zeros_like(b)
            many = np.flatnonzero(w > 1)
            if len(many):
                t[many] = np.floor(np.log(w[many])[:, None] / r[many] + b[many])
            a = log_c - r * (t - b + np.float32(1))
            least = np.minimum.reduceat(a, heads, axis=0)
            size_of = np.diff(np.append(heads, len(rows)))
            # The first term, in order of hash, that reaches the least value.
            hit = a == np.repeat(least, size_of, axis=0)
            place = np.where(hit, np.arange(len(rows))[:, None], len(rows))
            place = np.minimum.reduceat(place, heads, axis=0)
            docs = rows[heads]
            better = least < best[docs]
            sample = mix(term[place] + t[place, np.arange(samples)].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            best[docs] = np.where(better, least, best[docs])
            won[docs] = np.where(better, sample, won[docs])
        out[first:last] = (won >> np.uint64(32)).astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def edited_text(text: str, following: str) -> str:
    """``text`` with its last ``floor(n / 2)`` code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(ids: list, texts: list[str], followers: list[str], kind: pa.DataType, size: int, samples: int) -> pa.RecordBatch:
    edited = [edited_text(x, y) for x, y in zip(texts, followers, strict=True)]
    # Followers are mostly the next texts themselves, so only the others are fingerprinted again.
    own = signatures(*text_buffer(pa.array(texts, pa.large_string())), size, samples)
    odd = [i for i in range(len(texts)) if i + 1 >= len(texts) or followers[i] is not texts[i + 1]]
    nxt = np.roll(own, -1, axis=0)
    if odd:
        nxt[odd] = signatures(*text_buffer(pa.array([followers[i] for i in odd], pa.large_string())), size, samples)
    other = signatures(*text_buffer(pa.array(edited, pa.large_string())), size, samples)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, kind),
            pa.array([len(x) for x in texts], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
            pa.array([x.astype(">u4").tobytes().hex() for x in own], pa.string()),
            pa.array([x.astype(">u4").tobytes().hex() for x in other], pa.string()),
            pa.array(likeness(own, other)),
            pa.array(likeness(own, nxt)),
        ],
        names=["id", *(c.split()[0] for c in _OUT.split(", "))],
    )


_ORDER = ("id", "tie", "tie2")


def _key(values=None, kind: str = "") -> Column:
    if values is None:
        return F.struct(*_ORDER)
    return F.struct(F.lit(values[0]).cast(kind).alias("id"), F.lit(values[1]).alias("tie"), F.lit(values[2]).alias("tie2"))


def _range_of(bounds: list, kind: str) -> Column:
    """The number of bounds that a row's key reaches, found in two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = int(len(bounds) ** 0.5) + 1
    every = F.array(*[_key(b, kind) for b in bounds])
    count = lambda some: F.size(F.filter(some, lambda b: b <= _key()))
    first = (count(F.array(*[_key(b, kind) for b in bounds[::step]])) - 1) * step
    return F.when(first < 0, 0).otherwise(first + count(F.slice(every, F.greatest(first, F.lit(0)) + 1, step)))


def edit_likeness(
    docs: DataFrame, size: int = 5, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text", batch_rows: int = 256
) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and that of the next text."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"), F.xxhash64(F.lit(1), text).alias("tie2"))
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema["id"].dataType.simpleString()
    keys = cut(rows.groupBy(*_ORDER).agg(F.count(F.lit(1)).alias("n")))  # three numbers a row
    if keys.where("n > 1").isEmpty():
        rows = rows.withColumn("n", F.lit(1).cast("long"))
    else:  # rows that are equal in id and text are folded by each task before they are shuffled
        rows = rows.groupBy(*_ORDER).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    order = [F.col("id").asc_nulls_first(), "tie", "tie2"]
    # About 16 keys a range; every bound is a key, so no range is empty.
    sample = keys.where(F.rand(5) < 16 * spread / max(keys.count(), 1)).select(*_ORDER).limit(32 * spread).orderBy(*order).collect()
    bounds = [tuple(r) for r in (sample[1:] if len(sample) <= spread else sample[len(sample) // spread :: len(sample) // spread][: spread - 1])]
    part = _range_of(bounds, kind)
    firsts = keys.groupBy(part.alias("part")).agg(F.min(_key()).alias("k")).orderBy("part").collect()  # one key a range
    turned = [(r.part, *firsts[(i + 1) % len(firsts)].k) for i, r in enumerate(firsts)]
    heads = spark.createDataFrame(turned, f"part int, h_id {kind}, h_tie long, h_tie2 long")
    same = F.col("id").eqNullSafe(F.col("h_id")) & (F.col("tie") == F.col("h_tie")) & (F.col("tie2") == F.col("h_tie2"))
    heads = rows.join(F.broadcast(heads), same)  # a row for each range
    dealt = rows.select(part.alias("part"), *_ORDER, "n", F.lit(False).alias("late"), "text")
    dealt = dealt.unionByName(heads.select("part", *_ORDER, "n", F.lit(True).alias("late"), "text"))
    ordered = dealt.repartitionById(spread, "part").sortWithinPartitions("late", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row of the range with the one that follows it; the last row is the head of the next range."""
        last: tuple | None = None
        for batch in batches:
            for lo in range(0, batch.num_rows, batch_rows):
                piece = batch.slice(lo, batch_rows)
                ids, texts, times = (piece.column(i).to_pylist() for i in range(3))
                if last is not None:
                    ids, texts, times = [last[0], *ids], [last[1], *texts], [last[2], *times]
                last = (ids[-1], texts[-1], times[-1])
                if len(ids) > 1:
                    yield counted(_compare(ids[:-1], texts[:-1], texts[1:], batch.schema.field(0).type, size, samples), [1] * (len(ids) - 1))
                many = [i for i in range(len(ids) - 1) if times[i] > 1]
                if many:
                    own = [texts[i] for i in many]
                    pairs = [_compare([ids[i]], [x], [x], batch.schema.field(0).type, size, samples) for i, x in zip(many, own, strict=True)]
                    for pair, i in zip(pairs, many, strict=True):
                        yield counted(pair, [times[i] - 1])

    def counted(rows: pa.RecordBatch, times: list[int]) -> pa.RecordBatch:
        return rows.append_column("times", pa.array(times, pa.int64()))

    found = ordered.select("id", "text", "n").mapInArrow(released(run), f"id {kind}, {_OUT}, times long")
    every = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("_")
    return found.select("*", every).drop("times", "_").withColumnRenamed("id", id_col)
