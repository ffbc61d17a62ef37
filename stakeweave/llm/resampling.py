"""Importance resampling of documents towards a target's distribution of hashed n-grams.

Features are words and pairs of neighbouring words; a feature falls into the bucket that the CRC-32 of its bytes
names.  A bucket gains by being more frequent in the target than in the documents; a document weighs the mean gain of its
features, and the documents with the highest weights plus Gumbel noise are drawn.

Method: a head-tail vocabulary.  Words are counted exactly over all documents.  Those that make up one of ``2**16`` words or more
(so at most ``2**16``, of at most ``HEAD_BYTES`` bytes each) are the head; with each goes its CRC state, from which the
CRC of a pair goes on.  Pairs of head words are counted exactly too, and those that make up one of ``2**15`` go
with their buckets (at most ``2**15``).  Both tables are broadcast; their sizes are bounded by these shares at any size of the corpus.
What is not in them, the tail, takes its CRC directly, from the state of its first word.  Head and tail feed the same exact
bucket totals, so the head changes time, never results.  A long text is read in pieces of ``PIECE`` bytes cut
between words.

Words are counted in tasks before they are shuffled, so no word is hot; totals shuffle a row for a bucket and task; draws are ranked by
ranges of their order.  The driver holds the head, the gains (a number a bucket) and a count for each range.

Defined results: a null text has no words; a document without features weighs 0; a null id hashes as the empty text and sorts last; of rows with
one id and score the lighter comes first; repeated rows each count and each give a row; an empty table of documents gives
an empty result, an empty target gains as if each bucket were seen once; texts may be of any length; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeweave.llm.common import cut, positions, text_or_empty
from stakeweave.llm.kernels import LOWER, released, text_buffer

#: Words are runs of digits, letters a to z and characters beyond ASCII; these bytes never end inside a character.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NO_WORD = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
HEAD_WORDS, HEAD_PAIRS, HEAD_BYTES = 1 << 16, 1 << 15, 64
PIECE = 1 << 18
#: Distinct words or pairs that a task counts before it sends them on.
HELD = 1 << 18


class Head:
    """Frequent words with their CRC states and frequent pairs with their buckets."""

    def __init__(self, words: list[bytes], pairs: np.ndarray, paired: int, buckets: int):
        self.number = {w: i for i, w in enumerate(words)}
        self.paired = max(paired, 1)  # words below this number may stand in frequent pairs
        self.buckets = buckets
        # The last state belongs to no word; tail words find it first and overwrite it.
        self.state = np.array([crc32(w) for w in words] + [0], np.int64)
        self.pairs = np.sort(pairs)
        left, right = (x.tolist() for x in np.divmod(self.pairs, self.paired))
        at = [crc32(b" " + words[b], crc32(words[a])) % buckets for a, b in zip(left, right, strict=True)]
        self.pair_bucket = np.array([*at, 0], np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Places in the head, or -1."""
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))

    def pair_keys(self, number: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs that start at ``near`` hold paired words only, and their keys."""
        a, b = number[near], number[near + 1]
        both = (a >= 0) & (b >= 0) & (a < self.paired) & (b < self.paired)
        return both, a[both] * self.paired + b[both]

    def buckets_of(self, words: list[bytes], near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all words, and of the pairs that start at ``near``."""
        number = self.numbers(words)
        state = self.state[number]
        tail = np.flatnonzero(number < 0)
        state[tail] = np.fromiter(map(crc32, [words[i] for i in tail.tolist()]), np.int64, len(tail))
        pair = np.full(len(near), -1, np.int64)
        both, key = self.pair_keys(number, near)
        if len(self.pairs):
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            pair[both] = np.where(self.pairs[place] == key, self.pair_bucket[place], -1)
        rest = np.flatnonzero(pair < 0)
        first = near[rest]
        direct = [crc32(b" " + words[i + 1], s) for i, s in zip(first.tolist(), state[first].tolist(), strict=True)]
        pair[rest] = np.array(direct, np.int64) % self.buckets
        return state % self.buckets, pair


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[list[bytes], np.ndarray, bool]]:
    """Words of texts in blocks of about ``PIECE`` bytes, with each word's row.

    A text that is longer comes in several blocks; each but its first begins with the last word of the
    one before, which the flag tells.
    """
    words: list[bytes] = []
    rows: list[int] = []
    counts: list[int] = []
    held = 0

    def block(led: bool) -> tuple[list[bytes], np.ndarray, bool]:
        return words, np.repeat(np.array(rows, np.int64), counts), led

    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if a == b:
            continue
        if b - a <= PIECE:
            if held + b - a > PIECE and words:
                yield block(False)
                words, rows, counts, held = [], [], [], 0
            found = WORD.findall(LOWER[data[a:b]].tobytes())
            words += found
            rows.append(row)
            counts.append(len(found))
            held += b - a
            continue
        if words:
            yield block(False)
        words, rows, counts, held = [], [], [], 0
        last: list[bytes] = []
        while a < b:
            end = a + PIECE
            step = PIECE
            while end < b:  # on to the next byte that belongs to no word
                gap = NO_WORD.search(data[end : end + step].tobytes())
                if gap:
                    end += gap.start()
                    break
                end, step = end + step, 2 * step
            end = min(end, b)
            found = last + WORD.findall(LOWER[data[a:end]].tobytes())
            if len(found) > len(last):
                yield found, np.full(len(found), row), bool(last)
                last = found[-1:]
            a = end
    if words:
        yield block(False)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(text_or_empty(text_col).alias("text"))


def head_words(docs: DataFrame, text_col: str = "text") -> tuple[list[bytes], list[int], int]:
    """The head's words, most frequent first, their counts, and the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        total = 0

        def sent() -> pa.RecordBatch:
            short = [(w, n) for w, n in counts.items() if len(w) <= HEAD_BYTES]
            words = [w for w, _ in short] + [None]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([n for _, n in short] + [total], pa.int64())], names=["word", "n"])

        for batch in batches:
            for words, _, led in pieces(*text_buffer(batch.column(0))):
                counts.update(words[led:])
                total += len(words) - led
                if len(counts) > HELD:
                    yield sent()
                    counts.clear()
                    total = 0
        yield sent()

    counted = _texts(docs, text_col).mapInArrow(released(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # A word that occurs once in a corpus of more than HEAD_WORDS words is none of the head's; the null row has the total.
    counted = cut(counted.where((F.col("n") > 1) | F.col("word").isNull()))
    total = next((r.n for r in counted.where("word IS NULL").collect()), 0)
    # At most HEAD_WORDS rows, since each has that share of all words.
    rows = counted.where(F.col("word").isNotNull() & (F.col("n") * HEAD_WORDS >= total)).collect()
    rows.sort(key=lambda r: (-r.n, bytes(r.word)))
    return [bytes(r.word) for r in rows], [r.n for r in rows], total


def vocabulary(docs: DataFrame, buckets: int, text_col: str = "text") -> Head:
    """The head of the documents' words and pairs."""
    words, counts, total = head_words(docs, text_col)
    paired = sum(n * HEAD_PAIRS >= total for n in counts)
    alone = Head(words, np.zeros(0, np.int64), paired, buckets)
    shared = docs.sparkSession.sparkContext.broadcast(alone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, keys, counts = shared.value, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])

        waiting, held = [], 0
        for batch in batches:
            for words, rows, _ in pieces(*text_buffer(batch.column(0))):
                waiting.append(head.pair_keys(head.numbers(words), np.flatnonzero(rows[1:] == rows[:-1]))[1])
                held += len(waiting[-1])
                if held > 4 * HELD:
                    keys, counts = _merged(keys, counts, waiting)
                    waiting, held = [], 0
                    if len(keys) > 4 * HELD:
                        yield sent()
                        keys = counts = np.zeros(0, np.int64)
        keys, counts = _merged(keys, counts, waiting)
        yield sent()

    found = _texts(docs, text_col).mapInArrow(released(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # At most HEAD_PAIRS rows: there are fewer pairs than words.
    pairs = [r.pair for r in found.where(F.col("n") * HEAD_PAIRS >= total).select("pair").collect()] if paired else []
    return Head(words, np.array(pairs, np.int64), paired, buckets)


def _merged(keys: np.ndarray, counts: np.ndarray, waiting: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate([keys, *waiting])
    n = np.concatenate([counts, np.ones(len(every) - len(keys), np.int64)])
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    first = np.flatnonzero(np.diff(every, prepend=-1))
    return every[first], np.add.reduceat(n, first) if len(first) else n


def bucket_totals(docs: DataFrame, shared, text_col: str = "text") -> np.ndarray:
    """How many features of ``docs`` each bucket holds; ``shared`` is a broadcast ``Head``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        total = np.zeros(head.buckets, np.int64)
        for batch in batches:
            for words, rows, led in pieces(*text_buffer(batch.column(0))):
                one, two = head.buckets_of(words, np.flatnonzero(rows[1:] == rows[:-1]))
                total += np.bincount(one[led:], minlength=head.buckets) + np.bincount(two, minlength=head.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    summed = _texts(docs, text_col).mapInArrow(released(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(shared.value.buckets, np.int64)
    for r in summed.collect():  # a row for each bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths: the logarithm of its share in the target over that in the source, both smoothed by one."""
    buckets, every, wanted = len(source), int(source.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((float(t + 1) * float(every + buckets)) / (float(s + 1) * float(wanted + buckets))))
            for s, t in zip(source.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def gumbel(seed: int, doc_id) -> int:
    """Noise of a document in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, shared, gain: np.ndarray, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, key, n_words, n_features, weight, score`` of every row; ``key`` is a hash of the text."""
    gain_of = docs.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, worth = shared.value, gain_of.value
        for batch in batches:
            n = batch.num_rows
            count, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for words, rows, led in pieces(*text_buffer(batch.column(2))):
                near = np.flatnonzero(rows[1:] == rows[:-1])
                one, two = head.buckets_of(words, near)
                for row, value in ((rows[led:], worth[one[led:]]), (rows[near], worth[two])):
                    if len(row):
                        first = np.flatnonzero(np.diff(row, prepend=-1))
                        total[row[first]] += np.add.reduceat(value, first)
                count += np.bincount(rows[led:], minlength=n)
            features = count + np.maximum(count - 1, 0)
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            score = weight + np.array([gumbel(seed, i) for i in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x) for x in (count, features, weight, score))],
                names=["id", "key", "n_words", "n_features", "weight", "score"],
            )

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(released(run), f"id {kind}, key long, n_words long, n_features long, weight long, score long")


def importance_ranks(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 25,
    least_words: int = 20,
    buckets: int = 10000,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """``id, key, n_features, weight, score, rank`` of every row of ``docs``; rows that aren't drawn have no rank."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(docs, buckets, text_col))
    gain = gains(bucket_totals(docs, shared, text_col), bucket_totals(target, shared, target_text_col))
    weighed = cut(weigh(docs, shared, gain, seed, id_col, text_col))
    enough: Column = F.col("n_words") >= least_words
    drawn = percent * weighed.where(enough).count() // 100
    order = [enough.desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("weight"), F.col("n_features"), F.col("key")]
    ranked = positions(weighed, *order, name="place")
    rank = F.when(enough & (F.col("place") < drawn), F.col("place") + 1)
    return ranked.select(F.col("id").alias(id_col), "key", "n_features", "weight", "score", rank.alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, whole.

    A row is known by its id and a hash of its text; rows that agree in these are all taken if one of them is drawn.
    """
    ranks = importance_ranks(docs, target, id_col=id_col, text_col=text_col, **options).where("rank IS NOT NULL")
    keys = ranks.select(F.col(id_col).alias("_r_id"), F.col("key").alias("_r_key")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("_r_id")) & (F.xxhash64(text_or_empty(text_col)) == F.col("_r_key"))
    return docs.join(keys, same, "left_semi")
