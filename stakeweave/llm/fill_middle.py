"""Fill-in-middle: documents cut at two lines and put in prefix, suffix, middle order.

Method: content-defined chunk memoization.  A rolling hash over the last ``WINDOW`` bytes cuts
texts into chunks wherever its low bits are zero, so the same passage gives the same chunks in
whatever text it stands.  A worker keeps what it has learned of a chunk, its boundary
summary: line ends, code points, whether a sentinel lies inside, and the first and last bytes, where
a sentinel may cross into a neighbour.  A chunk seen before is recognised by its hash and then
compared byte for byte (both done by the dictionary that holds them).  Summaries of neighbours
combine, so a text's are added up, and running sums of line ends tell in which chunk a cut lies;
only that chunk is searched for its place.  The memory of chunks is emptied when it holds
``MEMO_BYTES``; that costs time only.

A text's units are its lines with their line ends; a last line without one is a unit too.  From the
first four groups of eight hex digits of the SHA-256 of ``<seed>:<id>``, h1 and h2 choose the cuts among
the ``n + 1`` ends of units, h3 whether the text is turned at all and h4 the order.

Defined results: a null text is the empty text; an empty text and one that holds a sentinel stay plain;
a null id hashes as the empty text; repeated rows each give a row; a text may be of any length (its
chunks are looked at one by one; the worker holds the text and its turned form); an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeweave.llm.common import text_or_empty
from stakeweave.llm.kernels import mix, released, text_buffer

SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes that the rolling hash sees; a power of two.
WINDOW = 32
#: A byte in 2**MASK_BITS ends a chunk; none is longer than MOST bytes.
MASK_BITS, MOST = 9, 1 << 12
MEMO_BYTES = 1 << 25
BLOCK = 1 << 19
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Gear hashes of the ``WINDOW`` bytes that end at each byte (fewer at the start), by doubling."""
    h, span = GEAR[data], 1
    while span < WINDOW:
        longer = h.copy()
        longer[span:] += h[:-span] << np.uint32(span)
        h, span = longer, 2 * span
    return h


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the chunks of all texts end, in rising order; every text that isn't empty ends one."""
    found = []
    for first in range(0, len(data), BLOCK):
        back = min(first, WINDOW - 1)
        h = rolling_hash(data[first - back : first + BLOCK])[back:]
        # The upper bits have seen the whole window; the low ones only its last bytes.
        found.append(np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + first + 1)
    ends = np.concatenate(found) if found else np.zeros(0, np.int64)
    begin = offsets[np.searchsorted(offsets, ends - 1, "right") - 1]
    # Hashes that reach over a text's start depend on its neighbour.
    ends = np.union1d(ends[ends - begin >= WINDOW], offsets[1:][np.diff(offsets) > 0])
    begin = np.append(0, ends[:-1])
    more = (ends - begin - 1) // MOST
    if more.any():
        step = np.arange(1, more.sum() + 1) - np.repeat(np.cumsum(more) - more, more)
        ends = np.union1d(ends, np.repeat(begin, more) + step * MOST)
    return ends


class Summary(NamedTuple):
    lines: int  # line ends
    chars: int  # code points that begin here
    found: bool  # a sentinel lies inside
    head: bytes
    tail: bytes


class Chunks:
    """Summaries of chunks, remembered by content."""

    def __init__(self, sentinels: Sequence[str], most_bytes: int = MEMO_BYTES):
        self.marks = tuple(s.encode() for s in sentinels)
        self.reach = max(map(len, self.marks)) - 1
        self.most = most_bytes
        self.memo: dict[bytes, Summary] = {}
        self.held = self.hits = 0

    def of(self, chunk: bytes) -> Summary:
        known = self.memo.get(chunk)
        if known is not None:
            self.hits += 1
            return known
        chars = len(chunk) if chunk.isascii() else int(np.count_nonzero(np.frombuffer(chunk, np.uint8) & 0xC0 != 0x80))
        known = Summary(chunk.count(b"\n"), chars, self.holds(chunk), chunk[: self.reach], chunk[len(chunk) - min(self.reach, len(chunk)) :])
        if self.held > self.most:
            self.memo.clear()
            self.held = 0
        self.memo[chunk] = known
        self.held += len(chunk)
        return known

    def holds(self, raw: bytes) -> bool:
        return any(m in raw for m in self.marks)

    def join(self, a: Summary, b: Summary) -> Summary:
        """The summary of two neighbours together."""
        head = a.head if len(a.head) == self.reach else (a.head + b.head)[: self.reach]
        tail = b.tail if len(b.tail) == self.reach else (a.tail + b.tail)[-self.reach :]
        return Summary(a.lines + b.lines, a.chars + b.chars, a.found or b.found or self.holds(a.tail + b.head), head, tail)


def draws(seed: int, doc_id) -> list[int]:
    """h1 to h4 of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4)]


def turn(raw: bytes, ends: np.ndarray, h: Sequence[int], known: Chunks, rate: int, spm_rate: int) -> tuple:
    """``(n, form, prefix_chars, middle_chars, output bytes)`` of one text whose chunks end at ``ends``."""
    if not raw:
        return 0, "plain", None, None, raw
    parts, begin, total = [], 0, Summary(0, 0, False, b"", b"")
    for end in ends.tolist():
        parts.append(known.of(raw[begin:end]))
        total = known.join(total, parts[-1])
        begin = end
    n = total.lines + (not raw.endswith(b"\n"))
    if total.found or h[2] % 100 >= rate:
        return n, "plain", None, None, raw
    lines = np.cumsum([p.lines for p in parts])
    chars = np.cumsum([p.chars for p in parts])

    def place(unit: int) -> tuple[int, int]:
        """Bytes and code points before the end of the unit of this number, counted from 1."""
        if unit > lines[-1]:
            return len(raw), int(chars[-1])
        if not unit:
            return 0, 0
        k = int(np.searchsorted(lines, unit))  # the chunk that holds the unit's line end
        at, before = (int(ends[k - 1]), int(chars[k - 1])) if k else (0, 0)
        missing, first = unit - (int(lines[k - 1]) if k else 0), at
        for _ in range(missing):
            at = raw.index(b"\n", at) + 1
        return at, before + len(raw[first:at].decode(errors="ignore"))

    one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    (a, before), (b, upto) = place(one), place(two)
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    first, second, third = known.marks
    if h[3] % 100 < spm_rate:
        return n, "spm", before, upto - before, b"".join((second, suffix, first, prefix, third, middle))
    return n, "psm", before, upto - before, b"".join((first, prefix, second, suffix, third, middle))


def fill_in_middle(
    docs: DataFrame,
    seed: int = 7,
    rate: int = 100,
    spm_rate: int = 50,
    sentinels: Sequence[str] = SENTINELS,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = 1 << 22,
) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` of every row: each text in its turned form.

    ``rate`` percent of the texts are turned, ``spm_rate`` percent of these with the suffix first.  No sentinel may
    hold or overlap another, so that ``restored`` finds each of them once.
    """
    marks = tuple(sentinels)
    for a in marks:
        for b in marks:
            if (a is not b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError("sentinels may not be empty, equal, inside each other or overlap")
    if len(marks) != 3 or len(set(marks)) != 3 or not all(marks):
        raise ValueError("three sentinels are needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Chunks(marks)

        def batch_of(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            n, form, before, middle, out = zip(*rows, strict=True)
            text = pa.array(out, pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), text],
                names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            names = batch.column(0).to_pylist()
            first, rows, held = 0, [], 0
            while first + len(rows) < len(names):
                # Chunks of as many texts as fill a block, or of one longer text.
                i = first + len(rows)
                last = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
                last = min(last, len(names))
                base = offsets[i]
                ends = chunk_ends(data[base : offsets[last]], offsets[i : last + 1] - base)
                cuts = np.searchsorted(ends, offsets[i : last + 1] - base, "right")
                for k in range(i, last):
                    own = ends[cuts[k - i] : cuts[k - i + 1]] - (offsets[k] - base)
                    raw = data[offsets[k] : offsets[k + 1]].tobytes()
                    rows.append(turn(raw, own, draws(seed, names[k]), known, rate, spm_rate))
                    held += len(raw)
                    if held >= batch_bytes:
                        yield batch_of(batch.column(0).slice(first, len(rows)), rows)
                        first, rows, held = first + len(rows), [], 0
            if rows:
                yield batch_of(batch.column(0).slice(first, len(rows)), rows)

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    turned = rows.mapInArrow(released(run), f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return turned.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that was turned, from its output and form alone."""
    first, second, third = sentinels

    def between(a: str, b: str) -> Column:
        return F.substring_index(F.substring_index(output, b, 1), a, -1)

    middle = F.substring_index(output, third, -1)
    psm = F.concat(between(first, second), middle, between(second, third))
    spm = F.concat(between(first, third), middle, between(second, first))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle_digest(docs: DataFrame, **options) -> DataFrame:
    """What ``fill_in_middle`` gives, with digests of the outputs and of the texts restored from them."""
    out = fill_in_middle(docs, **options)
    whole = restored(F.col("output"), F.col("form"), options.get("sentinels", SENTINELS))
    return out.select(
        options.get("id_col", "doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(whole, 256).alias("restored_sha256"),
    )
