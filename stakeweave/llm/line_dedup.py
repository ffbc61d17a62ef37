"""Line dedup by a set-similarity join over the lines of all texts, exact but for collisions of 64-bit hashes.

A line is its set of lower-cased (A-Z) words.  Lines stand in the order (id, line
number); a line goes when an earlier line of any text has Jaccard similarity of at
least ``threshold`` with it.  Lines without words stay.

1. One pass counts all words in a table of 2**24 counters indexed by the word's hash,
   kept as byte codes.  Its size is fixed, so it can be broadcast whatever the corpus; a
   shared counter makes a word look more frequent, which may cost candidates but never a
   match, because any order shared by all lines is valid.
2. Words of a line are ordered from rare to frequent, and its prefix of
   ``n - ceil(threshold * n) + 1`` words is posted under each of them.  A word that
   occurs once cannot be shared and is not posted.  Each task posts a set once, at its
   first place, so a line that fills a third of the corpus gives one row a task.
3. Postings meet by word.  Length, positional and parity filters find possible partners; a
   set names its ``NAMED`` earliest ones under each word, never all, and a set that has
   more is noted as open.
4. The words of sets named in a pair are read again, once a set (a Bloom filter of fixed size finds
   their lines in a scan), and pairs are verified.
5. If a set is open and none of its named partners matched, it and all its possible
   partners are posted again with all their words, and in each group it is verified
   against earlier ones until one matches.  So naming a few loses nothing.
6. Of every distinct set the first place stays if nothing earlier matched.

Every text has a number of its own that stands in the order of ids.  Where each id names one row, the id is
that number; else, or where ids aren't whole numbers, texts are numbered by (id, hashes of the text) in one
range sort of these keys, and joined with their number wherever they are read.

Sets of words are told apart by 64 bits of a hash over their words' hashes, and partners are verified on 64-bit
hashes of words; two given words or sets that differ share a hash with probability 2**-64.  Where one word's open lines are very many they are compared in one task.

Defined results: a null text reads as empty and has no lines with words; null ids sort last, ids may be of any
type that sorts; texts of one id stand in the order of a hash of their text; rows that are equal in id and
text are one text, so each of them gets the same lines; of equal lines the first stays; empty lines are kept
as they are; a text may be of any length; an empty table gives an empty result; other columns are
ignored (``dedup_lines`` carries them through, whatever their names).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeweave.llm.common import cut
from stakeweave.llm.kernels import CHUNK_BYTES, LOWER, find_words, mix, released, span_hash, text_buffer

BUCKET_BITS = 24
_PAGE = 1 << 18  # counters in one row of the count job
FILTER_BITS = 27
_ROW_BITS = 12  # lines of one block, so that a sort key holds line, rarity and hash


def _need(n: np.ndarray, threshold: float) -> np.ndarray:
    return np.ceil(n * threshold - 1e-9).astype(np.int64)


def _blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Lower-cased bytes, line offsets, text numbers and line numbers of a column, in blocks."""
    data, offsets = text_buffer(column)
    breaks = np.flatnonzero(data == 10) + 1
    starts = np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks])
    starts = np.unique(starts[starts < len(data)])
    owner = np.searchsorted(offsets, starts, "right") - 1
    # A break that ends a text starts no line of the next one.
    first = np.searchsorted(starts, offsets[:-1])
    number = np.arange(len(starts)) - first[owner]
    ends = np.append(starts[1:], len(data))
    lo = 0
    while lo < len(starts):
        hi = int(np.searchsorted(starts, starts[lo] + CHUNK_BYTES, "right"))
        hi = min(max(hi, lo + 1), lo + (1 << _ROW_BITS), len(starts))
        base = starts[lo]
        yield LOWER[data[base : ends[hi - 1]]], np.append(starts[lo:hi], ends[hi - 1]) - base, owner[lo:hi], number[lo:hi]
        lo = hi


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _code(counts: np.ndarray) -> np.ndarray:
    """Byte codes that ascend with counts: up to 64 the count itself, beyond it about six codes for each doubling."""
    out = np.minimum(counts, 64).astype(np.uint8)
    wide = np.flatnonzero(counts > 64)
    out[wide] = np.minimum(65 + np.floor(5.6 * np.log2(counts[wide].astype(np.float64) / 64)), 255).astype(np.uint8)
    return out


#: The count that each code stands for; exact up to 64.
_COUNT_OF = np.where(np.arange(256) <= 64, np.arange(256), 64 * 2 ** ((np.arange(256) - 64.5) / 5.6))


def word_rarity(docs: DataFrame) -> np.ndarray:
    """Codes of how often the words of each hash bucket occur in ``docs`` (column ``text``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << BUCKET_BITS, np.uint32)
        some = False
        for batch in batches:
            for data, lines, _, _ in _blocks(batch.column(0)):
                _, start, end = find_words(data, lines)
                at = np.sort((span_hash(data, start, end) >> np.uint64(64 - BUCKET_BITS)).astype(np.uint32))
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
                held[at[first]] += np.diff(np.append(first, len(at))).astype(np.uint32)
                some = True
        if some:
            yield from pages(range((1 << BUCKET_BITS) // _PAGE), np.split(_code(held), (1 << BUCKET_BITS) // _PAGE))

    def pages(numbers, held) -> Iterator[pa.RecordBatch]:
        packed = [zlib.compress(x.tobytes(), 1) for x in held]
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(packed, pa.binary())], names=["page", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for page, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = _COUNT_OF[np.frombuffer(zlib.decompress(packed), np.uint8)]
                held[page] = held[page] + counts if page in held else counts
        if held:
            yield from pages(list(held), [_code(x) for x in held.values()])

    schema = "page int, counts binary"
    n_pages = (1 << BUCKET_BITS) // _PAGE
    found = docs.select(F.col("text").cast("string")).mapInArrow(released(count), schema).repartition(n_pages, "page").mapInArrow(merge, schema)
    table = np.zeros(1 << BUCKET_BITS, np.uint8)
    for row in found.collect():  # 64 pages, 16 MB at most
        table[row["page"] * _PAGE : (row["page"] + 1) * _PAGE] = np.frombuffer(zlib.decompress(row["counts"]), np.uint8)
    return table


def _line_sets(data: np.ndarray, lines: np.ndarray, rarity: np.ndarray):
    """Sorted unique words of each line: keys, line of each, first place and size of each line with words."""
    row, start, end = find_words(data, lines)
    h = span_hash(data, start, end)
    key = (row.astype(np.uint64) << np.uint64(52)) | (rarity[_bucket(h)].astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    row = (key >> np.uint64(52)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    return key, row, first, size


_TOKEN = np.uint64((1 << 44) - 1)
#: Possible partners that a set names under each word.
NAMED = 4
#: A posting; ``pos`` is -1 where the row stands for the set itself and ``key`` is the set's hash, and -2 where it
#: stands for a text, with the number of its lines with words as ``line``.
#: ``tag`` is 40 bits of the set's own hash above 24 bits of its size; ``odd`` and ``odd2`` are 128 parities.
_POSTING = np.dtype([("key", "<i8"), ("odd", "<u8"), ("odd2", "<u8"), ("tag", "<i8"), ("doc", "<i8"), ("pos", "<i4"), ("line", "<i4")])
_HELD = 1 << 19  # postings that a task gathers before it writes pages


def _parities(token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 parities of each set's words: two sets differ in at least as many words as parities."""
    bit = np.uint64(1) << (token & np.uint64(63))
    upper = (token >> np.uint64(6) & np.uint64(1)).astype(bool)
    zero = np.uint64(0)
    return np.bitwise_xor.reduceat(np.where(upper, zero, bit), first), np.bitwise_xor.reduceat(np.where(upper, bit, zero), first)


def _set_hash(token: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(np.add.reduceat(mix(token), first) + size.astype(np.uint64)).view(np.int64)


def _post(docs: DataFrame, shared, threshold: float, parts: int) -> DataFrame:
    """``part, page``: postings of all lines, packed by the partition that compares them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = np.frombuffer(shared.value, np.uint8)
        seen: dict[int, tuple[int, int]] = {}
        held: list[np.ndarray] = []
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = np.zeros(len(ids), _POSTING)
            texts["key"], texts["doc"], texts["pos"] = ids, ids, -2
            for data, lines, owner, number in _blocks(batch.column(1)):
                rows, worded = postings(data, lines, ids[owner], number, rarity, seen)
                texts["line"] += np.bincount(owner[worded], minlength=len(ids)).astype(np.int32)
                held.append(rows)
                if sum(map(len, held)) > _HELD:
                    yield pages(np.concatenate(held))
                    held = []
            held.append(texts)
        if held:
            yield pages(np.concatenate(held))

    def postings(data, lines, ids, number, rarity, seen) -> tuple[np.ndarray, np.ndarray]:
        """Postings of a block's lines, and the places in the block of lines with words."""
        key, row, first, size = _line_sets(data, lines, rarity)
        line = row[first]
        if not len(first):
            return np.zeros(0, _POSTING), line
        token = key & _TOKEN
        sets = _set_hash(token, first, size)
        doc, no = ids[line], number[line]
        fresh = np.zeros(len(first), bool)
        for i, (s, place) in enumerate(zip(sets.tolist(), zip(doc.tolist(), no.tolist(), strict=True), strict=True)):
            if s not in seen or place < seen[s]:
                seen[s] = place
                fresh[i] = True
        odd, odd2 = _parities(token, first)
        which = np.repeat(np.arange(len(first)), size)
        pos = np.arange(len(key)) - first[which]
        prefix = size - _need(size, threshold) + 1
        rare = (key >> np.uint64(44)) & np.uint64(255)
        posted = np.flatnonzero(fresh[which] & (pos < prefix[which]) & (rare > 1))
        own, of = np.flatnonzero(fresh), which[posted]
        both = np.concatenate([own, of])
        out = np.zeros(len(both), _POSTING)
        out["key"] = np.concatenate([sets[own], token[posted].astype(np.int64)])
        out["pos"][: len(own)] = -1
        out["pos"][len(own) :] = pos[posted]
        for name, values in (("odd", odd), ("odd2", odd2)):
            out[name][len(own) :] = values[of]
        out["tag"][len(own) :] = (sets[of] << 24) | size[of]
        out["doc"], out["line"] = doc[both], no[both]
        return out, line

    def pages(rows: np.ndarray) -> pa.RecordBatch:
        part = (mix(rows["key"].view(np.uint64)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        cut_at = np.append(first, len(part))
        # Bytes of one place stand together, so that the shuffle's compression finds the zeros.
        packed = [rows[order[a:b]].view(np.uint8).reshape(b - a, -1).T.tobytes() for a, b in zip(cut_at[:-1], cut_at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), pa.array(packed, pa.binary())], names=["part", "page"])

    return docs.select("doc", "text").mapInArrow(released(run), "part int, page binary")


def _name(rows: np.ndarray, threshold: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of postings in order of key and size: pairs (later, earlier) with the ``most`` earliest possible partners
    of each row, rows that have more, and all possible partners of those.

    Row by row the pairs at distance 1, 2, ... inside a key are filtered, as far as sizes allow a match.
    """
    n = len(rows)
    size, pos = rows["tag"] & ((1 << 24) - 1), rows["pos"].astype(np.int64)
    odd, odd2 = np.ascontiguousarray(rows["odd"]), np.ascontiguousarray(rows["odd2"])
    doc, line = rows["doc"], rows["line"].astype(np.int64)
    if n and 0 <= doc.min() and doc.max() < 1 << 40 and line.max() < 1 << 22:
        rank = (doc << 22) | line
    else:
        rank = np.empty(n, np.int64)
        rank[np.lexsort((line, doc))] = np.arange(n)
    key = rows["key"]
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    # The last row of the group that is not too large: sizes ascend inside a group.
    wide = size.max(initial=0) / threshold + 2
    reach = np.searchsorted(group * wide + size, group * wide + size / threshold + 1e-6, "right") - 1 - np.arange(n)

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Later and earlier rows that may match; no later row twice in one step."""
        # The smaller set of a pair needs a shorter prefix: it shares at least 2t / (1 + t) of its own size.
        short = size - np.ceil(size * (2 * threshold / (1 + threshold)) - 1e-9).astype(np.int64) + 1
        at, step = np.flatnonzero((reach > 0) & (pos < short)), 1
        while len(at):
            to = at + step
            total = size[at] + size[to]
            need = np.ceil(total * (threshold / (1 + threshold)) - 1e-9)
            room = np.minimum(pos[at], pos[to]) + np.minimum(size[at] - pos[at], size[to] - pos[to])
            ok = np.flatnonzero(room >= need)
            a, b = at[ok], to[ok]
            near = np.bitwise_count(odd[a] ^ odd[b]).astype(np.int64) + np.bitwise_count(odd2[a] ^ odd2[b])
            ok = near <= total[ok] - 2 * need[ok]
            a, b = a[ok], b[ok]
            up = rank[a] < rank[b]
            yield b[up], a[up]
            yield a[~up], b[~up]
            step += 1
            at = at[reach[at] >= step]

    none = np.iinfo(np.int64).max
    named = np.full((n, most), none)  # ranks of partners
    who = np.zeros((n, most), np.int64)
    found = np.zeros(n, np.int64)
    for later, earlier in pairs():
        slot = named[later].argmax(1)
        better = rank[earlier] < named[later, slot]
        named[later[better], slot[better]] = rank[earlier[better]]
        who[later[better], slot[better]] = earlier[better]
        found[later] += 1
    is_open = found > most
    partner = np.zeros(n, bool)
    if is_open.any():
        for later, earlier in pairs():
            partner[earlier[is_open[later]]] = True
    later, slot = np.nonzero(named < none)
    return later, who[later, slot], np.flatnonzero(is_open), np.flatnonzero(partner)


#: Kind 0: the first place of a set.  1: a later and an earlier place that may match.  2: an open place.  3: a partner of one.
#: 4: a text and, as ``line``, the number of its lines with words.
_MET = "kind int, key long, doc long, line int, doc2 long, line2 int"


def _meet(posted: DataFrame, threshold: float, named: int, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [
            np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(_POSTING.itemsize, -1).T).view(_POSTING)[:, 0]
            for batch in batches for x in batch.column(1)
        ]
        if not held:
            return
        rows = np.concatenate(held)
        del held
        texts = rows[rows["pos"] == -2]
        yield _met(4, texts["key"], texts["doc"], texts["line"], texts["doc"], texts["line"])
        own = rows[rows["pos"] == -1]
        own = _first_places(own[np.argsort(own["key"])], "key")
        yield _met(0, own["key"], own["doc"], own["line"], own["doc"], own["line"])
        rows = rows[rows["pos"] >= 0]
        size = rows["tag"] & ((1 << 24) - 1)
        if size.max(initial=0) < 1 << 19:  # key and size in one number: words have 44 bits here
            rows = rows[np.argsort((rows["key"].astype(np.uint64) << np.uint64(19)) | size.astype(np.uint64))]
        else:
            rows = rows[np.lexsort((size, rows["key"]))]
        # Only keys with two postings or more can give pairs.
        count = np.diff(np.append(np.flatnonzero(_changes(rows, "key")), len(rows)))
        rows = _first_places(rows[np.repeat(count > 1, count)], "key", "tag", "odd")
        if not len(rows):
            return
        later, earlier, is_open, partner = _name(rows, threshold, named)
        doc, line = rows["doc"], rows["line"].astype(np.int64)
        pairs = np.unique(np.stack([doc[later], line[later], doc[earlier], line[earlier]], axis=1), axis=0)
        yield _met(1, np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1], pairs[:, 2], pairs[:, 3])
        for kind, at in ((2, is_open), (3, partner)):
            places = np.unique(np.stack([doc[at], line[at]], axis=1), axis=0)
            yield _met(kind, np.zeros(len(places), np.int64), places[:, 0], places[:, 1], places[:, 0], places[:, 1])

    def _first_places(rows: np.ndarray, *names: str) -> np.ndarray:
        """Of rows equal in ``names`` the one at the first place; rows come in order of the first name and, if any, of size."""
        if not len(rows):
            return rows
        size = rows["tag"] & ((1 << 24) - 1)
        new = _changes(rows, names[0]) | np.concatenate([[True], size[1:] != size[:-1]])
        run = np.diff(np.append(np.flatnonzero(new), len(rows)))
        many = np.repeat(run > 1, run)
        keep = ~many
        at = np.flatnonzero(many)
        sub = rows[at]
        order = np.lexsort((sub["line"], sub["doc"], *[sub[n] for n in reversed(names)]))
        keep[at[order[_changes(sub[order], *names)]]] = True
        return rows[keep]

    def _changes(rows: np.ndarray, *names: str) -> np.ndarray:
        new = np.zeros(len(rows), bool)
        new[:1] = True
        for name in names:
            new[1:] |= rows[name][1:] != rows[name][:-1]
        return new

    def _met(kind, key, doc, line, doc2, line2) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(doc), pa.array(line.astype(np.int32)),
                pa.array(doc2), pa.array(line2.astype(np.int32)),
            ],
            names=[c.split()[0] for c in _MET.split(", ")],
        )

    return posted.repartitionById(parts, "part").mapInArrow(released(run), _MET)


def _place_bits(doc: np.ndarray, line: np.ndarray) -> list[np.ndarray]:
    """Two bits of the filter for each place."""
    h = mix(doc.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + line.astype(np.uint64))
    return [(h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64), (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]


def place_filter(places: DataFrame) -> bytes:
    """A Bloom filter of ``places`` (``doc, line``): 16 MB whatever their number; once full it lets every place through."""
    page = _PAGE

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for bits in _place_bits(batch.column(0).to_numpy(), batch.column(1).to_numpy()):
                for number in np.unique(bits >> 21).tolist():
                    mine = bits[bits >> 21 == number] & ((1 << 21) - 1)
                    np.bitwise_or.at(held.setdefault(number, np.zeros(page, np.uint8)), mine >> 3, (1 << (mine & 7)).astype(np.uint8))
        yield _pages(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bits = np.frombuffer(zlib.decompress(packed), np.uint8)
                held[number] = held[number] | bits if number in held else bits
        yield _pages(held)

    def _pages(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        packed = [zlib.compress(x.tobytes(), 1) for x in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(packed, pa.binary())], names=["number", "bits"])

    n = (1 << FILTER_BITS) // 8 // page
    schema = "number int, bits binary"
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in places.select("doc", "line").mapInArrow(fill, schema).repartition(n, "number").mapInArrow(merge, schema).collect():
        out[row["number"] * page : (row["number"] + 1) * page] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return out.tobytes()


def _words_at(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``doc, line, key, words``: the set's hash and all its words' hashes, ascending, for ``places`` and a few others."""
    shared = docs.sparkSession.sparkContext.broadcast(place_filter(places))  # 16 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for data, lines, owner, number in _blocks(batch.column(1)):
                pick = np.ones(len(owner), bool)
                for bits in _place_bits(ids[owner], number):
                    pick &= (wanted[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(bool)
                pick = np.flatnonzero(pick)
                if not len(pick):
                    continue
                # Only the wanted lines are split into words.
                size = lines[pick + 1] - lines[pick]
                at = np.cumsum(size) - size
                data = data[np.repeat(lines[pick] - at, size) + np.arange(int(size.sum()))]
                row, start, end = find_words(data, np.append(at, len(data)))
                h = span_hash(data, start, end)
                if not len(row):
                    continue
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])
                row, h = row[new], h[new]
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                size = np.diff(np.append(first, len(row)))
                line = pick[row[first]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[owner[line]].astype(np.int64)), pa.array(number[line].astype(np.int32)),
                        pa.array(_set_hash(h >> np.uint64(20), first, size)),
                        pa.array([h[f : f + n].tobytes() for f, n in zip(first.tolist(), size.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["doc", "line", "key", "words"],
                )

    return docs.select("doc", "text").mapInArrow(released(run), "doc long, line int, key long, words binary")


def _similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= threshold * (len(a) + len(b) - shared) - 1e-9


def _verify_pairs(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """``key``: sets of the later places of ``pairs`` whose earlier one matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            hit = [_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit, pa.bool_()))], names=["key"])

    early = words.select(F.col("doc").alias("doc2"), F.col("line").alias("line2"), F.col("words").alias("words2"))
    both = pairs.join(early, ["doc2", "line2"]).join(words, ["doc", "line"])
    return both.select("key", "words", "words2").mapInArrow(run, "key long")


def _verify_open(words: DataFrame, shared, threshold: float) -> DataFrame:
    """``key``: open sets (column ``is_open``) of ``words`` that match an earlier set of it."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            tokens, owner = [], []
            for i, raw in enumerate(batch.column(3).to_pylist()):
                h = np.frombuffer(raw, np.uint64)
                h = h[np.lexsort((h, h >> np.uint64(20), rarity[_bucket(h)]))]
                h = h[: len(h) - max(1, ceil(len(h) * threshold - 1e-9)) + 1]
                tokens += h.view(np.int64).tolist()
                owner += [i] * len(h)
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), *batch.take(pa.array(owner, pa.int64())).columns], names=["token", *batch.schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        token, doc, line, key = (table.column(i).to_numpy() for i in range(4))
        words, is_open = table.column(4).combine_chunks(), table.column(5).to_numpy()
        order = np.lexsort((line, doc, token))
        lost: set[int] = set()
        for group in np.split(order, np.flatnonzero(np.diff(token[order])) + 1):
            # The first place of each set; places ascend inside the group.
            _, at = np.unique(key[group], return_index=True)
            group = group[np.sort(at)]
            if len(group) < 2 or not is_open[group].any():
                continue
            full = [np.frombuffer(words[int(i)].as_buffer(), np.uint64) for i in group]
            size = np.array([len(x) for x in full])
            first = np.cumsum(size) - size
            odd, odd2 = _parities(np.concatenate(full) >> np.uint64(20), first)
            for j in range(1, len(group)):
                b = group[j]
                if not is_open[b] or int(key[b]) in lost:
                    continue
                total = size[:j] + size[j]
                near = np.bitwise_count(odd[:j] ^ odd[j]).astype(np.int64) + np.bitwise_count(odd2[:j] ^ odd2[j])
                ok = near <= total - 2 * np.ceil(total * (threshold / (1 + threshold)) - 1e-9)
                ok &= (doc[group[:j]] != doc[b]) | (line[group[:j]] != line[b])
                if any(_similar(full[i], full[j], threshold) for i in np.flatnonzero(ok).tolist()):
                    lost.add(int(key[b]))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(lost), pa.int64())], names=["key"])

    spread = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posted = words.select("doc", "line", "key", "words", "is_open").mapInArrow(post, "token long, doc long, line int, key long, words binary, is_open boolean")
    return posted.repartition(spread, "token").mapInArrow(run, "key long")


def _numbers(docs: DataFrame) -> DataFrame | None:
    """``n_id, n_h1, n_h2, doc`` of every distinct text, or None where the ids are numbers that name one row each."""
    if docs.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        known = docs.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        if known.where("n > 1 OR id IS NULL").isEmpty():
            return None
    keys = docs.select(F.col("id").alias("n_id"), *_text_keys()).distinct()
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("n_id").asc_nulls_last(), "n_h1", "n_h2"]
    return cut(keys.repartitionByRange(spread, *order).sortWithinPartitions(*order).withColumn("doc", F.monotonically_increasing_id()))


def _text_keys() -> list[Column]:
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("n_h1"), F.xxhash64(F.lit(1), text).alias("n_h2")]


def _numbered(docs: DataFrame, numbers: DataFrame | None) -> DataFrame:
    """``docs`` (columns ``id, text`` and others) with the number of each text as ``doc``."""
    if numbers is None:
        return docs.withColumn("doc", F.col("id").cast("long"))
    keyed = docs.select("*", *_text_keys())
    same = F.col("id").eqNullSafe(F.col("n_id")) & (keyed["n_h1"] == numbers["n_h1"]) & (keyed["n_h2"] == numbers["n_h2"])
    return keyed.join(numbers, same).select(*docs.columns, "doc")


def _judge(rows: DataFrame, threshold: float, named: int) -> tuple[DataFrame, DataFrame]:
    """Of ``rows`` (``doc, text``): ``doc, n_lines`` of every one, and ``doc, lines`` (numbers from 0) of the lines with words that stay."""
    shared = rows.sparkSession.sparkContext.broadcast(word_rarity(rows).tobytes())  # 16 MB, whatever the input
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = cut(_meet(_post(rows, shared, threshold, parts), threshold, named, parts))
    pairs = met.where("kind = 1").select("doc", "line", "doc2", "line2").distinct()
    opened = met.where("kind IN (2, 3)").groupBy("doc", "line").agg(F.max(F.col("kind") == 2).alias("is_open"), F.max(F.col("kind") == 3).alias("is_partner"))
    ends = pairs.select("doc", "line").unionByName(pairs.select(F.col("doc2").alias("doc"), F.col("line2").alias("line"))).unionByName(opened.select("doc", "line"))
    words = cut(_words_at(rows, ends))
    lost = cut(_verify_pairs(pairs, words, threshold).distinct())
    # Open sets that none of their named partners matched; places and keys decide, words follow for the few.
    keys = words.select("doc", "line", "key")
    undecided = cut(opened.where("is_open").join(keys, ["doc", "line"]).join(lost, "key", "left_anti").select("doc", "line").distinct())
    if not undecided.isEmpty():
        places = undecided.withColumn("is_open", F.lit(True)).unionByName(opened.where("is_partner").select("doc", "line", F.lit(False).alias("is_open")))
        places = places.groupBy("doc", "line").agg(F.max("is_open").alias("is_open"))
        lost = lost.unionByName(_verify_open(words.join(places, ["doc", "line"]), shared, threshold).distinct())
    kept = met.where("kind = 0").select("key", "doc", "line").join(lost, "key", "left_anti")
    kept = kept.groupBy("doc").agg(F.array_sort(F.collect_list("line")).alias("lines"))  # the lines of one text
    return met.where("kind = 4").select("doc", F.col("line").cast("long").alias("n_lines")), kept


def _has_words(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.transform(lines, lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\f\r"))) > 0)


def line_dedup(docs: DataFrame, threshold: float = 0.8, named: int = NAMED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_removed, kept``: lines with words, how many went, and numbers of those that stay."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    numbers = _numbers(rows)
    texts, kept = _judge(_numbered(rows, numbers).select("doc", "text"), threshold, named)
    lines = F.coalesce(F.col("lines"), F.array().cast("array<int>"))
    found = texts.join(kept, "doc", "left").select("doc", "n_lines", (F.col("n_lines") - F.size(lines)).alias("n_removed"), lines.alias("kept"))
    if numbers is None:
        return found.select(F.col("doc").cast(rows.schema["id"].dataType).alias(id_col), "n_lines", "n_removed", "kept")
    return found.join(numbers.select("doc", "n_id"), "doc").select(F.col("n_id").alias(id_col), "n_lines", "n_removed", "kept")


def dedup_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` with their text reduced to the lines that stay, and all other columns as they are.

    A column ``n_chars`` follows the text.  Lines without words stay.  A text all of whose lines go becomes empty; its row stays.
    """
    # The row travels as one column, so no name of its columns can clash.
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), F.struct("*").alias("row"))
    numbers = _numbers(rows.select("id", "text"))
    kept = _judge(_numbered(rows.select("id", "text"), numbers).select("doc", "text"), threshold, NAMED)[1]
    joined = _numbered(rows, numbers).join(kept, "doc", "left")
    lines = F.split(F.col("text"), "\n")
    blank = F.filter(F.transform(_has_words(F.col("text")), lambda w, i: F.when(~w, i)), lambda i: i.isNotNull())
    stays = F.array_sort(F.concat(blank, F.coalesce(F.col("lines"), F.array().cast("array<int>"))))
    # The lines are held once, in an array of one element, while the numbers pick from them.
    text = F.element_at(F.transform(F.array(lines), lambda held: F.array_join(F.transform(stays, lambda i: F.get(held, i)), "\n")), 1)
    out = joined.select("row", F.when(F.col("text").isNotNull(), text).alias("text"))
    own = {"text": F.col("text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("row.n_chars"))
    return out.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
