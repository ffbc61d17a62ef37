"""Best-fit packing: documents' tokens in as few sequences of a fixed capacity as can be.

Method: best-two-fit.  A sequence is filled greedily with the longest piece that fits; when nothing fits
any more and it holds several, its shortest piece is replaced by the two unpacked pieces
that fill the widened gap best, if they fill it more tightly.  Pieces of at most a sixth of the capacity wait until the others
are packed, and then each goes where it fits most tightly.  Only lengths matter to this, so the
rule runs over the numbers of pieces of each length, of which there are ``capacity``, and a filling repeats as
long as it would come out the same.  Each filling leaves one length with fewer pieces than it needs, of
at most ``2 * capacity / length``, so there are at most about ``2 * capacity * (1 + ln capacity)`` of them at any size of
the corpus, each with a few runs of small pieces (their lengths differ and fit its gap); the driver holds these and no row.
Pieces are ranked by length over ranges of that order, and each looks up where the pieces of its rank lie.

Tokens come from the library inside Arrow batches.  For byte-level models without a normaliser, texts are cut before each
single space between characters that are no white space: such a model begins a new unit there
whatever stands around, so the parts' ids joined are the text's ids (the model's definition is read to tell whether this
holds; otherwise whole texts are encoded).  Arrow cuts some megabytes of texts and tells their words apart, so each word is looked up once
for all its places there.  Words end before marks behind Latin letters and about single line ends too, as the model's units do.
Words seen before come from a memory of two halves of ``KNOWN`` each: a full one becomes
the older half, whose words move over when they are met again and go with it when the next one is full.  New words that are
one unit go to the library without its pattern.

A document is its ids and the end id; one of more than ``capacity`` is cut into pieces of ``capacity``, of which the
first may be shorter.

Defined results: a null or empty text is the end id alone; repeated rows are packed one by one; a null id stays null; texts may be of any length
(part by part for byte-level models, but the ids of one document are held by its task); an empty table gives an empty
result; equal lengths are dealt in the order of id, piece and a hash of the ids; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeweave.llm.common import cut, positions, text_or_empty
from stakeweave.llm.kernels import released

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: A run without white space, with what follows it up to the next single space between two such runs.
PART = re.compile(r"\s*\S+(?:(?:\s\s+|[^\S ])\S*)*|\s+")
#: A piece of at most the capacity's share of this is small.
SMALL = 6
#: Where a part isn't just a space and a word: white space beside a space, or a space at an edge.  As in ``str.isspace``.
WHITE = r"[\s\v\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ROUGH = f"^ | $| {WHITE}|{WHITE} |\x01"
#: Stands before a word that follows no space; texts that hold it are rough.
CLOSE = "\x01"
#: Latin letters, and marks that no added token has behind one.
LETTERS, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r".,;:!?)\]}\"$%&*#"
#: Where words end besides: a line end before a word of ASCII, and marks before a space.
LINE_END, MARKS_END = (rf"([^{WHITE[1:]})\n\b", f"\\1 {CLOSE}\n {CLOSE}"), (f"([{LETTERS}])([{MARKS}]+)( |$)", rf"\1 {CLOSE}\2\3")
#: Words that are one unit.
SIMPLE = re.compile(f"[{LETTERS}]+|[{MARKS}]+|[0-9]+|\n")
#: Words in each half of a worker's memory, and the longest of them in characters.
KNOWN, KNOWN_CHARS = 1 << 19, 32
#: New words that are encoded as one text.
JOINED = 512
#: Characters of a text that are looked at together, and of texts.
WINDOW, TOGETHER = 1 << 16, 1 << 23
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of whole texts by a tokenizer's definition, word by word where that gives the same."""

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(definition)
        spec = json.loads(definition)
        before = spec.get("pre_tokenizer") or {}
        byte_level = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        added = spec.get("added_tokens") or []
        plain = not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        self.parts = byte_level and spec.get("normalizer") is None and plain
        # A byte-level token has a character for each of its bytes.
        vocabulary = self.model.get_vocab(with_added_tokens=False)
        self.lengths = np.zeros(max([*vocabulary.values(), *(t["id"] for t in added), 0]) + 1, np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)
        for t in added:
            self.lengths[t["id"]] = len(t["content"].encode())
        # The same model behind units that are cut already, in the characters of its tokens; byte 0 parts them.
        self.units = None
        if self.parts and not any(re.search(f"[{LETTERS}][{MARKS}]", t["content"]) for t in added):
            cut_at = {"type": "CharDelimiterSplit", "delimiter": " "}
            self.units = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": cut_at, "added_tokens": [], "post_processor": None, "truncation": None, "padding": None}))
        self.characters = _byte_characters() | {0: " "}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as unsigned little-endian 32-bit numbers."""
        if not self.parts:
            return self._encode(texts)
        out: list[list[bytes]] = [[] for _ in texts]
        held, size = [], 0
        for i, text in enumerate(texts):
            first = 0
            while first < len(text):
                last = self._cut(text, first + WINDOW)
                held.append((i, text[first:last], first > 0))
                size += last - first
                first = last
                if size > TOGETHER:
                    self._fill(held, out)
                    held, size = [], 0
        self._fill(held, out)
        return [b"".join(x) for x in out]

    def _fill(self, held: list[tuple[int, str, bool]], out: list[list[bytes]]) -> None:
        """Appends to ``out`` the ids of texts held as place there, characters, and whether these begin with a part's space."""
        rough = pc.match_substring_regex(pa.array([t[inner:] for _, t, inner in held], pa.large_string()), ROUGH).to_pylist()
        # What precedes the first space is encoded alone, as are units that aren't a space and a word.
        heads = [None if r else "" if inner else t.partition(" ")[0] for (_, t, inner), r in zip(held, rough, strict=True)]
        smooth = [(t[len(head) + 1 :], k) for k, ((_, t, _), head) in enumerate(zip(held, heads, strict=True)) if head is not None and len(head) < len(t)]
        ids: list[list[bytes]] = [[] for _ in held]
        alone = [(ids[k], head) for k, head in enumerate(heads) if head]
        for (found, _), raw in zip(alone, self._encode([head for _, head in alone]), strict=True):
            found.append(raw)
        if smooth:
            rest = pa.array([t for t, _ in smooth], pa.large_string())
            for pattern, by in (LINE_END, MARKS_END) if self.units else ():
                rest = pc.replace_substring_regex(rest, pattern, by)
            lists = pc.split_pattern(rest, " ")
            for (_, k), raw in zip(smooth, self._joined(lists, {}), strict=True):
                ids[k].append(raw)
        others = [k for k, r in enumerate(rough) if r]
        if others:
            units = [PART.findall(held[k][1]) for k in others]
            odd = dict(enumerate(u for some in units for u in some))
            odd = {n: u for n, u in odd.items() if u[0] != " " or u[1:2] == CLOSE or _rough(u[1:])}
            lists = pa.array([[u[1:] for u in some] for some in units], pa.large_list(pa.large_string()))
            for k, raw in zip(others, self._joined(lists, odd), strict=True):
                ids[k].append(raw)
        for (i, _, _), found in zip(held, ids, strict=True):
            out[i] += found

    def _joined(self, lists: pa.Array, odd: dict[int, str]) -> list[bytes]:
        """The ids of each list of words that follow a space each; at the places in ``odd`` are units of another kind."""
        coded = lists.flatten().dictionary_encode()
        place = coded.indices.to_numpy()
        if odd:
            place = place.copy()
            met = np.bincount(np.delete(place, list(odd)), minlength=len(coded.dictionary))
            place[list(odd)] = len(coded.dictionary) + np.arange(len(odd))
            words = coded.dictionary.filter(pa.array(met > 0))
            place = np.append(np.cumsum(met > 0) - 1, np.arange(len(odd)) + len(words))[place]
        else:
            words = coded.dictionary
        table = pa.array(self._ids(words.to_numpy(zero_copy_only=False).tolist()) + self._encode(list(odd.values())), pa.large_binary())
        ids = table.take(pa.array(place))
        ends, raw = np.frombuffer(ids.buffers()[1], np.int64), ids.buffers()[2]
        ends = ends[lists.offsets.to_numpy()].tolist()
        return [raw[a:b].to_pybytes() for a, b in zip(ends, ends[1:], strict=False)]

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of different words, a space before each that ``CLOSE`` doesn't begin."""
        got = list(map(self.known.get, words))
        missing = [k for k, ids in enumerate(got) if ids is None]
        fresh = self._fresh([words[k] for k in missing])
        for k in missing:
            got[k] = fresh[words[k]]
        if len(self.known) > KNOWN:
            self.older, self.known = self.known, {}
        self.known.update([x for x in fresh.items() if len(x[0]) <= KNOWN_CHARS])
        return got

    def _fresh(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words that aren't in the newer half of the memory."""
        found = self._met_before(words)
        missing = [w for w in words if w not in found] if found else words
        apart = [w for w in missing if w[:1] != CLOSE]
        close = [w[1:] for w in missing if w[:1] == CLOSE]
        simple = {w for w in apart + close if SIMPLE.fullmatch(w)} if self.units else set()
        found |= self._encode_words([w for w in apart if w in simple], " ") | self._encode_mixed([w for w in apart if w not in simple])
        own = self._encode_words([w for w in close if w in simple], "")
        mixed = [w for w in close if w not in simple]
        own |= zip(mixed, self._encode(mixed), strict=True)
        return found | {CLOSE + w: ids for w, ids in own.items()}

    def _met_before(self, words: Iterable[str]) -> dict[str, bytes]:
        return {w: ids for w in words if (ids := self.older.get(w))} if self.older else {}

    def _encode_words(self, words: list[str], before: str) -> dict[str, bytes]:
        """Ids of simple words with ``before`` in front."""
        found: dict[str, bytes] = {}
        for i in range(0, len(words), JOINED):
            some = words[i : i + JOINED]
            text = "\0".join([before + w for w in some]).encode().decode("latin-1").translate(self.characters)
            ids = self._told_apart(self.units, text, list(map(len, text.split(" "))))
            found.update(zip(some, ids or self._encode([before + w for w in some]), strict=True))
        return found

    def _encode_mixed(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of any kind with a space in front."""
        found: dict[str, bytes] = {}
        for i in range(0, len(words), JOINED):
            some = words[i : i + JOINED]
            ids = self._told_apart(self.model, " " + " ".join(some), [len(w.encode()) + 1 for w in some])
            found.update(zip(some, ids or self._encode([" " + w for w in some]), strict=True))
        return found

    def _told_apart(self, model: Tokenizer, text: str, sizes: list[int]) -> list[bytes] | None:
        """Ids of the words of a text with so many bytes each, by the bytes of its tokens; none if a token crosses words."""
        ids = np.array(model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends, cuts = np.cumsum(self.lengths[ids]), np.cumsum(sizes)
        at = np.searchsorted(ends, cuts)
        if not len(ends) or ends[-1] != cuts[-1] or (ends[at] != cuts).any():
            return None
        raw, place = ids.tobytes(), [0, *((at + 1) * 4).tolist()]
        return [raw[a:b] for a, b in zip(place, place[1:], strict=False)]

    @staticmethod
    def _cut(text: str, at: int) -> int:
        """The first place from ``at`` on where a part may begin, or the end."""
        while at < len(text) - 1:
            at = text.find(" ", at)
            if at < 0 or at >= len(text) - 1:
                return len(text)
            if not text[at - 1].isspace() and not text[at + 1].isspace():
                return at
            at += 1
        return len(text)


def _rough(word: str) -> bool:
    return not word or word[0].isspace() or word[-1].isspace()


def _byte_characters() -> dict[int, str]:
    """The character of each byte in the tokens of a byte-level model: its own if that can be seen, else one from 256 on in order."""
    seen = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + n) for n, b in enumerate(hidden)}


def encoder(definition: str) -> Encoder:
    if definition not in _encoders:
        _encoders[definition] = Encoder(definition)
    return _encoders[definition]


def token_pieces(
    docs: DataFrame, definition: str, capacity: int = 1024, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", batch_ids: int = 1 << 20,
    keep_ids: bool = True,
) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` of every piece, and its ``ids`` (unsigned little-endian 32-bit numbers) if they are kept.

    Ids that are not kept never leave the worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # a tokenizer file, some megabytes
    end = np.array([] if end_id is None else [end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(shared.value)
        for batch in batches:
            for first, n in slices(batch.column(1)):
                yield from pieces_of(batch.slice(first, n), model)

    def slices(texts: pa.Array) -> list[tuple[int, int]]:
        """Rows with some megabytes of text each: where they begin, and how many they are."""
        share = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // TOGETHER
        first = np.flatnonzero(np.diff(share, prepend=-1))
        return list(zip(first.tolist(), np.diff(first, append=len(share)).tolist(), strict=True))

    def pieces_of(batch: pa.RecordBatch, model: Encoder) -> Iterator[pa.RecordBatch]:
        encoded = model.encode(batch.column(1).to_pylist())
        held: list[tuple] = []
        size = 0
        for row, raw in enumerate(encoded):
            ids = memoryview(raw + end)
            n = len(ids) // 4
            short = n % capacity
            for piece, start in enumerate([*([0] if short else []), *range(short, n, capacity)]):
                stop = short if start < short else start + capacity
                own = ids[4 * start : 4 * stop]
                held.append((row, piece, start, stop - start, zlib.crc32(own), *([own] if keep_ids else [])))
                size += stop - start
                if size >= batch_ids:
                    yield made(batch, held)
                    held, size = [], 0
        if held:
            yield made(batch, held)

    def made(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        rows, piece, *others, crc = zip(*[h[:5] for h in held], strict=True)
        columns = [batch.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (*others, crc))]
        if keep_ids:
            columns.append(pa.array([h[5] for h in held], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    kinds = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    names = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    return rows.mapInArrow(released(run), kinds).withColumnRenamed("id", id_col)


class Plan:
    """Where the pieces of each length go, as runs of ranks that lie alike.

    The pieces of a run, ``each`` to a sequence, fill sequences from ``sequence`` on, from place ``at`` on.
    ``first`` counts pieces over all lengths, shorter ones first.
    """

    def __init__(self, runs: list[tuple[int, int, int, int, int]], sequences: int):
        table = np.array(sorted(runs), np.int64).reshape(-1, 5)
        self.first, self.each, self.sequence, self.at, self.length = table.T
        self.sequences = sequences

    def places(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces at these positions."""
        k = np.searchsorted(self.first, position, "right") - 1
        bin_, slot = np.divmod(position - self.first[k], self.each[k])
        return self.sequence[k] + bin_, self.at[k] + slot * self.length[k]


def best_two_fit(counts: np.ndarray, capacity: int) -> Plan:
    """The plan for ``counts[length]`` pieces of each length from 1 to ``capacity``.

    Pieces of more than ``capacity / SMALL`` are packed by best-two-fit.  The small ones wait until then, as they fit
    gaps of any kind: longest first, each goes where it fits most tightly, and to a new sequence where it fits nowhere.
    """
    left = np.asarray(counts, np.int64).copy()
    begin = np.cumsum(left) - left  # position of the first piece of a length
    used = np.zeros_like(left)
    small, runs, sequences = capacity // SMALL, [], 0
    #: Sequences that are alike, by the room that they have left: where they begin, and how many.
    gaps: dict[int, list[tuple[int, int]]] = {}

    def put(n: int, each: int, first: int, times: int, gap: int) -> None:
        runs.append((int(begin[n] + used[n]), each, first, capacity - gap, n))
        used[n] += each * times
        left[n] -= each * times

    large = left.copy()
    large[: small + 1] = 0
    while large.any():
        filling, need = _fill(large, capacity)
        times = int(1 + min((large[n] - need[n]) // k for n, k in filling))
        gap = capacity
        for n, k in filling:
            put(n, k, sequences, times, gap)
            large[n] -= k * times
            gap -= n * k
        gaps.setdefault(gap, []).append((sequences, times))
        sequences += times
    for n in range(min(small, len(left) - 1), 0, -1):
        for gap in sorted(g for g in gaps if g >= n):
            each = gap // n
            for first, times in gaps.pop(gap) if left[n] else ():
                some = int(min(times, left[n] // each))
                if some:
                    put(n, each, first, some, gap)
                    gaps.setdefault(gap - each * n, []).append((first, some))
                if some < times:  # the last pieces of a length fill one sequence in part
                    last = int(left[n])
                    if last:
                        put(n, last, first + some, 1, gap)
                        gaps.setdefault(gap - last * n, []).append((first + some, 1))
                        some += 1
                    if some < times:
                        gaps.setdefault(gap, []).append((first + some, times - some))
        if left[n]:
            each = capacity // n
            for k, times in ((each, int(left[n] // each)), (int(left[n] % each), 1)):
                if k and times:
                    put(n, k, sequences, times, capacity)
                    gaps.setdefault(capacity - k * n, []).append((sequences, times))
                    sequences += times
    return Plan(runs, sequences)


def _fill(left: np.ndarray, capacity: int) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """One sequence's lengths with their numbers, and how many pieces of a length must be there for the same filling."""
    gap, filling = capacity, {}
    while gap:
        fits = np.flatnonzero(left[: gap + 1])
        if not len(fits) or fits[-1] in filling:
            # A length is taken as often as it fits and is there, so one met again has no piece left; look below it.
            fits = np.array([n for n in fits if n not in filling])
        if not len(fits):
            break
        n = int(fits[-1])
        filling[n] = k = int(min(left[n], gap // n))
        gap -= k * n
    need = dict(filling)
    if gap and sum(filling.values()) > 1:
        shortest = min(filling)
        rest = left[: gap + shortest + 1].copy()
        for n, k in filling.items():
            if n < len(rest):
                rest[n] -= k
        pair = _best_pair(rest, gap + shortest)
        if pair and sum(pair) > shortest:
            filling[shortest] -= 1
            for n in pair:
                filling[n] = filling.get(n, 0) + 1
                need[n] = need.get(n, 0) + 1
    return sorted(((n, k) for n, k in filling.items() if k), reverse=True), need


def _best_pair(rest: np.ndarray, room: int) -> tuple[int, int] | None:
    """Two lengths of pieces in ``rest`` with the greatest sum of at most ``room``; of equal sums the one with the longest piece."""
    some = np.flatnonzero(rest > 0)
    if not len(some):
        return None
    k = np.searchsorted(some, room - some, "right") - 1  # the longest partner that fits
    alone = (k >= 0) & (some[k] == some) & (rest[some] < 2)
    k = np.where(alone, k - 1, k)
    fits = k >= 0
    if not fits.any():
        return None
    best = np.where(fits, some + some[k], -1)
    a = len(some) - 1 - int(np.argmax(best[::-1]))
    return int(some[a]), int(some[k[a]])


def pack(pieces: DataFrame, capacity: int = 1024, order: tuple[str, ...] = ("doc_id", "piece", "tie"), length_col: str = "length") -> DataFrame:
    """``pieces`` (checkpointed, with a ``length`` of 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    ``order`` names columns that decide among pieces of one length.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy(length_col).count().collect():  # at most a row for each length
        counts[r[length_col]] = r["count"]
    plan = pieces.sparkSession.sparkContext.broadcast(best_two_fit(counts, capacity))
    placed = positions(pieces, F.col(length_col), *(F.col(c).asc_nulls_last() for c in order), name="place")
    names = placed.columns
    at = names.index("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.value.places(batch.column(at).to_numpy())
            columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*(n for n in names if n != "place"), "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema if f.name != "place")
    return placed.mapInArrow(released(run), f"{kinds}, sequence_id long, offset long")


def packed_pieces(docs: DataFrame, definition: str, capacity: int = 1024, end_id: int | None = 2, keep_ids: bool = True, **options) -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece, and its ``ids`` if they are kept."""
    pieces = cut(token_pieces(docs, definition, capacity, end_id, keep_ids=keep_ids, **options))
    packed = pack(pieces, capacity, (options.get("id_col", "doc_id"), "piece", "start", "ids_crc32"))
    return packed


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``sequence_id, ids, pieces`` of every sequence: its ids joined, and which piece begins where."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", F.col(id_col).alias(id_col), "piece", "ids")))  # at most ``capacity`` pieces
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    empty = F.lit(b"")
    ids = F.aggregate("parts", empty, lambda done, p: F.concat(done, p["ids"]))
    spans = F.transform("parts", lambda p: F.struct(p["offset"].alias("offset"), p["length"].alias("length"), p[id_col].alias(id_col), p["piece"].alias("piece")))
    return rows.select("sequence_id", ids.alias("ids"), spans.alias("pieces"))
