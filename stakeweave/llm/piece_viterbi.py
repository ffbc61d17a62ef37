"""SentencePiece encoding and decoding by an Aho-Corasick automaton and one Viterbi pass.

The automaton runs over the UTF-8 bytes of all pieces.  At each byte its state names the
longest piece that ends there, and output links lead to every shorter one; each relaxes
the best score at the byte.  The segmentation has the greatest sum of piece scores.  A
character that no piece covers costs ``least score - 10`` and becomes its byte pieces
(or the unknown piece where the model has none).

Texts are normalised as the model says for the plain case: a space mark in front, spaces
as marks.  No supported piece has a mark behind another character, so the best
segmentation of a text is that of its words, each with the marks before it, one after
another; the pass runs once over each distinct word of a batch, for all words at
once, byte position by byte position.  A word longer than ``LONG`` bytes is walked on its own.

Of equal scores the longest last piece wins.  Defined results: a null text reads as
empty and has no pieces; repeated rows each give a row; an empty table gives an empty result; a text may be of any length, the worker holds its words and
ids; other columns are ignored by every operator here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeweave.llm.kernels import chunks, released, span_hash, text_buffer

MARK = "▁"
_MARK = MARK.encode()
LONG = 64
BATCH = 8192  # words walked together
UNKNOWN_PENALTY = 10.0
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model format


class PieceTable:
    """Pieces with scores and types, and the automaton over their bytes."""

    def __init__(self, pieces: Sequence[tuple[str, float, int]]):
        self.texts = [p.encode() for p, _, _ in pieces]
        self.types = [t for _, _, t in pieces]
        self.byte_id = np.full(256, -1, np.int64)
        self.unknown = 0
        usable = []
        for i, (piece, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_id[int(piece[1:-1], 16)] = i
            elif kind == UNKNOWN:
                self.unknown = i
            elif kind in (NORMAL, USER) and piece:
                usable.append(i)
        if any(MARK in pieces[i][0].lstrip(MARK) for i in usable):
            raise ValueError("a piece holds a space mark behind another character")
        scores = [pieces[i][1] for i in usable]
        self.unknown_score = (min(scores) if scores else 0.0) - UNKNOWN_PENALTY
        self._build(usable, [pieces[i][1] for i in usable])

    def _build(self, usable: list[int], scores: list[float]) -> None:
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for i in usable:
            state = 0
            for byte in self.texts[i]:
                nxt = children[state].get(byte)
                if nxt is None:
                    nxt = len(children)
                    children[state][byte] = nxt
                    children.append({})
                    ends.append(-1)
                state = nxt
            if ends[state] < 0:
                ends[state] = i
        n = len(children)
        # Rows of the dense table in order of depth: a state copies its failure state's row.
        self.step = np.zeros((n, 256), np.int32)
        fail = np.zeros(n, np.int32)
        self.link = np.zeros(n, np.int32)  # nearest shorter state that ends a piece; 0 for none
        end = np.array(ends)
        level = [0]
        while level:
            nxt_level = []
            for state in level:
                row = self.step[state]
                if state:
                    row[:] = self.step[fail[state]]
                for byte, child in children[state].items():
                    fail[child] = row[byte] if state else 0
                    row[byte] = child
                    f = fail[child]
                    self.link[child] = f if end[f] >= 0 else self.link[f]
                    nxt_level.append(child)
            level = nxt_level
        self.end = end.astype(np.int32)
        self.first_output = np.where(end >= 0, np.arange(n), self.link).astype(np.int32)
        self.length = np.array([len(self.texts[i]) if i >= 0 else 0 for i in ends], np.int32)
        score = dict(zip(usable, scores, strict=True))
        self.score = np.array([score.get(i, 0.0) for i in ends], np.float64)

    def encode_word(self, raw: bytes) -> list[int]:
        """Best pieces of one word, in a single pass over its bytes."""
        n = len(raw)
        best = [-np.inf] * (n + 1)
        best[0] = 0.0
        back, piece = [0] * (n + 1), [0] * (n + 1)
        state, head = 0, 0
        step, outputs, link, end, length, score = self.step, self.first_output, self.link, self.end, self.length, self.score
        for at in range(1, n + 1):
            byte = raw[at - 1]
            if byte & 0xC0 != 0x80:
                head = at - 1
            state = int(step[state, byte])
            out = int(outputs[state])
            while out:
                start = at - int(length[out])
                value = best[start] + float(score[out])
                if value > best[at]:
                    best[at], back[at], piece[at] = value, start, int(end[out])
                out = int(link[out])
            if at == n or raw[at] & 0xC0 != 0x80:
                value = best[head] + self.unknown_score
                if value > best[at] and not self._covered(raw[head:at]):
                    best[at], back[at], piece[at] = value, head, -1
        ids: list[int] = []
        at = n
        while at:
            start = back[at]
            if piece[at] >= 0:
                ids.append(piece[at])
            else:
                ids += self.unknown_ids(raw[start:at])[::-1]
            at = start
        return ids[::-1]

    def _covered(self, raw: bytes) -> bool:
        """Whether a piece is just this character; then it is never unknown."""
        state = 0
        for byte in raw:
            state = int(self.step[state, byte])
        return self.end[state] >= 0 and self.length[state] == len(raw)

    def unknown_ids(self, raw: bytes) -> list[int]:
        ids = self.byte_id[list(raw)].tolist()
        return ids if min(ids, default=-1) >= 0 else [self.unknown]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """``encode_word`` of all words, position by position for the short ones together."""
        out: list = [None] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.encode_word(w)
        short.sort(key=lambda i: -len(words[i]))
        for lo in range(0, len(short), BATCH):
            self._encode_short(words, short[lo : lo + BATCH], out)
        return out

    def _encode_short(self, words: list[bytes], short: list[int], out: list) -> None:
        """Words ``short``, in order of falling length, into their places of ``out``."""
        n = np.array([len(words[i]) for i in short])
        width = int(n[0])
        raw = np.zeros((len(short), width + 1), np.uint8)
        flat = np.frombuffer(b"".join(words[i] for i in short), np.uint8)
        raw[np.repeat(np.arange(len(short)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
        best = np.full((len(short), width + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((len(short), width + 1), np.int32)
        piece = np.full((len(short), width + 1), -1, np.int32)
        state = np.zeros(len(short), np.int32)
        head = np.zeros(len(short), np.int32)
        whole = np.zeros(len(short), np.int32)  # state of the walk from the character's head
        live = len(short)
        for at in range(1, width + 1):
            live = int(np.searchsorted(-n[:live], -at, "right"))  # words of at least ``at`` bytes
            byte = raw[:live, at - 1]
            begins = (byte & 0xC0) != 0x80
            head[:live][begins] = at - 1
            state = self.step[state[:live], byte]
            whole = self.step[np.where(begins, 0, whole[:live]), byte]
            out_state = self.first_output[state]
            rows = np.flatnonzero(out_state)
            cur = out_state[rows]
            while len(rows):
                start = at - self.length[cur]
                value = best[rows, start] + self.score[cur]
                better = value > best[rows, at]
                r = rows[better]
                best[r, at] = value[better]
                back[r, at] = start[better]
                piece[r, at] = self.end[cur[better]]
                cur = self.link[cur]
                more = cur > 0
                rows, cur = rows[more], cur[more]
            ended = (n[:live] == at) | ((raw[:live, at] & 0xC0) != 0x80)
            own = (self.end[whole] >= 0) & (self.length[whole] == at - head[:live])
            r = np.flatnonzero(ended & ~own)
            if len(r):
                value = best[r, head[r]] + self.unknown_score
                better = value > best[r, at]
                r = r[better]
                best[r, at] = value[better]
                back[r, at] = head[r]
                piece[r, at] = -1
        # Walk all paths back together; each step gives the last piece that is left of each word.
        place = n.copy()
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        odd: dict[int, list[tuple[int, int, int]]] = {}
        rows = np.arange(len(short))
        while len(rows):
            p = piece[rows, place[rows]]
            for r in rows[p < 0].tolist():
                odd.setdefault(r, []).append((len(steps), int(back[r, place[r]]), int(place[r])))
            steps.append((rows, p))
            place[rows] = back[rows, place[rows]]
            rows = rows[place[rows] > 0]
        taken = np.concatenate([r for r, _ in steps])
        ids = np.concatenate([p for _, p in steps])
        order = np.lexsort((-np.arange(len(taken)), taken))
        ids, taken = ids[order].tolist(), taken[order]
        first = np.searchsorted(taken, np.arange(len(short) + 1)).tolist()
        for k, i in enumerate(short):
            got = ids[first[k] : first[k + 1]]
            if k in odd:
                full: list[int] = []
                spans = [(a, b) for _, a, b in reversed(odd[k])]
                for x in got:
                    full += [x] if x >= 0 else self.unknown_ids(words[i][slice(*spans.pop(0))])
                got = full
            out[i] = got

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Piece ids of each text that ``offsets`` cuts ``data`` into."""
        result: list[np.ndarray] = []
        for a, b in chunks(offsets, 2 << 20):  # large chunks repeat more words
            base = offsets[a]
            text, cut = data[base : offsets[b]], offsets[a : b + 1] - base
            result += self._encode_chunk(text, cut)
        return result

    def _encode_chunk(self, text: np.ndarray, cut: np.ndarray) -> list[np.ndarray]:
        n = len(text)
        if not n:
            return [np.zeros(0, np.int32)] * (len(cut) - 1)
        # A word is a run of spaces (or marks) and what follows up to the next run; a text's first
        # word has the mark that the model puts in front.
        space = text == 32
        for i in np.flatnonzero(text == _MARK[0]).tolist():
            if bytes(text[i : i + 3]) == _MARK:
                space[i : i + 3] = True
        head = np.zeros(n, bool)
        head[1:] = space[1:] & ~space[:-1]
        head[cut[(cut < n)]] = True
        start = np.flatnonzero(head)
        end = np.append(start[1:], n)
        at_front = np.zeros(n + 1, bool)
        at_front[cut] = True
        h = span_hash(text, start, end) ^ np.where(at_front[start], np.uint64(0x5851F42D4C957F2D), np.uint64(0))
        _, one, which = np.unique(h, return_index=True, return_inverse=True)
        # Words of one hash are compared with the first of them byte by byte; should any differ, every word stands for itself.
        twin, size = start[one][which], end - start
        shift = np.repeat(twin - start, size)
        shift += np.arange(n)
        if (size != size[one][which]).any() or (at_front[start] != at_front[twin]).any() or (text[shift] != text).any():
            one = which = np.arange(len(start))
        raw = text.tobytes()
        words = [
            (_MARK if at_front[s] else b"") + raw[s:e].replace(b" ", _MARK) for s, e in zip(start[one].tolist(), end[one].tolist(), strict=True)
        ]
        found = self.encode_words(words)
        size = np.array([len(x) for x in found])
        flat = np.concatenate([np.array(x, np.int32) for x in found]) if found else np.zeros(0, np.int32)
        from_ = np.cumsum(size) - size
        n_ids = size[which]
        place = np.repeat(from_[which] - (np.cumsum(n_ids) - n_ids), n_ids) + np.arange(int(n_ids.sum()))
        ids = flat[place]
        marks = np.append(np.cumsum(n_ids) - n_ids, len(ids))
        return np.split(ids, marks[np.searchsorted(start, cut[1:-1])])

    def decode(self, ids: Sequence[int]) -> str:
        """The text that ids stand for: bytes joined, marks as spaces, the front mark dropped."""
        raw = b"".join(map(self._decoded().__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    def _decoded(self) -> list[bytes]:
        if not hasattr(self, "_plain"):
            self._plain = [
                bytes([int(t[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else t.replace(_MARK, b" ")
                for t, k in zip(self.texts, self.types, strict=True)
            ]
        return self._plain


def read_pieces(proto: bytes) -> list[tuple[str, float, int]]:
    """Pieces of a model file, which must not rewrite or trim its input."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(proto)
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
        raise ValueError("the model rewrites its input; only plain models are supported")
    return [(p.piece, p.score, p.type) for p in model.pieces]


_tables: dict[bytes, PieceTable] = {}


def _table(proto: bytes) -> PieceTable:
    key = hashlib.sha256(proto).digest()
    if key not in _tables:
        _tables[key] = PieceTable(read_pieces(proto))
    return _tables[key]


def encode_pieces(docs: DataFrame, model_proto: bytes, id_col: str = "doc_id", text_col: str = "text", rows: int = 128) -> DataFrame:
    """``id, n_pieces, ids, round_trip``: the piece ids of every text, and whether they decode to it."""
    shared = docs.sparkSession.sparkContext.broadcast(model_proto)  # the model file, half a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                texts = [x or "" for x in part.column(1).to_pylist()]
                ids = table.encode(*text_buffer(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                        pa.array([table.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)]),
                    ],
                    names=["id", "n_pieces", "ids", "round_trip"],
                )

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(released(run), f"id {kind}, n_pieces long, ids array<int>, round_trip boolean").withColumnRenamed("id", id_col)


def decode_pieces(encoded: DataFrame, model_proto: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, text``: the text of every array of piece ids; a null array decodes to the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model_proto)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(shared.value)
        for batch in batches:
            texts = [table.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    picked = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def encode_digest(docs: DataFrame, model_proto: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_pieces, ids_sha256, round_trip`` from ``encode_pieces``.

    ``ids_sha256`` is over the ids in decimal, joined by commas.
    """
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encode_pieces(docs, model_proto, id_col, text_col).select(
        id_col, "n_pieces", F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), "round_trip"
    )
