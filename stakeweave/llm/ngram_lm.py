"""Language-model scores from an Elias-Fano n-gram trie that is kept in shards.

Model.  Counts are exact and over all training texts; n-grams that occur ``LEAST`` times or more
are in the model, at every corpus size, so the model grows with the corpus.  ``p(w)`` is the
contract's add-one estimate over all words; higher orders interpolate with absolute discounting,
``p(w | v) = (c(vw) - D) / c(v) + l(v) p(w)``, and likewise for two words of context; what pruned
and discounted n-grams leave goes to the lower order, so every context sums to one with it.

Flow.  Nothing of the model passes through the driver, and two shuffles serve counting and scoring.

1. Arrow batches cut texts into pages and reduce each page to its distinct trigrams (first word,
   second, third), with how often training texts of the page have them.  The trigrams go to the
   shard of their first word; the page itself keeps the place of each token's trigram.
2. A task that holds a shard sums the counts, builds the shard's trie, maps it into memory and
   looks up what the pages ask for: the counts and back-off weights of contexts, and n-grams.
3. The answers go back to the pages, which add up the logarithms text by text.

A bigram or trigram always stands in the shard of its first word, with its context.  The few words
with more than ``1 / shards`` of all tokens are dealt by their second word, and pairs of words with that
share by the third: each part of such a context sends its sums to every partition of step 3, which
adds them up.  Which contexts these are, how many shards there are and which words get short codes in
the shuffle is read from a sample of about ``SAMPLE`` texts; that alters sizes, never counts.

Trie.  Level 1 holds the shard's first words in order of hash, with their counts; level 2 the
successors of each, level 3 the successors of each bigram.  Level contents and the pointers
to the next level are Elias-Fano sequences; log probabilities and back-off weights are 12-bit codes
into quantile codebooks.  A look-up searches a word's successor among those of its context.
The file is a task's own scratch, already unlinked; a retried task builds it again.

Defined results: a null text reads as empty and has one token, the end; a null id is
not held out; repeated rows count as often as they occur and give a row each; without training
texts every count is 0; a long text is one page whatever its length; ids may be of any type;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeweave.llm.common import text_or_empty
from stakeweave.llm.elias_fano import EliasFano
from stakeweave.llm.kernels import LOWER, chunks, find_words, mix, released, span_hash, text_buffer

#: Occurrences that an n-gram needs to be in the model, at every corpus size.
LEAST = 2
DISCOUNT = 0.75
END = np.uint64(0xE4D0E4D0E4D0E4D1)
START = np.uint64(0x57A257A257A257A3)
CODES = 4096
#: Bytes of text in a page, tokens that are expected in a shard, texts in the sample and words with short codes.
PAGE_BYTES = 8 << 20
SHARD_TOKENS = 3 << 19
SAMPLE = 1 << 13
SHORT = 65_000
_K = np.uint64(0x9E3779B97F4A7C15)
_CUT = np.uint64(16)  # second and third words are told apart by 48 bits, inside their contexts
_ID_BITS = 31
_GRID = 4096.0  # answers carry log10 of back-off weights in steps of 1 / _GRID
_WIDE = -1  # in place of the count of a pair whose context several shards hold


def in_fold(id_col: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each token: a start mark, the words and an end for every text."""
    n = len(offsets) - 1
    low = LOWER[data]
    row, start, end = find_words(low, offsets)
    h = span_hash(low, start, end)
    count = np.bincount(row, minlength=n)
    out = np.empty(len(h) + 2 * n, np.uint64)
    rows = np.repeat(np.arange(n), count + 2)
    first = np.cumsum(count + 2) - (count + 2)
    out[first] = START
    out[first + count + 1] = END
    out[np.arange(len(h)) + 2 * row + 1] = h
    return rows, out


def _page_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``token_hashes`` of a page, computed in chunks that stay in a core's cache."""
    parts = []
    for a, b in chunks(offsets):
        rows, h = token_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        parts.append((rows + a, h))
    return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, each number's bytes set apart so that their zeros compress."""
    head = np.array([len(arrays), *[len(x) for x in arrays]], np.uint32).tobytes()
    raw = head + b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() for x in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    sizes = raw[4 : 4 + 4 * len(kinds)].view(np.uint32)
    out, at = [], 4 + 4 * len(kinds)
    for n, kind in zip(sizes.tolist(), map(np.dtype, kinds), strict=True):
        part = raw[at : at + n * kind.itemsize].reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(part.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


class Vocabulary:
    """Places of hashes in a sorted array."""

    def __init__(self, hashes: np.ndarray, bits_used: int = 64):
        self.hashes = hashes
        bits = max(1, int(np.log2(max(len(hashes), 1))) + 1)
        self.shift = np.uint64(bits_used - bits)
        self.first = np.searchsorted(hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it is absent."""
        out = np.full(len(h), -1, np.int64)
        bucket = (h >> self.shift).astype(np.int64)
        at, stop = self.first[bucket].astype(np.int64), self.first[bucket + 1]
        live = np.flatnonzero(at < stop)
        while len(live):
            hit = self.hashes[at[live]] == h[live]
            out[live[hit]] = at[live[hit]]
            at[live] += 1
            live = live[~hit]
            live = live[at[live] < stop[live]]
        return out


class Plan:
    """How trigrams are dealt to shards, and the short codes of frequent words (0: none).

    ``hot`` and ``wide`` are (key, parts): words and pairs of words whose contexts are dealt in parts.
    """

    def __init__(self, words: np.ndarray, hot: list, wide: list, shards: int):
        self.shards = shards
        self.words = np.concatenate([np.zeros(1, np.uint64), words])  # by code
        order = np.argsort(words)
        self._sorted, self._code = words[order], (order + 1).astype(np.uint16)
        self._book: Vocabulary | None = None
        code = {w: c + 1 for c, w in enumerate(words.tolist())}
        self.hot_of = np.full(len(words) + 1, -1, np.int32)
        hot = [(code[w], k) for w, k in hot if w in code]
        self.hot_of[[c for c, _ in hot]] = np.arange(len(hot))
        self.hot_parts = np.array([k for _, k in hot], np.uint64)
        held = sorted(((code[u] << 16) | code[v], k, int(self.hot_of[code[u]])) for (u, v), k in wide if u in code and v in code)
        held = [x for x in held if x[2] >= 0]
        self.wide = np.array([x[0] for x in held], np.int64)
        self.wide_parts = np.array([x[1] for x in held], np.uint64)
        self.wide_hot = np.array([x[2] for x in held], np.int64)

    def codes(self, h: np.ndarray) -> np.ndarray:
        if self._book is None:
            self._book = Vocabulary(self._sorted)
        if not len(self._sorted):
            return np.zeros(len(h), np.uint16)
        at = self._book.ids(h)
        return np.where(at >= 0, self._code[at], 0).astype(np.uint16)

    def wide_of(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Index of each pair of codes among the wide ones, or -1."""
        out = np.full(len(u), -1, np.int64)
        if len(self.wide):
            some = np.flatnonzero(self.hot_of[u] >= 0)
            key = (u[some].astype(np.int64) << 16) | v[some]
            at = np.minimum(np.searchsorted(self.wide, key), len(self.wide) - 1)
            out[some] = np.where(self.wide[at] == key, at, -1)
        return out

    def shard(self, u, u_code, v, v_code, w) -> np.ndarray:
        s = mix(u + np.uint64(1))
        hot = self.hot_of[u_code]
        at = np.flatnonzero(hot >= 0)
        if len(at):
            s[at] = mix(u[at] * _K + v[at] % self.hot_parts[hot[at]] + np.uint64(1))
            wide = self.wide_of(u_code[at], v_code[at])
            at, wide = at[wide >= 0], wide[wide >= 0]
            s[at] = mix(mix(u[at] * _K + v[at]) * _K + mix(w[at]) % self.wide_parts[wide] + np.uint64(1)) if len(at) else s[at]
        return (s % np.uint64(self.shards)).astype(np.int64)


def make_plan(rows: DataFrame, share: float | None = None, shards: int | None = None) -> Plan:
    """The plan for ``rows`` (column ``text``), from a sample of about ``SAMPLE`` of them."""
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = rows.count()
    part = min(1.0, SAMPLE / max(n, 1))
    picked = rows.select("text") if part == 1 else rows.select("text").sample(part, seed=11)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, none = [], np.zeros(0, np.uint64)
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            held += [_page_tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets, PAGE_BYTES)]
        h = np.concatenate([none, *[x for _, x in held]])
        word, times = np.unique(h, return_counts=True)
        yield entries(0, none[:1], none[:1], np.array([len(h)]))  # the number of tokens
        yield entries(1, word[times > 1], word[times > 1], times[times > 1])
        if share is None and len(h) < 1 << 14:
            return
        for rows, h in held:  # a pair that is frequent overall is frequent in some page
            two = np.flatnonzero(rows[1:] == rows[:-1])
            pair, at, times = np.unique(mix(h[two] * _K + h[two + 1]), return_index=True, return_counts=True)
            live = times >= max(2, len(h) * (share or 2.0**-15) / 2)
            yield entries(2, h[two[at[live]]], h[two[at[live]] + 1], times[live])

    def entries(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        if not kind:
            a = b = np.zeros(1, np.uint64)
        columns = [pa.array(np.full(len(n), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["kind", "a", "b", "n"])

    seen = picked.mapInArrow(released(count), "kind int, a long, b long, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    # The SHORT most frequent words, and at most about as many pairs.
    top = seen.orderBy(F.when(F.col("kind") == 0, 0).otherwise(1), F.desc("n"), "kind", "a", "b").limit(2 * SHORT).collect()
    tokens = max([r.n for r in top if r.kind == 0], default=0)
    shards = shards or max(spread, int(tokens / part / SHARD_TOKENS) + 1)
    least = max(1, tokens) * (share or max(1.0 / shards, 2.0**-15))
    words = [(r.a & (2**64 - 1), r.n) for r in top if r.kind == 1][:SHORT]
    pairs = [((r.a & (2**64 - 1), r.b & (2**64 - 1)), r.n) for r in top if r.kind == 2]
    hot, wide = ([(x, int(4 * n / least) + 1) for x, n in held if n >= least] for held in (words, pairs))
    return Plan(np.array([w for w, _ in words], np.uint64), hot, wide[: 1 << 15], shards)


def _changes(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return new


def _lengths(new: np.ndarray) -> np.ndarray:
    return np.diff(np.append(np.flatnonzero(new), len(new)))


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint16)


_ASK = ("u4", "u2", "u8", "u4", "u2", "u4", "u2", "u2", "u4", "u2", "u4")
_NO_WORD = 65535  # the code of a missing third word


def page_asks(rows: np.ndarray, h: np.ndarray, train: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, list[tuple[int, bytes]]]:
    """Of a page's tokens: number of trigrams of each text, each one's place among the distinct ones, and those packed by shard.

    Every token but a text's last begins one trigram; the last has no third word.
    """
    at = np.flatnonzero(rows[1:] == rows[:-1])
    code = plan.codes(h)
    n, third = np.bincount(rows[at], minlength=len(train)), np.minimum(at + 2, len(h) - 1)
    has = (rows[third] == rows[at]) & (at + 2 < len(h))
    u, v = h[at], h[at + 1] >> _CUT
    w = np.where(has, h[third] >> _CUT, np.uint64(0))
    u_code, v_code, w_code = code[at], code[at + 1], np.where(has, code[third], _NO_WORD).astype(np.uint16)
    shard = plan.shard(u, u_code, v, v_code, w)
    bits = lambda x, drop: x >> np.uint64(drop)
    group = (shard.astype(np.uint64) << np.uint64(44)) | (bits(u, 48) << np.uint64(28)) | (bits(v, 34) << np.uint64(14)) | bits(w, 34)
    order = np.argsort(group)  # equal trigrams meet but for rare clashes of these bits, which only repeat a question
    u, v, w, shard = u[order], v[order], w[order], shard[order]
    new = _changes(shard, u, v, w)
    place = np.empty(len(order), np.uint32)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    times = np.add.reduceat(train[rows[at[order]]].astype(np.int64), first) if len(first) else first
    u, v, w, shard, order = u[first], v[first], w[first], shard[first], order[first]
    new_u = _changes(shard, u)
    new_v = new_u | _changes(v)
    out = []
    edges = np.append(np.flatnonzero(_changes(shard)), len(shard))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        nu, nv = new_u[a:b].copy(), new_v[a:b].copy()
        ku, kv = order[a:b][nu], order[a:b][nv]
        cu, cv, cw = u_code[ku], v_code[kv], w_code[order[a:b]]
        out.append((int(shard[a]), pack(
            _lengths(nu).astype(np.uint32), cu, u[a:b][nu][cu == 0], _lengths(nv).astype(np.uint32), cv, *_halves(v[a:b][nv][cv == 0]),
            cw, *_halves(w[a:b][cw == 0]), np.minimum(times[a:b], 0xFFFFFFFF).astype(np.uint32),
        )))
    return n, place, out


def _read_asks(data: bytes, plan: Plan):
    """Runs of first words, runs of pairs, third words and counts of a packed page."""
    u_len, cu, eu, v_len, cv, lv, hv, cw, lw, hw, times = unpack(data, *_ASK)
    u = plan.words[cu]
    u[cu == 0] = eu

    def cut(codes, low, high) -> np.ndarray:
        x = plan.words[np.where(codes == _NO_WORD, 0, codes)] >> _CUT
        x[codes == 0] = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
        return x

    return u_len.astype(np.int64), cu, u, v_len.astype(np.int64), cv, cut(cv, lv, hv), cut(cw, lw, hw), times.astype(np.int64)


def _quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ``values`` and the codebook: means of equally full bins."""
    if not len(values):
        return np.zeros(0, np.uint16), np.zeros(1)
    distinct = np.unique(values)
    if len(distinct) <= CODES:
        return np.searchsorted(distinct, values).astype(np.uint16), distinct
    edges = np.unique(np.quantile(values, np.linspace(0, 1, CODES + 1)[1:-1]))
    code = np.searchsorted(edges, values, "right")
    book = np.bincount(code, values, len(edges) + 1) / np.maximum(np.bincount(code, minlength=len(edges) + 1), 1)
    return code.astype(np.uint16), book


def _ascending(local: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Each range shifted behind the last value of the one before."""
    local = local + 1
    size = np.diff(point)
    last = np.zeros(len(size), np.int64)
    last[size > 0] = local[point[1:][size > 0] - 1]
    return local + np.repeat(np.cumsum(last) - last, size)


def build_trie(words: np.ndarray, count: np.ndarray, pairs: tuple, triples: tuple) -> dict[str, np.ndarray]:
    """All arrays of a shard's trie, by name.

    ``words`` are first words in order of hash with their counts; ``pairs`` the kept bigrams (place of the first
    word, second word, count), ``triples`` the kept trigrams (place among ``pairs``, third word, count).
    """
    parent2, v, c2 = pairs
    names = np.unique(np.concatenate([v, triples[1]]))
    v = np.searchsorted(names, v)
    order = np.argsort((parent2 << _ID_BITS) | v)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    parent2, v, c2 = parent2[order], v[order], c2[order]
    parent3, w, c3 = place[triples[0]], np.searchsorted(names, triples[1]), triples[2]
    order = np.argsort((parent3 << _ID_BITS) | w)
    parent3, w, c3 = parent3[order], w[order], c3[order]
    # A pair that other shards share may be there for its trigrams alone, with a lesser count.
    p2 = np.maximum(c2 - DISCOUNT, 0) / np.maximum(count[parent2], 1)
    p3 = (c3 - DISCOUNT) / np.maximum(c2[parent3], 1)
    rest1 = 1 - np.bincount(parent2, np.where(c2 >= LEAST, p2, 0), len(words))
    rest2 = 1 - np.bincount(parent3, p3, len(c2))
    point1 = np.searchsorted(parent2, np.arange(len(words) + 1))
    point2 = np.searchsorted(parent3, np.arange(len(c2) + 1))
    out = {"hash": words, "count": count.astype(np.int64), "names": names}
    for name, values in (("point1", point1), ("level2", _ascending(v, point1)), ("point2", point2), ("level3", _ascending(w, point2))):
        out |= {f"{name}.{part}": x for part, x in EliasFano.build(values).items()}
    tiny = 1e-12
    for name, values in (("p2", p2), ("p3", p3), ("rest1", rest1), ("rest2", rest2)):
        out[f"{name}.code"], out[f"{name}.book"] = _quantise(np.log10(np.maximum(values, tiny)))
    return out


def map_arrays(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The arrays in a memory-mapped scratch file that has no name, each from a multiple of 64 bytes."""
    out, at = {}, 0
    with tempfile.TemporaryFile() as f:
        for x in arrays.values():
            raw = np.ascontiguousarray(x).view(np.uint8)
            f.write(raw.tobytes() + b"\0" * (-raw.nbytes % 64))
        f.write(b"\0" * 64)
        f.flush()
        held = np.memmap(f, np.uint8, "r")
        for name, x in arrays.items():
            out[name] = held[at : at + x.nbytes].view(x.dtype)
            at += -(-x.nbytes // 64) * 64
    return out


class Trie:
    """Look-ups in a stored model; all take arrays."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.words, self.names = Vocabulary(np.asarray(arrays["hash"])), Vocabulary(np.asarray(arrays["names"]), 48)
        self.count = arrays["count"]
        self.seq = {
            name: EliasFano({part: arrays[f"{name}.{part}"] for part in EliasFano.PARTS}) for name in ("point1", "level2", "point2", "level3")
        }
        self.code = {name: (arrays[f"{name}.code"], arrays[f"{name}.book"]) for name in ("p2", "p3", "rest1", "rest2")}

    def value(self, name: str, at: np.ndarray) -> np.ndarray:
        code, book = self.code[name]
        return book[code[at]]

    def successor(self, level: int, parent: np.ndarray, name: np.ndarray) -> np.ndarray:
        """Place in ``level`` of each parent's successor ``name``, or -1; places and names below 0 have none."""
        out = np.full(len(parent), -1, np.int64)
        some = np.flatnonzero((parent >= 0) & (name >= 0))
        pointer, held = self.seq[f"point{level - 1}"], self.seq[f"level{level}"]
        begin, end = pointer.access(parent[some]), pointer.access(parent[some] + 1)
        live = end > begin
        some, begin, end = some[live], begin[live], end[live]
        if not len(some):
            return out
        before = np.zeros(len(some), np.int64)
        inner = begin > 0
        before[inner] = held.access(begin[inner] - 1)
        at = held.find(before + name[some] + 1)
        out[some] = np.where((at >= begin) & (at < end), at, -1)
        return out


def _grid(log: np.ndarray, live: np.ndarray) -> np.ndarray:
    return np.where(live, np.clip(np.rint(-log * _GRID), 0, 65535), 0).astype(np.uint16)


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.cumsum(lengths) - lengths) if len(lengths) else np.zeros(0, np.int64)


#: Counts of trigrams; runs of pairs, their counts and back-off weights; runs of words, their counts and weights.
_ANSWER = ("i8", "u4", "i8", "u2", "u4", "i8", "u2")
_STATS = ("i8", "i8", "i8", "i8", "i8")


def answer_shard(asked: list, plan: Plan) -> tuple[list[bytes], bytes]:
    """An answer for each page's questions, and the shard's sums: tokens and words, hot words, wide pairs."""
    u_len, cu, u, v_len, cv, v, w, times = (np.concatenate(x) for x in zip(*asked, strict=True))
    pairs_of_u = np.searchsorted(np.cumsum(v_len), np.cumsum(u_len)) + 1
    pairs_of_u = np.diff(np.concatenate([[0], pairs_of_u]))
    u_run = np.repeat(np.arange(len(u)), pairs_of_u)
    words, first_u, of_u = np.unique(u, return_index=True, return_inverse=True)
    c1 = np.bincount(of_u, _sums(times, u_len), len(words)).astype(np.int64)
    pair_key = mix(u[u_run] * _K + v)
    pairs, first_p, of_p = np.unique(pair_key, return_index=True, return_inverse=True)
    c2 = np.bincount(of_p, _sums(times, v_len), len(pairs)).astype(np.int64)
    _, first_t, of_t = np.unique(mix(np.repeat(pair_key, v_len) * _K + w), return_index=True, return_inverse=True)
    c3 = np.bincount(of_t, times, len(first_t)).astype(np.int64)
    run_of_ask = np.repeat(np.arange(len(v)), v_len)
    pair_u, pair_v, tri_pair, tri_w = of_u[u_run[first_p]], v[first_p], of_p[run_of_ask[first_t]], w[first_t]
    hot = plan.hot_of[cu[first_u]]
    wide = plan.wide_of(cu[u_run[first_p]], cv[first_p])
    # Words that training texts have are level 1; kept n-grams the others.
    live1, live2, live3 = c1 > 0, (c2 >= LEAST) | ((wide >= 0) & (c2 > 0)), (c3 >= LEAST) & (tri_w > 0)
    to1, to2 = np.cumsum(live1) - 1, np.cumsum(live2) - 1
    trie = Trie(map_arrays(build_trie(
        words[live1], c1[live1], (to1[pair_u[live2]], pair_v[live2], c2[live2]), (to2[tri_pair[live3]], tri_w[live3], c3[live3])
    )))
    # What the pages ask for, each word, pair and trigram once.
    at1 = trie.words.ids(words)
    count = np.where(at1 >= 0, trie.count[at1], 0) if len(trie.count) else np.zeros(len(words), np.int64)
    rest1 = _grid(trie.value("rest1", at1), at1 >= 0) if len(trie.count) else np.zeros(len(words), np.uint16)
    at2 = trie.successor(2, at1[pair_u], trie.names.ids(pair_v))
    held2, rest2, found2 = np.zeros(len(at2), np.int64), np.zeros(len(at2), np.uint16), np.flatnonzero(at2 >= 0)
    # Probabilities times the count of their context are counts again, to within the codes' error.
    held2[found2] = np.rint(10.0 ** trie.value("p2", at2[found2]) * count[pair_u[found2]] + DISCOUNT)
    rest2[found2] = _grid(trie.value("rest2", at2[found2]), True)
    at3 = trie.successor(3, at2[tri_pair], trie.names.ids(tri_w))
    held3, found3 = np.zeros(len(at3), np.int64), np.flatnonzero(at3 >= 0)
    held3[found3] = np.rint(10.0 ** trie.value("p3", at3[found3]) * np.where(wide >= 0, c2, held2)[tri_pair[found3]] + DISCOUNT)
    shared = np.flatnonzero(wide >= 0)
    held2[shared], rest2[shared] = _WIDE, wide[shared]
    count = np.where(hot >= 0, -1 - hot, count)
    out, a, b, c = [], 0, 0, 0
    for x in asked:
        na, nb, nc = len(x[6]), len(x[3]), len(x[0])
        out.append(pack(held3[of_t[a : a + na]], x[3].astype(np.uint32), held2[of_p[b : b + nb]], rest2[of_p[b : b + nb]],
                        x[0].astype(np.uint32), count[of_u[c : c + nc]].astype(np.int64), rest1[of_u[c : c + nc]]))
        a, b, c = a + na, b + nb, c + nc
    kept = (c2 >= LEAST) & (wide < 0) & (hot[pair_u] >= 0)
    own = np.flatnonzero(hot >= 0)
    sums = [hot[own], c1[own], np.bincount(pair_u[kept], c2[kept], len(words))[own], np.bincount(pair_u[kept], minlength=len(words))[own]]
    s3, n3 = (np.bincount(tri_pair[live3], x, len(pairs))[shared] for x in (c3[live3], None))
    sums = np.stack([*sums, np.zeros(len(own))], axis=1)
    more = np.stack([wide[shared], c2[shared], s3, n3, np.ones(len(shared))], axis=1)
    # Kind 0: a hot word, 1: a wide pair, 2: tokens and words of the shard.
    totals = np.array([[0, c1.sum(), (live1 & (hot < 0)).sum(), 0, 2]])
    return out, pack(*np.concatenate([sums, more, totals]).astype(np.int64).T)


def _add_up(stats: list[bytes], plan: Plan) -> dict:
    """Totals of all shards: tokens, words, and of hot words and wide pairs their counts and back-off weights."""
    index, x, y, z, kind = (np.concatenate(p) for p in zip(*(unpack(s, *_STATS) for s in stats), strict=True))

    def total(values: np.ndarray, which: int, n: int) -> np.ndarray:
        return np.bincount(index[kind == which], values[kind == which], n)

    n_hot, n_wide = len(plan.hot_parts), len(plan.wide)
    c1, s2, n2 = (total(v, 0, n_hot) for v in (x, y, z))
    c2, s3, n3 = (total(v, 1, n_wide) for v in (x, y, z))
    whole = c2 >= LEAST
    s2 = s2 + np.bincount(plan.wide_hot[whole], c2[whole], n_hot)
    n2 = n2 + np.bincount(plan.wide_hot[whole], minlength=n_hot)
    rest = lambda c, s, n: np.where(c > 0, 1 - (s - DISCOUNT * n) / np.maximum(c, 1), 1.0)
    return {"n": int(x[kind == 2].sum()), "v": int(y[kind == 2].sum() + (c1 > 0).sum()), "c1": c1, "rest1": rest(c1, s2, n2), "c2": c2, "rest2": rest(c2, s3, n3)}


def score_page(n: np.ndarray, place: np.ndarray, answers: list[bytes], total: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Known tokens, base score and score of a page's texts; ``answers`` come in order of shard."""
    held3, v_len, held2, rest2, u_len, count, rest1 = (np.concatenate(x) for x in zip(*(unpack(d, *_ANSWER) for d in answers), strict=True))
    back = lambda code: 10.0 ** (code / -_GRID)
    # By run of first words, by run of pairs, then by question.
    hot = count < 0
    c1, l1 = np.maximum(count, 0).astype(float), back(rest1)
    c1[hot], l1[hot] = total["c1"][-1 - count[hot]], total["rest1"][-1 - count[hot]]
    l1[c1 == 0] = 1.0
    c2, l2 = held2.astype(float), np.where(held2 > 0, back(rest2), 1.0)
    wide = held2 == _WIDE
    c2[wide] = total["c2"][rest2[wide]]
    l2[wide] = np.where(c2[wide] >= LEAST, total["rest2"][rest2[wide]], 1.0)
    d2 = np.where(c2 >= LEAST, c2 - DISCOUNT, 0.0)
    d3 = np.where(held3 > 0, held3 - DISCOUNT, 0.0)
    c1, l1 = np.repeat(c1, u_len)[place], np.repeat(l1, u_len)[place]
    d2, l2, q3 = np.repeat(d2, v_len)[place], np.repeat(l2, v_len)[place], (d3 / np.repeat(np.maximum(c2, 1), v_len))[place]
    row = np.repeat(np.arange(len(n)), n)
    # The k-th trigram of a text begins with its k-th token (the start mark is the first) and speaks of the next one.
    first = np.cumsum(n) - n
    following = np.empty(len(row))
    following[:-1] = c1[1:]
    following[first + n - 1] = c1[first]  # as many ends as start marks
    p = np.where(c1 > 0, d2 / np.maximum(c1, 1), 0) + l1 * (following + 1) / (total["n"] + total["v"] + 1)
    inner = np.ones(len(row), bool)
    inner[first] = False
    inner = np.flatnonzero(inner)
    p[inner] = q3[inner - 1] + l2[inner - 1] * p[inner]
    sums = lambda x: np.bincount(row, x, len(n))
    return sums(following > 0), sums(np.log10(following + 1)) - n * np.log10(total["n"] + total["v"] + 1), sums(np.log10(p))


def score_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None,
    share: float | None = None, shards: int | None = None, page_bytes: int = PAGE_BYTES,
) -> DataFrame:
    """The contract's columns for every row of ``docs``; the model learns from rows that aren't ``held_out``.

    ``share`` of all tokens makes a context one that several shards hold; ``shards`` is their number.
    """
    held_out = in_fold(F.col(id_col)) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), held_out.alias("held_out"))
    plan = docs.sparkSession.sparkContext.broadcast(made := make_plan(rows, share, shards))  # SHORT words and 2 * SHORT contexts at most
    shards = made.shards
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"kind int, part int, page long, shard int, data binary, ids array<{kind}>"
    OWN, ASKED, STATS = 0, 1, 2

    def sent(kind: int, part, page, shard, data: list[bytes], ids: pa.Array) -> pa.RecordBatch:
        n = len(data)
        columns = [pa.array(np.full(n, kind, np.int32)), pa.array(part, pa.int32()), pa.array(page, pa.int64()), pa.array(shard, pa.int32()), pa.array(data, pa.binary()), ids]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    def home(page: np.ndarray) -> np.ndarray:
        """The partition of step 3 that a page belongs to: those of different tasks are dealt in turn."""
        return (((page >> 32) + (page & 0xFFFFFFFF) * 7919) % shards).astype(np.int32)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = TaskContext.get().partitionId() << 32
        for batch in batches:
            train = ~batch.column(2).to_numpy(zero_copy_only=False)
            data, offsets = text_buffer(batch.column(1))
            for a, b in chunks(offsets, page_bytes):
                tokens = _page_tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n, place, asked = page_asks(*tokens, train[a:b], plan.value)
                ids = batch.column(0).slice(a, b - a)
                lists = lambda n, values: pa.ListArray.from_arrays(pa.array([0] * n + [len(values)], pa.int32()), values)
                yield sent(OWN, home(np.array([page])), [page], [0], [pack(n.astype(np.uint32), train[a:b], place)], lists(1, ids))
                yield sent(ASKED, [s for s, _ in asked], [page] * len(asked), [s for s, _ in asked], [d for _, d in asked], lists(len(asked), ids.slice(0, 0)))
                page += 1

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages, asked, empty, shard = [], [], None, 0
        for batch in batches:
            own = pa.array(batch.column(0).to_numpy() == OWN)
            yield batch.set_column(1, "part", pa.array(home(batch.column(2).to_numpy()))).filter(own)
            rest = batch.filter(pa.array(batch.column(0).to_numpy() == ASKED))
            if rest.num_rows:
                pages.append(rest.column(2).to_numpy())
                asked += [_read_asks(x.as_py(), plan.value) for x in rest.column(4)]
                empty, shard = rest.column(5).slice(0, 1), rest.column(3)[0].as_py()
        if not asked:
            return
        pages = np.concatenate(pages)
        answers, stats = answer_shard(asked, plan.value)
        none = lambda n: pa.concat_arrays([empty] * n)
        yield sent(ASKED, home(pages), pages, np.full(len(pages), shard), answers, none(len(pages)))
        yield sent(STATS, np.arange(shards), np.zeros(shards, np.int64), np.full(shards, shard), [stats] * shards, none(shards))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found, stats = {}, {}, []
        for batch in batches:
            for kind, page, shard, data, ids in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), batch.column(5), strict=True):
                if kind == OWN:
                    own[page] = (data, ids.values)
                elif kind == ASKED:
                    found.setdefault(page, []).append((shard, data))
                else:
                    stats.append(data)
        if not own:
            return
        total = _add_up(stats, plan.value)
        for page, (data, ids) in own.items():
            n, train, place = unpack(data, "u4", "?", "u4")
            n = n.astype(np.int64)
            known, base, score = score_page(n, place, [d for _, d in sorted(found.pop(page), key=lambda x: x[0])], total)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(~train), pa.array(n), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), total["n"], np.int64)), pa.array(base), pa.array(score)],
                names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    asked = rows.mapInArrow(released(ask), schema).repartitionById(shards, "part")
    answered = asked.mapInArrow(released(answer), schema).repartitionById(shards, "part")
    final = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return answered.mapInArrow(released(finish), final).withColumnRenamed("id", id_col)
