"""Fill-in-middle, packing and importance resampling against plain rewrites of their definitions."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytestmark = pytest.mark.filterwarnings("ignore")


def key(row):
    return tuple((x is None, str(x)) for x in row)


def rows_of(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=key)


# Fill-in-middle


def turned(doc_id, text, seed=7, rate=100, spm=50):
    """(n, form, prefix_chars, middle_chars, output) by the definition."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = ["<P>", "a<S>b", "<", "<P", "x<M", "\n", "\n\n\n", "a\n", "\na", "é\n日本\n𠀀", "<P\n>", "\r\n\r\n", "end <", "P> start", "日本\n" * 3000, "<S" * 4000, "x" * 9000 + "<M>" + "y" * 9000]


@pytest.mark.parametrize("rate,spm", [(100, 50), (30, 80)])
def test_fill_in_middle(spark, rows, rate, spm):
    from stakeweave.llm.fill_middle import fill_in_middle, restored

    every = [(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(5000 + i, "line\nmore lines\n" * 20) for i in range(40)]
    docs = spark.createDataFrame(every, "doc_id long, text string").repartition(3)
    got = fill_in_middle(docs, rate=rate, spm_rate=spm)
    want = sorted(((i, *turned(i, t, rate=rate, spm=spm)) for i, t in every), key=key)
    assert rows_of(got, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output") == want
    back = got.select("doc_id", restored(F.col("output"), F.col("form")).alias("text"))
    assert rows_of(back, "doc_id", "text") == sorted(((i, t or "") for i, t in every), key=key)


def test_sentinels_must_be_told_apart(docs):
    from stakeweave.llm.fill_middle import fill_in_middle

    for bad in (("a", "b", "ab"), ("<<", "<x", "y"), ("", "a", "b"), ("a", "a", "b"), ("aa", "b", "c"), ("abc", "cd", "x")):
        with pytest.raises(ValueError):
            fill_in_middle(docs, sentinels=bad)


def test_summaries_of_chunks_combine():
    from stakeweave.llm.fill_middle import SENTINELS, Chunks, Summary

    draw = random.Random(1)
    for _ in range(400):
        raw = "".join(draw.choice("<PSM>\né a") for _ in range(draw.randrange(1, 30))).encode()
        cuts = sorted({draw.randrange(1, len(raw) + 1) for _ in range(4)} | {len(raw)})
        known, total, begin = Chunks(SENTINELS, most_bytes=20), Summary(0, 0, False, b"", b""), 0
        for end in cuts:
            total, begin = known.join(total, known.of(raw[begin:end])), end
        assert total == Summary(raw.count(b"\n"), len(raw.decode()), any(s.encode() in raw for s in SENTINELS), raw[:2], raw[-2:])


def test_chunks_follow_content():
    from stakeweave.llm import fill_middle
    from stakeweave.llm.fill_middle import MOST, chunk_ends

    draw = np.random.default_rng(3)
    shared = draw.integers(97, 123, 30000).astype(np.uint8)
    texts = [draw.integers(97, 123, n).astype(np.uint8) for n in (10, 700, 5000, 0, 1)]
    texts = [np.concatenate([t, shared]) for t in texts] + [np.zeros(20000, np.uint8)]
    data, offsets = np.concatenate(texts), np.append(0, np.cumsum([len(t) for t in texts]))
    ends = chunk_ends(data, offsets)
    assert set(offsets[1:]) <= set(ends) and np.diff(ends, prepend=0).max() <= MOST and (np.diff(ends) > 0).all()
    pieces = [collections.Counter(bytes(data[a:b]) for a, b in zip([lo, *e[:-1]], e)) for lo, hi in zip(offsets, offsets[1:]) for e in [ends[(ends > lo) & (ends <= hi)].tolist()]]
    common = pieces[0] & pieces[1] & pieces[2]
    assert sum(len(c) * n for c, n in common.items()) > 25000  # all but the edges of the shared passage
    for i, t in enumerate(texts):  # a text's chunks don't depend on its neighbours, nor on the size of blocks
        alone = chunk_ends(t, np.array([0, len(t)]))
        assert collections.Counter(bytes(t[a:b]) for a, b in zip([0, *alone[:-1]], alone)) == pieces[i]
    block, fill_middle.BLOCK = fill_middle.BLOCK, 1000
    try:
        assert (chunk_ends(data, offsets) == ends).all()
    finally:
        fill_middle.BLOCK = block


def test_fill_in_middle_matches_sql(docs):
    from stakeweave.llm.fill_middle import fill_in_middle_digest
    from stakeweave.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    cursor = con.execute(ORACLE_SQL["op11_fill_in_middle"])
    columns = [c[0] for c in cursor.description]
    assert rows_of(fill_in_middle_digest(docs), *columns) == sorted(cursor.fetchall(), key=key)


# Packing


@pytest.fixture(scope="module")
def definition():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


HARD = ["a  b", " lead", "trail ", "  ", "\t x", "x \n y", "it's  we'll 've", "a b   c", "a \x1c b", "x\x1c y", "<|endoftext|>", "a <|endoftext|> b", "日本 語 テ", "é é", "1 2  3\n\n 4", "a  b", " \x85 x", "word " * 700,
        "0123456789 " * 300, "x" * 3000, "\n" * 50, "a b c " * 5, "tab\tand space \t end", "(a) [b] {c}", "a .b , c", "é è ê"]


def test_parts_encode_as_whole_texts(definition):
    from stakeweave.llm import packing

    model = packing.Encoder(definition)
    assert model.parts
    draw = random.Random(6)
    texts = HARD + ["".join(draw.choice(["a", "b1", "'s", "don't", " ", " ", " ", "\n", "\t", "\x1c", " ", "é", "日", ".", ",", "<|endoftext|>", "9", "?", ")", "Word", "\n"]) for _ in range(draw.randrange(1, 60))) for _ in range(600)]
    want = [e.ids for e in model.model.encode_batch(texts, add_special_tokens=False)]
    plain = lambda found: [np.frombuffer(x, "<u4").tolist() for x in found]
    assert plain(model.encode(texts)) == plain(model.encode(texts)) == want
    window, known = packing.WINDOW, packing.KNOWN
    packing.WINDOW, packing.KNOWN = 7, 20
    try:
        assert plain(packing.Encoder(definition).encode(texts)) == want
    finally:
        packing.WINDOW, packing.KNOWN = window, known


def test_words_met_again_outlast_a_full_memory(definition, monkeypatch):
    from stakeweave.llm import packing

    monkeypatch.setattr(packing, "KNOWN", 4)
    model = packing.Encoder(definition)
    encoded = []
    own = model._encode_words
    monkeypatch.setattr(model, "_encode_words", lambda words, before: encoded.extend(words) or own(words, before))
    texts = [f"x again, b{i} c{i}" for i in range(12)]
    found = [np.frombuffer(model.encode([t])[0], "<u4").tolist() for t in texts]
    assert found == [e.ids for e in model.model.encode_batch(texts, add_special_tokens=False)]
    assert encoded.count("again") == 1 and len(model.known) + len(model.older) < 24


def test_words_that_end_at_marks_and_lines_encode_as_whole_texts(definition):
    from stakeweave.llm import packing

    model, draw = packing.Encoder(definition), random.Random(8)
    some = ["Word", "é", "ǆ", "×", "s", "n't", "_a", "12", ".", "!!", "$%", "'", "'s", "<|endoftext|>", "|>", "\x01", "ª", "日", "\n", "\n\n", "\r\n", "\t", " ", " ", " ", " ", "  "]
    texts = ["".join(draw.choices(some[: draw.randrange(14, len(some) + 1)] + [" "] * 8, k=draw.randrange(1, 40))) for _ in range(4000)]
    want = [e.ids for e in model.model.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in model.encode(texts)] == want


def test_a_word_is_looked_up_once_for_all_its_places(definition):
    from stakeweave.llm import packing

    class Known(dict):
        looked = 0

        def get(self, *key):
            self.looked += 1
            return super().get(*key)

    model = packing.Encoder(definition)
    model.known = known = Known()
    texts = [f"x again$$$ and, again.\nAgain and b{i} again" for i in range(500)]
    found = [np.frombuffer(x, "<u4").tolist() for x in model.encode(texts)]
    assert found == [e.ids for e in model.model.encode_batch(texts, add_special_tokens=False)]
    assert known.looked < 520 and "again" in known and not any("again$" in w for w in known)


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    from stakeweave.llm.packing import Encoder

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        text = f.read()
    model = Encoder(text)
    want = [Tokenizer.from_str(text).encode(t, add_special_tokens=False).ids for t in HARD[:9]]
    assert not model.parts and [np.frombuffer(x, "<u4").tolist() for x in model.encode(HARD[:9])] == want


def fill_largest_first(lengths, capacity):
    left, n = sorted(lengths), 0
    while left:
        gap, n = capacity, n + 1
        for i in range(len(left) - 1, -1, -1):
            if left[i] <= gap:
                gap -= left.pop(i)
    return n


def two_fit_by_rows(lengths, capacity):
    """Best-two-fit piece by piece, small pieces last, without counts."""
    from stakeweave.llm.packing import SMALL

    left, gaps = sorted(x for x in lengths if x > capacity // SMALL), []
    while left:
        gap, own = capacity, []
        for i in range(len(left) - 1, -1, -1):
            if left[i] <= gap:
                own.append(left.pop(i))
                gap -= own[-1]
        if gap and len(own) > 1:
            s = min(own)
            best = max(((left[i] + left[j], max(left[i], left[j])) for i in range(len(left)) for j in range(i) if left[i] + left[j] <= gap + s), default=(0, 0))
            if best[0] > s:
                left.append(s)
                left.remove(best[1])
                left.remove(best[0] - best[1])
                left.sort()
                gap += s - best[0]
        gaps.append(gap)
    for x in sorted((x for x in lengths if x <= capacity // SMALL), reverse=True):
        tight = min((g for g in gaps if g >= x), default=None)
        if tight is None:
            gaps.append(capacity - x)
        else:
            gaps[gaps.index(tight)] -= x
    return len(gaps)


def placed(counts, capacity):
    from stakeweave.llm.packing import best_two_fit

    plan = best_two_fit(counts, capacity)
    lengths = np.repeat(np.arange(len(counts)), counts)
    sequence, offset = plan.places(np.arange(len(lengths)))
    order = np.lexsort((offset, sequence))
    s, o, n = sequence[order], offset[order], lengths[order]
    new = np.append(True, np.diff(s) > 0)[: len(s)]
    assert (o[new] == 0).all() and (o[1:][~new[1:]] == (o + n)[:-1][~new[1:]]).all() and ((o + n) <= capacity).all()
    assert len(set(s.tolist())) == plan.sequences == (s.max() + 1 if len(s) else 0)
    return plan


def test_plans_are_whole_and_tight():
    draw = np.random.default_rng(2)
    won = 0
    for trial in range(150):
        capacity = int(draw.integers(1, 60))
        lengths = draw.integers(1, capacity + 1, int(draw.integers(0, 60)))
        if trial % 3 == 0:
            lengths = np.minimum((lengths * draw.random(len(lengths))).astype(int) + 1, capacity)
        plan = placed(np.bincount(lengths, minlength=capacity + 1), capacity)
        assert plan.sequences == two_fit_by_rows(lengths.tolist(), capacity)
        assert plan.sequences >= -(-int(lengths.sum()) // capacity)
        won += plan.sequences < fill_largest_first(lengths.tolist(), capacity)
        assert plan.sequences <= fill_largest_first(lengths.tolist(), capacity) + 1
    counts = np.append(0, draw.integers(0, 10**6, 1024))
    plan = placed(np.minimum(counts, 300), 1024)
    counts[700:] //= 10
    from stakeweave.llm.packing import best_two_fit

    big = best_two_fit(counts, 1024)  # half a thousand million pieces: the plan stays as small
    assert len(big.first) < 60000 and big.sequences <= 1.01 * (counts * np.arange(1025)).sum() / 1024 + 1


def test_packed_documents(spark, rows, definition):
    from tokenizers import Tokenizer

    from stakeweave.llm.packing import packed_pieces, sequences

    every = [(r[0], r[1]) for r in rows] + [(2000 + i, t) for i, t in enumerate(HARD)]
    docs = spark.createDataFrame(every, "doc_id long, text string").repartition(3)
    packed = packed_pieces(docs, definition, capacity=64).cache()
    model = Tokenizer.from_str(definition)
    want = []
    for i, t in every:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        short = len(ids) % 64
        for piece, start in enumerate([*([0] if short else []), *range(short, len(ids), 64)]):
            own = np.array(ids[start : start + (short if piece == 0 and short else 64)], "<u4").tobytes()
            want.append((i, piece, start, len(own) // 4, zlib.crc32(own)))
    assert rows_of(packed, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=key)
    by = collections.defaultdict(list)
    for r in packed.collect():
        by[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    for own in by.values():
        at = 0
        for offset, length, _ in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    made = {r.sequence_id: bytes(r.ids) for r in sequences(packed).collect()}
    assert made == {k: b"".join(x[2] for x in sorted(v)) for k, v in by.items()}
    again = packed_pieces(docs.repartition(7), definition, capacity=64)
    assert rows_of(again, "doc_id", "piece", "ids_crc32", "sequence_id", "offset") == rows_of(packed, "doc_id", "piece", "ids_crc32", "sequence_id", "offset")


def test_ids_that_are_not_kept_stay_in_workers(spark, rows, definition):
    from stakeweave.llm.packing import packed_pieces, token_pieces

    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole, bare = token_pieces(docs, definition, 64), token_pieces(docs, definition, 64, keep_ids=False)
    assert bare.columns == names and whole.columns == [*names, "ids"]
    assert rows_of(bare, *names) == rows_of(whole, *names)
    assert all(r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length for r in whole.collect())
    placed = ["doc_id", "piece", "sequence_id", "offset"]
    assert rows_of(packed_pieces(docs, definition, 64, keep_ids=False), *placed) == rows_of(packed_pieces(docs, definition, 64), *placed)


# Importance resampling


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [x.encode() for x in w] + [f"{a} {b}".encode() for a, b in zip(w, w[1:])]


def ranked(docs, target, percent=25, least=20, buckets=10000, seed=7):
    count = lambda texts: collections.Counter(zlib.crc32(f) % buckets for t in texts for f in features(t)[1])
    s, t = count(x for _, x in docs), count(target)
    every, wanted = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (every + buckets) / ((s[b] + 1) * (wanted + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        n, f = features(text)
        weight = sum(gain[zlib.crc32(x) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    number = {id(r): k + 1 for k, r in enumerate(order[: percent * len(order) // 100])}
    return sorted((((*r[:4], number.get(id(r)))) for r in out), key=key)


TARGET = ["the river and the stone lion7 copper", None, "", "winter maple signal harbor " * 9, "naïve 日本語"]


@pytest.mark.parametrize("small", [False, True])
def test_importance_ranks(spark, docs, rows, small, monkeypatch):
    from stakeweave.llm import resampling

    if small:
        monkeypatch.setattr(resampling, "HEAD_WORDS", 40)
        monkeypatch.setattr(resampling, "HEAD_PAIRS", 200)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = resampling.importance_ranks(docs, target, buckets=500)
    assert rows_of(got, "doc_id", "n_features", "weight", "score", "rank") == ranked([(r[0], r[1]) for r in rows], TARGET, buckets=500)
    drawn = resampling.resampled(docs, target, buckets=500)
    ids = {r.doc_id for r in got.where("rank IS NOT NULL").collect()}
    assert {r.doc_id for r in drawn.collect()} == ids and drawn.columns == docs.columns


def test_head_and_tail_give_the_same_buckets():
    from stakeweave.llm.resampling import Head, pieces

    draw = random.Random(8)
    words = [draw.choice([b"a", b"bb", b"the", b"x1", "é".encode(), b"rare%d" % draw.randrange(99)]) for _ in range(3000)]
    head = [b"a", b"bb", b"the", "é".encode()]
    near = np.flatnonzero(np.arange(2999) % 7)
    plain = [zlib.crc32(words[i] + b" " + words[i + 1]) % 100 for i in near]
    for h in (Head([], np.zeros(0, np.int64), 0, 100), Head(head, np.zeros(0, np.int64), 4, 100), Head(head, np.array([0, 1, 6, 15]), 4, 100), Head(head, np.array([3, 1]), 2, 100)):
        one, two = h.buckets_of(words, near)
        assert one.tolist() == [zlib.crc32(w) % 100 for w in words] and two.tolist() == plain
    assert list(pieces(np.zeros(0, np.uint8), np.zeros(1, np.int64))) == []


def test_head_is_counted_exactly(docs, rows, monkeypatch):
    from stakeweave.llm import resampling

    monkeypatch.setattr(resampling, "HEAD_WORDS", 60)
    monkeypatch.setattr(resampling, "HEAD_PAIRS", 300)
    monkeypatch.setattr(resampling, "HELD", 5)  # tasks send what they count in many parts
    head = resampling.vocabulary(docs, 100)
    lists = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", (r[1] or "").translate({c: c + 32 for c in range(65, 91)})) for r in rows]
    one = collections.Counter(w for x in lists for w in x)
    two = collections.Counter(p for x in lists for p in zip(x, x[1:]))
    total = sum(one.values())
    assert set(head.number) == {w.encode() for w, n in one.items() if n > 1 and 60 * n >= total and len(w.encode()) <= 64}
    names = list(head.number)
    found = {(names[p // head.paired].decode(), names[p % head.paired].decode()) for p in head.pairs.tolist()}
    assert found == {p for p, n in two.items() if 300 * n >= total and all(len(w.encode()) <= 64 for w in p)}


@pytest.mark.parametrize("piece", [1, 50, 1 << 18])
def test_long_texts_in_pieces(piece, monkeypatch):
    from stakeweave.llm import resampling

    monkeypatch.setattr(resampling, "PIECE", piece)
    texts = ["Alpha beta, gamma! " * 30, "", "x" * 400, ",,,", "one", "日本 語x " * 20 + "end"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))
    words, pairs = collections.defaultdict(list), collections.defaultdict(list)
    for own, rows, led in resampling.pieces(data, offsets):
        for k in range(len(own)):
            words[int(rows[k])] += own[k : k + 1] if k >= led else []
            if k and rows[k] == rows[k - 1]:
                pairs[int(rows[k])].append(own[k - 1] + b" " + own[k])
    for i, t in enumerate(texts):
        n, f = features(t)
        assert words[i] + pairs[i] == f, i


# Odd tables


@pytest.mark.parametrize("kind", ["empty", "clashing", "docs"])
def test_odd_tables(spark, request, kind, definition):
    from stakeweave.llm.fill_middle import fill_in_middle, fill_in_middle_digest
    from stakeweave.llm.packing import packed_pieces, sequences
    from stakeweave.llm.resampling import importance_ranks, resampled

    frame = request.getfixturevalue(kind)
    more = frame.select("*", *[F.lit(1).alias(c) for c in ("n", "form", "output", "piece", "start", "length", "place", "position", "weight", "score", "rank", "word", "pair", "offset", "ids", "sequence_id")
                               if c not in frame.columns])
    n = frame.count()
    target = spark.createDataFrame([], "text string")
    assert fill_in_middle(more).count() == fill_in_middle_digest(more).count() == n
    packed = packed_pieces(more, definition)
    assert packed.select("doc_id", "piece").where("piece = 0").count() == n and sequences(packed).count() == packed.select("sequence_id").distinct().count()
    ranks = importance_ranks(more, target)
    assert ranks.count() == n and resampled(more, target).columns == more.columns
    assert ranks.columns == ["doc_id", "key", "n_features", "weight", "score", "rank"]
