import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tests.llm import brute

pytestmark = pytest.mark.filterwarnings("ignore")


def key(row):
    return tuple((x is None, str(x)) for x in row)


# Token counts


def test_token_counts_match_the_library(docs, rows, model):
    import sentencepiece

    from stakeweave.llm.token_counts import token_counts

    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, *_ in rows), key=key)
    got = token_counts(docs, model, limit=100, batch_bytes=500, split_chars=64).collect()
    assert sorted([tuple(r)[:3] for r in got], key=key) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)


def test_split_text_keeps_counts(model):
    import sentencepiece

    from stakeweave.llm.token_counts import count_texts

    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = ["a  b   c " * 40, " lead" * 30, "tail " * 30, "▁a ▁ b " * 20, "<s> </s> <unk> " * 10, "日本 語 " * 30, "\n \n x \t y" * 20]
    for limit in (1, 2, 3, 7, 50):
        assert count_texts(texts, model, 40, limit) == [len(x) for x in library.encode(texts)]


# Licences


def test_licences(spark, empty):
    from stakeweave.llm.licences import TEMPLATES, scan_licences

    mit = TEMPLATES["MIT"][1]
    texts = [mit, mit.upper() + "!", "prose\nReleased under the MIT License.\nmore prose here", "plain words only", None, "", mit.replace("free of charge", "for a fee"),
             " ".join(f"intro{k}" for k in range(60)) + "\n\n" + mit + "\n\n" + " ".join(f"rest{k}" for k in range(60)), "the MIT the MIT the MIT"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licences(docs).collect()}
    assert [got[i].licence for i in range(9)] == ["MIT", "MIT", "MIT", None, None, None, "MIT", "MIT", None]
    assert got[0].dice == 1.0 and 0.9 <= got[6].dice < 1 and got[7].matches[0].unit == "paragraph"
    m = got[2].matches[0]
    assert texts[2].encode()[m.first : m.end].decode().strip() == "Released under the MIT License."
    assert scan_licences(empty).count() == 0


def test_fingerprint_error_at_the_registered_samples():
    import numpy as np

    from stakeweave.llm.fingerprints import SAMPLES, likeness, signatures

    draw, off = np.random.default_rng(5), []
    for _ in range(200):
        w = [f"w{x}" for x in draw.integers(0, 10**6, 300)]
        other = w[:200] + [f"v{x}" for x in draw.integers(0, 10**6, 100)]
        a, b = ({tuple(x[i : i + 5]) for i in range(296)} for x in (w, other))
        raw = [" ".join(x).encode() for x in (w, other)]
        got = signatures(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])))
        off.append(likeness(got[:1], got[1:])[0] - len(a & b) / len(a | b))
    error = 0.5 / SAMPLES**0.5
    assert abs(np.mean(off)) < 0.3 * error and np.std(off) < 1.25 * error


def test_licences_in_runs_of_words():
    import numpy as np

    from stakeweave.llm.licences import TEMPLATES, Templates, find_licences

    held = Templates(TEMPLATES, 0.9)
    apache, mit = TEMPLATES["Apache-2.0"][1], TEMPLATES["MIT"][1]
    cut = apache.replace(" You may obtain", "\n#\n# You may obtain").replace(" Unless", "\n#\n# Unless")
    code = "\n\n".join(f"def f{i}(x{i}):\n    return x{i} + {i}" for i in range(40))
    three = mit.replace(" The above", "\n\nThe above").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    texts = [f"{cut}\n\n{code}", f"{three}\n\n{code}", f"Copyright 2024 Jane Doe.  {TEMPLATES['MIT'][0]}  All of it.", f"{code}\n{apache} {code}\n{mit}", code]
    raw = [t.encode() for t in texts]
    got = find_licences(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])), held)
    assert [{m[0] for m in x} for x in got] == [{"Apache-2.0"}, {"MIT"}, {"MIT"}, {"Apache-2.0", "MIT"}, set()]
    name, dice, unit, first, end = got[1][0]
    assert dice == 1 and raw[1][first:end].startswith(b"Permission is") and raw[1][first:end].endswith(b"THE SOFTWARE")


def test_licences_across_lines_match_brute_force(spark):
    import random

    from stakeweave.llm.licences import TEMPLATES, scan_licences

    bigrams = lambda t: (lambda w: set(zip(w, w[1:])) or {(x,) for x in w})(re.findall(r"[a-z0-9]+", t.lower()))
    draw, texts = random.Random(7), []
    names = sorted(TEMPLATES)
    for k in range(60):
        words = draw.choice(TEMPLATES[names[k % len(names)]]).split(" ")
        words = [w if draw.random() > 0.02 else "changed" for w in words]
        width = draw.randrange(1, 15)
        lines = [draw.choice(["", "# ", "// ", " * "]) + " ".join(words[i : i + width]) for i in range(0, len(words), width)]
        code = [f"x{draw.randrange(99)} = f{draw.randrange(99)}({draw.randrange(99)})" for _ in range(draw.randrange(0, 9))]
        texts.append("\n".join([*code, *lines, *code]) if k % 2 else "\n".join(lines))
    texts += ["Released\nunder\nthe\nMIT\nLicense.", "a = 1\n# Released under\n# the MIT License.\nb = 2"]
    got = {r.doc_id: r for r in scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        own = bigrams(t)
        best = max((2 * len(own & bigrams(x)) / (len(own) + len(bigrams(x))) for n in names for x in TEMPLATES[n]))
        if best >= 0.9:  # runs of words may be better still
            assert got[i].dice >= best - 1e-9, (i, best, got[i])
        tokens = re.findall(r"[a-z0-9]+", t.lower())
        pairs = list(zip(tokens, tokens[1:]))
        # Every run of words against every template.
        runs = 0.0
        for x in {x for n in names for x in TEMPLATES[n]}:
            other = bigrams(x)
            for a in [p for p in range(len(pairs)) if pairs[p] in other]:
                seen, common = set(), 0
                for p in pairs[a : a + 2 * len(other) + 20]:
                    if p not in seen:
                        seen.add(p)
                        common += p in other
                    runs = max(runs, 2 * common / (len(seen) + len(other)))
        assert (max(runs, best) >= 0.9 - 1e-9) == (got[i].licence is not None), (i, runs, best)
        if got[i].licence:  # a unit that matches speaks for the runs inside it
            assert got[i].dice <= max(runs, best) + 1e-9 and (got[i].matches[0].unit != "words" or abs(got[i].dice - runs) < 1e-9), (i, runs, got[i])
    assert got[60].licence == got[61].licence == "MIT"


def test_licence_bounds_prune_nothing_that_matches():
    from stakeweave.llm.licences import TEMPLATES, Templates

    held = Templates(TEMPLATES, 0.9)
    for own in held.sets:
        grams = sorted(own)
        for cut in range(1, max(2, len(grams) // 5)):
            part = frozenset(grams[cut:])
            best = max((2 * len(part & o) / (len(part) + len(o)) for o in held.sets))
            assert (held.best(part) or (0,))[0] == (best if best >= 0.9 else 0)


# Language


def test_language(spark, empty):
    from stakeweave.llm.language_id import identify_language

    base = {"en": "the thing with shing er and for that", "de": "der die das ung schön über keit", "fr": "été où les eaux ment que être", None: "zzz yyy xxx www vvv"}
    rows = [(i, " ".join((base[lang] + f" {i % 7}").split()[k % 6] for k in range(i, i + 60)), lang) for i, lang in enumerate(["en", "de", "fr", None] * 60)]
    rows += [(900, None, "en"), (901, "123 456", "en"), (902, "", "de"), (None, "the thing", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify_language(docs, per_label=60).collect()}
    assert got[900].lang_pred == got[901].lang_pred == got[902].lang_pred == "und"
    known = [(r, lang) for i, _, lang in rows[:240] if lang and (r := got[i])]
    assert sum(r.lang_pred == lang for r, lang in known if r.held_out) >= 0.95 * sum(r.held_out for r, _ in known)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[None].held_out is False
    assert identify_language(empty).count() == 0


def test_network_gradient():
    import numpy as np

    from stakeweave.llm.language_id import ByteConvNet

    net, draw = ByteConvNet(["a", "b"]), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = draw.integers(0, 256, (3, 40)), np.array([0, 1, 1])
    loss = lambda: -np.log(net._forward(x)[-1][np.arange(3), y]).mean()
    grad = net._gradient(x, y)
    for name in ("d", "w3", "b2", "c"):
        at = tuple(0 for _ in grad[name].shape)
        net.p[name][at] += 1e-5
        up = loss()
        net.p[name][at] -= 2e-5
        assert abs((up - loss()) / 2e-5 - grad[name][at]) < 1e-5
        net.p[name][at] += 1e-5


# Mixing


def test_apportion_is_highest_quotients():
    import random

    from stakeweave.llm.mixing import apportion

    draw = random.Random(1)
    for _ in range(60):
        w = [draw.choice([0, 1, 5, 7.5, 100, draw.random() * 50]) for _ in range(draw.randrange(1, 9))]
        seats = draw.randrange(0, 60)
        won = [0] * len(w)
        for _ in range(seats if sum(w) else 0):
            best = max(range(len(w)), key=lambda i: (w[i] / (2 * won[i] + 1), -i))
            won[best] += 1
        assert apportion(w, seats).tolist() == won


def test_mixing(docs, rows, empty):
    from stakeweave.llm.mixing import mix_sources

    got = mix_sources(docs, block=8).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(brute.words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    capped: set = set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order if s not in capped}
        over = {s for s, v in share.items() if v > 3 * size[s]}
        if not over:
            break
        capped |= over
    target = {s: 3.0 * size[s] if s in capped else share[s] for s in order}
    by_size = {size[s]: s for s in order}
    taken = collections.Counter()
    for r in got:
        s = by_size[r.source_size]
        assert abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 16
    again = mix_sources(docs.repartition(3), block=8).collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)
    assert mix_sources(empty).count() == 0


# Fingerprints


def test_fingerprints(docs, rows, empty, spark):
    from stakeweave.llm.fingerprints import edit_likeness

    plain = [(i, t) for i, t, *_ in rows if i is not None]
    once = sorted({i: t for i, t in reversed(plain)}.items())
    frame = spark.createDataFrame(once, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r for r in edit_likeness(frame, batch_rows=5).collect()}
    assert len(got) == len(once)
    prints = lambda s: [s[k : k + 8] for k in range(0, len(s), 8)]
    for k, (i, t) in enumerate(once):
        nxt, t = once[(k + 1) % len(once)], t or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + (nxt[1] or "")[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        same = lambda a, b: sum(x == y for x, y in zip(prints(a), prints(b))) / 64
        assert r.near_edited == same(r.fingerprint, r.edited_fingerprint) and r.near_next == same(r.fingerprint, got[nxt[0]].fingerprint)
    assert edit_likeness(docs).count() == len(rows) and edit_likeness(empty).count() == 0
    assert edit_likeness(spark.createDataFrame([(1, "alone here")], "doc_id long, text string")).first().near_next == 1.0


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_fingerprints_need_no_reused_exchange(spark, parts):
    from stakeweave.llm.fingerprints import edit_likeness

    rows = [(i % 97 if i % 5 else None, f"text number {i % 131} of many words " * (i % 4)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    before = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.exchange.reuse", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = edit_likeness(docs).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    import xxhash

    def order(r):
        h = xxhash.xxh64_intdigest(r[1].encode(), 42)
        return r[0] is not None, r[0] or 0, h - (h >> 63 << 64)

    rows.sort(key=order)
    edited = []
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        edited.append((i, hashlib.sha256((t[: len(t) - half] + rows[(k + 1) % 400][1][:half]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.edited_sha256) for r in got), key=key) == sorted(edited, key=key)


def test_collision_rate_is_generalised_jaccard():
    import numpy as np
    import pyarrow as pa

    from stakeweave.llm.fingerprints import signatures
    from stakeweave.llm.kernels import text_buffer

    draw = np.random.default_rng(3)
    error = []
    for _ in range(30):
        terms = draw.integers(0, 10**9, 40).astype(str)
        a = " ".join(draw.choice(terms, 120))
        b = " ".join([*a.split()[:70], *draw.choice(terms, 50)])
        x, y = collections.Counter(a.split()), collections.Counter(b.split())
        want = sum((x & y).values()) / sum((x | y).values())
        s = signatures(*text_buffer(pa.array([a, b])), size=1, samples=512)
        error.append((s[0] == s[1]).mean() - want)
    assert abs(np.mean(error)) < 0.01 and np.abs(error).max() < 0.09


# Lines


@pytest.mark.parametrize("named", [1, 4])
def test_line_dedup(docs, rows, empty, named):
    from stakeweave.llm.line_dedup import line_dedup

    want = brute.kept_lines([(i, t) for i, t, *_ in rows])
    got = line_dedup(docs, named=named).collect()
    found = lambda i, n, kept: (i is None, i or 0, n, n - len(kept), kept)
    assert sorted(found(r.doc_id, r.n_lines, list(r.kept)) for r in got) == sorted(found(i, n, k) for i, t, *_ in rows for k, n in [want[i, t or ""]])
    assert all(r.n_removed == r.n_lines - len(r.kept) for r in got)
    unique = [r for r in rows if r[0] is not None and r[0] != 7]  # every id once: texts need no numbers
    unique = list({r[0]: r for r in unique}.values())
    want = brute.kept_lines([(i, t) for i, t, *_ in unique])
    for r in line_dedup(docs.sparkSession.createDataFrame(unique, docs.schema).repartition(3), named=named).collect():
        assert (list(r.kept), r.n_lines) == next(want[i, t or ""] for i, t, *_ in unique if i == r.doc_id)
    assert line_dedup(empty).count() == 0


def test_dedup_lines_of_texts_with_one_id(spark):
    from stakeweave.llm.line_dedup import dedup_lines, line_dedup

    rows = [(7, "alpha beta gamma\nkappa lambda mu"), (7, "delta epsilon zeta"), (None, "one two three"), (None, "four five six"), (None, "four five six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, dedup_lines(docs).collect()), key=key) == sorted(rows, key=key)
    assert [r.n_removed for r in line_dedup(docs).collect()] == [0] * 5
    named = docs.select(F.concat(F.lit("d"), F.monotonically_increasing_id()).alias("doc_id"), "text")
    assert dedup_lines(named).where("text <> ''").count() == 4


def test_dedup_lines_rewrites_texts(spark):
    from stakeweave.llm.line_dedup import dedup_lines

    line = "this is a shared line with some more words in it"
    near = "this is a shared line with some more words in it too"
    rows = [(1, f"first one\n\n{line}\nlast"), (2, f"{near}\n  \nother words entirely"), (3, line), (4, None), (5, "")]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "  \nother words entirely" and got[3].text == "" and got[4].text is None and got[5].text == ""
    assert got[2].n_chars == len(got[2].text) and got[3].n_chars == 0


# Language model


def _scores_match(got, rows):
    order = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    want, got = sorted(brute.language_model(rows), key=order), sorted(map(tuple, got), key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert abs(a[5] - b[5]) < 1e-6 * abs(b[5]) and abs(a[6] - b[6]) < 2e-3 * abs(b[6])


# Small shares make hot words and wide pairs, whose contexts several shards hold; small pages repeat questions.
@pytest.mark.parametrize("options", [{}, {"share": 0.01, "shards": 13, "page_bytes": 3000}, {"share": 0.0005, "shards": 5, "page_bytes": 500}])
def test_language_model(docs, rows, empty, options):
    from stakeweave.llm.ngram_lm import score_texts

    _scores_match(score_texts(docs, **options).collect(), [(i, t) for i, t, *_ in rows])
    assert score_texts(empty, **options).count() == 0


def test_language_model_of_hot_contexts(spark):
    import random

    from stakeweave.llm.ngram_lm import make_plan, score_texts

    draw = random.Random(6)
    rows = [(i, " ".join(f"id : w{draw.randrange(300)} the of" for _ in range(draw.randrange(1, 20)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    plan = make_plan(docs, 0.02, 9)
    assert len(plan.hot_parts) >= 4 and len(plan.wide) >= 2 and plan.wide_parts.min() > 1
    _scores_match(score_texts(docs, share=0.02, shards=9, page_bytes=1000).collect(), rows)


def test_language_model_keeps_the_same_ngrams_in_a_large_corpus(spark):
    from stakeweave.llm.ngram_lm import score_texts

    rows = [(0, "rare words meet"), (1, "rare words meet once"), *[(i, "common " * 250_000) for i in range(2, 8)]]  # 10.5 MB
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    _scores_match(score_texts(docs).collect(), rows)


def test_language_model_without_training_texts_and_with_other_ids(spark):
    from stakeweave.llm.ngram_lm import score_texts

    docs = spark.createDataFrame([("x", "a b a b"), ("y", None)], "doc_id string, text string")
    got = {r.doc_id: r for r in score_texts(docs, held_out=F.lit(True)).collect()}
    assert [(got[k].n_tokens, got[k].n_known, got[k].train_tokens, got[k].base_score, got[k].score) for k in "xy"] == [(5, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]
    assert {r.doc_id for r in score_texts(docs).collect()} == {"x", "y"}


def test_elias_fano():
    import numpy as np

    from stakeweave.llm.elias_fano import EliasFano

    draw = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1), (1, 10**12), (700, 700), (5000, 10**7), (3000, 3001), (100, 10**15)):
        v = np.unique(draw.integers(0, top, n)) if n else np.zeros(0, np.int64)
        ef = EliasFano(EliasFano.build(v))
        assert (ef.access(np.arange(len(v))) == v).all()
        q = np.concatenate([v, v + 1, draw.integers(0, top + 5, 50), [-1, top * 2]])
        where = {int(x): i for i, x in enumerate(v)}
        assert ef.find(q).tolist() == [where.get(int(x), -1) for x in q]
    repeated = np.sort(draw.integers(0, 50, 400))
    assert (EliasFano(EliasFano.build(repeated)).access(np.arange(400)) == repeated).all()


# Quality


def test_quality_signals(docs, rows, empty):
    from stakeweave.llm.quality import quality_verdicts

    want = sorted(((i, *brute.quality(t)) for i, t, *_ in rows), key=key)
    got = quality_verdicts(docs).collect()
    assert sorted([tuple(r)[:7] for r in got], key=key) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_verdicts(empty).count() == 0


def test_quality_fences_adapt(spark):
    from stakeweave.llm.quality import quality_filter, quality_verdicts

    plain = [(i, " ".join(f"word{(i * 7 + k) % 501}" for k in range(60)), "en", "a", 0) for i in range(100)]
    odd = [(1000 + i, " ".join(f"word{(i * 11 + k) % 377}***" for k in range(60)), "en", "a", 0) for i in range(5)]
    usual = [(2000 + i, " ".join(f"x{(i * 11 + k) % 377}***" for k in range(60)), "en", "markup", 0) for i in range(100)]
    docs = spark.createDataFrame(plain + odd + usual, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in quality_verdicts(docs).where("kept").collect()}
    assert kept == {r[0] for r in plain + usual}
    assert {r.doc_id for r in quality_filter(docs).collect()} == kept


# Pieces


def test_pieces_match_a_unigram_encoder(docs, rows, empty, model):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    from stakeweave.llm.piece_viterbi import decode_pieces, encode_digest, encode_pieces, read_pieces

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:  # the library adds scores as 32-bit floats, which one of -1e9 would round
        piece.score = max(piece.score, -40_000.0)
    model = proto.SerializeToString()
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    score = [p[1] for p in read_pieces(model)]
    encoded = encode_pieces(docs, model).collect()
    assert all(r.round_trip for r in encoded) and len(encoded) == len(rows)
    total = lambda ids: sum(score[i] for i in ids)
    for word in {w for _, t, *_ in rows for w in brute.words(t, False) if len(w) < 40}:
        (mine,) = [x for x in [_table(model).encode_word(f"▁{word}".encode())]]
        assert total(mine) == total(library.encode(word))
    back = {(r.doc_id, r.text) for r in decode_pieces(encode_pieces(docs, model), model).collect()}
    assert back == {(i, t or "") for i, t, *_ in rows}
    assert encode_digest(docs, model).count() == len(rows) and encode_digest(empty, model).count() == 0


def _table(model):
    from stakeweave.llm.piece_viterbi import PieceTable, read_pieces

    if not hasattr(_table, "held"):
        _table.held = PieceTable(read_pieces(model))
    return _table.held


def test_viterbi_is_the_best_segmentation():
    import itertools
    import random

    from stakeweave.llm.piece_viterbi import BYTE, NORMAL, UNKNOWN, PieceTable

    draw = random.Random(5)
    for _ in range(30):
        texts = sorted({"".join(draw.choices("abé", k=draw.randrange(1, 4))) for _ in range(7)})
        pieces = [("<unk>", 0.0, UNKNOWN), *[(f"<0x{b:02X}>", 0.0, BYTE) for b in range(256)], *[(t, -draw.randrange(1, 9) * 1.0, NORMAL) for t in texts]]
        table = PieceTable(pieces)
        score = {p: s for p, s, k in pieces if k == NORMAL}
        words = ["".join(draw.choices("abéz", k=n)) for n in range(1, 9)]
        for word, ids in zip(words, table.encode_words([w.encode() for w in words])):
            assert ids == table.encode_word(word.encode())
            best = -1e9
            for cuts in itertools.product([0, 1], repeat=len(word) - 1):
                parts, last = [], 0
                for k, c in enumerate([*cuts, 1], 1):
                    if c:
                        parts.append(word[last:k])
                        last = k
                if all(p in score or len(p) == 1 for p in parts):
                    best = max(best, sum(score.get(p, table.unknown_score) for p in parts))
            got, held = 0.0, b""
            for i in ids:
                if pieces[i][2] == BYTE:
                    held += bytes([int(pieces[i][0][1:-1], 16)])
                    if held.decode("utf-8", "ignore"):
                        got, held = got + table.unknown_score, b""
                else:
                    got += score[pieces[i][0]]
            assert abs(got - best) < 1e-9


# SimHash


def test_simhash_groups(docs, rows, empty):
    from stakeweave.llm.simhash import simhash_groups

    prints = [brute.simhash(t) for _, t, *_ in rows]
    ids = [r[0] for r in rows]
    want = sorted(zip(ids, (f"{p:016x}" for p in prints), brute.components(prints, ids)), key=key)
    assert sorted(map(tuple, simhash_groups(docs).collect()), key=key) == want
    assert simhash_groups(empty).count() == 0


def test_shards_lose_no_link():
    import numpy as np

    from stakeweave.llm.simhash import VpTree, _roots, shard_links

    draw = np.random.default_rng(8)
    base = draw.integers(0, 2**63, 400).astype(np.uint64)
    flips = [base ^ np.uint64(1 << int(k)) for k in draw.integers(0, 63, 4)]
    points = np.unique(np.concatenate([base, *flips, flips[0] ^ np.uint64(4)]))
    near = np.bitwise_count(points[:, None] ^ points[None]) <= 2
    a, b = np.nonzero(np.triu(near, 1))
    leaves, places = VpTree(points, 2, 64).route(points)
    visits = collections.defaultdict(set)
    for leaf, p in zip(leaves.tolist(), places.tolist()):
        visits[p].add(leaf)
    assert len(set(leaves.tolist())) > 4 and all(visits[int(i)] & visits[int(j)] for i, j in zip(a, b))
    x, y = shard_links(points, 2, leaf=64, block=32)
    assert (_roots(len(points), a, b) == _roots(len(points), x, y)).all()


def test_components_of_long_chains(spark):
    from stakeweave.llm.simhash import components

    pairs = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 30)] + [(-5, -9), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(30)) and got[-5] == got[-9] == -9


def test_clashing_columns(clashing, rows, model):
    from stakeweave.llm.fingerprints import edit_likeness
    from stakeweave.llm.language_id import identify_language
    from stakeweave.llm.licences import scan_licences
    from stakeweave.llm.line_dedup import dedup_lines, line_dedup
    from stakeweave.llm.mixing import mix_sources, mixed_documents
    from stakeweave.llm.ngram_lm import score_texts
    from stakeweave.llm.piece_viterbi import encode_pieces
    from stakeweave.llm.quality import quality_filter, quality_verdicts
    from stakeweave.llm.near_copies import drop_near_copies
    from stakeweave.llm.simhash import simhash_groups
    from stakeweave.llm.token_counts import token_counts

    n = len(rows)
    for f in (edit_likeness, identify_language, scan_licences, line_dedup, mix_sources, score_texts, quality_verdicts, simhash_groups):
        assert f(clashing).count() == n, f
    for f in (token_counts, encode_pieces):
        assert f(clashing, model).count() == n, f
    for f in (dedup_lines, quality_filter, drop_near_copies, mixed_documents):
        assert f(clashing).columns == clashing.columns and f(clashing).count() > 0, f


def test_pipeline_drops_rewrapped_near_copies(spark, tmp_path):
    import random

    import corpus_pipeline

    draw = random.Random(9)
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    texts, near = [], 0
    for _ in range(60):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randrange(100, 400))]
        edited = [f"x{draw.randrange(5000)}" if draw.random() < 0.015 else w for w in words]
        edited = "\n".join(" ".join(edited[i : i + 12]) for i in range(0, len(edited), 12))
        a, b = sets(words), sets(edited.split())
        near += len(a & b) >= 0.8 * len(a | b)
        texts += [" ".join(words), edited]
    assert near > 30
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert kept.count() == len(texts) - near and kept.where("doc_id % 2 = 0").count() == len(texts) // 2


@pytest.mark.parametrize("most", [2, 7, 1000])
def test_large_buckets_lose_no_link(spark, most):
    import random

    from stakeweave.llm.near_copies import near_classes, with_keys

    draw, texts = random.Random(1), []
    for k in range(4):  # chains: each text is near the one before it, the last is far from the first
        words = [f"w{k}x{i}" for i in range(200)]
        for step in range(12):
            words = words[:]
            words[step * 16 + draw.randrange(3)] = f"edit{k}x{step}"
            texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = near_classes(with_keys(docs).select("key", "text"), most).select("key.i", "root").collect()
    name = {}
    assert len(got) == len(texts) and all(name.setdefault(r.root, root[r.i]) == root[r.i] for r in got) and len(name) == len(set(root))


def test_filters_without_broadcasts_give_the_same(docs, monkeypatch):
    from stakeweave.llm import near_copies, quality

    for module, f in ((near_copies, near_copies.drop_near_copies), (quality, quality.quality_filter)):
        few = sorted(map(str, f(docs).collect()))
        monkeypatch.setattr(module, "FEW", -1)
        assert sorted(map(str, f(docs).collect())) == few and 0 < len(few) < docs.count()


def test_near_links_match_all_pairs():
    import numpy as np

    from stakeweave.llm.near_copies import near_links
    from stakeweave.llm.simhash import _roots

    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 62, (4, 40)).astype(np.uint64)
    held = [np.unique(np.where(draw.random(40) < 0.06, draw.integers(0, 1 << 62, 40).astype(np.uint64), base[i % 4])) for i in range(60)] + [np.zeros(0, np.uint64)]
    want = [(i, j) for i in range(61) for j in range(i) if len(x := np.intersect1d(held[i], held[j])) and len(x) >= 0.8 * len(np.union1d(held[i], held[j]))]
    got = near_links(np.concatenate(held), np.append(0, np.cumsum([len(x) for x in held])))
    assert len(got) < 61 and (_roots(61, *np.array(got).T) == _roots(61, *np.array(want).T)).all()


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    again = corpus_pipeline.run(spark, str(tmp_path))
    rows = sorted(map(str, got.collect()))
    assert rows and rows == sorted(map(str, again.collect())) and got.where("not round_trip").count() == 0
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name


def test_registered_queries():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3, [(1, "same words here in this line of text again and more", "en", "s", 3)] * 4])
def test_pipeline_on_odd_tables(spark, tmp_path, rows):
    import corpus_pipeline
    from tests.llm.conftest import SCHEMA

    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= max(3, len(rows))
    frame = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, str(tmp_path)).count() <= 3 * len(rows), name


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3, [(1, "same words here in this line of text again and more", "en", "s", 3)] * 4])
def test_queries_on_odd_tables(spark, tmp_path, rows):
    import __spark_entry__ as entry
    from tests.llm.conftest import SCHEMA

    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "lion river stone"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, query in entry.queries().items():
        if re.match(r"op\d+_", name):
            found = query(spark, str(tmp_path))
            # Packing gives a row for each piece of a document.
            found = found.where("piece = 0") if name.startswith("op12_") else found
            assert found.count() == len(rows), name
