"""Words whose patterns defeat polynomial hashes stay apart in every operator that hashes words."""

import random

import numpy as np
import pytest

from stakeweave.llm.kernels import PLACES, span_hash

pytestmark = pytest.mark.filterwarnings("ignore")


def thue_morse(bits, flip=0):
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(1 << bits))


PAIRS = [(thue_morse(k), thue_morse(k, 1)) for k in (5, 6, 11)]


def hashes(words):
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(x) for x in raw])
    return span_hash(np.frombuffer(b"".join(raw), np.uint8), np.append(0, ends[:-1]), ends)


def test_span_hashes_tell_words_apart():
    draw = random.Random(2)
    words = list({"".join(draw.choice("ab") for _ in range(draw.randrange(1, 140))) for _ in range(20000)} | {w for p in PAIRS for w in p} | {"a" * k for k in range(1, 200)})
    got = hashes(words)
    assert len(set(got.tolist())) == len(words)
    assert (hashes(words[::-1])[::-1] == got).all()  # a word's hash is its own, wherever it stands
    assert hashes(["x" * PLACES, "x" * (PLACES + 1)])[0] == hashes(["x" * PLACES])[0]


@pytest.mark.parametrize("a,b", PAIRS)
def test_operators_keep_unlike_words_apart(spark, model, a, b):
    from stakeweave.llm.fingerprints import edit_likeness
    from stakeweave.llm.line_dedup import line_dedup
    from stakeweave.llm.near_copies import drop_near_copies
    from stakeweave.llm.ngram_lm import score_texts
    from stakeweave.llm.piece_viterbi import encode_pieces
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string").coalesce(1)
    pieces = {r.doc_id: r for r in encode_pieces(docs, model).collect()}
    assert all(r.round_trip for r in pieces.values())
    assert all(pieces[i].ids == encode_pieces(docs.where(f"doc_id = {i}"), model).first().ids for i in (1, 2))
    assert sum(r.n_removed for r in line_dedup(docs).collect()) == 0
    assert drop_near_copies(docs.select("*", F.lit(None).cast("string").alias("source"))).count() == 2
    scores = {r.doc_id: r for r in score_texts(docs, held_out=F.col("doc_id") == 2).collect()}
    assert scores[2].n_known == 1 and scores[2].n_tokens == 2 and scores[1].n_known == 2  # the end is known, the word isn't
    prints = {r.doc_id: r for r in edit_likeness(docs).collect()}
    assert prints[1].fingerprint != prints[2].fingerprint and prints[1].near_next == 0


def test_equal_hashes_of_unlike_words_do_no_harm_to_pieces(monkeypatch, model):
    """Even if all words shared a hash, encoding compares their bytes."""
    from stakeweave.llm import piece_viterbi
    from stakeweave.llm.kernels import text_buffer
    import pyarrow as pa

    table = piece_viterbi.PieceTable(piece_viterbi.read_pieces(model))
    texts = pa.array(["one two three", "four  five", "", "one"])
    want = [x.tolist() for x in table.encode(*text_buffer(texts))]
    monkeypatch.setattr(piece_viterbi, "span_hash", lambda data, start, end: np.zeros(len(start), np.uint64))
    assert [x.tolist() for x in table.encode(*text_buffer(texts))] == want
