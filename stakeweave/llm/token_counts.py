"""Token counts of whole texts, from batches of a SentencePiece model's own encoder.

Texts are encoded inside Arrow batches and only lengths leave Python.  Batches for the
encoder hold about ``batch_bytes`` each, so one batch of long texts costs as much as one
of short texts.  A text of more than ``split_chars`` characters is cut before a space that follows a
character other than a space: no piece of a supported model holds a space mark behind
another character (this is checked when the model is read; if a piece does, texts stay
whole), so no merge crosses such a cut and the counts of the parts add up.

Defined results: a null text counts as the empty text (0 bytes, 0 tokens); repeated rows
each give a row; an empty table gives an empty result; a null id stays null; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeweave.llm.kernels import released

MARK = "▁"
_models: dict[bytes, tuple] = {}


def _model(proto: bytes):
    """The encoder and whether long texts may be split, one of each per worker."""
    if proto not in _models:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        crosses = any(re.search(f"[^{MARK}]{MARK}", piece) for piece in pieces)
        # A model that trims, rewrites or doesn't prefix its input gives other counts for parts.
        probe = model.encode("a  b", out_type=str)
        splits = not crosses and "".join(probe) == f"{MARK}a{MARK}{MARK}b"
        _models[proto] = (model, splits)
    return _models[proto]


def split_text(text: str, limit: int) -> list[str]:
    """Parts of ``text``, each of ``limit`` characters or little more, whose token counts add up.

    A cut swallows one space, which the encoder puts back in front of every input.
    """
    parts, first = [], 0
    while len(text) - first > limit:
        at = first + limit
        while True:
            at = text.find(" ", at)
            if at < 0 or at + 1 >= len(text):
                at = -1
                break
            if text[at - 1] not in (" ", MARK):
                break
            at += 1
        if at < 0:
            break
        parts.append(text[first:at])
        first = at + 1
    parts.append(text[first:])
    return parts


def count_texts(texts: list[str], proto: bytes, batch_bytes: int, split_chars: int) -> list[int]:
    model, splits = _model(proto)
    counts = [0] * len(texts)
    parts: list[str] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        for owner, ids in zip(owners, model.encode(parts, num_threads=1), strict=True):
            counts[owner] += len(ids)
        parts.clear()
        owners.clear()

    for i, text in enumerate(texts):
        for part in split_text(text, split_chars) if splits and len(text) > split_chars else [text]:
            parts.append(part)
            owners.append(i)
            held += len(part) if part.isascii() else len(part.encode())
            if held >= batch_bytes:
                flush()
                held = 0
    if parts:
        flush()
    return counts


def token_counts(
    docs: DataFrame,
    model_proto: bytes,
    limit: int = 4096,
    batch_bytes: int = 1 << 18,
    split_chars: int = 1 << 15,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model_proto)  # the model file, half a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            counts = count_texts(texts, shared.value, batch_bytes, split_chars)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"]
            )

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(released(run), f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
