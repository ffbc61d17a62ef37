"""Corpus pipeline: documents through quality rules, two dedups, mixing and encoding.

Every stage takes all that the one before kept.  ``run`` writes each stage's result as
Parquet below ``spark.checkpoint.dir`` and reads it again, so a lost executor costs one stage's
tasks at most and no stage is computed twice.

Defined results: a document without words fails the quality rules; null language and null source are groups
of their own; null ids sort last in line dedup and first among near copies; rows of one id stand apart by their
texts; of equal rows one stays; texts may be of any length; an empty table gives an empty result; further columns are
carried through to the last stage, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stakeweave import ship
from stakeweave.llm.common import checkpoint_folder
from stakeweave.llm.line_dedup import dedup_lines
from stakeweave.llm.mixing import mixed_documents
from stakeweave.llm.near_copies import drop_near_copies
from stakeweave.llm.piece_viterbi import encode_pieces
from stakeweave.llm.quality import quality_filter


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the base rule or an adaptive fence rejects go."""
    ship(spark)
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: lines that match an earlier line go; their documents stay."""
    ship(spark)
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10 over five-word shingles, with an exact check at Jaccard 0.8: one document of each group stays."""
    ship(spark)
    return drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents as often as the mix takes them."""
    ship(spark)
    return mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: piece ids of every document, and whether they decode to its text."""
    import public_tokenizers

    ship(spark)
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return encode_pieces(docs, f.read())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("sentencepiece", sentencepiece),
]

#: Stages 1, 3, 4 and 5 rest on sketches, hashes and a model's pieces, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
