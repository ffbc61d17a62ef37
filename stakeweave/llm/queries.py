"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stakeweave.llm.common import documents


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from stakeweave.llm.token_counts import token_counts

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return token_counts(documents(spark, sf_dir), f.read())


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stakeweave.llm.licences import scan_licences

    return scan_licences(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stakeweave.llm.language_id import identify_language

    return identify_language(documents(spark, sf_dir))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stakeweave.llm.mixing import mix_sources

    return mix_sources(documents(spark, sf_dir))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stakeweave.llm.fingerprints import edit_likeness

    return edit_likeness(documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stakeweave.llm.line_dedup import line_dedup

    return line_dedup(documents(spark, sf_dir))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stakeweave.llm.ngram_lm import score_texts

    return score_texts(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stakeweave.llm.quality import quality_verdicts

    return quality_verdicts(documents(spark, sf_dir))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from stakeweave.llm.piece_viterbi import encode_digest

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return encode_digest(documents(spark, sf_dir), f.read())


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stakeweave.llm.simhash import simhash_groups

    return simhash_groups(documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stakeweave.llm.fill_middle import fill_in_middle_digest

    return fill_in_middle_digest(documents(spark, sf_dir))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from stakeweave.llm.packing import packed_pieces

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return packed_pieces(documents(spark, sf_dir), f.read(), keep_ids=False)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stakeweave.llm.resampling import importance_ranks

    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return importance_ranks(documents(spark, sf_dir), target).drop("key")


def quality_base_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the base rule of operator 8 measures."""
    from stakeweave.llm.quality import quality_verdicts

    return quality_verdicts(documents(spark, sf_dir)).drop("kept")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operator 4 aims at, for every document."""
    from pyspark.sql import functions as F

    from stakeweave.llm.mixing import mix_sources

    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_licence_scan": op2_licence_scan,
    "op3_language_id": op3_language_id,
    "op4_mix_sources": op4_mix_sources,
    "op5_fingerprints": op5_fingerprints,
    "op6_line_dedup": op6_line_dedup,
    "op7_lm_scores": op7_lm_scores,
    "op8_quality_rules": op8_quality_rules,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_simhash_groups": op10_simhash_groups,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_importance_resampling": op13_importance_resampling,
    "quality_base_signals": quality_base_signals,
    "mixing_targets": mixing_targets,
}

#: The operators' whole results rest on models, hashes and sketches, which SQL cannot express; these parts of two it can.
ORACLE_SQL: dict[str, str] = {
    "op11_fill_in_middle": r"""WITH d AS (SELECT doc_id, COALESCE(text, '') AS text, sha256('7:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines, list_transform(range(0, 4), lambda k: CAST('0x' || substr(h, CAST(8 * k + 1 AS BIGINT), 8) AS BIGINT)) AS h FROM d),
c AS (SELECT *, len(lines) AS n, LEAST(h[1] % (len(lines) + 1), h[2] % (len(lines) + 1)) AS a, GREATEST(h[1] % (len(lines) + 1), h[2] % (len(lines) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p""",
    "quality_base_signals": r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
runs AS (SELECT r, i, words[i : i + 4] AS run FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, COUNT(*) OVER (PARTITION BY r, run) AS n FROM runs) WHERE n > 1),
covered AS (SELECT r, COUNT(*) AS n FROM (SELECT DISTINCT r, i + k AS at FROM twice, (SELECT unnest(range(0, 5)) AS k)) GROUP BY r),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  COALESCE(c.n, 0) AS n_repeat_words FROM w LEFT JOIN covered c USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m""",
    "mixing_targets": r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(SUM(size) AS DOUBLE) AS size, 1 + (ROW_NUMBER() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS w FROM d GROUP BY source),
-- Sources in the order in which the level rises to their caps: those below the level that is left when they are reached stop there.
o AS (SELECT *, SUM(size) OVER () - COALESCE(SUM(3 * size) OVER (ORDER BY 3 * size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  SUM(w) OVER (ORDER BY 3 * size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM s),
l AS (SELECT *, 3 * size / w < rest / weights AS capped FROM o),
t AS (SELECT source, size, CASE WHEN capped THEN 3 * size ELSE w * (SELECT MAX(rest / weights) FROM l WHERE NOT capped) END AS target FROM l)
SELECT d.doc_id, d.size, CAST(t.size AS BIGINT) AS source_size, ROUND(t.target, 3) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source""",
}
