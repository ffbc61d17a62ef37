"""Quality rules with thresholds that adapt to each language and source.

Everything runs as DataFrame expressions.  Signals of a text are computed by functions
on its own array of words, so no text is shuffled; the signals (a few numbers
a row) are summarised by KLL quantile sketches per language and source,
merged upwards to language and to the whole table, and joined back.

A row is rejected by the fixed base rule, or when a signal lies outside the fence
``[q25 - reach * spread, q75 + reach * spread]`` of its group, ``spread`` being the
group's quartile range or a floor.  The fence of the mean word length widens by
``word_slack / sqrt(n_words)``, the sampling error of a short text's mean.  A group of fewer
than ``min_group`` rows uses its language's sketch, and a language of fewer the table's.

Defined results: a null text has no words and fails the base rule; null language and
null source are groups of their own; repeated rows each give a row; a value on a fence is inside it; a text
may be of any length, as its words are held as one array; rows of an empty
table give none; other columns are ignored (``quality_filter`` carries them through).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeweave.llm.common import SPACE_CHARS, SPACES, cut, text_or_empty

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Signal: the least spread of its fence.
SIGNALS = {"symbol_rate": 0.10, "word_length": 0.30, "dup_line_rate": 0.20}


def _without(text: Column, chars: str | tuple[str, ...]) -> Column:
    for char in chars:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _windows(words: Column) -> Column:
    last = F.size(words) - WINDOW
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])),
    )


def _covered(windows: Column) -> Column:
    """Words that lie in a window found twice or more, from the windows' hashes."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.filter(s, lambda x, k: F.when(k > 0, same(x, k - 1)).otherwise(F.lit(False)) | same(x, k + 1))

    def spans(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    places = _let(ordered, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
    return _let(places, spans)


def base_signals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed``.

    The input must not have columns of these names.
    """
    text = text_or_empty(text_col)
    line_breaks = F.filter(
        F.split(text, "\n"), lambda x: F.btrim(x, F.lit("".join(SPACE_CHARS))) != ""
    )
    cols = docs.withColumns(
        {
            "_words": F.filter(F.split(text, f"{SPACES}+"), lambda w: w != ""),
            "_lines": line_breaks,
            "word_chars": F.char_length(_without(text, SPACE_CHARS)).cast("long"),
            "n_symbols": (F.octet_length(text) - F.octet_length(_without(text, SYMBOLS))).cast("long"),
        }
    )
    cols = cols.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": _let(
                _windows(F.col("_words")),
                lambda h: F.when(h.isNull() | (F.size(F.array_distinct(h)) == F.size(h)), F.lit(0).cast("long")).otherwise(
                    _covered(h)
                ),
            ),
        }
    ).drop("_words", "_lines")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return cols.withColumn("base_failed", failed)


def quality_verdicts(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    id_cols: tuple[str, ...] = ("doc_id",),
    reach: float = 3.0,
    word_slack: float = 8.0,
    min_group: int = 50,
    sketch_k: int = 1024,
) -> DataFrame:
    """``id_cols``, the base signals, ``base_failed`` and ``kept`` of every row."""
    ids = F.struct(*[F.col(c) for c in id_cols]).alias("row")
    rows = cut(_measured(docs, text_col, lang_col, source_col, ids))
    found = _judged(rows, _fences(rows, reach, min_group, sketch_k), word_slack)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return found.select(*[F.col("row").getField(c).alias(c) for c in id_cols], *names)


def _measured(docs: DataFrame, text_col: str, lang_col: str, source_col: str, row: Column) -> DataFrame:
    """``row, _lang, _source``, the base signals and the rates of every row."""
    picked = docs.select(row, F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"))
    words = F.greatest(F.col("n_words"), F.lit(1))
    return base_signals(picked, "_text").drop("_text").withColumns(
        {
            "symbol_rate": F.col("n_symbols") / words,
            "word_length": F.col("word_chars") / words,
            "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        }
    )


def _judged(rows: DataFrame, fences: DataFrame, word_slack: float) -> DataFrame:
    """``rows`` with ``kept``."""
    same = rows["_lang"].eqNullSafe(fences["_f_lang"]) & rows["_source"].eqNullSafe(fences["_f_source"])
    joined = rows.join(fences, same, "left")
    inside = F.lit(True)
    for name in SIGNALS:
        slack = F.lit(word_slack) / F.sqrt(F.greatest(F.col("n_words"), F.lit(1))) if name == "word_length" else F.lit(0.0)
        inside &= F.coalesce(F.col(name).between(F.col(f"{name}_low") - slack, F.col(f"{name}_high") + slack), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside)


def _fences(rows: DataFrame, reach: float, min_group: int, k: int) -> DataFrame:
    """Fences of every language and source that occur; rows that fail the base rule don't count."""
    keys = ["_lang", "_source"]
    own = rows.groupBy(*keys).agg(
        F.sum((~F.col("base_failed")).cast("long")).alias("n"),
        *[F.kll_sketch_agg_double(F.when(~F.col("base_failed"), F.col(s)), k).alias(s) for s in SIGNALS],
    )
    own = cut(own)  # one row for each language and source
    lang = own.groupBy("_lang").agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(s, k).alias(s) for s in SIGNALS])
    every = lang.groupBy(F.lit(1).alias("_one")).agg(F.sum("n").alias("n2"), *[F.kll_merge_agg_double(s, k).alias(f"{s}2") for s in SIGNALS])
    lang = lang.select(F.col("_lang").alias("_l1"), F.col("n").alias("n1"), *[F.col(s).alias(f"{s}1") for s in SIGNALS])
    levels = own.join(lang, own["_lang"].eqNullSafe(lang["_l1"]), "left").withColumn("_one", F.lit(1)).join(every, "_one")
    out = [F.col("_lang").alias("_f_lang"), F.col("_source").alias("_f_source")]
    for s, floor in SIGNALS.items():
        sketch = F.when(F.col("n") >= min_group, F.col(s)).when(F.col("n1") >= min_group, F.col(f"{s}1")).otherwise(F.col(f"{s}2"))
        low, high = (
            F.when(F.coalesce(F.col("n2"), F.lit(0)) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(q))) for q in (0.25, 0.75)
        )
        spread = F.greatest(high - low, F.lit(floor)) * reach
        out += [F.round(low - spread, 3).alias(f"{s}_low"), F.round(high + spread, 3).alias(f"{s}_high")]
    return levels.select(*out)


#: Rejected rows whose keys are broadcast (16 bytes each); more of them are joined by a shuffle.
FEW = 1 << 20


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever their names.

    Signals are computed once and the rows that are rejected taken out by a key over id, text, language and source,
    so rows that are equal in these share a verdict.
    """
    own = [F.col(c) for c in ("doc_id", text_col, lang_col, source_col)]
    keyed = docs.select(
        F.xxhash64(*own).alias("k1"), F.xxhash64(F.lit(1), *own).alias("k2"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
        F.col(source_col).alias("source"), F.struct("*").alias("row"),
    )
    bad = cut(quality_verdicts(keyed, id_cols=("k1", "k2"), **options).where("NOT kept").select("k1", "k2").distinct())
    if bad.count() <= FEW:
        bad = F.broadcast(bad)
    return keyed.join(bad, ["k1", "k2"], "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
