"""Search: a token index, candidates in stages, and a six-key rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT, NOTABLE, TEXT, SUBSTRING, PERSON = range(5)
LIMITS = {EXACT: 10, NOTABLE: 15, TEXT: 30, SUBSTRING: 20, PERSON: 15}


def tokens(text: Column) -> Column:
    """Distinct words in lower case: runs of letters, marks and digits of any script."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([\\p{L}\\p{M}\\p{N}_]+)")))


def grams(text: Column, size: int = 3) -> Column:
    """Distinct runs of ``size`` characters; a shorter text is its own run."""
    low = F.lower(F.coalesce(text, F.lit("")))
    last = F.greatest(F.char_length(low) - size + 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(low, i, F.lit(size))))


def holding(names: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, id``: names that hold a query's text, found by its rarest run of three characters.

    Queries of one or two characters use runs as long as they are.
    """
    low = F.lower("q")
    asked = queries.where(F.char_length("q") > 0).select("query_id", low.alias("low"), F.least(F.char_length("q"), F.lit(3)).alias("size"))
    found = None
    for size in (1, 2, 3):
        q = asked.where(F.col("size") == size).select("query_id", "low", F.explode(grams(F.col("low"), size)).alias("gram"))
        hits = names.select("id", F.lower("name").alias("held"), F.explode(grams(F.col("name"), size)).alias("gram")).join(q.select("gram").distinct(), "gram")
        count = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        rarest = q.join(count, "gram", "left").groupBy("query_id", "low").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
        part = rarest.join(hits, "gram").where(F.contains("held", "low")).select("query_id", "id")
        found = part if found is None else found.unionByName(part)
    return found


def token_index(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``token, key``, once per row and token: write it partitioned by token to serve searches."""
    return rows.select(key, F.explode(tokens(F.col(text))).alias("token"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("n_docs"))


def match_any(index: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """``query_id, key, hits``: rows with any of a query's words; the index is joined, never scanned by text."""
    words = queries.select("query_id", F.explode(tokens(F.col("q"))).alias("token"))
    return words.join(index, "token").groupBy("query_id", key).agg(F.count(F.lit(1)).alias("hits"))


def _top(rows: DataFrame, order: list[Column], stage: int) -> DataFrame:
    place = Window.partitionBy("query_id").orderBy(*order)
    numbered = rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= LIMITS[stage])
    return numbered.select("query_id", "id", F.lit(stage).alias("stage"), "place")


def entity_candidates(entities: DataFrame, index: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, id, stage, place``: exact names, notable text matches, text matches; substrings only if none of these.

    ``queries`` has ``query_id, q, nn, country``; a query's country, if any, holds for every stage.
    """
    e = entities.select("id", "name", "name_normalized", "wikidata_id", F.col("country").alias("e_country"))
    here = F.col("country").isNull() | (F.col("country") == F.col("e_country"))
    exact = _top(queries.where("nn <> ''").join(e, F.col("nn") == F.col("name_normalized")).where(here), [F.col("id")], EXACT)
    found = match_any(index, queries, "id").join(e, "id").join(queries.select("query_id", "country"), "query_id").where(here)
    best = [F.col("hits").desc(), F.col("id")]
    staged = exact.unionByName(_top(found.where("wikidata_id IS NOT NULL"), best, NOTABLE)).unionByName(_top(found, best, TEXT))
    bare = queries.join(staged.select("query_id"), "query_id", "left_anti").where("q <> ''")
    substring = holding(e, bare).join(e, "id").join(bare.select("query_id", "country"), "query_id").where(here)
    return staged.unionByName(_top(substring, [F.col("id")], SUBSTRING))


def person_candidates(persons: DataFrame, index: DataFrame, queries: DataFrame) -> DataFrame:
    """Persons by name, only for queries without a country."""
    found = match_any(index, queries.where("country IS NULL"), "id").join(persons.select("id"), "id", "left_semi")
    return _top(found, [F.col("hits").desc(), F.col("id")], PERSON)


def rank(candidates: DataFrame, nodes: DataFrame, queries: DataFrame, hidden: DataFrame | None = None, most: int = 20) -> DataFrame:
    """Ranked results: hidden nodes go, each node counts once at its best rank, then the limit."""
    if hidden is not None:
        candidates = candidates.join(hidden.select("id"), "id", "left_anti")
    rows = candidates.join(nodes, "id").join(queries, "query_id")
    name, q = F.lower(F.coalesce("name", F.lit(""))), F.lower("q")
    words = F.filter(F.split(q, "\\s+"), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: F.contains(name, w)))
    tier = F.when(name == q, 0).when(name.startswith(q), 1).when(F.contains(name, q), 2).otherwise(3)
    rows = rows.select(
        "query_id", "id", "name", "stage", "place", F.when((F.col("nn") != "") & (F.col("name_normalized") == F.col("nn")), 0).otherwise(1).alias("not_exact"),
        hits.alias("hits"), tier.alias("tier"), F.when(F.coalesce("wikidata_id", F.lit("")) != "", 0).otherwise(1).alias("not_notable"),
        F.when(tier <= 2, F.length(name)).otherwise(0).alias("name_length"),
    )
    keys = [F.col("not_exact"), F.col("hits").desc(), F.col("tier"), F.col("not_notable"), F.col("name_length"), F.col("stage"), F.col("place"), F.col("id")]
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy(*keys))).where("_n = 1")
    ranked = once.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*keys))).where(F.col("position") <= max(1, min(most, 50)))
    return ranked.select("query_id", "position", "id", "name", "hits", "tier")


def best_entity(candidates: DataFrame, nodes: DataFrame, queries: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    return rank(candidates, nodes, queries, hidden, 1).select("query_id", "id", "name")
