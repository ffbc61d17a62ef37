"""Copy-on-write upserts with a rule for each column, and versioned tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What becomes of a column where both a stored and a new row exist.  Empty texts and empty arrays count as missing in
#: ``existing_first`` and ``nonempty_new``; ``credible`` takes the new value unless the stored ``name_credibility`` is higher.
RULES = ("existing_first", "new_first", "overwrite", "nonempty_new", "max", "either", "credible")

# Which side each column of the three sources' upserts believes.
ENTITY_OF_WIKIDATA = {
    "wikidata_id": "overwrite", "search_text": "overwrite", "name_normalized": "overwrite",
    "lei_id": "existing_first", "sec_cik": "existing_first", "source_id": "existing_first",
    "hq_lat": "existing_first", "hq_lng": "existing_first", "hq_city": "existing_first", "hq_country": "existing_first",
    "type": "new_first", "country": "new_first", "founded": "new_first", "revenue": "new_first", "employees": "new_first",
    "employees_as_of": "new_first", "description": "new_first",
    "aliases": "nonempty_new", "countries": "nonempty_new", "hq_locations": "nonempty_new",
    "name": "credible", "name_credibility": "credible",
}
PERSON_OF_WIKIDATA = {c: "existing_first" for c in ("birth_date", "death_date", "birth_place", "description", "nationality", "alias", "nationalities", "source_id")}
ENTITY_BY_NAME = {"sec_cik": "new_first", "lei_id": "new_first", "source_id": "existing_first"}


def _said(value: Column, kind: str) -> Column:
    if kind == "string":
        return F.nullif(value, F.lit(""))
    return F.when(F.size(value) > 0, value) if kind.startswith("array") else value


def last_of_key(rows: DataFrame, keys: list[str], sequence: str | None = None) -> DataFrame:
    """One row a key: the last by the column ``sequence``, which goes; of equal ones, or without it, the greatest."""
    values = [c for c in rows.columns if c not in keys and c != sequence]
    order = [] if sequence is None else [sequence]
    if not order + values:
        return rows.distinct()
    last = rows.groupBy(*keys).agg(F.max(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order + values)])).alias("_v"))
    return last.select(*keys, *[F.col(f"_v._{len(order) + i}").alias(c) for i, c in enumerate(values)])


def upsert(
    current: DataFrame, delta: DataFrame, keys: list[str], rules: Mapping[str, str] | None = None, default: str = "new_first", sequence: str | None = None
) -> DataFrame:
    """``current`` with ``delta`` folded in by ``keys``; of several rows of ``delta`` with one key the last by ``sequence`` counts, or the greatest.

    Columns that ``delta`` lacks keep their stored values.
    """
    rules = dict(rules or {})
    delta = last_of_key(delta, keys, sequence)
    new = delta.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in delta.columns if c not in keys], F.lit(True).alias("_new"))
    both = current.withColumn("_old", F.lit(True)).join(new, keys, "full")
    kinds = dict(current.dtypes)
    if "credible" in rules.values():
        stronger = F.col("_new") & (F.coalesce("name_credibility", F.lit(0)) <= F.col("_n_name_credibility"))
    out = []
    for c in current.columns:
        if c in keys or c not in delta.columns:
            out.append(F.col(c))
            continue
        old, fresh, rule = F.col(c), F.col(f"_n_{c}"), rules.get(c, default)
        value = {
            "existing_first": F.coalesce(_said(old, kinds[c]), fresh, old), "new_first": F.coalesce(fresh, old),
            "overwrite": F.when(F.col("_new"), fresh).otherwise(old), "nonempty_new": F.coalesce(_said(fresh, kinds[c]), old), "max": F.greatest(old, fresh) if rule == "max" else old,
            "credible": F.when(stronger, fresh).otherwise(old) if rule == "credible" else old,
            "either": (F.coalesce(old, F.lit(False)) | F.coalesce(fresh, F.lit(False))) if rule == "either" else old,
        }[rule]
        out.append(value.alias(c))
    return both.select(*out)


def update_only(current: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Matched rows take the delta's values; rows are never added."""
    known = delta.join(current.select(*keys), keys, "left_semi")
    return upsert(current, known, keys, default="overwrite")


def create(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not taken yet are added; columns they lack are null."""
    return current.unionByName(new.join(current.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def delete(current: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(gone.select(*keys).distinct(), keys, "left_anti")


def close(edges: DataFrame, ended: DataFrame, keys: list[str]) -> DataFrame:
    """Active edges of ``ended`` (keys and ``until``) get their end."""
    ends = ended.groupBy(*keys).agg(F.max("until").alias("_until"))
    return edges.join(ends, keys, "left").withColumn("until", F.coalesce("until", "_until")).select(*edges.columns)


def upsert_edges(current: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Active edges are refreshed by natural key, others added; ended edges stay as they are."""
    active, ended = current.where("until IS NULL"), current.where("until IS NOT NULL")
    rules = {"edge_id": "existing_first", "since": "existing_first"}
    return upsert(active, delta, keys, rules).unionByName(ended)


def write_version(frame: DataFrame, root: str) -> str:
    """A new version folder below ``root``, which ``read_version`` reads from now on.

    Versions are numbered in a table that is only ever appended to, after the version's own folder is whole; so a
    crash at any point leaves the version before in place.  One writer at a time.
    """
    spark = frame.sparkSession
    last = _last_version(spark, root)
    path = f"{root}/v-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    number = 0 if last is None else last["number"] + 1
    spark.createDataFrame([(number, path)], "number long, path string").coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return path


def _last_version(spark: SparkSession, root: str):
    try:
        return spark.read.schema("number long, path string").parquet(f"{root}/versions").orderBy(F.desc("number"), F.desc("path")).first()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_version(spark: SparkSession, root: str) -> DataFrame:
    last = _last_version(spark, root)
    if last is None:
        raise FileNotFoundError(f"no version of a table at {root}")
    return spark.read.parquet(last["path"])
