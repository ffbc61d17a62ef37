"""Entity resolution: identifiers, duplicate names, merge plans and their application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stakeweave.operators.tree import cut

HARD_IDS = ("lei_id", "companies_house_id", "sec_cik", "wikidata_id")
#: Identifiers in the order in which a lookup believes them.
LOOKUP_ORDER = ("wikidata_id", "sec_cik", "lei_id", "companies_house_id", "name_normalized", "name")
CONFIDENCE = ("definitive", "high", "medium", "low")


def resolve_by_identifier(candidates: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """``key, entity_id, matched_on``: the first identifier in order that finds an entity; of several the smallest id."""
    columns = [c for c in LOOKUP_ORDER if c in candidates.columns and c in entities.columns]
    # A row for each identifier, so that one join and one look at either table find them all.
    held = F.filter(F.array(*[F.struct(F.lit(k).alias("rank"), F.col(c).cast("string").alias("_v")) for k, c in enumerate(columns)]), lambda x: x["_v"].isNotNull())
    stored = entities.select("id", F.explode(held).alias("h")).where("h._v <> ''").groupBy("h.rank", "h._v").agg(F.min("id").alias("entity_id"))
    found = candidates.select(key, F.explode(held).alias("h")).select(key, "h.*").join(stored, ["rank", "_v"])
    matched = F.element_at(F.array(*map(F.lit, columns)), F.col("rank") + 1).alias("matched_on")
    best = found.groupBy(key).agg(F.min_by(F.struct("entity_id", matched), "rank").alias("_b"))
    return candidates.select(key).join(best, key, "left").select(key, F.col("_b.entity_id").alias("entity_id"), F.col("_b.matched_on").alias("matched_on"))


def duplicate_names(entities: DataFrame, name: str = "name_normalized") -> DataFrame:
    """Names of more than one entity, how many share each, and how sure it is that they are one company."""
    named = entities.where(F.coalesce(F.col(name), F.lit("")) != "")
    said = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    ends = [f(said(c)).alias(f"{c}_{n}") for c in ("country", "founded") for n, f in (("min", F.min), ("max", F.max))]
    groups = named.groupBy(name).agg(F.count(F.lit(1)).alias("n"), *ends).where("n > 1")
    # Identifiers and addresses that several entities of a name have; most entities have few or none.
    kinds = (*HARD_IDS, "registered_address")
    held = F.filter(F.array(*[F.struct(F.lit(c in HARD_IDS).alias("hard"), F.lit(k).alias("kind"), said(c).alias("value")) for k, c in enumerate(kinds)]), lambda x: x["value"].isNotNull())
    values = named.select(name, F.explode(held).alias("v")).groupBy(name, "v").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    shared = values.groupBy(name).agg(F.max("v.hard").alias("hard"))
    one = lambda c: F.coalesce(F.col(f"{c}_min") == F.col(f"{c}_max"), F.lit(False))
    grade = F.when(F.col("hard"), "definitive").when(F.col("hard").isNotNull(), "high").when(one("country") & one("founded"), "medium").otherwise("low")
    return groups.join(shared, name, "left").select(name, "n", grade.alias("confidence"))


#: Columns of a group's members in the review list, and how many members it shows.
MEMBER_COLUMNS, MOST_MEMBERS = ("id", "name", "country", "founded", *HARD_IDS, "registered_address"), 25


def duplicate_name_report(entities: DataFrame, name: str = "name_normalized", least: str | None = None, most: int = 100) -> DataFrame:
    """The largest groups of one name, from ``least`` confidence up (an unknown grade filters nothing)."""
    rank = F.array_position(F.array(*map(F.lit, CONFIDENCE)), F.col("confidence"))
    groups = duplicate_names(entities, name)
    if least in CONFIDENCE:
        groups = groups.where(rank <= CONFIDENCE.index(least) + 1)
    top = groups.orderBy(F.col("n").desc(), name).limit(most)
    columns = [c for c in MEMBER_COLUMNS if c in entities.columns]
    # Each group's first members by id; the window drops the others before anything is collected.
    place = F.row_number().over(Window.partitionBy(name).orderBy("id"))
    some = entities.join(top.select(name), name, "left_semi").withColumn("_n", place).where(F.col("_n") <= MOST_MEMBERS)
    members = some.groupBy(name).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("members"))
    return top.join(members, name).orderBy(F.col("n").desc(), name)


def scoped_merge_plan(entities: DataFrame, touched: DataFrame, separate: DataFrame, name: str = "name_normalized") -> DataFrame:
    """Merges of entities with the name of a touched one (column ``id``), where the group is surely one company.

    Sure groups are those graded definitive or high.  A pair that a moderator told apart stays apart; the
    group's other members are merged all the same.
    """
    names = entities.where(F.coalesce(F.col(name), F.lit("")) != "").join(touched.select("id"), "id", "left_semi").select(name).distinct()
    members = entities.join(names, name, "left_semi")
    sure = duplicate_names(members, name).where(F.col("confidence").isin(*CONFIDENCE[:2])).select(name, "confidence")
    plan = members.join(sure, name).select(F.col("id").alias("dup_id"), _survivor([name]).alias("keep_id"), F.concat(F.lit("same_name_"), "confidence").alias("reason"))
    return _not_separated(plan.where("dup_id <> keep_id"), separate)


def merge_report(plan: DataFrame, most: int = 100) -> DataFrame:
    """The first rows of a plan, each with the number of all its merges as ``total``."""
    return plan.orderBy("keep_id", "dup_id").limit(most).withColumn("total", F.lit(plan.count()))


def duplicate_name_totals(entities: DataFrame, name: str = "name_normalized") -> DataFrame:
    groups = duplicate_names(entities, name)
    return groups.agg(F.count(F.lit(1)).alias("duplicate_name_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant_nodes"))


def duplicate_ids(entities: DataFrame) -> DataFrame:
    """``id_kind, value, n, keep_id`` of every hard identifier that several entities carry."""
    parts = None
    for column in HARD_IDS:
        part = (
            entities.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(F.col(column).alias("value"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("keep_id")).where("n > 1").select(F.lit(column).alias("id_kind"), "value", "n", "keep_id")
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


def _survivor(keys: list[str]) -> Column:
    order = Window.partitionBy(*keys).orderBy(F.coalesce("name_credibility", F.lit(0)).desc(), F.coalesce("verified", F.lit(False)).desc(), "id")
    return F.first("id").over(order)


def _not_separated(plan: DataFrame, separate: DataFrame) -> DataFrame:
    pairs = separate.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b"))
    return plan.join(pairs, (F.least("dup_id", "keep_id") == F.col("_a")) & (F.greatest("dup_id", "keep_id") == F.col("_b")), "left_anti")


def merge_plan(entities: DataFrame, separate: DataFrame, by: tuple[str, ...] = HARD_IDS) -> DataFrame:
    """``dup_id, keep_id, reason``: entities that share an identifier fold into the most credible, verified, smallest one.

    Pairs that a moderator keeps separate are left out.  An entity that several
    identifiers would fold takes the survivor of the first; a survivor that is itself
    folded passes its own survivor on, so the plan has single hops and no cycles.
    """
    plan = None
    for rank, column in enumerate(by):
        some = entities.where(F.coalesce(F.col(column), F.lit("")) != "")
        part = some.select(F.col("id").alias("dup_id"), _survivor([column]).alias("keep_id"), F.lit(rank).alias("rank"), F.lit(column).alias("reason"))
        part = part.where("dup_id <> keep_id")
        plan = part if plan is None else plan.unionByName(part)
    plan = _not_separated(plan, separate)
    plan = plan.groupBy("dup_id").agg(F.min_by(F.struct("keep_id", "reason"), "rank").alias("_p")).select("dup_id", "_p.*")
    return collapse_plan(plan)


def collapse_plan(plan: DataFrame) -> DataFrame:
    """A plan without chains: every id's final survivor; ids whose chain ends in a cycle fold into the cycle's smallest id.

    Pointers double: after k rounds each has passed 2**k hops, so the rounds are logarithmic in the longest chain.
    """
    plan = cut(plan.select("dup_id", "keep_id", "reason"))
    at = plan.select("dup_id", "reason", F.col("keep_id").alias("at"), F.col("dup_id").alias("low"))
    ids = plan.select(F.col("dup_id").alias("at"))
    if at.join(ids, "at", "left_semi").isEmpty():
        return plan
    hops, n = 1, plan.count()
    while hops <= n:
        further = at.select(F.col("dup_id").alias("_d"), F.col("at").alias("_at"), F.col("low").alias("_low"))
        at = cut(at.join(further, F.col("at") == F.col("_d"), "left").select(
            "dup_id", "reason", F.coalesce("_at", "at").alias("at"), F.least("low", "_low").alias("low")  # least() skips nulls
        ))
        hops *= 2
        if at.join(ids, "at", "left_semi").isEmpty():
            break
    # Who still points at an id that folds is in a cycle by now, or has been led into one.
    low = at.select(F.col("dup_id").alias("_d"), F.col("low").alias("_low"))
    done = at.join(low, F.col("at") == F.col("_d"), "left").select("dup_id", F.coalesce("_low", "at").alias("keep_id"), "reason")
    return done.where("dup_id <> keep_id")


def bulk_delete_plan(entities: DataFrame, column: str) -> DataFrame:
    """Ids to delete so that each value of ``column`` keeps its smallest id; edges do not move."""
    order = Window.partitionBy(column)
    some = entities.where(F.coalesce(F.col(column), F.lit("")) != "")
    return some.withColumn("keep_id", F.min("id").over(order)).where("id <> keep_id").select("id", "keep_id")


def rewrite_endpoints(edges: DataFrame, plan: DataFrame, keep_one: tuple[str, ...] | None = None) -> DataFrame:
    """Edges with merged endpoints replaced; new self loops go.

    With ``keep_one``, an active edge that was moved goes where the survivor already has an active
    one for the same columns.
    """
    out = edges.withColumn("_moved", F.lit(False))
    for column in ("from_id", "to_id"):
        p = plan.select(F.col("dup_id").alias("_d"), F.col("keep_id").alias("_k"))
        out = out.join(p, F.col(column) == F.col("_d"), "left").withColumn("_moved", F.col("_moved") | F.col("_k").isNotNull())
        out = out.withColumn(column, F.coalesce("_k", column)).drop("_d", "_k")
    out = out.where("NOT (_moved AND from_id = to_id)")
    if keep_one:
        order = Window.partitionBy(*keep_one, F.col("until").isNull()).orderBy("_moved", "edge_id")
        out = out.withColumn("_n", F.row_number().over(order)).where("NOT _moved OR until IS NOT NULL OR _n = 1").drop("_n")
    return out.drop("_moved")


#: Columns that a merge treats on its own.
_LISTS = ("aliases", "countries", "hq_locations")


def merge_entities(entities: DataFrame, plan: DataFrame) -> DataFrame:
    """Survivors with the gaps filled from those folded into them, lists united, lost names kept as aliases.

    Several folded entities fill gaps in the order of their ids.  Columns unknown to this
    module fill like any other.
    """
    p = plan.select(F.col("dup_id").alias("id"), "keep_id")
    rows = entities.join(p, "id", "left").withColumn("_to", F.coalesce("keep_id", "id")).withColumn("_own", F.col("keep_id").isNull())
    kinds = dict(entities.dtypes)

    def first(column: str) -> Column:
        value = F.col(column)
        if kinds[column] == "string":
            value = F.nullif(value, F.lit(""))
        order = F.struct(~F.col("_own"), F.col("id"))
        return F.min_by(value, F.when(value.isNotNull(), order)).alias(column)

    aggregates = []
    for column in entities.columns:
        if column == "id":
            continue
        if column == "name":
            aggregates.append(F.max(F.when(F.col("_own"), F.col("name"))).alias("name"))
        elif column == "name_credibility":
            aggregates.append(F.max(F.coalesce("name_credibility", F.lit(0))).alias(column))
        elif column == "verified":
            aggregates.append(F.max(F.coalesce("verified", F.lit(False))).alias(column))
        elif column in _LISTS:
            own = F.coalesce(F.col(column), F.array().cast("array<string>"))
            if column == "aliases":
                own = F.when(F.col("_own"), own).otherwise(F.concat(own, F.array("name")))
            ordered = F.array_sort(F.collect_list(F.struct((~F.col("_own")).alias("o"), F.col("id").alias("i"), own.alias("v"))))
            aggregates.append(F.flatten(F.transform(ordered, lambda x: x["v"])).alias(column))
        else:
            aggregates.append(first(column))
    merged = rows.groupBy(F.col("_to").alias("id")).agg(*aggregates)
    for column in _LISTS:
        if column in entities.columns:
            merged = merged.withColumn(column, distinct_names(F.col(column), F.col("name") if column == "aliases" else None))
    return merged.select(*entities.columns)


def distinct_names(values: Column, own: Column | None = None) -> Column:
    """Trimmed values in order, without blanks and case-insensitive repeats, and without the own name."""
    plain = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))

    def once(xs: Column) -> Column:
        low = F.transform(xs, F.lower)
        return F.filter(xs, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)

    out = F.element_at(F.transform(F.array(plain), once), 1)
    return out if own is None else F.filter(out, lambda x: F.lower(x) != F.lower(F.trim(F.coalesce(own, F.lit("")))))


def merge_log_rows(plan: DataFrame, entities: DataFrame, at: Column) -> DataFrame:
    """Log rows of a plan, one per survivor and lost name."""
    names = entities.select(F.col("id").alias("_i"), F.col("name").alias("_n"))
    rows = plan.join(names.withColumnRenamed("_n", "dup_name"), F.col("dup_id") == F.col("_i")).drop("_i")
    rows = rows.join(names.withColumnRenamed("_n", "keep_name"), F.col("keep_id") == F.col("_i")).drop("_i")
    return rows.groupBy("keep_id", "keep_name", "dup_name").agg(F.min("dup_id").alias("dup_id"), F.count(F.lit(1)).cast("int").alias("count")).withColumn("at", at)


def reconcile(local: DataFrame, remote: DataFrame, remote_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A peer's snapshot told in local ids: its entities, its edges, and ``remote_id, id`` of every remote entity.

    A remote entity is the local one that its own id, else its best identifier finds; else it is new and keeps its id.
    """
    known = remote.select(F.col("id").alias("remote_id")).join(local.select(F.col("id").alias("remote_id")), "remote_id", "left_semi")
    others = remote.withColumnRenamed("id", "remote_id").join(known, "remote_id", "left_anti")
    found = resolve_by_identifier(others.drop("name", "name_normalized"), local, "remote_id")
    ids = known.withColumn("id", F.col("remote_id")).unionByName(found.select("remote_id", F.coalesce("entity_id", "remote_id").alias("id")))
    told = remote.withColumnRenamed("id", "remote_id").join(ids, "remote_id").select(*remote.columns)
    return told, rewrite_endpoints(remote_edges, ids.where("remote_id <> id").select(F.col("remote_id").alias("dup_id"), F.col("id").alias("keep_id"))), ids


def keep_separate(pairs: DataFrame, ids: DataFrame, kind: str, at: Column) -> DataFrame:
    """``pairs`` with every two ids of each group (columns ``group, id``) kept separate, once a pair."""
    a, b = (ids.select("group", F.col("id").alias(c)) for c in ("a", "b"))
    new = a.join(b, "group").where("a < b").select(F.lit(kind).alias("kind"), "a", "b", at.alias("at"))
    return pairs.unionByName(new.join(pairs, ["kind", "a", "b"], "left_anti").select(*pairs.columns))


def undo_keep_separate(pairs: DataFrame, undone: DataFrame) -> DataFrame:
    gone = undone.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kind")
    return pairs.join(gone, ["kind", "a", "b"], "left_anti").select(*pairs.columns)


def kept_separate_listing(pairs: DataFrame, nodes: DataFrame, kind: str, most: int = 100) -> DataFrame:
    """Pairs with both names, newest first."""
    name = lambda c: nodes.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    rows = pairs.where(F.col("kind") == kind).join(name("a"), "a").join(name("b"), "b")
    return rows.orderBy(F.col("at").desc(), "a", "b").limit(most).select("a", "a_name", "b", "b_name", "at")


def wipe_source(edges: DataFrame, nodes: DataFrame, others: list[DataFrame], source_id: str, prefixes: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes after a source is wiped: its edges go, then its nodes that no remaining edge touches."""
    mine = F.coalesce(F.col("source_id") == source_id, F.lit(False))
    left = edges.where(~mine)
    touched = left.select(F.col("from_id").alias("id")).unionByName(left.select(F.col("to_id").alias("id")))
    for other in others:
        kept = other.where(~mine)
        touched = touched.unionByName(kept.select(F.col("from_id").alias("id"))).unionByName(kept.select(F.col("to_id").alias("id")))
    own = mine
    for prefix in prefixes:
        own = own | F.col("id").startswith(prefix)
    gone = nodes.where(own).join(touched.distinct(), "id", "left_anti").select("id")
    return left, nodes.join(gone, "id", "left_anti")
