import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from stakeweave.functions import names
from stakeweave.operators import claims, edges, maintenance, moderation, persons, resolution, search, tree
from stakeweave.operators.upsert import read_version, update_only, upsert, write_version

OWNS = "edge_id string, from_id string, to_id string, stake_percent double, direct_or_indirect string, since string, until string, source_id string"


def owns(spark, rows):
    """Edges from (from, to, stake, marker, until) rows."""
    return spark.createDataFrame([(f"e{i:03d}", a, b, s, m, None, u, "src") for i, (a, b, s, m, u) in enumerate(rows)], OWNS)


def nothing(spark, kind="suppression"):
    if kind == "pin":
        return spark.createDataFrame([], "from_id string, to_id string, stake_percent double, ownership_type string")
    return spark.createDataFrame([], "target_kind string, from_id string, to_id string, role string, node_id string")


@pytest.mark.parametrize("stakes, want", [([7.0, 5.0], (12.0, 88.0, 0, False)), ([80.0, 63.0], (143.0, None, 0, True)), ([10.0, None], (10.0, None, 1, False)),
                                          ([None], (None, None, 1, False)), ([60.0, 39.8], (99.8, None, 0, False))])
def test_ownership_summary(spark, stakes, want):
    rows = [(f"o{i}", "x", s, None, None) for i, s in enumerate(stakes)] + [("x", "x", 5.0, None, None), ("old", "x", 50.0, None, "2020-01-01")]
    got = edges.ownership_summary(edges.current_owners(owns(spark, rows), nothing(spark), nothing(spark, "pin"))).first()
    assert tuple(got)[1:5] == want


def test_overlays_come_in_order(spark):
    rows = [("a", "x", 10.0, None, None), ("a", "x", 30.0, None, None), ("b", "x", 20.0, None, None), ("c", "x", 5.0, None, None)]
    hide = spark.createDataFrame([("owns", "b", "x", None, None), ("node", None, None, None, "c")], nothing(spark).schema)
    pins = spark.createDataFrame([("a", "x", 51.0, "majority")], nothing(spark, "pin").schema)
    got = edges.current_owners(owns(spark, rows), hide, pins).collect()
    assert [(r.from_id, r.stake_percent, r.ownership_type, r.edge_id) for r in got] == [("a", 51.0, "majority", "e000")]


def test_tree(spark):
    chain = owns(spark, [("a", "b", 1.0, None, None), ("b", "c", 1.0, "direct", None), ("a", "c", None, "indirect", None), ("c", "a", 1.0, None, "2020"), ("a", "b", 2.0, None, None)])
    root = spark.createDataFrame([("a",)], "id string")
    paths = sorted("".join(r.node_path) for r in tree.ownership_tree(chain, root, 3).collect())
    assert paths == ["ab", "ab", "abc", "abc", "abca", "abca"]
    assert tree.ownership_tree(chain, root, 1, True).count() == 3
    deep = tree.ownership_tree(chain, root, 99)
    assert deep.where("size(edge_path) <> size(array_distinct(edge_path))").count() == 0 and deep.agg(F.max("depth")).first()[0] <= 10
    hop = owns(spark, [("a", "b", 1.0, "indirect", None), ("b", "c", 1.0, "direct", None)])
    assert tree.ownership_tree(hop, root, 3).count() == 0


def test_family_and_forwarding(spark):
    pairs = spark.createDataFrame([("g", "p"), ("p", "s"), ("p", "sibling"), ("s", "c"), ("c", "s")], "from_id string, to_id string")
    got = {r.id for r in tree.family(pairs, spark.createDataFrame([("s",)], "id string")).collect()}
    assert got == {"g", "p", "s", "c"}
    merged = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "old_id string, new_id string")
    ids = spark.createDataFrame([("a",), ("c",), ("x",), ("zz",)], "id string")
    got = dict(tree.resolve_forwarding(merged, spark.createDataFrame([("c",)], "id string"), ids).collect())
    assert got == {"a": "c", "c": "c", "x": None, "zz": None}
    new = spark.createDataFrame([("c", "d")], "old_id string, new_id string")
    assert dict(tree.collapse_forwarding(merged, new).collect())["b"] == "d"


def test_counts_and_sections(spark):
    rows = owns(spark, [("p", "s1", 1.0, None, None), ("p", "s1", 2.0, None, None), ("p", "s2", 1.0, None, "2020")])
    none = rows.limit(0)
    got = edges.section_counts(spark.createDataFrame([("p",), ("s1",)], "id string"), rows, none, none, none)
    assert {r.id: (r.owners, r.subsidiaries) for r in got.collect()} == {"p": (0, 1), "s1": (1, 0)}
    assert edges.dedup_owns(rows).first().stake_percent == 2.0
    assert tuple(edges.duplicate_owns_stats(rows).first()) == (2, 1, 1, 1)


PERSON = "id string, full_name string, first_name string, last_name string, birth_date string, birth_place string, wikidata_id string, alias array<string>"


def test_person_duplicates(spark):
    """Ten situations and the confidence of each."""
    people = [
        ("a1", "Page Larry", None, None, None, None, None, []), ("a2", "Larry Page", "Larry", "Page", None, None, "Q1", []),
        ("b1", "Jon Doe", "Jon", "Doe", "1970-01-02", "Oslo", None, []), ("b2", "Jonathan D", "Jonathan", "D", "1970-01-02", "Oslo", None, []),
        ("c1", "Mr Ian Fox", None, None, None, None, None, []), ("c2", "Ian Fox", "Ian", "Fox", None, None, None, []),
        ("d1", "Dr Amy Beth Cole", None, None, None, None, None, []), ("d2", "Amy Beth Cole", None, "Cole", None, None, None, []),
        ("e1", "Uma Vale", None, None, "1980-05", None, None, []), ("e2", "Vale Uma", None, None, "1980-05", None, None, []),
        ("f1", "Sam Hill", None, None, "1950-01-01", None, None, []), ("f2", "Hill Sam", None, None, "1990-01-01", None, None, []),
        ("g1", "Larry Fink", "Larry", "Fink", None, None, "Q2", []), ("g2", "Laurence Fink", "Laurence", "Fink", None, None, None, []),
        ("h1", "Ann Stone", "Ann", "Stone", None, None, None, []), ("h2", "Bob Stone", "Bob", "Stone", None, None, None, []),
        ("i1", "Dave Marsh", "Dave", "Marsh", None, None, None, []), ("i2", "David Marsh", "David", "Marsh", None, None, None, []),
        ("j1", "Bill Gates", "Bill", "Gates", None, None, None, ["William H. Gates III"]), ("j2", "Gates William H Iii", None, None, None, None, None, []),
    ]
    links = [(p, f"co-{p[0]}") for p in ("a1", "a2", "g1", "g2", "h1", "h2", "j1", "j2")] + [("i1", "co-x"), ("i2", "co-y")]
    e = spark.createDataFrame(links, "from_id string, to_id string")
    groups = persons.duplicate_groups(spark.createDataFrame(people, PERSON), [e], spark.createDataFrame([], "a string, b string"))
    got = {r.members[0][0]: r for r in groups.collect()}
    assert {k: v.confidence for k, v in got.items()} == {"a": "high", "b": "high", "c": "low", "d": "medium", "e": "high", "f": "low", "g": "medium", "j": "high"}
    assert got["a"].keep_id == "a2" and got["g"].keep_id == "g1" and got["f"].likely_distinct
    told = persons.drop_dismissed(groups, spark.createDataFrame([("c2", "c1")], "a string, b string"))
    assert {r.members[0][0] for r in told.collect()} == set(got) - {"c"}
    plan = persons.auto_merge_plan(groups)
    assert dict(plan.select("dup_id", "keep_id").collect()) == {"a1": "a2", "b2": "b1", "e2": "e1", "j2": "j1"} or plan.count() == 4
    merged = persons.merge_persons(spark.createDataFrame(people, PERSON), plan)
    assert merged.count() == len(people) - 4 and "Page Larry" in merged.where("id = 'a2'").first().alias


def groups_by_pairs(people, links, separate):
    """Groups of persons (with their keys) by the signals' definitions, all pairs compared."""
    linked = collections.defaultdict(set)
    for p, e in links:
        linked[p].add(e)
    signals = []
    for kind in ("birth", "name"):
        by = collections.defaultdict(set)
        for p in people:
            keys = ([(p.birth_date, p.place)] if p.birth_date and p.birth_place else []) if kind == "birth" else map(tuple, p.name_keys)
            for k in keys:
                by[k].add(p.id)
        signals += [(kind, k, frozenset(m)) for k, m in sorted(by.items())]
    rows = {p.id: p for p in people}
    for a, b in itertools.combinations(people, 2):
        x, y = a.given, b.given
        alike = x and y and (a.full == b.full or x.startswith(y) or y.startswith(x) or (len(x) > 1 and x[:2] == y[:2]))
        if a.surname and a.surname == b.surname and a.own_key != b.own_key and alike and linked[a.id] & linked[b.id]:
            signals.append(("variant", None, frozenset((a.id, b.id))))
    out, told = {}, {frozenset(x) for x in separate}
    for kind, key, m in signals:
        if len(m) < 2 or m in out:
            continue
        shared = any(linked[a] & linked[b] for a, b in itertools.combinations(m, 2))
        dates = [rows[i].birth_date for i in m if rows[i].birth_date]
        same, differ = len(dates) > 1 and len(set(dates)) == 1, len(set(dates)) > 1 and not shared
        width = len(key) if kind == "name" else max(len(rows[i].own_key) for i in m)
        grade = ("high" if same else "medium") if kind == "variant" else "high" if shared or same else "low" if differ else "medium" if width > 2 else "low"
        keep = min(m, key=lambda i: (not rows[i].wikidata_id, -len(linked[i]), len(rows[i].full_name), i))
        out[m] = (grade, differ, keep)
    return {tuple(sorted(m)): v for m, v in out.items() if not all(frozenset(x) in told for x in itertools.combinations(m, 2))}


@pytest.mark.parametrize("seed", [1, 2])
def test_person_duplicates_match_all_pairs(spark, seed):
    draw = random.Random(seed)
    given, last = ["Bob", "Robert", "R", "B", "Ro", "Larry", "Laurence", "L", "Ann", "Anna", "", "Mr Ed"], ["Fink", "Stone", "St-One", "Fink Jr"]
    people = []
    for i in range(140):
        g, n = draw.choice(given), draw.choice(last)
        name = f"{g} {n}" if draw.random() < 0.8 else f"{n} {g}"
        alias = [f"{draw.choice(given)} {draw.choice(last)} Extra"] if draw.random() < 0.2 else None if draw.random() < 0.3 else []
        people.append((f"p{i:03d}", name, draw.choice([None, "", g]), draw.choice([None, n, ""]), draw.choice([None, "", "1970-01-01", "1980-02-02"]), draw.choice([None, "Oslo", "Os lo", "Rome", ""]), draw.choice([None, None, f"Q{i}", ""]), alias))
    links = [(f"p{draw.randrange(150):03d}", f"c{draw.randrange(12)}") for _ in range(200)]
    separate = [(f"p{draw.randrange(140):03d}", f"p{draw.randrange(140):03d}") for _ in range(600)]
    table = spark.createDataFrame(people, PERSON)
    e = spark.createDataFrame([x if k % 2 else x[::-1] for k, x in enumerate(links)] + links[:5], "from_id string, to_id string")
    keyed = table.select(
        "*", names.normalize_place(F.col("birth_place")).alias("place"), names.name_key(F.col("full_name")).alias("own_key"), names.surname_key(F.col("last_name"), F.col("full_name")).alias("surname"),
        F.filter(F.transform(F.concat(F.array("full_name"), F.coalesce("alias", F.array().cast("array<string>"))), names.name_key), lambda k: F.size(k) > 0).alias("name_keys"),
        names.first_token(F.coalesce(F.nullif("first_name", F.lit("")), F.col("full_name"))).alias("given"),
    ).withColumn("full", names.full_given_name(F.col("given"))).collect()
    want = groups_by_pairs(keyed, set(links), separate)
    pairs = spark.createDataFrame(separate, "a string, b string")
    got = persons.duplicate_groups(table, [e], pairs)
    assert {tuple(r.members): (r.confidence, r.likely_distinct, r.keep_id) for r in got.collect()} == want and got.count() == len(want) > 30
    rows = persons.duplicate_members(table, [e], pairs)
    assert rows.count() == sum(map(len, want))
    plan = lambda x: sorted(map(tuple, persons.auto_merge_plan(x).select("dup_id", "keep_id").collect()))
    assert plan(rows) == plan(got)


def test_variants_are_written_once(spark, monkeypatch):
    """Of 900 pairs of variants at one company no row is kept for their members, nor joined with their companies."""
    kept = []
    monkeypatch.setattr(persons, "cut", lambda frame: kept.append(tree.cut(frame)) or kept[-1])
    people = [(f"{g[0]}{i:02d}", f"{g} {i:02d} Fink", g, "Fink", None, None, None, []) for g in ("Bob", "Robert") for i in range(30)]
    e = spark.createDataFrame([(p[0], "co") for p in people], "from_id string, to_id string")
    rows = persons.duplicate_members(spark.createDataFrame(people, PERSON), [e], spark.createDataFrame([("B00", "R00")], "a string, b string")).collect()
    want = {("B%02d" % i, "R%02d" % k) for i in range(30) for k in range(30)} - {("B00", "R00")}
    found = collections.defaultdict(set)
    for r in rows:
        if {r.gid.split("|")[1][0], r.gid.split("|")[2][0]} == {"B", "R"}:
            found[r.gid].add(r.id)
    assert {tuple(sorted(x)) for x in found.values()} == want and max(k.count() for k in kept) <= 240


def test_hot_names_and_surnames(spark):
    """Half of all persons have one name, a third one surname at one company, and no value holds them all."""
    people = spark.range(60_000).select(
        F.concat(F.lit("p"), "id").alias("id"),
        F.when(F.col("id") % 2 == 0, F.lit("Ann Lee Common")).otherwise(F.concat(F.chr(97 + F.col("id") % 26), F.chr(97 + (F.col("id") / 26).cast("long") % 26), F.lit("x"), F.col("id"), F.lit(" Hot"))).alias("full_name"),
        *[F.lit(None).cast("string").alias(c) for c in ("first_name", "last_name", "birth_date", "birth_place", "wikidata_id")], F.lit(None).cast("array<string>").alias("alias"),
    )
    links = people.where("full_name LIKE '% Hot' AND int(substring(id, 2)) % 3 = 0").select(F.col("id").alias("from_id"), F.lit("c1").alias("to_id"))
    rows = persons.duplicate_members(people, [links], spark.createDataFrame([], "a string, b string"))
    assert "collect_" not in rows._jdf.queryExecution().optimizedPlan().toString()
    sizes = {r.reason: (r.n, r.g) for r in rows.groupBy("reason").agg(F.max("n").alias("n"), F.count_distinct("gid").alias("g")).collect()}
    stems = collections.Counter((i % 26, i // 26 % 26) for i in range(60_000) if i % 2 and i % 3 == 0)
    assert sizes == {"same name/alias (order/spelling/title)": (30_000, 1), "same surname + shared company (name variant)": (2, sum(n * (n - 1) // 2 for n in stems.values()))}


ENTITY = "id string, name string, name_normalized string, country string, founded int, lei_id string, companies_house_id string, sec_cik string, wikidata_id string, registered_address string, name_credibility int, verified boolean, aliases array<string>, description string"


def entity(i, name="n", **more):
    base = dict.fromkeys([c.split()[0] for c in ENTITY.split(", ")])
    return tuple((base | {"id": i, "name": name, "name_normalized": name.lower(), "aliases": []} | more).values())


@pytest.mark.parametrize("members, want", [
    ([{"lei_id": "L"}, {"lei_id": "L"}, {}], "definitive"), ([{"registered_address": "r"}, {"registered_address": "r"}], "high"),
    ([{"country": "DE", "founded": 1990}, {}], "medium"), ([{"country": "DE", "founded": 1990}, {"country": "FR"}], "low"), ([{"country": "DE"}, {"country": "DE"}], "low"),
    ([{"sec_cik": ""}, {"sec_cik": ""}], "low"),
])
def test_name_confidence(spark, members, want):
    frame = spark.createDataFrame([entity(f"i{k}", **m) for k, m in enumerate(members)], ENTITY)
    assert resolution.duplicate_names(frame).first().confidence == want
    assert resolution.duplicate_name_report(frame, least="bogus").count() == 1


def test_entity_merge(spark):
    frame = spark.createDataFrame([
        entity("a", "Acme", lei_id="L1", name_credibility=90), entity("b", "ACME Corp", lei_id="L1", name_credibility=50, wikidata_id="Q1", description="d", verified=True),
        entity("c", "Acme Ltd", wikidata_id="Q1"), entity("s1", "S", sec_cik="1"), entity("s2", "S", sec_cik="1"), entity("s3", "S", sec_cik="1"),
    ], ENTITY)
    apart = spark.createDataFrame([("s2", "s1")], "a string, b string")
    plan = resolution.merge_plan(frame, apart)
    assert dict(plan.select("dup_id", "keep_id").collect()) == {"b": "a", "c": "a", "s3": "s1"}
    merged = {r.id: r for r in resolution.merge_entities(frame, plan).collect()}
    assert set(merged) == {"a", "s1", "s2"}
    a = merged["a"]
    assert (a.name, a.wikidata_id, a.description, a.name_credibility, a.verified, a.aliases) == ("Acme", "Q1", "d", 90, True, ["ACME Corp", "Acme Ltd"])
    moved = owns(spark, [("b", "x", 1.0, None, None), ("a", "x", 2.0, None, None), ("b", "a", 1.0, None, None), ("y", "c", 3.0, None, "2020")])
    got = resolution.rewrite_endpoints(moved, plan, ("from_id", "to_id"))
    assert sorted((r.from_id, r.to_id, r.stake_percent) for r in got.collect()) == [("a", "x", 2.0), ("y", "a", 3.0)]


def test_plan_cycles_and_chains(spark):
    plan = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("x", "y", "r"), ("y", "x", "r")], "dup_id string, keep_id string, reason string")
    got = dict(resolution.collapse_plan(plan).select("dup_id", "keep_id").collect())
    assert got == {"a": "c", "b": "c", "y": "x"}


def test_resolution_order(spark):
    stored = spark.createDataFrame([("e1", "Q1", None, "n"), ("e2", None, "0001", "n"), ("e0", None, None, "n")], "id string, wikidata_id string, sec_cik string, name_normalized string")
    asked = spark.createDataFrame([("k1", "Q1", "0001", "n"), ("k2", None, "0001", "n"), ("k3", "Q9", None, "n"), ("k4", None, None, "zz")], "key string, wikidata_id string, sec_cik string, name_normalized string")
    got = {r.key: (r.entity_id, r.matched_on) for r in resolution.resolve_by_identifier(asked, stored, "key").collect()}
    assert got == {"k1": ("e1", "wikidata_id"), "k2": ("e2", "sec_cik"), "k3": ("e0", "name_normalized"), "k4": (None, None)}


def test_wipe_and_purge(spark):
    e = spark.createDataFrame([("e1", "a", "b", "S"), ("e2", "b", "c", "T")], "edge_id string, from_id string, to_id string, source_id string")
    nodes = spark.createDataFrame([("a", "A", "S"), ("b", "B", "S"), ("c", "C", "T")], "id string, name string, source_id string")
    left, kept = resolution.wipe_source(e, nodes, [], "S")
    assert [r.edge_id for r in left.collect()] == ["e2"] and sorted(r.id for r in kept.collect()) == ["b", "c"]
    kept, left, _ = maintenance.purge_company(nodes, e, nodes.limit(0), "a")
    assert sorted(r.id for r in kept.collect()) == ["b", "c"] and left.count() == 1


def test_purge_reads_edges_once(spark, tmp_path):
    rows = [("e1", "a", "b"), ("e2", "b", "c"), ("e3", "d", "a"), ("e4", "d", "A"), ("e5", "p", "a"), ("e6", "a", None), ("e7", "f", "f"), ("e8", "a", "a")]
    spark.createDataFrame(rows, "edge_id string, from_id string, to_id string").write.parquet(str(tmp_path / "edges"))
    e = spark.read.parquet(str(tmp_path / "edges"))
    nodes = spark.createDataFrame([("a", "X"), ("A", "x"), ("b", "B"), ("c", "C"), ("d", "D"), ("f", None), ("g", "x")], "id string, name string")
    persons = spark.createDataFrame([("p",), ("q",)], "id string")
    kept, left, people = maintenance.purge_company(nodes, e, persons, "x")
    assert sorted(r.id for r in kept.collect()) == ["b", "c", "f"] and sorted(r.edge_id for r in left.collect()) == ["e2", "e7"] and [r.id for r in people.collect()] == ["q"]
    assert left.columns == e.columns and kept._jdf.queryExecution().optimizedPlan().toString().count("Relation [edge_id#") == 1


def test_claims(spark):
    rows = [("owns", "a", "b", "s1", 10.0, "2020", 80, "2020-02"), ("owns", "a", "b", "s2", 20.0, "2019", 90, "2020-01"), ("owns", "a", "b", "s3", 30.0, "2021", 90, "2020-03")]
    frame = spark.createDataFrame(rows, "kind string, from_id string, to_id string, source_id string, stake_percent double, source_date string, credibility_score int, last_seen_at string")
    frame = claims.with_claim_key(frame.withColumn("source_url", F.lit("u")))
    assert claims.best_claim(frame, "from_id", "to_id").first().source_id == "s3"
    assert claims.claims_for(frame).count() == 0 and claims.claims_for(frame, to_id="b").first().source_id == "s3"
    stored = frame.withColumn("first_seen_at", F.lit("2019-01"))
    got = claims.upsert_claims(stored, frame.where("source_id = 's1'").withColumn("stake_percent", F.lit(99.0)).withColumn("last_seen_at", F.lit("2025")))
    row = got.where("source_id = 's1'").first()
    assert got.count() == 3 and (row.first_seen_at, row.last_seen_at, row.stake_percent) == ("2019-01", "2025", 99.0)


def test_upserts(spark, tmp_path):
    current = spark.createDataFrame([("a", "x", 1, False), ("b", "", 2, True)], "id string, name string, n int, ok boolean")
    delta = spark.createDataFrame([("a", "y", 9, True), ("c", "z", 3, None)], current.schema)
    got = {r.id: tuple(r)[1:] for r in upsert(current, delta, ["id"], {"name": "existing_first", "n": "max", "ok": "either"}).collect()}
    assert got == {"a": ("x", 9, True), "b": ("", 2, True), "c": ("z", 3, False)}
    assert {r.id for r in update_only(current, delta, ["id"]).collect()} == {"a", "b"}
    write_version(current, str(tmp_path))
    write_version(update_only(read_version(spark, str(tmp_path)), delta, ["id"]), str(tmp_path))
    assert read_version(spark, str(tmp_path)).where("id = 'a'").first().name == "y"


def test_moderation(spark):
    schema = "id string, target_kind string, from_id string, to_id string, role string, node_id string, category string, status string, created_at string, note string, reporter_id string"
    flags = spark.createDataFrame([("f1", "owns", "a", "b", None, None, "c", "open", "1", "x", "u"), ("f2", "owns", "a", "b", None, None, "c", "reviewing", "2", "", "u"),
                                   ("f3", "node", None, None, None, "n", "c", "open", "3", None, "v")], schema)
    top = moderation.group_flags(flags).first()
    assert (top.n, top.note, top.ids) == (2, "x", ["f1", "f2"])
    assert {r.id for r in moderation.collapse_reports(flags).collect()} == {"f1", "f3"}
    e = owns(spark, [("a", "b", 1.0, None, None), ("a", "b", 1.0, None, "2020")])
    hidden, after, left = moderation.suppress(nothing(spark), flags, e, flags.where("id IN ('f1', 'f3')"))
    assert hidden.count() == 2 and left.count() == 1 and {r.id: r.status for r in after.collect()} == {"f1": "resolved", "f2": "reviewing", "f3": "resolved"}
    pins = spark.createDataFrame([("a", "b", 10.0, "minority")], "from_id string, to_id string, stake_percent double, ownership_type string")
    new = spark.createDataFrame([("a", "b", None, "majority"), ("c", "d", 5.0, None)], pins.schema)
    assert sorted(map(tuple, moderation.upsert_pins(pins, new).collect())) == [("a", "b", 10.0, "majority"), ("c", "d", 5.0, None)]


def test_search_ranking(spark):
    nodes = spark.createDataFrame([("1", "BlackRock, Inc.", "Q1", "US"), ("2", "BLACKROCK GLOBAL FUND, INC.", None, "US"), ("3", "Heineken Vietnam", None, "VN"), ("4", "Heineken Holding", "Q4", "NL"),
                                   ("5", "Obscure", None, "NL")], "id string, name string, wikidata_id string, country string")
    from stakeweave.functions.names import normalize_entity_name

    nodes = nodes.withColumn("name_normalized", normalize_entity_name(F.col("name")))
    queries = spark.createDataFrame([("a", "BlackRock, Inc.", None), ("b", "heineken vietnam", None), ("c", "heineken", None), ("d", "scur", None), ("e", "heineken", "VN")], "query_id string, q string, country string")
    queries = queries.withColumn("nn", normalize_entity_name(F.col("q")))
    found = search.entity_candidates(nodes, search.token_index(nodes, "id", "name"), queries)
    best = {r.query_id: r.id for r in search.best_entity(found, nodes.drop("country"), queries.select("query_id", "q", "nn")).collect()}
    assert best == {"a": "1", "b": "3", "c": "4", "d": "5", "e": "3"}
    hidden = spark.createDataFrame([("4",)], "id string")
    assert search.best_entity(found, nodes.drop("country"), queries.select("query_id", "q", "nn"), hidden).where("query_id = 'c'").first().id == "3"


def test_maintenance(spark):
    rows = [("1", "Germany", "n", None, "Q1", None), ("2", "usa", "n", None, None, "1"), ("3", "fr", "n", "s", None, None), ("4", "Narnia", "n", None, None, None)]
    frame = spark.createDataFrame(rows, "id string, country string, name string, source_id string, wikidata_id string, sec_cik string")
    codes = spark.createDataFrame([("DE", "Germany"), ("FR", "France")], "code string, name string")
    assert [r.country for r in maintenance.normalize_countries(frame, codes).orderBy("id").collect()] == ["DE", "US", "FR", "Narnia"]
    sources = spark.createDataFrame([("w", "Wikidata"), ("e", "SEC EDGAR")], "id string, name string")
    assert [r.source_id for r in maintenance.backfill_sources(frame, sources).orderBy("id").collect()] == ["w", "e", "s", None]
    e = spark.createDataFrame([("1", "Main St 1, Bonn", "Bonn", "DE", None, None, None), ("2", "nowhere", "Bonn", "DE", None, None, None), ("3", None, "Rome", "IT", None, None, None)],
                              "id string, hq_address string, hq_city string, hq_country string, hq_lat double, hq_lng double, hq_geo_precision string")
    places = spark.createDataFrame([("main st 1, bonn", 1.0, 2.0), ("Bonn, DE", 3.0, 4.0)], "place string, lat double, lng double")
    assert [(r.hq_lat, r.hq_geo_precision) for r in maintenance.geocode(e, places).orderBy("id").collect()] == [(1.0, "exact"), (3.0, "approx"), (None, None)]


def test_graph_tables_take_whole_tables():
    import duckdb

    from stakeweave.plans.fixture import SQL

    duck = duckdb.connect()
    duck.execute("""CREATE TABLE lineitem AS SELECT i // 7 AS l_orderkey, CAST(i % 7 + 1 AS INT) AS l_linenumber, i AS l_partkey, i % 90 AS l_suppkey, 0.01 * (i % 11) AS l_discount,
        0.01 * (i % 9) AS l_tax, 1.0 AS l_quantity, 'F' AS l_linestatus, 'A' AS l_returnflag, TIMESTAMP '2020-01-01' AS l_shipdate FROM range(700) t(i)""")
    duck.execute("CREATE TABLE orders AS SELECT i AS o_orderkey, i AS o_custkey, TIMESTAMP '2020-01-01' AS o_orderdate, '5-LOW' AS o_orderpriority FROM range(100) t(i)")
    duck.execute("CREATE TABLE supplier AS SELECT i AS s_suppkey FROM range(90) t(i)")
    count = lambda table, where: duck.execute(f"SELECT COUNT(*), COUNT(DISTINCT {where[1]}) FROM ({SQL[table]}) WHERE {where[0]}").fetchone()
    assert count("owns", ("edge_id LIKE 'L%'", "edge_id")) == (700, 700)
    assert count("has_role", ("TRUE", "edge_id")) == (700, 700)
    assert count("merged_id", ("old_id LIKE 'old:%'", "old_id")) == (90, 90)


def test_reachable_goes_on_until_nothing_is_new(spark, monkeypatch):
    from stakeweave.operators import tree

    class Frame:
        """Stands for a chain of 150 links, without a Spark job for each round."""

        rounds = 0

        def __getattr__(self, name):
            return lambda *_: self

        def isEmpty(self):  # noqa: N802
            Frame.rounds += 1
            return Frame.rounds > 150

    monkeypatch.setattr(tree, "cut", lambda frame: frame)
    tree.reachable(Frame(), Frame(), "from_id", "to_id")
    assert Frame.rounds == 151


def test_identifiers_are_looked_up_by_one_join(spark):
    """The first identifier in order decides, its smallest id; empty ones and nulls find nothing; one join looks up all of them."""
    local = spark.createDataFrame([("b", "Q1", "1", ""), ("a", "Q1", None, ""), ("c", "", "2", None), ("d", None, "Q1", None)], "id string, wikidata_id string, sec_cik string, lei_id string")
    asked = spark.createDataFrame([("r1", "Q1", "2", None), ("r2", "Q9", "2", ""), ("r3", "", "9", ""), ("r4", None, None, None), ("r5", None, "Q1", None)], "k string, wikidata_id string, sec_cik string, lei_id string")
    got = resolution.resolve_by_identifier(asked, local, "k")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    assert sorted(map(tuple, got.collect())) == [("r1", "a", "wikidata_id"), ("r2", "c", "sec_cik"), ("r3", None, None), ("r4", None, None), ("r5", "d", "sec_cik")]


def test_role_without_stake_counts_people_and_aggregates_after_the_limit(spark):
    roles = [(f"p{i % 5}", f"c{i % 2}") for i in range(40)] + [(None, "c0"), ("p1", None), (None, "c0")]
    owns = [("p0", "c0"), ("p4", "c1"), ("p4", "c1"), (None, "c0")]
    found = edges.role_without_stake(spark.createDataFrame(roles, "from_id string, to_id string"), spark.createDataFrame(owns, "from_id string, to_id string"), 3)
    people = collections.defaultdict(set)
    for p, c in roles:
        if None in (p, c) or (p, c) not in owns:
            people[c].add(p)
    want = [(p, c) for c, some in people.items() for p in sorted(some, key=lambda p: (p is not None, p))[:3]]
    assert sorted(map(str, map(tuple, found.select("from_id", "to_id").collect()))) == sorted(map(str, want))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "HashAggregate" not in plan[plan.rindex("WindowGroupLimit") :]
