"""Limits, chains, hubs, other scripts, importers, and the small functions that no query calls."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stakeweave.functions import dates, hashing, names
from stakeweave.operators import claims as cl
from stakeweave.operators import edges as ed
from stakeweave.operators import maintenance as mt
from stakeweave.operators import moderation as mo
from stakeweave.operators import persons as pe
from stakeweave.operators import resolution as rs
from stakeweave.operators import search as se
from stakeweave.operators import tree as tr
from stakeweave.operators.imports import ImportLock, ImportLocked, import_control
from stakeweave.operators.store import Conflict, Store
from stakeweave.operators.upsert import ENTITY_OF_WIKIDATA, PERSON_OF_WIKIDATA, read_version, upsert, write_version
from stakeweave.sources import filings, registers


def ids(frame, column="id"):
    return sorted(r[0] for r in frame.select(column).collect())


def test_plans_follow_chains_of_any_length_and_end_in_cycles(spark):
    chain = [(f"n{i:04}", f"n{i + 1:04}", "x") for i in range(1000)]
    cycle = [("c3", "c1", "x"), ("c1", "c2", "x"), ("c2", "c3", "x"), ("a0", "c2", "x")]
    got = {r.dup_id: r.keep_id for r in rs.collapse_plan(spark.createDataFrame(chain + cycle, "dup_id string, keep_id string, reason string")).collect()}
    assert len(got) == 1000 + 3 and all(got[d] == "n1000" for d, *_ in chain)
    assert (got["c2"], got["c3"], got["a0"]) == ("c1", "c1", "c1") and "c1" not in got
    plain = [("b", "a", "x"), ("c", "a", "x")]
    assert len(rs.collapse_plan(spark.createDataFrame(plain, "dup_id string, keep_id string, reason string")).collect()) == 2


def test_limits_count_what_they_cut(spark):
    rows = spark.createDataFrame([("k", i) for i in range(30)] + [("m", i) for i in range(3)], "key string, v int")
    got = ed.limited(rows, "key", [F.col("v")], 3)
    assert sorted(map(tuple, got.collect())) == [("k", 0, True), ("k", 1, True), ("k", 2, True), ("m", 0, False), ("m", 1, False), ("m", 2, False)]


def test_tree_limits_are_the_first_trails(spark):
    # Every node has three children up to level 5: 363 trails.
    edges, level = [], ["r"]
    for _ in range(5):
        following = [f"{n}{c}" for n in level for c in "abc"]
        edges += [(n, f"{n}{c}", f"{n}{c}", None) for n in level for c in "abc"]
        level = following
    owns = spark.createDataFrame(edges, "from_id string, to_id string, edge_id string, direct_or_indirect string")
    roots = spark.createDataFrame([("r",), ("ra",)], "id string")
    every = tr.ownership_tree(owns, roots, 5)
    key = lambda r: (r.root_id, r.depth, ">".join(r.edge_path))
    for most in (1, 7, 40, 120, 400):
        want = {}
        for r in sorted(every.collect(), key=key):
            want.setdefault(r.root_id, []).append(key(r))
        got = tr.ownership_tree(owns, roots, 5, most=most).collect()
        assert sorted(map(key, got)) == sorted(k for x in want.values() for k in x[:most])
        assert {(r.root_id, r.truncated) for r in got} == {(k, len(x) > most) for k, x in want.items()}


def test_scoped_merges_take_sure_groups_and_spare_pairs(spark):
    cols = "id string, name string, name_normalized string, lei_id string, companies_house_id string, sec_cik string, wikidata_id string, registered_address string, country string, founded int, name_credibility int, verified boolean"
    row = lambda i, n, lei=None, at=None, cred=0: (i, n, n, lei, None, None, None, at, None, None, cred, False)
    e = spark.createDataFrame(
        [row("a1", "acme", "L1"), row("a2", "acme", "L1", cred=5), row("a3", "acme", "L1"), row("b1", "beta", at="x"), row("b2", "beta", at="x"), row("c1", "corp"), row("c2", "corp"), row("d1", "dual", "L2"), row("d2", "dual", "L2")], cols
    )
    touched = spark.createDataFrame([("a1",), ("b2",), ("c1",)], "id string")
    plan = rs.scoped_merge_plan(e, touched, spark.createDataFrame([("a2", "a3")], "a string, b string"))
    assert sorted(map(tuple, plan.collect())) == [("a1", "a2", "same_name_definitive"), ("b2", "b1", "same_name_high")]
    assert [r.total for r in rs.merge_report(plan, 1).collect()] == [2]


def test_words_of_any_script_and_substrings(spark):
    names_ = spark.createDataFrame([("1", "Société Générale"), ("2", "Müller 株式会社"), ("3", "Plain Ltd")], "id string, name string")
    assert {r.token for r in se.token_index(names_, "id", "name").collect()} == {"société", "générale", "müller", "株式会社", "plain", "ltd"}
    queries = spark.createDataFrame([("a", "ÉNÉR"), ("b", "ll"), ("c", "n"), ("d", "nothing here"), ("e", "ain l"), ("f", "株式")], "query_id string, q string")
    assert sorted(map(tuple, se.holding(names_, queries).collect())) == [("a", "1"), ("b", "2"), ("c", "1"), ("c", "3"), ("e", "3"), ("f", "2")]


def test_versions_survive_a_crash_and_fold_repeated_keys(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        read_version(spark, root)
    write_version(spark.range(3), root)
    spark.range(9).write.parquet(f"{root}/v-unfinished")  # a writer that died before its version was numbered
    assert read_version(spark, root).count() == 3
    write_version(read_version(spark, root).limit(1), root)
    assert read_version(spark, root).count() == 1
    current = spark.createDataFrame([("a", 1)], "id string, v int")
    delta = spark.createDataFrame([("a", 5), ("a", 7), ("b", 2), ("b", 2)], "id string, v int")
    assert sorted(map(tuple, upsert(current, delta, ["id"]).collect())) == [("a", 7), ("b", 2)]


def test_sources_believe_columns_in_their_own_order(spark):
    kinds = "id string, name string, name_credibility int, lei_id string, country string, aliases array<string>, wikidata_id string"
    stored = spark.createDataFrame([("1", "Register Name", 95, "L1", "US", ["a"], None), ("2", "Weak Name", 10, None, "US", [], None)], kinds)
    new = spark.createDataFrame([("1", "Wiki", 90, "L9", "FR", [], "Q1"), ("2", "Wiki", 90, "L9", None, ["b"], "Q2")], kinds)
    got = {r.id: tuple(r)[1:] for r in upsert(stored, new, ["id"], ENTITY_OF_WIKIDATA).collect()}
    assert got == {"1": ("Register Name", 95, "L1", "FR", ["a"], "Q1"), "2": ("Wiki", 90, "L9", "US", ["b"], "Q2")}
    kinds = "id string, description string, nationality string, alias array<string>"
    stored = spark.createDataFrame([("1", "", "FR", []), ("2", "kept", "", ["x"])], kinds)
    new = spark.createDataFrame([("1", "d", "US", ["y"]), ("2", "d", "US", ["y"])], kinds)
    assert sorted(map(tuple, upsert(stored, new, ["id"], PERSON_OF_WIKIDATA).collect())) == [("1", "d", "FR", ["y"]), ("2", "kept", "US", ["x"])]


def test_import_lock(spark, tmp_path):
    one, two = ImportLock(spark, str(tmp_path)), ImportLock(spark, str(tmp_path))
    start = datetime(2024, 1, 1, tzinfo=UTC)
    assert one.acquire("first", start) == 1
    with pytest.raises(ImportLocked, match="first"):
        two.acquire("second", start + timedelta(hours=5))
    assert two.status(start + timedelta(hours=7))["stale"]
    assert two.acquire("second", start + timedelta(hours=7)) == 2
    one.release()  # lost to the second, so it stays
    assert two.status(start + timedelta(hours=7))["holder"] == "second"
    two.release()
    with one:
        assert one.status()["held"] and one.fence == 3
    assert not one.status()["held"]


@pytest.mark.parametrize("first", [0, 1])
def test_two_that_see_a_stale_lock(spark, tmp_path, first):
    """Both have looked before either takes over: one wins, and the one that was slow to notice cannot write."""
    old, *both = (ImportLock(spark, str(tmp_path)) for _ in range(3))
    store = Store(spark, str(tmp_path / "tables"))
    start = datetime(2024, 1, 1, tzinfo=UTC)
    late = start + timedelta(hours=9)
    rows = spark.range(3)
    store.create({"t": (rows, ["id"], 2)}, fence=old.acquire("old", start))
    winner, loser = both[first], both[1 - first]
    seen = loser.status(late)
    assert winner.acquire("winner", late) == 2
    loser.status = lambda now=None: seen
    with pytest.raises(ImportLocked, match="faster"):
        loser.acquire("loser", late)
    store.commit(store.latest(), {}, fence=winner.fence)
    with pytest.raises(Conflict):
        store.commit(store.latest(), {}, fence=old.fence)


def test_control_register_import(spark):
    schema = registers.PSC_SCHEMA
    records = spark.createDataFrame(
        [('{"company_number":"1","data":{"kind":"individual-person-with-significant-control","name":"Ann Lee","links":{"self":"/a"},"address":{"country":"France"},"natures_of_control":["ownership-of-shares-75-to-100-percent"]}}',),
         ('{"company_number":"1","data":{"kind":"corporate-entity-person-with-significant-control","name":"Cede & Co","links":{"self":"/b"},"address":{"country":"Scotland"}}}',)], "json string",
    ).select(F.from_json("json", schema).alias("r")).select("r.*")
    codes = spark.createDataFrame([("FR", "France")], "code string, name string")
    assert sorted(r.address_country for r in registers.control_rows(records, codes).collect()) == ["FR", "GB"]
    tables = {
        "entity": spark.createDataFrame([], "id string, name string, is_nominee boolean, source_id string"), "person": spark.createDataFrame([], "id string, full_name string"),
        "owns": spark.createDataFrame([], "edge_id string, from_id string, to_id string, stake_percent double, direct_or_indirect string, since string, until string, source_id string"),
        "claim": spark.createDataFrame([], "claim_key string, kind string, from_id string, to_id string, source_id string, stake_percent double, source_url string, last_seen_at string, first_seen_at string"),
    }
    out = import_control(tables, records, "psc", 85, F.lit("2024-01-01"), codes)
    again = import_control(out, records, "psc", 85, F.lit("2024-02-02"), codes)
    for t in (out, again):
        assert [t[n].count() for n in ("entity", "person", "owns", "claim")] == [2, 1, 2, 2]
        assert ids(t["entity"].where("is_nominee")) == ["chpsc:/b"]
    assert {(r.first_seen_at, r.last_seen_at) for r in again["claim"].collect()} == {("2024-01-01", "2024-02-02")}


def test_entities_take_whole_records(spark):
    rows = spark.createDataFrame([("x", None, "B", None), ("x", "Beta", "US", "far"), ("x", "Acme", None, "near")], "id string, name string, country string, place string")
    assert [tuple(r) for r in registers._first_record(rows).collect()] == [("x", "Acme", "US", "near")]


def test_company_look_ups_in_order(spark):
    s = "q string, cik string, name string, form_rank int"
    queries = spark.createDataFrame([("Apple",), ("Beta Corp",), ("Gamma",), ("Nobody",)], "q string")
    tickers = spark.createDataFrame([(7, "Apple Inc.")], "cik_str long, title string")
    registered = spark.createDataFrame([("Apple", "8", "Apple Other", 0), ("Beta Corp", "9", "Beta Corp Holdings", 0), ("Beta Corp", "10", "Beta Corp", 0), ("Beta Corp", "11", "Beta Corp", 1)], s)
    hits = spark.createDataFrame([("Gamma", "12", "Gamma", 1), ("Gamma", "13", "Something Else", 0), ("Nobody", "14", "Quite Different", 0)], s)
    got = {r.q: (r.cik, r.stage) for r in filings.find_companies(queries, tickers, registered, hits).collect()}
    assert got == {"Apple": ("0000000007", 1), "Beta Corp": ("0000000010", 2), "Gamma": ("0000000012", 3)}


def test_ownership_tables_of_real_shapes():
    t = lambda *rows: "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
    head = ("Name of Beneficial Owner", "Shares", "Percent of class")
    plain = t(head, ("Ann Lee", "100,500", "5.1%"), ("Bob May (1)", "200,000 (2)", "*"))
    assert filings.owner_rows(plain) == [("Ann Lee", "100,500", "5.1%"), ("Bob May (1)", "200,000 (2)", "*")]
    assert filings.owner_rows(f"<table><tr><td>x{plain}</td></tr><tr><td>y</td></tr></table>") == filings.owner_rows(plain)
    padded = t(("", *head), ("", "Ann Lee", "100,000", "5.1%"), ("", "20,000", "7.2%"), ("​", "Bob May", "300,000", "7.2"))
    assert filings.owner_rows(padded) == [("Ann Lee", "100,000", "5.1%"), ("Bob May", "300,000", "7.2")]
    assert filings.owner_rows(t(head, ("Ann Lee", "100,500", "5.1%"))) == [] and filings.owner_rows(None) == [] and filings.owner_rows("<td>loose") == []


def test_ticker_prefixes_inside_words(spark):
    tickers = spark.createDataFrame([(1, "The Acme Company"), (2, "The Acme"), (3, "The Zeta")], "cik_str long, title string")
    got = filings.match_tickers(spark.createDataFrame([("The Acm",), ("The Acme",), ("The Q",)], "q string"), tickers)
    assert {r.q: r.cik[-1] for r in got.collect()} == {"The Acm": "2", "The Acme": "2"}


def test_countries_stay_unless_known(spark):
    codes = spark.createDataFrame([("FR", "France")], "code string, name string")
    e = spark.createDataFrame([("1", "france"), ("2", "fr"), ("3", "zz"), ("4", "USA"), ("5", None)], "id string, country string")
    assert {r.id: r.country for r in mt.normalize_countries(e, codes).collect()} == {"1": "FR", "2": "FR", "3": "zz", "4": "US", "5": None}
    assert mt.without_meta(e.withColumn("@rid", F.lit("#1:1"))).columns == ["id", "country"]


def test_moderation_writes(spark):
    flags = spark.createDataFrame([("f1", "open", "n1", None, None, None), ("f2", "open", None, "a", "b", "CEO")], "id string, status string, node_id string, from_id string, to_id string, role string")
    assert ids(flags.where(mo.target_is("n1"))) == ["f1"] and ids(flags.where(mo.target_is(from_id="a", to_id="b", role="CEO"))) == ["f2"]
    assert ids(flags.where(mo.target_is(from_id="a", to_id="b"))) == ["f2"]
    new = mo.create_flag(flags.withColumn("note", F.lit("")), spark.createDataFrame([("f3", "open", "x" * 2000)], "id string, status string, note string"))
    assert new.count() == 3 and new.agg(F.max(F.length("note"))).first()[0] == mo.NOTE_LENGTH
    assert ids(mo.set_flag_status(flags, ["f1"], "resolved").where("status = 'resolved'")) == ["f1"] and ids(mo.delete_flags(flags, ["f1"])) == ["f2"]
    assert ids(mo.remove_suppressions(flags, ["f2"])) == ["f1"] and ids(mo.remove_pins(flags, ["f1"])) == ["f2"]
    runs = spark.createDataFrame([(str(i), f"2024-01-{i + 1:02}") for i in range(9)], "id string, started_at string")
    assert ids(mo.prune_runs(runs, 2)) == ["7", "8"]


def test_person_review_and_merge(spark):
    p = spark.createDataFrame(
        [("1", "Ann Lee", ["Annie Lee"], None), ("2", "Lee Ann", None, None), ("3", "Annie Lee", None, "Q1"), ("4", "Other", None, "Q1"), ("5", "Nobody", None, None)],
        "id string, full_name string, alias array<string>, wikidata_id string",
    )
    assert ids(pe.candidate_persons(p, spark.createDataFrame([("1",)], "id string"))) == ["1", "3"]
    assert ids(pe.candidate_persons(p, spark.createDataFrame([("3",)], "id string"))) == ["3", "4"]
    assert [tuple(r) for r in pe.reversed_name_pairs(p).collect()] == [("2", "1")]
    groups = spark.createDataFrame([(["b"], "low", "x"), (["a"], "high", "y"), (["c"], "medium", "x")], "members array<string>, confidence string, reason string")
    assert [r.confidence for r in pe.review_order(groups).collect()] == ["high", "medium", "low"]
    plan = spark.createDataFrame([("2", "1")], "dup_id string, keep_id string")
    owns = spark.createDataFrame([("e1", "1", "x", None, "u"), ("e2", "2", "x", 5.0, "v"), ("e3", "2", "y", 7.0, None)], "edge_id string, from_id string, to_id string, stake_percent double, since string")
    assert sorted(map(tuple, pe.fold_owns(owns, plan).collect())) == [("e1", "1", "x", 5.0, "u"), ("e3", "1", "y", 7.0, None)]
    rel = spark.createDataFrame([("r1", "1", "9", None), ("r2", "2", "9", "spouse"), ("r3", "9", "2", "child"), ("r4", "1", "2", "self")], "edge_id string, from_id string, to_id string, relation string")
    assert sorted(map(tuple, pe.fold_relations(rel, plan).collect())) == [("r1", "1", "9", "spouse"), ("r3", "9", "1", "child")]
    pairs = spark.createDataFrame([("person", "1", "2", "t")], "kind string, a string, b string, at string")
    undone = spark.createDataFrame([("person", "2", "1")], "kind string, a string, b string")
    assert rs.undo_keep_separate(pairs, undone).isEmpty()


def test_claims_of_edges(spark):
    edges = spark.createDataFrame([("a", "b", "s", 5.0), ("a", "c", None, 1.0)], "from_id string, to_id string, source_id string, stake_percent double")
    (row,) = cl.claim_rows(edges, "owns", F.lit("2024")).collect()
    assert (row.kind, row.to_id, row.stake_percent, row.credibility_score, row.last_seen_at) == ("owns", "b", 5.0, cl.DEFAULT_CREDIBILITY, "2024")


def test_filing_helpers(spark):
    arrays = "cik string, form array<string>, accessionNumber array<string>, filingDate array<string>"
    recent = spark.createDataFrame([("1", ["SC 13D", "10-K"], ["a", "b"], ["2024-01-01", "2024-01-02"])], arrays)
    archives = spark.createDataFrame([("1", ["SC 13G"], ["c"], ["2020-01-01"], 4), ("1", ["SC 13G"], ["d"], ["2019-01-01"], 5)], arrays + ", page int")
    assert [r.accession for r in filings.holding_pages(recent, archives).collect()] == ["a", "c"]
    former = spark.createDataFrame([("1", ["Acme", "ACME", "Beta"])], "cik string, former array<string>")
    assert filings.former_names(former).first().names == ["Acme", "Beta"]
    xml = "<o><issuer><issuerCik>7</issuerCik></issuer><rptOwnerName>Lee Ann {}</rptOwnerName><sharesOwnedFollowingTransaction><value>{}</value></sharesOwnedFollowingTransaction></o>"
    rows = [("4", "2024-01-01", f"a{i}", xml.format(chr(65 + i), 10 * i)) for i in range(3)]
    got = filings.insider_holding(spark.createDataFrame(rows, "form string, filed string, accession string, xml string"), spark.createDataFrame([("0000000007",)], "issuer_cik string"))
    assert sorted(r.shares for r in got.collect()) == [10.0, 20.0]


def test_small_functions(spark):
    row = spark.range(1).select(
        names.opencorporates_url(F.lit("gb"), F.lit("1")).alias("u"), hashing.token_hash(F.lit("x")).alias("h"),
        dates.scrape_is_due(F.lit("stale")).alias("due"), dates.scrape_is_due(F.lit("fresh")).alias("not_due"),
        dates.lock_is_stale(F.lit("2024-01-01 00:00:00"), F.lit("2024-01-01 07:00:00")).alias("stale"),
        dates.relationship_dates(F.from_json(F.lit('[{"StartDate":{"$":"2020-01-02T00"},"PeriodType":{"$":"RELATIONSHIP_PERIOD"}}]'),
            "array<struct<StartDate:struct<`$`:string>,EndDate:struct<`$`:string>,PeriodType:struct<`$`:string>>>")).alias("d"),
    ).first()
    assert row.u == "https://opencorporates.com/companies/gb/1" and len(row.h) == 64 and row.due and not row.not_due and row.stale and tuple(row.d) == ("2020-01-02", None)


def test_person_search(spark):
    persons = spark.createDataFrame([("1", "Ann Lee"), ("2", "Bob May")], "id string, name string")
    queries = spark.createDataFrame([("a", "ann", None), ("b", "bob", "US")], "query_id string, q string, country string")
    assert [(r.query_id, r.id) for r in se.person_candidates(persons, se.token_index(persons, "id", "name"), queries).collect()] == [("a", "1")]


def test_upserted_edges_are_made_once(spark, tmp_path):
    from stakeweave.plans.store_queries import stored_upserts

    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    spark.range(3).selectExpr("id AS s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    edges = spark.createDataFrame([(f"e{i}", "a", "b", 50.0 + i, "2020") for i in range(30)], "edge_id string, from_id string, to_id string, stake_percent double, since string")
    out = stored_upserts(lambda name: edges.mapInArrow(seen, edges.schema), spark, str(tmp_path))
    assert out.where("edge_id LIKE 'e%' AND stake_percent = 60 AND since = '2030-01-01'").count() == 19 and made.value == 30


def test_profiles_compute_shown_ownership_once(spark, tmp_path):
    from stakeweave.operators.profile import entity_profiles

    edges = [("e1", "a", "b", 10.0, None), ("e2", "a", "b", 30.0, None), ("e3", "b", "a", None, None), ("e4", "c", "b", 5.0, None), ("e5", "d", "b", 5.0, "2020-01-01")]
    spark.createDataFrame([(*e[:4], None, "2019-01-01", e[4]) for e in edges], "edge_id string, from_id string, to_id string, stake_percent double, direct_or_indirect string, since string, until string").write.parquet(str(tmp_path / "owns"))
    entities = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "id string, name string")
    none = lambda schema: spark.createDataFrame([], schema)
    pairs, hidden = none("from_id string, to_id string, since string"), none("target_kind string, from_id string, to_id string, role string, node_id string")
    roles, pins = none("edge_id string, from_id string, to_id string, role string, since string, until string"), none("from_id string, to_id string, stake_percent double, ownership_type string")
    found = entity_profiles(entities, spark.read.parquet(str(tmp_path / "owns")), roles, pairs, pairs, hidden, pins, most=1)
    found = found.select("id", "ownership.disclosed_pct", "owners", "subsidiaries", "cross_holdings")
    ids = lambda items: [x.id for x in items or []]
    assert {r.id: (r.disclosed_pct, ids(r.owners), ids(r.subsidiaries), ids(r.cross_holdings)) for r in found.collect()} == {
        "a": (None, ["b"], ["b"], ["b"]), "b": (35.0, ["a"], ["a"], ["a"]), "c": (None, [], ["b"], []),
    }
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [edge_id") == 0
