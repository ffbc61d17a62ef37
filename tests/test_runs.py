import json

import pytest
from pyspark.sql import functions as F

from stakeweave.operators import claims, maintenance, resolution, runs
from stakeweave.operators.store import Store
from stakeweave.sources import gleif, registers
from tests.test_graph import ENTITY
from tests.test_sources import PERIOD, relation, w

PERSON = "id string, full_name string, first_name string, last_name string, birth_date string, nationality string"
OWNS = "edge_id string, from_id string, to_id string, stake_percent double, direct_or_indirect string, since string, until string, source_id string, credibility_score int"
CLAIM = "claim_key string, kind string, from_id string, to_id string, source_id string, stake_percent double, source_url string, source_date string, credibility_score int, last_seen_at string, first_seen_at string"
TABLES = {"entity": ENTITY + ", is_nominee boolean, hq_city string", "person": PERSON, "owns": OWNS, "claim": CLAIM}


def graph(spark, path, **rows):
    store = Store(spark, str(path))
    runs.create_graph(store, {k: spark.createDataFrame(rows.get(k, []), s) for k, s in TABLES.items()}, 8)
    return store


def contents(store, version=None):
    return {t: sorted(map(str, store.read(t, version).collect())) for t in (*TABLES, "merged_id", "merge_log")}


def parsed(spark, rows, schema):
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", schema).alias("r")).select("r.*")


def lei(code, name, number=None, **more):
    registered = {"RegistrationAuthorityID": w("RA000585"), "RegistrationAuthorityEntityID": w(number)} if number else {}
    return {"LEI": w(code), "Entity": {"LegalName": w(name), "EntityStatus": w("ACTIVE"), "LegalAddress": {"Country": w("GB")}, "RegistrationAuthority": registered, **more}}


def control(number, name, link, kind="individual", **more):
    return {"company_number": number, "data": {"kind": f"{kind}-person-with-significant-control", "name": name, "links": {"self": link}, "notified_on": "2020-01-02", "natures_of_control": ["ownership-of-shares-75-to-100-percent"], **more}}


def test_runs_merge_what_they_touch_and_repeat_themselves(spark, tmp_path):
    store = graph(spark, tmp_path / "g")
    none = spark.createDataFrame([], "code string, name string")
    entities = parsed(spark, [lei("X1", "Acme Holdings Ltd", "0001"), lei("X2", "Other plc", "0002"), lei("X3", "Cede & Co")], gleif.LEI_SCHEMA)
    psc = [control("0001", "Ann Lee", "/a"), control("0003", "Acme Holdings", "/b", "corporate-entity", identification={"registration_number": "0001", "country_registered": "England"})]
    csv = spark.createDataFrame([("0003", "Third Company Limited", "03/02/1999", "LEEDS"), ("0009", "Never seen", None, None)], "CompanyNumber string, CompanyName string, IncorporationDate string, RegAddress_PostTown string")
    holdings = spark.createDataFrame([("0000000007", "0000000008", "Filed Corp", 12.5, "2024-01-01", None)], "cik string, issuer_cik string, issuer string, stake_percent double, since string, until string")
    sources = {
        "legal": lambda: runs.said_by_legal_entities(entities, "g", 92, none, none),
        "control": lambda: runs.said_by_control(parsed(spark, psc, registers.PSC_SCHEMA), "p", 85),
        "relations": lambda: runs.said_by_relationships(parsed(spark, [relation("X2", "X1", periods=PERIOD)], gleif.RR_SCHEMA), "g", 92),
        "companies": lambda: runs.said_by_companies(csv, 90),
        "holdings": lambda: runs.said_by_holdings(holdings, store.read("entity"), "s", 70),
    }
    merges = {}
    for name, said in sources.items():
        merges[name] = runs.run_import(store, said(), "2024-01-01")["merges"]
    assert merges == {"legal": 0, "control": 1, "relations": 0, "companies": 0, "holdings": 0}
    e = {r.id: r for r in store.read("entity").collect()}
    # The company of the register and the legal entity share a number: the more credible one stays.
    assert set(e) == {"lei:X1", "lei:X2", "lei:X3", "gb-coh:0003", "sec:0000000007", "sec:0000000008"}
    assert e["gb-coh:0003"].name == "Third Company Limited" and e["gb-coh:0003"].founded == 1999 and e["lei:X3"].is_nominee and e["lei:X1"].companies_house_id == "0001"
    assert {(r.from_id, r.to_id) for r in store.read("owns").collect()} == {("chpsc:/a", "lei:X1"), ("lei:X1", "gb-coh:0003"), ("lei:X1", "lei:X2"), ("sec:0000000007", "sec:0000000008")} or {
        (r.from_id, r.to_id) for r in store.read("owns").collect()} == {("chpsc:/a", "lei:X1"), ("lei:X1", "gb-coh:0003"), ("lei:X2", "lei:X1"), ("sec:0000000007", "sec:0000000008")}
    assert {(r.from_id, r.to_id) for r in store.read("claim").collect()} == {(r.from_id, r.to_id) for r in store.read("owns").collect()}
    assert [(r.old_id, r.new_id) for r in store.read("merged_id").collect()] == [("gb-coh:0001", "lei:X1")] and store.read("merge_log").first()["count"] == 1
    before = contents(store)
    for name, said in sources.items():
        assert runs.run_import(store, said(), "2024-01-01")["merges"] == 0, name
        assert contents(store) == before, name
    later = runs.run_import(store, sources["control"](), "2024-02-02")
    assert later["merges"] == 0 and {r.id for r in later["touched"].collect()} >= {"lei:X1", "gb-coh:0003"}
    seen = {r.from_id: (r.first_seen_at, r.last_seen_at) for r in store.read("claim").collect()}
    assert seen["chpsc:/a"] == ("2024-01-01", "2024-02-02") and seen["sec:0000000007"] == ("2024-01-01", "2024-01-01")


def rows_to_merge(spark, tmp_path):
    named = lambda i, **k: tuple(({c.split()[0]: None for c in TABLES["entity"].split(", ")} | {"id": i, "name": f"N {i}", "name_normalized": f"n {i}", "aliases": []} | k).values())
    entity = [named(f"e{i}", founded=i if i % 2 else None, country="DE" if i < 3 else None) for i in range(12)]
    owns = [(f"x{i}", f"e{i % 12}", f"e{(i * 5 + 1) % 12}", float(i), None, None, None if i % 4 else "2020-01-01", "s", 80) for i in range(60)]
    claim = [(None, "owns", o[1], o[2], "s", o[3], f"u{i}", None, 80, "2024-01-01", "2023-01-01") for i, o in enumerate(owns)]
    keyed = {tuple(r)[0]: tuple(r) for r in claims.with_claim_key(spark.createDataFrame(claim, CLAIM)).select(*[c.split()[0] for c in CLAIM.split(", ")]).collect()}
    first = {}
    for o in owns:  # one active edge for each pair
        first.setdefault((o[1], o[2], o[6] is None), o)
    store = graph(spark, tmp_path / "g", entity=entity, owns=list(first.values()), claim=list(keyed.values()))
    old = spark.createDataFrame([("z1", "e1"), ("z2", "e9")], "old_id string, new_id string")
    store.change({"merged_id": (old, lambda stored, delta: stored.unionByName(delta))})
    plan = spark.createDataFrame([("e1", "e2"), ("e3", "e2"), ("e7", "e8"), ("e8", "e0"), ("gone", "e5")], "dup_id string, keep_id string")
    return store, plan


def test_merges_equal_those_of_whole_tables(spark, tmp_path):
    store, plan = rows_to_merge(spark, tmp_path)
    base = store.latest()
    runs.apply_merges(store, plan, F.lit("2024-05-05"))
    real = resolution.collapse_plan(plan.where("dup_id <> 'gone'").withColumn("reason", F.lit("x"))).select("dup_id", "keep_id")
    text = lambda rows: sorted(map(str, rows.collect()))
    old = {t: store.read(t, base) for t in (*TABLES, "merged_id")}
    ids = ["e1", "e2", "e3", "e7", "e8", "e0"]
    some = old["entity"].where(F.col("id").isin(ids))
    want = resolution.merge_entities(some, real).unionByName(old["entity"].where(~F.col("id").isin(ids)))
    assert text(store.read("entity")) == text(want) and store.read("entity").count() == 8
    owns = runs._tidy(resolution.rewrite_endpoints(old["owns"], real, ("from_id", "to_id")))
    assert text(store.read("owns")) == text(owns.select(*old["owns"].columns))
    assert maintenance.housekeeping(store.read("entity").drop("is_nominee").withColumn("is_nominee", F.lit(False)), store.read("owns"))[1].count() == store.read("owns").count()
    ends = {i for t in ("owns", "claim") for r in store.read(t).collect() for i in (r.from_id, r.to_id)}
    assert ends.isdisjoint({"e1", "e3", "e7", "e8"})
    assert dict(map(tuple, store.read("merged_id").collect())) == {"z1": "e2", "z2": "e9", "e1": "e2", "e3": "e2", "e7": "e0", "e8": "e0"}
    assert store.read("merge_log").count() == 4
    again = store.latest()
    assert runs.apply_merges(store, plan, F.lit("2024-06-06")).number == again.number  # nothing is left to merge


@pytest.mark.parametrize("at", [1, 2, 3, 4, 5, 6])
def test_a_merge_that_breaks_off_leaves_the_graph_as_it_was(spark, tmp_path, monkeypatch, at):
    store, plan = rows_to_merge(spark, tmp_path)
    before, number, writes = contents(store), store.latest().number, []
    plain = Store.write, Store.commit

    def lost(method):
        def run(self, *args, **options):
            writes.append(1)
            if len(writes) == at:
                raise RuntimeError("lost")
            return method(self, *args, **options)

        return run

    monkeypatch.setattr(Store, "write", lost(plain[0]))
    monkeypatch.setattr(Store, "commit", lost(plain[1]))
    with pytest.raises(RuntimeError):
        runs.apply_merges(store, plan, F.lit("2024-05-05"))
    assert store.latest().number == number and contents(store) == before


def test_merges_find_their_edges_by_one_reading_of_ends_and_one_of_rows(spark, tmp_path, monkeypatch):
    owns = [("e1", "d", "x", 5.0, None, None, None, "s", 1), ("e2", "k", "x", 7.0, None, None, None, "s", 1), ("e3", "d", "k", 1.0, None, None, None, "s", 1), ("e4", "z", "d", 2.0, None, None, "2020", "s", 1),
            ("e6", "z", "x", 4.0, None, None, None, "s", 1), ("e7", "z", "x", 4.0, None, None, None, "s", 1), ("e8", "d", "y", 9.0, None, None, None, "s", 1)]
    nodes = [tuple((i, i.upper(), *[None] * (len(ENTITY.split(", ")) - 2), None, None)) for i in "dkxyz"]
    store = graph(spark, tmp_path / "g", owns=owns, entity=nodes)
    reads, read = [], Store.read
    monkeypatch.setattr(Store, "read", lambda self, name, *more, **named: reads.append(name) or read(self, name, *more, **named))
    runs.apply_merges(store, spark.createDataFrame([("d", "k")], "dup_id string, keep_id string"), F.lit("2024-01-01"))
    assert reads.count("owns") == 2
    assert sorted((r.edge_id, r.from_id, r.to_id) for r in read(store, "owns").collect()) == [
        ("e2", "k", "x"), ("e4", "z", "k"), ("e6", "z", "x"), ("e7", "z", "x"), ("e8", "k", "y")
    ]
