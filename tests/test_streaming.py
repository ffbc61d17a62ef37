import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stakeweave.operators.store import Conflict, Files, Store
from stakeweave.sources import gleif
from stakeweave.streaming.deltas import _KEY as KEY
from stakeweave.streaming.deltas import apply_delta, catch_up, fold_delta, in_file_order, stream_deltas, stream_publications
from stakeweave.streaming.limits import LOCKOUTS, decide, rate_limit
from tests.test_sources import PERIOD, relation, w


def edges(spark, rows):
    e = gleif.owns_edges(spark.createDataFrame([], gleif.RR_SCHEMA), "g", 92)
    return spark.createDataFrame([{"edge_id": f"e{i}", **r} for i, r in enumerate(rows)], e.schema) if rows else e


def test_create_close_reopen_replay(spark):
    def delta(*records):
        frame = spark.read.schema(gleif.RR_SCHEMA).json(spark.sparkContext.parallelize([json.dumps(r) for r in records]))
        return gleif.delta_edges(frame, "g", 92, F.lit("2025-06-01"))

    table = edges(spark, [])
    made = apply_delta(table, *delta(relation("C", "P", periods=PERIOD | {"EndDate": None})))
    assert made.first().until is None and made.first().since == "2020-01-02"
    closed = apply_delta(made, *delta(relation("C", "P", status="INACTIVE")))
    assert closed.first().until == "2025-06-01" and closed.count() == 1
    again = apply_delta(closed, *delta(relation("C", "P", status="INACTIVE")))
    assert sorted(map(str, again.collect())) == sorted(map(str, closed.collect()))
    opened = apply_delta(closed, *delta(relation("C", "P")))
    assert opened.first().until is None and opened.first().since == "2020-01-02"


def folders(store, name="owns"):
    return dict(store.latest().tables[name].paths)


def test_stream_applies_each_file_once(spark, tmp_path):
    store, landing = Store(spark, str(tmp_path / "t")), tmp_path / "in"
    landing.mkdir()
    store.create({"owns": (edges(spark, []), KEY, 8)})
    stream = lambda: stream_deltas(spark, str(landing), store, "owns", str(tmp_path / "ck"), "g", today="2025-06-01").awaitTermination()
    for k, records in enumerate(([relation("C", "P"), relation("D", "P")], [relation("C", "P", status="INACTIVE")])):
        (landing / f"{k}.json").write_text("\n".join(map(json.dumps, records)))
        stream()
    got = {r.to_id: r.until for r in store.read("owns").collect()}
    assert got == {"lei:C": "2025-06-01", "lei:D": None}
    number = store.latest().number
    stream()
    assert store.latest().number == number
    # A replayed batch (its checkpoint was lost after the version had been written) finds itself applied.
    for f in (tmp_path / "ck" / "commits").glob("*1"):
        f.unlink()
    for f in (tmp_path / "ck" / "commits").glob(".*1.crc"):
        f.unlink()
    stream()
    assert store.latest().number == number


def test_the_last_record_of_a_file_counts(spark, tmp_path):
    first, last = relation("C", "P", periods=PERIOD | {"StartDate": w("2021-01-01")}), relation("C", "P", periods=PERIOD | {"StartDate": w("2019-01-01")})
    for k, order in enumerate(([first, last], [last, first])):
        (tmp_path / f"{k}.json").write_text("\n".join(map(json.dumps, order)))
        records = in_file_order(spark.read.schema(gleif.RR_SCHEMA).json(str(tmp_path / f"{k}.json")))
        up, shut = gleif.delta_edges(records, "g", 92, F.lit("2025-06-01"))
        assert apply_delta(edges(spark, []), up, shut, "_sequence").first().since == ["2019-01-01", "2021-01-01"][k]


def test_a_small_batch_writes_few_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    base = spark.range(5000).select(F.concat(F.lit("e"), "id").alias("edge_id"), F.concat(F.lit("a"), "id").alias("from_id"), F.lit("b").alias("to_id"), F.lit("direct").alias("direct_or_indirect"),
                                    F.lit(None).cast("string").alias("since"), F.lit(None).cast("string").alias("until"))
    store.create({"owns": (base, KEY, 64)})
    before = folders(store)
    assert len(before) == 64 and store.read("owns").count() == 5000
    up = base.where("from_id IN ('a1', 'a2', 'a3', 'a4')").withColumn("since", F.lit("2020-01-01")).unionByName(base.limit(1).withColumn("from_id", F.lit("new")))
    shut = base.where("from_id IN ('a7', 'a8', 'a9')").select(*KEY).withColumn("until", F.lit("2025-01-01"))
    fold_delta(store, "owns", up, shut)
    after = folders(store)
    changed = {b for b in after if after[b] != before[b]}
    assert len(changed) <= 8 and set(after) == set(before)
    want = apply_delta(base, up, shut)
    assert sorted(map(str, store.read("owns").collect())) == sorted(map(str, want.collect()))
    # A lookup opens the files of its keys' buckets only.
    some = store.lookup("owns", base.where("from_id IN ('a1', 'a7')").select(*KEY))
    assert sorted(r.from_id for r in some.collect()) == ["a1", "a7"] and len(some.inputFiles()) <= 2
    # The version before is still there, and a table may be dealt again.
    assert sorted(map(str, store.read("owns", store.version(1)).collect())) == sorted(map(str, base.collect()))
    store.rebucket("owns", 8)
    assert len(folders(store)) == 8 and sorted(map(str, store.read("owns").collect())) == sorted(map(str, want.collect()))
    assert store.vacuum(keep=1, least_age=3600) == []
    assert len(store.vacuum(keep=1, least_age=0)) == 2 and store.read("owns").count() == 5001
    with pytest.raises(Exception):
        store.version(1)


def test_tables_change_together_or_not_at_all(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "t"))
    a, b = (spark.createDataFrame([(i, "old") for i in range(20)], f"{k} long, v string") for k in "ab")
    store.create({"a": (a, ["a"], 4), "b": (b, ["b"], 4)}, {"x": "1"})
    new = lambda k: (spark.createDataFrame([(3, "new")], f"{k} long, v string"), lambda old, d: old.join(d.select(k), k, "left_anti").unionByName(d))
    seen = lambda: [sorted(r.v for r in store.read(t).where("v = 'new'").collect()) for t in "ab"]
    writes = []

    def crash(at):
        def write(self, *args):
            writes.append(1)
            if len(writes) == at:
                raise RuntimeError("lost")
            return plain(self, *args)

        return write

    plain = Store.write
    for at in (1, 2):
        writes.clear()
        monkeypatch.setattr(Store, "write", crash(at))
        with pytest.raises(RuntimeError):
            store.change({"a": new("a"), "b": new("b")})
        monkeypatch.setattr(Store, "write", plain)
        assert seen() == [[], []] and store.latest().number == 1
    put = Files.put_new
    monkeypatch.setattr(Files, "put_new", lambda *x: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.change({"a": new("a"), "b": new("b")})
    monkeypatch.setattr(Files, "put_new", put)
    assert seen() == [[], []]
    base = store.latest()
    done = store.change({"a": new("a"), "b": new("b")}, {"y": "2"}, fence=5)
    assert seen() == [["new"], ["new"]] and done.tags == {"x": "1", "y": "2"}
    with pytest.raises(Conflict):  # from a version that another has followed
        store.change({"a": new("a")}, base=base)
    with pytest.raises(Conflict):  # by a writer whose lock was taken over
        store.change({"a": new("a")}, fence=4)


def test_catching_up_over_gaps(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))

    def announce(day, files):
        rows = []
        for window, records in files.items():
            path = tmp_path / f"{day}-{window}.json"
            if records is not None:
                path.write_text("\n".join(map(json.dumps, records)))
            rows.append((f"2025-{day} 08:00:00", window, str(path)))
        return spark.createDataFrame(rows, "published string, window string, path string")

    step = lambda day, files: catch_up(store, "owns", announce(day, files), "gleif", "g", today="2025-06-01")
    assert step("03-01", {"LastMonth": [relation("A", "P")]})["status"] == "reload"  # never loaded in full
    store.create({"owns": (edges(spark, []), KEY, 8)})
    assert step("03-01", {"LastDay": [], "LastMonth": [relation("A", "P")]})["window"] == "LastMonth"  # nothing seen so far
    assert step("03-02", {"LastDay": [relation("B", "P")], "LastWeek": [relation("X", "P")]}) == {"status": "applied", "window": "LastDay", "published": "2025-03-02 08:00:00"}
    assert step("03-01", {"LastDay": [relation("Y", "P")]})["status"] == "old"  # late
    assert step("03-02", {"LastDay": [relation("Y", "P")]})["status"] == "old"  # again
    assert step("03-05", {"LastDay": [relation("Y", "P")], "LastWeek": [relation("C", "P")]})["window"] == "LastWeek"  # three days were missed
    assert step("03-06", {"LastDay": None, "LastMonth": [relation("D", "P")]})["window"] == "LastMonth"  # the file that would do is missing
    assert step("05-20", {"LastMonth": [relation("Z", "P")]}) == {"status": "reload", "published": "2025-03-06 08:00:00"}
    assert store.latest().tags["reload:gleif"] == "2025-05-20 08:00:00"
    assert sorted(r.to_id for r in store.read("owns").collect()) == ["lei:A", "lei:B", "lei:C", "lei:D"]
    landing = tmp_path / "in"
    landing.mkdir()
    for k, day in enumerate(("03-08", "03-07")):  # announcements out of order, in one batch each
        announce(day, {"LastDay": [relation(f"E{k}", "P")], "LastWeek": [relation("F", "P"), relation("C", "P", status="INACTIVE")]}).write.mode("append").json(str(landing / "x"))
        stream_publications(spark, str(landing / "x"), store, "owns", str(tmp_path / "ck"), "gleif", "g", today="2025-06-01").awaitTermination()
    got = {r.to_id: r.until for r in store.read("owns").collect()}
    assert got == {"lei:A": None, "lei:B": None, "lei:C": "2025-06-01", "lei:D": None, "lei:F": None} and store.latest().tags["published:gleif"] == "2025-03-08 08:00:00"


def test_lockouts_escalate():
    stamps, until, count, now, seen = [], 0.0, 0, 0.0, []
    for _ in range(5):
        while True:
            ok, stamps, until, count = decide(stamps, until, count, now, 2, 3600)
            now += 1
            if not ok:
                break
        seen.append(until - (now - 1))
        now = until
    assert seen == [*map(float, LOCKOUTS), float(LOCKOUTS[-1])]


def test_rate_limit_stream(spark, tmp_path):
    pd.DataFrame({"key": ["a", "a", "a", "b"], "ts": [0.0, 10.0, 20.0, 5.0]}).to_parquet(tmp_path / "x.parquet")
    stream = spark.readStream.schema("key string, ts double").parquet(str(tmp_path))
    q = rate_limit(stream, 2).writeStream.format("memory").queryName("limits").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("limits").collect())) == [("a", 0.0, True), ("a", 10.0, True), ("a", 20.0, False), ("b", 5.0, True)]
