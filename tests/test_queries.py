import os

import duckdb
import pytest

import __spark_entry__ as entry
from stakeweave import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in entry.oracle_sql() if not (n.startswith("op") and n[2:3].isdigit()) and n != "pipeline")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    return round(float(value), 6) if isinstance(value, int | float) else str(value)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_oracle(spark, duck, name):
    frame = entry.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    result = duck.execute(entry.oracle_sql()[name])
    order = [c[0] for c in result.description]
    assert sorted(order) == columns
    key = lambda row: tuple((x is None, str(x)) for x in row)
    want = sorted((tuple(plain(r[order.index(c)]) for c in columns) for r in result.fetchall()), key=key)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=key) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("parts", [1, 7])
def test_input_order_does_not_matter(spark, tmp_path, parts):
    for t in TABLES[:8]:
        spark.read.parquet(f"{DATA}/{t}.parquet").repartition(parts).write.parquet(str(tmp_path / f"{t}.parquet"))
    for name in ("ownership_summary", "owns_dedup", "best_claim", "person_positions", "lei_merge_plan", "flag_groups"):
        f = entry.queries()[name]
        assert sorted(map(str, f(spark, str(tmp_path)).collect())) == sorted(map(str, f(spark, DATA).collect())), name


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_stream_limits_attempts(spark):
    rows = entry.queries()["streamed_lockouts"](spark, DATA)
    assert rows.where("allowed").count() > 0 and rows.count() == spark.read.parquet(f"{DATA}/events.parquet").count()


def test_sources_fail_alone(spark):
    def broken(*_):
        raise ValueError("no")

    registry.register(registry.Source("a", lambda s, t: s.range(1)))
    registry.register(registry.Source("b", broken))
    registry.register(registry.Source("c", lambda s, t: s.range(2), depth_aware=True))
    registry.register(registry.Source("d", lambda s, t: s.range(2), enabled=False))
    done, failed = registry.run_all(spark, "x")
    assert sorted(done) == ["a", "c"] and failed == {"b": "no"} and sorted(registry.run_all(spark, "x", deepening=True)[0]) == ["c"]
