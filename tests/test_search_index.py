import random

import pytest
from pyspark.sql import functions as F

from stakeweave.operators import search
from stakeweave.operators import search_index as si
from stakeweave.operators.search_index import SearchIndex
from stakeweave.operators.store import Store

WORDS = [f"w{i}" for i in range(300)] + ["straße", "日本", "common"]


def texts(draw, ids):
    return [(i, None if draw.random() < 0.05 else "common " + " ".join(draw.choice(WORDS) for _ in range(draw.randrange(0, 9)))) for i in ids]


def test_segments_and_merges_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(si, "BLOCK_IDS", 20)
    draw = random.Random(5)
    held = dict(texts(draw, [f"n{i}" for i in range(400)]))
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "id string, text string")
    queries = spark.createDataFrame([(1, "w1 w2 common"), (2, "Straße 日本"), (3, "nothing here"), (4, "")], "query_id int, q string")
    index = SearchIndex(Store(spark, str(tmp_path / "s")), buckets=32)
    index.build(frame(held))
    longest = index.store.read("words-1").agg(F.max(F.size("ids"))).first()[0]
    assert 20 <= longest < 60  # a word that all rows have lies in many blocks

    def same():
        want = sorted(map(tuple, search.token_index(frame(held), "id", "text").select("token", "id").collect()))
        assert sorted(map(tuple, index.words().collect())) == want
        hits = lambda words: sorted(map(tuple, search.match_any(words, queries, "id").collect()))
        assert hits(index.words_of(queries)) == hits(search.token_index(frame(held), "id", "text"))

    same()
    for step in range(3):
        before = dict(index.store.latest().tables)
        new = dict(texts(draw, draw.sample(sorted(held), 15) + [f"new{step}"]))
        gone = draw.sample(sorted(set(held) - set(new)), 5)
        index.change(frame(new), spark.createDataFrame([(g,) for g in gone], "id string"))
        held = {k: v for k, v in (held | new).items() if k not in gone}
        after = index.store.latest().tables
        assert all(after[t] == before[t] for t in before if t != "words-changed") and len(after) == len(before) + 1
        same()
    asked = index.words(["w1"])
    assert len(asked.inputFiles()) <= 4 + len(index._notes(index.store.latest()).inputFiles())  # one bucket of each segment
    index.merge()
    assert len(index._segments(index.store.latest())) == 1 and index._notes(index.store.latest()).count() == 0
    same()
    assert index.document_frequency(["common"]).first().n_docs == sum(v is not None for v in held.values())


def test_ranked_results_from_the_stored_index(spark, tmp_path):
    names = [("a", "Red Widget Works"), ("b", "Widget Red"), ("c", "Blue Widget"), ("d", "Ring Small Works")]
    nodes = spark.createDataFrame([(i, n, n.lower(), "Q1" if i == "c" else None, "DE") for i, n in names], "id string, name string, name_normalized string, wikidata_id string, country string")
    queries = spark.createDataFrame([("q1", "red widget", "red widget", None), ("q2", "works", "", "DE"), ("q3", "idge", "", None)], "query_id string, q string, nn string, country string")
    index = SearchIndex(Store(spark, str(tmp_path / "s")), buckets=8)
    index.build(nodes.select("id", F.col("name").alias("text")).where("id <> 'b'"))
    index.change(nodes.select("id", F.col("name").alias("text")).where("id = 'b'"))

    def ranked(words):
        found = search.entity_candidates(nodes, words, queries)
        return list(map(tuple, search.rank(found, nodes, queries.drop("country")).orderBy("query_id", "position").collect()))

    want = ranked(search.token_index(nodes.withColumnRenamed("name", "text"), "id", "text"))
    assert ranked(index.words_of(queries)) == want and len(want) > 5


def test_empty_index(spark, tmp_path):
    index = SearchIndex(Store(spark, str(tmp_path / "s")))
    none = spark.createDataFrame([], "id string, text string")
    index.build(none)
    assert index.words().count() == index.words(["x"]).count() == 0
    index.change(spark.createDataFrame([("a", "x y"), (None, "x")], "id string, text string"))
    assert sorted(map(tuple, index.words().collect())) == [("x", "a"), ("y", "a")]
    with pytest.raises(ValueError):
        SearchIndex(Store(spark, str(tmp_path / "other"))).change(none)
