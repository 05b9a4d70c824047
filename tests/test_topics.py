import random
import time

from loomgraph.functions import text
from loomgraph.operators import bridges, ingest
from pyspark.sql import functions as F


def test_bridge_facts_and_paths(spark):
    chosen = spark.createDataFrame([("q", "h", "n", 2), ("q", "k", "n", 0), ("q", "h", "o", 9)], "qid string, hub string, nbr string, novel long")
    seeds = spark.createDataFrame([("q", "h", 0.3), ("q", "k", 0.2)], "qid string, hub string, dist double")
    facts = spark.createDataFrame([("n", "f1"), ("n", "f2"), ("o", "f3"), ("z", "f4")], "hub string, id string")
    known = spark.createDataFrame([("q", "f2")], "qid string, id string")
    got = {r.id: (r.seed, r.score) for r in bridges.bridge_facts(chosen, seeds, facts, known).collect()}
    assert got == {"f1": ("k", 0.35), "f3": ("h", 0.4)}
    paths = spark.createDataFrame([("q", "h", "n"), ("q", "h", "o")], "qid string, from_hub string, to_hub string")
    left = bridges.surviving_paths(paths, spark.createDataFrame([("q", "h"), ("q", "n")], "qid string, hub string"))
    assert [(r.from_hub, r.to_hub) for r in left.collect()] == [("h", "n")]


def test_topic_sessions_are_fused(spark):
    members = spark.createDataFrame([("t1", "rain cloud", "s1"), ("t1", "rain cloud", "s2"), ("t2", "sun", "s3"), ("t3", "moon", "s4")], "topic string, label string, session string")
    queries = spark.createDataFrame([("q", "Rain today"), ("p", "nothing")], "qid string, text string")
    seeds = spark.createDataFrame([("q", "s3", 1)], "qid string, session string, rk int")
    chosen = bridges.select_topics(queries, members, seeds, 2)
    assert [(r.qid, r.topic, r.score) for r in chosen.orderBy("rk").collect()] == [("q", "t1", 0.35), ("q", "t2", 0.3)]
    got = bridges.topic_sessions_ranked(chosen, members, seeds).orderBy("rk").collect()
    assert [r.id for r in got] == ["s3", "s1", "s2"]


def test_edges_flags_mentions_and_features(spark):
    w = spark.createDataFrame([(None, "a", "R", "b", 1, {"x": "1", "y": "1"}), (None, "a", "R", "b", 2, {"y": "2"}), ("e", "a", "R", "b", 1, None)], "uuid string, src string, name string, dst string, seq int, properties map<string,string>")
    assert {r.uuid: r.properties for r in ingest.merged_edges(w).collect()} == {"a-R-b": {"x": "1", "y": "2"}, "e": {}}
    e = spark.createDataFrame([("e1", False), ("e2", False)], "uuid string, deprecated boolean")
    assert {r.uuid: r.deprecated for r in ingest.deprecated(e, spark.createDataFrame([("e2",)], "uuid string")).collect()} == {"e1": False, "e2": True}
    units = spark.createDataFrame([("u1", "d", "Ann met BOB"), ("u2", "d", "nobody")], "unit string, doc string, text string")
    ents = spark.createDataFrame([("d", "ann"), ("d", "carl")], "doc string, entity string")
    assert sorted((r.unit, r.entity) for r in ingest.mentioned(units, ents).collect()) == [("u1", "ann"), ("u2", "ann"), ("u2", "carl")]
    pairs = spark.createDataFrame([("d", 0, "z", "1"), ("d", 1, "color", "red"), ("d", 2, "z", "2"), ("d", 3, "a", "3")], "doc_id string, pos int, key string, value string")
    assert sorted((r.key, r.value) for r in ingest.ordered_features(pairs, ["brand", "color"], 2).collect()) == [("color", "red"), ("z", "1"), ("z", "2")]


def test_slices_and_sizes(spark):
    r = spark.createDataFrame([("abcdefg", 3), ("", 20), (None, None)], "t string, n int").select(text.fixed_slices(F.col("t"), 3).alias("s"), text.unit_size(F.col("n")).alias("z")).collect()
    assert [x.s for x in r] == [["abc", "def", "g"], [], []] and [x.z for x in r] == [6000, 1200, 6000]


def test_many_sessions_are_not_compared_with_every_topic(spark):
    rng = random.Random(3)
    rows = [("b", f"s{i:04d}", sorted({f"w{rng.randrange(60_000)}" for _ in range(400)})) for i in range(2000)]
    rows += [("b", f"t{i:04d}", rows[i][2][:-20] + ["new"]) for i in range(50)]
    df = spark.createDataFrame(rows, "tenant string, session string, tokens array<string>")
    began = time.monotonic()
    got = bridges.topics(df).collect()
    assert time.monotonic() - began < 25  # each with each takes minutes
    by = {r.session: r.topic for r in got}
    assert len(set(by.values())) == 2000 and all(by[f"t{i:04d}"] == by[f"s{i:04d}"] for i in range(50))
