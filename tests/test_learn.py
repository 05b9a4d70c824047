import random

import numpy as np
import pytest
from loomgraph.functions import names
from loomgraph.operators import channels, dense, learn, ranked, synergy
from loomgraph.plans.search_queries import names as part_names
from loomgraph.plans.search_queries import g
from loomgraph.sources import store
from pyspark.sql import functions as F


def test_name_likeness_and_spelling(spark):
    rows = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("ab", ""), (None, "x")], "a string, b string")
    assert [round(r.x, 6) for r in rows.select(names.indel_ratio("a", "b").alias("x")).collect()] == [round(8 / 13, 6), 1.0, 0.0, 0.0]
    one = spark.createDataFrame([("--Café &amp; ﬁne!! ", None)], "a string, b string").select(names.spelling("a").alias("x"), names.spelling("b").alias("y")).first()
    assert (one.x, one.y) == ("Cafe & fine", None)
    spans = spark.createDataFrame([("red fox", "the red fox"), ("Red fox", "the red\n fox"), ("cat", "the dog"), ("", "x")], "s string, t string")
    assert [r.x for r in spans.select(names.span_offset("s", "t").alias("x")).collect()] == [4, 4, -1, -1]
    same = spark.createDataFrame([("Ann Lee", ["P"], "ann lee", ["P"]), ("Ann Lee", ["P"], "Bob", ["Q"])], "a string, la array<string>, b string, lb array<string>")
    assert [r.x for r in same.select(names.same_entity(F.col("a"), F.col("la"), F.col("b"), F.col("lb")).alias("x")).collect()] == [True, False]


def test_json_and_maps(spark):
    df = spark.createDataFrame([('x {"a": 1} then {"b": {"c": 2}} end', {"k": "1", "m": "2"}, {"k": None, "n": "3"}), ("no {bad", {}, {})], "t string, a map<string,string>, b map<string,string>")
    rows = df.select(names.last_json(F.col("t")).alias("j"), names.merged_extras(F.col("a"), F.col("b")).alias("m"), names.set_properties(F.col("a"), F.col("b"), ["m"]).alias("s")).collect()
    assert rows[0].j == '{"b": {"c": 2}}' and rows[1].j is None
    assert rows[0].m == {"k": "1", "m": "2", "n": "3"} and rows[0].s == {"k": "1", "n": "3"}


def test_nearest_in_small_blocks_as_numpy(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 7)
    rng = np.random.default_rng(0)
    x = rng.integers(-2, 3, (60, 4)).astype(float)
    x[5] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (98, [])], "id long, embedding array<double>").repartition(5)
    got = {}
    for r in dense.nearest(df, df.withColumnRenamed("id", "qid"), 4, skip_self=True).collect():
        got.setdefault(r.qid, []).append((r.rk, r.id, r.score))
    norm = np.linalg.norm(x, axis=1)
    cos = np.round(np.divide(x @ x.T, np.outer(norm, norm), out=np.zeros((60, 60)), where=np.outer(norm, norm) > 0), 6)
    for i in range(60):
        order = sorted((j for j in range(60) if j != i), key=lambda j: (-cos[i, j], j))[:4]
        assert [(k, j) for k, j, _ in sorted(got[i])] == list(enumerate(order, 1))
    assert dense.nearest(df, df.withColumnRenamed("id", "qid").limit(0), 4).count() == 0


def test_inverted_lists_find_nine_of_ten(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    asked = v.filter("id % 50 = 0").withColumnRenamed("id", "qid")
    exact, found = ({(r.qid, r.id): r.score for r in rows.collect()} for rows in (dense.nearest(v, asked, 10), dense.approximate(v, asked, 10)))
    assert len(exact) >= 300 and len(exact.keys() & found.keys()) >= 0.9 * len(exact)
    assert all(abs(exact[x] - found[x]) < 2e-6 for x in exact.keys() & found.keys())
    assert dense.listed(v, dense.centroids(v)[0]).select("id").distinct().count() == v.count()
    odd = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, []), (4, [1.0, 0.0]), (5, [1.0])], "id long, embedding array<double>")
    assert {(r.qid, r.id) for r in dense.approximate(odd, odd.filter("id = 4").withColumnRenamed("id", "qid"), 5).collect()} == {(4, 1), (4, 4)}
    assert dense.approximate(odd.limit(0), odd.withColumnRenamed("id", "qid"), 5).count() == 0


def test_reduction_is_greedy_in_order(spark):
    rows = spark.createDataFrame([("k", 1, [1.0, 0.0]), ("k", 2, [1.0, 0.05]), ("k", 3, [0.0, 1.0]), ("j", 4, [1.0, 0.05])], "key string, id int, embedding array<double>")
    assert sorted(r.id for r in learn.reduced(rows).collect()) == [1, 3, 4]


def test_ranknet_learns_the_useful_feature(spark):
    rng = random.Random(0)
    rows = [(f"q{q}", f"d{i}", float(i < 2), (i < 2) + rng.random() * 0.3, rng.random()) for q in range(40) for i in range(8)]
    df = spark.createDataFrame(rows, "qid string, id string, gain double, good double, noise double")
    top = ranked.top(learn.ranknet(df, ["good", "noise"]), 2, ["qid"]).join(df, ["qid", "id"])
    assert top.agg(F.avg("gain")).first()[0] > 0.95


def test_maxsim_and_class_gain(spark):
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("q", [0.0, 1.0])], "qid string, embedding array<double>")
    d = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 2.0]), ("b", [1.0, 1.0])], "id string, embedding array<double>")
    got = {r.id: r.score for r in learn.maxsim(q, d).collect()}
    assert got == {"a": 2.0, "b": pytest.approx(2 / np.sqrt(2), abs=1e-6)}
    assert spark.range(1).select(learn.class_gain(F.array(F.lit(0.5), F.lit(0.5)), [1.0, 0.1]).alias("x")).first().x == 0.55


def test_sample_caps_documents_and_drops_queries_without_gold(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "qid string")
    c = spark.createDataFrame([("a", "1", 0, 1.0), ("a", "2", 1, 0.0), ("a", "3", 2, 0.0), ("b", "1", 0, 0.0), ("b", "4", 1, 1.0), ("c", "9", 0, 1.0)], "qid string, id string, pos int, gain double")
    got = learn.sampled_catalog(q, c, 2, 2, 2)
    assert sorted((r.qid, r.id) for r in got.collect()) == [("a", "1"), ("a", "2")]


def test_plug_ins(spark):
    channels.register_retriever("mine", lambda q, k: q.select("qid", F.lit("x").alias("id"), F.lit(1.0).alias("score"), F.lit(1).alias("rk")))
    q = spark.createDataFrame([("q", "t")], "qid string, text string")
    assert channels.plugin(channels.RETRIEVERS, "plugin:mine")(q, 5).first().id == "x"
    with pytest.raises(ValueError):
        channels.plugin(channels.RETRIEVERS, "plugin:other")
    with pytest.raises(ValueError):
        channels.register_reranker("linear", lambda r, n: r)


def test_entity_channel_takes_the_best_branch(spark, data):
    n, _ = g(spark, data)
    asked = part_names(spark, data)
    plain = channels.entities(n, asked, 5, ["PRODUCT"]).filter("rk = 1")
    assert plain.filter("score < 8").count() == 0  # every query is some part's whole name
    one = n.filter("uuid like 'part:%'").orderBy("uuid").select("uuid").first().uuid
    similar = asked.select("qid", F.lit(one).alias("id"), F.lit(100.0).alias("score"))
    assert channels.entities(n, asked, 1, ["PRODUCT"], similar).filter(f"id <> '{one}'").count() == 0


def test_synergies_by_hand(spark):
    adj = spark.createDataFrame([("t", "s"), ("s", "t"), ("s", "x"), ("x", "s"), ("t", "r"), ("r", "x")], "origin string, nbr string")
    vec = spark.createDataFrame([("t", [1.0, 0.0]), ("s", [0.8, 0.6]), ("r", [0.6, 0.8]), ("x", [1.0, 0.0])], "id string, embedding array<double>")
    none = spark.createDataFrame([], "seed string, like string")
    r = synergy.synergies(spark.createDataFrame([("t",)], "target string"), adj, vec, none, 5).collect()
    a, b = (1.0 + 0.6) / 2 * 1.3, (1.0 + 0.8) / 2 * 1.3
    w = 0.3 * 1 / 2
    assert [(x.id, x.via) for x in r] == [("x", ["r", "s"])] and r[0].score == pytest.approx((a ** (1 - w) + b ** (1 - w)) / 2, abs=1e-5)


def test_best_paths_are_simple_and_scored(spark):
    adj = spark.createDataFrame([("a", "b", "e1"), ("b", "a", "e1"), ("b", "c", "e2"), ("c", "b", "e2")], "origin string, nbr string, edge string")
    worth = spark.createDataFrame([("e1", 0.5), ("e2", 0.4)], "edge string, s double")
    got = {"".join(r.path): r.score for r in synergy.best_paths(spark.createDataFrame([("a",)], "uuid string"), adj, worth, store.written).collect()}
    assert got == {"ab": 0.5, "abc": 0.54}
