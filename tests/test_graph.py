"""Patterns on small graphs with known answers."""

import random

import pytest
from loomgraph import model
from loomgraph.operators import bridges, graph, pagerank
from loomgraph.sources import store
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def small(spark):
    n = spark.createDataFrame([("A", ["Person"], "Alice"), ("B", ["Event"], "Meeting"), ("C", ["Person"], "Bob"), ("D", ["Event"], "Elsewhere")], "uuid string, labels array<string>, name string")
    e = spark.createDataFrame([("r1", "CAUSED", "flow1", "A", "B"), ("r2", "LED_TO", "flow1", "B", "C"), ("r3", "UNRELATED", "other", "B", "D")], "uuid string, name string, flow_key string, src string, dst string")
    return model.nodes(n), model.edges(e)


def start(spark, *uuids):
    return spark.createDataFrame([(u,) for u in uuids], "uuid string")


def test_one_event_path(spark, small):
    _, e = small
    rows = graph.event_paths(e, starts=start(spark, "A")).collect()
    assert [(r.n, r.r, r.m, r.r2, r.b) for r in rows] == [("A", "r1", "B", "r2", "C")]
    assert graph.event_paths(e, starts=start(spark, "nobody")).count() == 0
    assert [(r.m, r.r2, r.b) for r in graph.nexts(e, "r1").collect()] == [("B", "r2", "C")]


def test_an_invalid_leg_hides_the_path(small):
    _, e = small
    for change in ({"deprecated": F.lit(True)}, {"invalid_at": F.lit("2024-01-01")}):
        one = F.col("uuid") == "r2"
        k, v = next(iter(change.items()))
        assert graph.event_paths(e.withColumn(k, F.when(one, v).otherwise(F.col(k)))).count() == 0


def test_labels_are_normalised_on_both_sides(small):
    n, _ = small
    assert {r.uuid for r in graph.entities(n, labels=["event"]).collect()} == {"B", "D"}
    assert graph.entities(n, labels=["PERSON", "EVENT"], every=True).count() == 0
    assert [r.uuid for r in graph.entities(n, name="ALI").collect()] == ["A"]


def test_self_loops_once_or_twice(spark):
    e = model.edges(spark.createDataFrame([("l", "x", "x", "f")], "uuid string, src string, dst string, flow_key string"))
    assert model.adjacency(e).count() == 1 and model.adjacency(e, loops_twice=True).count() == 2


def test_traverse_is_cycle_free_and_clamped(spark, small):
    _, e = small
    ring = e.unionByName(model.edges(spark.createDataFrame([("r4", "C", "A")], "uuid string, src string, dst string")))
    rows = graph.traverse(model.adjacency(ring), start(spark, "A"), 9).collect()
    assert all(len(set(r.path)) == len(r.path) for r in rows)
    assert sorted("".join(r.path) for r in rows) == ["AB", "ABC", "ABD", "AC", "ACB", "ACBD"]
    pruned = graph.traverse(model.adjacency(ring), start(spark, "A"), 3, keep=F.col("name") != "UNRELATED")
    assert "D" not in {r["at"] for r in pruned.collect()}


def test_neighbour_limit_counts_over_all_origins(spark, small):
    n, e = small
    origins = spark.createDataFrame([(0, "B"), (1, "A")], "pos int, uuid string")
    rows = graph.neighbours(model.adjacency(e), n, origins, limit=4).collect()
    assert [(r.origin, r.edge) for r in rows] == [("B", "r1"), ("B", "r2"), ("B", "r3"), ("A", "r1")]
    assert [r.name for r in graph.by_uuids(n, spark.createDataFrame([(0, "C"), (1, "zz"), (2, "A")], "pos int, uuid string")).collect()] == ["Bob", "Alice"]


def test_pagerank_mass_and_formula(spark):
    links = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("d", "a", 1.0)]
    seeds = spark.createDataFrame([("a", 1.0), ("d", -3.0)], "uuid string, weight double")
    got = {r.uuid: r.mass for r in pagerank.pagerank(spark.createDataFrame(links, "src string, dst string, w double"), seeds, store.written).collect()}
    ids = "abcd"
    mass = {i: float(i == "a") for i in ids}
    total = {i: sum(w for s, _, w in links if s == i) for i in ids}
    for _ in range(20):
        lost = sum(mass[i] for i in ids if not total[i])
        mass = {i: 0.15 * (i == "a") + 0.85 * (sum(mass[s] * w / total[s] for s, d, w in links if d == i) + lost / 4) for i in ids}
    assert abs(sum(got.values()) - 1) < 1e-9 and all(abs(got[i] - mass[i]) < 1e-9 for i in ids)


def test_bridges_leave_context_out_and_refresh(spark):
    rows = spark.createDataFrame([("e1", "p", "Pat", "MADE"), ("e2", "p", "Pat", "TARGETED"), ("e3", "p", "Pat", "MADE"), ("e1", "town", "Rome", "OCCURRED_WITHIN"), ("e2", "town", "Rome", "OCCURRED_WITHIN"), ("x", "x", "X", "MADE")], "event string, entity string, entity_name string, rel_name string")
    m = bridges.memberships(rows)
    b = bridges.bridges(m)
    assert sorted((r.event_a, r.event_b, r.shared_entity) for r in b.collect()) == [("e1", "e2", "p"), ("e1", "e3", "p"), ("e2", "e3", "p")]
    less = bridges.refreshed(b, m.filter("event <> 'e3'"), spark.createDataFrame([("p",)], "entity string"))
    assert [(r.event_a, r.event_b) for r in less.collect()] == [("e1", "e2")]


def test_greedy_bridge_choice(spark):
    pool = spark.createDataFrame([("q", 0, "h", "n1", 1.0, ["s1"]), ("q", 0, "h", "n2", 1.0, ["s2", "s3"]), ("q", 1, "k", "n2", 9.0, ["s2"]), ("q", 1, "k", "n3", 0.5, ["s1"])], "qid string, at int, hub string, nbr string, weight double, sessions array<string>")
    got = bridges.novel_neighbours(pool, 1).orderBy("hub").collect()
    assert [(r.hub, r.nbr, r.novel) for r in got] == [("h", "n2", 2), ("k", "n3", 1)]


def test_topics_in_order(spark):
    rows = spark.createDataFrame([("b", "s1", ["a", "b", "c"]), ("b", "s2", ["b", "c", "d"]), ("b", "s3", ["x", "y"]), ("b", "s4", ["c", "d"])], "tenant string, session string, tokens array<string>")
    for parts in (1, 4):
        got = bridges.topics(rows.repartition(parts)).collect()
        groups = {}
        for r in got:
            groups.setdefault((r.topic, r.label), []).append(r.session)
        assert sorted(sorted(v) for v in groups.values()) == [["s1", "s2", "s4"], ["s3"]]
        assert {k[1] for k in groups} == {"a, b, c, d", "x, y"}


def test_read_only_sql(spark):
    sql = store.ReadOnlySql(spark, {"nums": spark.range(250)})
    rows, more = sql.run("select id from nums order by id")
    assert rows.count() == 100 and more
    assert sql.run("with t as (select 1 a) select * from t")[1] is False
    for bad in ("drop table nums", "create view v as select 1", "insert into nums values (1)", "set x = 1", "cache table nums", "delete from nums", "create table t as select 1"):
        with pytest.raises(Exception):  # noqa: B017  the parser's or ours
            sql.run(bad)


def test_deletes_cascade_and_upserts_keep_the_last(spark, small):
    n, e = small
    left_n, left_e = store.without_nodes(n, e, start(spark, "C"))
    assert left_n.count() == 3 and {r.uuid for r in left_e.collect()} == {"r1", "r3"}
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, seq int, v string")
    new = spark.createDataFrame([("a", 0, "z"), ("c", 1, "w")], "id string, seq int, v string")
    assert {(r.id, r.v) for r in store.upsert(old, new, "id", "seq").collect()} == {("a", "z"), ("b", "y"), ("c", "w")}


def test_counted_paths_are_the_listed_ones(spark):
    rng = random.Random(8)
    ways = [(rng.choice("abcdefg"), rng.choice("abcdefg"), f"e{i}") for i in range(24)]  # parallel edges and loops
    adj = model.adjacency(model.edges(spark.createDataFrame(ways, "src string, dst string, uuid string").withColumn("name", F.lit("HAS"))))
    roots = spark.createDataFrame([("a",), ("b",), ("b",), ("none",)], "uuid string")
    for oneway in (None, F.col("direction") == "out"):
        want = {tuple(r) for r in graph.traverse(adj, roots, 3, oneway).groupBy("root", "depth", "at").count().collect()}
        assert {tuple(r) for r in graph.path_counts(adj, roots, 3, oneway).collect()} == want
