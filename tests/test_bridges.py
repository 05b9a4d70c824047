from itertools import combinations

from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomgraph.operators import bridges


def _events(spark, data):
    """Orders of each customer and each part, from the tables."""
    held = {}
    for r in spark.read.parquet(f"{data}/orders.parquet").select("o_orderkey", "o_custkey").collect():
        held.setdefault(f"user:{r.o_custkey}", set()).add(f"order:{r.o_orderkey}")
    for r in spark.read.parquet(f"{data}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        held.setdefault(f"part:{r.l_partkey}", set()).add(f"order:{r.l_orderkey}")
    return held


def test_hub_bridges_lists_every_pair(spark, data):
    want = {(a, b, e) for e, events in _events(spark, data).items() for a, b in combinations(sorted(events), 2)}
    got = entry.registry.QUERIES["hub_bridges"](spark, data).collect()
    assert len(got) == len(want) and {(r.event_a, r.event_b, r.shared_entity) for r in got} == want


def test_bridge_pool_counts_every_neighbour(spark, data):
    want = {}
    for e, events in _events(spark, data).items():
        for a in events if len(events) > 1 else ():
            nbrs, first = want.setdefault(a, (set(), []))
            nbrs |= events - {a}
            first.append(e)
    assert max(len(n) for n, _ in want.values()) > 100
    got = entry.registry.QUERIES["bridge_pool"](spark, data)
    assert {r.hub: (r.neighbours, r.first_shared) for r in got.collect()} == {h: (len(n), min(f)) for h, (n, f) in want.items()}


def test_neighbour_pool_is_that_of_all_pairs(spark):
    rows = [(f"e{i}", f"ev{(i * 7 + j * j) % 23:02d}") for i in range(12) for j in range(i + 1)] + [("alone", "x")]
    members = spark.createDataFrame(sorted(set(rows)), "entity string, event string").withColumn("name", F.lit("n"))
    hubs = members.select(F.col("event").alias("hub")).distinct()
    want = bridges.bridge_neighbours(bridges.bridges(members), hubs).select("hub", "nbr", "shared_entity")
    assert sorted(bridges.neighbour_pool(members).collect()) == sorted(want.collect())
