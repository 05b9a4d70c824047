"""Pattern queries over nodes, edges and adjacency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import all_of, any_of
from ..model import adjacency


def by_uuids(rows: DataFrame, wanted: DataFrame, key: str = "uuid") -> DataFrame:
    """Rows named in wanted (pos, uuid), in its order; missing ones are skipped."""
    return rows.join(wanted.withColumnRenamed("uuid", key), key).orderBy("pos")


def triples(edge_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the names of their ends."""
    end = lambda k: nodes.select(F.col("uuid").alias(k), F.col("name").alias(f"{k}_name"), F.col("labels").alias(f"{k}_labels"))
    return edge_rows.join(end("src"), "src").join(end("dst"), "dst")


def neighbours(adj: DataFrame, nodes: DataFrame, origins: DataFrame, labels: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """origin, edge, direction, nbr of each origin (uuid, pos); labels any-of on the neighbour. `limit` counts over all
    origins together, by origin's place and edge."""
    end = nodes.select(F.col("uuid").alias("nbr"), F.col("labels").alias("nbr_labels"))
    rows = adj.join(origins.withColumnRenamed("uuid", "origin"), "origin").join(end, "nbr").filter(any_of(F.col("nbr_labels"), labels or []))
    return rows.orderBy("pos", "edge", "direction").limit(limit) if limit else rows


def event_paths(edge_rows: DataFrame, hubs: DataFrame | None = None, starts: DataFrame | None = None, history: bool = False) -> DataFrame:
    """Five-tuples n -r- m -r2- b: two different edges at m that share a flow key, in any direction. A path may end
    where it began. `hubs` (uuid) restricts m, `starts` (uuid) restricts n. Both legs have to be valid, unless `history` is
    asked for; then the column `current` tells whether they are."""
    adj = adjacency(edge_rows.filter("coalesce(flow_key, '') <> ''"), loops_twice=True)
    if history:
        legs = adj.select("origin", F.col("edge").alias("r"), F.col("nbr").alias("m"), F.col("name").alias("r_name"), "flow_key", "valid")
        if starts is not None:
            legs = legs.join(starts.select(F.col("uuid").alias("origin")).distinct(), "origin", "left_semi")
        if hubs is not None:
            legs = legs.join(hubs.select(F.col("uuid").alias("m")).distinct(), "m", "left_semi")
        ends = adj.select(F.col("origin").alias("m"), F.col("edge").alias("r2"), F.col("name").alias("r2_name"), F.col("nbr").alias("b"), F.col("direction").alias("r2_direction"), "flow_key", F.col("valid").alias("valid2"))
        return legs.withColumnRenamed("origin", "n").join(ends, ["m", "flow_key"]).filter("r <> r2").withColumn("current", F.col("valid") & F.col("valid2")).drop("valid", "valid2")
    adj = adj.filter("valid")
    one = adj.select(F.col("origin").alias("n"), F.col("edge").alias("r"), F.col("name").alias("r_name"), F.col("nbr").alias("m"), "flow_key")
    two = adj.select(F.col("origin").alias("m"), F.col("edge").alias("r2"), F.col("name").alias("r2_name"), F.col("nbr").alias("b"), F.col("direction").alias("r2_direction"), "flow_key")
    if hubs is not None:
        keep = hubs.select(F.col("uuid").alias("m")).distinct()
        one, two = one.join(keep, "m", "left_semi"), two.join(keep, "m", "left_semi")
    if starts is not None:
        one = one.join(starts.select(F.col("uuid").alias("n")).distinct(), "n", "left_semi")
    return one.join(two, ["m", "flow_key"]).filter("r <> r2")


def tuples_of(edge_rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """The five-tuples that begin at each query's seeds (qid, uuid)."""
    paths = event_paths(edge_rows, starts=seeds.select("uuid").distinct())
    return seeds.select("qid", F.col("uuid").alias("n")).distinct().join(paths, "n")


def nexts(edge_rows: DataFrame, leg: str) -> DataFrame:
    """The outgoing second legs of paths that begin with the edge `leg`."""
    first = edge_rows.filter(F.col("uuid") == leg)
    starts = first.select(F.col("src").alias("uuid"))
    return event_paths(edge_rows, starts=starts).filter((F.col("r") == leg) & (F.col("r2_direction") == "out"))


def between(edge_rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges between the two of each pair (a, b), either way."""
    both = pairs.select("a", "b", F.col("a").alias("src"), F.col("b").alias("dst")).union(pairs.filter("a <> b").select("a", "b", F.col("b"), F.col("a")))
    return edge_rows.join(both.distinct(), ["src", "dst"])


def degree(adj: DataFrame) -> DataFrame:
    return adj.groupBy(F.col("origin").alias("uuid")).agg(F.count("*").alias("degree"))


def entities(nodes: DataFrame, uuids: list[str] | None = None, labels: list[str] | None = None, name: str | None = None, every: bool = False) -> DataFrame:
    """Nodes by uuid, labels (any of them, or all) and part of the name."""
    tests = [(all_of if every else any_of)(F.col("labels"), labels or [])]
    if uuids:
        tests.append(F.col("uuid").isin(*uuids))
    if name:
        tests.append(F.contains(F.lower("name"), F.lit(name.lower())))
    return nodes.filter(reduce(lambda a, b: a & b, tests))


def relationships(edge_rows: DataFrame, nodes: DataFrame, names: list[str] | None = None, from_labels: list[str] | None = None, to_labels: list[str] | None = None, needle: str | None = None, target: str = "all") -> DataFrame:
    """Edges by type, labels of their ends and text in node names, edge description or edge name."""
    rows = triples(edge_rows, nodes).filter(any_of(F.col("src_labels"), from_labels or []) & any_of(F.col("dst_labels"), to_labels or []))
    rows = rows.filter(F.col("name").isin(*names)) if names else rows
    if needle:
        has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(needle.lower()))
        by = {"node_name": has("src_name") | has("dst_name"), "relationship_description": has("description"), "relationship_name": has("name")}
        rows = rows.filter(reduce(lambda a, b: a | b, by.values()) if target == "all" else by[target])
    return rows


def traverse(adj: DataFrame, origins: DataFrame, depth: int = 2, keep: Column | None = None, checkpoint=None) -> DataFrame:
    """Simple paths of up to `depth` (1 to 5) hops from each origin (uuid): origin, depth, nbr, path of nodes. A hop
    that `keep` rejects is left out together with all beyond it."""
    hop = adj.filter(keep) if keep is not None else adj
    step = origins.select(F.col("uuid").alias("root"), F.col("uuid").alias("at"), F.array("uuid").alias("path"))
    out = None
    for d in range(1, min(5, max(1, depth)) + 1):
        step = step.join(hop.select(F.col("origin").alias("at"), "nbr", "edge", "name"), "at").filter(~F.array_contains("path", F.col("nbr")))
        step = step.select("root", F.lit(d).alias("depth"), F.col("nbr").alias("at"), F.concat("path", F.array("nbr")).alias("path"), "edge", "name")
        step = checkpoint(step) if checkpoint else step
        out = step if out is None else out.unionByName(step)
        step = step.select("root", "at", "path")
    return out


def path_counts(adj: DataFrame, origins: DataFrame, depth: int = 3, keep: Column | None = None, checkpoint=None) -> DataFrame:
    """root, depth, at, paths: how many of `traverse`'s paths of up to `depth` (1 to 3) hops end at each node. Ways are
    summed before each hop, so that no path is listed: a walk of two hops is simple if it doesn't come back to its root, one
    of three if it also doesn't come back to its first node, and those that do are counted by that node and taken off."""
    hop = (adj.filter(keep) if keep is not None else adj).filter("origin <> nbr").groupBy("origin", "nbr").agg(F.count("*").alias("ways"))
    hop = checkpoint(hop) if checkpoint else hop
    ends = lambda rows, n: rows.groupBy("root", "at").agg(F.sum(n).alias("paths"))
    onward = lambda step: step.join(hop.withColumnRenamed("origin", "at"), "at").filter("nbr <> root").select("root", F.col("nbr").alias("at"), (F.col("paths") * F.col("ways")).alias("n"))
    one = ends(origins.select(F.col("uuid").alias("root")).join(hop, F.col("root") == F.col("origin")).select("root", F.col("nbr").alias("at"), "ways"), "ways")
    steps = [one]
    if depth > 1:
        steps.append(ends(onward(one), "n"))
    if depth > 2:
        there_and_back = hop.join(hop.select(F.col("origin").alias("nbr"), F.col("nbr").alias("origin"), F.col("ways").alias("back")), ["origin", "nbr"]).select(F.col("origin").alias("at"), F.col("nbr").alias("over"), (F.col("ways") * F.col("back")).alias("loops"))
        loops = one.join(there_and_back.groupBy("at").agg(F.sum("loops").alias("all")), "at").join(there_and_back.select("at", F.col("over").alias("root"), "loops"), ["root", "at"], "left")
        again = loops.select("root", "at", (F.col("paths") * (F.coalesce("loops", F.lit(0)) - F.col("all"))).alias("n"))
        steps.append(ends(onward(steps[1]).unionByName(again), "n").filter("paths > 0"))
    return reduce(DataFrame.unionByName, [s.select("root", F.lit(d).alias("depth"), "at", "paths") for d, s in enumerate(steps[: max(1, depth)], 1)])


def reach(adj: DataFrame, origins: DataFrame, depth: int, write) -> DataFrame:
    """Breadth first: root, uuid and the least number of hops. `write` stores a frontier and reads it back."""
    seen = write(origins.select(F.col("uuid").alias("root"), "uuid", F.lit(0).alias("hops")))
    for d in range(1, depth + 1):
        front = seen.filter(F.col("hops") == d - 1).join(adj.select(F.col("origin").alias("uuid"), "nbr"), "uuid")
        new = front.select("root", F.col("nbr").alias("uuid")).distinct().join(seen, ["root", "uuid"], "left_anti")
        seen = write(seen.unionByName(new.withColumn("hops", F.lit(d))))
    return seen


def adjacent(edge_rows: DataFrame, nodes: DataFrame, origins: DataFrame, fanout: int, skip: list[str] | None = None) -> DataFrame:
    """Other ends of each origin (uuid): over events first (the event itself is skipped), then direct; distinct,
    without `skip` labels, `fanout` at most."""
    adj = adjacency(edge_rows).filter("valid").select("origin", "nbr")
    is_event = nodes.select(F.col("uuid").alias("nbr"), F.array_contains("labels", "EVENT").alias("event"), "labels")
    hop = adj.join(origins.select(F.col("uuid").alias("origin")), "origin").join(is_event, "nbr")
    over = hop.filter("event").select("origin", F.col("nbr").alias("hub")).join(adj.select(F.col("origin").alias("hub"), "nbr"), "hub").join(is_event, "nbr").filter("not event")
    rows = over.select("origin", "nbr", "labels", F.lit(0).alias("way")).union(hop.filter("not event").select("origin", "nbr", "labels", F.lit(1)))
    rows = rows.filter("origin <> nbr")
    rows = rows.filter(~any_of(F.col("labels"), skip)) if skip else rows
    first = rows.groupBy("origin", "nbr").agg(F.min("way").alias("way"))
    w = Window.partitionBy("origin").orderBy("way", "nbr")
    return first.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= fanout)


def distinct_labels(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))
