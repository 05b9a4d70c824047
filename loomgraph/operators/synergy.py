"""Siblings of a target, second-degree hops, best paths: walks guided by vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import association, cosine
from .ranked import top

# Factors of direct and similar seeds, and the weight of repeated evidence.
DIRECT, SIMILAR, REPEATED = 1.30, 0.70, 0.30


def weighted_mean(a, b, n: int = 2, weight: float = REPEATED):
    """Mean of two scores after s ^ (1 - w), w the effective weight of n values."""
    w = weight * max(1, n - 2) / max(2, n)
    lift = lambda s: F.pow(F.greatest(s, F.lit(0.0)), F.lit(1.0 - w))
    return (lift(a) + lift(b)) / 2


def synergies(targets: DataFrame, adj: DataFrame, vectors: DataFrame, similar: DataFrame, k: int) -> DataFrame:
    """target, id, score, via, rk: nodes that share a seed with the target (target).

    Seeds are the target's neighbours, at a factor of 1.3, and nodes similar to these (seed, like), at 0.7. A sibling's
    score at a seed is the mean of its cosine with the target and of the seed's with the target, times the factor; each
    seed counts once, and further seeds are folded in, in order of seed, by the weighted mean.
    """
    vec = vectors.select(F.col("id").alias("v"), "embedding")
    direct = targets.join(adj.select(F.col("origin").alias("target"), F.col("nbr").alias("seed")), "target").distinct().withColumn("factor", F.lit(DIRECT))
    alike = direct.join(similar, "seed").select("target", F.col("like").alias("seed"), F.lit(SIMILAR).alias("factor"))
    seeds = direct.unionByName(alike).filter("seed <> target").groupBy("target", "seed").agg(F.max("factor").alias("factor"))
    rows = seeds.join(adj.select(F.col("origin").alias("seed"), F.col("nbr").alias("id")).distinct(), "seed").filter("id <> target")
    with_vec = lambda df, key, name: df.join(vec.withColumnsRenamed({"v": key, "embedding": name}), key)
    rows = with_vec(with_vec(with_vec(rows, "target", "tv"), "seed", "sv"), "id", "nv")
    score = association(cosine(F.col("tv"), F.col("nv")), cosine(F.col("tv"), F.col("sv")), F.col("factor"))
    each = rows.select("target", "seed", "id", F.round(score, 6).alias("score")).filter("score > 0")
    listed = each.groupBy("target", "id").agg(F.array_sort(F.collect_list(F.struct("seed", "score"))).alias("e"))
    rest = F.slice("e", 2, F.greatest(F.size("e") - 1, F.lit(0)))
    folded = F.aggregate(rest, F.element_at("e", 1)["score"], lambda acc, x: weighted_mean(acc, x["score"]))
    return top(listed.select("target", "id", F.round(folded, 6).alias("score"), F.transform("e", lambda x: x["seed"]).alias("via")), k, ["target"])


def second_degree(seeds: DataFrame, adj: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """qid, id, hops, score: first and second neighbours of a query's seeds (qid, id) with a cosine of at least `least`
    to the seeds' mean vector."""
    parts = seeds.join(vectors, "id").select("qid", F.posexplode("embedding").alias("i", "x")).groupBy("qid", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = parts.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    hop = adj.select("origin", "nbr").distinct()
    one = seeds.join(hop, F.col("id") == F.col("origin")).select("qid", F.col("nbr").alias("id"), F.lit(1).alias("hops"))
    two = one.join(hop, F.col("id") == F.col("origin")).select("qid", F.col("nbr").alias("id"), F.lit(2).alias("hops"))
    rows = one.union(two).groupBy("qid", "id").agg(F.min("hops").alias("hops")).join(seeds, ["qid", "id"], "left_anti")
    found = rows.join(vectors, "id").join(mean, "qid").select("qid", "id", "hops", F.round(cosine(F.col("embedding"), F.col("mean")), 6).alias("score"))
    return found.filter(F.col("score") >= least)


def best_paths(starts: DataFrame, adj: DataFrame, worth: DataFrame, write: Callable[[DataFrame], DataFrame], branch: int = 3, depth: int = 3) -> DataFrame:
    """root, path, score: a beam over simple paths, the `branch` best hops from each place by worth (edge, s); a path
    scores its first hop plus a tenth of each later one, halved again for each further step."""
    hops = adj.join(worth, "edge").select("origin", "nbr", "s")
    w = Window.partitionBy("origin").orderBy(F.desc("s"), "nbr")
    hops = write(hops.groupBy("origin", "nbr").agg(F.max("s").alias("s")).withColumn("r", F.row_number().over(w)))
    step = starts.select(F.col("uuid").alias("root"), F.array("uuid").alias("path"), F.lit(0.0).alias("score"))
    out = None
    for d in range(depth):
        step = step.withColumn("at", F.element_at("path", -1)).join(hops.filter(F.col("r") <= branch + depth), F.col("at") == F.col("origin")).filter(~F.array_contains("path", F.col("nbr")))
        pick = Window.partitionBy("root", "path").orderBy(F.desc("s"), "nbr")
        step = step.withColumn("q", F.row_number().over(pick)).filter(F.col("q") <= branch)
        step = step.select("root", F.concat("path", F.array("nbr")).alias("path"), F.round(F.col("score") + F.col("s") * (1.0 if d == 0 else 0.1 / 2 ** (d - 1)), 6).alias("score"))
        out = step if out is None else out.unionByName(step)
    return out
