"""Ranked lists (qid, list_no, id, rk, score) and what is closed over them: fusion, merging, blending, metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import min_max

C = 60


def top(rows: DataFrame, k: int | None, keys: list[str], score: str = "score", tie: str = "id") -> DataFrame:
    """rk from 1 by falling score, then by id; k None or not positive keeps all. Plans as a window with a group limit."""
    out = rows.withColumn("rk", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(tie))))
    return out.filter(F.col("rk") <= k) if k and k > 0 else out


def union(lists: list[DataFrame]) -> DataFrame:
    """Numbers the lists in order; each has qid, id, rk, score."""
    out = None
    for no, rows in enumerate(lists):
        part = rows.select("qid", F.lit(no).alias("list_no"), "id", "rk", F.col("score").cast("double").alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def rrf(lists: DataFrame, weights: Column | None = None, c: int = C) -> DataFrame:
    """Reciprocal rank fusion of (qid, list_no, id, rk). Ties go to the item seen first: by list, then by rank."""
    share = (F.lit(1.0) if weights is None else weights) / (c + F.col("rk"))
    found = lists.groupBy("qid", "id").agg(F.round(F.sum(share), 6).alias("score"), F.min(F.struct("list_no", "rk")).alias("_first"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("_first"), F.asc("id"))
    return found.withColumn("rk", F.row_number().over(w)).drop("_first")


def convex(dense: DataFrame, lexical: DataFrame, alpha: float = 0.5) -> DataFrame:
    """alpha * dense + (1 - alpha) * lexical after rescaling each list to 0..1; missing counts 0; ties by id."""
    a = min(1.0, max(0.0, alpha))
    part = lambda rows, name: rows.select("qid", "id", min_max(F.col("score"), ["qid"]).alias(name))
    both = part(dense, "_d").join(part(lexical, "_l"), ["qid", "id"], "full")
    score = F.round(a * F.coalesce("_d", F.lit(0.0)) + (1 - a) * F.coalesce("_l", F.lit(0.0)), 6)
    return top(both.select("qid", "id", score.alias("score")), None, ["qid"])


def single(rows: DataFrame) -> DataFrame:
    """One list alone scores 1 / rank."""
    return rows.select("qid", "id", F.round(1.0 / F.col("rk"), 6).alias("score"), "rk")


def fuse(dense: DataFrame | None, lexical: DataFrame | None, mode: str = "rrf", alpha: float = 0.5, extra: list[DataFrame] | None = None) -> DataFrame:
    """The fusion that the lists given call for."""
    lists = [x for x in (dense, lexical) if x is not None]
    if mode == "cc" and lists:
        core = convex(dense if dense is not None else lexical.limit(0), lexical if lexical is not None else dense.limit(0), alpha)
        return rrf(union([core, *extra])) if extra else core
    lists += extra or []
    return single(lists[0]) if len(lists) == 1 else rrf(union(lists))


def frozen_head(ranked: DataFrame, sidecar: DataFrame, k: int, head: int = 10, prefer: DataFrame | None = None) -> DataFrame:
    """The first `head` stay; then what only the sidecar has, in its order; then the rest, preferred ids first."""
    base = ranked.select("qid", "id", F.when(F.col("rk") <= head, 0).otherwise(2).alias("part"), F.col("rk").alias("pos"))
    if prefer is not None:
        marked = prefer.select("qid", "id", F.lit(True).alias("_p")).distinct()
        base = base.join(marked, ["qid", "id"], "left").withColumn("part", F.when((F.col("part") == 2) & F.col("_p").isNull(), 3).otherwise(F.col("part"))).drop("_p")
    more = sidecar.select("qid", "id", F.lit(1).alias("part"), F.col("rk").alias("pos"))
    heads = base.filter("part = 0").select("qid", "id")
    rows = base.unionByName(more.join(heads, ["qid", "id"], "left_anti"))
    first = rows.groupBy("qid", "id").agg(F.min(F.struct("part", "pos")).alias("at"))
    w = Window.partitionBy("qid").orderBy("at", "id")
    return first.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k).select("qid", "id", "rk")


def blend(ranked: DataFrame, preference: DataFrame, share: DataFrame) -> DataFrame:
    """(1 - s) * rescaled score + s * rescaled preference, s by query; the order stays where s or all preferences are
    0, and among ties. ranked (qid, id, rk, score), preference (qid, id, pref), share (qid, s)."""
    rows = ranked.join(preference, ["qid", "id"], "left").join(share, "qid", "left").na.fill(0.0, ["pref", "s"])
    w = Window.partitionBy("qid")
    value = (1 - F.col("s")) * min_max(F.col("score"), ["qid"], 0.0) + F.col("s") * min_max(F.col("pref"), ["qid"], 0.0)
    rows = rows.withColumn("_off", (F.col("s") == 0) | (F.max("pref").over(w) <= 0)).withColumn("blend", F.round(value, 6))
    order = Window.partitionBy("qid").orderBy(F.when(F.col("_off"), 0.0).otherwise(F.col("blend")).desc(), F.asc("rk"))
    return rows.withColumn("new_rk", F.row_number().over(order)).select("qid", "id", "rk", "new_rk", "blend")


def facets(hits: DataFrame, extras: str = "extras") -> DataFrame:
    """Counts of each value of each extra: (key, value, n)."""
    return hits.select(F.explode(extras).alias("key", "value")).groupBy("key", "value").agg(F.count("*").alias("n"))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of rows with the total number beside each."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


# -- metrics


def metrics(ranked: DataFrame, gains: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """recall, mrr and ndcg at k of each query of `gains` (qid, id, gain): relevant means a positive gain. Gains without
    qid hold for every one of `queries` (qid): they are joined by id alone, and have one ideal list."""
    gold = gains.filter("gain > 0")
    own = [c for c in ("qid",) if c in gains.columns]
    hits = ranked.filter(F.col("rk") <= k).join(gold, [*own, "id"])
    dcg = lambda r: F.col("gain") / F.log2(r + 1.0)
    found = hits.groupBy("qid").agg(F.count("*").alias("hits"), F.min("rk").alias("first"), F.sum(dcg(F.col("rk"))).alias("dcg"))
    best = gold.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("gain"), "id"))) if own else gold.orderBy(F.desc("gain"), "id").limit(k)
    if own:
        ideal = best.groupBy("qid").agg(F.count("*").alias("n_gold"), F.sum(F.when(F.col("r") <= k, dcg(F.col("r")))).alias("ideal"))
        rows = gains.select("qid").distinct().join(ideal, "qid", "left")
    else:
        first = best.withColumn("r", F.row_number().over(Window.orderBy(F.desc("gain"), "id"))).agg(F.sum(dcg(F.col("r"))).alias("ideal"))
        rows = queries.select("qid").distinct().crossJoin(gold.agg(F.nullif(F.count("*"), F.lit(0)).alias("n_gold"))).crossJoin(first)  # one row each
    rows = rows.join(found, "qid", "left")
    ratio = lambda a, b: F.round(F.coalesce(F.col(a) / F.col(b), F.lit(0.0)), 6)
    return rows.select("qid", ratio("hits", "n_gold").alias("recall"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), ratio("dcg", "ideal").alias("ndcg"))


def canonical(ranked: DataFrame, document: Column) -> DataFrame:
    """Chunk hits as document hits: each document at its first place, ranks closed up."""
    first = ranked.withColumn("id", document).groupBy("qid", "id").agg(F.min("rk").alias("at"))
    return first.withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy("at", "id"))).drop("at")


def restricted(ranked: DataFrame, pool: DataFrame) -> DataFrame:
    """The list within a labelled pool (qid, id, or id for all queries), ranks closed up."""
    keys = [c for c in ("qid", "id") if c in pool.columns]
    kept = ranked.join(pool.select(*keys).distinct(), keys, "left_semi")
    return kept.withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy("rk")))


def picked(rows: DataFrame, done: DataFrame | None, key: str, state: dict[str, Column], order: Column, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`done` and one more row (with its `turn`) of each key: the least by `order`, where that isn't null, of those not
    yet done. `state` are aggregates of the key's done rows that `order` may use (null before the first). Choosing in turn like this needs no
    group in one task: a round is a partial aggregate, and what is done is small, so Spark broadcasts it by its size."""
    turn, left = 1, rows
    if done is None:
        left = left.withColumns({n: F.lit(None) for n in state})
    else:
        turn = (done.agg(F.max("turn")).first()[0] or 0) + 1
        left = left.join(done.select(key, "id"), [key, "id"], "left_anti").join(done.groupBy(key).agg(*[c.alias(n) for n, c in state.items()]), key, "left")
    best = left.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("b")).filter("b is not null").select("b.*").withColumn("turn", F.lit(turn))
    return write(best if done is None else done.unionByName(best))


def kendall(rows: DataFrame, block: int = 1 << 16) -> DataFrame:
    """key, tau, pairs: Kendall's tau-b of each key's rows (key, x, y), null where all are tied in x or in y.

    Pairs that are out of order are counted bit by bit, in n log n: two ranks differ at some highest bit, so at each bit,
    among rows whose higher bits agree, every row with the bit off counts those before it with the bit on. Rows are
    counted within blocks of places, and blocks against blocks by their sums, so one key may have many rows.
    """
    rows = rows.filter("x is not null and y is not null").select("key", "x", "y")
    ties = lambda *by: rows.groupBy("key", *by).agg(F.count("*").alias("n")).groupBy("key").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("t"))
    place = rows.select("key", (F.row_number().over(Window.partitionBy("key").orderBy("x", "y")) - 1).alias("at"), (F.dense_rank().over(Window.partitionBy("key").orderBy("y")) - 1).alias("rank"))
    bits = rows.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(F.log2(F.countDistinct("y")))).cast("int").alias("bits"))
    each = place.join(bits, "key").select("key", "at", "rank", F.explode(F.sequence(F.lit(0), F.col("bits") - 1)).alias("level"))
    each = each.select("key", "at", "level", F.expr("shiftright(rank, level + 1)").alias("high"), F.expr("shiftright(rank, level) & 1").alias("bit"), F.floor(F.col("at") / block).alias("block"))
    within = Window.partitionBy("key", "level", "high", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    near = each.withColumn("on", F.coalesce(F.sum("bit").over(within), F.lit(0))).filter("bit = 0").groupBy("key").agg(F.sum("on").alias("d"))
    sums = each.groupBy("key", "level", "high", "block").agg(F.sum("bit").alias("on"), F.count_if(F.col("bit") == 0).alias("off"))
    before = Window.partitionBy("key", "level", "high").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    far = sums.withColumn("on", F.coalesce(F.sum("on").over(before), F.lit(0))).groupBy("key").agg(F.sum(F.col("on") * F.col("off")).alias("d"))
    wrong = near.union(far).groupBy("key").agg(F.sum("d").alias("wrong"))
    out = ties().withColumnRenamed("t", "n0").join(wrong, "key", "left")
    for name, by in (("n1", ["x"]), ("n2", ["y"]), ("n3", ["x", "y"])):
        out = out.join(ties(*by).withColumnRenamed("t", name), "key")
    right = F.expr("n0 - n1 - n2 + n3 - 2 * coalesce(wrong, 0)")
    scale = F.sqrt((F.col("n0") - F.col("n1")).cast("double") * (F.col("n0") - F.col("n2")))
    return out.select("key", F.when(scale > 0, right / scale).alias("tau"), F.col("n0").alias("pairs"))
