"""Mixing sources to target weights, with DataFrame functions only.

Words are summed per source, the sources' targets follow from their weights, and every document is emitted
floor(rate) times plus once more with the rate's fraction as probability, seeded by a hash of its id. The hash puts a
source's documents on a circle, each as long as its words, in a random order; a hash of the source turns the circle. A
document is drawn if its middle then lies in the first part of the circle, of the fraction's length: the turn alone gives
each document exactly the fraction as probability, however many words of its source it holds, and a source's copies come
within its largest document of the target (rows of one doc_id count as one), where independent draws would scatter with
the root of its size. Draws need no sort: words are summed by source and leading bits of the hash, the places where the
part begins and ends are looked up in these sums, and only the rows of these two steps, a small part, are summed hash by
hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stash

WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its own size.
CEILING = 3
SEED = 42
#: Steps that hashes of 52 bits are summed by, in bits.
STEP_BITS = 12
#: A table of sources up to this size (rows, bytes of names) is broadcast; a larger one is joined by shuffle, each
#: source's rows in SALTS parts.
MOST_ROWS, MOST_BYTES, SALTS = 50_000, 4 << 20, 64


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hashed(doc_id: Column, text: Column, seed: int) -> Column:
    """52 bits of a row's doc_id, or of its text if that is null."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("long")


def shares(sums: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """source, source_size, target and rate from source and source_size; null is a source of its own, last in order.

    With sources sorted by ceiling * size / weight, those that overrun come first, and a source overruns if its
    ceiling is below its weight's share of what the ones before it leave. That is the end of sharing the excess
    again and again, found in one pass over the sources.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    cap = F.col("source_size") * float(ceiling)
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    first = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    left = F.sum("source_size").over(every) - first("cap")
    rows = sums.withColumn("weight", weight).withColumn("cap", cap)
    rows = rows.withColumn("over", F.col("cap") * (F.sum("weight").over(every) - first("weight")) < F.col("weight") * left)
    spared = lambda c: F.sum(F.when(~F.col("over"), F.col(c))).over(every)
    taken = F.coalesce(F.sum(F.when(F.col("over"), F.col("cap"))).over(every), F.lit(0.0))
    rest = F.col("weight") * (F.sum("source_size").over(every) - taken) / spared("weight")
    rows = rows.withColumn("target", F.when(F.col("over"), F.col("cap")).otherwise(rest))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return rows.select("source", "source_size", "target", F.least(rate, F.lit(float(ceiling))).alias("rate"))


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size and hash of every row, as a table: all that deciding needs, and texts are read once."""
    key = hashed(F.col("doc_id"), F.col("text"), seed)
    return stash(docs.select("doc_id", "source", size(F.col("text")).alias("size"), key.alias("hash")), "sized")


def turned(source: Column, seed: int) -> Column:
    """How far a source's circle is turned, from 0 to 1."""
    key = F.concat(F.lit(f"{seed}:source:"), F.coalesce(F.concat(F.lit("of:"), source.cast("string")), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / float(1 << 52)


def decided(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING, seed: int = SEED) -> DataFrame:
    """source, source_size, target, rate, and `since`, `until`, `wraps` from `sized` rows: hashes from `since` up to before
    `until` are drawn, or where the part wraps around those from `since` on and those before `until`."""
    step = F.shiftright("hash", 52 - STEP_BITS)
    steps = stash(rows.groupBy("source", step.alias("step")).agg(F.sum("size").alias("words")), "steps")
    table = shares(steps.groupBy("source").agg(F.sum("words").alias("source_size")), weights, ceiling)
    table = table.withColumn("low", (1 - turned(F.col("source"), seed)) * F.col("source_size"))
    table = table.withColumn("high", F.col("low") + (F.col("rate") - F.floor("rate")) * F.col("source_size"))
    table = stash(table.withColumn("wraps", F.col("high") > F.col("source_size")), "shares")
    ends = [F.struct(F.lit(0).alias("cut"), F.col("low").alias("wanted")), F.struct(F.lit(1).alias("cut"), F.when(F.col("wraps"), F.col("high") - F.col("source_size")).otherwise(F.col("high")).alias("wanted"))]
    cuts = table.select("source", F.inline(F.array(*ends)))
    # for either end of a source's part, the first step by whose end the words reach it, and the words before that step
    of = Window.partitionBy("source").orderBy("step")
    run = steps.withColumn("ends", F.sum("words").over(of)).select(F.col("source").alias("_source"), "step", "ends", (F.col("ends") - F.col("words")).alias("spent"))
    passed = run.join(cuts, F.col("_source").eqNullSafe(F.col("source"))).filter("ends >= wanted")
    passed = passed.groupBy("source", "cut", "wanted").agg(F.min(F.struct("step", "spent")).alias("at")).select(F.col("source").alias("_source"), "cut", "wanted", "at.step", "at.spent")
    inner = with_source(rows.select("source", "size", "hash", step.alias("_step")), passed, "_source", "source", F.col("hash")).filter("_step = step")
    # there the first hash whose middle is at or past the end
    ties = inner.groupBy("source", "cut", "wanted", "hash").agg(F.sum("size").alias("words"), F.first("spent").alias("spent"))
    past = Window.partitionBy("source", "cut").orderBy("hash")
    middle = F.col("spent") + F.sum("words").over(past) - F.col("words") / 2
    beyond = ties.withColumn("middle", middle).groupBy("source", "cut").agg(F.min(F.when(F.col("middle") >= F.col("wanted"), F.col("hash"))).alias("first"), (F.max("hash") + 1).alias("after"))
    hash_of = lambda cut: F.max(F.when(F.col("cut") == cut, F.coalesce("first", "after")))
    found = beyond.groupBy(F.col("source").alias("_source")).agg(hash_of(0).alias("since"), hash_of(1).alias("until"))
    found = table.join(found, F.col("source").eqNullSafe(F.col("_source")), "left")
    return stash(found.select("source", "source_size", "target", "rate", "since", "until", "wraps"), "decided")


def with_source(rows: DataFrame, table: DataFrame, name: str, source: str, spread: Column) -> DataFrame:
    """`rows` joined to a table of one row a source (`name`), broadcast behind a check of its size. A larger one is
    joined by shuffle, with each source's rows, which may be a third of all, dealt to SALTS parts by `spread`."""
    n, names = table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(name)), F.lit(0))).first()
    same = F.col(source).eqNullSafe(F.col(name))
    if n <= MOST_ROWS and names <= MOST_BYTES:
        return rows.join(F.broadcast(table), same)
    salts = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return dealt.join(salts, same & (F.col("_part") == F.col("_salt"))).drop("_part", "_salt")


def copies(hash_: Column) -> Column:
    since, until = hash_ >= F.col("since"), hash_ < F.col("until")
    return F.floor("rate") + F.when(F.when(F.col("wraps"), since | until).otherwise(since & until), 1).otherwise(0)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING, seed: int = SEED) -> DataFrame:
    """`docs` (doc_id, text, source and any others) with each row as often as the mix takes it; columns unchanged.

    Null and blank texts have size 0 and are copied like others. Rows without doc_id draw by their text; repeated rows
    and rows of one doc_id draw alike, as one document of all their words. An empty table gives no rows.
    """
    table = decided(sized(docs, seed), weights, ceiling, seed).select(F.col("source").alias("_source"), "rate", "since", "until", "wraps")
    nested = docs.select(F.struct("*").alias("row"))  # so that no column's name can clash
    rows = with_source(nested, table, "_source", "row.source", F.struct("row.doc_id", "row.text"))
    rows = rows.withColumn("copies", copies(hashed(F.col("row.doc_id"), F.col("row.text"), seed))).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row; other columns are ignored."""
    rows = sized(docs, seed)
    rows = with_source(rows, decided(rows, weights, ceiling, seed).withColumnRenamed("source", "_source"), "_source", "source", F.col("hash"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("hash"))).cast("long").alias("taken"))
