"""Document fingerprints by closed syncmers, with DataFrame functions only.

A text is a row of pieces: its words, those over 16 code points in runs of 16. A k-mer of pieces is an anchor if the
smallest of its inner s-mers stands at its left or right edge (Edgar, 2021). Whether it is depends on the k-mer alone,
so an edit changes anchors only where it touches their k-mers, and equal passages have equal anchors at shifted places.
A text of fewer than k pieces has one anchor, the hash of all of it; an empty one has none. A fingerprint holds every
anchor with its place, whatever the text's length, and likeness is counted over all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import with_text

K, S = 5, 2
#: Ids in a range, and ranges at most.
ROWS, RANGES = 2000, 20_000
PIECE = r"[^\x20\x09-\x0D]{1,16}"


def with_anchors(rows: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """Adds `out`, an array of (at, hash) in the text's order: the place in pieces and the k-mer's hash."""
    words, mers = f"_{out}_words", f"_{out}_mers"
    w, m = F.col(words), F.col(mers)
    rows = rows.withColumn(words, F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda x: F.xxhash64(x)))
    if s == 2:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        rows = rows.withColumn(mers, F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.xxhash64(a, b)))
    else:
        starts = F.sequence(F.lit(1), F.size(w) - s + 1)
        rows = rows.withColumn(mers, F.when(F.size(w) >= s, F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, s)))).otherwise(F.array().cast("array<bigint>")))
    inner = k - s

    def mark(i: Column) -> Column:
        at = lambda j: F.get(m, i + j)
        between = [at(j) for j in range(1, inner)]
        edge = F.least(at(0), at(inner))
        closed = edge <= (F.least(*between) if len(between) > 1 else between[0]) if between else F.lit(True)
        cover = [at(j) for j in sorted({*range(0, inner, s), inner})]  # s-mers that cover the k-mer
        return F.when(closed, F.struct(i.alias("at"), F.xxhash64(*cover).alias("hash")))

    found = F.filter(F.transform(F.sequence(F.lit(0), F.size(w) - k), mark), lambda x: x.isNotNull())
    short = F.when(F.size(w) > 0, F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(w).alias("hash")))).otherwise(F.array().cast("array<struct<at:int,hash:bigint>>"))
    return rows.withColumn(out, F.when(F.size(w) >= k, found).otherwise(short)).drop(words, mers)


def hashes(anchors: Column) -> Column:
    """The distinct hashes."""
    return F.array_distinct(F.transform(anchors, lambda x: x["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes. Two empty ones are alike."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def fingerprint(anchors: Column) -> Column:
    """Every anchor in the text's order: the hash in 16 hexadecimal digits, "@", the place."""
    return F.lower(F.array_join(F.transform(anchors, lambda x: F.concat(F.lpad(F.hex(x["hash"]), 16, "0"), F.lit("@"), x["at"].cast("string"))), "."))


def parsed(line: Column) -> Column:
    """The array of anchors that a fingerprint holds."""
    parts = F.filter(F.split(line, "[.]"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.substring_index(x, "@", -1).cast("int").alias("at"), F.conv(F.substring_index(x, "@", 1), 16, -10).cast("long").alias("hash")))


def matches(a: Column, b: Column) -> Column:
    """Positional matching of two arrays of anchors: (at in a, shift to b) of each anchor hash that both hold,
    at the first place in either, in a's order. Moved passages show as runs of one shift. Both are sorted together, so
    long texts cost little more than a sort."""
    tagged = lambda anchors, side: F.transform(anchors, lambda x: F.struct(x["hash"].alias("hash"), F.lit(side).alias("side"), x["at"].alias("at")))
    first = lambda rows: _after(rows, lambda x, y: F.when(y.isNull() | (x["hash"] != y["hash"]) | (x["side"] != y["side"]), x))
    both = first(F.sort_array(F.concat(tagged(a, 0), tagged(b, 1))))
    found = _after(both, lambda x, y: F.when(x["hash"] == y["hash"], F.struct(y["at"].alias("at"), (x["at"] - y["at"]).alias("shift"))))
    return F.sort_array(found)


def _after(rows: Column, of: Callable[[Column, Column], Column]) -> Column:
    """What `of` gives for each element and the one before it (null before the first), without nulls."""
    n = F.size(rows)
    before = F.concat(F.array(F.get(rows, F.lit(-1))), F.slice(rows, 1, F.greatest(n - 1, F.lit(0))))
    return F.filter(F.zip_with(rows, F.when(n > 0, before).otherwise(rows), of), lambda x: x.isNotNull())


def bounds(ids: DataFrame) -> list[int]:
    """First ids of ranges of about equal counts, the least id first: ROWS ids in each, and 8 ranges for each shuffle
    partition at least, RANGES in all at most, so that their number is bounded whatever the table's size."""
    n, least = ids.agg(F.count("*"), F.min("doc_id")).first()
    parts = min(RANGES, max(n // ROWS, 8 * int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))), max(n, 1))
    if parts < 2:
        return [] if least is None else [least]
    cuts = ids.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 20 * parts)).first()[0]
    return sorted({least, *cuts})


def place(key: Column, firsts: list[int]) -> Column:
    """The number of the range that holds the key: a search among every k-th first id, then among k of them."""
    k = max(1, round(len(firsts) ** 0.5))
    table = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>")
    before = lambda a: F.size(F.filter(a, lambda x: x <= key))
    coarse = before(table(firsts[::k]))
    return (coarse - 1) * k + before(F.slice(table(firsts), (coarse - 1) * k + 1, k)) - 1


def with_next(rows: DataFrame, names: list[str]) -> DataFrame:
    """Adds next_<name> for each name: the values of the row with the next larger doc_id, after the largest those of
    the smallest. doc_id is unique and not null. Rows are dealt out once, by ranges of ids; the first row of a range is
    also sent to the range before it, where it stands last."""
    firsts = bounds(rows.select("doc_id"))
    if not firsts:
        return rows.select("*", *[F.col(n).alias(f"next_{n}") for n in names])
    last = len(firsts) - 1
    own = place(F.col("doc_id"), firsts)
    starts = F.get(F.split(F.lit(",".join(map(str, firsts))), ",").cast("array<bigint>"), F.col("_range")) == F.col("doc_id")
    to = lambda r, guest: F.struct(r.cast("int").alias("range"), guest.cast("int").alias("guest"))
    home = to(F.col("_range"), F.lit(0))
    sent = F.when(starts, F.array(home, to(F.when(F.col("_range") > 0, F.col("_range") - 1).otherwise(last), F.lit(1)))).otherwise(F.array(home))
    dealt = rows.withColumn("_range", own).withColumn("_to", F.explode(sent))
    window = Window.partitionBy(F.col("_to.range")).orderBy(F.col("_to.guest"), F.col("doc_id"))
    out = dealt.select("*", *[F.lead(n).over(window).alias(f"next_{n}") for n in names])
    return out.filter("_to.guest = 0").drop("_range", "_to")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text is the text with its last floor(n_chars / 4) code points replaced by as many (or all) of the next
    document. Null texts count as empty. Of rows with one doc_id, the one with the smallest text is the "next document"
    of others. Rows without doc_id have no next one: they are edited with themselves. Empty tables give no rows.
    """
    rows = with_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.filter("doc_id is not null")
    repeated = not placed.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    if repeated:
        one = with_next(placed.groupBy("doc_id").agg(F.min("text").alias("text")), ["text"])
        follow = placed.join(one.select("doc_id", "next_text"), "doc_id")
    else:
        follow = with_next(placed, ["text"])
    alone = rows.filter("doc_id is null").withColumn("next_text", F.col("text"))
    rows = follow.unionByName(alone).withColumn("n_chars", F.char_length("text"))
    need = "cast(floor(n_chars / 4) as int)"
    rows = rows.withColumn("edited", F.expr(f"concat(substring(text, 1, n_chars - {need}), substring(next_text, 1, {need}))"))
    # anchors are computed after the shuffle, those of the next text once more: they are larger than texts
    for text in ("text", "edited", "next_text"):
        rows = with_anchors(rows, text, f"{text}_anchors").withColumn(f"{text}_hashes", hashes(F.col(f"{text}_anchors")))
    return rows.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text_anchors")).alias("fingerprint"),
        fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("text_hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("text_hashes"), F.col("next_text_hashes")).alias("near_next"),
    )
