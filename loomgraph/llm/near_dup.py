"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, connected groups.

1. A text becomes the set of its 5-word shingles (64-bit hashes). Texts of equal sets form a class, and only
   the class's smallest id goes on, so groups of copies cost one row each.
2. SuperMinHash (Ertl, 2017): element e gets, at level j, a rank j + r(e, j) in the slot that a Fisher-Yates
   permutation of its own puts at place j. Ranks of one element are thus correlated: no slot is hit twice, which
   lowers the estimate's variance. A document stops at the first level that can't lower any slot.
3. 25 bands of 5 slots: a pair at similarity 0.85 shares a band but for 4 in 10 million, at 0.8 but for 5 in 100,000.
4. In each bucket every member is compared with the bucket's smallest id, on full sets. Links are closed to
   components. Where a bucket still holds several components, its other pairs are compared if it has a handful of
   members; the members of larger ones go on to an exact prefix-filter join, which finds every link between them
   without listing a bucket's pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices, small_batches, stash, text_bytes, with_least, with_one, with_text

BANDS, ROWS = 25, 5
#: Bytes of text hashed at once.
PIECE = 1 << 20
#: A bucket's members up to this number are compared directly, larger buckets by prefix filter.
SMALL = 6
#: Bits of the largest bitmap of ids, 16 MB.
MOST_BITS = 1 << 27
#: Elements whose permutations are held at once.
HELD = 60_000

U = np.uint64
_rng = np.random.default_rng(20170601)
_byte_code = _rng.integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
_base = U(0x9E3779B97F4A7C15)
_word_code = _rng.integers(1, 1 << 63, 64, dtype=U) * U(2) + U(1)
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_byte_code = _byte_code[_lower]
_blank = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def mix(x: np.ndarray) -> np.ndarray:
    """Steele's 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse modulo 2^64."""
    up = np.full(n, _base, U)
    down = np.full(n, U(pow(int(_base), -1, 1 << 64)), U)
    up[0] = down[0] = U(1)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, A-Z taken as a-z, and each text's count of words."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(off) - 1, np.int64)
    up, down = _powers(1 << max(20, (n - 1).bit_length()))
    full = ~_blank[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begins, ends = full.copy(), full.copy()
    begins[1:] &= ~full[:-1] | edge[1:n]
    ends[:-1] &= ~full[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    total = np.zeros(n + 1, U)
    np.cumsum(_byte_code[data] * up[:n], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(U))
    return hashes, np.diff(np.searchsorted(start, off))


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; with fewer than k words the whole sequence is one shingle."""
    words, counts = word_hashes(data, off)
    ends = np.cumsum(counts)
    runs = np.zeros(max(0, len(words) - k + 1), U)
    for i in range(k):
        runs += words[i : len(words) - k + 1 + i] * _word_code[i] if len(runs) else U(0)
    runs = mix(runs)
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= k:
            yield np.unique(runs[end - n : end - k + 1])
        elif n:
            yield mix(np.array([np.sum(words[end - n : end] * _word_code[32 : 32 + n]) + U(n)], U))
        else:
            yield np.zeros(0, U)


def superminhash(sets: list[np.ndarray], slots: int = BANDS * ROWS) -> np.ndarray:
    """A row of `slots` ranks for each set, level in the upper and fraction in the lower half; all sets at once,
    level by level. An empty set's ranks are the largest number."""
    best = np.full((len(sets), slots), ~U(0), U)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return best
    flat = best.reshape(-1)
    item, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    drawn = mix(item)
    first = ((drawn & U(0xFFFFFFFF)) * U(slots) >> U(32)).astype(np.int64)
    np.minimum.at(flat, of * slots + first, drawn >> U(32))
    going = best.max(1) >= U(1 << 32)
    rest = np.flatnonzero(going[of])
    bounds = np.searchsorted(of[rest], np.arange(len(sets) + 1))
    at = 0
    while at < len(sets):  # whole sets, about HELD elements at a time
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + HELD, "right")) - 1)
        _levels(best, flat, item, of, first, rest[bounds[at] : bounds[to]], slots)
        at = to
    return best


def _levels(best: np.ndarray, flat: np.ndarray, item: np.ndarray, of: np.ndarray, first: np.ndarray, which: np.ndarray, slots: int) -> None:
    """Levels from 1 on of the elements `which`, until their sets can't change."""
    if not len(which):
        return
    item, of, first = item[which], of[which], first[which]
    places = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(item), 1))
    row = np.arange(len(item))
    places[row, first] = 0
    places[row, 0] = first
    for level in range(1, slots):
        drawn = mix(item + U(level * int(_base) % (1 << 64)))
        other = level + ((drawn & U(0xFFFFFFFF)) * U(slots - level) >> U(32)).astype(np.int64)
        slot = places[row, other]
        places[row, other] = places[row, level]
        places[row, level] = slot
        np.minimum.at(flat, of * slots + slot, (drawn >> U(32)) + U(level << 32))
        going = best[of].max(1) >= U((level + 1) << 32) if len(item) < 512 else (best.max(1) >= U((level + 1) << 32))[of]
        if not going.all():
            item, of, places = item[going], of[going], places[going]
            row = np.arange(len(item))
        if not len(item):
            return


def bands(ranks: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; the band's number is part of it."""
    parts = ranks.reshape(len(ranks), BANDS, ROWS)
    keys = np.repeat(_word_code[None, :BANDS], len(ranks), 0)
    for i in range(ROWS):
        keys = mix(keys + parts[:, :, i] * _word_code[40 + i])
    return keys


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (64 bits of the text), n_shingles, set_key (null for the empty set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                sets = list(shingle_sets(*text_bytes(part.column(1))))
                keys = bands(superminhash(sets)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.reshape(-1))),
                    ],
                    ["doc_id", "text_key", "n_shingles", "set_key", "bands"],
                )
        give_back()

    rows = with_text(docs).withColumn("text_key", text_key(F.col("text")))
    return small_batches(rows).mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>")


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def marks(ids: DataFrame) -> np.ndarray:
    """A bitmap of the ids' hashes: 16 bits for each id, between 1 and MOST_BITS in all, whatever the data. It
    only spares work: an id that it wrongly lets through is no pair's member."""
    bits = min(MOST_BITS, max(1 << 15, 1 << (16 * ids.count()).bit_length()))
    at = F.pmod(F.xxhash64("id"), F.lit(bits))
    rows = ids.select(at.alias("at")).groupBy(F.expr("at div 32768").alias("part")).agg(F.expr("bitmap_construct_agg(at % 32768)").alias("bits"))
    out = np.zeros(bits, bool)
    for row in rows.collect():
        out[row.part << 15 : (row.part + 1) << 15] = np.unpackbits(np.frombuffer(row.bits, np.uint8), bitorder="little")
    return np.packbits(out)


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and shingle set (8 bytes each, sorted) of the documents named in `ids` and of a few others. Texts are not
    shuffled: each task drops the rows that the bitmap rules out."""
    bitmap = marks(ids)
    sent, bits = docs.sparkSession.sparkContext.broadcast(bitmap), len(bitmap) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bitmap[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))
            for part in slices(batch, "text", PIECE):
                sets = [s.tobytes() for s in shingle_sets(*text_bytes(part.column(1)))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["id", "members"])
        give_back()

    rows = with_text(docs).filter("doc_id is not null").withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(bits)))
    return small_batches(rows).mapInArrow(run, "id long, members binary")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """`docs` less the rows whose doc_id and text are among `gone` (id, text_key). Rows that the bitmap of ids clears are
    kept where they are; only the others, about as many as `gone`, are shuffled for the exact anti-join."""
    bitmap = marks(gone.select("id").distinct())
    sent, bits = docs.sparkSession.sparkContext.broadcast(bitmap), len(bitmap) * 8

    def marked(at: pa.Array) -> pa.Array:
        place = at.to_numpy(zero_copy_only=False)
        return pa.array((sent.value[place >> 3] >> (7 - (place & 7)) & 1).astype(bool))

    nested = docs.select(F.struct("*").alias("row"))  # so that no column's name can clash
    doc_id, key = F.col("row.doc_id").cast("long"), text_key(F.col("row.text").cast("string"))
    doubt = F.arrow_udf(marked, "boolean")(F.pmod(F.xxhash64(F.coalesce(doc_id, F.lit(0))), F.lit(bits))) & doc_id.isNotNull()
    rows = nested.withColumn("doubt", doubt)
    checked = rows.filter("doubt").join(gone, (doc_id == F.col("id")) & (key == F.col("text_key")), "left_anti")
    return rows.filter("not doubt").union(checked).select("row.*")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets reach the similarity, computed exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
                if len(s) > len(t):
                    s, t = t, s
                if 100 * len(s) < percent * len(t):
                    keep.append(False)
                    continue
                at = np.searchsorted(t, s)
                both = int(np.count_nonzero(t[np.minimum(at, len(t) - 1)] == s))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("id").alias(k), F.col("members").alias(m)) for k, m in (("a", "left"), ("b", "right")))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id and the smallest id reachable, of every id in `links` (a, b; a stashed table). Large-star and small-star steps
    (Kiveris et al., 2014) in turn until nothing changes: union-find's joining and path halving for whole tables. Each
    round is a stashed table."""
    edges, seen = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), None
    while True:
        both = with_least(edges.union(edges.select("v", "u")), "u", "v", "m")
        m = F.least("u", "m")
        large = both.filter("v > u").select(F.col("v").alias("u"), m.alias("v"))
        large = large.union(both.filter("v < u").select("u", m.alias("v"))).filter("u <> v").distinct()
        small = with_least(large, "u", "v", "m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(small.select("u", F.col("m").alias("v")))
        edges = stash(small.distinct(), "edges")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = mark


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (doc_id, text; further columns are ignored).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets; component_id is the
    smallest doc_id reachable over links, kept whether it is the row's own. Null and blank texts have the empty set
    and stand alone; so do rows without doc_id, whose component_id is null and which are kept. Repeated rows share a
    component and are all returned; rows of one doc_id with different texts count as one document, linked with all that
    any of them is linked with, but for exact copies, which get their own set's component. An empty table gives no rows.
    """
    return grouped(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicated(docs: DataFrame, percent: int = 85) -> DataFrame:
    """`docs` with one row of each component, that of the smallest doc_id, and all columns. Rows without doc_id stay.

    Of rows of one doc_id with equal sets, that with the smallest text_key stays, once. Where a doc_id stands with
    different sets, links by id can't tell its rows apart: of these only exact copies of smaller ids' sets go.
    """
    found = grouped(docs, percent).filter("doc_id is not null").withColumn("set_key", F.coalesce("set_key", F.lit(b"")))
    found = stash(found.select(F.col("doc_id").alias("id"), "text_key", "set_key", "class", "kept"), "kept")
    again = found.groupBy("id").agg(F.count("*").alias("n"), (F.min("set_key") != F.max("set_key")).alias("several"))
    again = stash(again.filter("n > 1").select("id", "several"), "again")
    if again.isEmpty():
        return without(docs, found.filter("not kept").select("id", "text_key"))
    least = found.join(again, "id").groupBy("id", "set_key", "several").agg(F.min("text_key").alias("least"))
    rows = found.join(least, ["id", "set_key"], "left")
    gone = F.when(F.coalesce("several", F.lit(False)), F.col("class") < F.col("id")).otherwise(~F.col("kept")) | F.coalesce(F.col("text_key") > F.col("least"), F.lit(False))
    nested = without(docs, rows.filter(gone).select("id", "text_key").distinct()).select(F.struct("*").alias("row"))
    repeated = nested.filter("row.doc_id is not null").withColumns({"id": F.col("row.doc_id"), "key": text_key(F.col("row.text"))})
    return repeated.dropDuplicates(["id", "key"]).select("row.*").union(nested.filter("row.doc_id is null").select("row.*"))


def grouped(docs: DataFrame, percent: int) -> DataFrame:
    """The rows of near_duplicates, with text_key, set_key and class, the smallest doc_id whose set is the same (null
    without doc_id)."""
    known = stash(signatures(docs), "signatures")
    full = known.filter("set_key is not null and doc_id is not null").select("doc_id", "set_key")
    later = with_least(full, "set_key", "doc_id", "first").filter("first < doc_id").distinct()
    classes = stash(known.join(later, ["doc_id", "set_key"], "left").withColumn("class", F.coalesce("first", "doc_id")).drop("first"), "classes")
    alone = classes.filter("doc_id = class and n_shingles > 0")
    held = alone.select(F.explode("bands").alias("band"), F.col("doc_id").alias("a"))
    buckets = held.groupBy("band").agg(F.min("a").alias("b"), F.max("a").alias("last")).filter("b <> last").select("band", "b")
    held = stash(held.join(buckets, "band").select("band", "a", "b"), "buckets")
    stars = stash(held.filter("a <> b").select("a", "b").distinct(), "stars")
    sets = stash(full_sets(docs, stars.select(F.col("a").alias("id")).union(stars.select("b")).distinct()), "sets")
    links = stash(verified(stars, sets, percent), "verified")
    found = components(links)

    placed = held.select("band", F.col("a").alias("id")).join(found, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size"), F.min("id").alias("leader")).filter("x <> y and size > 2")
    unsettled = stash(placed.join(mixed.select("band", "size", "leader"), "band"), "open")
    pairs = few_pairs(unsettled.filter(F.col("size") <= SMALL))
    many = unsettled.filter(F.col("size") > SMALL).select("id", "component").distinct()
    if not many.isEmpty():
        pairs = pairs.union(prefix_pairs(many, sets, percent)).distinct()
    more = stash(verified(pairs, sets, percent), "more")
    if not more.isEmpty():
        found = components(stash(links.union(more), "links"))

    of = found.filter("id <> component").select(F.col("id").alias("class"), "component")
    named = with_one(classes.drop("bands"), of, "class", "doc_id").withColumn("component_id", F.coalesce("component", "class")).drop("component")
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def few_pairs(members: DataFrame) -> DataFrame:
    """Pairs of members of one bucket (SMALL at most) that are of different components and not yet compared."""
    of = members.filter("id <> leader").groupBy("band").agg(F.array_sort(F.collect_list(F.struct("id", "component"))).alias("m"))
    one = of.select("m", F.posexplode("m").alias("i", "x"))
    two = one.select("x", F.explode(F.slice("m", F.col("i") + 2, SMALL)).alias("y"))
    return two.filter("x.component <> y.component").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every pair of `members` (id, component) of different components that can reach the similarity: those that
    share one of their n - ceil(percent * n / 100) + 1 rarest shingles (Chaudhuri et al., 2006), at places that leave
    room for enough others (Xiao et al., 2008). Exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.column(2)):
                s = np.frombuffer(row.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(batch.column(j)[i].as_py(), len(s)), pa.int64()) for j in (0, 1)] + [pa.array(np.full(len(s), len(s)), pa.int64()), pa.array(s)],
                    ["id", "component", "n", "item"],
                )

    rows = members.join(sets, "id").select("id", "component", "members").mapInArrow(run, "id long, component long, n long, item long")
    rows = stash(rows, "items")
    common = rows.groupBy("item").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = rows.join(common, "item", "left").select("id", "component", "n", "item", F.coalesce("df", F.lit(1)).alias("df"))
    ordered = ranked.groupBy("id", "component", "n").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("s"))
    keep = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    prefix = ordered.select("id", "component", "n", F.posexplode(F.slice("s", F.lit(1), keep)).alias("at", "p")).filter("p.df > 1")
    prefix = stash(prefix.select("id", "component", "n", "at", F.col("p.item").alias("item")), "prefix")
    left = prefix.select("item", F.col("id").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), (F.col("n") - F.col("at")).alias("ra"))
    right = prefix.select("item", F.col("id").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), (F.col("n") - F.col("at")).alias("rb"))
    # at the first shared shingle, it and all that follow it in either set must suffice for the overlap
    room = F.least("ra", "rb") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    return left.join(right, "item").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & room).select("a", "b").distinct()
