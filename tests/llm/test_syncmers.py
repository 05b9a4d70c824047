import hashlib
import random
import re

import xxhash
from loomgraph.llm import syncmers
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, kept string, next_text string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(300)) for _ in range(n))


def run(spark, rows):
    return syncmers.fingerprints(spark.createDataFrame([(i, t, "k", "n") for i, t in rows], DOCS)).collect()


def test_edits_as_by_hand_and_likeness(spark):
    rows = [(i * 7, prose(i % 40, 20 + i)) for i in range(60)] + [(1001, None), (1002, ""), (1003, "one"), (1004, "héllo wörld ✓ " * 9)]
    got = {r.doc_id: r for r in run(spark, rows)}
    ids = sorted(i for i, _ in rows)
    text = {i: t or "" for i, t in rows}
    for i, nxt in zip(ids, [*ids[1:], ids[0]], strict=True):
        t, m = text[i], len(text[i]) // 4
        edited = t[: len(t) - m] + text[nxt][:m]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    long = [got[i] for i in ids if got[i].n_chars > 300]
    assert all(r.near_edited > 0.3 > r.near_next for r in long if r.doc_id < 1000)
    assert all(0 <= v <= 1 for r in got.values() for v in (r.near_edited, r.near_next))


def test_equal_texts_repeated_ids_and_rows_without_id(spark):
    rows = [(1, prose(1, 50)), (2, prose(1, 50)), (2, prose(2, 50)), (4, prose(4, 9)), (None, prose(1, 50))]
    got = run(spark, rows)
    assert len(got) == 5
    same = [r.fingerprint for r in got if r.n_chars == len(prose(1, 50))]
    assert len(set(same)) == 1
    assert [r.near_edited > 0 for r in got if r.doc_id is None] == [True]
    assert run(spark, []) == [] and run(spark, [(3, "a b c d e f g h")])[0].near_next == 1.0


def test_many_ranges_follow_in_order(spark, monkeypatch):
    ids = random.Random(3).sample(range(-10_000, 10_000), 500)
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = {r.doc_id: r.next_doc_id for r in syncmers.with_next(df, ["doc_id"]).collect()}
    order = sorted(ids)
    assert got == dict(zip(order, [*order[1:], order[0]], strict=True))


def test_anchors_are_context_free_and_match_by_place(spark):
    middle = prose(9, 60)
    df = spark.createDataFrame([(prose(1, 30) + " " + middle, prose(2, 11) + " " + middle + " " + prose(3, 5))], "a string, b string")
    df = syncmers.with_anchors(syncmers.with_anchors(df, "a", "x"), "b", "y")
    shifts = [m["shift"] for m in df.select(syncmers.matches(F.col("x"), F.col("y")).alias("m")).first().m]
    assert len(shifts) > 15 and set(shifts) == {-19}
    other = syncmers.with_anchors(df.select("a"), "a", "z", k=6, s=3).first().z
    assert 0 < len(other) < 90


def test_long_texts_keep_all_anchors_and_places(spark):
    def own(t):  # anchors by Spark, likeness and matches by hand
        df = spark.createDataFrame([(t,)], "t string")
        return [(x.at, x.hash) for x in syncmers.with_anchors(df, "t", "x").first().x]

    shared = prose(1, 300)
    texts = [prose(2, 2500) + " " + shared, prose(3, 1700) + " " + shared + " " + prose(4, 900)]
    a, b = map(own, texts)
    got = sorted(run(spark, [(1, texts[0]), (2, texts[1])]), key=lambda r: r.doc_id)
    x, y = ({h for _, h in v} for v in (a, b))
    assert len(x) > 1000 and got[0].near_next == got[1].near_next == len(x & y) / len(x | y) > 0
    edited = {h for _, h in own(texts[0][: len(texts[0]) - len(texts[0]) // 4] + texts[1][: len(texts[0]) // 4])}
    assert got[0].near_edited == len(x & edited) / len(x | edited)
    assert got[0].fingerprint == ".".join(f"{h % 2**64:016x}@{i}" for i, h in a)
    df = spark.createDataFrame([(got[0].fingerprint, got[1].fingerprint, "")], "a string, b string, c string")
    r = df.select(*[syncmers.parsed(F.col(c)).alias(c) for c in "abc"]).withColumn("m", syncmers.matches(F.col("a"), F.col("b"))).withColumn("none", syncmers.matches(F.col("a"), F.col("c"))).withColumn("empty", syncmers.matches(F.col("c"), F.col("c"))).first()
    assert [tuple(v) for v in r.a] == a and r.c == r.none == r.empty == []
    place = dict((h, i) for i, h in reversed(b))
    first = {h: i for i, h in reversed(a)}
    assert [tuple(v) for v in r.m] == sorted((i, place[h] - i) for h, i in first.items() if h in place)
    assert sum(v.shift == -800 for v in r.m) > 100


def brute(text, k=5, s=2):
    """Closed syncmers by their definition."""
    signed = lambda x: x - 2**64 if x >= 2**63 else x

    def chained(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest((v % 2**64).to_bytes(8, "little"), seed)
        return signed(seed)

    words = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.findall(r"[^\x20\x09-\x0D]{1,16}", text)]
    out = []
    for i in range(len(words) - k + 1):
        mers = [chained(words[i + j : i + j + s]) for j in range(k - s + 1)]
        if min(mers) in (mers[0], mers[-1]):
            out.append((i, chained(mers[j] for j in sorted({*range(0, k - s, s), k - s}))))
    return out


def test_anchors_by_brute_force(spark):
    texts = [prose(i, n) for i, n in enumerate([5, 6, 7, 40, 400])] + ["x " * 50, "é✓中 " * 9 + "a" * 100, "\t a\nb c  d e f\x0b g", prose(9, 30_000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string")
    got = {r.doc_id: r.x for r in syncmers.with_anchors(rows, "t", "x").collect()}
    for i, t in enumerate(texts):
        assert [(a.at, a.hash) for a in got[i]] == brute(t), t[:40]
