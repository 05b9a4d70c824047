import hashlib
import math
from collections import defaultdict

import pytest
from loomgraph.llm import mixing

DOCS = "doc_id long, text string, source string, rate double, copies string"


def by_hand(sizes):
    """Sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped, target = sum(sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = [s for s in free if target[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return target
        capped |= set(over)


def rows_of():
    rows, n = [], 0
    for s, (count, words) in {"b": (40, 3), "a": (3, 2), "ä": (400, 9), "z": (30, 5), None: (7, 1), "c": (200, 4)}.items():
        for i in range(count):
            rows.append((n, " ".join(["w"] * (words + i % 3)) + " ", s, 1.0, "x"))
            n += 1
    return [*rows, (n, None, "a", 1.0, None), (n + 1, " \t ", "zero", 1.0, None), (None, "no id", "b", 1.0, None)]


def test_targets_as_by_hand(spark):
    rows = rows_of()
    got = mixing.taken(spark.createDataFrame(rows, DOCS)).collect()
    sizes, source = defaultdict(int), {}
    for i, t, s, *_ in rows:
        sizes[s] += len((t or "").split())
        source[i] = s
    want = by_hand(dict(sizes))
    assert len(got) == len(rows)
    for r in got:
        assert math.isclose(r.target, want[source[r.doc_id]], rel_tol=1e-9, abs_tol=1e-9) and r.source_size == sizes[source[r.doc_id]]
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
    for s in want:
        took = sum(r.taken for r in got if source[r.doc_id] == s)
        assert abs(took - want[s]) <= max(r.size for r in got if source[r.doc_id] == s) + 1e-6


@pytest.mark.parametrize("most", [50_000, 0])
def test_sources_come_to_their_targets_within_their_largest_document(spark, data, most, monkeypatch):
    """By brute force: documents in hash order on a circle that the source's hash turns, the copy taken where a document's
    middle comes to lie among the words wanted. With a broadcast table of sources and without."""
    monkeypatch.setattr(mixing, "MOST_ROWS", most)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = mixing.taken(docs).collect()
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    per = defaultdict(list)
    for r in got:
        per[source[r.doc_id]].append(r)
    for rows in per.values():
        size, target = rows[0].source_size, rows[0].target
        assert abs(sum(r.taken for r in rows) - target) <= max(r.size for r in rows) + 1e-6
        rate = min(target / size, 3.0)
        before, wanted = 0, (rate - math.floor(rate)) * size
        name = "null" if source[rows[0].doc_id] is None else f"of:{source[rows[0].doc_id]}"
        turn = int(hashlib.md5(f"42:source:{name}".encode()).hexdigest()[:13], 16) / 2**52
        for _, r in sorted((int(hashlib.md5(f"42:{r.doc_id}".encode()).hexdigest()[:13], 16), r) for r in rows):
            assert r.taken == r.size * (math.floor(rate) + ((before + r.size / 2 + turn * size) % size < wanted))
            before += r.size


def test_copies_equal_the_plan_and_reruns_agree(spark):
    df = spark.createDataFrame(rows_of(), DOCS)
    one, two = (sorted(map(str, mixing.taken(df.repartition(n)).collect())) for n in (2, 7))
    assert one == two
    copies = mixing.mixed(df)
    assert copies.columns == df.columns
    words = copies.select(mixing.size(copies["text"]).alias("n")).groupBy().sum("n").first()[0]
    assert words == sum(r.taken for r in mixing.taken(df).collect())


def test_empty_table_and_no_words(spark):
    assert mixing.taken(spark.createDataFrame([], DOCS)).count() == 0
    blank = [(i, " ", "a", 0.0, None) for i in range(40)] + [(40, "x y z", "b", 0.0, None)]
    assert mixing.mixed(spark.createDataFrame(blank, DOCS)).filter("source = 'a'").count() == 0
    assert [r.taken for r in mixing.taken(spark.createDataFrame([(1, None, "a", 0.0, None)], DOCS)).collect()] == [0]


def test_each_document_is_copied_with_the_fraction_as_probability(spark):
    """Over 2,000 seeds, all sources of one table: one document alone, one with 60 % of the words, small ones."""
    seeds, frac = 2000, {"alone": 0.3, "heavy": 0.25}
    sizes = {"alone": [10], "heavy": [60, *[4] * 10]}
    rows = [(1000 * k + i, n, f"{s}{k}", s) for k in range(seeds) for s, ns in sizes.items() for i, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "doc_id long, size long, source string, kind string")
    df = df.withColumn("hash", mixing.hashed(df.doc_id, df.source, 7))
    real = mixing.shares
    try:
        rate = mixing.F.when(mixing.F.col("source").startswith("alone"), frac["alone"]).otherwise(frac["heavy"])
        mixing.shares = lambda sums, *_: sums.withColumn("rate", rate).withColumn("target", rate * sums["source_size"])
        table = mixing.decided(df, seed=7).withColumnRenamed("source", "_source")
    finally:
        mixing.shares = real
    got = mixing.with_source(df, table, "_source", "source", df.hash).withColumn("n", mixing.copies(mixing.F.col("hash"))).collect()
    assert len(got) == len(rows)
    for kind, size in (("alone", 10), ("heavy", 60), ("heavy", 4)):
        ns = [r.n for r in got if r.kind == kind and r.size == size]
        sigma = math.sqrt(frac[kind] * (1 - frac[kind]) / seeds)  # small ones of a source depend on each other
        assert abs(sum(ns) / len(ns) - frac[kind]) < 4 * sigma, (kind, size, sum(ns) / len(ns))
