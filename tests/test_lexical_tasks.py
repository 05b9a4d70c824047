"""Documents are scored where they are read: the same rows as by tables of terms, whatever the blocks."""

import random
from collections import Counter

import pytest
from loomgraph.operators import lexical
from pyspark.sql import functions as F


def corpus(spark, kind):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["the", "connections", "connected", "über"]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 5, 30]))) for _ in range(150)]
    texts += [texts[0]] * 20 + ["", None, "nothing else"]
    rows = [(None if i == 7 else i if kind == "long" else f"d{i}", t) for i, t in enumerate(texts)]
    asked = [(f"q{i}", " ".join(rng.choices(words, k=1 + i))) for i in range(6)] + [("none", "zzz"), ("both", "w1 w2")]
    return spark.createDataFrame(rows, f"id {kind}, text string").repartition(5), spark.createDataFrame(asked, "qid string, text string")


@pytest.mark.parametrize("kind", ["long", "string"])
def test_scores_are_those_of_joined_tables(spark, tmp_path, monkeypatch, kind):
    docs, asked = corpus(spark, kind)
    some = docs.filter("id is not null").orderBy("text").limit(60).select("id")
    stored = {a: lexical.Index(docs, str(tmp_path / f"{kind}-{a}"), a) for a in ("simple", "english")}
    got = lambda rows: sorted((tuple(r) for r in rows.select("qid", "id", "score", "rk").collect()), key=str)
    found = {}
    for most, sums in ((lexical.MOST_TERMS, lexical.SUMS), (lexical.MOST_TERMS, 64), (0, 64)):
        monkeypatch.setattr(lexical, "MOST_TERMS", most)  # with 0 the terms are too many for all tasks, and tables are joined
        monkeypatch.setattr(lexical, "SUMS", sums)
        for a, options in (("simple", {"by_tokens": True}), ("simple", {"k": 3, "candidates": some}), ("english", {"every_term": True}))[: 3 if kind == "long" else 1]:
            for what in (docs, stored[a])[: 2 if most else 1]:
                rows = got(lexical.bm25(what, asked, analyser=a, **options))
                assert found.setdefault(str(options), rows) == rows and rows


def test_overlap_counts_distinct_words_and_shuffles_only_the_best(spark, monkeypatch):
    docs, asked = corpus(spark, "long")
    terms = asked.select("qid", F.explode(F.split("text", " ")).alias("term"))
    want = {}
    for q, t in (tuple(r) for r in terms.collect()):
        want.setdefault(q, Counter())[t] += 1
    best = lexical.token_overlap(docs, terms, 4)
    for r in best.collect():
        text = next(t for i, t in ((d.id, d.text) for d in docs.collect()) if i == r.id)
        assert r.score == sum(n for t, n in want[r.qid].items() if t in text.split())
    assert best.groupBy("qid").count().agg(F.max("count")).first()[0] == 4
    sent = []
    cut = lexical.top
    monkeypatch.setattr(lexical, "top", lambda rows, *a, **o: sent.append(rows.count()) or cut(rows, *a, **o))
    lexical.bm25(docs, asked, 2).count()
    assert sent[0] <= 2 * 8 * docs.rdd.getNumPartitions()


def test_a_needle_of_many_is_looked_for_once(spark, monkeypatch):
    texts = spark.createDataFrame([(f"t{i}", f"{w} thing") for i, w in enumerate(["Large ring", "blue ring", "old", None])], "id string, text string")
    asked = spark.createDataFrame([(i, w) for i in range(400) for w in ("RING", "blue")[: 1 + i % 2]] + [(0, "ring"), (1000, "")], "qid long, needle string")
    want = sorted((i, t) for i in range(400) for t in ("t0", "t1"))
    for most in (lexical.MOST_NEEDLES, 1):
        monkeypatch.setattr(lexical, "MOST_NEEDLES", most)
        plan = lexical.holding(texts, asked)
        assert sorted(map(tuple, plan.collect())) == want
    monkeypatch.undo()
    assert "[gram" not in lexical.holding(texts, asked)._jdf.queryExecution().optimizedPlan().toString()  # two needles, not 600
