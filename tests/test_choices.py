import math
import random
import re

import pytest
from loomgraph import model
from loomgraph.operators import bridges, channels, ingest, lexical, pagerank, ranked, recommend
from loomgraph.sources import store
from pyspark.sql import functions as F


def test_query_variants(spark):
    rows = [("a", " Red lamp, red "), ("b", "Which books did Ann and Bob read"), ("c", "In what order did the translation go"), ("d", "Order of tests"), ("e", None)]
    got = {}
    for r in channels.variants(spark.createDataFrame(rows, "qid string, text string"), most=99, listing=99).orderBy("qid", "variant").collect():
        got.setdefault(r.qid, []).append(r.text)
    assert got["a"] == ["Red lamp, red", "Red", "lamp"]
    # the question's own first word is a name by its capital, as in any model-free reading
    own = ["Which books did Ann and Bob read", "Which", "books", "did", "Ann", "and", "Bob", "read"]
    assert got["b"] == own + ["Which books", "Which read", "Ann books", "Ann read", "Bob books", "Bob read"]
    assert got["c"][-2:] == list(channels.TRANSLATION_ASPECTS[:2]) and got["d"][-2:] == list(channels.BUDGET_ASPECTS[:2]) and "e" not in got
    few = channels.variants(spark.createDataFrame(rows, "qid string, text string"))
    assert {r.qid: r.n for r in few.groupBy("qid").agg(F.count("*").alias("n")).collect()} == {"a": 3, "b": 6, "c": 6, "d": 3}


def chosen_labels(rows, k, weight=0.7):
    left, types, out = sorted(rows, key=lambda r: r[0]), set(), []
    while left and len(out) < k:
        best = max(left, key=lambda r: (round(weight * r[1] - (1 - weight) * len(set(r[2]) & types) / max(1, len(r[2])), 9), [-ord(c) for c in r[0]]))
        left.remove(best)
        out.append(best[0])
        types |= set(best[2])
    return out


def test_mmr_over_all_candidates(spark):
    rng = random.Random(4)
    rows = [(f"u{i % 3}", f"p{i:04d}", rng.randrange(100) / 100, rng.sample(["A", "B", "C", "D"], rng.randint(0, 3))) for i in range(900)]
    got = {}
    for r in recommend.mmr(spark.createDataFrame(rows, "seed string, id string, score double, labels array<string>"), 7).orderBy("seed", "rk").collect():
        got.setdefault(r.seed, []).append(r.id)
    assert got == {u: chosen_labels([r[1:] for r in rows if r[0] == u], 7) for u in ("u0", "u1", "u2")}


def test_five_pools_are_united(spark):
    pool = lambda rows: spark.createDataFrame(rows, "seed string, id string, score double")
    labels = spark.createDataFrame([("a", ["X"]), ("b", ["X"]), ("c", ["Y"]), ("d", ["Y"]), ("hub", ["BRAND"]), ("hub2", ["BRAND"]), ("tag", ["Tag"]), ("ev", ["EVENT", "Z"])], "id string, labels array<string>")
    links = spark.createDataFrame([("u", "hub"), ("u", "hub2"), ("u", "tag"), ("u", "ev"), ("u", "c")], "seed string, id string")
    medoids = recommend.interests(links, labels, 2)
    assert sorted((r.seed, r.medoid) for r in medoids.collect()) == [("u", "hub"), ("u", "tag")]
    siblings = spark.createDataFrame([("hub", "b", 1.0), ("hub", "u", 1.0), ("hub2", "d", 9.0), ("tag", "d", 0.4)], "target string, id string, score double")
    pools = {"synergy": pool([("u", "a", 0.9), ("u", "b", 0.5)]), "asymmetric": pool([("u", "c", 0.7), ("u", "u", 5.0)]), "collaborative": pool([("u", "a", 0.2), ("u", "seen", 3.0)]), "multi_interest": recommend.multi_interest(medoids, siblings), "attribute": pool([("u", "d", 0.1)])}
    seen = spark.createDataFrame([("u", "seen")], "seed string, id string")
    plain = recommend.united(pools, labels, 10, seen, diversify=False).orderBy("rk").collect()
    assert [(r.id, r.score, r.pools) for r in plain] == [("a", 0.9, ["collaborative", "synergy"]), ("b", 0.85, ["multi_interest", "synergy"]), ("c", 0.7, ["asymmetric"]), ("d", 0.34, ["attribute", "multi_interest"])]
    assert [r.id for r in recommend.united(pools, labels, 3, seen).orderBy("rk").collect()] == ["a", "c", "b"]
    degree = spark.createDataFrame([("a", 2), ("b", 14)], "id string, degree long")
    damped = {r.id: r.score for r in recommend.united(pools, labels, 10, seen, degree, diversify=False).collect()}
    assert damped == {"a": 0.45, "b": 0.2125, "c": 0.7, "d": 0.34}


def chosen_facts(facts, most, weight=0.65):
    """In turn, one query's facts as rows (id, score, hub, sessions, kind, bridge, ok)."""
    order = lambda f: (-f[1], f[0])
    if len(facts) <= most:
        return [f[0] for f in sorted(facts, key=order)]
    done = []

    def take(pool, until):
        while pool and len(done) < until:
            hubs, seen = {f[2] for f in done}, {s for f in done for s in f[3]}

            def worth(f):
                other = {"spine": "context", "context": "spine"}.get(f[4])
                if any(d[2] == f[2] and d[4] == other for d in done):
                    return weight * (f[1] + 0.5)
                share = len(set(f[3]) & seen) / max(1, len(f[3]))
                return weight * f[1] - (1 - weight) * (0.55 * (f[2] in hubs) + 0.45 * share)

            best = min(pool, key=lambda f: (-round(worth(f), 9), f[0]))
            pool.remove(best)
            done.append(best)

    plain, spare = [f for f in facts if not f[5]], [f for f in facts if f[5] and f[6]]
    reserve = min(most, max(3, most // 4)) if spare else 0
    take(plain, most - reserve)
    for _ in range(reserve):
        seen = {s for f in done for s in f[3]}
        fresh = {s for f in spare for s in f[3]} - seen
        if not fresh:
            break
        best = min((f for f in spare if min(fresh) in f[3]), key=lambda f: (f[2], f[0]))
        spare.remove(best)
        done.append(best)
    take(plain + spare, most)
    return [f[0] for f in done]


def test_facts_are_diversified_over_all(spark):
    rng = random.Random(6)
    rows = []
    for q, n in (("q0", 5), ("q1", 60), ("q2", 400), ("q3", 40)):
        for i in range(n):
            bridge = q != "q3" and rng.random() < 0.3
            rows.append((q, f"f{i:03d}", rng.randrange(200) / 200, f"h{rng.randrange(9)}", rng.sample([f"s{j}" for j in range(8)], rng.randint(0, 2)), rng.choice(["spine", "context", "other"]), bridge, rng.random() < 0.7))
    df = spark.createDataFrame(rows, "qid string, id string, score double, hub string, sessions array<string>, kind string, bridge boolean, reserve_ok boolean")
    got = {}
    for r in bridges.diversified(df, 8).orderBy("qid", "rk").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got == {q: chosen_facts([r[1:] for r in rows if r[0] == q], 8) for q in ("q0", "q1", "q2", "q3")}


def walked(facts, rounds=20, damping=0.85):
    """One query's masses of nodes, by hand; facts (n, m, b, w1, w2, seed, dist)."""
    edges, seeds = {}, {}
    for n, m, b, w1, w2, seed, dist in facts:
        seeds[seed] = max(seeds.get(seed, 0), 1 / (1 + max(0, round(dist, 3))))
        for x, y, w in ((n, m, w1), (m, b, w2), (n, b, min(w1, w2) / 2)):
            for p in ((x, y), (y, x)):
                edges[p] = max(edges.get(p, 0), w)
    nodes = sorted({x for p in edges for x in p})
    jump = {x: seeds.get(x, 0) / sum(seeds.values()) for x in nodes}
    out = {x: sum(w for (a, _), w in edges.items() if a == x) for x in nodes}
    mass = dict(jump)
    for _ in range(rounds):
        mass = {x: (1 - damping) * jump[x] + damping * sum(mass[a] * w / out[a] for (a, b), w in edges.items() if b == x) for x in nodes}
    return mass


def test_masses_of_all_queries_at_once(spark):
    rng = random.Random(8)
    rows = [(f"q{i % 3}", f"f{i}", f"u{rng.randrange(4)}", f"e{rng.randrange(5)}", f"p{rng.randrange(4)}", 1.0, rng.choice([0.35, 1.0]), rng.randrange(9) / 9) for i in range(60)]
    rows = [(q, i, n, m, b, x, y, b, d) for q, i, n, m, b, x, y, d in rows]
    df = spark.createDataFrame(rows, "qid string, id string, n string, m string, b string, w1 double, w2 double, seed string, dist double")
    got = {(r.qid, r.id): r.mass for r in pagerank.fact_masses(df, store.written).collect()}
    for q in ("q0", "q1", "q2"):
        mass = walked([r[2:] for r in rows if r[0] == q])
        for _, i, n, m, b, *_ in [r for r in rows if r[0] == q]:
            assert abs(got[q, i] - max(mass[n], mass[m], mass[b])) < 1e-9


@pytest.mark.parametrize("most", [300, 0])
def test_texts_that_hold_a_needle(spark, most, monkeypatch):
    monkeypatch.setattr(lexical, "MOST_NEEDLES", most)
    texts = [(1, "Red Lamp"), (2, "lamplight"), (3, "a"), (4, None), (5, "ümläut é"), (6, "xx red lam")]
    asked = [("q", "LAMP"), ("q", "red"), ("r", "a"), ("s", ""), ("t", None), ("u", "ÜM"), ("v", "d l"), ("w", "xx")]
    got = lexical.holding(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(asked, "qid string, needle string")).collect()
    want = {(q, i) for q, n in asked if n for i, t in texts if t and n.lower() in t.lower()}
    assert sorted((r.qid, r.id) for r in got) == sorted(want)


def test_stored_postings_search_alike(spark, tmp_path):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randint(0, 40)))) for i in range(150)], "id long, text string")
    asked = spark.createDataFrame([(q, " ".join(f"w{rng.randrange(60)}" for _ in range(4))) for q in range(9)], "qid long, text string")
    index = lexical.Index(docs, str(tmp_path / "index"))
    for options in ({}, {"every_term": True}, {"by_tokens": True}):
        one, two = (sorted(map(tuple, lexical.bm25(d, asked, **options).select("qid", "id", "score", "rk").collect())) for d in (docs, index))
        assert one == two and (one or options)


def bm25_by_hand(docs, query, k=10):
    """Any term, distinct query terms, lengths in distinct terms."""
    words = {i: t.lower().split() for i, t in docs}
    n, size = len(docs), {i: max(1, len(set(w))) for i, w in words.items()}
    mean = sum(size.values()) / n
    score = {}
    for term in set(query.lower().split()):
        df = sum(term in w for w in words.values())
        for i, w in words.items():
            if term in w:
                tf = w.count(term)
                score[i] = score.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * size[i] / mean))
    return [i for i, _ in sorted(((i, round(s, 6)) for i, s in score.items()), key=lambda x: (-x[1], x[0]))][:k]


def test_passages_of_variants_by_hand(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("red blue lamp chair table book Ann read old new".split()) for _ in range(rng.randint(3, 12)))) for i in range(40)]
    asked = [("a", "red lamp"), ("b", "Which books did Ann read")]
    got = {}
    for r in channels.passages_by_variants(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(asked, "qid string, text string"), 6).orderBy("qid", "rk").collect():
        got.setdefault(r.qid, []).append(r.id)
    variants = {"a": ["red lamp", "red", "lamp"], "b": ["Which books did Ann read", "Which", "books", "did", "Ann", "read"]}
    for q, texts in variants.items():
        score, first = {}, {}
        for no, t in enumerate(texts):
            for rk, i in enumerate(bm25_by_hand(docs, t, 6), 1):
                score[i] = score.get(i, 0) + 1 / (60 + rk)
                first.setdefault(i, (no, rk))
        assert got[q] == sorted(score, key=lambda i: (-round(score[i], 6), first[i]))[:6]


def test_gains_for_all_queries_alike(spark):
    rng = random.Random(5)
    hits = spark.createDataFrame([(q, i, rk, 1.0) for q in range(4) for rk, i in enumerate(rng.sample(range(30), 12), 1)], "qid long, id long, rk int, score double")
    gains = spark.createDataFrame([(i, float(rng.randrange(3))) for i in range(0, 30, 2)], "id long, gain double")
    queries = spark.createDataFrame([(q,) for q in range(6)], "qid long")
    one = ranked.metrics(hits, gains, 5, queries).orderBy("qid").collect()
    assert one == ranked.metrics(hits, queries.crossJoin(gains), 5).orderBy("qid").collect() and len(one) == 6
    none = ranked.metrics(hits, gains.filter("gain > 9"), 5, queries).collect()
    assert {(r.recall, r.mrr, r.ndcg) for r in none} == {(0.0, 0.0, 0.0)}


def test_events_resolve_by_anchors_days_and_names(spark):
    x, y, z = [1.0, 0.0], [0.8, 0.6], [0.0, 1.0]
    new = spark.createDataFrame([("k1", x, "d1"), ("k2", x, None), ("k3", x, "d1"), ("k4", x, "d1"), ("k5", x, "d9")], "key string, embedding array<double>, day string")
    anchors = spark.createDataFrame([("k1", "a"), ("k1", "b"), ("k1", "c"), ("k2", "a"), ("k3", "d"), ("k4", "e"), ("k5", "a")], "key string, anchor string")
    known = spark.createDataFrame([("e1", x, "d1"), ("e2", x, "d1"), ("e3", z, "d1"), ("e4", y, None), ("e5", y, "d1")], "uuid string, embedding array<double>, day string")
    links = spark.createDataFrame([("a", "e1"), ("b", "e1"), ("a", "e2"), ("d", "e3"), ("d", "e4"), ("e", "e4"), ("e", "e5")], "anchor string, uuid string")
    got = {r.key: r.match for r in ingest.resolved_events(new, anchors, known, links).collect()}
    # k1: e2 shares one anchor of three; k2: e1 and e2 alike; k3: e3's name is another; k4: e4 and e5 alike; k5: other days
    assert got == {"k1": "e1", "k3": "e4"}
    asked = spark.createDataFrame([("k1", "u9", "E", "EVENT"), ("k5", "u8", "F", "EVENT")], "key string, uuid string, name string, type string")
    events = spark.createDataFrame(list(got.items()), "key string, match string")
    all_known = spark.createDataFrame([("e1", "other", "EVENT")], "uuid string, name string, type string")
    near = spark.createDataFrame([], "key string, uuid string, sim double")
    assert {r.key: (r.match, r.how) for r in ingest.resolved(asked, all_known, near, events=events).collect()} == {"k1": ("e1", "event"), "k5": (None, "new")}


def test_a_sink_merges_and_keeps_versions(spark, tmp_path):
    sink = store.Sink(spark, f"file://{tmp_path}/t")
    row = lambda *r: spark.createDataFrame(r, "uuid string, at int, v string")
    last = lambda old, new: store.upsert(old, new, "uuid", "at")
    assert sink.read() is None
    sink.write(row(("a", 1, "x"), ("b", 9, "y")), last)
    sink.write(row(("b", 2, "z"), ("c", 3, "w")), last)
    assert sorted(tuple(r) for r in sink.read().collect()) == [("a", 1, "x"), ("b", 2, "z"), ("c", 3, "w")]
    sink.write(row(("a", 5, "q")), last)
    (tmp_path / "t" / "version=00000007").mkdir()  # a write that died
    assert sink.versions() == [1, 2, 3]
    sink.keep(1)
    assert sink.versions() == [3] and sink.read().count() == 3


def test_entities_and_communities_by_hand(spark):
    things = {"h1": ("acme", ["BRAND"]), "h2": ("lamp", ["CATEGORY"]), "h3": ("acme tools", ["BRAND"]), "p1": ("acme lamp one", ["PRODUCT"]), "p2": ("acme chair", ["PRODUCT"]), "p3": ("blue lamp", ["PRODUCT"]), "p4": ("other", ["PRODUCT"]), "ev": ("bought", ["EVENT"])}
    ends = [("p1", "h1"), ("p1", "h2"), ("p2", "h1"), ("p3", "h2"), ("p4", "h3"), ("ev", "h1"), ("ev", "p4")]
    n = model.nodes(spark.createDataFrame([(u, x, name) for u, (name, x) in things.items()], "uuid string, labels array<string>, name string"))
    e = model.edges(spark.createDataFrame([(f"e{i}", a, b) for i, (a, b) in enumerate(ends)], "uuid string, src string, dst string"))
    queries = {"q1": "acme lamp", "q2": "acme"}
    asked = spark.createDataFrame(list(queries.items()), "qid string, text string")

    def named(query, name):  # how far a name is the query's, by its text and by its tokens
        q, tokens = query.lower(), [t for t in dict.fromkeys(re.findall("[a-z0-9]{3,}", query.lower())) if t != query.lower()]
        hits = sum(t in name for t in tokens)
        return (5.0 if name == q else 3.0 if q in name else 0.0) + hits + (hits / len(tokens) if tokens else 0.0) + (0.75 if len(tokens) == 2 and q in name else 0.0)

    def found(query, labels):
        pool = {u: name for u, (name, x) in things.items() if not labels or set(x) & set(labels)}
        terms, out = set(query.split()), {}
        for u, name in pool.items():
            if named(query, name) > 0:
                out[u] = named(query, name)
            if terms <= set(name.split()):  # every term: Okapi over the pool, three at most
                mean = sum(len(set(x.split())) for x in pool.values()) / len(pool)
                idf = [math.log(1 + (len(pool) - d + 0.5) / (d + 0.5)) for d in (sum(t in x.split() for x in pool.values()) for t in terms)]
                bm = sum(i * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(set(name.split())) / mean)) for i in idf)
                out[u] = max(out.get(u, 0), named(query, name) + min(3.0, round(bm, 6)))
        return {u: round(s, 6) for u, s in out.items()}

    for labels in (["PRODUCT"], ["BRAND", "CATEGORY"]):
        got = {(r.qid, r.id): r.score for r in channels.entities(n, asked, 10, labels).collect()}
        assert got == pytest.approx({(q, u): s for q, t in queries.items() for u, s in found(t, labels).items()}, abs=2e-6)
    got = {(r.qid, r.id): r.score for r in channels.communities(n, e, model.adjacency(e), asked, ["BRAND", "CATEGORY"], 10).collect()}
    members, degree = {"h1": ["p1", "p2", "p4"], "h2": ["p1", "p3"], "h3": ["p4"]}, {"h1": 3, "h2": 2, "h3": 1}
    want = {}
    for q, text in queries.items():
        hubs = found(text, ["BRAND", "CATEGORY"])
        kinds = {things[h][1][0] for h in hubs}
        best, of = {}, {}
        for h, s in hubs.items():
            for m in members[h]:
                tokens = [t for t in dict.fromkeys(re.findall("[a-z0-9]{3,}", text)) if t != text]
                share = sum(t in things[m][0] for t in tokens) / len(tokens) if tokens else 0.0
                best[m] = max(best.get(m, 0.0), round(s / math.log2(2 + degree[h]) * (1 + share), 6))
                of.setdefault(m, set()).add(things[h][1][0])
        common = {m for m in best if of[m] == kinds}
        want |= {(q, m): s for m, s in best.items() if not common or m in common}
    assert got == pytest.approx(want, abs=2e-6) and any(q == "q1" for q, _ in want)
