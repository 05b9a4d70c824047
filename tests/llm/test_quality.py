import random
import zlib

import numpy as np
from loomgraph.llm import quality as q

rng = random.Random(0)
VOWELS = [a + b for a in "bdfklmnprst" for b in "aeiou"]
good = lambda: " ".join("".join(rng.choice(VOWELS) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 200))) + "."
bad = lambda: rng.choice([lambda: " ".join(w + rng.choice(["###", "%%%"]) for w in good().split()), lambda: " ".join(["Buba"] * rng.randint(40, 300)), lambda: good().upper().replace(" ", "!! ")])()


def tables(spark, n=400):
    rows = [(i, (good if i % 3 else bad)(), 0.5, "l") for i in range(n)]
    docs = spark.createDataFrame([*rows, (n, None, 0.1, None), (n + 1, "", 0.1, None), (None, good(), 0.1, None), (1, rows[1][1], 0.5, "l")], "doc_id long, text string, label double, bag string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(n)] + [(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy_and_every_row_scored(spark):
    docs, labels = tables(spark)
    got = q.scored(docs, labels).collect()
    assert len(got) == docs.count() and got[0].asDict().keys() >= {"doc_id", "text", "label", "bag", "score", "held_out", "predicted"}
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_held_out_labels_are_never_learnt(spark):
    docs, labels = tables(spark)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality", "toxic")
    one, two = (sorted((str(r.doc_id), r.score) for r in q.scored(docs, x).collect()) for x in (labels, flipped))
    assert one == two


def test_no_labels_no_rows(spark):
    docs, labels = tables(spark, 20)
    assert {r.predicted for r in q.scored(docs, labels.limit(0)).collect()} == {1}
    assert q.scored(docs.limit(0), labels).count() == 0


def described(text: bytes) -> list[list[float]]:
    """The features of a text's passages, one by one and word by word."""
    letter = lambda b: int(q._class[b])
    blank = lambda b: b in b" \t\n\x0b\x0c\r"
    words, at = [], 0  # (first byte, last byte, lower-cased word)
    while at < len(text):
        end = at
        while end < len(text) and not blank(text[end]):
            end += 1
        if end > at:
            words.append((at, end - 1, text[at:end].lower()))
        at = end + 1
    seen = {1: set(), 3: set()}
    new = {1: [], 3: []}
    for k in seen:
        for i in range(len(words) - k + 1):
            run = tuple(w for _, _, w in words[i : i + k])
            new[k].append(run not in seen[k])
            seen[k].add(run)
    out = []
    for a in range(0, max(1, len(text)), q.PASSAGE):
        part, inside = text[a : a + q.PASSAGE], [i for i, (s, _, _) in enumerate(words) if a <= s < a + q.PASSAGE]
        n, row = len(inside), [0.0] * q.FEATURES
        for b in part:
            row[letter(b)] += 1 / len(part)
        for x, y in zip(part, part[1:], strict=False):
            row[q.CLASSES + int(q._coarse[x]) * q.COARSE + int(q._coarse[y])] += 1 / len(part)
        row = [v**0.5 for v in row]
        if words:
            many = max(n, 1)
            twice = sum(i > 0 and words[i][2] == words[i - 1][2] for i in inside)
            late = lambda k: 0.0 if not (own := [new[k][i] for i in inside if i < len(new[k])]) else 1 - sum(own) / len(own)
            first = len({words[i][2] for i in inside})
            x = [np.log1p(n) / 5, sum(not blank(b) for b in part) / many / 10, twice / many, 1 - first / many if n else 0.0, late(1), late(3), sum(65 <= text[words[i][0]] <= 90 for i in inside) / many]
            last = [letter(text[words[i][1]]) for i in inside]
            row[-q.EXTRA :] = [*x, sum(32 <= c < 55 for c in last) / many, sum(c >= 30 for c in last) / many]
        out.append(row)
    return out


def test_passages_and_scores_by_brute_force():
    texts = [b"", b" ", b"one", b"Aa aa b  b, c!\n", " ".join(good() for _ in range(6)).encode(), "é中🙂 x ".encode() * 200, b"\n\t word word word " * 90, good().upper().encode()]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    x, first = q.passages(np.frombuffer(b"".join(texts), np.uint8), off)
    want = [described(t) for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in want]
    np.testing.assert_allclose(x, np.array([r for w in want for r in w]), atol=2e-6)
    model = q.Bags(q.FEATURES)
    p = model.p
    for got, rows in zip(model.score(x, first), want, strict=True):
        h = [np.tanh(np.clip(np.array(r), -6, 6) @ p["w"] + p["b"]) for r in rows]
        e = [float((np.tanh(v @ p["v"]) / (1 + np.exp(-(v @ p["u"]))) @ p["a"])[0]) for v in h]
        weight = np.exp(e) / np.exp(e).sum()
        assert abs(got - 1 / (1 + np.exp(-float(sum(w * v for w, v in zip(weight, h, strict=True)) @ p["o"][:, 0] + p["c"][0])))) < 1e-5


def test_repeated_rows_and_very_long_texts(spark):
    docs, labels = tables(spark)
    model = q.fitted(docs, labels)
    again = q.fitted(docs.union(docs).union(docs), labels)
    assert all((model.p[k] == again.p[k]).all() for k in model.p)
    long = spark.createDataFrame([(9999, " ".join(["Buba ###"] * 200_000), 0.0, "l"), (9998, (good() + " ") * 2000, 0.0, "l")], docs.schema)
    got = {r.doc_id: r.predicted for r in q.scored(docs.union(long), labels).filter("doc_id > 9000").collect()}
    assert got == {9999: 0, 9998: 1}


def test_gradients_by_learning_one_bad_passage():
    """A bag is bad if one of its passages is: attention has to find it."""
    r = np.random.default_rng(2)
    sizes = r.integers(2, 9, 600)
    first = np.concatenate([[0], np.cumsum(sizes)])
    x = r.standard_normal((first[-1], 10)).astype(np.float32)
    y = (r.random(600) < 0.5).astype(np.float32)
    for i in np.flatnonzero(y):
        x[first[i] + r.integers(sizes[i]), 3] += 6
    model = q.Bags(10).fit(x[: first[500]], first[:501], y[:500])
    test = np.concatenate([[0], np.cumsum(sizes[500:])])
    score = model.score(x[first[500] :], test)
    assert ((score > 0.5) == y[500:]).mean() > 0.9
    weight = model.forward(model._scaled(x[first[500] :]), test)[4]
    lit = x[first[500] :, 3] > 4
    assert weight[lit].mean() > 2 * weight[~lit].mean()
