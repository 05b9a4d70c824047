"""Quality classifier by attention-based multiple-instance learning (Ilse et al., 2018).

A document is a bag of passages of PASSAGE bytes. Each passage is described by its letters, signs, words and
repetitions, then encoded; gated attention, learned from document labels alone, weighs the passages, and a logistic
unit scores the weighted representation. Everything is trained here in numpy on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, slices, small_batches, stash, text_bytes, with_text
from .near_dup import mix, word_hashes

PASSAGE = 512
#: Labelled documents used for fitting at most, and their passages together: documents enter whole, with every passage,
#: in order of a hash of their ids while both bounds hold; those with over a twentieth of PASSAGES aren't sampled.
#: Scoring knows no bound.
SAMPLE, PASSAGES = 4000, 80_000
THRESHOLD = 0.3
HIDDEN, GATE = 24, 12
STEPS, BATCH, SEED = 500, 256, 11
PIECE = 1 << 19

# classes of bytes: each lower-case letter, then upper case, digits, blanks, line ends, signs, other
_class = np.full(256, 55, np.int64)
_class[97:123] = np.arange(26)
_class[65:91] = 26
_class[48:58] = 27
_class[[32, 9]] = 28
_class[[10, 13]] = 29
for _i, _c in enumerate(".,!?#$%&*|<>/:;=-_()[]{}\"'@"):
    _class[ord(_c)] = 30 + min(_i, 24)
_class[128:] = 56
CLASSES = 57
# coarse classes for pairs: vowel, consonant, upper, digit, blank, line, stop, sign, high
_coarse = np.full(256, 7, np.int64)
_coarse[97:123] = 1
_coarse[[97, 101, 105, 111, 117, 121]] = 0
_coarse[65:91], _coarse[48:58], _coarse[[32, 9]], _coarse[[10, 13]], _coarse[[44, 46]], _coarse[128:] = 2, 3, 4, 5, 6, 8
COARSE = 9
EXTRA = 9
FEATURES = CLASSES + COARSE * COARSE + EXTRA
_blank = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def passages(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage of the texts, and each text's first row (one more than texts). A text
    without bytes is one passage of zeros."""
    sizes = np.diff(off)
    count = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(count)])
    rows = int(first[-1])
    out = np.zeros((rows, FEATURES), np.float32)
    if not len(data):
        return out, first
    of = np.repeat(np.arange(len(sizes)), sizes)
    row = first[of] + (np.arange(len(data)) - off[of]) // PASSAGE
    length = np.maximum(np.bincount(row, minlength=rows), 1)[:, None]
    out[:, :CLASSES] = np.sqrt(np.bincount(row * CLASSES + _class[data], minlength=rows * CLASSES).reshape(rows, -1) / length)
    kind = _coarse[data]
    pair = kind[:-1] * COARSE + kind[1:]
    same = row[:-1] == row[1:]
    out[:, CLASSES : CLASSES + COARSE * COARSE] = np.sqrt(np.bincount((row[:-1] * COARSE * COARSE + pair)[same], minlength=rows * COARSE * COARSE).reshape(rows, -1) / length)
    x = out[:, CLASSES + COARSE * COARSE :]
    full = ~_blank[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    begins = full.copy()
    begins[1:] &= ~full[:-1] | edge[1 : len(data)]
    at = np.flatnonzero(begins)
    if not len(at):
        return out, first
    words, _ = word_hashes(data, off)
    doc, place = of[at], row[at]
    n = np.bincount(place, minlength=rows)
    many = np.maximum(n, 1)
    share = lambda flag, where: np.bincount(where[flag], minlength=rows) / many
    x[:, 0] = np.log1p(n) / 5
    x[:, 1] = np.bincount(row[full], minlength=rows) / many / 10
    x[:, 2] = share(np.concatenate([[False], (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])]), place)
    x[:, 3] = 1 - np.bincount(_firsts(words ^ mix(place.astype(np.uint64)), place), minlength=rows) / many
    x[n == 0, 3] = 0  # whatever else is in the batch
    for i, k in ((4, 1), (5, 3)):  # words, and runs of three, that stood earlier in the document
        runs = words[: len(words) - k + 1].copy()
        for j in range(1, k):
            runs = mix(runs) + words[j : len(words) - k + 1 + j]
        inside = doc[: len(runs)] == doc[k - 1 :]
        keys, where = (runs ^ mix(doc[: len(runs)].astype(np.uint64)))[inside], place[: len(runs)][inside]
        x[:, i] = 1 - np.bincount(_firsts(keys, where), minlength=rows) / np.maximum(np.bincount(where, minlength=rows), 1)
        x[np.bincount(where, minlength=rows) == 0, i] = 0
    upper = (data >= 65) & (data <= 90)
    x[:, 6] = share(upper[at], place)
    ends = np.flatnonzero(full & np.concatenate([~full[1:] | edge[1 : len(data)], [True]]))
    last = _class[data[ends]]
    x[:, 7] = share((last >= 32) & (last < 55), place)
    x[:, 8] = share(last >= 30, place)
    return out, first


def _firsts(keys: np.ndarray, where: np.ndarray) -> np.ndarray:
    """`where` of the first of each of the equal keys."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    return where[order[new]]


class Bags:
    """Encoder, gated attention and scorer; parameters in p."""

    def __init__(self, features: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.mean, self.spread = np.zeros(features, np.float32), np.ones(features, np.float32)
        self.p = {"w": draw(features, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE), "a": draw(GATE, 1), "o": draw(HIDDEN, 1), "c": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, first: np.ndarray):
        p = self.p
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * s @ p["a"])[:, 0]
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
        weight = e / np.add.reduceat(e, first[:-1])[bag]
        z = np.add.reduceat(weight[:, None] * h, first[:-1], axis=0)
        return h, t, s, bag, weight, z, (z @ p["o"] + p["c"])[:, 0]

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6).astype(np.float32)

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.forward(self._scaled(x), first)[-1].astype(np.float64)))

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> Bags:
        self.mean, self.spread = x.mean(0), x.std(0) + 0.02
        x = self._scaled(x)
        p, rng = self.p, np.random.default_rng(SEED)
        m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
        for step in range(1, STEPS + 1):
            chosen = rng.choice(len(y), min(BATCH, len(y)), replace=False)
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in chosen])
            starts = np.concatenate([[0], np.cumsum(first[chosen + 1] - first[chosen])])
            bx = x[rows]
            h, t, s, bag, weight, z, out = self.forward(bx, starts)
            d = ((1 / (1 + np.exp(-out)) - y[chosen]) / len(chosen)).astype(np.float32)
            g = {"o": z.T @ d[:, None], "c": d.sum(keepdims=True)}
            dz = d[:, None] * p["o"][:, 0]
            dh = weight[:, None] * dz[bag]
            dw = (h * dz[bag]).sum(1)
            de = weight * (dw - np.add.reduceat(weight * dw, starts[:-1])[bag])
            g["a"] = (t * s).T @ de[:, None]
            dt, ds = de[:, None] * p["a"][:, 0] * s * (1 - t * t), de[:, None] * p["a"][:, 0] * t * s * (1 - s)
            g["v"], g["u"] = h.T @ dt, h.T @ ds
            dh += dt @ p["v"].T + ds @ p["u"].T
            dh *= 1 - h * h
            g["w"], g["b"] = bx.T @ dh + 1e-4 * p["w"], dh.sum(0)
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                p[k] -= (0.01 * min(1.0, 2 * (1 - step / (STEPS + 1))) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def is_held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = PASSAGES) -> Bags | None:
    """A model from at most `sample` labelled documents that aren't held out and have at most `most` passages together;
    None without any label.

    Labels other than 0 and 1 and those without doc_id are passed over; of several labels of a document the smallest
    counts, and of several texts of one doc_id the first in byte order, so that repeated rows count once.
    """
    usable = labels.filter("quality in (0, 1) and doc_id is not null").filter(~is_held_out()).groupBy("doc_id").agg(F.min("quality").alias("label"))
    usable = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # so few rows may be broadcast
    found = with_text(docs).withColumn("text", F.coalesce("text", F.lit(""))).join(F.broadcast(usable), "doc_id")
    found = stash(found.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "labelled")  # at most `sample` rows
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / PASSAGE))
    so_far = F.sum(count).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = found.filter(count <= most // 20).select("doc_id", so_far.alias("n")).filter(F.col("n") <= most).select("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                x, first = passages(*text_bytes(part.column(1)))
                bags = [x[a:b].astype(np.float16).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(bags, pa.binary())], ["doc_id", "label", "bag"])

    rows = found.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    rows = small_batches(rows).mapInArrow(run, "doc_id long, label int, bag binary").toArrow()
    bags = sorted(zip(*(rows.column(k).to_pylist() for k in range(3)), strict=True))
    if not bags:
        return None
    parts = [np.frombuffer(b, np.float16).reshape(-1, FEATURES).astype(np.float32) for _, _, b in bags]
    first = np.concatenate([[0], np.cumsum([len(a) for a in parts])])
    return Bags(FEATURES).fit(np.concatenate(parts), first, np.array([a for _, a, _ in bags], np.float32))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """`docs` with held_out, score and predicted; the other columns pass through, but for those of these names.

    Null and empty texts are scored as one passage without words. Without any usable label every score is 1, so that
    nothing is rejected. Repeated rows score alike; rows without doc_id aren't held out; no rows give no rows.
    """
    from pyspark.sql import types as T

    model = fitted(docs, labels, sample)
    docs = docs.drop("held_out", "score", "predicted")
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in slices(batch, "text", PIECE):
                score = np.ones(part.num_rows) if model is None else model.score(*passages(*text_bytes(part.column(at))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*names, "score"])
        give_back()

    rows = small_batches(docs).mapInArrow(run, schema)
    return rows.withColumn("held_out", is_held_out()).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
