"""Secret scans: rules find candidates, a character convolutional network judges every one with its context.

Three rules (assignments, access keys, long hex runs) always report. Besides them every run of 16 or more token
characters outside their findings is a candidate, which the network accepts or drops. The tables hold no labelled secrets, so the labelled findings are made from a seed: keys of many shapes and their
look-alikes (long words, paths, URLs, versions, dates, identifiers) in neutral and telling contexts. Of these an eighth is
held out to calibrate the network's output (Platt), and another eighth to set the threshold of its spans: the highest
that keeps RECALL of the true ones that no rule reports, those that are no candidates counted as lost. The rules' own
findings carry a score but need no threshold.
"""

from __future__ import annotations

import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, texts, with_text

KINDS = ("assign", "access", "hex", "cnn")
#: Share of held-out true findings that the threshold must keep.
RECALL = 0.98
#: Findings made for training and calibration.
LABELLED = 6000
SEED = 7
REDACTED = "[REDACTED]"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
SHORTEST = 16

BEFORE, INSIDE, AFTER = 20, 40, 12
LENGTH = BEFORE + INSIDE + AFTER
#: A longer span is judged in windows of INSIDE characters that begin so many apart, the last at its end.
STEP = 8
#: Windows held at once.
HELD = 1 << 14
_code = np.full(256, 1, np.int64)
for _i, _c in enumerate(string.printable):
    _code[ord(_c)] = _i + 2
CODES = len(string.printable) + 2


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) of the rules' findings, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def more_candidates(text: str, base: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int]]:
    """Runs of SHORTEST or more token characters outside the rules' findings; of a run that findings touch, the rest."""
    out, first = [], 0
    for m in RUN.finditer(text):
        a, b = m.span()
        while first < len(base) and base[first][2] <= a:  # both in order, so that each is walked once
            first += 1
        for k in range(first, len(base)):
            s, _, e, _, _ = base[k]  # findings may overlap
            if s >= b:
                break
            if a < e:
                if s - a >= SHORTEST:
                    out.append((a, s))
                a = e
        if b - a >= SHORTEST:
            out.append((a, b))
    return out


def slides(a: int, b: int) -> list[tuple[int, int]]:
    """Spans of at most INSIDE characters that together cover a span."""
    return [(x, x + INSIDE) for x in [*range(a, b - INSIDE, STEP), b - INSIDE]] if b - a > INSIDE else [(a, b)]


def windows(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes and inside-flags of each span of at most INSIDE characters (`slides`), with 20 before and 12 after."""
    codes, inside = np.zeros((len(spans), LENGTH), np.int64), np.zeros((len(spans), LENGTH), np.float32)
    for row, (a, b) in enumerate(spans):
        left, middle, right = text[max(0, a - BEFORE) : a], text[a : min(b, a + INSIDE)], text[b : b + AFTER]
        for at, part in ((BEFORE - len(left), left), (BEFORE, middle), (BEFORE + len(middle), right)):
            codes[row, at : at + len(part)] = _code[np.frombuffer(part.encode("latin-1", "replace"), np.uint8)]
        inside[row, BEFORE : BEFORE + len(middle)] = 1
    return codes, inside


# -- the network

WIDTH, EMBED, FILTERS = 5, 11, 32


class Network:
    """Embedding, one convolution with ReLU, the largest response inside and outside the candidate, a logistic unit."""

    def __init__(self, rng: np.random.Generator):
        draw = lambda *n, s: (rng.standard_normal(n) * s).astype(np.float32)
        self.p = {"e": draw(CODES, EMBED, s=0.3), "w": draw(WIDTH * (EMBED + 1), FILTERS, s=0.15), "b": np.zeros(FILTERS, np.float32), "o": draw(3 * FILTERS, s=0.1), "c": np.zeros(1, np.float32)}
        self.p["e"][0] = 0
        self.scale, self.shift = 1.0, 0.0
        self.threshold = 0.5

    def _forward(self, codes: np.ndarray, inside: np.ndarray):
        x = np.concatenate([self.p["e"][codes], inside[:, :, None]], 2)
        cols = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(x), LENGTH - WIDTH + 1, -1)
        z = cols @ self.p["w"] + self.p["b"]
        act = np.maximum(z, 0)
        flag = inside[:, WIDTH // 2 : LENGTH - WIDTH // 2, None]
        held, near = act * flag, act * (1 - flag)
        count = np.maximum(flag.sum(1), 1)
        pooled = np.concatenate([held.max(1), held.sum(1) / count, near.max(1)], 1)
        return cols, z, flag, held, near, count, pooled, pooled @ self.p["o"] + self.p["c"]

    def logits(self, codes: np.ndarray, inside: np.ndarray) -> np.ndarray:
        parts = [self._forward(codes[i : i + 512], inside[i : i + 512])[-1] for i in range(0, len(codes), 512)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def score(self, codes: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.logits(codes, inside) + self.shift)))

    def gradients(self, codes: np.ndarray, inside: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        cols, z, flag, held, near, count, pooled, out = self._forward(codes, inside)
        d = (1 / (1 + np.exp(-out)) - y) / len(y)
        g = {"o": pooled.T @ d, "c": d.sum(keepdims=True)}
        dp = d[:, None] * self.p["o"]
        f = FILTERS
        da = np.repeat((dp[:, None, f : 2 * f] / count[:, None]), z.shape[1], 1) * flag
        rows, chans = np.arange(len(y))[:, None], np.arange(f)[None]
        da[rows, held.argmax(1), chans] += dp[:, :f] * (held.max(1) > 0)
        da[rows, near.argmax(1), chans] += dp[:, 2 * f :] * (near.max(1) > 0)
        dz = da * (z > 0)
        g["w"] = np.tensordot(cols, dz, ([0, 1], [0, 1]))
        g["b"] = dz.sum((0, 1))
        dx = (dz @ self.p["w"].T).reshape(len(y), z.shape[1], WIDTH, EMBED + 1)[..., :EMBED]
        g["e"] = np.zeros_like(self.p["e"])
        for i in range(WIDTH):
            np.add.at(g["e"], codes[:, i : i + z.shape[1]], dx[:, :, i])
        g["e"][0] = 0
        return g


def best(rows: list[str], spans: list[list[tuple[int, int]]], net: Network) -> list[float]:
    """The largest score in each span, text by text: every character is in one of its windows."""
    out: list[float] = []
    parts, owner = [], []

    def judge() -> None:
        if owner:
            score = net.score(np.concatenate([c for c, _ in parts]), np.concatenate([i for _, i in parts]))
            for k, p in zip(owner, score.tolist(), strict=True):
                out[k] = max(out[k], p)
        parts.clear()
        owner.clear()

    for text, own in zip(rows, spans, strict=True):
        for a, b in own:
            out.append(0.0)
            cut = slides(a, b)
            for i in range(0, len(cut), HELD):
                parts.append(windows(text, cut[i : i + HELD]))
                owner += [len(out) - 1] * len(cut[i : i + HELD])
                if len(owner) >= HELD:
                    judge()
    judge()
    return out


def labelled(rng: np.random.Generator, n: int = LABELLED) -> list[tuple[str, int, int, int, str]]:
    """(text, start, end, label, kind) of made findings; half of them secrets."""
    pick = lambda seq: seq[int(rng.integers(len(seq)))]
    some = lambda alphabet, a, b: "".join(pick(alphabet) for _ in range(int(rng.integers(a, b + 1))))
    low, up, dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
    syllables = [a + b for a in "bcdfghlmnprstvz" for b in "aeiou"] + ["th", "er", "on", "tion", "ing", "heit", "ment", "ción", "sch"]
    word = lambda a=1, b=4: "".join(pick(syllables) for _ in range(int(rng.integers(a, b + 1))))
    prose = lambda: " ".join(word() for _ in range(int(rng.integers(2, 6))))
    b64, mixed = low + up + dig + "+/", low + up + dig
    secret = [
        lambda: some(mixed, 20, 44), lambda: some(b64, 24, 60) + pick(["", "=", "=="]), lambda: some(mixed + "-_", 20, 48),
        lambda: pick(["sk_", "pk_", "ghp_", "xox-", "key-", "tok_", "live_"]) + some(mixed, 18, 40),
        lambda: "eyJ" + some(mixed + "-_", 15, 30) + "." + some(mixed + "-_", 15, 40), lambda: some(up + dig, 20, 32),
        lambda: some("0123456789abcdef", 24, 64), lambda: "AKIA" + some(up + dig, 16, 16), lambda: some(dig + "ABCDEF", 24, 40),
    ]
    plain = [
        lambda: word(7, 10), lambda: word(7, 10).title(), lambda: word(3, 5) + "-" + word(3, 5) + "-" + str(int(rng.integers(100))),
        lambda: "/".join(word(1, 3) for _ in range(5)) + pick(["", ".html", ".py", ".txt"]), lambda: "www." + word(3, 5) + ".com/" + word(2, 4) + "/" + str(int(rng.integers(3000))),
        lambda: "_".join(word(1, 3) for _ in range(4)), lambda: "".join(word(1, 2).title() for _ in range(6)), lambda: "-" * int(rng.integers(16, 60)), lambda: "=" * int(rng.integers(16, 60)),
        lambda: f"{int(rng.integers(1990, 2030))}-{int(rng.integers(10, 13))}-{int(rng.integers(10, 29))}-{word(4, 6)}", lambda: "." * int(rng.integers(16, 40)), lambda: str(int(rng.integers(10**8))) + "." * 10 + str(int(rng.integers(1000))),
        lambda: "v" + ".".join(str(int(rng.integers(30))) for _ in range(3)) + "-" + word(4, 6), lambda: "...".join(word(1, 3) for _ in range(4)), lambda: pick("abcxyzHA01") * int(rng.integers(16, 50)), lambda: (word(1, 1) * 12)[:24] + str(int(rng.integers(10))),
        lambda: some(dig, 16, 20), lambda: word(2, 3).upper() + "_" + word(2, 4).upper() + "_" + word(2, 3).upper(), lambda: word(3, 4) + "." + word(3, 4) + "." + word(2, 3) + str(int(rng.integers(10))), lambda: "+".join(word(1, 3).title() for _ in range(5)),
    ]
    telling = ["token: ", "secret = ", "api_key=", "Authorization: Bearer ", "password: ", "key ", "credentials "]
    out = []
    for i in range(n):
        label = i % 2
        body = pick(secret if label else plain)()
        if len(body) < 16:
            body += pick(plain)() if not label else some(mixed, 16, 20)
        told = rng.random() < (0.3 if label else 0.1)
        left = prose() + " " + (pick(telling) if told else pick(["", "(", '"', "see ", "in "]))
        kind = "hex" if HEX.fullmatch(body) else "access" if ACCESS.fullmatch(body) else "assign" if told else "cnn"
        out.append((left + body + pick([" ", ". ", ") ", '" ', "\n", ""]) + prose(), len(left), len(left) + len(body), label, kind))
    return out


def candidate_scores(rows: list[tuple[str, int, int, int, str]], net: Network) -> list[float | None]:
    """The best score of the candidates that touch each made finding, as a scan finds them: 0 if there are none, None if
    a rule reports it."""
    out: list[float | None] = []
    for text, a, b, _, _ in rows:
        base = base_spans(text)
        spans = [(x, y) for x, y in more_candidates(text, base) if x < b and a < y]
        ruled = any(s < b and a < e for s, _, e, _, _ in base)
        out.append(max(best([text], [spans], net)) if spans else None if ruled else 0.0)
    return out


@lru_cache(1)
def trained(seed: int = SEED, epochs: int = 10) -> Network:
    """The network, its calibration and threshold; the same at every call with the same seed."""
    rng = np.random.default_rng(seed)
    rows = labelled(rng)
    got = [windows(t, [(a, b)]) for t, a, b, _, _ in rows]
    codes, inside = np.concatenate([c for c, _ in got]), np.concatenate([i for _, i in got])
    y, kinds = np.array([r[3] for r in rows], np.float32), np.array([r[4] for r in rows])
    part = rng.random(len(y))
    held, last = part < 0.125, (part >= 0.125) & (part < 0.25)
    net, order = Network(rng), np.flatnonzero(part >= 0.25)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for _ in range(epochs):
        rng.shuffle(order)
        for i in range(0, len(order), 128):
            b, step = order[i : i + 128], step + 1
            for k, g in net.gradients(codes[b], inside[b], y[b]).items():
                m[k] += 0.1 * (g - m[k])
                v2[k] += 0.001 * (g * g - v2[k])
                net.p[k] -= 0.004 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
    out, truth = net.logits(codes[held], inside[held]), y[held]
    for _ in range(300):  # Platt scaling by gradient steps
        d = 1 / (1 + np.exp(-(net.scale * out + net.shift))) - truth
        net.scale, net.shift = net.scale - 0.05 * float((d * out).mean()), net.shift - 0.05 * float(d.mean())
    true = [rows[i] for i in np.flatnonzero(last & (kinds != "assign")) if y[i]]
    own = np.sort([p for p in candidate_scores(true, net) if p is not None])
    net.threshold = float(max(0.02, own[int((1 - RECALL) * len(own))] - 1e-6))
    return net


def found_in(rows: list[str], net: Network) -> list[list[tuple[int, int, int, int, int, float]]]:
    """For each text the spans kept, in order: (start, kind, end, value start, value end, score)."""
    base = [base_spans(t) for t in rows]
    runs = [more_candidates(t, b) for t, b in zip(rows, base, strict=True)]
    spans = [[(s[3], s[4]) for s in b] + r for b, r in zip(base, runs, strict=True)]
    score = best(rows, spans, net)
    out, at = [], 0
    for b, r in zip(base, runs, strict=True):
        own = score[at : at + len(b) + len(r)]
        at += len(own)
        kept = [(*s, p) for s, p in zip(b, own, strict=False)]
        kept += [(x, 3, y, x, y, p) for (x, y), p in zip(r, own[len(b) :], strict=True) if p >= net.threshold]
        out.append(sorted(kept))
    return out


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of kind, start, end, score), n_assign, n_access, n_hex, n_cnn for every row.

    Offsets are code points, ends exclusive. Null and empty texts have no spans. Other columns are ignored; rows without
    doc_id and repeated rows are scanned like others; an empty table gives no rows.
    """
    net = trained()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = found_in(texts(batch.column(1)), net)
        spans = pa.array([[{"kind": KINDS[k], "start": a, "end": b, "score": float(p)} for a, k, b, _, _, p in f] for f in found], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))
        counts = [pa.array([sum(s[1] == k for s in f) for f in found], pa.int64()) for k in range(4)]
        return pa.RecordBatch.from_arrays([batch.column(0), spans, *counts], ["doc_id", "spans", "n_assign", "n_access", "n_hex", "n_cnn"])

    return in_arrow(with_text(docs), run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>, n_assign long, n_access long, n_hex long, n_cnn long", most=1 << 20)


def digests(docs: DataFrame) -> DataFrame:
    """The scan with the rules' spans as a digest and all spans as a string."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda c: F.array_join(F.transform(c, line), ",")
    rows = scanned(docs)
    base = joined(F.filter("spans", lambda s: s["kind"] != "cnn"))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_cnn")


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with each secret's value in `text` replaced, and n_chars, if there, counted anew; a null text stays null."""
    net = trained()
    names, kinds = docs.columns, docs.schema
    low = [n.lower() for n in names]  # as Spark resolves them
    at = low.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.column(at).to_pylist()
        out = []
        for text, found in zip(rows, found_in([t or "" for t in rows], net), strict=True):
            parts, end = [], 0
            for a, b in sorted((s[3], s[4]) for s in found):
                if b <= end:
                    continue
                if a >= end:
                    parts += [text[end:a], REDACTED]
                end = b
            out.append("".join([*parts, text[end:]]) if end else text)
        columns = [pa.array(out, pa.string()) if n == "text" else pa.array([None if t is None else len(t) for t in out], batch.column(i).type) if n == "n_chars" else batch.column(i) for i, n in enumerate(low)]
        return pa.RecordBatch.from_arrays(columns, names)

    return in_arrow(docs, run, kinds, names[at], most=1 << 20)


