"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one pass over the text.

At each position the automaton's output links give every piece that ends there, and each relaxes the best score at
that position. For unigram models a piece adds its score. A BPE model's scores are merge ranks, whose sum is not what
BPE maximises, so there the pass runs over another score, by a reduction: a way's score is 0 if BPE leaves every two
neighbours of it apart, else minus infinity. If BPE's ids of a prefix end in piece p that begins at i, its ids of the
prefix of length i are the same less p (no merge crosses i), so they are the best way to i; and p alone may follow that
way's last piece, since ids whose neighbours BPE all leaves apart are BPE's ids of their text. Hence one piece relaxes
each position, that one is BPE's last piece there, and reading back gives BPE's ids. Ranks of different pieces must
differ for this. Runs of blanks share the lowest rank; they merge last and leftmost first, which `_run` does.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import give_back, slices, small_batches, texts, with_text

#: Encoded chunks, and pairs of pieces judged, that a worker remembers; of chunks up to twice as many.
REMEMBERED = 200_000
SPACE = "▁"
UNREACHED, SPELT = -2, -1
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


class Pieces:
    """A .model file's pieces. `unigram`: None takes the file's own type."""

    def __init__(self, path: str, unigram: bool | None = None):
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            model = proto.ModelProto.FromString(f.read())
        norm = model.normalizer_spec
        if norm.name != "identity" or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models with identity normalisation and kept white space are supported")
        self.unigram = model.trainer_spec.model_type == 1 if unigram is None else unigram
        self.dummy = norm.add_dummy_prefix
        self.names = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.scores = [p.score for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER)}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == BYTE}
        self.automaton = ahocorasick.Automaton()
        self.whole = set(self.ids)
        if not self.unigram:  # pieces that BPE itself never leaves whole don't enter the automaton
            self.whole = {p for p, i in self.ids.items() if self._merged(p) == [i]}
        for piece in self.whole:
            self.automaton.add_word(piece, (self.ids[piece], len(piece)))
        self.automaton.make_automaton()
        self.worst = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        # what each id stands for; bytes as escapes that UTF-8 puts together again
        self.texts = [chr(int(n[1:-1], 16)) if k == BYTE and n < "<0x80>" else chr(0xDC00 + int(n[1:-1], 16)) if k == BYTE else "" if k in (CONTROL, UNKNOWN) else n for n, k in zip(self.names, self.kinds, strict=True)]
        self.apart: dict[int, bool] = {}
        blanks = {self.scores[i] for p, i in self.ids.items() if set(p) == {SPACE} and len(p) > 1}
        ranks = [self.scores[i] for p, i in self.ids.items() if len(p) > 1 and set(p) != {SPACE}]
        self.level = len(blanks) <= 1 and max(blanks, default=-1e300) < min(ranks, default=0.0)
        spaced = any(SPACE in p[1:] and p.strip(SPACE) for p in self.ids)
        broken = any("\n" in p for p in self.ids if len(p) > 1)
        # chunks that no piece crosses, so that each is encoded alone and remembered
        self.chunks = None if spaced or (self.unigram and model.trainer_spec.byte_fallback is False) else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if broken else f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+").findall

    # -- encoding

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        text = text.replace(" ", SPACE)
        text = SPACE + text if self.dummy else text
        known, out = self.known, []
        for chunk in self.chunks(text) if self.chunks else [text]:
            try:
                out += known[chunk]
            except KeyError:
                out += self._remembered(chunk)
                known = self.known
        return out

    def forget(self) -> None:
        """Gives the memory of chunks back; called at the end of a partition. Judged pairs, fewer and dearer, stay."""
        self.known, self.older = {}, {}

    def _remembered(self, chunk: str) -> tuple[int, ...]:
        """From the older half of the memory, or encoded; kept in the newer half."""
        ids = self.older.get(chunk)
        if ids is None:
            ids = tuple(self._encoded(chunk))
        if len(chunk) <= 64:
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[chunk] = ids
        return ids

    def _encoded(self, chunk: str) -> Iterable[int]:
        if not self.unigram:
            if chunk in self.whole:
                return (self.ids[chunk],)
            if SPACE * 2 in chunk:
                return self._after_blanks(chunk) if self.level and self.chunks else self._merged(chunk)
        return self._path(chunk)

    def _after_blanks(self, chunk: str) -> list[int]:
        """Blanks and what follows them: the last blank merges with the rest first, then those that are left."""
        n = len(chunk) - len(chunk.lstrip(SPACE))
        rest = list(self._remembered(chunk[n - 1 :])) if n < len(chunk) else []
        if rest and self.names[rest[0]] == SPACE:
            return [*self._run(n), *rest[1:]]
        return [*self._run(n - 1 if rest else n), *rest]

    def _run(self, n: int) -> list[int]:
        """BPE of n blanks: of pairs of one rank the leftmost merges, so all left of the first pair stays."""
        done: list[int] = []
        for _ in range(n):
            done.append(1)
            while len(done) > 1 and SPACE * (done[-2] + done[-1]) in self.ids:
                done[-2:] = [done[-2] + done[-1]]
        return [self.ids[SPACE * k] for k in done]

    def _path(self, text: str) -> list[int]:
        """The pass. last[i] is the piece by which the best way to position i ends, UNREACHED or SPELT."""
        n = len(text)
        last, length = [UNREACHED] * (n + 1), [1] * (n + 1)
        last[0] = SPELT
        if self.unigram:
            self._best_sums(text, last, length)
        else:
            apart = self.apart
            for end, (piece, size) in self.automaton.iter(text):
                at = end + 1
                if last[at] >= 0:
                    continue
                before = last[at - size]
                if before >= 0:  # a code point without a piece, spelt in bytes, stands apart from any
                    ok = apart.get(before << 20 | piece)
                    if not (self._apart(before, piece) if ok is None else ok):
                        continue
                last[at], length[at] = piece, size
        ids: list[int] = []
        at = n
        while at:
            if last[at] >= 0:
                ids.append(last[at])
            else:
                ids += reversed(self._spelt(text[at - 1]))
            at -= length[at]
        return ids[::-1]

    def _best_sums(self, text: str, last: list[int], length: list[int]) -> None:
        """Relaxes sums of scores; a code point without a piece is spelt at the cost of `worst`."""
        best, scores, ready = [-1e300] * len(last), self.scores, 0
        best[0] = 0.0
        for end, (piece, size) in self.automaton.iter(text):
            while ready <= end:
                ready += 1
                if ready <= end and last[ready] == UNREACHED:
                    last[ready], best[ready] = SPELT, best[ready - 1] + self.worst
            score = best[end + 1 - size] + scores[piece]
            if score > best[end + 1]:
                best[end + 1], last[end + 1], length[end + 1] = score, piece, size
        for at in range(1, len(last)):
            if last[at] == UNREACHED:
                last[at], best[at] = SPELT, best[at - 1] + self.worst

    def _apart(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two pieces apart."""
        if len(self.apart) >= 2 * REMEMBERED:
            self.apart.clear()
        found = self.apart[left << 20 | right] = self._merged(self.names[left] + self.names[right]) == [left, right]
        return found

    def _spelt(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def _merged(self, text: str) -> list[int]:
        """BPE by its definition: again and again the best-scored pair, the leftmost of equals."""
        ids, scores, parts = self.ids, self.scores, list(text)
        ranks = [scores[i] if (i := ids.get(a + b)) is not None else None for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            at, top = -1, -1e300
            for i, r in enumerate(ranks):
                if r is not None and r > top:
                    at, top = i, r
            if at < 0:
                return [j for p in parts for j in ([ids[p]] if p in ids else self._spelt(p))]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            for i in (at - 1, at):
                if 0 <= i < len(ranks):
                    ranks[i] = scores[j] if (j := ids.get(parts[i] + parts[i + 1])) is not None else None

    # -- decoding

    def decode(self, ids: Iterable[int]) -> str:
        text = "".join(map(self.texts.__getitem__, ids))
        if not text.isascii():
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return (text[1:] if self.dummy and text[:1] == SPACE else text).replace(SPACE, " ")


@lru_cache(2)
def pieces(path: str, unigram: bool | None = None) -> Pieces:
    return Pieces(path, unigram)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), restored for every row: the ids of the whole text, and whether decoding
    them gives the text back (U+2581 in a text comes back as a space, as in the library).

    A null text counts as empty and has no ids. Other columns are ignored; rows without doc_id and repeated rows are
    encoded like others; an empty table gives no rows. `path`: the .model file, which every executor must find there.
    """

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = pieces(path)
        rows = texts(batch.column(1))
        ids = [model.encode(t) for t in rows]
        restored = [model.decode(i) == t.replace(SPACE, " ") for i, t in zip(ids, rows, strict=True)]
        off = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
        flat = np.frombuffer(b"".join([array("i", i).tobytes() for i in ids]), np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off), pa.int64()), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat)), pa.array(restored)], ["doc_id", "n_tokens", "ids", "restored"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield one(part)
        pieces(path).forget()
        give_back()

    return small_batches(with_text(docs)).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, restored boolean")
