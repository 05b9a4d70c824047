"""Byte-level BPE encoding and decoding as the `tokenizers` library gives them.

A pre-token's bytes form a doubly linked list of symbols, and a priority queue holds the merge ranks of neighbouring
pairs, each rank with the places where it applies. The lowest rank's places are merged from left to right; a place
whose symbols have changed since it was queued is stale and skipped. Decoding concatenates vocabulary strings.

Texts are read window by window, each cut behind a letter and before another kind of code point, where every pre-token
ends; so memory follows the window, or the longest pre-token, but not the text.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator, Sequence
from hashlib import sha256
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import in_arrow, with_text

# The byte alphabet of byte-level BPE, and the pattern of its pre-tokens.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Code points of a window, or a little more: up to the next place where texts can be cut.
WINDOW = 1 << 16
#: Encoded pre-tokens that a worker remembers (up to twice as many), and the longest remembered.
REMEMBERED, LONGEST = 200_000, 64
#: Symbols of a pre-token whose queue is kept by rank.
MANY = 1 << 16


class Bpe:
    """A tokenizer file's vocabulary and merges. `special`: whether its special strings inside texts are its special
    tokens (the library's default) or text like other text. Files with other steps are refused."""

    def __init__(self, path: str, special: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        extra = [t for t in spec["added_tokens"] if not t["special"] or t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model["type"] != "BPE" or odd or extra:
            raise ValueError(f"{path}: not byte-level BPE without normaliser, prefix space and other steps")
        library = Tokenizer.from_file(path)
        self.library = library.pre_tokenizer
        spare = iter(range(256, 512))
        self.byte_of = {chr(b if b in PLAIN else next(spare)): b for b in range(256)}
        vocabulary = model["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: What each id stands for.
        self.strings: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.strings[i] = bytes(self.byte_of[c] for c in token) if all(c in self.byte_of for c in token) else token.encode()
        self.decimals = [str(i) for i in range(len(self.strings))]
        letter = {b: c for c, b in self.byte_of.items()}
        self.first = [vocabulary[letter[b]] for b in range(256)]
        #: Ranks of pairs, times 2 ** 32, so that a place can be added.
        self.rank: dict[tuple[int, int], int] = {}
        self.pairs: list[tuple[int, int, int]] = []
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = vocabulary[left], vocabulary[right]
            self.rank[a, b] = len(self.pairs) << 32
            self.pairs.append((a, b, vocabulary[left + right]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]} if special else {}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.split = regex.compile(PATTERN).findall
        self.end = regex.compile(r"(?<=\p{L})(?=\P{L})").search
        self.assigned: set[str] = set()
        self.known: dict[str, Sequence[int]] = {}
        self.older: dict[str, Sequence[int]] = {}

    # -- encoding

    def windows(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The text in windows; a special string stands alone, with its id."""
        at = 0
        for found in self.specials.finditer(text) if self.specials else ():
            yield from ((w, None) for w in self._cut(text, at, found.start()))
            yield found[0], self.special[found[0]]
            at = found.end()
        yield from ((w, None) for w in self._cut(text, at, len(text)))

    def _cut(self, text: str, at: int, to: int) -> Iterator[str]:
        while to - at > WINDOW:
            found = self.end(text, at + WINDOW, to)
            if not found or found.start() == to:
                break
            yield text[at : found.start()]
            at = found.start()
        if at < to:
            yield text[at:to]

    def unassigned(self, text: str) -> bool:
        """Whether Python's Unicode tables lack a code point, which may be of another kind in the library's tables."""
        new = set(text) - self.assigned
        missing = {c for c in new if unicodedata.category(c) == "Cn"}
        self.assigned |= new - missing
        return bool(missing)

    def pre_tokens(self, text: str) -> list[str]:
        """A window's pre-tokens; the library splits where it may know more code points."""
        if text.isascii() or not self.unassigned(text):
            return self.split(text)
        return [bytes(map(self.byte_of.__getitem__, word)).decode() for word, _ in self.library.pre_tokenize_str(text)]

    def window_ids(self, text: str) -> list[int]:
        """Ids of a window without special tokens."""
        words = self.pre_tokens(text)
        fresh = set(words).difference(self.known)
        long = {}
        if fresh:
            if len(self.known) + len(fresh) > REMEMBERED:
                self.older, self.known = self.known, {}
                fresh = set(words)
            older, known = self.older, self.known
            for w in fresh:
                ids = older.get(w)
                if ids is None:
                    ids = self.merged(w)
                if len(w) <= LONGEST:
                    known[w] = ids
                else:
                    long[w] = ids
        if long:
            return list(chain.from_iterable((long if len(w) > LONGEST else self.known)[w] for w in words))
        return list(chain.from_iterable(map(self.known.__getitem__, words)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable([i] if i is not None else self.window_ids(w) for w, i in self.windows(text)))

    def merged(self, word: str) -> Sequence[int]:
        """Ids of one pre-token: of the pairs in the queue that of the lowest rank merges, the leftmost of equals."""
        symbols = list(map(self.first.__getitem__, word.encode()))
        n = len(symbols)
        if n > MANY:
            return self._merged_long(array("i", symbols))
        get, pairs = self.rank.get, self.pairs
        queue = [r | i for i, r in enumerate(map(get, zip(symbols, symbols[1:]))) if r is not None]  # noqa: B905
        heapify(queue)
        symbols.append(-1)  # stands on both sides of the word; no pair has it
        after, before = list(range(1, n + 2)), list(range(-1, n))
        while queue:
            r = heappop(queue)
            at = r & 0xFFFFFFFF
            a, b, whole = pairs[r >> 32]
            to = after[at]
            if symbols[at] != a or symbols[to] != b:
                continue  # stale
            symbols[at], symbols[to] = whole, -1
            after[at] = to = after[to]
            before[to] = at
            r = get((whole, symbols[to]))
            if r is not None:
                heappush(queue, r | at)
            left = before[at]
            r = get((symbols[left], whole))
            if r is not None:
                heappush(queue, r | left)
        return tuple([s for s in symbols if s >= 0])

    def _merged_long(self, symbols: array) -> array:
        """The same for a long pre-token, in some twenty bytes a symbol: the queue holds each rank once, with its
        places in an array."""
        rank, n = self.rank, len(symbols)
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        queue: list[int] = []
        places: dict[int, array] = {}

        def wait(left: int, right: int) -> None:
            r = rank.get((symbols[left], symbols[right]))
            if r is not None:
                if r not in places:
                    places[r] = array("i")
                    heappush(queue, r)
                places[r].append(left)

        for i in range(n - 1):
            wait(i, i + 1)
        while queue:
            r = heappop(queue)
            a, b, whole = self.pairs[r >> 32]
            turn = np.sort(np.frombuffer(places.pop(r), np.int32))
            for done, at in enumerate(_each(turn), 1):
                to = after[at]
                if symbols[at] != a or to >= n or symbols[to] != b:
                    continue  # stale
                symbols[at], symbols[to] = whole, -1
                after[at] = after[to]
                if after[at] < n:
                    before[after[at]] = at
                    wait(at, after[at])
                if before[at] >= 0:
                    wait(before[at], at)
                if queue and queue[0] < r and done < len(turn):  # a pair that goes first has come up
                    if r not in places:
                        places[r] = array("i")
                        heappush(queue, r)
                    places[r].frombytes(turn[done:].tobytes())
                    break
        return array("i", (s for s in symbols if s >= 0))

    # -- decoding

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def _each(places: np.ndarray) -> Iterator[int]:
    for at in range(0, len(places), WINDOW):
        yield from places[at : at + WINDOW].tolist()


@lru_cache(4)
def bpe(path: str, special: bool = True) -> Bpe:
    return Bpe(path, special)


def encoded(docs: DataFrame, path: str, special: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), decoded (string) for every row; the ids stand in one row, so a text's ids
    have to fit in one. Otherwise as `digests`."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = bpe(path, special)
        ids = [model.encode(t.as_py() or "") for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(map(model.decode, ids), pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return in_arrow(with_text(docs), run, "doc_id long, n_tokens long, ids array<int>, decoded string", most=1 << 20)


def digests(docs: DataFrame, path: str, special: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by commas), decoded_sha256 (of the text that the ids
    give) for every row.

    A null text counts as empty and has no ids. Other columns are ignored; rows without doc_id and repeated rows are
    encoded like others; an empty table gives no rows. `path`: the tokenizer file, which every executor must find there.
    """

    def one(model: Bpe, text: str) -> tuple[int, str, str]:
        n, ids_hash, text_hash, rest = 0, sha256(), sha256(), b""
        for window, special_id in model.windows(text):
            ids = [special_id] if special_id is not None else model.window_ids(window)
            ids_hash.update(("," * (n > 0) + ",".join(map(model.decimals.__getitem__, ids))).encode())
            n += len(ids)
            rest += b"".join(map(model.strings.__getitem__, ids))
            whole = _complete(rest)
            text_hash.update(rest[:whole].decode("utf-8", "replace").encode())
            rest = rest[whole:]
        text_hash.update(rest.decode("utf-8", "replace").encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = bpe(path, special)
        rows = [one(model, t.as_py() or "") for t in batch.column(1)]
        n, ids, decoded = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return in_arrow(with_text(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", most=1 << 20)


def _complete(data: bytes) -> int:
    """Length without the last code point, which may go on in the next window."""
    at = len(data)
    while at and data[at - 1] & 0xC0 == 0x80 and len(data) - at < 3:
        at -= 1
    return max(at - 1, 0)
