"""Alignment of two tokenizers' tokens over each document.

Python tokenises, and each word once: a text is cut where both tokenizers end anyway. It gives ids and where tokens end.
All ends of either tokenizer cut the text into cells, and an end is told as the number of its cell and whether the other
tokenizer ends there, too. Groups and links are Spark's higher-order functions over these: ends of both cut groups, and
each cell is one link, since two tokens overlap in one range at most. Groups recur, so a row is a block of texts: the
ids and ends of every distinct group once, and each text as the groups' numbers, which are looked up.
Texts are tokenised in windows, so no array follows the longest text.

How often a pair of ids is linked is counted over the corpus, a document once. The most frequent pairs, a bounded
number, are broadcast to the links; the rest, which no document-heavy key is among, are joined by shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as proto

from .bpe import PATTERN, Bpe
from .common import give_back, slices, small_batches, stash, with_text

#: Code points of a window, or more: up to the next place where both tokenizers end.
WINDOW = 1 << 15
#: Groups of a block, or one window's.
SENT = 1 << 18
#: Code points whose words are looked up at once.
READ = 1 << 20
#: Words, and distinct groups, that a worker remembers from block to block, and code points of these words.
WORDS, GROUPS, CHARS = 150_000, 100_000, 4 << 20
#: Pairs that are broadcast, at most.
BROADCAST = 1_000_000
BYTE, UNKNOWN, CONTROL = 6, 2, 3

_IDS = T.ArrayType(T.IntegerType(), False)
_WINDOW = T.StructType([T.StructField(n, t) for n, t in (("row", T.LongType()), ("doc_id", T.LongType()), ("part", T.IntegerType()), ("parts", T.IntegerType()), ("n_a", T.LongType()), ("n_b", T.LongType()), ("groups", _IDS))])
BLOCKS = T.StructType([T.StructField(n, t) for n, t in (("a", _IDS), ("a_marks", _IDS), ("b", _IDS), ("b_marks", _IDS), ("windows", T.ArrayType(_WINDOW, False)))])


class Both:
    """The two tokenizers: ids of a window, and where its tokens end."""

    def __init__(self, a_path: str, b_path: str):
        self.bpe = Bpe(a_path, special=False)
        results = [whole for _, _, whole in self.bpe.pairs]
        own = len(self.bpe.first) + len(results)
        self.fast = None
        if results == sorted(set(results)) and max(self.bpe.first) < min(results):  # an id is its rank
            ranks = {self.bpe.strings[i]: i for i in [*self.bpe.first, *results]}
            self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == own else None
        with open(b_path, "rb") as f:
            model = proto.ModelProto.FromString(f.read())
        norm = model.normalizer_spec
        crossing = any("▁" in p.piece[1:] and p.piece.strip("▁") for p in model.pieces if p.type not in (BYTE, UNKNOWN, CONTROL))
        if norm.name != "identity" or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or crossing:
            raise ValueError(f"{b_path}: not identity normalisation, kept white space, a prefix and pieces within words")
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.b_strings = [bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else p.piece.replace("▁", " ").encode() for p in model.pieces]
        self.a_lengths = np.array([len(s) for s in self.bpe.strings])
        self.b_lengths = np.array([len(s) for s in self.b_strings])
        self.cut = regex.compile(r"(?<=\p{L}) ").search

    def windows(self, text: str, size: int = WINDOW) -> Iterator[str]:
        """The text in windows, without the space before each: before a space behind a letter every token of either
        kind ends, and either takes a space before its text."""
        at = 0
        while len(text) - at > size:
            found = self.cut(text, at + size)
            if not found:
                break
            yield text[at : found.start()]
            at = found.end()
        yield text[at:]

    def a_ids(self, text: str) -> list[int] | np.ndarray:
        """An array from the fast way, whose tokens are always the text's bytes."""
        if self.fast is None or (not text.isascii() and self.bpe.unassigned(text)):
            return self.bpe.encode(text)
        return self.fast.encode_to_numpy(text, disallowed_special=())

    def tokens(self, text: str, size: int = WINDOW) -> list[tuple[np.ndarray, ...]]:
        """a, a_ends, b, b_ends of each window; nothing if the tokens' bytes aren't the text's."""
        if not text:
            return []
        out = []
        for window in self.windows(text, size):
            out.append(self.window(window))
            if out[-1] is None:
                return []
        return out

    def window(self, window: str) -> tuple[np.ndarray, ...] | None:
        spaced = " " + window
        a, b, data = self.a_ids(spaced), self.pieces.encode(window) if window else self._blank(), spaced.encode()
        if b"".join(map(self.b_strings.__getitem__, b)) != data or (isinstance(a, list) and b"".join(map(self.bpe.strings.__getitem__, a)) != data):
            return None
        a_, b_ = np.asarray(a).astype(np.int32), np.array(b, np.int32)
        return a_, np.cumsum(self.a_lengths[a_], dtype=np.int32), b_, np.cumsum(self.b_lengths[b_], dtype=np.int32)

    def _blank(self) -> list[int]:
        """One space: a text that ends in a space behind a letter, cut there."""
        return [self.pieces.piece_to_id("▁")]


def marked(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """a, a_marks, b, b_marks: each end as its cell's number, from 1, times 4, and 1 if a ends there, 2 if b does."""
    bits = np.zeros(max(a_ends[-1:].tolist() + b_ends[-1:].tolist(), default=0) + 1, np.int32)
    bits[a_ends] |= 1
    bits[b_ends] |= 2
    marks = np.cumsum(bits > 0, dtype=np.int32) * 4 + bits
    return a, marks[a_ends], b, marks[b_ends]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class Ragged:
    """Arrays of any length, by number."""

    def __init__(self):
        self.flat, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths, dtype=np.int64) - lengths])
        self.flat, self.lengths = np.concatenate([self.flat, flat.astype(np.int32)]), np.concatenate([self.lengths, lengths.astype(np.int32)])

    def get(self, numbers: np.ndarray) -> np.ndarray:
        return self.flat[ranges(self.starts[numbers], self.lengths[numbers])]


class Numbers(dict):
    """Numbers keys as they come; `new` has those since it was last emptied."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Memory:
    """Words as numbers of groups, and groups as ids of both tokenizers; each word is tokenised once."""

    #: Before a space behind these both tokenizers end: letters and others that no table takes for white space.
    split = re.compile(r" (?<=[\w!-~] )").split
    safe = re.compile(r"[\w!-~]\Z").search

    def __init__(self, tokenizers: Both):
        self.of, self.words, self.groups = tokenizers, Numbers(), Numbers()
        self.in_word, self.a, self.b = Ragged(), Ragged(), Ragged()
        self.counts = np.zeros((0, 2), np.int64)  # tokens of either kind; -1 where the tokens' bytes aren't the word's
        self.chars = 0

    def full(self) -> bool:
        return len(self.words) > WORDS or len(self.groups) > GROUPS or self.chars > CHARS

    def read(self, texts: list[str]) -> list[tuple[int, int, np.ndarray]]:
        """n_a, n_b and the groups of each text; n_a below 0 if it has no tokens."""
        if not texts:
            return []
        words, sizes, alone = [], [], set()
        for text in texts:
            own = self.split(text)
            words += own
            sizes.append(len(own))
            if not self.safe(own[-1]):
                alone.add(own[-1])
        numbers = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        del words
        new, self.words.new = self.words.new, []
        self.chars += sum(map(len, new))
        # a stretch of words that are tokenised together ends before and behind one that none may follow
        at = 0
        for k in [i for i, w in enumerate(new) if w in alone] if alone else []:
            self._learn(new[at:k])
            self._learn(new[k : k + 1])
            at = k + 1
        self._learn(new[at:])
        to = np.cumsum(sizes)
        lengths = np.concatenate([[0], np.cumsum(self.in_word.lengths[numbers], dtype=np.int64)])[np.concatenate([[0], to])]
        groups, counts = self.in_word.get(numbers), self.counts[numbers]
        bad, sums = np.add.reduceat(counts[:, 0] < 0, to - sizes), np.add.reduceat(counts, to - sizes)
        return [(-1 if bad[i] else int(sums[i, 0]), int(sums[i, 1]), groups[lengths[i] : lengths[i + 1]]) for i in range(len(texts))]

    def _learn(self, words: list[str]) -> None:
        """Groups and counts of words, any of which but the last may stand before a space."""
        if not words:
            return
        text = " ".join(words)
        windows = self.of.tokens(text) if text else [self.of.window("")]
        if not windows:
            if len(words) > 1:
                self._learn(words[: len(words) // 2])
                self._learn(words[len(words) // 2 :])
            else:
                self._know(np.zeros(0, np.int32), np.zeros(1, np.int64), np.full((1, 2), -1))
            return
        shifts = np.cumsum([0, *(int(w[1][-1]) for w in windows)])
        a, b = (np.concatenate([w[k] for w in windows]) for k in (0, 2))
        a_ends, b_ends = (np.concatenate([w[k] + s for w, s in zip(windows, shifts, strict=False)]) for k in (1, 3))
        ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
        to = np.cumsum([len(w.encode()) + 1 for w in words] if not text.isascii() else [len(w) + 1 for w in words])
        groups = self._number(a, np.searchsorted(a_ends, ends) + 1, b, np.searchsorted(b_ends, ends) + 1)
        counts = [np.diff(np.searchsorted(x, to, "right"), prepend=0) for x in (ends, a_ends, b_ends)]
        self._know(groups, counts[0], np.stack(counts[1:], 1))

    def _know(self, groups: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> None:
        self.in_word.add(groups, lengths)
        self.counts = np.concatenate([self.counts, counts])

    def _number(self, a: np.ndarray, a_to: np.ndarray, b: np.ndarray, b_to: np.ndarray) -> np.ndarray:
        """Numbers of the groups that end before these places in a and b. A group is known by its ids alone, since they
        say where tokens end."""
        a_n, b_n = np.diff(a_to, prepend=0), np.diff(b_to, prepend=0)
        out, known = np.empty(len(a_to), np.int64), len(self.groups)
        one = (a_n == 1) & (b_n == 1)
        keys, back = np.unique((a[a_to[one] - 1].astype(np.int64) << 32) + b[b_to[one] - 1], return_inverse=True)
        out[one] = np.fromiter(map(self.groups.__getitem__, keys.tolist()), np.int64, len(keys))[back]
        rest = np.flatnonzero(~one)
        a_bytes, b_bytes = a.astype(np.int32).tobytes(), b.astype(np.int32).tobytes()
        spans = zip(((a_to - a_n)[rest] * 4).tolist(), (a_to[rest] * 4).tolist(), ((b_to - b_n)[rest] * 4).tolist(), (b_to[rest] * 4).tolist(), strict=True)
        out[rest] = np.fromiter((self.groups[a_bytes[i:j], b_bytes[k:m]] for i, j, k, m in spans), np.int64, len(rest))
        new, self.groups.new = self.groups.new, []
        if new:
            first = np.zeros(len(new), np.int64)
            fresh = np.flatnonzero(out >= known)
            first[out[fresh[::-1]] - known] = fresh[::-1]
            for store, ids, to, n in ((self.a, a, a_to, a_n), (self.b, b, b_to, b_n)):
                store.add(ids[ranges((to - n)[first], n[first])], n[first])
        return out

    def marked(self, groups: np.ndarray) -> tuple[np.ndarray, ...]:
        """What `marked` gives of these groups, one after the other."""
        a, b = self.a.get(groups), self.b.get(groups)
        return marked(a, np.cumsum(self.of.a_lengths[a], dtype=np.int32), b, np.cumsum(self.of.b_lengths[b], dtype=np.int32))


@lru_cache(2)
def both(a_path: str, b_path: str) -> Both:
    return Both(a_path, b_path)


def tokenised(docs: DataFrame, a_path: str, b_path: str, window: int = WINDOW, read: int = READ) -> DataFrame:
    """Blocks of windows of every row; a document without tokens has one window, without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = both(a_path, b_path)
        memory, rows, held = Memory(tokenizers), [], 0
        for batch in batches:
            for part in slices(batch, "text", read):
                texts = [x or "" for x in part.column(1).to_pylist()]
                keys = list(zip(part.column(2).to_pylist(), part.column(0).to_pylist(), strict=True))
                if len(texts) == 1 and len(texts[0]) > read:
                    yield from long_document(tokenizers, *keys[0], texts[0], window, read)
                    continue
                windows = [[*tokenizers.windows(t, window)] if t else [] for t in texts]
                found = iter(memory.read([w for own in windows for w in own]))
                for key, own in zip(keys, windows, strict=True):
                    words = [next(found) for _ in own]
                    if not words or any(n < 0 for n, _, _ in words):
                        words = [NONE]
                    for k, w in enumerate(words):
                        rows.append((*key, k, len(words), *w))
                        held += len(w[2]) + 1
                    if held > SENT:
                        yield block(memory, rows)
                        rows, held = [], 0
                if memory.full():
                    if rows:
                        yield block(memory, rows)
                    memory, rows, held = Memory(tokenizers), [], 0
        if rows:
            yield block(memory, rows)
        give_back()

    return small_batches(with_text(docs).withColumn("row", F.monotonically_increasing_id())).mapInArrow(run, BLOCKS)


#: A document without tokens.
NONE = (0, 0, np.zeros(0, np.int32))


def block(memory: Memory, rows: list) -> pa.RecordBatch:
    """One row of these windows (row, doc_id, part, parts, n_a, n_b, groups), with the groups that they have."""
    groups = np.concatenate([r[6] for r in rows])
    seen = np.zeros(len(memory.groups), bool)
    seen[groups] = True
    used, new = np.flatnonzero(seen), (np.cumsum(seen) - 1).astype(np.int32)
    off = np.concatenate([[0], np.cumsum([len(r[6]) for r in rows])]).astype(np.int32)
    fields = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
    fields.append(pa.ListArray.from_arrays(pa.array(off), pa.array(new[groups])))
    row = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return pa.RecordBatch.from_arrays([*(row(pa.array(x)) for x in memory.marked(used)), row(pa.StructArray.from_arrays(fields, _WINDOW.names))], BLOCKS.names)


def long_document(tokenizers: Both, row: int, doc_id: int | None, text: str, window: int, read: int) -> list[pa.RecordBatch]:
    """Blocks of one document, of which `read` code points are read at once, or one window's."""
    memory, parts, blocks, rows, texts = Memory(tokenizers), sum(1 for _ in tokenizers.windows(text, window)), [], [], []
    size = at = 0
    for k, w in enumerate(tokenizers.windows(text, window), 1):
        texts.append(w)
        size += len(w)
        if size < read and k < parts:
            continue
        for found in memory.read(texts):
            if found[0] < 0:
                return [block(memory, [(row, doc_id, 0, 1, *NONE)])]
            rows.append((row, doc_id, at, parts, *found))
            at += 1
        blocks.append(block(memory, rows))
        memory = Memory(tokenizers) if memory.full() else memory
        texts, rows, size = [], [], 0
    return blocks


def _spread(ids: str, marks: str) -> Column:
    """The id that covers each cell."""
    cells = lambda i: F.shiftright(F.get(marks, i), 2) - F.coalesce(F.shiftright(F.get(marks, i - 1), 2), F.lit(0))
    return F.flatten(F.transform(ids, lambda x, i: F.array_repeat(x, cells(i))))


def _grouped(ids: str, marks: str) -> Column:
    """The ids of each group, joined by commas: a group ends where both tokenizers' tokens end."""
    told = F.zip_with(ids, marks, lambda x, m: F.concat(x.cast("string"), F.get(F.array(*map(F.lit, ",,,;")), m.bitwiseAND(F.lit(3)))))
    return F.split(F.array_join(told, ""), ";")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often `use` asks."""
    return F.get(F.transform(F.array(value), use), 0)


def aligned(blocks: DataFrame) -> DataFrame:
    """row, doc_id, part, parts, n_a, n_b, n_groups, links (a id * 2^32 + b id of each) and the groups as text."""
    texts = F.filter(F.zip_with(_grouped("a", "a_marks"), _grouped("b", "b_marks"), lambda x, y: F.when(x != "", F.concat(x, F.lit("|"), y))), lambda x: x.isNotNull())
    pairs = F.zip_with(_spread("a", "a_marks"), _spread("b", "b_marks"), lambda a, b: F.shiftleft(a.cast("long"), 32) + b)
    ends = F.transform(F.filter("a_marks", lambda m: m.bitwiseAND(F.lit(3)) == 3), lambda m: F.shiftright(m, 2))
    starts = lambda e, i: F.coalesce(F.get(e, i - 1), F.lit(0))
    links = _let(F.struct(pairs.alias("pairs"), ends.alias("ends")), lambda s: F.transform(s["ends"], lambda e, i: F.slice(s["pairs"], starts(s["ends"], i) + 1, e - starts(s["ends"], i))))
    looked_up = _let(
        F.struct(texts.alias("texts"), links.alias("links")),
        lambda d: F.transform(
            "windows",
            lambda w: F.struct(
                *(w[c].alias(c) for c in ("row", "doc_id", "part", "parts", "n_a", "n_b")),
                F.size(w["groups"]).cast("long").alias("n_groups"),
                F.flatten(F.transform(w["groups"], lambda g: F.get(d["links"], g))).alias("links"),
                F.array_join(F.transform(w["groups"], lambda g: F.get(d["texts"], g)), ";").alias("groups"),
            ),
        ),
    )
    return blocks.select(F.inline(looked_up))


def counted(links: DataFrame) -> DataFrame:
    """pair (a id * 2^32 + b id), n (documents that hold it linked), best (whether no pair of its a id has more)."""
    # a document of one window counts a pair once there; one of many is told apart by its row
    long = F.when(F.col("parts") > 1, F.col("row"))
    held = links.select(long.alias("long"), F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair", "long").agg(F.count("*").alias("n"))
    pairs = held.groupBy("pair").agg(F.sum(F.when(F.col("long").isNull(), F.col("n")).otherwise(1)).alias("n"))
    pairs = stash(pairs, "pairs")
    tops = pairs.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("top"))  # one row a vocabulary entry at most
    return stash(pairs.join(F.broadcast(tops), F.shiftright(pairs.pair, 32) == tops.a).select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "counted")


def scored(links: DataFrame, pairs: DataFrame, most: int = BROADCAST) -> DataFrame:
    """row, n_links, n_best, count_sum of every row that has links. Pairs are broadcast from the most frequent down, as
    long as there are `most` at most; links of others meet their pair by shuffle."""
    level = F.floor(F.log2("n") * 4).cast("int")
    sizes = {r.level: r["count"] for r in pairs.groupBy(level.alias("level")).count().collect()}  # a few hundred rows
    least, room = math.inf, most
    for k in sorted(sizes, reverse=True):
        room -= sizes[k]
        if room < 0:
            break
        least = k
    all_hot = room >= 0
    hot = F.broadcast(pairs if all_hot else pairs.filter(level >= least) if least < math.inf else pairs.limit(0))
    sums = (F.count("*").alias("n_links"), F.count_if("best").alias("n_best"), F.sum("n").alias("count_sum"))
    each = links.select("row", F.explode("links").alias("pair"))
    found = each.join(hot, "pair").groupBy("row").agg(*sums)
    if all_hot:
        return found
    rest = pairs if least == math.inf else pairs.filter(level < least)
    rare = each.join(hot.select("pair"), "pair", "left_anti").join(rest.hint("shuffle_hash"), "pair").groupBy("row").agg(*sums)
    return found.union(rare).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])


def alignments(docs: DataFrame, a_path: str, b_path: str, most: int = BROADCAST, window: int = WINDOW, read: int = READ) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row.

    A null or empty text, and one whose tokens' bytes aren't its own, has no tokens: zeros, and '' for the hash. Other
    columns are ignored; rows without doc_id and repeated rows are documents of their own; an empty table gives no rows.
    A document's groups, as text, have to fit in one row. `a_path`, `b_path`: the files, which every executor must find.
    """
    one = F.col("parts") == 1
    links = aligned(tokenised(docs, a_path, b_path, window, read))
    links = links.withColumn("sha", F.when(one, F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))))
    links = stash(links.withColumn("groups", F.when(~one, F.col("groups"))), "links")
    sums = scored(links, counted(links), most)
    # documents of many windows: their groups in order
    counts = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups")]
    names = ["row", "doc_id", "n_a", "n_b", "n_groups"]
    long = links.filter("parts > 1").groupBy("row").agg(F.first("doc_id").alias("doc_id"), *counts, F.array_sort(F.collect_list(F.struct("part", "groups"))).alias("g"))
    long = long.select(*names, F.sha2(F.array_join(F.transform("g", lambda g: g["groups"]), ";"), 256).alias("groups_sha256"))
    rows = links.filter(one).select(*names, F.col("sha").alias("groups_sha256")).union(long)
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]
    return rows.join(sums, "row", "left").select(*names[1:], *zero, "groups_sha256")
