"""Token counts with a whole-token shortcut.

Before any text is read, every vocabulary string that encodes, alone, as one token is proven such by the library
itself. Pre-tokens found among them count one each; only the rest go through the merges, all of a batch's at once.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import in_arrow, texts, with_text

LIMIT = 2048
#: Counts of so many distinct pre-tokens are remembered by a worker.
REMEMBERED = 200_000

# The byte alphabet of byte-level BPE.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


class WordCounter:
    """Counts as `tokenizers` gives them for a BPE vocabulary with word ends, NFC and lower case. The file's pattern
    and special strings are read from it; files with other steps are refused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split, letters = (*(spec["pre_tokenizer"] or {}).get("pretokenizers", []), {}, {})[:2]
        if steps != ["NFC", "Replace", "Lowercase"] or (split.get("behavior"), split.get("invert"), letters.get("type")) != ("Removed", True, "ByteLevel") or spec["model"].get("end_of_word_suffix") != "</w>":
            raise ValueError(f"{path}: not NFC, blanks, lower case, words by one pattern and byte-level BPE with word ends")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # the model's merges alone: words that are normal already must not be normalised again
        self.merges = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "truncation": None, "padding": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, letters]}}))
        self.split = regex.compile(split["pattern"]["Regex"]).findall
        specials = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1 + len(specials), bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.assigned: set[str] = set()
        self.counts = self.single = self._proven(vocabulary)

    def _proven(self, vocabulary: dict[str, int]) -> dict[str, int]:
        """The strings that are one pre-token and one token."""
        extra = iter(range(256, 512))
        letter = {chr(b if b in PLAIN else next(extra)): b for b in range(256)}
        words = []
        for token in vocabulary:
            try:
                words.append(bytes(letter[c] for c in token.removesuffix("</w>")).decode())
            except (KeyError, UnicodeDecodeError):
                continue
        words = [w for w in dict.fromkeys(words) if self.normal(w) == w and self.split(w) == [w]]
        found = self.library.encode_batch(words, add_special_tokens=False)
        return {w: 1 for w, e in zip(words, found, strict=True) if len(e.ids) == 1}

    @staticmethod
    def normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # each code point for itself

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """The text's pre-tokens, and how many special strings stand in it."""
        if self.special is None or "<|" not in text:
            return self.split(self.normal(text)), 0
        parts = self.special.split(text)
        return [w for p in parts for w in self.split(self.normal(p))], len(parts) - 1

    def unassigned(self, text: str) -> bool:
        """Whether a code point is missing in unicodedata."""
        new = set(text) - self.assigned
        missing = {c for c in new if unicodedata.category(c) == "Cn"}
        self.assigned |= new - missing
        return bool(missing)

    def merged(self, words: list[str]) -> np.ndarray:
        """Tokens of each of the pre-tokens, by the library's merges, and nothing else of it, over all of them in one string."""
        ids = np.array(self.merges.encode(" ".join(words), add_special_tokens=False).ids, np.int64)
        at = np.flatnonzero(self.ends[ids])
        if len(at) != len(words):  # a word that is not kept apart by spaces: ask for each
            return np.array([len(e.ids) for e in self.merges.encode_batch(words, add_special_tokens=False)])
        return np.diff(at, prepend=-1)

    def count(self, batch: list[str]) -> list[int]:
        foreign = {i: len(self.library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(batch) if not t.isascii() and self.unassigned(t)}
        split = [([], foreign[i]) if i in foreign else self.pre_tokens(t) for i, t in enumerate(batch)]
        known = self.counts
        rest = list({w for words, _ in split for w in words if w not in known})
        if rest:
            if len(known) + len(rest) > REMEMBERED + len(self.single):
                known = dict(self.single)
            elif known is self.single:
                known = dict(known)
            known.update(zip(rest, self.merged(rest).tolist(), strict=True))
            lost = [w for words, _ in split for w in words if w not in known]
            if lost:  # remembered ones that were dropped just now
                known.update(zip(lost, self.merged(lost).tolist(), strict=True))
            self.counts = known
        return [sum(map(known.__getitem__, words)) + n for words, n in split]


@lru_cache(2)
def counter(path: str) -> WordCounter:
    return WordCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; other columns are ignored.

    A null text counts as empty: no bytes, no tokens. Rows without doc_id and repeated rows are counted like others;
    an empty table gives no rows. `path`: the vocabulary file, which every executor must find there.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counter(path).count(texts(batch.column(1))), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = with_text(docs).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return in_arrow(rows, run, "doc_id long, n_bytes long, n_tokens long", most=1 << 20).withColumn("over_limit", F.col("n_tokens") > limit)
