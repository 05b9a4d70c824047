import json
import random
import time
from hashlib import sha256

import public_tokenizers
import pytest
from loomgraph.llm import bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
POOL = [*"İıſKÅΣςßẞǄŉﬁeaI'st  \n\t\x1c\x85 　<|>1²Ⅷ中कि-_.", "́", "‍", "가", "🙂", "re", "ll", "\x00", "﻿", "<|endoftext|>", "<|endoftext", "᠎", "hello", " the", "  "]
SPANS = (0, 0x250), (0x300, 0x400), (0x1E00, 0x2100), (0, 0xD800), (0xE000, 0x110000)


def made(n, seed=1):
    rng = random.Random(seed)

    def text():
        if rng.random() < 0.7:
            return "".join(rng.choice(POOL) for _ in range(rng.randint(0, 14)))
        return "".join(chr(rng.randrange(*rng.choice(SPANS))) for _ in range(rng.randint(0, 12)))

    return [text() for _ in range(n)]


@pytest.mark.parametrize("many", [1 << 16, 3])
def test_made_texts_are_the_librarys(monkeypatch, many):
    """Tiny windows and memories, either queue, special strings, code points of any plane."""
    monkeypatch.setattr(bpe, "WINDOW", 3)
    monkeypatch.setattr(bpe, "REMEMBERED", 500)
    monkeypatch.setattr(bpe, "MANY", many)
    library, own, texts = Tokenizer.from_file(PATH), bpe.Bpe(PATH), made(30_000, many)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, w in zip(texts, want, strict=True) if own.encode(t) != w] == []
    assert all(own.decode(w) == t for t, w in zip(texts, want, strict=True))
    assert own.decode([50256, own.first[0xE4], own.first[0xB8], 50256]) == library.decode([50256, own.first[0xE4], own.first[0xB8], 50256], skip_special_tokens=False)


def test_special_strings_can_be_plain_text():
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    own = bpe.Bpe(PATH, special=False)
    for t in ("<|endoftext|>", "a<|endoftext|> b", "<|endoftext|><|endoftext|"):
        assert own.encode(t) == library.encode(t, add_special_tokens=False).ids


def test_every_code_point_is_split_as_the_library_does():
    own = bpe.Bpe(PATH)
    back = lambda words: ["".join(bytes(map(own.byte_of.__getitem__, w)).decode()) for w, _ in words]
    for at in range(0, 0x110000, 64):
        text = "".join(f"a{c} {c}1{c}!" for c in map(chr, range(at, at + 64)) if not 0xD800 <= ord(c) < 0xE000)
        assert own.pre_tokens(text) == back(own.library.pre_tokenize_str(text)), hex(at)


def test_long_runs_take_little_time():
    library, own = Tokenizer.from_file(PATH), bpe.Bpe(PATH)
    began = time.process_time()
    for t in ("x" * 200_000, " " * 200_001, "ab" * 100_000, "中文" * 40_000, "word " * 60_000):
        assert own.encode(t) == library.encode(t, add_special_tokens=False).ids
    assert time.process_time() - began < 60


def test_a_pair_that_goes_first_may_come_up_late(tmp_path):
    """Ranks that no training gives: (bc, d) comes before (b, c)."""
    letters = {chr(b): b - 97 for b in range(97, 103)}
    spare = iter(range(256, 512))
    letters |= {(chr(b) if b in bpe.PLAIN else chr(next(spare))): 10 + b for b in range(256) if not 97 <= b < 103}
    merges = [["bc", "d"], ["a", "bcd"], ["b", "c"], ["c", "b"]]
    vocab = letters | {a + b: 1000 + i for i, (a, b) in enumerate(merges)}
    spec = json.load(open(PATH)) | {"added_tokens": []}
    spec["model"] |= {"vocab": vocab, "merges": merges}
    (tmp_path / "odd.json").write_text(json.dumps(spec))
    library, rng = Tokenizer.from_file(str(tmp_path / "odd.json")), random.Random(5)
    for many in (1 << 16, 1):
        bpe_many, bpe.MANY = bpe.MANY, many
        try:
            own = bpe.Bpe(str(tmp_path / "odd.json"))
            for _ in range(2000):
                t = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))
                assert own.encode(t) == library.encode(t).ids, t
        finally:
            bpe.MANY = bpe_many


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="not byte-level BPE"):
        bpe.Bpe(public_tokenizers.path("word_bpe_49k.json"))


def test_digests_of_rows(spark, data):
    library = Tokenizer.from_file(PATH)
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()] + made(300) + ["long text, " * 30_000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(-1, None, "x"), (None, "hello", None), (0, texts[0], "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string")
    got = bpe.digests(docs, PATH).collect()
    assert len(got) == len(rows)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, _ in rows}
    for r in got:
        ids = want[r.doc_id]
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(text.encode()).hexdigest())
    whole = {r.doc_id: r for r in bpe.encoded(docs.limit(50), PATH).collect()}
    assert all(list(r.ids) == want[i] and r.decoded == texts[i] for i, r in whole.items())
    assert bpe.digests(docs.limit(0), PATH).count() == 0
