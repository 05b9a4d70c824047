import random
import time

import public_tokenizers
import pytest
import sentencepiece
from loomgraph.llm import pieces, token_counts
from sentencepiece import sentencepiece_model_pb2 as proto
from tokenizers import Tokenizer

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", "a", " ", "   ", "\n\n x", "Σίσυφος ΑΣ", "İstanbul ſ K", "<|endoftext|>hi<|startoftext|>", "a<|b 中文字符 漢字 🙂🙃", "it's we're 'tx ?'t 12345 a1b2", "ﬁ é   　x", "x" * 300, "\t\ttabs\t", "don''t  ___ ---", "🏳️‍🌈 क्षि ไทย", "a b\u0085c\x1cd", "<|endoftext|", "Ǆ ǅ ẞ ß ŉ", "The quick brown fox, unbelievably so."]


@pytest.fixture(scope="module")
def texts(spark, data):
    return HARD + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]


def test_counts_are_the_librarys(spark, texts):
    library = Tokenizer.from_file(WORDS)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(-1, None, "x"), (None, "hello", None), (0, "", "x")]
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), WORDS).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (by[i].n_tokens, by[i].n_bytes, by[i].over_limit) == (n, len(t.encode()), n > 2048), t[:50]
    assert by[-1].n_tokens == 0 and by[None].n_tokens == 1


def test_counts_of_made_texts_are_the_librarys():
    """Marks that compose anew after lower-casing, blanks of all kinds, special strings, code points of any plane."""
    rng, library, own = random.Random(20), Tokenizer.from_file(WORDS), token_counts.WordCounter(WORDS)
    pool = [*"İıſKÅΣςßẞǄŉﬁeaI'st  \n\t\x1c\x85\u2003\u3000<|>1²Ⅷ中कि-_.", "\u0301", "\u0323", "\u0307", "\u0345", "\u05b0", "\u200d", "\uac00", "\u1100", "\u1161", "\u11a8", "🙂", "re", "ll", "\x00", "\ufeff", "<|endoftext|>", "<|startoftext|>"]

    def text():
        if rng.random() < 0.7:
            return "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        spans = (0, 0x250), (0x300, 0x400), (0x1E00, 0x2100), (0, 0xD800), (0xE000, 0x11000)
        return "".join(chr(rng.randrange(*rng.choice(spans))) for _ in range(rng.randint(0, 12)))

    texts = [text() for _ in range(100_000)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = [n for i in range(0, len(texts), 500) for n in own.count(texts[i : i + 500])]
    assert [(t, a, b) for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


def test_shortcut_holds_single_tokens_only_and_survives_forgetting(monkeypatch):
    c = token_counts.WordCounter(WORDS)
    library = Tokenizer.from_file(WORDS)
    assert len(c.single) > 30_000 and "hello" in c.single
    assert all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in list(c.single)[::97])
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    for t in ["qzxv wvutq zzzyx", "qzxv plorkish grumblefax snorf", "qzxv zzzyx"]:
        assert c.count([t]) == [len(library.encode(t, add_special_tokens=False).ids)]


def test_ids_are_the_librarys_and_decode_back(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(-1, None, "x"), (None, "hello", None)]
    got = pieces.encoded(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PIECES).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(r.restored for r in got)
    for i, t in enumerate(texts):
        assert list(by[i].ids) == library.encode(t), t[:50]
    assert by[-1].ids == [] and by[None].n_tokens == len(library.encode("hello"))


def test_blank_runs_are_the_librarys_and_take_linear_time():
    rng, library, own = random.Random(3), sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.Pieces(PIECES)
    pool = [" "] * 6 + ["  ", "\n", "\t", "hello", " x", "é", "中", "🙂", "_", "=", "a", "the", "▁", "\u00a0"]
    made = [" " * n + w for n in range(150) for w in ("", " hello", "\n", "🙃z", "--")]
    made += ["".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(20_000)]
    assert [t for t in made if own.encode(t) != library.encode(t)] == []
    began = time.process_time()
    for long in (" " * 1_000_000, " " * 1_000_000 + "x", "\n" * 1_000_000):
        ids = own.encode(long)
        assert own.decode(ids) == long
    assert time.process_time() - began < 30


def test_unigram_scores_give_the_librarys_path(texts):
    """The same pieces read as a unigram model: the pass maximises the sum of scores, as the library does."""
    with open(PIECES, "rb") as f:
        model = proto.ModelProto.FromString(f.read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    own = pieces.Pieces(PIECES, unigram=True)
    total = lambda ids: sum(own.scores[i] for i in ids if own.kinds[i] == pieces.NORMAL)
    checked = 0
    for t in texts[:120]:
        if pieces.SPACE * 2 in t.replace(" ", pieces.SPACE) or any(own.kinds[i] == pieces.BYTE for i in library.encode(t)):
            continue
        assert abs(total(own.encode(t)) - total(library.encode(t))) < 1e-3 * max(1, abs(total(library.encode(t))))
        assert own.decode(own.encode(t)) == t
        checked += 1
    assert checked > 20
