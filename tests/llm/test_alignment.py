from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from loomgraph.llm import alignment, bpe
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", None, " ", "a ", "  x  y ", "ab▁cd", "<|endoftext|> <s> </s> <0x41>", "🙂🙃 中文字符", "a  b\n\n c", "word " * 50, "x\t y", "ñandú " * 9 + " ", "x" * 3000, "͸ new", "\x00 b"]


def brute(docs):
    """Token by token, with the libraries."""
    a_of = Tokenizer.from_file(A)
    a_of.encode_special_tokens = True
    b_of, strings = sentencepiece.SentencePieceProcessor(model_file=B), bpe.Bpe(A).strings
    piece = lambda i: bytes([int(b_of.id_to_piece(i)[1:-1], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode()
    out, links, counts = [], [], Counter()
    for _, text in docs:
        a, b = (a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)) if text else ([], [])
        a_bytes, b_bytes = [strings[i] for i in a], [piece(i) for i in b]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            out.append((0, 0, 0, ""))
            links.append([])
            continue
        ends = [[sum(map(len, t[: k + 1])) for k in range(len(t))] for t in (a_bytes, b_bytes)] if len(a) < 400 else [list(_sums(t)) for t in (a_bytes, b_bytes)]
        i = j = g = h = 0
        own, groups = [], []
        while i < len(a):
            own.append((a[i], b[j]))
            x, y = ends[0][i], ends[1][j]
            i, j = i + (x <= y), j + (y <= x)
            if x == y:
                groups.append(",".join(map(str, a[g:i])) + "|" + ",".join(map(str, b[h:j])))
                g, h = i, j
        out.append((len(a), len(b), len(groups), sha256(";".join(groups).encode()).hexdigest()))
        links.append(own)
        counts.update(set(own))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    return [(i, *o[:3], len(own), sum(counts[p] == top[p[0]] for p in own), sum(counts[p] for p in own), o[3]) for (i, _), o, own in zip(docs, out, links, strict=True)]


def _sums(parts):
    n = 0
    for p in parts:
        n += len(p)
        yield n


@pytest.mark.parametrize(("window", "most"), [(alignment.WINDOW, alignment.BROADCAST), (40, 300), (2, 0)])
def test_equal_to_brute_force(spark, data, window, most):
    """Windows of any size, all pairs broadcast, some and none; nulls, repeated rows, clashing names."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()][:120]
    docs += [(-1 - i, t) for i, t in enumerate(HARD)] + [(None, "no id"), docs[3], docs[3]]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, row long, a string").repartition(3)
    got = alignment.alignments(df, A, B, most, window)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs), key=key)


def test_empty_table(spark):
    assert alignment.alignments(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_windows_end_where_both_tokenizers_end():
    both = alignment.Both(A, B)
    for text in [t for t in HARD if t] + ["it's  a  test   of\n blanks behind letters "]:
        whole, parts = both.tokens(text, 1 << 20), both.tokens(text, 1)
        for k in (0, 2):
            assert [x for w in whole for x in w[k].tolist()] == [x for w in parts for x in w[k].tolist()], text


def test_marks_count_cells_and_say_whose_token_ends():
    ends = lambda *x: np.array(x, np.int32)
    a, b = ends(7, 8, 9), ends(5, 6)
    _, a_marks, _, b_marks = alignment.marked(a, ends(2, 5, 9), b, ends(5, 9))
    assert a_marks.tolist() == [1 * 4 + 1, 2 * 4 + 3, 3 * 4 + 3] and b_marks.tolist() == [2 * 4 + 3, 3 * 4 + 3]
    none = ends()
    assert [x.tolist() for x in alignment.marked(none, none, none, none)] == [[], [], [], []]


def read_again(memory, groups):
    """The ids of both tokenizers that the groups stand for."""
    return [memory.a.get(groups).tolist(), memory.b.get(groups).tolist()]


def test_words_are_tokenised_once_and_groups_sent_once():
    """The work follows distinct words, and the ids that Spark turns to text and links follow distinct groups."""
    both, seen = alignment.Both(A, B), []
    encode = both.a_ids
    both.a_ids = lambda text: seen.append(text) or encode(text)
    memory = alignment.Memory(both)
    texts = ["a few words, then a few words again. " * 40 + "a few"] * 30 + ["a few words"]
    found = memory.read(texts) + memory.read(texts)
    assert sum(map(len, seen)) < 60
    whole = both.tokens(texts[0])
    assert found[0][:2] == (len(whole[0][0]), len(whole[0][2]))
    assert read_again(memory, found[0][2]) == [whole[0][0].tolist(), whole[0][2].tolist()]
    sent = alignment.block(memory, [(i, i, 0, 1, *w) for i, w in enumerate(found)])
    assert sent.num_rows == 1 and len(sent.column(0)[0]) < 30 and len(sent.column(4)[0]) == len(found)


def test_words_equal_whole_texts():
    """Texts that end where no word may follow, beside others, in any order and again."""
    both = alignment.Both(A, B)
    memory = alignment.Memory(both)
    odd = [t for t in HARD if t] + ["x　 y", "x  y   z", "²  ª _ ٣ ", "tab\t ", "▁ ▁", " ▁a b", "á ́b", "it's 's 're x's", "\x1c \x1d a\x85 b"]
    for texts in (odd, odd[::-1], [t + u for t in odd for u in (" ", " a", "\n", "", " 's")], [" ".join(odd[:3]), " ".join(odd[7:])]):
        for text, (n_a, n_b, groups) in zip(texts, memory.read(texts), strict=True):
            windows = both.tokens(text, 1 << 20)
            if not windows:
                assert n_a < 0, text
                continue
            assert (n_a, n_b) == (len(windows[0][0]), len(windows[0][2])), text
            assert read_again(memory, groups) == [windows[0][0].tolist(), windows[0][2].tolist()], text
            _, marks, _, _ = alignment.marked(*windows[0])
            assert len(groups) == sum(m & 3 == 3 for m in marks.tolist()), text


@pytest.mark.parametrize("read", [1, 60])
def test_long_documents_equal_brute_force(spark, read):
    """Texts that are longer than what is read at once, with and without tokens; all of a partition null."""
    docs = [(i, t) for i, t in enumerate([*HARD, "the last of these words isn't a word ▁ " * 9, "so many words that they come in pieces " * 20])]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).unionAll(spark.createDataFrame([(99, None), (98, "")], "doc_id long, text string"))
    got = alignment.alignments(df, A, B, window=5, read=read)
    assert sorted(map(tuple, got.collect())) == sorted(brute([*docs, (99, None), (98, "")]))


def test_a_full_memory_is_left(monkeypatch):
    """A long document in blocks of several memories, which each have the groups that they number."""
    monkeypatch.setattr(alignment, "WORDS", 5)
    both, text = alignment.Both(A, B), " ".join(f"word{i} and again {i % 7}" for i in range(60))
    blocks = alignment.long_document(both, 1, 2, text, 10, 40)
    windows = [w for b in blocks for w in b.column(4)[0].as_py()]
    assert len(blocks) > 5 and [w["part"] for w in windows] == list(range(len(windows))) and {w["parts"] for w in windows} == {len(windows)}
    ids = []
    for b in blocks:
        a, marks = b.column(0)[0].as_py(), b.column(1)[0].as_py()
        groups = [[]]
        for x, m in zip(a, marks, strict=True):
            groups[-1].append(x)
            if m & 3 == 3:
                groups.append([])
        ids += [x for w in b.column(4)[0].as_py() for g in w["groups"] for x in groups[g]]
    assert ids == both.tokens(text)[0][0].tolist()
    assert [b.column(4)[0].as_py() for b in alignment.long_document(both, 1, 2, text + " ▁", 10, 40)] == [[{"row": 1, "doc_id": 2, "part": 0, "parts": 1, "n_a": 0, "n_b": 0, "groups": []}]]
