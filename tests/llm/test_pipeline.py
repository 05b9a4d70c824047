import hashlib
import math
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import sentencepiece
from loomgraph.llm import near_dup, pieces, quality, secret_scan
from test_mixing import by_hand
from test_near_dup import brute


def test_stages_take_effect(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "alpha beta gamma delta epsilon zeta eta theta. " * 3 + "secret = abcdef123456", "en", "src1", 0), (10**6 + 1, "alpha beta gamma delta epsilon zeta eta theta. " * 3 + "secret = abcdef123456", "en", "src1", 0), (None, "no id", None, None, None), (10**6 + 2, None, "en", "src2", None)], docs.schema)
    docs = docs.union(extra)
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stash(stage(spark, seen, data), name)
        if name != "sentencepiece":
            assert out.schema.names == docs.schema.names
        if name == "quality":
            assert 0 < out.count() < docs.count()
        if name == "near_duplicates":
            again = near_dup.near_duplicates(out).filter("not kept").count()
            assert again == 0 and out.filter("doc_id is null").count() == seen.filter("doc_id is null").count() and out.count() < seen.count()
        if name == "secrets":
            assert out.count() == seen.count()
            assert not any(secret_scan.base_spans(r.text or "") for r in out.collect())
        if name == "mix":
            assert out.select("doc_id").distinct().count() <= seen.count()
        if name == "sentencepiece":
            model = pieces.pieces(corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model"))
            texts = {r.doc_id: r.text for r in seen.collect()}
            assert out.count() == seen.count() and all(list(r.ids) == model.encode(texts[r.doc_id] or "") for r in out.collect())
        seen = out


def test_run_by_brute_force(spark, data):
    """All stages one after the other in plain Python, from the table's rows to the library's ids."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mix", "sentencepiece"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = quality.fitted(docs, spark.read.parquet(f"{data}/labels.parquet"))
    rows = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        if model.score(*quality.passages(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))[0] >= quality.THRESHOLD:
            rows.append(r)
    groups = brute([(r.doc_id, r.text) for r in rows])
    rows = [r for r in rows if groups[r.doc_id][1] == r.doc_id]
    net, texts = secret_scan.trained(), {}
    for r in rows:
        text, out, end = r.text or "", "", 0
        for a, b in sorted((s[3], s[4]) for s in secret_scan.found_in([text], net)[0]):
            if b > end:
                out, end = (out + text[end:a] + secret_scan.REDACTED if a >= end else out), b
        texts[r.doc_id] = out + text[end:]
    size, source = {i: len(t.split()) for i, t in texts.items()}, {r.doc_id: r.source for r in rows}
    sums, members = defaultdict(int), defaultdict(list)
    for i, s in source.items():
        sums[s] += size[i]
        members[s].append((int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:13], 16), i))
    want, copies = by_hand(dict(sums)), Counter()
    for s, own in members.items():
        rate = min(want[s] / sums[s], 3.0) if sums[s] else 0.0
        before, wanted = 0, (rate - math.floor(rate)) * sums[s]
        turn = int(hashlib.md5(f"42:source:{'null' if s is None else f'of:{s}'}".encode()).hexdigest()[:13], 16) / 2**52
        for _, i in sorted(own):
            copies[i] = math.floor(rate) + (bool(sums[s]) and (before + size[i] / 2 + turn * sums[s]) % sums[s] < wanted)
            before += size[i]
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model"))
    expected = Counter({(i, tuple(library.encode(texts[i]))): n for i, n in copies.items() if n})
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, data).collect())
    assert got == expected and len(got) > 20


def test_no_rows_long_texts_and_clashing_names(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = ["score", "own_score", "held_out", "predicted", "_marked", "row", "rate", "copies", "spans"]
    clash = docs.withColumns({n: corpus_pipeline.F.concat(corpus_pipeline.F.lit(f"{n} "), "doc_id") for n in names})
    long = docs.orderBy("doc_id").limit(1).selectExpr("doc_id + 10000000 doc_id", "repeat(concat(text, ' '), 3000) text", "lang", "source", "n_chars", *[f"'{n} x' {n}" for n in names])
    for rows, least in ((clash.limit(0), 0), (clash.unionByName(long), 20)):
        seen = rows
        for name, stage in corpus_pipeline.STAGES:
            seen = corpus_pipeline.stash(stage(spark, seen, data), name)
            if name != "sentencepiece":
                assert seen.columns == rows.columns
                assert all(r[n] in (f"{n} {r.doc_id}", f"{n} x") for r in seen.select("doc_id", *names).collect() for n in names)
        assert seen.count() >= least


def test_columns_of_any_case_pass(spark, data):
    """Names as Spark resolves them, not as they are written."""
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    odd = docs.selectExpr("doc_id as DOC_ID", "text as Text", "lang", "source", "n_chars as N_Chars", "'keep me' as Score", "7 as Predicted", "true as HELD_OUT")
    want = {r.doc_id for r in corpus_pipeline.keep_quality(spark, docs, data).collect()}
    out = corpus_pipeline.keep_quality(spark, odd, data)
    assert out.columns == odd.columns and {r.DOC_ID for r in out.collect()} == want
    assert all((r.Score, r.Predicted, r.HELD_OUT) == ("keep me", 7, True) for r in out.collect())
    texts = {r.doc_id: (r.text, r.n_chars) for r in secret_scan.redacted(docs).collect()}
    got = secret_scan.redacted(odd)
    assert got.columns == odd.columns and {r.DOC_ID: (r.Text, r.N_Chars) for r in got.collect()} == texts
