import random
import re

import numpy as np
import pytest
from loomgraph.llm import near_dup as nd

DOCS = "doc_id long, text string, kept boolean, class string"  # two columns clash with the operator's own


def brute(rows, percent=85):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            a, b = sets[x], sets[y]
            if x < y and a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, True, "x") for i, t in rows], DOCS)
    return nd.near_duplicates(df, **options).collect()


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, rng.choice([" ", "  ", "\t"]).join(copy)))
            n += rng.randint(1, 3)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_groups_as_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, rows)}
    assert got == brute(rows)


def test_a_chain_through_one_large_bucket_keeps_every_link(spark, monkeypatch):
    """Members drift away from the bucket's first one, so most links aren't to it."""
    monkeypatch.setattr(nd, "SMALL", 2)
    words = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(words)))
        words = [*words[:-2], f"n{i}", f"m{i}"]
        words = words[2:] + words[:2] if i == 15 else words
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, rows)}
    assert got == brute(rows)


def test_nulls_blanks_ties_and_repeated_rows(spark):
    rows = [(5, "a b c d e f"), (3, "A B c d e f"), (3, "A B c d e f"), (9, None), (10, ""), (11, " \t\n"), (12, "one two"), (13, "one  two"), (None, "a b c d e f"), (14, "ONE two three")]
    got = sorted(run(spark, rows), key=str)
    at = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert (at[5].component_id, at[5].kept, at[3].kept) == (3, False, True)
    assert [at[i].component_id for i in (9, 10, 11)] == [9, 10, 11] and at[9].n_shingles == 0
    assert at[13].component_id == 12 and at[14].component_id == 14
    assert at[None].component_id is None and at[None].kept


def test_empty_table_and_a_very_long_text(spark):
    assert run(spark, []) == []
    long = " ".join(f"x{i % 50_000}" for i in range(300_000))
    assert {r.component_id for r in run(spark, [(1, long), (2, long + " end")])} == {1}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 62, 4000, dtype=np.uint64))
    sets = [a[: int(len(a) * 0.75)], a[int(len(a) * 0.25) :], a[:1], a[:1], np.zeros(0, np.uint64)]
    ranks = nd.superminhash([np.sort(s) for s in sets])
    assert abs(float((ranks[0] == ranks[1]).mean()) - 0.5) < 0.15
    assert (ranks[2] == ranks[3]).all() and len(set(ranks[2].tolist())) == ranks.shape[1]


def test_few_elements_match_one_by_one():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64)) for n in (1, 2, 7, 40, 300)]
    together = nd.superminhash(sets)
    for s, row in zip(sets, together, strict=True):
        assert (nd.superminhash([s])[0] == row).all()
        # each element fills every slot once in its own order, so a set's ranks are the least of its elements'
        assert (np.min([nd.superminhash([s[i : i + 1]])[0] for i in range(len(s))], axis=0) == row).all()


def test_one_row_of_each_component_stays_with_all_columns(spark):
    """Columns with the names that the operator works with keep their values; rows of one doc_id are told apart by text."""
    names = ["_marked", "doubt", "row", "id", "class", "text_key"]
    a, b = "a b c d e f g h", "p q r s t u v w"
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, a), (2, a), (2, b), (3, None), (4, ""), (4, ""), (5, "x y"), (5, "X  y"), (None, a), (None, a), (7, long), (8, long + " end"), (9, long + " fin"), (9, long + " fin")]
    df = spark.createDataFrame([(i, t, *["keep"] * len(names)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = nd.deduplicated(df).collect()
    assert all(r[n] == "keep" for r in got for n in names)
    left = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in got)
    assert [x for x in left if x[0] != 5] == sorted([(1, a), (2, b), (3, ""), (4, ""), (-1, a), (-1, a), (7, long)])
    assert len([x for x in left if x[0] == 5]) == 1
    unique = {i: t for i, t in rows if i not in (None, 2, 4, 5, 9)}
    kept = nd.deduplicated(spark.createDataFrame(list(unique.items()), "doc_id long, text string")).collect()
    assert {r.doc_id for r in kept} == {i for i, (_, c) in brute(unique.items()).items() if i == c}


def test_a_hot_group_of_copies_and_a_hot_star(spark):
    long = [f"w{i}" for i in range(80)]
    rows = [(i, "same text in very many documents here") for i in range(0, 900, 3)] + [(i, " ".join([*long, f"end{i}"])) for i in range(1, 900, 3)] + [(i, f"alone {i} " * 6) for i in range(2, 900, 3)]
    got = {r.doc_id: r.component_id for r in run(spark, rows)}
    assert {got[i] for i in range(0, 900, 3)} == {0} and {got[i] for i in range(1, 900, 3)} == {1} and all(got[i] == i for i in range(2, 900, 3))
