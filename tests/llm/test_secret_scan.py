import base64
import hashlib
import random
import re
import string
import time

import numpy as np
from loomgraph.llm import secret_scan as ss

DOCS = "doc_id long, text string, spans string, n_chars long"
KEY = "Zk3" + "bQ9xT7mWv2LrYp8sHd6N" + "1cFg4J"
TEXTS = [
    "nothing here", None, "", 'x password: "hunter22x" y', "PASSWD=abc", "api-key = 12 apikey=1234567 token token:abcdef", "AKIA" + "ABCDEFGH12345678" + " AKIAshort", "0123456789abcdef01234567 deadbeef", "é✓ secret = é secret='abcdef-1'",
    "token = " + "a1" * 20, f"the value {KEY} stands alone", "path/to/some/where/long/file.html and www.example.com/index/page", "ſecret=abcdefgh toKen=abcdefgh", "secret:token=abcdefg",
]


def brute(text):
    text, out = text or "", []
    assign = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    out += [(m.start(), 0, m.end()) for m in re.finditer(assign, fold) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_rules_as_brute_force_and_extra_spans(spark, data):
    rows = [(i, t, "clash", None) for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], None, None), (0, TEXTS[0], None, None)]
    rows += [(1000 + r.doc_id, r.text, None, None) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = ss.digests(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, *_ in rows}
    for r in got:
        base = brute(text[r.doc_id])
        line = ",".join(f"{ss.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in base) for j in range(3)]
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))
    spans = {r.doc_id: r.spans for r in got}
    assert f"cnn:10:{10 + len(KEY)}" in spans[10] and spans[11] == "" and spans[0] == ""


def test_network_on_findings_it_has_not_seen():
    net = ss.trained()
    rows = ss.labelled(np.random.default_rng(123), 1500)
    got = [ss.windows(t, [(a, b)]) for t, a, b, _, _ in rows]
    score = net.score(np.concatenate([c for c, _ in got]), np.concatenate([i for _, i in got]))
    y = np.array([r[3] for r in rows])
    assert (score[y == 1] >= net.threshold).mean() > 0.95
    assert (score[y == 0] >= net.threshold).mean() < 0.02


def test_gradients_are_right():
    rng = np.random.default_rng(5)
    net = ss.Network(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows = ss.labelled(rng, 6)
    got = [ss.windows(t, [(a, b)]) for t, a, b, _, _ in rows]
    codes, inside, y = np.concatenate([c for c, _ in got]), np.concatenate([i for _, i in got]), np.array([r[3] for r in rows], float)
    loss = lambda: float(np.mean(np.log1p(np.exp(o := net.logits(codes, inside))) - y * o))
    g = net.gradients(codes, inside, y)
    for k, at in (("o", (3,)), ("b", (2,)), ("w", (7, 4)), ("e", (int(codes[0, 25]), 1)), ("c", (0,))):
        net.p[k][at] += 1e-5
        up = loss()
        net.p[k][at] -= 2e-5
        down = loss()
        net.p[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-5


def test_redaction_leaves_nothing_to_find(spark):
    df = spark.createDataFrame([(i, t, "keep", 5) for i, t in enumerate(TEXTS)], DOCS)
    got = {r.doc_id: r for r in ss.redacted(df).collect()}
    assert ss.redacted(df).columns == df.columns
    assert got[1].text is None and got[0].text == TEXTS[0] and got[0].spans == "keep"
    assert got[3].text == f'x password: "{ss.REDACTED}" y' and got[3].n_chars == len(got[3].text)
    assert KEY not in got[10].text
    assert not any(brute(r.text) for r in got.values())
    assert ss.redacted(df.limit(0)).count() == 0


def candidates(text):
    return [text[a:b] for a, b in ss.more_candidates(text, ss.base_spans(text))]


def test_candidates_of_both_cases_and_beside_findings():
    assert candidates("QwErTyUiOpAsDfGhJkLz and AbCdEfGhIjKlMnOpQr==") == ["QwErTyUiOpAsDfGhJkLz", "AbCdEfGhIjKlMnOpQr=="]
    every = ["internationalisation", "INTERNATIONALISATION", "Internationalisation.", "----------------------"]
    assert candidates(" ".join(every)) == every and ss.found_in(every, ss.trained()) == [[]] * 4
    rest = "/" + KEY * 2
    assert candidates("AKIA" + "ABCDEFGH12345678" + rest) == [rest]
    assert candidates("x9" * 10 + "_" + "0123456789abcdef01234567" + "Kq9" + KEY) == ["x9" * 10 + "_", "Kq9" + KEY]


def test_recall_of_keys_without_digits_as_a_scan_finds_them():
    net, rng = ss.trained(), np.random.default_rng(11)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    keys = ["".join(rng.choice(letters, 24)) for _ in range(300)]
    found = ss.found_in([f"the value {k} stands alone" for k in keys], net)
    assert np.mean([len(f) == 1 for f in found]) > 0.9
    rows = [r for r in ss.labelled(rng, 1500) if r[3] and r[4] == "cnn"]
    assert np.mean([p is None or p >= net.threshold for p in ss.candidate_scores(rows, net)]) > 0.95


def test_candidates_are_all_runs_outside_the_findings():
    """By brute force, character by character, findings of any kind and overlap between."""
    rng = random.Random(8)
    parts = ["a" * 15, "Q" * 16, "x1" * 9, "0123456789abcdef" * 2, "AKIA" + "ABCDEFGH12345678" * 2, "token=", "password: ", "secret=abcdef", " ", "\n", "é", "/", "deadbeef" * 4, '"']
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        base, want, at = ss.base_spans(text), [], 0
        free = [c.isascii() and (c.isalnum() or c in "+/_.=-") and not any(s <= i < e for s, _, e, *_ in base) for i, c in enumerate(text)]
        while at < len(text):
            to = at
            while to < len(text) and free[to]:
                to += 1
            if to - at >= ss.SHORTEST:
                want.append((at, to))
            at = max(to, at + 1)
        assert ss.more_candidates(text, base) == want, text


def test_many_findings_take_linear_time():
    text = "\n".join(f"{i:032x}" for i in range(200_000))
    began = time.process_time()
    assert ss.more_candidates(text, ss.base_spans(text)) == []
    assert time.process_time() - began < 20


def test_recall_of_keys_of_one_case():
    """None of them was labelled."""
    rng = np.random.default_rng(12)
    for letters, least in (("abcdefghijklmnopqrstuvwxyz", 0.8), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.95)):
        keys = ["".join(rng.choice(list(letters), 24)) for _ in range(300)]
        assert np.mean([len(f) == 1 for f in ss.found_in([f"the value {k} stands alone" for k in keys], ss.trained())]) > least


def test_every_character_of_a_long_run_is_judged(spark):
    rng, letters = np.random.default_rng(3), np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    path, names = "docs/guides/setup/install/linux/readme", "name.of.a.long.module.path.with.parts"
    keys = ["".join(rng.choice(letters, 32)) for _ in range(100)]
    for form in (path + "/sk_live_{}", names + ".{}", path + "/{}/" + path):
        runs = [form.format(k) for k in keys]
        found = ss.found_in([f"see {r} here" for r in runs], ss.trained())
        assert np.mean([[x[:3] for x in f] == [(4, 3, 4 + len(r))] for f, r in zip(found, runs, strict=True)]) > 0.9
    assert ss.found_in([f"see {path}/{path}/{path}.html and {names}.{names}"], ss.trained()) == [[]]
    for n in (16, 40, 41, 48, 95, 1000):
        cut = ss.slides(7, 7 + n)
        assert {i for a, b in cut for i in range(a, b)} == set(range(7, 7 + n)) and all(b - a <= ss.INSIDE for a, b in cut)
    got = ss.redacted(spark.createDataFrame([(1, f"see {path}/{keys[0]} here", None, 0)], DOCS)).first().text
    assert got == f"see {ss.REDACTED} here"


def test_findings_that_the_generator_did_not_write():
    """Keys in the shapes of public services, and common look-alikes."""
    rng = random.Random(5)
    some = lambda n, al=string.ascii_letters + string.digits: "".join(rng.choice(al) for _ in range(n))
    url, dig = string.ascii_letters + string.digits + "-_", string.digits
    b64 = lambda n: base64.b64encode(rng.randbytes(n)).decode()
    keys = [
        lambda: "ghp_" + some(36), lambda: "github_pat_" + some(22) + "_" + some(59), lambda: f"xoxb-{some(12, dig)}-{some(12, dig)}-{some(24)}", lambda: "sk_live_" + some(24), lambda: "AIza" + some(35, url),
        lambda: f"SG.{some(22, url)}.{some(43, url)}", lambda: b64(32), lambda: b64(64), lambda: "glpat-" + some(20, url), lambda: "npm_" + some(36), lambda: "ya29." + some(60, url), lambda: some(40), lambda: some(32).lower(),
        lambda: f"eyJhbGciOiJIUzI1NiJ9.{some(54, url)}.{some(43, url)}", lambda: "hf_" + some(34), lambda: some(64, dig + "ABCDEF"), lambda: "AGE-SECRET-KEY-1" + some(58, "QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L"),
    ]
    plain = """internationalization https//example.org/about/team/contact-us.html /usr/local/share/applications/defaults.list docs/getting-started/installation.md
    2024-03-15T08-30-00+00-00 user_profile_settings_page AbstractSingletonProxyFactoryBean com.example.project.service.UserService node_modules/react-dom/cjs/index.js v1.24.0-rc.3-linux-amd64.tar.gz
    ----------------------- ========================== src/main/java/org/apache/Foo.java New-York-San-Francisco-Los-Angeles 1234567890123456 10000000000000.000000 en.wikipedia.org/wiki/Main_Page
    IEEE-754-2008-standard ____________________ some-very-long-css-class-name checkboxGroupItemLabelText README.CONTRIBUTING.LICENSE 2001-09-09.2013-01-01.report mathematics+physics+chemistry
    john.smith.jr-1984.example.com thisIsAVariableNameInCamelCase MAX_BUFFER_SIZE_IN_BYTES 0.3333333333333333 12/31/2023-01/01/2024 font-family=sans-serif supercalifragilisticexpialidocious
    PROCESS_INFORMATION_BLOCK well-being/self-esteem/stress 192.168.100.200-192.168.100.250 iso-8859-1.utf-8.utf-16 Donaudampfschifffahrtsgesellschaft anti-inflammatory/immunosuppressive
    part-time/full-time/contract chapter-12-section-3-exercise-4""".split()
    found, asked = 0, 0
    for key in keys:
        for _ in range(30):
            value = key()
            text = rng.choice(["use ", "see ", "the value is ", "export X ", ""]) + value + rng.choice([" now", "\n", ". Then", ""])
            at = text.index(value)
            found += any(s < at + len(value) and at < e for s, _, e, *_ in ss.found_in([text], ss.trained())[0])
            asked += 1
    wrong = [w for w in plain if ss.found_in([f"it says {w} here"], ss.trained())[0]]
    assert found >= 0.95 * asked and len(wrong) <= 3, (found / asked, wrong)


def test_scores_by_brute_force():
    """Every candidate of a text, window by window, filter by filter."""
    net, texts = ss.trained(), [TEXTS[10], "see é docs/guides/setup/install/linux/readme/" + KEY + "/end", KEY, "x" * 30 + KEY.lower()]
    p = {k: v.astype(float) for k, v in net.p.items()}
    code = lambda c: ss._code[ord(c)] if ord(c) < 256 else ss._code[ord("?")]
    checked = 0
    for text in texts:
        spans = ss.more_candidates(text, ss.base_spans(text))
        for (a, b), got in zip(spans, ss.best([text], [spans], net), strict=True):
            want = 0.0
            starts = sorted({*range(a, max(a + 1, b - ss.INSIDE), ss.STEP), max(a, b - ss.INSIDE)})
            for s in starts:
                e = min(b, s + ss.INSIDE)
                chars = {ss.BEFORE + i - s: (code(text[i]), float(s <= i < e)) for i in range(max(0, s - ss.BEFORE), min(len(text), e + ss.AFTER))}
                row = [chars.get(i, (0, 0.0)) for i in range(ss.LENGTH)]
                held, near = [], []
                for i in range(ss.LENGTH - ss.WIDTH + 1):
                    x = [v for c, f in row[i : i + ss.WIDTH] for v in (*p["e"][c], f)]
                    act = np.maximum(np.array(x) @ p["w"] + p["b"], 0)
                    (held if row[i + ss.WIDTH // 2][1] else near).append(act)
                pooled = np.concatenate([np.max(held, 0), np.mean(held, 0), np.max(near, 0)])
                want = max(want, 1 / (1 + np.exp(-(net.scale * float(pooled @ p["o"] + p["c"][0]) + net.shift))))
            assert abs(got - want) < 1e-4
            checked += 1
    assert checked >= 4
