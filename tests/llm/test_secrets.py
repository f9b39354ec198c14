import hashlib
import random
import re

import numpy as np

from blockweave.llm import registry
from blockweave.llm import secrets as S
from tests.llm.helpers import SAMPLE, docs


def brute(text):
    """The base spans by the patterns as they are written, failing matches dropped."""
    text, out = text or "", []
    for kind, pattern, ok in (
        (0, r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        (1, r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        (2, r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if ok(m)]
    return sorted(out)


def test_base_spans_same_as_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SAMPLE}/documents.parquet").collect()}
    rows = registry.op2_secret_scan(spark, SAMPLE).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, x, _ in want) for k in range(3))
        assert r["base_sha256"] == hashlib.sha256(S.joined(want).encode()).hexdigest()
        assert set(S.joined(want).split(",")) <= set(r["spans"].split(","))


def test_patterns_on_hard_texts():
    r = random.Random(4)
    parts = ["PassWord", "token", "api_key", "apikey", " = ", ":", '"', "'", "=", " ", "AKIA", "AKIAAKIA", "ABC123", "0123456789ab", "abcdef", "xyz.9", "\n", "ſecret", "toKen", "é"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 14)))
        assert [(s, k, e) for s, k, e, _ in S.pattern_spans(text)] == brute(text), text


def small_field():
    r = random.Random(1)
    secret = lambda: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(16))
    words = "the cat sat on a mat and Saw 12 dogs (in 2020) by night".split()
    texts = []
    for k in range(150):
        line = [r.choice(words) for _ in range(12)]
        texts.append(" ".join(line) + (f" key AKIA{secret()} {r.choice(words)}" if k % 2 else f"\npassword = {secret().lower()}1 and"))
    return S.fit(texts)


def test_field_finds_secrets_without_a_pattern():
    field = small_field()
    text = "the mat\nsat on key BKIAQ7WX2ZPL94KMN3TR by night"
    base, spans = S.all_spans(text, field)
    assert base == [] and [text[s:e] for s, _, e in spans] == ["BKIAQ7WX2ZPL94KMN3TR"]
    assert S.masked(text, spans) == "the mat\nsat on key [SECRET] by night"
    assert S.all_spans("the cat sat on a mat by night, 12 dogs saw", field)[1] == []


def test_viterbi_same_as_all_paths_and_windows_lose_nothing():
    field = small_field()
    r = np.random.default_rng(2)
    for n in (1, 2, 5, 7):
        scores = r.normal(0, 3, (n, 3))
        paths = np.array(np.meshgrid(*[range(3)] * n, indexing="ij")).reshape(n, -1).T
        t = field.transitions

        def value(p, scores=scores, t=t):
            full = [0, *p, 0]
            return sum(t[a, b] for a, b in zip(full, full[1:], strict=False)) + sum(scores[k, y] for k, y in enumerate(p))

        assert abs(value(field.viterbi(scores)) - max(map(value, paths))) < 1e-6
    for _ in range(200):
        scores = np.column_stack([np.zeros(60), r.normal(-6, 5, 60), r.normal(-6, 5, 60)])
        gains = np.maximum(scores[:, 1] + field.gain_begin, scores[:, 2] + field.gain_inside)
        whole, parts = field.viterbi(scores), np.zeros(60, np.int64)
        for a, b in field.windows(gains):
            parts[a:b] = field.viterbi(scores[a:b])
        assert (whole == parts).all()


def test_gradient_is_that_of_the_likelihood():
    r = np.random.default_rng(6)
    batch = [([[0, 2], [1], [3, 0]], [0, 1, 2]), ([[1, 3]], [1])]
    w, t = r.normal(0, 1, (4, 3)), r.normal(0, 1, (3, 3))

    def likelihood(w, t):
        out = 0.0
        for rows, labels in batch:
            n = len(labels)
            scores = np.array([w[x].sum(axis=0) for x in rows])
            value = lambda p: sum(t[a, b] for a, b in zip([0, *p], [*p, 0], strict=True)) + sum(scores[k, y] for k, y in enumerate(p))  # noqa: B023, E731
            paths = np.array(np.meshgrid(*[range(3)] * n, indexing="ij")).reshape(n, -1).T
            out += value(labels) - np.log(sum(np.exp(value(p)) for p in paths))
        return out

    grad, grad_t = S._gradient(batch, w, t)
    for x, g in ((w, grad), (t, grad_t)):
        for at in np.ndindex(*x.shape):
            step = np.zeros_like(x)
            step[at] = 1e-5
            near = likelihood(w, t + step) - likelihood(w, t - step) if x is t else likelihood(w + step, t) - likelihood(w - step, t)
            assert abs(near / 2e-5 - g[at]) < 1e-3, (at, near / 2e-5, g[at])


def test_odd_texts_and_redaction(spark):
    texts = [None, "", "no secret", "x token=abcdef0 y", (None, "AKIA" + "A" * 16), "é" * 300_000, "0" * 24 + " " + "f" * 30]
    some = docs(spark, texts)
    rows = S.scan(some, None).collect()
    assert sorted(r["spans"] for r in rows) == ["", "", "", "", "access:0:20", "assign:2:15", "hex:0:24,hex:25:55"]
    clean = S.redact(some, S.train(some), length_col="n_chars")
    assert clean.columns == some.columns and clean.count() == len(texts)
    assert clean.where("doc_id = 3").first()["text"] == "x [SECRET] y"
    assert clean.where("doc_id = 6").first()["n_chars"] == len("[SECRET] [SECRET]")
    assert S.scan(some.limit(0), None).count() == 0 and S.train(some.limit(0)) is None


def unseen_secrets(turn):
    """Secrets of kinds that no pattern knows and no training text holds."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    some = lambda n, alphabet: "".join(turn.choices(alphabet, k=n))
    mixed = letters + letters.upper() + "0123456789"
    return {
        "ghp": "ghp_" + some(36, mixed), "live": "sk_live_" + some(24, mixed), "bot": f"xoxb-{some(11, '0123456789')}-{some(24, mixed)}", "maps": "AIza" + some(35, mixed), "npm": "npm_" + some(36, mixed),
        "signed": f"eyJ{some(33, mixed)}.eyJ{some(60, mixed)}.{some(43, mixed)}", "lab": "glpat-" + some(20, mixed), "base64": some(40, mixed + "+/") + "==",
    }


def test_recall_of_unseen_kinds(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect() if r["text"] and len(r["text"]) <= 20_000]
    field, turn = S.fit(texts[:600]), random.Random(5)
    words = " ".join(texts[:20]).split()
    found = total = 0
    for _ in range(15):
        for secret in unseen_secrets(turn).values():
            before, after = (" ".join(turn.sample(words, 6)) for _ in range(2))
            text = turn.choice(["{b} use key {s} for it {a}", "{s}", "{b} {s} {a}", "config {s} {b}"]).format(b=before, s=secret, a=after)
            at = text.index(secret)
            found += any(s < at + len(secret) and at < e for s, _, e in S.all_spans(text, field)[1])
            total += 1
    assert found >= 0.85 * total
    assert sum(k == 3 for t in texts[600:] for _, k, _ in S.all_spans(t, field)[1]) <= 1


def harmless_lines(turn):
    """Lines with tokens that aren't secrets, written otherwise than those the field learns from."""
    some = lambda n, alphabet: "".join(turn.choices(alphabet, k=n))
    hexes, pick = "0123456789abcdef", turn.choice
    noun, verb = ("report", "garden", "window", "account", "library", "summer"), ("read", "open", "merge", "update", "remove")
    n = lambda top: turn.randrange(top)
    return [
        f"see https://www.{pick(noun)}-{pick(noun)}.org/{2000 + n(30)}/{n(13)}/{pick(verb)}-the-{pick(noun)}-{pick(noun)}.html for more", f"request id {some(8, hexes)}-{some(4, hexes)}-4{some(3, hexes)}-a{some(3, hexes)}-{some(12, hexes)} failed",
        f"fixed in commit {some(8, hexes)} by the {pick(noun)} team", f"released {pick(noun)} {n(9)}.{n(20)}.{n(20)}-beta.{n(9)}+build.{n(999)} today", f"set userId{n(99)} and {pick(verb)}{pick(noun).title()}{pick(noun).title()}By{pick(noun).title()}{n(9)} first",
        f"import org.{pick(noun)}.{pick(noun)}.{pick(verb)}.{pick(noun).title()}{pick(noun).title()}Factory here", f"moved /usr/local/share/{pick(noun)}/{pick(noun)}_{pick(verb)}_{n(99)}.tar.gz away", f"the {pick(noun)}_{pick(verb)}_{pick(noun)}_MAX_{n(99)} constant",
        f"call {n(999)}-{n(999)}-{n(9999)} before {1990 + n(40)}-0{1 + n(9)}-1{n(9)}T0{n(9)}:4{n(9)}:00Z", f"{pick(verb)} node_modules/@{pick(noun)}/{pick(noun)}-{pick(verb)}/dist/{pick(noun)}.min.js", f"mail {pick(noun)}.{pick(noun)}{n(99)}@{pick(noun)}.example.com now", f"window-{n(99)}x{n(99)} and {pick(noun)}-v{n(9)}.{n(9)}",
    ]


def test_precision_on_what_is_no_secret(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect() if r["text"] and len(r["text"]) <= 20_000]
    field, turn = S.fit(texts[:600]), random.Random(8)
    lines = [x for _ in range(25) for x in harmless_lines(turn)]
    false = [x for x in lines if S.all_spans(x, field)[1]]
    assert len(false) <= 0.01 * len(lines), false[:9]
    whole = "\n".join(lines[:12])
    assert S.masked(whole, S.all_spans(whole, field)[1]) == whole
    secrets = [s for _ in range(15) for s in unseen_secrets(turn).values()]
    assert sum(any(k == 3 for _, k, _ in S.all_spans(f"{pre} {s}", field)[1]) for s, pre in zip(secrets, ["use the key", "and then", "config", ""] * 30, strict=False)) >= 0.9 * len(secrets)
