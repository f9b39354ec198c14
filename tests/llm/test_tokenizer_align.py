import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from blockweave.llm import registry
from blockweave.llm import tokenizer_align as T
from tests.llm.helpers import SAMPLE, docs

A = Tokenizer.from_file(T.FILE_A)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=T.FILE_B)
LETTERS = T.byte_letters()


def token_bytes(text):
    """(ids, bytes) of both sides of a whole text, by the libraries alone."""
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    of_a = [bytes(LETTERS[c] for c in A.id_to_token(k)) if k < 50256 else b"<|endoftext|>" for k in a]
    of_b = [bytes([int(B.id_to_piece(k)[3:5], 16)]) if B.is_byte(k) else B.id_to_piece(k).replace("▁", " ").encode() for k in b]
    return a, b, of_a, of_b


def one(text):
    """Groups text and linked pairs of a text; None without tokens."""
    if not text:
        return None
    a, b, of_a, of_b = token_bytes(text)
    raw = (" " + text).encode()
    if b"".join(of_a) != raw or b"".join(of_b) != raw:
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in of_a]).tolist(), np.cumsum([len(x) for x in of_b]).tolist()
    links = []
    for i, x in enumerate(ends_a):
        for j, y in enumerate(ends_b):
            if (ends_a[i - 1] if i else 0) < y and (ends_b[j - 1] if j else 0) < x:
                links.append((a[i], b[j]))
    groups, i, j = [], 0, 0
    for e in sorted(set(ends_a) & set(ends_b)):
        p, q = ends_a.index(e) + 1, ends_b.index(e) + 1
        groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
        i, j = p, q
    return a, b, groups, links


def brute(rows):
    made = [(i, one(t)) for i, t in rows]
    count = Counter(p for _, x in made if x for p in set(x[3]))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for i, x in made:
        if not x:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = x
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


TEXTS = [
    "Hello world, tokens don't align.", "  two  spaces\n\nlines\t tabs ", "", None, " ", "\n", "a", "<|endoftext|> and <s> </s> <unk> <0x41>", "Größe naïve 東京 \U0001f600\U0001f468‍\U0001f469 é",
    "has ▁ the mark", "x y   z\x1c q\x85 r", "nul \0 byte", "zzzz" * 300, "word " * 700, "Hello world, tokens don't align.", "a" * 70 + " " + "b" * 70, "ﬁ ２ ½ ①", "'s 're a's  's", "1234567 89 3.14", " leading", "trailing ", "　wide　 space", "́accent é",
]


@pytest.mark.parametrize(("block", "piece", "chars"), [(10**6, 512, 10**6), (100, 7, 500), (10**6, 1, 1)])
def test_same_as_brute_force(spark, block, piece, chars):
    rows = list(enumerate(TEXTS)) + [(3, "word " * 5), (None, "Hello world")]
    got = T.alignment(docs(spark, rows).repartition(3), block=block, piece=piece, batch_chars=chars)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SAMPLE}/documents.parquet").select("doc_id", "text").collect()]
    assert sum(len(t or "") for _, t in rows) > 10_000
    got = {r["doc_id"]: tuple(r) for r in registry.op11_tokenizer_align(spark, SAMPLE).collect()}
    assert len(got) == len(rows)
    short = [(i, t) for i, t in rows if len(t or "") < 6000]
    # The numbers of the corpus come from all rows; those of a row alone are held against the libraries.
    for i, t in short[:120]:
        x = one(t)
        want = (len(x[0]), len(x[1]), len(x[2]), len(x[3])) if x else (0, 0, 0, 0)
        assert got[i][1:5] == want and got[i][7] == (hashlib.sha256(";".join(x[2]).encode()).hexdigest() if x else "")


def test_empty_table(spark):
    assert T.alignment(docs(spark, ["a"]).limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab 'sT1.\n\t▁é東 \0-"), max_size=40), max_size=5))
def test_parts_make_whole_texts(texts):
    parts = T.Parts(T.tokenizer_a(T.FILE_A), T.tokenizer_b(T.FILE_B))
    texts = [t for t in texts if t]
    (ids_a, n_a), (ids_b, n_b), good = parts.tokens(texts) if texts else ((np.zeros(0), []), (np.zeros(0), []), [])
    at_a = at_b = 0
    for t, a, b, ok in zip(texts, n_a, n_b, good, strict=True):
        x = one(t)
        assert ok == (x is not None)
        if x:
            assert ids_a[at_a : at_a + a].tolist() == x[0] and ids_b[at_b : at_b + b].tolist() == x[1]
        at_a, at_b = at_a + a, at_b + b


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 60), max_size=40), st.sets(st.integers(1, 60), max_size=40), st.integers(1, 9))
def test_merge_of_any_ends(a, b, piece):
    end = max([1, *a, *b])
    a, b = np.array(sorted(a | {end})), np.array(sorted(b | {end}))
    left, right, ends = T.merge(a, b, piece)
    want = [(i, j) for i in range(len(a)) for j in range(len(b)) if (a[i - 1] if i else 0) < b[j] and (b[j - 1] if j else 0) < a[i]]
    assert sorted(zip(left.tolist(), right.tolist(), strict=True)) == want
    assert ends.tolist() == [[a.tolist().index(e) + 1, b.tolist().index(e) + 1] for e in sorted(set(a.tolist()) & set(b.tolist()))]
