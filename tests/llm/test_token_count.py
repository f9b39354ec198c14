import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from blockweave.llm import registry
from blockweave.llm import token_count as C
from tests.llm.helpers import SAMPLE, docs


def reference(vocabulary, byte_fallback):
    """The public library's tokenizer with the same vocabulary."""
    unk = next((k for k, (_, _, kind) in enumerate(vocabulary) if kind == 2), None)
    hidden = lambda p, kind: p if kind in (1, 4, 6) else f"\x00{p}\x00"  # noqa: E731  never part of a text
    t = Tokenizer(models.Unigram([(hidden(p, kind), s) for p, s, kind in vocabulary], unk_id=unk, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


TEXTS = ["", " ", "  two  spaces ", "a", "Hello world", "naïve café\nnext\ttab", "日本語 text", "x" * 300, "▁mark", "emoji 😀😀 end", "<0x41> <s>", "é" * 40]


def test_same_as_public_library_on_whole_sample(spark):
    want = reference(C.read_vocabulary(C.MODEL), True)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SAMPLE}/documents.parquet").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in registry.op3_token_count(spark, SAMPLE).collect()}
    assert got == {k: want(t) for k, t in texts.items()}
    model = C.Unigram(C.read_vocabulary(C.MODEL))
    assert [model.count(t) for t in TEXTS] == [want(t) for t in TEXTS]


@pytest.mark.parametrize("seed", range(4))
def test_ties_and_unknown_characters(seed):
    r = random.Random(seed)
    words = {"".join(r.choice("abc▁") for _ in range(r.randrange(1, 5))) for _ in range(25)} | {"▁", "a"}
    vocabulary = [("<unk>", 0.0, 2)] + [(w, -float(r.randrange(4)), 1) for w in sorted(words) if "▁" not in w[1:]]
    want, model = reference(vocabulary, False), C.Unigram(vocabulary)
    for _ in range(300):
        text = "".join(r.choice("aabcz ") for _ in range(r.randrange(14)))
        assert model.count(text) == want(text), text


def test_nulls_and_empty_table(spark):
    rows = C.count_tokens(docs(spark, [None, "", "a b", (None, "a b"), (2, "a b")])).collect()
    assert sorted((r["doc_id"] is None, r["n_tokens"]) for r in rows) == [(False, 0), (False, 0), (False, 2), (False, 2), (True, 2)]
    assert C.count_tokens(docs(spark, ["a"]).limit(0)).count() == 0


def test_size_of_model_file_is_checked(tmp_path, monkeypatch):
    monkeypatch.setattr(C, "MAX_BYTES", 10)
    with pytest.raises(ValueError):
        C.read_vocabulary(C.MODEL)
