import random
import zlib

import numpy as np

from blockweave.llm import registry
from blockweave.llm import toxicity as X
from tests.llm.helpers import docs

SF = "/root/testdata/sf0.1"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_same_as_brute_force():
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcd") for _ in range(n))
    terms = {word(r.randrange(3, 12)): 1.0 for _ in range(60)}
    automaton = X.LexiconAutomaton(terms, memory=300)
    words = [word(r.randrange(1, 14)) for _ in range(3000)] + list(terms) + ["", "x"]
    for t in list(terms):
        words += [t[1:], t + "a", "z" + t, t[:3] + "zz" + t[4:]]
    for w in words:
        near = [(distance(w, t), t) for t in terms if distance(w, t) <= automaton.edits(t)]
        assert automaton.match(w) == ((min(near)[1], min(near)[0]) if near else None)


def test_quotation_scores_below_abuse():
    lexicon = X.LexiconAutomaton({"idiot": 5.0})
    value = lambda t: X.features(t, lexicon)[2]
    assert value("you are an idiot and that is all") > value("what an idiot that was") > value('they said the word "idiot" once')
    assert value("what an ice") == 0 < value("what an idi0t") == value("what an idioot") < value("what an idiot")
    assert value("il dit « quel idiot » hier") < value("quel idiot hier")


def test_held_out_quality(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = registry.op8_toxicity(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    hit = sum(y and p for y, p in held)
    assert hit / sum(y for y, _ in held) > 0.85 and hit / sum(p for _, p in held) > 0.85
    assert np.mean([y == p for y, p in held]) > 0.97


def test_odd_tables(spark):
    texts = [None, "", "fine words"] + [(10 + k, "such an idiot here" if k % 2 else f"plain words {k}") for k in range(120)] + [(None, "idiot")]
    some = docs(spark, texts)
    labels = spark.createDataFrame([(10 + k, 1, k % 2, "t") for k in range(120)] + [(11, 0, 0, "t"), (None, 1, 1, "t"), (12, 1, None, "t")], "doc_id long, quality int, toxic int, text string")
    model = X.train(some, labels)
    rows = X.score(some, model).collect()
    assert len(rows) == len(texts)
    by = {r["doc_id"]: r for r in rows}
    assert by[11]["predicted"] == 1 and by[None]["predicted"] == 1 and by[1]["predicted"] == 0 and by[12]["predicted"] == 0
    assert X.train(some, labels.limit(0)) is None
    assert {r["score"] for r in X.score(some, None).collect()} == {0.0}
    assert X.score(some.limit(0), model).count() == 0


def test_misspelt_terms_of_four_letters():
    texts = [f"you are scum and more {k}" for k in range(40)] + [f"some fine words {k}" for k in range(40)] + [f"the scam was told {k}" for k in range(40)]
    lexicon = X.with_trust(X.LexiconAutomaton({"scum": 5.0}), texts, [1] * 40 + [0] * 80)
    assert [lexicon.match(w) for w in ("scum", "scvm", "scumm", "scm", "scam")] == [("scum", 0), ("scum", 1), ("scum", 1), ("scum", 1), None]
    assert X.features("you scvm", lexicon)[1] > 0 == X.features("a scam", lexicon)[1]
