import zlib

import numpy as np

from blockweave.llm import language_id as L
from blockweave.llm import registry
from tests.llm.helpers import docs

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = registry.op4_language_id(spark, SF).collect()
    assert len(rows) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"] and langs[r["doc_id"]]]
    assert np.mean(held) > 0.97


def test_kernel_is_the_normalised_count_of_shared_grams():
    texts = ["abc abd", "xyz", "abd x"]
    model = L.KernelModel(texts, ["p", "q", "p"], landmarks=3)

    def spectrum(t):
        b = t.encode()
        return {b[k : k + n] for n in (1, 2, 3) for k in range(len(b) - n + 1)}

    sets = [spectrum(t) for t in texts]
    order = [0, 1, 2]  # landmarks are taken in turn of the languages: p, q, p
    want = [[len(a & sets[k]) / (len(a) * len(sets[k])) ** 0.5 for k in order] for a in sets]
    assert np.allclose(model.kernel(texts), want, atol=1e-5)


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = [(k, "le chat et la souris" if k % 2 else "the cat and the mouse") for k in range(80)]
    some = docs(spark, rows).withColumn("lang", L.F.when(L.held_out("doc_id"), "wrong").when(L.F.col("doc_id") % 2 == 1, "fr").otherwise("en"))
    got = L.predict(some, L.train(some)).collect()
    assert {(r["doc_id"] % 2, r["lang_pred"]) for r in got} == {(1, "fr"), (0, "en")}


def test_odd_texts(spark):
    some = docs(spark, [None, "", "12 34 !?", "word", (None, "word"), "w " * 300_000])
    rows = L.predict(some, L.train(docs(spark, [(k, "some english words") for k in range(20)]))).collect()
    assert sorted(r["lang_pred"] for r in rows) == ["en", "en", "en", "und", "und", "und"]
    assert {r["lang_pred"] for r in L.predict(some, L.train(some.limit(0))).collect()} == {"und"}
    assert L.predict(some.limit(0), None).count() == 0
