import random
import re

import numpy as np
import pytest

from blockweave.llm import near_dedup as N
from blockweave.llm import registry
from blockweave.llm.components import components
from tests.llm.helpers import SAMPLE, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width, percent=80):
    """(doc_id, n_shingles, component_id) of every row, all pairs compared."""
    sets = []
    for _, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        size = min(width, len(w))
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if w else frozenset())
    top = list(range(len(rows)))

    def find(k):
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    top[find(a)] = find(b)
    first = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            first[find(k)] = min(first.get(find(k), i), i)
    return sorted(((i, len(s), first.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed,width", [(1, 2), (2, 5)])
def test_same_as_brute_force(spark, seed, width):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé") for _ in range(3))
    rows = []
    for g in range(8):
        base = [word() for _ in range(r.choice([1, 2, 6, 40, 120]))]
        for _ in range(12):
            w = list(base)
            for _ in range(r.randrange(8)):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows) + 10, " ".join(w).upper() if g % 2 else "\n".join(w)))
    rows += [(None, rows[5][1]), (3, None), (4, ""), (2, rows[20][1]), (30, rows[20][1]), (30, rows[20][1])]
    got = N.group(docs(spark, rows), width=width)
    assert found(got) == brute(rows, width)
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got.where("doc_id is not null").collect())


def test_query_on_sample_same_as_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SAMPLE}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows, 2)
    assert found(registry.op7_near_dedup(spark, SAMPLE)) == want
    assert any(i != c for i, _, c in want)


def test_chain_through_partners_that_are_not_the_pivot(spark):
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[12 * k : 12 * k + 200])) for k in range(12)]
    assert found(N.group(docs(spark, rows), width=2)) == brute(rows, 2)


def test_sketch_estimates_similarity_and_fills_every_place():
    r = np.random.default_rng(1)
    common = r.integers(0, 1 << 63, 400).astype(np.uint64)
    a, b = np.append(common, r.integers(0, 1 << 63, 100).astype(np.uint64)), np.append(common, r.integers(0, 1 << 63, 100).astype(np.uint64))
    s = N.sketches([a, b, common[:1], common[:3]], 800)
    assert (s < np.iinfo(np.uint64).max).all()
    assert abs((s[0] == s[1]).mean() - 400 / 600) < 0.06


def test_one_of_each_group_stays(spark):
    text = " ".join(f"x{k}" for k in range(50))
    some = docs(spark, [(4, text), (9, text + " more"), (4, text), (5, "other words of its own"), (6, None), (None, text)])
    kept = N.dedupe(some)
    assert kept.columns == some.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6]
    assert N.group(some.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {(r[0], r[1]) for r in components(edges).collect()} == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}


def test_component_without_a_common_element_keeps_its_buckets_members(spark):
    # A chain that drifts over its whole length is the largest component; star and centre aren't enough for one more pair.
    words = [f"w{k}" for k in range(1200)]
    texts = {k: words[20 * k : 20 * k + 201] for k in range(40)} | {100: [f"v{k}" for k in range(201)], 101: [f"v{k}" for k in range(10, 211)]}
    sets = {k: N.shingle_set(" ".join(w), 2, N._Hashes()) for k, w in texts.items()}
    rows = [(1, k, len(s)) for k, s in sets.items()]
    members = spark.createDataFrame(rows, "bucket long, node long, n long")
    full = spark.createDataFrame([(k, s.view("int64").tolist(), N.parity(s).tolist()) for k, s in sets.items()], "node long, items array<long>, parity array<long>")
    star = spark.createDataFrame([], "a long, b long, linked boolean")
    labels = spark.createDataFrame([(k, 0) for k in range(40)], "node long, label long")
    got = {r["node"]: r["label"] for r in N._beside_centre(members, star, full, labels, 80).collect()}
    assert got[100] == got[101] and got[0] == 0
