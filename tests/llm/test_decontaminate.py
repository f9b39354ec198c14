import hashlib
import random
import re

import numpy as np
import pytest

from blockweave.llm import decontaminate as D
from blockweave.llm import registry
from tests.llm.helpers import SAMPLE, docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows, items):
    out = []
    for i, text in rows:
        words = WORD.findall(lower(text))
        hit, names = [False] * len(words), set()
        for name, t in items:
            w = WORD.findall(lower(t))
            size = min(10, len(w))
            for k in range(len(w) - size + 1 if w else 0):
                for j in range(len(words) - size + 1):
                    if words[j : j + size] == w[k : k + size]:
                        hit[j : j + size] = [True] * size
                        names.add(str(name))
        out.append((i, len(words), sum(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(sum(hit))))
    return sorted(out, key=str)


def spark_rows(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=str)


def brute_longest(text, items):
    words, best = WORD.findall(lower(text)), (0, 0)
    for _, t in items:
        w = WORD.findall(lower(t))
        for j in range(len(words)):
            for k in range(len(w)):
                n = 0
                while j + n < len(words) and k + n < len(w) and words[j + n] == w[k + n]:
                    n += 1
                if n >= min(10, len(w)):
                    best = max(best, (n, -j))
    return best[0], -best[1] if best[0] else None


def random_rows(seed, n=40):
    r = random.Random(seed)
    words = ["a", "b", "Éa", "c", "d9", "zz"]
    text = lambda k: "".join(r.choice(words) + r.choice([" ", ", ", "\n", "-"]) for _ in range(k))
    items = [(k, text(r.choice([0, 1, 3, 9, 10, 11, 30]))) for k in range(12)] + [(90, None), (91, "")]
    rows = [(k, text(r.randrange(60))) for k in range(n)]
    rows += [(k + 1000, rows[k][1] + (items[k % 12][1] or "") + rows[-k][1]) for k in range(n)]
    return rows + [(5000, None), (5001, ""), (None, rows[3][1]), (7, rows[7][1])], items


@pytest.mark.parametrize("block_bytes,shard", [(4_000_000, 2_000_000), (60, 50)])
def test_same_as_brute_force(spark, block_bytes, shard):
    rows, items = random_rows(block_bytes)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.digest(D.scan(docs(spark, rows), bench, block_bytes=block_bytes, shard_words=shard))
    assert spark_rows(got) == brute(rows, items)
    long = sorted(((r["doc_id"], r["longest_match"], r["longest_at"]) for r in got.collect()), key=str)
    assert long == sorted(((i, *brute_longest(t, items)) for i, t in rows), key=str)


def test_query_on_sample_same_as_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SAMPLE}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SAMPLE}/benchmark.parquet").collect()]
    windows = {}
    for name, t in items:
        w = WORD.findall(lower(t))
        for k in range(max(1, len(w) - 9)):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(name))
    want = []
    for i, text in rows:
        w = WORD.findall(lower(text))
        hit, names = set(), set()
        for j in range(len(w)):
            if found := windows.get(tuple(w[j : j + 10])):
                hit |= set(range(j, j + 10))
                names |= found
        want.append((i, len(w), len(hit), len(names), D.sha256_of(list(names)), bool(hit)))
    assert spark_rows(registry.op1_decontaminate(spark, SAMPLE)) == sorted(want, key=str)
    assert any(x[5] for x in want)


def test_longest_match_and_place(spark):
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20)))], "item_id long, text string")
    text = "other " + " ".join(f"w{k}" for k in range(2, 17)) + " end"
    row = D.scan(docs(spark, [text]), bench).first()
    assert (row["longest_match"], row["longest_at"], row["hits"][0]["start"], row["hits"][0]["end"]) == (15, 1, 1, 16)


def test_suffix_array_is_sorted():
    r = np.random.default_rng(3)
    seq = np.append(r.integers(0, 3, 400), 0).astype(np.int32)
    places = np.flatnonzero(D.run_lengths(seq) >= 2)
    order = D.suffix_array(seq, places, int(D.run_lengths(seq).max()))
    cut_at_zero = lambda p: seq[p : p + D.run_lengths(seq)[p]].tolist()
    assert [cut_at_zero(p) for p in order] == sorted(cut_at_zero(p) for p in places)


def test_empty_tables_and_removal(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    some = docs(spark, ["x one two THREE y", "one two", None])
    assert [r["doc_id"] for r in D.remove(some, bench).orderBy("doc_id").collect()] == [1, 2]
    assert D.remove(some, bench).columns == some.columns
    assert D.scan(some.limit(0), bench).count() == 0
    assert D.remove(some, bench.limit(0)).count() == 3
