import re
from collections import Counter

import corpus_pipeline as P
from blockweave.llm import secrets
from tests.llm.test_decontaminate import WORD as BENCH_WORD
from tests.llm.test_decontaminate import lower
from tests.llm.test_near_dedup import brute as groups
from tests.llm.test_line_quality import brute as measures
from tests.llm.helpers import SAMPLE


def test_stages_in_order():
    assert [name for name, _ in P.STAGES] == ["quality rules", "near-duplicates", "benchmark decontamination", "secret scan", "source mix"]


def test_same_as_brute_force(spark):
    """Each stage's rows again, by plain Python; no host of the sample has enough documents for a boilerplate line."""
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SAMPLE}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SAMPLE}/benchmark.parquet").collect()]
    good = {i: r["text"] for i, r in docs.items() if not ((m := measures(r["text"]))[0] < 50 or 100 * m[4] > 50 * m[0])}
    good = {i: good[i] for i, _, c in groups(sorted(good.items()), 5) if i == c}
    windows = {tuple(w[k : k + 10]) for t in items for w in [BENCH_WORD.findall(lower(t))] for k in range(max(1, len(w) - 9))}
    assert min(map(len, windows)) == 10
    good = {i: t for i, t in good.items() if not any(tuple(w[k : k + 10]) in windows for w in [BENCH_WORD.findall(lower(t))] for k in range(len(w)))}
    rows = P.run(spark, SAMPLE).collect()
    kept = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(kept) and set(kept) <= set(good)
    for i, r in kept.items():
        assert secrets.pattern_spans(r["text"]) == [] and r["n_chars"] == len(r["text"])
        assert (r["text"] == good[i]) or secrets.MASK in r["text"]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) and 0 < r["taken"] <= 2 * r["size"]
    sources = Counter()
    for r in rows:
        sources[r["source"]] += r["taken"]
    targets = {r["source"]: r["target"] for r in rows}
    assert all(sources[s] == int(targets[s]) for s in sources)
    left_out = [i for i in good if i not in kept]
    assert all(sources[docs[i]["source"]] < 1.5 * sum(kept[j]["size"] for j in kept if docs[j]["source"] == docs[i]["source"]) for i in left_out)
