import hashlib
import re

import duckdb
import pytest

from blockweave.llm import exact_dedup as E
from blockweave.llm import registry
from tests.llm.helpers import SAMPLE, docs


def brute(rows):
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row, groups by whole texts."""
    groups = {}
    for k, (i, text) in enumerate(rows):
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", text or ""), []).append((-len(text or ""), i is None, i or 0, k))
    out = []
    for text, members in groups.items():
        best = min(members)
        out += [(rows[k][0], rows[best[3]][0], len(members), k == best[3], hashlib.sha256(text.encode()).hexdigest()) for *_, k in members]
    return sorted(out, key=str)


TEXTS = [(1, "a b c"), (2, "abc"), (3, "a  b\tc\n"), (4, None), (5, ""), (6, " \r\x0b\x0c"), (7, "a bc"), (8, "\U0001f600 x"), (9, "\U0001f600\tx "), (10, "ABC"), (11, "z" * 300_000), (12, "z " * 300_000), (3, "a  b\tc\n"), (None, "a b c  "), (None, "q"), (0, "q")]


@pytest.mark.parametrize("share", [1, 3, 1000, 10**9])
def test_same_as_brute_force(spark, share):
    """The split into frequent and other digests doesn't show in the result."""
    rows = TEXTS + [(100 + k, f"t {k % 5} " * (k % 3)) for k in range(60)]
    got = E.group(docs(spark, rows).repartition(5), share=min(share, 1000)) if share < 10**9 else E.group(docs(spark, rows), share=1000, counters=2000)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_frequent_digests_are_named(spark):
    """A third of the rows and a run of small groups: the counters name what holds more than its share."""
    some = docs(spark, [(k, "hot" if k % 3 == 0 else f"warm {k % 2}" if k % 3 == 1 else f"own {k}") for k in range(3000)])
    rows = E.cut(E.digests(some.repartition(7)))
    named = {bytes(r[0]) for r in E.candidates(rows, counters=64, most=8).select("digest").distinct().collect()}
    need = {hashlib.sha256(t.encode()).digest() for t in ("hot", "warm0", "warm1")}
    assert need <= named and len(named) <= 16


def test_same_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SAMPLE}/documents.parquet')")
    want = con.execute(registry.ORACLE_SQL["op12_exact_dedup"]).fetchall()
    got = registry.op12_exact_dedup(spark, SAMPLE)
    assert got.columns == [c[0] for c in con.description]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_empty_table(spark):
    assert E.group(docs(spark, ["a"]).limit(0)).collect() == []
    assert E.dedupe(docs(spark, ["a"]).limit(0)).collect() == []


@pytest.mark.parametrize("share", [2, 1000])
def test_dedupe_keeps_one_of_each_class_and_all_columns(spark, share):
    from pyspark.sql import functions as F

    some = docs(spark, TEXTS).withColumns({n: F.lit(n) for n in ("row", "_row", "digest", "keep_row", "n", "h", "group_size", "keep_id")})
    out = E.dedupe(some, share=share)
    assert out.columns == some.columns
    rows = out.collect()
    want = [r for r in brute(TEXTS) if r[3]]
    assert sorted((str(r["doc_id"]) for r in rows)) == sorted(str(w[0]) for w in want)
    assert all(r["_row"] == "_row" and r["row"] == "row" and r["digest"] == "digest" for r in rows)


def test_native_plan(spark):
    plan = E.group(docs(spark, TEXTS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
