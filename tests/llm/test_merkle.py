import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from blockweave.llm import merkle as M
from blockweave.llm import registry
from tests.llm.helpers import SAMPLE

FORM = "doc_id long, source string, lang string, n_chars long, text string, extra string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes, fanout):
    """The last node, and for each first node the (left, right) siblings of all levels."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, k in zip(proofs, at, strict=True):
            run = nodes[k // fanout * fanout :][:fanout]
            p.append(("".join(run[: k % fanout]), "".join(run[k % fanout + 1 :])))
        nodes = [h(*nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)]
        at = [k // fanout for k in at]
    return nodes[0], proofs


def brute(rows, fanout=16):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in names:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs[s] = own, *tree([leaf(r) for r in own], fanout)
    root, above = tree([subs[s][1] for s in names], fanout)
    out = []
    for s, up in zip(names, above, strict=True):
        own, subroot, proofs = subs[s]
        for r, p in zip(own, proofs, strict=True):
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            acc = leaf((*r[:4], text))
            for a, b in p + up:
                acc = h(a, acc, b)
            out.append((r[0], leaf(r), subroot, root, h(*[a + b for a, b in p + up]), acc, acc == root))
    return sorted(out, key=str)


def rows_of(sizes):
    out = []
    for s, n in sizes.items():
        out += [(1000 * len(out) + 7 * k, s, None if k % 3 else "en", k, None if k % 11 == 5 else f"Text {k} of É {s}") for k in range(n)]
    return out


CASES = {
    "one row": (rows_of({"a": 1}), 16),
    "edges of runs": (rows_of({"a": 16, "b": 17, "c": 15, "": 32, None: 33, "Z": 1}), 16),
    "three levels": (rows_of({"hot": 300, "é": 5}), 16),
    "many sources": (rows_of({f"s{k}": 1 + k % 3 for k in range(40)}), 16),
    "fan of two": (rows_of({"a": 37, "b": 8, None: 1}), 2),
    "nulls, ties, repeats": ([(None, None, None, None, None), (None, "a", None, None, ""), (1, "a", "x", 1, "T"), (1, "a", "x", 1, "T"), (1, "a", "x", 1, "t"), (1, "a", None, 1, "T"), (2, "a", "", 0, "LONG " * 50_000)], 16),
}


@pytest.mark.parametrize("name", CASES)
def test_same_as_brute_force(spark, name):
    rows, fanout = CASES[name]
    docs = spark.createDataFrame([(*r, "x") for r in rows], FORM).repartition(3)
    got = M.verify(M.manifest(docs, fanout=fanout, seen=M.lowered_for()))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, fanout)


def test_same_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SAMPLE}/documents.parquet')")
    want = con.execute(registry.ORACLE_SQL["op13_merkle_manifest"]).fetchall()
    got = registry.op13_merkle_manifest(spark, SAMPLE)
    assert got.columns == [c[0] for c in con.description]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_untampered_rows_verify_and_a_change_moves_the_root(spark):
    docs = spark.createDataFrame([(*r, "x") for r in rows_of({"a": 40, "b": 3})], FORM)
    one = M.manifest(docs)
    assert M.verify(one).where("verified").count() == 43
    other = M.manifest(docs.withColumn("lang", F.when(F.col("doc_id") == 7, "zz").otherwise(F.col("lang"))))
    assert one.root != other.root
    a, b = ({(r["at"], r["level"], r["idx"]): bytes(r["digest"]) for r in m.sources.nodes().collect()} for m in (one, other))
    assert a.keys() == b.keys() and {k for k in a if a[k] != b[k]} == {("=a", 0, 1), ("=a", 1, 0), ("=a", 2, 0)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], FORM)
    m = M.manifest(docs)
    assert m.root is None and M.verify(m).collect() == []
