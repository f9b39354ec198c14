import duckdb

from blockweave.llm import mixing as M
from blockweave.llm import registry
from tests.llm.helpers import SAMPLE, docs


def test_same_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SAMPLE}/documents.parquet')")
    want = con.execute(registry.ORACLE_SQL["op9_mix_sources"]).fetchall()
    got = [tuple(r) for r in registry.op9_mix_sources(spark, SAMPLE).collect()]
    assert sorted(got) == sorted(want)


def test_targets_share_what_full_sources_cannot_take(spark):
    sizes = spark.createDataFrame([("a", 1, 10), ("b", 1, 1000), ("c", 1, 1000), (None, 1, 0)], "source string, n long, source_size long")
    t = {r["source"]: r["target"] for r in M.targets(sizes).collect()}
    assert t["a"] == 20 and t[None] == 0
    assert abs(sum(t.values()) - 1.5 * 2010) < 1e-6 and abs(t["c"] / t["b"] - 2) < 1e-2 or t["c"] == 2000


def test_exact_cut_and_limits(spark):
    texts = [(k, "w " * (k % 7)) for k in range(300)] + [(None, "a b"), (3, "w w w"), (3, "w w w"), (400, None)]
    some = docs(spark, texts, source="big").union(docs(spark, [(900, "x " * 9)], source=None))
    rows = M.plan(some).collect()
    assert len(rows) == len(texts) + 1
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    for source in ("big", None):
        own = [r for r in rows if r["source"] == source]
        assert sum(r["taken"] for r in own) == int(own[0]["target"])
    again = M.plan(some.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_empty_and_null(spark):
    assert M.plan(docs(spark, ["a"]).limit(0)).count() == 0
    rows = M.plan(docs(spark, [None, ""])).collect()
    assert [r["taken"] for r in rows] == [0, 0]
    assert M.mix(docs(spark, ["a b c", "d e f"])).where("taken > 0").count() == 2


def test_equal_rows_take_their_own_shares(spark):
    """Four equal rows and a budget of less than all: the mix takes what the plan takes, and no row moves twice."""
    some = docs(spark, [(1, "a b c d")] * 4 + [(2, "x y z")])
    want = sorted(r["taken"] for r in M.plan(some).where("taken > 0").collect())
    out = M.mix(some)
    assert sorted(r["taken"] for r in out.collect()) == want
    assert [c for c in out.columns if c in some.columns] == some.columns
