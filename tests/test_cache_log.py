"""The cache as a log: two sessions, tombstones, compaction."""

from blockweave.sources.result_cache import ResultCache


def test_sets_append_and_sessions_share(spark, tmp_path):
    a = ResultCache(spark, str(tmp_path / "c"))
    for k in range(6):
        a.set("network", {"k": k % 4}, {"value": k})
    assert len(a.files()) == 6
    b = ResultCache(spark.newSession(), str(tmp_path / "c"))
    assert [b.get("network", {"k": k}) for k in range(5)] == [{"value": 4}, {"value": 5}, {"value": 2}, {"value": 3}, None]
    assert b.invalidate("network", {"k": 1}) == 1 and a.get("network", {"k": 1}) is None
    assert a.compact() == 7 and len(a.files()) == 1
    # The tombstone is young, so that it stays; entries are as before, and a new line covers it.
    assert b.table().count() == 3 and b.lines().where("gone").count() == 1
    b.set("network", {"k": 1}, None)
    assert a.table().count() == 4 and a.get("network", {"k": 0}) == {"value": 4}
    assert a.invalidate() == 4 and b.table().count() == 0 and b.compact() == 3 and a.table().count() == 0


def test_damaged_and_odd_values(spark, tmp_path):
    c = ResultCache(spark, str(tmp_path / "c"))
    assert c.compact() == 0 and c.table().count() == 0 and c.cleanup() == 0 and c.invalidate("search") == 0
    for data in (None, [], {}, 0, "", "a\nb", {"ü": [1.5, None]}):
        c.set("search", {"q": "é"}, data, ttl=0)
        assert c.get("search", {"q": "é"}) == data
    assert c.table().count() == 1
