import re

from pyspark.sql import functions as F

from blockweave.llm import registry
from blockweave.llm import url_templates as U
from tests.llm.helpers import SAMPLE


def pages(spark, urls):
    return spark.createDataFrame([(k, u, None, "x") for k, u in enumerate(urls)], "page_id long, url string, html string, host string")


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_rules_same_as_brute_force(spark):
    urls = [r["url"] for r in spark.read.parquet(f"{SAMPLE}/pages.parquet").collect()]
    rows = registry.op6_url_templates(spark, SAMPLE).collect()
    by = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SAMPLE}/pages.parquet").collect()}
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, verdict = brute(by[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG", "http://a.org/x://y/z", "http://Éx.COM/fr/?q#f", "http://xcom/de/1", "http://example.org/en/12#a", "x://h?a://b/c", "http://a.b\n.org/p\nq", "http://h.net/" + "a/" * 5000]
    rows = {r["page_id"]: r for r in U.judge(pages(spark, urls)).collect()}
    for k, u in enumerate(urls):
        assert (rows[k]["host"], rows[k]["path"], rows[k]["rule"]) == brute(u)[:3], u
    assert U.judge(pages(spark, urls).limit(0)).count() == 0
    assert U.judge(pages(spark, ["http://a.net/x"] * 3)).count() == 3


def test_templates_of_mixed_purity_are_told_apart(spark):
    urls = [f"http://shop.net/item/{k}" for k in range(60)] + [f"http://shop.net/promo/{k}" for k in range(60)] + [f"http://shop.net/u{chr(97 + k % 26)}{chr(97 + k // 26)}/home" for k in range(60)]
    label = F.when(F.col("url").contains("/promo/") & (F.col("page_id") % 2 == 0), "block").when((F.col("page_id") % 2 == 0), "allow")
    rows = U.judge(pages(spark, urls), label=label, rules=()).collect()
    by = {r["page_id"]: r for r in rows}
    assert by[3]["template"] == "/item/<n>" and by[3]["verdict"] == "allow"
    assert by[61]["template"] == "/promo/<n>" and by[61]["verdict"] == "block"
    assert by[121]["template"] == "/*/home" and by[121]["verdict"] == "allow"
