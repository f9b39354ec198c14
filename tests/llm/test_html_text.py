import re
from html import unescape

from blockweave.llm import html_text as H
from blockweave.llm import registry
from tests.llm.helpers import SAMPLE

PAGE = """<!DOCTYPE html><html><head><title>No</title><script>var t="</p><article>";</script></head><body class="has-sidebar">
<nav><ul><li><a href="/a">Menu one</a><li><a href='/b>'>Menu two</a></ul></nav><header>Site</header>
<div class="ad">Buy now</div><div id="cookie-notice">We use cookies</div>
<article><h1>A  title</h1><p>First <b>bold</b>text &amp; more&nbsp;words<br>next line<p>Second<!-- no --> part of this
 text is long enough, it has many words and no link<form>Your mail</form><ul><li>one<li>two</ul>
<section class="comments"><p>Reader says hello</p></section></article>
<aside>Side</aside><footer>&copy; foot</footer></body></html>"""
TEXT = "A title First boldtext & more words next line Second part of this text is long enough, it has many words and no link one two"


def test_page_without_its_parts():
    assert H.extract(PAGE) == TEXT


def test_page_without_semantic_elements():
    menu = "".join(f"<li><a href=/{k}>Go to {k}</a></li>" for k in range(12))
    body = "".join(f"<p>{'many plain words of a paragraph ' * 12}{k}.</p>" for k in range(6))
    text = H.extract(f"<body><div><ul>{menu}</ul></div><div><div>{body}</div></div><div><a href=x>about</a> <a href=y>terms</a></div></body>")
    assert text.count("paragraph") == 72 and "Go to" not in text and "terms" not in text


def test_comments_inside_the_article():
    assert H.extract('<main class="ad-free-site"><article class="post"><p>Own text</p><article class="comment"><p>Reply</p></article></article></main>') == "Own text"
    assert H.extract('<article class="comments-open"><p>Own text</p></article><div id="comments"><article>Reply that is much longer than the text itself, by far</article></div>') == "Own text"


def test_odd_pages():
    assert H.extract(None) == H.extract("") == H.extract("<html><body></body></html>") == ""
    assert H.extract("just  words &lt;b&gt;") == "just words <b>"
    assert H.extract("<article><p>cut in a t<a hr") == "cut in a t"
    assert H.extract('<article><p class="x>never ends</p><p>text</p></article>').endswith("text")
    assert H.extract("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert len(H.extract("<p>" + "long words " * 200_000)) == 2_199_999


def test_whole_article_of_every_sample_page(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SAMPLE}/pages.parquet").collect()}
    rows = registry.op10_html_text(spark, SAMPLE).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.DOTALL)[1]
        want = " ".join(unescape(re.sub(r"<[a-z/][^>]*(?:>|$)", " ", re.sub(r"</?b>", "", inner))).split())
        assert r["text"] == want and r["n_chars"] == len(r["text"])


def bare(html):
    """The page with all its parts as div, without any name."""
    html = re.sub(r"<(/?)(?:nav|article|footer|header|aside|main|section)\b", r"<\1div", html)
    return re.sub(r'\s(?:class|id|role)="[^"]*"', "", html)


def test_names_of_parts_are_not_needed(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    assert sum(H.extract(bare(h)) == H.extract(h) for h in pages) >= 0.96 * len(pages)


def test_densities_decide(spark, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet(f"{SAMPLE}/pages.parquet").collect()]
    texts = [H.extract(h) for h in pages]
    monkeypatch.setattr(H, "densities", lambda tree, sums: ([1.0] * len(tree.tag), [1.0] * len(tree.tag)))
    assert all(H.extract(h) != t for h, t in zip(pages, texts, strict=True))


def test_sections_lead_and_links_beside_and_inside():
    many = "".join(f"<p>{'plain words of a paragraph ' * 9}{k}.</p>" for k in range(4))
    links = "".join(f"<li><a href=/{k}>Read part {k} as well</a></li>" for k in range(6))
    page = f"<body><div><ul>{links}</ul></div><div><h1>Title</h1><div>{many}</div><div>{many}<ul>{links}</ul><p>Short.</p></div></div><div>About us</div></body>"
    text = H.extract(page)
    assert text.startswith("Title plain") and text.count("paragraph") == 72 and text.endswith("Short.")
    assert "as well" not in text and "About" not in text


def test_a_page_that_is_all_in_a_named_part():
    assert H.extract('<body><div class="share"><p>The only text</p></div></body>') == "The only text"


def test_references_are_decoded_between_tags():
    assert H.extract("<article><p>a&am<b>p;</b> b &lt;c&#62;</p></article>") == "a&amp; b <c>"
    assert H.extract("<article><p>a\u00a0\u2003b&nbsp;c</p></article>") == "a b c"


def test_nulls_and_empty_table(spark):
    rows = [(1, None, None), (None, "u", "<p>x</p>"), (1, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(r["text"] for r in H.extract_pages(df).collect()) == ["", "", "x"]
    assert H.extract_pages(df.limit(0)).count() == 0
