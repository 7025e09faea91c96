"""URL and crawl rules on hand-made cases, and links of pages with odd markup."""

from urllib.parse import urljoin, urlparse

from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from docloom.functions import numbers as N
from docloom.functions import text as T
from docloom.operators import web

BASES = ["https://a.org/x/y.html?q=1#f", "http://B.org:80", "https://a.org/x/", "https://a.org/ü/z"]
LINKS = ["g", "./g", "../g", "../../../g", "/g//h/", "?y=2", "#s", "", "//h.com/p/", "HTTP://X.y/A/", "mailto:a@b", "g/../h/./i/..", "g;p=1?q#f", "/", "a/b/?q=/", "http:k", " /t\t"]


def expected(base, link):
    link = link.strip().replace("\t", "")
    if link.startswith("//"):
        link = base.split(":")[0] + ":" + link
    parts = urlparse(urljoin(base, link))._replace(fragment="")
    url, root = parts.geturl(), f"{parts.scheme}://{parts.netloc}/"
    return url.rstrip("/") if url.endswith("/") and len(url) > len(root) else url


def normalized(spark, pairs):
    df = spark.createDataFrame(pairs, "base string, href string")
    return {(r.base, r.href): r.url_norm for r in web.url_normalize(df).collect()}


def test_normalize_like_the_standard_resolver(spark):
    pairs = [(b, l) for b in BASES for l in LINKS]
    got = normalized(spark, pairs)
    assert {p: got[p] for p in pairs} == {p: expected(*p) for p in pairs}


@settings(max_examples=10, deadline=None, derandomize=True)
@given(hs.lists(hs.text("abü./?#", max_size=9).filter(lambda x: ".//" not in x and "///" not in x), min_size=60, max_size=60))
def test_normalize_random_links(spark, links):
    pairs = sorted({(b, l) for b in BASES[:3] for l in links})
    got = normalized(spark, pairs)
    assert {p: got[p] for p in pairs} == {p: expected(*p) for p in pairs}


def test_scalars(spark):
    df = spark.createDataFrame([("https://h/docs/api/overview", "docs_api_overview.md"), ("https://h/", "index.md"), ("https://h/blog/my-post?v=2", "blog_my-post.md"),
                                ("https://h/a/b.v2.html", "a_b.v2.md"), ("https://h/a.b/c", "a.b_c.md"), ("https://h/x.md", "x.md"), ("https://h/é//ü!", "é_ü.md")], "u string, want string")
    assert all(r.got == r.want for r in df.select("want", T.file_name(F.col("u")).alias("got")).collect())
    nums = spark.createDataFrame([("-1.234,56", "-1234.56"), ("REVISAR", None), ("", None), ("1.000.000,00", "1000000.00"), ("x", None)], "s string, want string")
    assert all(str(r.got) == str(r.want) for r in nums.select("want", N.parse_es_number(F.col("s")).alias("got")).collect())
    ids = spark.createDataFrame([("ES78971220F", "78971220F"), ("ESB93445385", "B93445385"), ("LU20260743", "LU20260743"), ("FR12345678901", "FR12345678901")], "s string, want string")
    assert all(r.got == r.want for r in ids.select("want", N.tax_id(F.col("s")).alias("got")).collect())
    assert spark.range(1).select(N.column_letters(F.lit(64)).alias("c")).first().c == "BL"


def test_links_of_odd_markup(spark):
    html = """<A class=x HREF='b'>1</A><a data-href="no" href=c>2</a><!-- <a href="gone">x</a> --><script>"<a href='js'>"</script>
    <a href="b#again">3</a><a href="d.PDF?x">4</a><a href="e?a=1&amp;b=2">5</a><a href="//sub.h.org/f">6</a><a href="https://other.org">7</a><a>8</a><a href="tel:1">9</a>"""
    df = spark.createDataFrame([(1, "https://h.org/p/a", html)], "page_id int, url string, html string")
    got = [r.link for r in web.page_links(df).orderBy("pos").collect()]
    assert got == ["https://h.org/p/b", "https://h.org/p/c", "https://h.org/p/e?a=1&b=2", "https://sub.h.org/f"]
    docs = [r.link for r in web.page_links(df, docs_rules=True).orderBy("pos").collect()]
    assert "https://h.org/p/d.PDF?x" in docs


def test_robots_rules(spark):
    urls = spark.createDataFrame([("https://h.org/a/b",), ("https://h.org/c",), ("https://free.org/a",), ("https://e.org/z",), ("https://s.org",)], "url string")
    rules = spark.createDataFrame([("h.org", 1, True, "/a/b"), ("h.org", 2, False, "/a"), ("h.org", 3, False, "/c"), ("e.org", 1, False, ""), ("s.org", 1, False, "*")],
                                  "host string, rule_ord int, allow boolean, prefix string")
    got = {r.url: r.allowed for r in web.robots_filter(urls, rules).collect()}
    assert got == {"https://h.org/a/b": True, "https://h.org/c": False, "https://free.org/a": True, "https://e.org/z": True, "https://s.org": False}


def test_character_references_in_links(spark):
    cases = {"caf&eacute;": "café", "a&#38;b": "a&b", "a&#x26;b": "a&b", "a&amp;lt;b": "a&lt;b", "?x=1&copy=2": "?x=1&copy=2", "x&copy;": "x©", "&#x1F600;&#8364;": "😀€", "&nosuch;": "&nosuch;",
             "&#0;": "�", "&copyx=1": "&copyx=1", "plain": "plain", "&CounterClockwiseContourIntegral;": "∳"}
    rows = spark.createDataFrame([(f'<a href="{k}">x</a>',) for k in cases], "html string")
    assert [r[0] for r in rows.select(web.hrefs(F.col("html"))[0]).collect()] == list(cases.values())


def test_steps_above_the_root(spark):
    pairs = [("http://b.org", "../"), ("https://a.org/x/", "../../"), ("https://a.org/x/y", "../../../z"), ("https://a.org/x/y/", "..")]
    assert normalized(spark, pairs) == {p: expected(*p) for p in pairs}


def test_navigation_of_frameworks(spark):
    """Only links of the navigation of the page's framework; body and footer links never push them out; crawl where there is none."""
    from docloom.sources.markup import html_nodes

    nav = '<li><a href="/n1">1</a></li><li><a href="/n2#x">2</a></li><li><a href="/n1">1</a><a href="#top">t</a><a href="https://other.org/">o</a><a>no</a></li>'
    body = '<p><a href="/body1">b</a></p>{}<article><a href="/body2">c</a></article><footer><a href="/foot">f</a></footer>'
    html = {
        "mkdocs": '<meta name="generator" content="mkdocs">' + body.format("<nav>" + nav.replace("<a ", '<a class="md-nav__link" ') + '</nav><nav class="sidebar"><a href="/wrong">w</a></nav>'),
        "readthedocs": "<i>readthedocs</i>" + body.format('<div class="a sphinxsidebar"><ul>' + nav + "</ul></div><aside><nav><a href='/wrong'>w</a></nav></aside>"),
        "gitbook": '<div class="gitbook-root">gitbook</div>' + body.format(f'<nav class="sidebar">{nav}</nav>'),
        "generic": body.format(f'<aside><div><nav>{nav}</nav></div></aside>'),
        "generic2": body.format(f'<div class="x sidebar"><nav class="y"><ul>{nav}</ul></nav></div><nav><a href="/wrong">w</a></nav>'),
        "none": body.format(f"<nav>{nav}</nav>"), "empty": "",
    }
    urls = {name: f"http://{name}.org/docs" for name in html}
    pages = spark.createDataFrame([(i, urls[n], h) for i, (n, h) in enumerate(html.items())], "page_id long, url string, html string")
    nodes = html_nodes(pages, "page_id")
    found = {r["page_id"]: (r["framework"], r["hrefs"]) for r in web.sidebar_links(pages, nodes).collect()}
    assert {found[i][0] for i in (0, 1, 2)} == {"mkdocs", "readthedocs", "gitbook"} and set(found) == {0, 1, 2, 3, 4}
    edges = web.page_links(pages, docs_rules=True).select(F.col("url").alias("src"), "pos", F.col("link").alias("dst"))
    got = {}
    for r in web.sidebar_order(pages, nodes, 3, edges, 1).orderBy("page_id", "visit_no").collect():
        got.setdefault(r["page_id"], []).append(r["link"].split(".org")[1])
    want = ["/docs", "/n1", "/n2"]
    assert got == {i: want for i in range(5)} | {5: ["/docs", "/body1", "/n1"], 6: ["/docs"]}
    assert {r["page_id"] for r in web.sidebar_order(pages, nodes, 3).collect()} == set(range(5))
    assert web.sidebar_order(pages, nodes, 2, framework="vuepress").count() == 0
