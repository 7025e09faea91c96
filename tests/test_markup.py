"""Page markup on small hand-written pages."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import dom, markdown
from docloom.session import materialize
from docloom.sources.markup import decode_html, html_nodes


def render(spark, *pages):
    df = spark.createDataFrame([(str(i), h) for i, h in enumerate(pages)], "id string, html string")
    nodes = materialize(html_nodes(df, "id"))
    pruned = dom.prune_nodes(nodes)
    body = dom.within(pruned, dom.main_content(pruned))
    rows = {r.doc_id: r.markdown for r in markdown.page_markdown(body).collect()}
    return [rows.get(str(i)) for i in range(len(pages))]


CASES = {
    "<body><h2> Head <b>x</b></h2><p>One  <em>two</em> three<br>four</p><h3> </h3><p></p></body>":
        "## Head **x**\n\nOne *two* three\nfour\n",
    '<body><p>See <a href="/x"> the <b>page</b></a>, <a href="#f">frag</a> and <code>a  b</code> <kbd>K</kbd></p></body>':
        "See [the **page**](/x), frag and `a  b` `K`\n",
    '<body><pre class="x"><code class="language-Python">if  a:\n  b\n</code></pre><hr><pre>raw\n\ntext</pre></body>':
        "```python\nif  a:\n  b\n```\n\n---\n\n```\nraw\n\ntext\n```\n",
    '<body><ol start="3"><li>a</li><li>b<ul><li>c</li><li>d</li></ul></li></ol></body>':
        "3. a\n4. b\n    - c\n    - d\n",
    "<body><ul><li><p>one</p><p>two</p></li><li>three</li></ul></body>":
        "- one\n  two\n- three\n",
    "<body><blockquote><p>q1</p></blockquote><p>after</p></body>":
        "> q1\n\nafter\n",
    '<body><p>a<img src="i.png" alt=" A " title="T"></p><dl><dt>term</dt><dd>meaning</dd></dl></body>':
        'a![A](i.png "T")\n\n**term**\n: meaning\n',
    '<body><table><tr><th align="left">A</th><th>Long|er</th></tr><tr><td>1</td></tr></table></body>':
        "| A   | Long\\|er |\n| :-- | -------- |\n| 1   |          |\n",
    '<body><div class="cookie-box"><p>no</p></div><p style="display: none">no</p><p aria-hidden="true">no</p><p>yes</p><!-- c --></body>':
        "yes\n",
    '<body><pre>a<code class="language-py">x</code>b<i>c</i>d<i>e</i>f</pre><p>t</p><pre>p<i>q</i>\n\n</pre></body>':
        "```py\nx\n```\n\nt\n\n```\npq\n\n```\n",
    '<body><pre class="lang-go"><b>n</b><code>one\n<i>1</i></code> <code class="language-js">two</code></pre></body>':
        "```go\none\n1\n```\n",
    "<body><p><b><i><s><mark><b><i><s><mark> x </mark></s></i></b></mark></s></i></b> <s><b><i><s><mark><b><i><s> </s></i></b></mark></s></i></b></s>y</p></body>":
        "***~~==***~~==x==~~***==~~*** y\n",
    "<body><p>x <b> bold </b>y <s> gone </s> <b> </b>z</p></body>":
        "x  **bold** y ~~gone~~ z\n",
}


def test_page_markdown(spark):
    got = render(spark, *CASES)
    for (page, want), md in zip(CASES.items(), got):
        assert md == want, page


def test_main_content_rules(spark):
    long = "x" * 120
    pages = [f"<body><main>short</main><article>{long}</article></body>", "<body><p>a</p></body>",
             f'<body><div class="content">{long}</div></body>', "<p>no body</p>"]
    df = spark.createDataFrame([(str(i), h) for i, h in enumerate(pages)], "id string, html string")
    nodes = html_nodes(df, "id")
    rules = {r.doc_id: r.rule for r in dom.main_content(nodes).collect()}
    assert rules == {"0": 2, "1": 90, "2": 6, "3": 99}
    custom = {r.doc_id: (r.rule, r.chars) for r in dom.main_content(nodes, "main, p").collect()}
    assert custom["0"] == (0, 5) and custom["1"] == (0, 1) and custom["2"][0] == 6


def test_metadata(spark):
    pages = ['<html lang="es"><meta property="og:title" content=" OG "><title>T</title><meta name="description" content="D">',
             '<html xml:lang="de"><title> T &amp; U </title>', '<meta http-equiv="content-language" content="fr"><h1>H <b>1</b></h1><h1>2</h1>', "<p>x</p>"]
    df = spark.createDataFrame([(str(i), h) for i, h in enumerate(pages)], "id string, html string")
    got = {r.doc_id: (r.title, r.description, r.language) for r in dom.page_metadata(html_nodes(df, "id")).collect()}
    assert got == {"0": ("OG", "D", "es"), "1": ("T & U", "", "de"), "2": ("H1", "", "fr"), "3": ("", "", "")}


def test_table_sections(spark):
    html = ("<table><tfoot><tr><td>f</td></tr></tfoot><tbody><tr><td>b1</td><td>b2</td></tr></tbody>"
            "<tbody><tr><td>second body is not read</td></tr></tbody><thead><tr><th>h</th></tr></thead></table>")
    nodes = html_nodes(spark.createDataFrame([("d", html)], "id string, html string"), "id")
    rows = markdown.html_tables(nodes).orderBy("row_no", "col_no").collect()
    assert [(r.row_no, r.col_no, r.content) for r in rows] == [(0, 0, "h"), (0, 1, ""), (1, 0, "b1"), (1, 1, "b2"), (2, 0, "f"), (2, 1, "")]


def test_charsets(spark):
    rows = [("a", '<meta charset="ISO-8859-1">é'.encode("latin-1")), ("b", "<p>é".encode()), ("c", b'<meta charset="nope">\xc3\xa9'),
            ("d", b'<meta charset="utf-8">\xe9'), ("e", '<meta http-equiv=X content="text/html; charset=windows-1252">€'.encode("cp1252"))]
    got = {r.path: (r.charset, r.html[-1]) for r in decode_html(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a"] == ("iso-8859-1", "é") and got["b"] == ("utf-8", "é") and got["c"] == ("nope", "é")
    assert got["d"][1] == "�" and got["e"] == ("windows-1252", "€")


def test_noise_and_selectors(spark):
    html = '<body class="dark"><nav class="my-sidebar"><a href="1">1</a></nav><aside><nav><a href="2">2</a></nav></aside><a href="3">3</a></body>'
    nodes = html_nodes(spark.createDataFrame([("d", html)], "id string, html string"), "id")
    hit = dom.select(nodes, dom.FRAMEWORK_SELECTORS["generic"]["sidebar_links"]).where("hit")
    assert [r.h for r in hit.orderBy("node_id").select(F.col("attrs")["href"].alias("h")).collect()] == ["1", "2"]


def test_fragments_and_empty_pages_have_rows(spark):
    pages = spark.createDataFrame([(1, "<!-- c --><div>one</div>"), (2, "hello <p>two</p>"), (3, "<nav>x</nav><p>three</p>"), (4, ""), (5, "<body><main>short</main></body>")], "page_id bigint, html string")
    nodes = html_nodes(pages, "page_id")
    regions = dom.main_content(dom.prune_nodes(nodes))
    assert {int(r.doc_id): r.rule for r in regions.collect()} == {1: 99, 2: 99, 3: 99, 5: 90}
    docs = pages.select(F.col("page_id").cast("string").alias("doc_id"), F.lit("").alias("part"))
    part = nodes.select("part").first()[0]
    meta = dom.page_metadata(nodes, docs.withColumn("part", F.lit(part)))
    assert {int(r.doc_id) for r in meta.collect()} == {1, 2, 3, 4, 5}


def test_selectors(spark):
    page = """<nav><a id="1" href="/x">1</a><p><a id="2">2</a></p></nav><ul class="b list"><li id="3" data-k="start-end">3</li></ul>"""
    nodes = html_nodes(spark.createDataFrame([(1, page)], "page_id bigint, html string"), "page_id")
    ids = lambda *s: [r[0] for r in dom.select(nodes, s).where("hit").orderBy("node_id").select(F.col("attrs")["id"]).collect()]
    assert ids("nav a") == ["1", "2"] and ids("nav > a") == ["1"] and ids("nav>p>a") == ["2"] and ids("a[href]") == ["1"]
    assert ids("li[data-k^='start']") == ids("[data-k$='end']") == ids("ul.list > li") == ids("ul[class~='list'] li") == ["3"] and ids("li[data-k^='end']") == []
    for bad in ("li:nth-child(9)", "p:first-child", "a + b", ""):
        with pytest.raises(ValueError):
            dom.simple_match(bad)
