"""Web-corpus operators: links, page traits, crawl order, site summaries."""

from __future__ import annotations

from functools import reduce

import json
from functools import reduce
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import urls as U
from docloom.operators import dom
from docloom.operators.ordered import first_n, join_on, numbered
from docloom.session import materialize


# --- projections and predicates ---------------------------------------------------------------

def url_normalize(df: DataFrame, url: str = "href", base: str = "base", name: str = "url_norm") -> DataFrame:
    return df.withColumn(name, U.normalize(F.col(url), F.col(base)))


def is_internal(df: DataFrame, url: str, domain: str | Column, name: str = "internal") -> DataFrame:
    d = F.lit(domain) if isinstance(domain, str) else domain
    return df.withColumn(name, U.internal(F.col(url), d))


def crawlable(df: DataFrame, url: str = "url", pattern: str | None = None) -> DataFrame:
    """Keep addresses worth fetching; ``pattern`` is an optional regex searched in the whole address."""
    keep = U.followable(F.col(url)) & U.page_like(F.col(url))
    return df.where(keep & F.col(url).rlike(pattern) if pattern else keep)


def _gitbook(low: Column) -> Column:
    return low.contains("gitbook") & (low.contains(".gitbook-root") | F.substring(low, 1, 5000).contains("gitbook"))


def detect_framework(df: DataFrame, html: str = "html") -> DataFrame:
    """Documentation framework of a page: the first test that holds, else ``generic``."""
    low = F.lower(F.col(html))
    return df.withColumn(
        "framework",
        F.when(low.contains('<meta name="generator" content="docusaurus') | low.contains("__docusaurus"), "docusaurus")
        .when(_gitbook(low), "gitbook")
        .when(low.contains("readthedocs") | low.contains(".rst-content"), "readthedocs")
        .when(low.rlike(r"""<meta[^>]+name=["']generator["'][^>]+content=["']mkdocs"""), "mkdocs")
        .when(low.contains(".md-content") & low.contains(".md-sidebar"), "mkdocs")
        .when(low.contains("mintlify"), "mintlify")
        .when(low.contains("vuepress") | low.contains(".theme-default-content"), "vuepress")
        .when(low.contains('id="__next"') | low.contains("/_next/"), "nextjs")
        .otherwise("generic"))


# Markup signs of pages that are filled by scripts in the browser.
DYNAMIC_SIGNS = (
    r"""(?i)<div\s+id=["'](?:root|app|__next)["']>\s*</div>""",
    r"""(?i)<div\s+id=["'](?:root|app|__next)["']\s*/>""",
    r"(?i)__NEXT_DATA__",
    r"(?i)<app-root[^>]*>\s*</app-root>",
    r"(?is)<noscript[^>]*>.*?(?:enable|requires?|needs?)\s+javascript",
    r"""(?i)<script[^>]+src=["'][^"']*bundle[^"']*\.js["']""",
    r"""(?i)<script[^>]+src=["'][^"']*main\.[a-f0-9]+\.js["']""",
    r"""(?i)<div\s+id=["']app["']>\s*</div>""",
    r"""(?i)<div\s+id=["']svelte["']""",
)


def detect_dynamic(df: DataFrame, html: str = "html") -> DataFrame:
    """True for a near-empty body with more than two scripts, or any of the markup signs."""
    page = F.col(html)
    body = F.regexp_extract(page, r"(?is)<body\b[^>]*>(.*)", 1)
    body = F.regexp_replace(body, r"(?is)</body\s*>.*$", "")
    # Text pieces are trimmed and joined by one blank; script and style text counts, comments do not.
    pieces = F.filter(F.transform(F.split(F.regexp_replace(body, r"(?s)<!--.*?-->", ""), r"<[^>]*>"), T.strip),
                      lambda s: s != "")
    short = F.length(F.array_join(pieces, " ")) < 100
    scripts = F.size(F.regexp_extract_all(body, F.lit(r"(?i)<script\b"), F.lit(0)))
    hit = page.rlike(r"(?i)<body\b") & short & (scripts > 2)
    for sign in DYNAMIC_SIGNS:
        hit = hit | page.rlike(sign)
    return df.withColumn("dynamic", hit)


def fetch_outcome(log: DataFrame, status: str = "status", attempt: str = "attempt", retries: int = 3) -> DataFrame:
    """Outcome of one fetch attempt, with the wait (2, 4, 8, 16 ... seconds) that follows a retryable one."""
    s, a = F.col(status), F.col(attempt)
    retry = (s == 429) | (s >= 500)
    return (log.withColumn("outcome", F.when(s < 400, "ok").when(retry, "retry").otherwise("fail"))
            .withColumn("wait_s", F.when(retry, F.pow(F.lit(2), a + 1).cast("long")))
            .withColumn("gives_up", retry & (a >= retries)))


def sanitize_filename(df: DataFrame, url: str = "url", name: str = "file") -> DataFrame:
    return df.withColumn(name, T.file_name(F.col(url)))


def slugify(df: DataFrame, title: str = "title", name: str = "slug") -> DataFrame:
    return df.withColumn(name, T.slug(F.col(title)))


def frontmatter(df: DataFrame) -> DataFrame:
    """Adds ``header`` from title, description, url, language and scraped_at."""
    return df.withColumn("header", T.front_matter(*[F.col(c) for c in (
        "title", "description", "url", "language", "scraped_at")]))


def strip_frontmatter(df: DataFrame, md: str = "markdown", name: str = "body") -> DataFrame:
    return df.withColumn(name, T.without_front_matter(F.col(md)))


def markdown_title(df: DataFrame, md: str = "markdown") -> DataFrame:
    return df.withColumn("crawl_title", T.crawl_title(F.col(md))).withColumn("docs_title", T.docs_title(F.col(md)))


# --- links --------------------------------------------------------------------------------------

_ANCHOR = r"""(?is)<a\s[^>]*?(?<![\w\-])href\s*=\s*["']?((?<=")[^"]*|(?<=')[^']*|(?<!["'])[^\s"'>]+)"""
_INERT = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"


_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*+(?:;|(?!=)))"


def _code_point(number: Column) -> Column:
    """The character of a number; numbers outside Unicode, surrogates and 0 give the replacement mark."""
    n = number.try_cast("int")
    in_bytes = lambda *parts: F.decode(F.unhex(F.concat(*[F.lpad(F.hex(p), 2, "0") for p in parts])), "UTF-8")
    tail = lambda shift: F.lit(128) + F.shiftright(n, shift).bitwiseAND(63)
    return (F.when(n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit("\ufffd"))
            .when(n < 0x80, in_bytes(n)).when(n < 0x800, in_bytes(F.lit(192) + F.shiftright(n, 6), tail(0)))
            .when(n < 0x10000, in_bytes(F.lit(224) + F.shiftright(n, 12), tail(6), tail(0)))
            .otherwise(in_bytes(F.lit(240) + F.shiftright(n, 18), tail(12), tail(6), tail(0))))


def _reference(r: Column) -> Column:
    """The text of one character reference, or the reference itself where there is none of that name.  The names come
    from the standard library; those without a semicolon are the ones that HTML allows so."""
    body = F.regexp_replace(r, "^&#?[xX]?|;$", "")
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")  # a constant, folded once
    return (F.when(r.rlike("^&#[xX]"), _code_point(F.conv(body, 16, 10))).when(r.startswith("&#"), _code_point(body))
            .otherwise(F.coalesce(F.try_element_at(names, F.substr(r, F.lit(2))), r)))


def _unescape(c: Column) -> Column:
    """Decodes character references once, from left to right; what stands between them stays as it is."""
    found = F.regexp_extract_all(c, F.lit(_REFERENCE), F.lit(0))
    pieces = F.arrays_zip(F.split(c, _REFERENCE, -1).alias("t"), found.alias("r"))
    decoded = F.array_join(F.transform(pieces, lambda x: F.concat(x["t"], F.coalesce(_reference(x["r"]), F.lit("")))), "")
    return F.when(c.contains("&"), decoded).otherwise(c)


def hrefs(html: Column) -> Column:
    """All link targets of a page in page order, read with native expressions: no Python hop, and the
    page text does not leave the scan stage."""
    live = F.regexp_replace(html, _INERT, "")
    return F.transform(F.regexp_extract_all(live, F.lit(_ANCHOR), F.lit(1)), _unescape)


def _docs_link(href: Column) -> Column:
    return (href != "") & ~href.startswith("#") & ~href.startswith("javascript:")


def _distinct_links(found: Column, url: Column, accept_href, accept_url) -> Column:
    """Normalised, accepted links of one page, first occurrence first.  The whole step stays inside the
    page's row, so it needs no shuffle and no link is resolved twice."""
    resolved = U.let(U.base_parts(url), lambda b: F.transform(F.filter(found, accept_href), lambda h: U.resolve(h, b)))
    return F.array_distinct(F.filter(resolved, accept_url))


def page_links(pages: DataFrame, domain: str | Column | None = None, pattern: str | None = None,
               docs_rules: bool = False) -> DataFrame:
    """Distinct internal links per page with their place ``pos`` in first-seen order.

    ``domain`` defaults to the page's own host.  ``docs_rules`` switches to the documentation variant:
    no file-ending filter, and only ``#``, ``javascript:`` and ``mailto:`` links are skipped.
    """
    own = U.host(F.col("url")) if domain is None else (F.lit(domain) if isinstance(domain, str) else domain)

    def accept_url(u: Column) -> Column:
        keep = U.internal(u, own)
        if not docs_rules:
            keep = U.page_like(u) & keep
        return keep & u.rlike(pattern) if pattern else keep

    accept_href = (lambda h: _docs_link(h) & ~h.startswith("mailto:")) if docs_rules else U.followable
    links = _distinct_links(hrefs(F.col("html")), F.col("url"), accept_href, accept_url)
    return pages.select("page_id", "url", F.posexplode(links).alias("pos", "link"))


# --- joins ----------------------------------------------------------------------------------------

def robots_filter(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``allowed``: the first rule of the host whose prefix fits decides; no rule means allowed.

    Rules are packed into one row per host (a robots file is one small file), so a hot host only
    lengthens the left side of the join, which adaptive skew splitting can divide.
    """
    packed = rules.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("rule_ord", "allow", "prefix"))).alias("_rules"))
    target = F.regexp_replace(F.regexp_replace(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*", ""), "#.*$", "")
    target = F.when(target == "", F.lit("/")).otherwise(target)
    with_host = urls.withColumn("_host", U.host(F.col(url))).withColumn("_target", target)
    fits = F.filter("_rules", lambda r: (r["prefix"] == "*") | F.col("_target").startswith(r["prefix"]))
    # A prohibition with an empty prefix prohibits nothing.
    allowed = F.coalesce(F.get(F.transform(fits, lambda r: r["allow"] | (r["prefix"] == "")), F.lit(0)), F.lit(True))
    joined = with_host.join(packed.withColumnRenamed("host", "_host"), "_host", "left").withColumn("allowed", allowed)
    return joined.withColumn("status", F.when(F.col("allowed"), F.lit("")).otherwise("blocked_robots")).drop("_host", "_target", "_rules")


def resume_pending(candidates: DataFrame, index: DataFrame, url: str = "url") -> DataFrame:
    """Candidates that the index does not hold under any status; they restart at depth 0."""
    return candidates.join(index.select(url), url, "left_anti").withColumn("depth", F.lit(0))


def crawl_levels(edges: DataFrame, seeds: DataFrame, max_depth: int = 3, max_pages: int | None = None) -> DataFrame:
    """Breadth-first levels: each node once per site, at its smallest depth.

    ``seeds(site, node)``, ``edges(src, pos, dst)`` -> ``(site, node, depth, visit_no)``.  One join per
    level, an anti join against what was seen, and a written table per level; the loop only asks
    whether a level is empty.  ``visit_no`` (breadth-first order: parent's number, then link position)
    is computed when ``max_pages`` is given, and pages after that number are not visited.
    """
    links = materialize(edges.groupBy("src", "dst").agg(F.min("pos").alias("pos")))
    level = seeds.select("site", "node").distinct().withColumn("depth", F.lit(0))
    ranked = max_pages is not None
    if ranked:
        level = numbered(level, ["site"], ["node"], "visit_no").where(F.col("visit_no") <= max_pages)
    else:
        level = level.withColumn("visit_no", F.lit(None).cast("long"))
    level = materialize(level)
    seen = [level]
    for depth in range(1, max_depth + 1):
        visited = seen[0]
        for s in seen[1:]:
            visited = visited.unionByName(s)
        found = (level.join(links, level["node"] == links["src"])
                 .groupBy("site", F.col("dst").alias("node"))
                 .agg(F.min(F.struct("visit_no", "pos")).alias("_via")))
        fresh = found.join(visited.select("site", "node"), ["site", "node"], "left_anti").withColumn("depth", F.lit(depth))
        if ranked:
            fresh = numbered(fresh.select("site", "node", "depth", "_via.visit_no", "_via.pos"), ["site"],
                             ["visit_no", "pos", "node"], "_in_level")
            used = visited.groupBy("site").agg(F.max("visit_no").alias("_used"))
            fresh = (join_on(fresh.select("site", "node", "depth", "_in_level"), used, ["site"])
                     .withColumn("visit_no", F.col("_used") + F.col("_in_level"))
                     .where(F.col("visit_no") <= max_pages).select("site", "node", "depth", "visit_no"))
        else:
            fresh = fresh.select("site", "node", "depth", F.lit(None).cast("long").alias("visit_no"))
        level = materialize(fresh)
        if level.isEmpty():
            break
        seen.append(level)
    out = seen[0]
    for s in seen[1:]:
        out = out.unionByName(s)
    return out


# --- aggregations and ordered listings --------------------------------------------------------------

def crawl_summary(index: DataFrame) -> DataFrame:
    s = F.col("status")
    return index.agg(F.count_if(s == "success").alias("n_success"), F.count_if(s.startswith("error")).alias("n_errors"),
                     F.count_if(s == "blocked_robots").alias("n_blocked"))


def filename_collisions(pages: DataFrame, url: str = "url") -> DataFrame:
    """Names that several addresses of one host map to, with how many."""
    named = pages.select(U.host(F.col(url)).alias("host"), T.file_name(F.col(url)).alias("file"), F.col(url).alias("_u"))
    distinct = named.groupBy("host", "file", "_u").count()
    return distinct.groupBy("host", "file").agg(F.count(F.lit(1)).alias("n_urls")).where("n_urls > 1")


def sidebar_links(pages: DataFrame, nodes: DataFrame, framework: str | None = None) -> DataFrame:
    """Navigation links of each page, by the selectors of its documentation framework, in document order:
    ``(page_id, url, framework, hrefs)``.  Pages without any have no row.

    ``nodes`` are the pages' markup with the page as ``doc_id``.  The selectors of all frameworks are matched in one pass
    over the elements in document order; each page then reads the match of its own framework (``framework`` names one
    for all pages, else it is detected).
    """
    found = detect_framework(pages) if framework is None else pages.withColumn("framework", F.lit(framework))
    named = F.when(F.col("framework").isin(*dom.FRAMEWORK_SELECTORS), F.col("framework")).otherwise("generic")
    known = found.select("page_id", "url", named.alias("framework"), F.col("page_id").cast("string").alias("doc_id"))
    marked = nodes.where("kind = 'e'").select(*dom.DOC, "node_id", "parent_id", "end_id", "kind", "tag", "attrs")
    marks = {}
    for name, rules in dom.FRAMEWORK_SELECTORS.items():
        same = tuple(rules["sidebar_links"])
        if same not in marks:
            marks[same] = f"_nav{len(marks)}"
            marked = dom.select(marked, same, marks[same])
    href = F.coalesce(F.col("attrs")["href"], F.lit(""))
    hits = marked.where((href != "") & reduce(lambda x, y: x | y, map(F.col, marks.values()))).select("doc_id", "node_id", href.alias("_href"), *marks.values()).join(known, "doc_id")
    mine = reduce(lambda x, y: x | y, [(F.col("framework") == name) & F.col(marks[tuple(rules["sidebar_links"])]) for name, rules in dom.FRAMEWORK_SELECTORS.items()])
    listed = hits.where(mine).groupBy("page_id", "url", "framework").agg(F.sort_array(F.collect_list(F.struct("node_id", "_href"))).alias("_l"))
    return listed.select("page_id", "url", "framework", F.col("_l._href").alias("hrefs"))


def sidebar_order(pages: DataFrame, nodes: DataFrame, max_pages: int = 200, edges: DataFrame | None = None, max_depth: int = 3,
                  framework: str | None = None) -> DataFrame:
    """Visit order from each start page's navigation: ``(page_id, url, link, visit_no)``.

    Distinct internal links of the navigation (``sidebar_links``) in document order; the start page comes first when it
    is not among them; cut at ``max_pages``.  Links of body and footer never take part.  A start page without such links
    is crawled breadth first over ``edges(src, pos, dst)``, where given; without edges it has no row.
    """
    own = U.host(F.col("url"))
    links = _distinct_links(F.col("hrefs"), F.col("url"), _docs_link, lambda u: U.internal(u, own))
    listed = sidebar_links(pages, nodes, framework).select("page_id", "url", links.alias("_links")).where(F.size("_links") > 0)
    if edges is not None:
        listed = materialize(listed)
    queue = F.when(F.array_contains("_links", F.col("url")), F.col("_links")).otherwise(F.array_prepend("_links", F.col("url")))
    out = listed.select("page_id", "url", F.posexplode(F.slice(queue, 1, max_pages)).alias("_p", "link")).select(
        "page_id", "url", "link", (F.col("_p") + 1).cast("long").alias("visit_no"))
    if edges is None:
        return out
    rest = pages.select("page_id", "url").join(listed.select("page_id"), "page_id", "left_anti")
    crawled = crawl_levels(edges, rest.select(F.col("page_id").alias("site"), F.col("url").alias("node")), max_depth, max_pages)
    return out.unionByName(crawled.select(F.col("site").alias("page_id"), F.col("node").alias("link"), "visit_no").join(rest, "page_id").select("page_id", "url", "link", "visit_no"))


def _title_or_file(title: str = "title", file: str = "file") -> Column:
    return F.when(F.coalesce(F.col(title), F.lit("")) != "", F.col(title)).otherwise(F.col(file))


def consolidate(pages: DataFrame) -> DataFrame:
    """One combined document per site, as ordered pieces ``(site, piece_no, text)``.

    Pages come in as ``(site, ord, url, title, file, markdown)``.  Joining the pieces of a site by
    newline gives the document; it stays rows here because a site may hold a third of the corpus.
    """
    title = _title_or_file()
    n = numbered(pages.withColumn("_title", title), ["site"], ["ord"], "_no")
    total = pages.groupBy("site").agg(F.count(F.lit(1)).alias("_total"))
    toc = n.select("site", (F.col("_no") + 2).alias("piece_no"),
                   F.concat(F.col("_no").cast("string"), F.lit(". ["), F.col("_title"), F.lit("](#"), T.slug(F.col("_title")), F.lit(")")).alias("text"))
    body = T.strip(T.without_front_matter(F.col("markdown")))
    section = F.concat_ws("\n", F.lit("---\n"), F.concat(F.lit("<!-- source: "), F.col("url"), F.lit(" -->\n")),
                          F.concat(F.lit("# "), F.col("_title"), F.lit("\n")), body, F.lit("\n"))
    sections = join_on(n, total, ["site"]).select(
        "site", (F.col("_no") + F.col("_total") + 3).alias("piece_no"), section.alias("text"))
    frame = total.select("site", F.inline(F.array(
        F.struct(F.lit(1).cast("long").alias("piece_no"), F.lit("# Full Documentation\n").alias("text")),
        F.struct(F.lit(2).cast("long").alias("piece_no"), F.lit("## Table of Contents\n").alias("text")),
        F.struct((F.col("_total") + 3).alias("piece_no"), F.lit("\n").alias("text")))))
    return frame.unionByName(toc).unionByName(sections)


def site_index(index: DataFrame) -> DataFrame:
    """Site map per site as ordered lines: successes only, by depth, ties in recorded order.

    Input ``(site, seq, url, file, title, status, depth, started_at string)``.
    """
    ok = index.where(F.col("status") == "success")
    p = U.path(F.col("url"))
    entry = F.concat(F.lit("- ["), _title_or_file(), F.lit("]("), F.col("file"), F.lit(") - "),
                     F.when(p == "", F.lit("/")).otherwise(p))
    lines = numbered(ok.withColumn("_line", entry).select("site", "depth", "seq", "_line"), ["site"], ["depth", "seq"], "_no")
    counts = index.groupBy("site").agg(F.count_if(F.col("status") == "success").alias("_ok"),
                                       F.min("started_at").alias("_at"))
    head = counts.select("site", F.posexplode(F.array(
        F.concat(F.lit("# Site Map: "), F.col("site")), F.lit(""),
        F.concat(F.lit("Crawled on "), F.substring("_at", 1, 10), F.lit(". "), F.col("_ok").cast("string"), F.lit(" pages scraped.")),
        F.lit(""), F.lit("## Pages"), F.lit(""))).alias("line_no", "text"))
    tail = counts.select("site", (F.col("_ok") + 6).alias("line_no"), F.lit("").alias("text"))
    body = lines.select("site", (F.col("_no") + 5).alias("line_no"), F.col("_line").alias("text"))
    return head.withColumn("line_no", F.col("line_no").cast("long")).unionByName(body).unionByName(tail)


def docs_index(pages: DataFrame, heads: DataFrame) -> DataFrame:
    """Documentation index per site as ordered lines; ``heads(site, base_url, framework)``."""
    lines = numbered(pages.withColumn("_title", _title_or_file()), ["site"], ["ord"], "_no")
    entry = F.concat(F.lit("- ["), F.col("_title"), F.lit("]("), F.col("file"), F.lit(") — "), F.col("url"))
    counts = join_on(heads, pages.groupBy("site").agg(F.count(F.lit(1)).alias("_n")), ["site"])
    head = counts.select("site", F.posexplode(F.array(
        F.lit("# Documentation Index"), F.lit(""), F.concat(F.lit("- **Source**: "), F.col("base_url")),
        F.concat(F.lit("- **Framework**: "), F.col("framework")), F.concat(F.lit("- **Pages**: "), F.col("_n").cast("string")),
        F.lit(""), F.lit("## Pages"), F.lit(""))).alias("line_no", "text"))
    tail = counts.select("site", (F.col("_n") + 8).alias("line_no"), F.lit("").alias("text"))
    return (head.withColumn("line_no", F.col("line_no").cast("long"))
            .unionByName(lines.select("site", (F.col("_no") + 7).alias("line_no"), entry.alias("text")))
            .unionByName(tail))


def page_cap(levels: DataFrame, n: int, keys: tuple[str, ...] = ("site",), order: tuple[str, ...] = ("visit_no",)) -> DataFrame:
    """First ``n`` pages of each site in visit order."""
    return first_n(levels, list(keys), list(order), n, "cap_no")
