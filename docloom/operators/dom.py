"""Operators over the ``nodes`` table.  Groups and windows are per document part, which one input row bounds."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

DOC = ["doc_id", "part"]

# Page furniture by tag, by class/id fragment, and the usual homes of the main text.
FURNITURE_TAGS = "script style nav footer header noscript iframe svg form button input select textarea".split()
FURNITURE_NAMES = ("cookie banner popup modal overlay sidebar advertisement ad- ads- advert social-share share-buttons "
                   "newsletter subscribe related-posts comments comment- footer nav menu breadcrumb toc "
                   "table-of-contents").split()
MAIN_SELECTORS = ("main", "article", "[role='main']", ".markdown-body", ".docs-content", ".content", "#content",
                  ".post-content", ".article-content", ".entry-content", ".page-content", "#main-content",
                  ".main-content")
FRAMEWORK_SELECTORS: Mapping[str, Mapping[str, Sequence[str]]] = {
    "docusaurus": {
        "content": ["article.markdown", ".theme-doc-markdown"], "sidebar_links": [".menu__link"],
        "remove": [".theme-doc-footer", ".pagination-nav", ".theme-edit-this-page", ".table-of-contents",
                   ".theme-doc-sidebar-container", ".navbar"]},
    "gitbook": {
        "content": [".markdown-body", "[data-testid='page.contentEditor']", ".page-body"], "sidebar_links": ["nav.sidebar a"],
        "remove": [".page-footer", "[data-testid='page.editButton']", ".header-row"]},
    "readthedocs": {
        "content": [".document .body", ".rst-content", "[role='main']"], "sidebar_links": [".wy-nav-side a", ".sphinxsidebar a"],
        "remove": [".rst-footer-buttons", ".wy-breadcrumbs", ".headerlink", ".wy-nav-top"]},
    "mkdocs": {
        "content": [".md-content article", ".md-content__inner"], "sidebar_links": [".md-nav__link"],
        "remove": [".md-footer", ".md-header", ".md-source", ".md-content__button"]},
    "nextjs": {
        "content": ["main article", "main .content", "#__next main"], "sidebar_links": ["nav[class*='sidebar'] a"],
        "remove": ["footer", "header", "[class*='feedback']", "[class*='breadcrumb']"]},
    "mintlify": {
        "content": ["#content-area article", "main article"], "sidebar_links": ["nav[class*='sidebar'] a"],
        "remove": ["[class*='Feedback']", "[class*='PageFooter']", "header"]},
    "vuepress": {
        "content": [".theme-default-content", ".content__default"], "sidebar_links": [".sidebar-link"],
        "remove": [".page-edit", ".page-nav", ".header-anchor"]},
    "generic": {
        "content": ["main article", "article", "[role='main']", "main", ".content", "#content"],
        "sidebar_links": ["nav[class*='sidebar'] a", "aside nav a", ".sidebar nav a"],
        "remove": ["footer", "header", "nav[class*='navbar']", "[class*='cookie']", "[class*='banner']"]},
}
UNIVERSAL_NOISE = ["[class*='EditThisPage']", "[class*='edit-this-page']", "[class*='was-this-helpful']",
                   "[class*='thumbs-up']", "[class*='page-feedback']", "[class*='version-selector']",
                   "[class*='language-selector']", "[class*='prev-next']"]


def _attr(name: str) -> Column:
    return F.coalesce(F.col("attrs")[name], F.lit(""))


_SIMPLE = re.compile(r"""[a-zA-Z][\w-]*|\*|\.[\w-]+|\#[\w-]+|\[\s*[\w:-]+\s*(?:[*^$~]?=\s*(?:'[^']*'|"[^"]*"|[^'"\]\s]+)\s*)?\]""")


def simple_match(selector: str) -> Column:
    """Predicate for one compound selector: ``tag``, ``*``, ``.class``, ``#id``, ``[a]``, ``[a='v']`` and the tests
    ``*=``, ``^=``, ``$=``, ``~=``, in any mix.  Anything else raises, so that no selector matches by accident."""
    cond = F.col("kind") == "e"
    rest = selector.strip()
    tokens = _SIMPLE.findall(rest)
    if not rest or "".join(tokens) != rest or any(t[0] not in ".#[" for t in tokens[1:]):
        raise ValueError(f"unsupported selector: {selector!r}")
    for token in tokens:
        if token[0] == ".":
            cond = cond & F.concat(F.lit(" "), F.regexp_replace(_attr("class"), r"\s+", " "), F.lit(" ")).contains(f" {token[1:]} ")
        elif token[0] == "#":
            cond = cond & (_attr("id") == token[1:])
        elif token[0] == "[":
            name, op, value = re.match(r"""\[\s*([\w:-]+)\s*(?:([*^$~]?=)\s*(.*?)\s*)?\]$""", token).groups()
            value = (value or "").strip("'\"")
            has, a = F.col("attrs")[name].isNotNull(), _attr(name)
            words = F.concat(F.lit(" "), F.regexp_replace(a, r"\s+", " "), F.lit(" "))
            tests = {None: has, "=": has & (a == value), "*=": a.contains(value), "^=": a.startswith(value), "$=": a.endswith(value), "~=": words.contains(f" {value} ")}
            cond = cond & (tests[op] if op in (None, "=") or value else F.lit(False))
        elif token != "*":
            cond = cond & (F.col("tag") == token)
    return cond


def select(nodes: DataFrame, selectors: Sequence[str], name: str = "hit") -> DataFrame:
    """Adds ``hit``: the element matches one of the selectors; a blank means "somewhere below", ``>`` "directly below".

    The "below" test keeps, per document in order, how far the subtrees of the outer matches reach; "directly below"
    looks for the parent among the outer matches of the same document.
    """
    doc_order = Window.partitionBy(*DOC).orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    cond, out = F.lit(False), nodes
    for i, selector in enumerate(selectors):
        steps = re.findall(r"""(?:\[(?:'[^']*'|"[^"]*"|[^\]])*\]|[^\s>\[])+|>""", selector)
        inside = None
        for j, step in enumerate(steps[:-1]):
            if step == ">":
                continue
            here = simple_match(step) if inside is None else simple_match(step) & inside
            if steps[j + 1] == ">":
                out = out.withColumn(f"_reach{i}_{j}", F.collect_set(F.when(here, F.col("node_id"))).over(doc_order))
                inside = F.array_contains(f"_reach{i}_{j}", F.col("parent_id"))
            else:
                out = out.withColumn(f"_reach{i}_{j}", F.max(F.when(here, F.col("end_id"))).over(doc_order))
                inside = F.coalesce(F.col(f"_reach{i}_{j}") >= F.col("node_id"), F.lit(False))
        last = simple_match(steps[-1])
        cond = cond | (last if inside is None else last & inside)
    helpers = [c for c in out.columns if c.startswith("_reach")]
    return out.withColumn(name, cond).drop(*helpers)


def drop_subtrees(nodes: DataFrame, bad: Column) -> DataFrame:
    """Remove the matching nodes and everything below them: one sort per document, no join."""
    w = Window.partitionBy(*DOC).orderBy("node_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    covered = F.max(F.when(F.col("_bad"), F.col("end_id"))).over(w) >= F.col("node_id")  # the test's own columns need not cross
    return nodes.withColumn("_bad", bad).withColumn("_covered", F.coalesce(covered, F.lit(False))).where(~F.col("_covered")).drop("_bad", "_covered")


def prune_nodes(nodes: DataFrame) -> DataFrame:
    """Drop comments, page furniture and hidden elements with their subtrees.

    Class and id are searched for fragments, so ``nav`` also drops ``unavailable`` and ``toc`` drops ``stock``.
    """
    # A blank-run in the class attribute counts as one blank.
    named = F.concat(T.strip(F.regexp_replace(F.lower(_attr("class")), r"\s+", " ")), F.lit(" "), F.lower(_attr("id")))
    bad = F.col("tag").isin(*FURNITURE_TAGS)
    for fragment in FURNITURE_NAMES:
        bad = bad | F.col("_named").contains(fragment)
    style = F.replace(F.lower(_attr("style")), F.lit(" "), F.lit(""))
    hidden = style.contains("display:none") | style.contains("visibility:hidden")
    hidden = hidden | ((_attr("aria-hidden") == "true") & ~F.col("tag").isin("code", "pre"))
    drop = (F.col("kind") == "c") | ((F.col("kind") == "e") & (bad | hidden))
    return drop_subtrees(nodes.withColumn("_named", named), drop).drop("_named")


def doc_noise(nodes: DataFrame, frameworks: DataFrame) -> DataFrame:
    """Drop what the documentation framework of each page adds around the text.

    ``frameworks(doc_id, framework)``; per-framework rules first, then those common to all.
    """
    joined = nodes.join(frameworks, "doc_id", "left")
    known = F.when(F.col("framework").isin(*FRAMEWORK_SELECTORS), F.col("framework")).otherwise("generic")
    bad = F.lit(False)
    for name, rules in FRAMEWORK_SELECTORS.items():
        for selector in rules["remove"]:
            bad = bad | ((known == name) & simple_match(selector))
    for selector in UNIVERSAL_NOISE:
        bad = bad | simple_match(selector)
    return drop_subtrees(joined, bad).drop("framework")


def main_content(nodes: DataFrame, selector: str | None = None) -> DataFrame:
    """Where the main text of each document is: ``(doc_id, part, rule, node_id, end_id, chars)``.

    A given selector wins whatever it holds.  Otherwise the first rule in list order whose first match
    holds more than 100 trimmed characters; then body (rule 90), then the whole document (rule 99), whatever it
    begins with: fragments and documents whose first element was pruned have their row too.
    """
    ranked = [(i, simple_match(s)) for i, s in enumerate(MAIN_SELECTORS, 1)]
    hits = F.filter(F.array(*[F.when(cond, F.lit(i)) for i, cond in ranked],
                            F.when((F.col("kind") == "e") & (F.col("tag") == "body"), F.lit(90))), lambda x: x.isNotNull())
    source = nodes
    if selector:
        source = select(nodes, [s.strip() for s in selector.split(",")])
        hits = F.concat(F.when(F.col("hit"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), hits)
    firsts = (source.where(F.col("kind") == "e").select(*DOC, "node_id", "end_id", F.explode(hits).alias("rule"))
              .groupBy(*DOC, "rule").agg(F.min(F.struct("node_id", "end_id")).alias("_at")).select(*DOC, "rule", "_at.*"))
    whole = nodes.select(*DOC).distinct().withColumns({"rule": F.lit(99), "node_id": F.lit(0).cast(nodes.schema["node_id"].dataType), "end_id": F.lit(2147483647).cast(nodes.schema["end_id"].dataType)})
    firsts = firsts.unionByName(whole)
    texts = nodes.where(F.col("kind") == "t").select(*DOC, F.col("node_id").alias("_t"), F.length(T.strip(F.col("text"))).alias("_n"))
    sized = firsts.join(texts, DOC, "left").groupBy(*DOC, "rule", "node_id", "end_id").agg(
        F.coalesce(F.sum(F.when(F.col("_t").between(F.col("node_id"), F.col("end_id")), F.col("_n"))), F.lit(0)).alias("chars"))
    good = sized.where((F.col("rule") == 0) | (F.col("rule") >= 90) | (F.col("chars") > 100))
    best = good.groupBy(*DOC).agg(F.min(F.struct("rule", "node_id", "end_id", "chars")).alias("b"))
    return best.select(*DOC, "b.*")


def within(nodes: DataFrame, regions: DataFrame) -> DataFrame:
    """Nodes inside one region per document ``(doc_id, part, node_id, end_id)``."""
    r = regions.select(*DOC, F.col("node_id").alias("_from"), F.col("end_id").alias("_to"))
    return nodes.join(r, DOC).where(F.col("node_id").between(F.col("_from"), F.col("_to"))).drop("_from", "_to")


def page_metadata(nodes: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Title, description and language of each document; missing values are empty texts.

    ``docs(doc_id, part)`` adds documents that have no node at all, such as empty pages.

    Title: ``og:title``, else the title element, else the first h1.  One pass of partial aggregates.
    """
    first = lambda cond, value: F.min_by(F.when(cond, value), F.when(cond, F.col("node_id")))
    meta = (F.col("kind") == "e") & (F.col("tag") == "meta")
    content = T.strip(_attr("content"))
    el = lambda tag: (F.col("kind") == "e") & (F.col("tag") == tag)
    heads = nodes.groupBy(*DOC).agg(
        first(meta & (_attr("property") == "og:title"), content).alias("_og_t"),
        first(meta & (_attr("property") == "og:description"), content).alias("_og_d"),
        first(meta & (_attr("name") == "description"), content).alias("_d"),
        first(meta & (_attr("http-equiv") == "content-language"), content).alias("_cl"),
        first(el("html"), F.struct(_attr("lang").alias("a"), _attr("xml:lang").alias("b"))).alias("_l"),
        first(el("title"), F.struct("node_id", "end_id")).alias("_t"), first(el("h1"), F.struct("node_id", "end_id")).alias("_h"))
    texts = nodes.where((F.col("kind") == "t") & F.col("path").rlike("/(title|h1)/")).select(*DOC, F.col("node_id").alias("_n"), "text")
    joined = heads.join(texts, DOC, "left")
    inside = lambda c: F.col("_n").between(F.col(f"{c}.node_id"), F.col(f"{c}.end_id"))
    pieces = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(inside(c), F.struct("_n", "text")))), lambda s: T.strip(s["text"])), "")
    first_row = lambda c: F.first(c).alias(c)
    out = joined.groupBy(*DOC).agg(*[first_row(c) for c in ("_og_t", "_og_d", "_d", "_cl", "_l")],
                                   pieces("_t").alias("_title"), pieces("_h").alias("_h1"))
    pick = lambda *cs: F.coalesce(*[F.when(c != "", c) for c in cs], F.lit(""))
    if docs is not None:
        out = docs.select(*DOC).distinct().join(out, DOC, "left")
    return out.select(*DOC, pick(F.col("_og_t"), F.col("_title"), F.col("_h1")).alias("title"),
                      pick(F.col("_og_d"), F.col("_d")).alias("description"),
                      pick(F.col("_l.a"), F.col("_l.b"), F.col("_cl")).alias("language"))


def _joined() -> Column:
    """Texts of the group in document order (``_t``)."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_t", "text"))), lambda s: s["text"]), "")


def element_text(nodes: DataFrame, wanted: Column | None = None, keep_blank: bool = False, among: DataFrame | None = None) -> DataFrame:
    """Text below each wanted element (by condition, or the rows of ``among``), in order: ``(doc_id, part, node_id, content)``.

    White-space-only text is skipped unless ``keep_blank``.  Elements without text give no row.
    """
    cond = F.col("kind") == "e"
    txt = nodes.where(F.col("kind") == "t")
    if not keep_blank:
        txt = txt.where(T.strip(F.col("text")) != "")
    pairs = txt.select(*DOC, F.explode("ancestors").alias("node_id"), F.col("node_id").alias("_t"), "text")
    if wanted is not None:
        pairs = pairs.join(nodes.where(cond & wanted).select(*DOC, "node_id"), [*DOC, "node_id"])
    if among is not None:
        pairs = pairs.join(among, [*DOC, "node_id"])
    return pairs.groupBy(*DOC, "node_id").agg(_joined().alias("content"))


def find_nodes(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Look up elements: ``queries(query_id, doc_id, tag, attrs, line_from, line_to, contains)``.

    Nulls mean "any".  Result per query: ``found``, ``not found`` or ``multiple``, with the node when it is unique.
    ``contains`` is matched against the element's text without white-space-only nodes.
    """
    q = queries.select("query_id", "doc_id", "tag", F.col("attrs").alias("_want"), "line_from", "line_to", "contains")
    el = nodes.where(F.col("kind") == "e").select(*DOC, "node_id", "end_id", "tag", "attrs", "line")
    hit = q.join(el, ["doc_id", "tag"]).where(
        (F.col("line_from").isNull() | (F.col("line") >= F.col("line_from")))
        & (F.col("line_to").isNull() | (F.col("line") <= F.col("line_to")))
        & (F.col("_want").isNull() | F.forall(F.map_entries("_want"), lambda e: F.coalesce(F.col("attrs")[e["key"]], F.lit("")) == e["value"])))
    asked = hit.where("contains IS NOT NULL").select(*DOC, "node_id").distinct()
    texts = element_text(nodes, among=asked)
    hit = hit.join(texts, [*DOC, "node_id"], "left").where(
        F.col("contains").isNull() | F.coalesce(F.col("content"), F.lit("")).contains(F.col("contains")))
    counts = hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("node_id").alias("_first"))
    n = F.coalesce("_n", F.lit(0))
    return q.join(counts, "query_id", "left").select(
        "query_id", F.when(n == 0, "not found").when(n == 1, "found").otherwise("multiple").alias("status"),
        F.when(n == 1, F.col("_first")).alias("node_id"))


def paragraph_text(nodes: DataFrame, dealt: bool = False) -> DataFrame:
    """Text of each non-empty paragraph (w:p with its w:t), numbered in order: ``(doc_id, part, no, content)``.

    A paragraph nested in another one counts for both, in document order.  One shuffle, by document part, serves the grouping
    and the numbering; ``dealt`` says that the nodes come from a window and lie that way already.
    """
    runs = nodes.where((F.col("kind") == "t") & F.col("path").endswith("/t/"))
    tags = F.slice(F.split("path", "/"), 2, F.size("ancestors"))
    paras = F.filter(F.arrays_zip(F.col("ancestors").alias("id"), tags.alias("tag")), lambda x: x["tag"] == "p")
    pairs = runs.select(*DOC, F.explode(paras["id"]).alias("node_id"), F.col("node_id").alias("_t"), "text")
    pairs = pairs if dealt else pairs.repartition(*DOC)
    texts = pairs.groupBy(*DOC, "node_id").agg(_joined().alias("content")).where("content <> ''")
    w = Window.partitionBy(*DOC).orderBy("node_id")
    return texts.select(*DOC, F.row_number().over(w).alias("no"), "content")


def next_id(ids: DataFrame, value: str = "id", prefix: str = "", first: int = 0) -> DataFrame:
    """Next free number per document: highest number + 1; other texts are ignored; ``first`` when there is none.

    With ``prefix`` (``rId``) only values that start with it count, and the result carries it.
    """
    v = F.col(value)
    number = F.when(v.startswith(prefix), F.substr(v, F.lit(len(prefix) + 1)).try_cast("long"))
    return ids.groupBy("doc_id").agg(F.concat(F.lit(prefix), (
        F.coalesce(F.greatest(F.max(number), F.lit(first - 1)), F.lit(first - 1)) + 1).cast("string")).alias("next_id"))
