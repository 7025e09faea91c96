"""Main text of pages by a tree-structured graphical model over the nodes of each document."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES_AT_ONCE = 400  # pages whose trees exchange messages together

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
TAG_STOP = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""(class|id|role|data-content)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Elements of HTML by how they nest and show.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math select option button object canvas audio video".split())
UNSHOWN = RAW | {"head"}
BLOCK = frozenset("""html body article section nav aside header footer main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody
    tfoot tr td th blockquote pre form fieldset figure figcaption address details summary hr label legend""".split())
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "caption", "thead", "tbody", "tfoot", "label", "legend"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
TAGS = ["#text", "#root", *sorted(BLOCK), "a", "b", "strong", "em", "i", "span", "code", "small", "sup", "sub", "u", "time", "center", "font"]
TAG_AT = {t: i for i, t in enumerate(TAGS)}

# Word stems in class, id and role, by what they usually name.
STEMS = {
    "nav": "nav navbar menu breadcrumb breadcrumbs pagination pager tabs toc topnav navigation", "header": "header masthead banner logo brand",
    "footer": "footer foot bottom copyright legal colophon contentinfo", "side": "sidebar aside side widget related recommended recommendations trending popular complementary",
    "ad": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion", "notice": "notice cookie cookies consent gdpr alert popup modal newsletter subscribe",
    "form": "form search login signup signin register", "comment": "comment comments reply replies response responses respond disqus discussion",
    "social": "share sharing social follow tags meta byline", "content": "article content post entry story main body text prose page",
}
STEM_AT = {w: i + 1 for i, words in enumerate(STEMS.values()) for w in words.split()}
AREAS = ["article", "main", "section", "nav", "aside", "header", "footer", "form", "figure", "address", "details", "body"]
AREA_AT = {t: i + 1 for i, t in enumerate(AREAS)}
SIZES = (len(TAGS) + 1, len(STEMS) + 1, 12, 6, 6, len(TAGS) + 1, 6, (len(AREAS) + 1) ** 2, len(STEMS) + 1)  # categories of the features
EDGES = 4  # kinds of parent-child edges: to text, inline, block, and named elements
OFFSETS = np.cumsum([0, *SIZES[:-1]])


class Markup:
    """Cuts a page into tags and text in one forward pass: what is known not to follow is not looked for again."""

    def __init__(self, source: str):
        self.source = source
        self.last = source.rfind(">")
        self.quotes = True  # until a quoted value runs over all that is left
        self.gone: dict[str, int] = {}  # from where on a quote or a closing tag does not occur

    def find(self, what: str, at: int) -> int:
        if at >= self.gone.get(what, len(self.source) + 1):
            return -1
        found = self.source.find(what, at)
        if found < 0:
            self.gone[what] = at
        return found

    def tag_end(self, at: int) -> int:
        """Place of the sign that ends the tag, outside quoted values; of the next one, where quotes do not close."""
        place = at
        while self.quotes:
            m = TAG_STOP.search(self.source, place)
            if m is None:
                self.quotes = False
            elif m[0] == ">":
                return m.start()
            else:
                shut = self.find(m[0], m.end())
                place = m.end() if shut < 0 else shut + 1
        return self.source.find(">", at)

    def closing(self, name: str, at: int) -> int:
        """Place behind the end tag of an element whose inside is not markup, or -1."""
        key = f"</{name}"
        if at >= self.gone.get(key, len(self.source) + 1):
            return -1
        m = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(self.source, at)
        if m is None:
            self.gone[key] = at
            return -1
        return self.source.find(">", m.start()) + 1 or len(self.source)

    def next(self, at: int) -> tuple[int, str, bool, str, str]:
        """(end, name, whether it ends an element, attributes, text) of what begins at ``at``; comments have neither name nor text."""
        source, size = self.source, len(self.source)
        if source[at] != "<":
            end = source.find("<", at)
            return (end, "", False, "", source[at:end]) if end >= 0 else (size, "", False, "", source[at:])
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            return (end + 3 if end >= 0 else size), "", False, "", ""
        if at > self.last:  # no tag ends any more: text, up to a comment
            end = source.find("<!--", at)
            end = end if end >= 0 else size
            return end, "", False, "", source[at:end]
        if source[at + 1 : at + 2] in ("!", "?"):
            return source.find(">", at) + 1, "", False, "", ""
        m = NAME.match(source, at)
        if m is None:
            return at + 1, "", False, "", "<"
        end = self.tag_end(m.end())
        return end + 1, m[2].lower(), bool(m[1]), source[m.end() : end], ""


class Trees:
    """Nodes of many pages as columns; a parent comes before its children."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.tag: list[str] = []
        self.group: list[int] = []
        self.text: list[str] = []
        self.label: list[int] = []
        self.page: list[int] = []
        self.in_link: list[bool] = []
        self.area: list[int] = []  # the two innermost areas around a node, as one number
        self.around: list[int] = []  # group of the innermost named element around it

    def add(self, page: int, parent: int, tag: str, group: int = 0, text: str = "", label: int = 0, in_link: bool = False) -> int:
        for column, value in ((self.parent, parent), (self.tag, tag), (self.group, group), (self.text, text), (self.label, label), (self.page, page), (self.in_link, in_link)):
            column.append(value)
        area = self.area[parent] if parent >= 0 else 0
        if tag in AREA_AT and AREA_AT[tag] != area % (len(AREAS) + 1):
            area = area % (len(AREAS) + 1) * (len(AREAS) + 1) + AREA_AT[tag]
        self.area.append(area)
        self.around.append(group or (self.around[parent] if parent >= 0 else 0))
        return len(self.tag) - 1

    def parse(self, page: int, source: str) -> None:
        """Adds the tree of a page, closing what was left open as browsers do; text in unshown elements is left out."""
        root = self.add(page, -1, "#root")
        stack: list[tuple[str, int]] = [("#root", root)]
        hidden = 0  # depth of unshown elements
        links = 0
        at, end = 0, len(source)
        opened = Counter()

        def close(count: int) -> None:
            nonlocal hidden, links
            for name, _ in stack[len(stack) - count :]:
                hidden -= name in UNSHOWN
                links -= name == "a"
                opened[name] -= 1
            del stack[len(stack) - count :]

        markup = Markup(source)
        while at < end:
            at, name, ends, attributes, text = markup.next(at)
            if not name:
                if text and not hidden:
                    top = stack[-1][1]
                    self.add(page, top, "#text", 0, text, self.label[top], links > 0)
                continue
            if ends:
                if not opened[name]:
                    continue
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == name:
                        close(len(stack) - depth)
                        break
                    if stack[depth][0] in ("td", "th", "table") and name not in BLOCK:
                        break
                continue
            if name == "br" or name == "hr":
                if not hidden:
                    self.add(page, stack[-1][1], "#text", 0, "\n", self.label[stack[-1][1]], links > 0)
                continue
            if name in VOID:
                continue
            if name == "body" and hidden:  # a head that was left open
                close(len(stack) - 1 - (stack[1][0] == "html" if len(stack) > 1 else 0))
            if name in CLOSES_P and opened["p"]:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == "p":
                        close(len(stack) - depth)
                        break
                    if stack[depth][0] in BLOCK:
                        break
            if any(opened[n] for n in SIBLINGS.get(name, ())):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] in SIBLINGS[name]:
                        close(len(stack) - depth)
                        break
                    if stack[depth][0] in SCOPES[name]:
                        break
            if attributes.endswith("/") and name not in BLOCK:
                continue
            if name in RAW:
                stop = markup.closing(name, at) if name in ("script", "style", "textarea", "title", "noscript", "template", "iframe") else -1
                if stop >= 0:
                    at = stop
                    continue
                if name in ("script", "style", "title", "textarea"):
                    at = end  # never closed
                    continue
            top = stack[-1][1]
            group, label = 0, self.label[top]
            if attributes:
                for a in ATTRIBUTE.finditer(attributes):
                    value = a[2] or a[3] or a[4] or ""
                    if a[1].lower() == "data-content":
                        label = int(value == "1")
                    elif not group:
                        group = next((STEM_AT[w] for w in re.findall("[a-z]+", value.lower()) if w in STEM_AT), 0)
            stack.append((name, self.add(page, top, name, group, "", label)))
            hidden += name in UNSHOWN
            links += name == "a"
            opened[name] += 1

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parent of every node, its feature numbers, and the kind of the edge to its parent."""
        n = len(self.tag)
        parent = np.array(self.parent, dtype=np.int64)
        tag = np.array([TAG_AT.get(t, len(TAGS)) for t in self.tag], dtype=np.int64)
        length = np.array([len(t.strip()) for t in self.text], dtype=np.float64)
        link = length * np.array(self.in_link)
        marks = np.array([sum(t.count(c) for c in ".,!?;") for t in self.text], dtype=np.float64)
        children = np.bincount(parent[parent >= 0], minlength=n)
        totals = np.stack([length, link, marks], axis=1)
        for i in range(n - 1, -1, -1):  # children come after their parents
            if parent[i] >= 0:
                totals[parent[i]] += totals[i]
        bucket = lambda x, top: np.minimum(np.ceil(np.log2(x + 1)), top).astype(np.int64)
        density = np.floor(5 * totals[:, 1] / np.maximum(totals[:, 0], 1)).clip(max=5).astype(np.int64)
        group = np.array(self.group, dtype=np.int64)
        columns = np.stack([tag, group, bucket(totals[:, 0], 11), density, bucket(totals[:, 2], 5), np.where(parent >= 0, tag[parent], len(TAGS)), bucket(children, 5),
                            np.array(self.area, dtype=np.int64), np.array(self.around, dtype=np.int64)], axis=1)
        block = np.array([t in BLOCK for t in self.tag])
        kind = np.where(tag == 0, 0, np.where(group > 0, 3, np.where(block, 2, 1)))
        return parent, columns + OFFSETS, kind


def _depths(parent: np.ndarray) -> np.ndarray:
    depth = np.zeros(len(parent), dtype=np.int64)
    for i, p in enumerate(parent.tolist()):
        if p >= 0:
            depth[i] = depth[p] + 1
    return depth


def _log_sum(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(x[..., 0], x[..., 1])


def marginals(model: dict, parent: np.ndarray, columns: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product on trees: probability of content for every node, and of (parent, child) states for every edge.

    Messages go up level by level, then down; all trees of a batch take each step together.
    """
    n = len(parent)
    own = np.zeros((n, 2))
    own[:, 1] = model["node"][columns].sum(axis=1)
    depth = _depths(parent)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if n else []
    edge = model["edge"][kind]  # (node, parent state, own state)
    up, below, above = np.zeros((n, 2)), own.copy(), np.zeros((n, 2))
    for level in reversed(levels[1:]):
        up[level] = _log_sum(below[level][:, None, :] + edge[level])
        if 20 * len(level) > n:
            for s in (0, 1):
                below[:, s] += np.bincount(parent[level], weights=up[level, s], minlength=n)
        else:  # deep trees have many small levels
            np.add.at(below, parent[level], up[level])
    pairs = np.zeros((n, 2, 2))
    for level in levels[1:]:
        rest = below[parent[level]] + above[parent[level]] - up[level]
        above[level] = _log_sum((rest[:, :, None] + edge[level]).swapaxes(1, 2))
        pairs[level] = rest[:, :, None] + edge[level] + below[level][:, None, :]
    both = below + above
    content = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    pairs -= pairs.max(axis=(1, 2), keepdims=True)
    pairs = np.exp(pairs)
    return content, pairs / pairs.sum(axis=(1, 2), keepdims=True)


def train(pages: list[str], steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> dict:
    """Fits node and edge potentials to pages labelled with ``data-content``: the gradient of the likelihood is what the
    labels show minus what sum-product expects.  Empty training gives a model that keeps nothing certain (0.5)."""
    trees = Trees()
    for i, page in enumerate(pages):
        trees.parse(i, page)
    model = {"node": np.zeros(sum(SIZES)), "edge": np.zeros((EDGES, 2, 2))}
    if not trees.tag:
        return model
    parent, columns, kind = trees.features()
    label = np.array(trees.label, dtype=np.int64)
    inner = parent >= 0
    shown = np.zeros((EDGES, 2, 2))
    np.add.at(shown, (kind[inner], label[parent[inner]], label[inner]), 1)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.items()}
    for step in range(1, steps + 1):
        content, pairs = marginals(model, parent, columns, kind)
        gradient = {"node": np.bincount(columns.ravel(), weights=np.repeat(label - content, columns.shape[1]), minlength=len(model["node"]))}
        expected = np.zeros_like(shown)
        np.add.at(expected, kind[inner], pairs[inner])
        gradient["edge"] = shown - expected
        for k in model:
            g = gradient[k] / len(label) - decay * model[k] / 10
            moments[k][0] += 0.1 * (g - moments[k][0])
            moments[k][1] += 0.01 * (g * g - moments[k][1])
            model[k] += rate * (moments[k][0] / (1 - 0.9**step)) / (np.sqrt(moments[k][1] / (1 - 0.99**step)) + 1e-9)
    return model


def _texts(trees: Trees, content: np.ndarray, pages: int) -> list[str]:
    """Content of every page: inline text joins as it stands, blocks are set apart, white space becomes one space."""
    parts: list[list[str]] = [[] for _ in range(pages)]
    block: dict[int, int] = {}
    last = [-1] * pages
    for i, (tag, parent, page) in enumerate(zip(trees.tag, trees.parent, trees.page)):
        block[i] = i if parent < 0 or tag in BLOCK else block[parent]
        if tag == "#text" and content[i] >= 0.5:
            if block[i] != last[page]:
                parts[page].append(" ")
                last[page] = block[i]
            parts[page].append(html.unescape(trees.text[i]))
        elif tag in BLOCK:
            last[page] = -1
    return [" ".join("".join(p).split()) for p in parts]


def extract(pages: DataFrame, model: dict, source: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in ``keep`` and ``text`` of every row: the main text of the whole page.

    Null and empty pages, and pages without content, give empty text; pages without any element are read as one run of
    text; repeated rows come out again; an empty table gives no rows; other columns are not read.  A task holds the
    trees of ``PAGES_AT_ONCE`` pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(at, PAGES_AT_ONCE)
                trees = Trees()
                for i, value in enumerate(part.column(0)):
                    trees.parse(i, value.as_py() or "")
                content, _ = marginals(model, *trees.features())
                page = np.array(trees.page)
                plain = np.bincount(page, weights=[t[0] != "#" for t in trees.tag], minlength=part.num_rows) == 0
                content[plain[page]] = 1
                texts = pa.array(_texts(trees, content, part.num_rows))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], texts], names=[*keep, "text"])

    rows = pages.select(F.col(source).alias("_html"), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{fields}, text string")
