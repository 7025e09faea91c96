"""Markup and package sources: bytes -> text, packages -> parts, markup -> ``nodes``.

``nodes`` is the shared table of every page and package operator.  One row per element ('e'), text
('t') or comment ('c'), numbered in document order:

    doc_id, part, node_id, parent_id, end_id, depth, kind, tag, ns, path, ancestors, attrs, nsmap, text, line

``end_id`` is the last node of the element's subtree, so "below X" is an interval test; ``path`` holds
the tags of the ancestors between slashes, ``ancestors`` their ids.  All nodes of one document come from one input row, so
grouping by (doc_id, part) is bounded by the size of one page or part.
"""

from __future__ import annotations

import codecs
import io
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = """doc_id string, part string, node_id int, parent_id int, end_id int, depth int, kind string, tag string,
ns string, path string, ancestors array<int>, attrs map<string,string>, nsmap map<string,string>, text string, line int"""

_SCHEMA = pa.schema([
    ("doc_id", pa.string()), ("part", pa.string()), ("node_id", pa.int32()), ("parent_id", pa.int32()),
    ("end_id", pa.int32()), ("depth", pa.int32()), ("kind", pa.string()), ("tag", pa.string()), ("ns", pa.string()),
    ("path", pa.string()), ("ancestors", pa.list_(pa.int32())), ("attrs", pa.map_(pa.string(), pa.string())), ("nsmap", pa.map_(pa.string(), pa.string())),
    ("text", pa.string()), ("line", pa.int32())])

# Fixed values of the HTML syntax.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {  # open element -> start tags that end it without an end tag
    "p": set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
             "pre section table ul".split()),
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
}
HOLDS = set("ul ol table dl select article section div nav body blockquote main aside header footer".split())


class _Rows:
    """Open-element stack that writes node rows; siblings share their path and their list of ancestors."""

    def __init__(self, doc: str, part: str):
        self.doc, self.part, self.rows, self.stack = doc, part, [], []
        self.path, self.above, self.outer = "/", [], []

    def add(self, kind: str, tag: str, ns: str, attrs, nsmap, text: str | None, line: int) -> int:
        rows, above = self.rows, self.above
        n = len(rows)
        rows.append([self.doc, self.part, n, above[-1] if above else None, n, len(above), kind, tag, ns, self.path, above, attrs, nsmap, text, line])
        return n

    def open(self, tag: str, ns: str, attrs, nsmap, line: int) -> None:
        n = self.add("e", tag, ns, attrs, nsmap, None, line)
        self.stack.append(n)
        self.outer.append((self.path, self.above))
        self.path, self.above = f"{self.path}{tag}/", [*self.above, n]

    def close(self) -> None:
        self.rows[self.stack.pop()][4] = len(self.rows) - 1
        self.path, self.above = self.outer.pop()

    def tag(self, at: int) -> str:
        return self.rows[self.stack[at]][7]


class _Html(HTMLParser):
    def __init__(self, out: _Rows):
        super().__init__(convert_charrefs=True)
        self.out = out

    def handle_starttag(self, tag, attrs):
        out = self.out
        for at in range(len(out.stack) - 1, -1, -1):
            opened = out.tag(at)
            if tag in CLOSED_BY.get(opened, ()):
                while len(out.stack) > at:
                    out.close()
            elif opened in HOLDS and tag != "body":
                break
        out.open(tag, "", [(k, v or "") for k, v in dict(reversed(attrs)).items()], [], self.getpos()[0])
        if tag in VOID:
            out.close()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        out = self.out
        for at in range(len(out.stack) - 1, -1, -1):
            if out.tag(at) == tag:
                while len(out.stack) > at:
                    out.close()
                return
            if out.tag(at) in HOLDS and tag not in HOLDS and tag not in ("html", "body"):
                return

    def handle_data(self, data):
        self.out.add("t", "", "", [], [], data, self.getpos()[0])

    def handle_comment(self, data):
        self.out.add("c", "", "", [], [], data, self.getpos()[0])


def _html_rows(doc: str, part: str, text: str) -> list:
    out = _Rows(doc, part)
    parser = _Html(out)
    parser.feed(text)
    parser.close()
    while out.stack:
        out.close()
    return out.rows


def _xml_rows(doc: str, part: str, text: str | bytes) -> list:
    """Namespaced attributes keep their ``{uri}name``; ``nsmap`` is filled on the root element."""
    out = _Rows(doc, part)
    parser = expat.ParserCreate(namespace_separator="}")
    parser.ordered_attributes = parser.buffer_text = True
    declared: list[tuple[str, str]] = []

    def start(name, attrs):
        ns, _, local = name.rpartition("}")
        pairs = [(("{" + a) if "}" in a else a, v) for a, v in zip(attrs[::2], attrs[1::2])] if attrs else []
        out.open(local, ns, pairs, list(dict(declared).items()) if not out.stack else [], parser.CurrentLineNumber)

    parser.StartNamespaceDeclHandler = lambda prefix, uri: declared.append((prefix or "", uri or ""))
    parser.StartElementHandler = start
    parser.EndElementHandler = lambda name: out.close()
    parser.CharacterDataHandler = lambda data: out.add("t", "", "", [], [], data, parser.CurrentLineNumber)
    parser.CommentHandler = lambda data: out.add("c", "", "", [], [], data, parser.CurrentLineNumber)
    try:
        parser.Parse(text, True)
    except expat.ExpatError as e:
        line = e.lineno
        return [[doc, part, 0, None, 0, 0, "x", "", "", "/", [], [], [], str(e), line]]
    return out.rows


HELD = 4000  # node rows that a worker gathers before it hands them on


def _to_batches(rows: list, size: int = HELD) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), size):
        columns = list(zip(*rows[i:i + size]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _parse(make, tags: frozenset[str] | None = None):
    """``tags`` (lower case) hands on their elements only, numbered as ever: other rows need not be turned into columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for at in range(batch.num_rows):  # one text at a time: a batch of long texts is not held twice
                doc, part, text = (c[at].as_py() for c in batch.columns)
                if text is not None:
                    rows = make(doc, part, text)
                    held.extend(rows if tags is None else (r for r in rows if r[7].lower() in tags))
                if len(held) >= HELD:
                    yield from _to_batches(held)
                    held = []
        yield from _to_batches(held)

    return run


def spread(scan: DataFrame) -> DataFrame:
    """Use all cores on a small scan: a file scan with fewer splits than there are cores is redistributed
    before the tokeniser; a scan with enough splits is left as it is, so large inputs are not shuffled."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def html_nodes(df: DataFrame, doc: Column | str, html: str = "html", part: Column | str = "") -> DataFrame:
    """HTML text -> nodes.  Only the three needed columns cross to the Python workers."""
    d = F.col(doc) if isinstance(doc, str) else doc
    p = F.lit(part) if isinstance(part, str) else part
    return df.select(d.cast("string").alias("doc_id"), p.alias("part"), F.col(html)).mapInArrow(_parse(_html_rows), NODES)


def xml_nodes(df: DataFrame, doc: Column | str = "pkg", part: Column | str = "part", xml: str = "bytes", tags: Iterable[str] | None = None) -> DataFrame:
    """XML text or bytes -> nodes.  A part that is not well-formed gives one row of kind 'x' with the error.  With ``tags``
    (lower case) only the elements of these names come out, for a caller that needs no other nodes."""
    d = F.col(doc) if isinstance(doc, str) else doc
    p = F.col(part) if isinstance(part, str) else part
    return df.select(d.cast("string").alias("doc_id"), p.alias("part"), F.col(xml)).mapInArrow(_parse(_xml_rows, None if tags is None else frozenset(tags)), NODES)


# --- bytes and packages ---------------------------------------------------------------------------

def charset_of(content: Column) -> Column:
    """Charset named in the first 4 KB: a meta charset, else one inside a content attribute, else utf-8."""
    head = F.lower(F.regexp_replace(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"), r"[^\x00-\x7f]", ""))
    first = F.regexp_extract(head, r"""<meta[^>]+charset=["']?([^"'\s;>]+)""", 1)
    second = F.regexp_extract(head, r"""content=["'][^"']*charset=([^"'\s;]+)""", 1)
    return F.when(first != "", first).when(second != "", second).otherwise(F.lit("utf-8"))


def _decode(batches):
    for pdf in batches:
        texts = []
        for raw, name in zip(pdf["content"], pdf["charset"]):
            raw = bytes(raw)
            try:
                codecs.lookup(name)
                texts.append(raw.decode(name))
            except (LookupError, UnicodeDecodeError, ValueError):
                texts.append(raw.decode("utf-8", errors="replace"))
        yield pdf.assign(html=texts)[["path", "charset", "html"]]


def decode_html(files: DataFrame) -> DataFrame:
    """``(path, content binary)`` -> ``(path, charset, html)``; bad bytes or names fall back to utf-8 with marks."""
    named = files.select("path", F.col("content"), charset_of(F.col("content")).alias("charset"))
    return named.mapInPandas(_decode, "path string, charset string, html string")


def read_html_bytes(spark: SparkSession, glob: str) -> DataFrame:
    return decode_html(spark.read.format("binaryFile").load(glob).select("path", "content"))


WEIGHT = 4 << 20  # bytes of members that a worker gathers before it hands them on
_MEMBERS = pa.schema([("pkg", pa.string()), ("part", pa.string()), ("bytes", pa.binary()), ("error", pa.string())])


def _unzipped(path: str, content: bytes) -> Iterator[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for i in z.infolist():
                if i.is_dir():
                    continue
                try:
                    yield path, i.filename, z.read(i), None
                except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError) as e:
                    yield path, i.filename, None, f"{type(e).__name__}: {e}"
    except zipfile.BadZipFile as e:
        yield path, None, None, f"{type(e).__name__}: {e}"


def by_weight(rows: Iterator[tuple], schema: pa.Schema, weight: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``WEIGHT`` bytes, so that a worker never holds the members of a whole batch of packages."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row) + 100
        if size >= WEIGHT:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (row for batch in batches for at in range(batch.num_rows) for row in _unzipped(batch.column(0)[at].as_py(), batch.column(1)[at].as_py()))
    return by_weight(rows, _MEMBERS, lambda row: len(row[2] or b""))


def packages(files: DataFrame) -> DataFrame:
    """``(path, content binary)`` of zip packages -> one row per member ``(pkg, part, bytes, error)``.

    An unreadable package comes out as one row with its error and no part, an unreadable member under its name.
    """
    return files.select("path", "content").mapInArrow(_members, "pkg string, part string, bytes binary, error string")


def read_packages(spark: SparkSession, glob: str) -> DataFrame:
    return packages(spark.read.format("binaryFile").load(glob))


def markup_parts(parts: DataFrame) -> DataFrame:
    """The readable members that hold XML."""
    return parts.where((F.col("part").endswith(".xml") | F.col("part").endswith(".rels")) & F.col("bytes").isNotNull())


def _texts_below(parts: DataFrame, inside: Column, start: Column) -> DataFrame:
    """One row per match: ``inside`` maps a text node to the elements it counts for, ``start`` an element to itself; both are
    arrays of structs.  Rows are dealt by document part, which one input row bounds, so what is grouped by part and
    element later needs no further shuffle."""
    rows = parts.select("doc_id", "part", "node_id", "text", F.explode(F.when(F.col("kind") == "t", inside).otherwise(start)).alias("_x"))
    return rows.select("doc_id", "part", F.col("node_id").alias("_t"), "text", "_x.*").repartition("doc_id", "part")


def cells_from_packages(nodes: DataFrame) -> DataFrame:
    """Every cell of every worksheet part, shared strings resolved: ``(workbook, sheet, coord, row, col, value, formula)``.

    The nodes that count are written down once, since several steps read them.  A shared-string table has as many rows as
    the workbook has texts, so it is joined by key, not broadcast.
    """
    from pyspark.sql import Window

    from docloom.functions.numbers import column_number
    from docloom.session import materialize, wide
    part, tag, attrs = F.col("part"), F.col("tag"), F.col("attrs")
    in_sheet, in_strings = part.startswith("xl/worksheets/"), part == "xl/sharedStrings.xml"
    is_name, is_rel = (part == "xl/workbook.xml") & (tag == "sheet"), (part == "xl/_rels/workbook.xml.rels") & (tag == "Relationship")
    wanted = is_name | is_rel | (in_strings & ((F.col("kind") == "t") | (tag == "si"))) | (in_sheet & ((F.col("kind") == "t") | (tag == "c")))
    nodes = materialize(nodes.where(wanted).select("doc_id", "part", "node_id", "kind", "tag", "path", "ancestors", "attrs", "text"))
    rid = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    names = nodes.where(is_name).select("doc_id", attrs["name"].alias("sheet"), attrs[rid].alias("rid"))
    rels = nodes.where(is_rel).select("doc_id", attrs["Id"].alias("rid"), F.concat(F.lit("xl/"), F.regexp_replace(attrs["Target"], "^/?(xl/)?", "")).alias("part"))
    sheets = names.join(wide(rels), ["doc_id", "rid"]).select("doc_id", "part", "sheet")
    above = F.slice(F.split("path", "/"), 2, F.size("ancestors"))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("_t", "text")))), lambda s: s["text"]), "")

    item = F.struct(F.col("node_id").alias("item"))
    items = F.transform(F.filter(F.arrays_zip(F.col("ancestors").alias("id"), above.alias("tag")), lambda x: x["tag"] == "si"), lambda x: F.struct(x["id"].alias("item")))
    texts = _texts_below(nodes.where(in_strings), items, F.array(item)).groupBy("doc_id", "part", "item").agg(content.alias("shared"))
    place = F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("item")) - 1
    strings = texts.select("doc_id", place.cast("string").alias("_key"), "shared")

    none = F.lit(None)
    cell = F.struct(F.col("node_id").alias("cell"), attrs["r"].alias("coord"), F.coalesce(attrs["t"], F.lit("n")).alias("type"), none.cast("int").alias("leaf"), none.cast("string").alias("leaf_tag"))
    steps = F.arrays_zip(F.col("ancestors").alias("id"), above.alias("tag"), F.slice("ancestors", 2, F.size("ancestors")).alias("leaf"), F.slice(above, 2, F.size("ancestors")).alias("leaf_tag"))
    leaves = F.transform(F.filter(steps, lambda x: (x["tag"] == "c") & x["leaf_tag"].isin("v", "f", "is")), lambda x: F.struct(
        x["id"].alias("cell"), none.cast("string").alias("coord"), none.cast("string").alias("type"), x["leaf"].alias("leaf"), x["leaf_tag"].alias("leaf_tag")))
    key = ["doc_id", "part", "cell"]
    per_leaf = _texts_below(nodes.where(in_sheet), leaves, F.array(cell)).groupBy(*key, "leaf", "leaf_tag").agg(F.max("coord").alias("coord"), F.max("type").alias("type"), content.alias("content"))
    cells = per_leaf.groupBy(*key).agg(F.max("coord").alias("coord"), F.max("type").alias("type"), F.max(F.when(F.col("leaf_tag").isin("v", "is"), F.col("content"))).alias("raw"),
                                       F.max(F.when(F.col("leaf_tag") == "f", F.col("content"))).alias("f"))
    cells = cells.withColumn("_key", F.when(F.col("type") == "s", F.col("raw")))
    out = cells.join(wide(strings), ["doc_id", "_key"], "left").join(wide(sheets), ["doc_id", "part"])
    return out.select(F.col("doc_id").alias("workbook"), "sheet", "coord",
                      F.regexp_extract("coord", "([0-9]+)$", 1).cast("int").alias("row"),
                      column_number(F.regexp_extract("coord", "^([A-Z]+)", 1)).cast("int").alias("col"),
                      F.when(F.col("type") == "s", F.col("shared")).otherwise(F.col("raw")).alias("value"),
                      F.when(F.col("f").isNotNull(), F.concat(F.lit("="), F.col("f"))).alias("formula"))
