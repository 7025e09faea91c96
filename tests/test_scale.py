"""Steps that must stay right and small when tables are folders, keys are many, or lookups are large."""

import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.operators import layout, markdown, ordered
from docloom.operators import packages as pk
from docloom.operators import revisions as rv
from docloom.plans import files as plan_files
from docloom.plans import streams as plan_streams
from docloom.plans.base import Tables
from docloom.sources import markup as mk
from docloom.sources.markup import cells_from_packages, html_nodes, xml_nodes
from docloom.streaming import streams as st


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("audit", ["broken_refs", "duplicate_rids", "unreferenced_parts"])
def test_lookups_of_parts_are_never_gathered_on_the_driver(spark, audit):
    """Exploded parts look small to the planner, however many there are."""
    parts = spark.range(30).select(F.concat(F.lit("k"), "id").alias("pkg"), F.explode(F.array(F.lit("a.xml"), F.lit("_rels/a.xml.rels"))).alias("part"))
    rels = spark.range(30).select(F.concat(F.lit("k"), "id").alias("doc_id"), F.lit("_rels/a.xml.rels").alias("part"), F.lit("a.xml").alias("source_part"), F.lit("").alias("base"),
                                  F.lit("r1").alias("rid"), F.when(F.col("id") % 3 == 0, "lost.xml").otherwise("a.xml").alias("target"), F.lit(1).alias("line"), F.col("id").cast("int").alias("node_id"))
    found = getattr(pk, audit)(rels.unionByName(rels.where("node_id = 7").withColumn("node_id", F.lit(8))), parts)
    assert "Broadcast" not in plan(found)
    assert found.count() == {"broken_refs": 10, "duplicate_rids": 1, "unreferenced_parts": 10}[audit]


def test_tables_of_several_files_are_streamed(spark, tmp_path):
    df = spark.range(60).select((F.col("id") + 1).alias("page_id"), F.concat(F.lit("http://a/"), F.col("id") % 40, F.lit("?q")).alias("url"), F.lit("<p>").alias("html"))
    df.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = plan_streams.stream_ingest_pages(Tables(spark, str(tmp_path)))
    assert sorted((r["url"], r["page_id"]) for r in got.collect()) == sorted((f"http://a/{i}", i + 1) for i in range(40))


def test_many_keys_share_the_state_of_a_shard(spark, tmp_path):
    """Each job has an event or two; the ordered fold must not go to the state once per job."""
    df = spark.range(3000).select(F.concat(F.lit("h"), F.col("id") % 2000).alias("job_hash"), F.col("id").alias("event_id"),
                                  F.timestamp_seconds(1704067200 + F.col("id") * 60).alias("ts"), F.when(F.col("id") < 2000, "accepted").otherwise("retrieved").alias("status"))
    for part in (df.where("event_id < 1500"), df.where("event_id >= 1500")):  # keys come again in a later batch
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = st.append_to(st.stream_job_status(source), f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination()
    folds = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"] if "transform" in op["operatorName"].lower()]
    assert folds and max(folds) <= 8 * st.SHARDS
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.where("status = 'retrieved'").select("job_hash", "answer").distinct().count() == got.where("answer = 'served'").count() > 900


def test_table_cells_are_never_gathered_on_the_driver(spark):
    """Written nodes compress so well that the planner takes millions of them for a small table."""
    html = F.concat(F.lit("<table><tr><th>k</th></tr><tr><td>"), F.col("id"), F.lit("</td></tr></table>"))
    cells = markdown.html_tables(html_nodes(spark.range(20).select("id", html.alias("html")), "id"))
    assert "Broadcast" not in plan(cells)
    assert cells.where("row_no = 1 AND content = doc_id").count() == 20


def test_workbooks_are_parsed_once_and_never_gathered_on_the_driver(spark):
    """Eight steps read the nodes of a workbook; each used to tokenise every part again."""
    sheet = F.concat(F.lit('<worksheet><c r="A1" t="s"><v>1</v></c><c r="B2"><f>A1</f><v>'), F.col("id"), F.lit("</v></c><c r='C3' t='inlineStr'><is><r><t>x</t></r><r><t> y</t></r></is></c><c r='D4'/></worksheet>"))
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {"xl/workbook.xml": F.lit(f'<workbook xmlns:r="{rel}"><sheet name="S" r:id="r1"/></workbook>'), "xl/worksheets/one.xml": sheet,
             "xl/_rels/workbook.xml.rels": F.lit('<R><Relationship Id="r1" Target="/xl/worksheets/one.xml"/></R>'), "xl/sharedStrings.xml": F.lit("<sst><si/><si><t>a</t><t>b</t></si></sst>")}
    rows = spark.range(20).select(F.col("id").cast("string").alias("pkg"), F.explode(F.array(*[F.struct(F.lit(p).alias("part"), x.alias("bytes")) for p, x in parts.items()])).alias("x")).select("pkg", "x.*")
    cells = cells_from_packages(xml_nodes(rows))
    assert "Broadcast" not in plan(cells) and "MapInArrow" not in plan(cells)
    assert {tuple(r) for r in cells.where("workbook = '7'").drop("workbook").collect()} == {
        ("S", "A1", 1, 1, "ab", None), ("S", "B2", 2, 2, "7", "=A1"), ("S", "C3", 3, 3, "x y", None), ("S", "D4", 4, 4, None, None)}
    assert cells.count() == 80


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
TRACKED = (f'<w:document xmlns:w="{W}"><w:p><w:ins w:author="A"><w:r><w:t>a</w:t></w:r><w:del w:author="B"><w:r><w:delText>b</w:delText></w:r></w:del></w:ins>'
           '<w:del w:author="A"><w:r><w:delText>c</w:delText></w:r></w:del><w:r><w:t>d </w:t></w:r></w:p><w:p><w:r><w:t>e</w:t></w:r></w:p></w:document>')


def tracked(spark, xml=TRACKED):
    return xml_nodes(spark.range(9).select(F.col("id").alias("pkg"), F.lit("word/document.xml").alias("part"), F.lit(xml).alias("bytes")))


def contents(df):
    return [r["content"] for r in df.where("doc_id = '4'").orderBy("no").collect()]


def test_views_of_all_changes_shuffle_once(spark):
    """Whole nodes used to be sorted by a window, then grouped, then numbered, each with a shuffle of its own."""
    view = rv.change_view(tracked(spark), "all")
    assert plan(view).count("Exchange ") == 1
    assert contents(view) == ["abcd ", "e"]
    assert contents(rv.change_view(tracked(spark), "accept")) == ["ad ", "e"] and contents(rv.change_view(tracked(spark), "reject")) == ["cd ", "e"]
    undone = rv.reject_author_changes(tracked(spark), "A")
    assert [contents(rv.change_view(undone, m)) for m in ("all", "accept", "reject")] == [["cd ", "e"]] * 3


def test_compared_versions_are_tokenised_once(spark):
    """The later version was tokenised for its texts and again for the documents touched; a word diff doubled it all."""
    edits = rv.untracked_edits(tracked(spark, TRACKED.replace("d </w:t>", "f </w:t>")), tracked(spark), "A")
    assert plan(edits).count("MapInArrow") == 1  # the version before; the one after is written
    assert {tuple(r) for r in edits.where("doc_id = '4'").collect()} == {("4", 1, "cf ", "cd ")}
    words = rv.word_diff(edits, "word")
    assert plan(words).count("MapInArrow") == 1
    assert {tuple(r) for r in words.where("doc_id = '4'").collect()} == {("4", 1, "cf", -1), ("4", 1, "cd", 1)}


def test_runs_are_tokenised_once(spark):
    found = pk.whitespace_findings(tracked(spark))
    assert plan(found).count("MapInArrow") == 1
    assert {(r["doc"], r["message"]) for r in found.collect()} == {(str(i), "d ") for i in range(9)}


def test_workers_hand_packages_on_by_weight():
    """A worker used to hold all members of a batch of 10,000 packages, and all packages of a batch it wrote."""
    def zipped(n):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr("a.xml", bytes(n))
        return buf.getvalue()

    big = mk.WEIGHT // 2 + 1
    files = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(7)], "content": [zipped(big)] * 6 + [b"none"]})
    assert [b.num_rows for b in mk._members(iter([files]))] == [2, 2, 2, 1]
    bodies = pa.RecordBatch.from_pydict({"path": list("abc"), "names": [["x"]] * 3, "bodies": [["y"]] * 3})
    assert [b.num_rows for b in plan_files._zip(iter([bodies]))] == [3]


def test_repeated_ids_are_found_in_slim_rows(spark):
    """Whole nodes of all parts were written, sorted with their attributes, and read twice."""
    xml = ('<p xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"><sp id="1"/><a><sp ID="1"/></a><pic id="1"/><sldMasterId id="8"/><sldLayoutId id="8"/>'
           '<mc:AlternateContent><sp id="1"/></mc:AlternateContent><AlternateContent><pic id="1"/></AlternateContent></p>')
    rows = spark.range(3).select(F.col("id").cast("string").alias("pkg"), F.lit("a.xml").alias("part"), F.lit(xml).alias("bytes"))
    slim = xml_nodes(rows, tags=pk.ID_TAGS)
    assert slim.where("doc_id = '1'").count() == 9 and xml_nodes(rows).where("doc_id = '1'").count() == 11
    for nodes in (slim, xml_nodes(rows)):
        found = pk.duplicate_ids(nodes)
        assert "MapInArrow" not in plan(found) and "attrs" not in plan(found)
        assert sorted(r["message"].split(" (")[0].split(" already")[0] for r in found.where("doc = '1'").collect()) == [
            "Duplicate id=1 in <pic>", "Duplicate id=1 in <sp>", "Global ID 8 in <sldlayoutid>"]


def test_small_keys_are_numbered_by_a_window(spark, monkeypatch):
    """Every slide used to be range-partitioned, which computes the rows twice, and written down, whatever its size."""
    written = []
    keep = ordered.materialize
    monkeypatch.setattr(ordered, "materialize", lambda df, *a: written.append(df.columns) or keep(df, *a))
    shapes = spark.range(400).select(F.lit("d").alias("deck"), F.when(F.col("id") % 4 > 0, F.least(F.col("id") % 40, F.lit(9))).alias("slide"), F.col("id").alias("shape_no"),
                                     (F.col("id") * 7 % 300 / 100).cast("decimal(9,2)").alias("left_2"), (F.col("id") * 13 % 200 / 100).cast("decimal(9,2)").alias("top_2"))
    small = {tuple(r) for r in layout.reading_order(shapes).select("slide", "shape_no", "row_top", "shape_id").collect()}
    assert not any("shape_no" in columns for columns in written)
    monkeypatch.setattr(ordered, "BLOCK", 60)  # the slide 9 and the one without a number are above it
    assert small == {tuple(r) for r in layout.reading_order(shapes).select("slide", "shape_no", "row_top", "shape_id").collect()}
    assert any("shape_no" in columns for columns in written) and len(small) == 400
    plain = ordered.numbered(shapes, ["deck", "slide"], ["top_2", "shape_no"], "n")
    assert {tuple(r) for r in plain.collect()} == {tuple(r) for r in ordered.numbered(shapes, ["deck", "slide"], ["top_2", "shape_no"], "n", sizes=shapes).collect()}


def test_keys_of_one_chunk_need_no_chain(spark):
    """Two more passes of Python and a shuffle were spent on every key, for nothing to carry."""
    df = spark.range(90).select((F.col("id") % 5).alias("k"), (F.col("id") * 3).alias("pos"))
    short = ordered.anchored(df, ["k"], "pos", 10)
    assert plan(short).count("MapInArrow") == 1 and "Broadcast" not in plan(short)
    long = ordered.anchored(df.withColumn("pos", F.when(F.col("k") == 3, F.col("pos") * 9).otherwise(F.col("pos"))), ["k"], "pos", 10)
    assert plan(long).count("MapInArrow") == 3  # one key has two chunks or more
    same = lambda d: {tuple(r) for r in d.where("k <> 3").collect()}
    assert same(short) == same(long) == {(k, p, p - (p - 3 * k) % 15) for k in range(5) if k != 3 for p in range(3 * k, 270, 15)}
    assert {tuple(r) for r in long.where("k = 3").collect()} == {(3, p, p) for p in range(81, 2430, 135)}


def test_table_nodes_are_not_copied_for_every_ancestor(spark):
    """A node goes to its cells and tables alone, however deep it lies, and the key of a cell is no text to be parsed again."""
    deep = "<div>" * 12 + "<a/b>x</a>" + "</div>" * 12
    html = f"<main/x><table><tr><td>{deep}<table><tr><th>in</th></tr></table></td><td>b</td></tr></table></main>"
    cells = markdown.html_tables(html_nodes(spark.createDataFrame([(1, html), (2, "<td>no table</td>")], "id int, html string"), "id"))
    text = plan(cells)
    assert "explode(ancestors" not in text and "to_json" not in text and "from_json" not in text
    got = sorted((r["table_id"], r["row_no"], r["col_no"], r["content"]) for r in cells.collect())
    outer, inner = sorted({r[0] for r in got})
    assert [(r[0] == outer, *r[1:]) for r in got if r[0] == outer and r[2] == 1] == [(True, 0, 1, "b")]
    assert [r[1:] for r in got if r[0] == inner] == [(0, 0, "in")] and [r[3] for r in got if r[0] == outer][0].startswith("x")
