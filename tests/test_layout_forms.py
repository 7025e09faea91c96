"""Form boxes (the documented cases), overlaps against brute force, package fixtures, streams in several batches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import dom, layout, revisions
from docloom.operators import packages as pk
from docloom.sources.markup import markup_parts, packages, read_packages, xml_nodes
from docloom.sources.tables import combine_tables, read_fields_json, read_segments


def field(label, entry, page=1, text="unset"):
    f = {"page_number": page, "description": "f", "field_label": "l", "label_bounding_box": label, "entry_bounding_box": entry}
    return f if text == "unset" else f | {"entry_text": text}


CASES = {
    "no overlap": ([field([10, 10, 50, 30], [60, 10, 150, 30]), field([10, 40, 50, 60], [60, 40, 150, 60])], 0),
    "same field": ([field([10, 10, 60, 30], [50, 10, 150, 30])], 1),
    "different fields": ([field([10, 10, 50, 30], [60, 10, 150, 30]), field([40, 20, 80, 40], [160, 10, 250, 30])], 2),
    "other page": ([field([10, 10, 50, 30], [60, 10, 150, 30], 1), field([10, 10, 50, 30], [60, 10, 150, 30], 2)], 0),
    "short entry": ([field([10, 10, 50, 30], [60, 10, 150, 20], text={"font_size": 14})], 1),
    "tall enough": ([field([10, 10, 50, 30], [60, 10, 150, 30], text={"font_size": 14})], 0),
    "default font": ([field([10, 10, 50, 30], [60, 10, 150, 20], text={})], 1),
    "no entry text": ([field([10, 10, 50, 30], [60, 10, 150, 20])], 0),
    "touching": ([field([10, 10, 50, 30], [50, 10, 150, 30])], 0),
}


def test_box_cases(spark, tmp_path):
    for name, (fields, _) in CASES.items():
        (tmp_path / f"{name.replace(' ', '_')}.json").write_text(json.dumps({"pages": [], "form_fields": fields}))
    many = [field([10, 10, 50, 30], [20, 15, 60, 35])] * 25
    (tmp_path / "cap.json").write_text(json.dumps({"pages": [], "form_fields": many}))
    _, rows = read_fields_json(spark, str(tmp_path))
    messages = layout.box_messages(layout.form_boxes(rows.withColumn("field_no", F.col("field_no").cast("long"))))
    counts = {r["doc"].split("/")[-1][:-5]: r["count"] for r in messages.groupBy("doc").count().collect()}
    for name, (_, want) in CASES.items():
        assert counts.get(name.replace(" ", "_"), 0) == want, name
    capped = layout.message_cap(messages.where(F.col("doc").endswith("cap.json"))).orderBy("place").collect()
    assert len(capped) == 20 and capped[-1].message.startswith("Aborting")


def test_overlaps_against_brute_force(spark):
    rng = random.Random(5)
    data = []
    for i in range(400):  # one crowded slide with a few very large shapes
        slide = 1 if i % 3 else rng.randrange(2, 5)
        big = i % 97 == 0
        size = (2000, 1500) if big else (rng.randrange(1, 60), rng.randrange(1, 60))
        data.append((slide, i, rng.randrange(0, 1000), rng.randrange(0, 800), *size))
    df = spark.createDataFrame(data, "slide int, shape_id int, l int, t int, w int, h int")
    for a, b in (("left_2", "l"), ("top_2", "t"), ("width_2", "w"), ("height_2", "h")):
        df = df.withColumn(a, (F.col(b) / 100).cast("decimal(18,2)"))
    got = {(r.slide, r.shape_id, r.other_id) for r in layout.shape_overlaps(df, ["slide"]).collect()}
    rows = layout.shape_overlaps(df, ["slide"]).count()
    want = set()
    for s, i, l, t, w, h in data:
        for s2, j, l2, t2, w2, h2 in data:
            if s == s2 and i != j and min(l + w, l2 + w2) - max(l, l2) > 5 and min(t + h, t2 + h2) - max(t, t2) > 5:
                want.add((s, i, j))
    assert got == want and rows == len(want)


def test_manual_bullets_and_frames(spark):
    p = "array<struct<text:string,n_lines:int,font_size:double,line_spacing:double,space_before:double,space_after:double>>"
    data = [("a", 914400, 914400, [("• x", 1, 12.0, None, None, None)]), ("b", 914400, 914400, [("•x", 9, None, None, 5.0, None)]), ("c", 100, 914400, [("y", 99, None, None, None, None)])]
    df = layout.frame_overflow(layout.manual_bullets(spark.createDataFrame(data, f"id string, width_emu long, height_emu long, paragraphs {p}")))
    got = {r.id: (r.warning is not None, r.frame_overflow) for r in df.collect()}
    # b: 9 lines of the default 14 pt are 168 px against 86 usable px.
    assert got == {"a": (True, None), "b": (False, 0.85), "c": (False, None)}


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def run(text):
    return f"<w:r><w:t>{text}</w:t></w:r>"


def gone(author, text):
    return f'<w:del w:author="{author}"><w:r><w:delText>{text}</w:delText></w:r></w:del>'


def added(author, inner):
    return f'<w:ins w:author="{author}">{inner}</w:ins>'


PATTERNS = {  # before, after (changed by Me): taking Me's changes out must give the text of before
    "own insertion": (run("a"), run("a") + added("Me", run("b"))),
    "own deletion": (run("ab"), run("a") + gone("Me", "b")),
    "rejects an insertion": (added("You", run("x")), added("You", gone("Me", "x"))),
    "restores a deletion": (gone("You", "y"), gone("You", "y") + added("Me", run("y"))),
    "edits inside another's": (added("You", run("x")), added("You", run("changed")) + added("Me", run("z"))),
}


def test_tracked_change_patterns(spark):
    doc = lambda body: f"<w:document {W}><w:body><w:p>{body}</w:p></w:body></w:document>"
    frame = lambda i: xml_nodes(spark.createDataFrame([(k, "word/document.xml", doc(v[i])) for k, v in PATTERNS.items()], "pkg string, part string, bytes string"))
    found = {r.doc_id: (r.before, r.after) for r in revisions.untracked_edits(frame(0), frame(1), "Me").collect()}
    assert found == {"edits inside another's": ("x", "changed")}
    ops = revisions.word_diff(spark.createDataFrame([("d", 1, "kitten", "sitting")], "doc_id string, no int, before string, after string")).orderBy("ord").collect()
    assert [(r.op, r.removed, r.added) for r in ops] == [("replace", "k", "s"), ("replace", "e", "i"), ("insert", "", "g")]


def test_zip_packages(spark, tmp_path):
    import zipfile
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("_rels/.rels", '<Relationships><Relationship Id="rId1" Type="t" Target="word/document.xml"/><Relationship Id="rId2" Type="t" Target="../up.xml"/></Relationships>')
        z.writestr("word/document.xml", f"<w:document {W}><w:p>{run(' x')}</w:p></w:document>")
        z.writestr("word/lost.xml", "<a>")
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    parts = read_packages(spark, str(tmp_path / "*.docx"))
    nodes = xml_nodes(markup_parts(parts))
    rels = pk.relationships(nodes)
    assert [r.message for r in pk.broken_refs(rels, parts).collect()] == ["Broken reference to ../up.xml"]
    assert [r.part for r in pk.unreferenced_parts(rels, parts).collect()] == ["word/lost.xml"]
    assert [r.part for r in pk.malformed(nodes).collect()] == ["word/lost.xml"]
    assert pk.whitespace_findings(nodes).count() == 1
    junk = packages(spark.createDataFrame([("x", b"junk")], "path string, content binary")).collect()
    assert [(r.pkg, r.part, r.bytes, r.error[:10]) for r in junk] == [("x", None, None, "BadZipFile")]
    assert [r.error is None for r in parts.orderBy("pkg", "part").collect()] == [True, True, True, False]


def test_find_nodes(spark):
    xml = f"<w:document {W}>\n<w:p>{run('“Agreement')}</w:p>\n<w:p>{run('x')}</w:p></w:document>"
    nodes = xml_nodes(spark.createDataFrame([("d", "p", xml)], "pkg string, part string, bytes string"))
    q = spark.createDataFrame([(1, "d", "p", None, None, None, "“Agree"), (2, "d", "p", None, None, None, None), (3, "d", "r", None, 3, 3, None), (4, "d", "p", {"id": "1"}, None, None, None)],
                              "query_id int, doc_id string, tag string, attrs map<string,string>, line_from int, line_to int, contains string")
    assert {r.query_id: r.status for r in dom.find_nodes(nodes, q).collect()} == {1: "found", 2: "multiple", 3: "found", 4: "not found"}


def test_segments_and_tables(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"video_id": "v", "language": "x", "language_code": "es", "is_generated": True,
                                                 "transcript": [{"text": "a", "start": 2.3, "duration": 1.0}, {"text": "b", "start": 4.0, "duration": 1.0}]}))
    from docloom.operators.transcripts import srt_cues
    cues = srt_cues(read_segments(spark, str(tmp_path))).orderBy("cue_no").collect()
    assert cues[0].timing == "00:00:02,299 --> 00:00:03,299" and cues[1].cue_no == 2
    tables = spark.createDataFrame([(1, [["a", "b"], ["1", "2"]]), (2, [["a"]]), (3, [["c"], ["3"]])], "table_id int, rows array<array<string>>")
    assert {(r.table_id, tuple(r.cells.items())) for r in combine_tables(tables).collect()} == {(1, (("a", "1"), ("b", "2"))), (3, (("c", "3"),))}
    twice = spark.createDataFrame([(1, [["a", "b", "a", None], ["1", "2", "3", "4"]])], "table_id int, rows array<array<string>>")
    assert [r.cells for r in combine_tables(twice).collect()] == [{"a": "1", "b": "2", "a (3)": "3"}]


def test_index_versions(spark, tmp_path):
    from docloom.sources.tables import read_index, write_index
    path, schema = str(tmp_path / "index"), "url string, n int"
    rows = lambda: sorted((r.url, r.n) for r in read_index(spark, path, schema).collect())
    assert rows() == []
    for n in range(3):
        write_index(spark.createDataFrame([("u", n)], schema), path)
        assert rows() == [("u", n)]
    assert sorted(p.name for p in (tmp_path / "index").iterdir()) == ["version=000001", "version=000002"]
    (tmp_path / "index" / "version=000003").mkdir()  # a job that never ended
    assert rows() == [("u", 2)]
    for part in (tmp_path / "index" / "version=000002").glob("*.parquet"):
        part.write_bytes(b"PAR1 damaged")
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert rows() == []


@pytest.mark.parametrize("damage", ["footer", "page", "gone"])
def test_index_raises_other_errors(spark, tmp_path, monkeypatch, damage):
    """Damaged and missing files read as an empty index; a job that fails in another way raises."""
    from pyspark.errors import PySparkException
    from pyspark.sql import DataFrameWriter

    from docloom.sources.tables import read_index, write_index

    path, schema = str(tmp_path / "index"), "url string, n int"
    write_index(spark.createDataFrame([(f"u{i * 7919 % 1000}", i) for i in range(1000)], schema).coalesce(1), path)
    assert read_index(spark, path, schema).count() == 1000
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        read_index(spark, path, "url string, other int")
    with monkeypatch.context() as m:
        def lost(self, *a, **b):
            raise PySparkException("Job aborted due to stage failure: Task 0 in stage 1.0 failed 4 times: ExecutorLostFailure (executor 1 exited)")
        m.setattr(DataFrameWriter, "save", lost)
        with pytest.raises(PySparkException, match="ExecutorLostFailure"):
            read_index(spark, path, schema)
    [part] = (tmp_path / "index" / "version=000000").glob("*.parquet")
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    data = bytearray(part.read_bytes())
    data[4:2000] = b"\xff" * 1996
    part.write_bytes(b"PAR1 damaged" if damage == "footer" else bytes(data)) if damage != "gone" else part.unlink()
    assert read_index(spark, path, schema).count() == 0


def test_vat_totals_count_a_base_once(spark):
    from docloom.operators.invoices import vat_summary
    lines = spark.createDataFrame([("n", "c", k, 0.1, 100.0, 10.0, True) for k in ("iva", "recargo", "retencion")] + [("n", "c", "exento", 0.0, 50.0, None, True)],
                                  "numero_factura string, cif string, kind string, rate double, base double, quota double, fits boolean")
    got = {(r.cif, r.kind, r.rate): r.base for r in vat_summary(lines).collect()}
    assert got[("c", "recargo", 0.1)] == got[("c", "retencion", None)] == 100 and got[("c", None, None)] == got[(None, None, None)] == 150


def test_crowded_cells_are_cut(spark):
    """Many small boxes in a corner beside large and long ones, piles of equal boxes and of points: every pair once."""
    import numpy as np

    r = np.random.default_rng(4)
    boxes = []
    for k in range(1500):  # a dense corner of tiny boxes
        x, y = r.uniform(0, 3, 2)
        boxes.append((x, y, x + r.uniform(0.005, 0.04), y + r.uniform(0.005, 0.04)))
    boxes += [(0.0, 0.0, 900.0, 900.0), (1.0, 0.0, 1.001, 800.0), (0.0, 2.0, 700.0, 2.002), (500.0, 500.0, 950.0, 960.0)]
    boxes += [(2.5, 2.5, 2.6, 2.6)] * 40 + [(2.7, 2.7, 2.7, 2.7)] * 30 + [(float(x), 5.0, float(x) + 300.0, 400.0) for x in range(60)]
    rows = [("d", 1, k, k, "entry", *map(float, b)) for k, b in enumerate(boxes)] + [("d", 2, 5000 + k, k, "label", *map(float, b)) for k, b in enumerate(boxes[:90])]
    df = spark.createDataFrame(rows, "doc string, page long, box_no long, field_no long, rect_type string, x0 double, y0 double, x1 double, y1 double")

    def meeting(rows):
        a = np.array([x[5:] for x in rows])
        n = np.array([x[2] for x in rows])
        hit = (a[:, None, 0] <= a[None, :, 2]) & (a[:, None, 2] >= a[None, :, 0]) & (a[:, None, 1] <= a[None, :, 3]) & (a[:, None, 3] >= a[None, :, 1])
        strict = (a[:, None, 0] < a[None, :, 2]) & (a[:, None, 2] > a[None, :, 0]) & (a[:, None, 1] < a[None, :, 3]) & (a[:, None, 3] > a[None, :, 1])
        return {(n[i], n[j]) for i, j in zip(*np.nonzero(strict & hit)) if n[i] < n[j]}

    want = meeting(rows[: len(boxes)]) | meeting(rows[len(boxes):])
    for crowd in (25, layout.CROWD):
        pairs = layout._pairs(df, ["doc", "page"], "box_no", "x0", "y0", "x1", "y1", ["field_no"], crowd=crowd)
        found = [(p["box_no_a"], p["box_no_b"]) for p in pairs.where("x0_a < x1_b AND x1_a > x0_b AND y0_a < y1_b AND y1_a > y0_b").collect()]
        assert len(found) == len(set(found)) and set(found) == want
    sides = (["doc", "page"], "x0", "y0", "x1", "y1")
    grid = layout._outer_grid(df, *sides)
    cut = layout._split_crowds(grid, *sides, 25)
    before = max(r["count"] for r in grid.groupBy("doc", "page", "_path").count().collect())
    sizes = sorted(r["count"] for r in cut.groupBy("doc", "page", "_path").count().collect())
    assert before > 1500 and sum(n > 110 for n in sizes) == 0  # only the piles stay together


def test_pages_with_few_rectangles_are_paired_without_a_grid(spark):
    """Every rectangle used to be listed in about four cells, each with a path and the cell, and shuffled so."""
    n = F.col("id")
    boxes = spark.range(600).select((n % 3).alias("doc"), F.when(n % 7 > 0, 1).alias("page"), n.alias("box_no"), (n % 5).alias("field_no"), F.lit("entry").alias("rect_type"),
                                    (n * 7 % 31).alias("x0"), (n * 5 % 29).alias("y0"), F.when(n % 11 > 0, n * 7 % 31 + 4).alias("x1"), (n * 5 % 29 + 3).alias("y1")).where("doc < 2 OR id < 300")
    rows = [r for r in boxes.collect() if r["page"] is not None and r["x1"] is not None]
    want = {(a["box_no"], b["box_no"]) for a in rows for b in rows if a["doc"] == b["doc"] and a["box_no"] < b["box_no"]
            and a["x0"] < b["x1"] and a["x1"] > b["x0"] and a["y0"] < b["y1"] and a["y1"] > b["y0"]}
    for part in (boxes, boxes.where("doc = 2")):  # pages of about 160, 160 and 80 boxes; then few only
        pairs = layout.box_conflicts(part)
        text = pairs._jdf.queryExecution().executedPlan().toString()
        assert ("_path" in text) == (part is boxes) and "Broadcast" not in text.split("_path")[0]
        found = [(p["box_no_a"], p["box_no_b"]) for p in pairs.collect()]
        assert len(found) == len(set(found)) and set(found) == {x for x in want if part is boxes or x[0] % 3 == 2}
