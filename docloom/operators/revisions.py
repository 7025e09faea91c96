"""Tracked changes and document comparison."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.dom import DOC, drop_subtrees, paragraph_text
from docloom.session import materialize, wide

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _by(tag: str, author: str | None) -> Column:
    hit = (F.col("kind") == "e") & (F.col("tag") == tag)
    return hit if author is None else hit & (F.col("attrs")[_W + "author"] == author)


def _restore_deleted(nodes: DataFrame, author: str | None) -> DataFrame:
    """Take the deletion marks away and keep what they hold: deleted text becomes text again."""
    mine = F.coalesce(_by("del", author), F.lit(False))
    if author is None:  # the path tells, without a window
        n = nodes.where(~mine).withColumn("_in", F.col("path").contains("/del/"))
    else:
        w = Window.partitionBy(*DOC).orderBy("node_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        inside = F.coalesce(F.max(F.when(F.col("_mine"), F.col("end_id"))).over(w) >= F.col("node_id"), F.lit(False))
        n = nodes.withColumn("_mine", mine).withColumn("_in", inside).where("NOT _mine").drop("_mine")
    return (n.withColumn("tag", F.when(F.col("_in") & (F.col("tag") == "delText"), "t").otherwise(F.col("tag")))
            .withColumn("path", F.when(F.col("_in"), F.regexp_replace("path", "/delText/", "/t/")).otherwise(F.col("path"))).drop("_in"))


def _runs_and_marks(nodes: DataFrame) -> DataFrame:
    """The nodes that paragraph texts under tracked changes depend on: texts of runs, insertions and deletions."""
    run = (F.col("kind") == "t") & (F.col("path").endswith("/t/") | F.col("path").endswith("/delText/"))
    mark = (F.col("kind") == "e") & F.col("tag").isin("ins", "del")
    return nodes.where(run | mark).select(*DOC, "node_id", "end_id", "kind", "tag", "path", "ancestors", "attrs", "text")


def reject_author_changes(nodes: DataFrame, author: str) -> DataFrame:
    """The document as it was before one author's tracked changes: the author's insertions go with what they
    hold, the author's deletions are undone, other authors' changes stay."""
    return _restore_deleted(drop_subtrees(nodes, F.coalesce(_by("ins", author), F.lit(False))), author)


def change_view(nodes: DataFrame, mode: str) -> DataFrame:
    """Paragraph texts under ``accept`` (changes carried out), ``reject`` (changes undone) or ``all``
    (both texts in place)."""
    nodes = _runs_and_marks(nodes)
    if mode == "accept":
        return paragraph_text(drop_subtrees(nodes, _by("del", None)), dealt=True)
    if mode == "reject":
        return paragraph_text(_restore_deleted(drop_subtrees(nodes, _by("ins", None)), None), dealt=True)
    if mode == "all":
        return paragraph_text(_restore_deleted(nodes, None))
    raise ValueError(f"unknown mode {mode!r}")


def _main(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("part") == "word/document.xml")


def untracked_edits(before: DataFrame, after: DataFrame, author: str) -> DataFrame:
    """Paragraphs that differ once the author's tracked changes are taken out of both versions:
    ``(doc_id, no, before, after)``.  Documents without a change by the author are skipped."""
    slim = materialize(_runs_and_marks(_main(after)))  # read twice: for the documents touched and for their texts
    touched = wide(slim.where(_by("ins", author) | _by("del", author)).select("doc_id").distinct())
    text = lambda n: paragraph_text(reject_author_changes(n.join(touched, "doc_id", "left_semi"), author), dealt=True)
    a = text(_runs_and_marks(_main(before))).select("doc_id", "no", F.col("content").alias("before"))
    b = text(slim).select("doc_id", "no", F.col("content").alias("after"))
    return a.join(b, ["doc_id", "no"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def paragraph_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paragraph counts of both versions and the signed difference."""
    count = lambda n, c: _main(n).where((F.col("kind") == "e") & (F.col("tag") == "p")).groupBy("doc_id").agg(F.count(F.lit(1)).alias(c))
    j = count(before, "n_before").join(count(after, "n_after"), "doc_id", "full_outer")
    b, a = F.coalesce("n_before", F.lit(0)), F.coalesce("n_after", F.lit(0))
    return j.select("doc_id", b.alias("n_before"), a.alias("n_after"), (a - b).alias("delta"))


def _ops(batches):
    import pandas as pd
    for pdf in batches:
        rows = []
        for doc, no, a, b in zip(pdf["doc_id"], pdf["no"], pdf["before"], pdf["after"]):
            a, b = a or "", b or ""
            blocks = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
            rows += [(doc, no, i, op, a[s:e], b[x:y]) for i, (op, s, e, x, y) in enumerate(blocks) if op != "equal"]
        yield pd.DataFrame(rows, columns=["doc_id", "no", "ord", "op", "removed", "added"])


def word_diff(pairs: DataFrame, level: str = "char") -> DataFrame:
    """Changes inside differing paragraphs ``(doc_id, no, before, after)``.

    ``char`` gives ordered runs of characters (each pair is compared on its own, in Python, and only pairs
    that differ get there); ``word`` gives the words removed and added as a bag, in native expressions.
    """
    differing = pairs.where(~F.col("before").eqNullSafe(F.col("after")))
    if level == "char":
        return differing.select("doc_id", "no", "before", "after").mapInPandas(_ops, "doc_id string, no int, ord int, op string, removed string, added string")
    bag = lambda c, sign: F.transform(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: F.struct(x.alias("word"), F.lit(sign).alias("_s")))
    words = differing.select("doc_id", "no", F.explode(F.concat(bag("before", -1), bag("after", 1))).alias("_w")).select("doc_id", "no", "_w.*").where("word <> ''")
    both = words.groupBy("doc_id", "no", "word").agg(F.sum("_s").alias("change"))
    return both.where("change <> 0")


def new_errors(current: DataFrame, original: DataFrame, keys: Sequence[str] = ("doc", "part")) -> DataFrame:
    """Distinct messages of the current version that the original did not have (a part it lacked had none)."""
    c, o = (d.select(*keys, "message").distinct() for d in (current, original))
    return c.join(o, [*keys, "message"], "left_anti")


def error_buckets(parts: DataFrame, current: DataFrame, original: DataFrame, keys: Sequence[str] = ("doc", "part")) -> DataFrame:
    """Bucket of each part: ``skipped`` (no schema, ``checked`` false), ``valid``, ``only old errors`` or ``new errors``."""
    now = current.select(*keys, "message").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_now"))
    new = new_errors(current, original, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_new"))
    j = parts.join(now, list(keys), "left").join(new, list(keys), "left")
    return j.select(*keys, F.when(~F.col("checked"), "skipped").when(F.col("_now").isNull(), "valid").when(F.col("n_new").isNull(), "only old errors")
                    .otherwise("new errors").alias("bucket"), F.coalesce("n_new", F.lit(0)).alias("n_new"))
