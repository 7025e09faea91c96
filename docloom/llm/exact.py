"""Exact deduplication: 128-bit content hashes, with the bytes compared inside the groups.  DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: str = "max",
                 hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Rows form a group when their texts are equal after lower-casing A-Z (null is empty, and empty texts are
    equal).  ``keep`` names the id that stays: the largest (``"max"``) or the smallest (``"min"``).

    Counts and the id that stays come from an aggregation on the hash, which combines a hot group inside each
    task first.  Equality of bytes is then checked for every hash that occurs twice: the smallest and the
    largest text of a hash are the same only if all are, and both combine inside tasks too.  Hashes that fail
    (collisions) are grouped again by the text itself.

    Rows that share id and text are one document: each of them is reported, with the same decision.  Null ids
    never stay while the group has another; a group of null ids only keeps them all.  An empty table gives no
    rows; other columns are not read, so their names cannot clash.
    """
    best = {"max": F.max, "min": F.min}[keep]
    rows = docs.select(F.col(id).alias("_id"), ascii_lower(F.col(text)).alias("_text"))
    hashes = rows.select("_id", F.col("_text"), hashed(F.col("_text")).alias("_hash"))
    keyed = materialize(hashes.select("_id", "_hash", F.sha2("_text", 256).alias("_sha")))
    groups = keyed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"), best("_id").alias("_keep")).where("_n > 1")
    groups = materialize(groups)  # a side of its own, so that the joins below can split a hot hash
    bounds = (hashes.join(groups.select("_hash"), "_hash", "left_semi").groupBy("_hash")
              .agg(F.min("_text").alias("_low"), F.max("_text").alias("_high")))
    clashes = materialize(bounds.where("_low <> _high").select("_hash"))

    decided = keyed.join(groups, "_hash", "left").select("_id", "_hash", "_sha", "_n", "_keep")
    if not clashes.isEmpty():
        apart = hashes.join(clashes, "_hash", "left_semi").withColumn("_sha", F.sha2("_text", 256))
        split = apart.groupBy("_hash", "_text").agg(F.count(F.lit(1)).alias("_n"), best("_id").alias("_keep"))
        apart = apart.join(split, ["_hash", "_text"]).select("_id", "_hash", "_sha", "_n", "_keep")
        decided = decided.join(clashes, "_hash", "left_anti").unionByName(apart)
    keep_id = F.when(F.col("_n") > 1, F.col("_keep")).otherwise(F.col("_id"))
    return decided.select(
        F.col("_id").alias(id), keep_id.alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: str = "max") -> DataFrame:
    """``docs`` without the rows that do not stay; rows that agree in id and text come out once."""
    stay = exact_groups(docs, id, text, keep).where("kept").select(F.struct(F.col(id)).alias("_kept_id"), F.col("text_sha256").alias("_kept_sha")).distinct()
    key = [F.struct(F.col(id)).alias("_kept_id"), F.sha2(ascii_lower(F.col(text)), 256).alias("_kept_sha")]
    return docs.select("*", *key).join(stay, ["_kept_id", "_kept_sha"], "left_semi").dropDuplicates(["_kept_id", "_kept_sha"]).drop("_kept_id", "_kept_sha")
