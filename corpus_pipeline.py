"""Corpus pipeline: documents to packed training sequences, in stages that each read what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import exact, jaccard, quality, secrets
from docloom.llm.queries import packed
from docloom.plans.base import Registry, Tables
from docloom.session import materialize

R = Registry()
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled documents that are not held out."""
    scores = quality.score(docs, quality.fit(docs, Tables(spark, sf_dir).labels), keep=COLUMNS)
    return scores.where("score >= 0.5").select(*COLUMNS)


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts: the one with the largest id."""
    return exact.drop_copies(docs).select(*COLUMNS)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of similar texts: the one with the smallest id.  Documents without an id stay."""
    groups = jaccard.similar_groups(docs).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(groups, "doc_id", "left_semi")
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*COLUMNS)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark."""
    found = secrets.scan(docs, secrets.train(secrets.samples_from(docs)), keep=("doc_id", "lang", "source"))
    clean = secrets.masked(F.col("text"), F.col("spans"))
    return found.withColumn("text", clean).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and place."""
    return packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("exact_dedup", no_exact_copies),
    ("jaccard_join", no_near_copies),
    ("secrets", masked_secrets),
    ("packing", packed_sequences),
]

# The classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written down as Parquet and read again by the next."""
    docs = Tables(spark, sf_dir).documents
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialize(docs)
    return docs


@R.query("pipeline", oracle=ORACLE_SQL)
def pipeline(t: Tables) -> DataFrame:
    return run(t.spark, t.folder)
