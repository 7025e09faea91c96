"""Row-shaped sources and the sinks."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import PySparkException


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page table ``(page_id, url, html)``."""
    return spark.read.parquet(path)


def read_delimited(spark: SparkSession, path: str, schema: str | T.StructType, columns: Sequence[str] | None = None,
                   dates: Mapping[str, str] | None = None, sep: str = ",", header: bool = True) -> DataFrame:
    """Delimited text with given types, a column subset, and date columns with their patterns."""
    df = spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)
    for c, pattern in (dates or {}).items():
        df = df.withColumn(c, F.try_to_timestamp(F.col(c), F.lit(pattern)).cast("date"))
    return df.select(*columns) if columns else df


def read_sheets_union(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Stack named sheets; columns a sheet lacks are null."""
    out = None
    for name, df in frames.items():
        named = df.withColumn("sheet", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


BOX_FIELDS = """pages array<struct<page_number:int,image_width:int,image_height:int>>,
form_fields array<struct<page_number:int,description:string,field_label:string,label_bounding_box:array<double>,
entry_bounding_box:array<double>,entry_text:struct<text:string,font_size:double,font_color:string>>>"""


def read_fields_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Form descriptions -> (page rows, field rows); ``has_text`` keeps "no entry_text" apart from ``{}``."""
    return field_rows(spark.read.schema(BOX_FIELDS).option("multiLine", True).json(path).withColumn("doc", F.input_file_name()))


def field_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc, pages, form_fields)`` -> (page rows, field rows)."""
    pages = raw.select("doc", F.explode_outer("pages").alias("p")).select("doc", "p.*")
    fields = raw.select("doc", F.posexplode_outer("form_fields").alias("field_no", "f")).select(
        "doc", "field_no", "f.*", F.col("f.entry_text").isNotNull().alias("has_text"))
    return pages, fields


SEGMENTS = """video_id string, language string, language_code string, is_generated boolean,
transcript array<struct<text:string,start:double,duration:double>>"""


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Transcript documents -> one row per snippet, in order."""
    return segments(spark.read.schema(SEGMENTS).option("multiLine", True).json(path))


def segments(transcripts: DataFrame) -> DataFrame:
    return transcripts.select("video_id", "language", "language_code", "is_generated",
                              F.posexplode("transcript").alias("seq", "s")).select(
        "video_id", "language", "language_code", "is_generated", F.col("seq").cast("long").alias("seq"), "s.*")


def combine_tables(tables: DataFrame) -> DataFrame:
    """Extracted tables ``(table_id, rows array<array<string>>)``: the first row names the columns.

    Rows come out as ``(table_id, row_no, cells map<name, text>)`` so tables with different headers
    stack; tables without a data row vanish.  A name that is taken already gets its column number: ``a``, ``a (3)``.
    """
    kept = tables.where(F.size("rows") > 1).withColumn("_first", F.col("rows")[0])
    taken = F.array().cast("array<string>")
    add = lambda names, i: F.array_append(names, F.when(
        F.array_contains(names, F.get("_first", i)), F.format_string("%s (%d)", F.get("_first", i), i + 1)).otherwise(F.get("_first", i)))
    head = F.aggregate(F.sequence(F.lit(0), F.size("_first") - 1), taken, add)
    return kept.where(F.size("_first") > 0).select("table_id", head.alias("_head"),
                       F.posexplode(F.slice("rows", 2, 2147483647)).alias("row_no", "_row")).select(
        "table_id", "row_no", F.map_from_entries(F.filter(F.arrays_zip("_head", "_row"), lambda e: e["_head"].isNotNull())).alias("cells"))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions whose job ended well (they hold ``_SUCCESS``)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    done = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop.Path(folder, "version=*/_SUCCESS"))
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in done or [])


def write_index(df: DataFrame, path: str) -> None:
    """Replace the index: the new one is written beside the old one and counts once it is complete, so readers see the
    old or the new one, never a part.  The version before stays for readers that have opened it; older ones go."""
    spark = df.sparkSession
    versions = _versions(spark, path)
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={versions[-1] + 1 if versions else 0:06d}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for old in versions[:-1]:
        gone = hadoop.Path(hadoop.Path(path), f"version={old:06d}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


# What Spark says of files that are missing or damaged, and what shows that a store or a cluster failed instead.
DAMAGED = re.compile(r"\[(FAILED_READ_FILE|PATH_NOT_FOUND|UNABLE_TO_INFER_SCHEMA)\b|Could not read footer|is not a Parquet file")
FAILED = re.compile(r"ExecutorLostFailure|FetchFailed|OutOfMemoryError|AccessControlException|AccessDenied|InterruptedIOException|SocketTimeoutException|java\.net\.|TaskKilled")


def read_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest complete index; an empty one when there is none or when its files are missing or damaged.  Other errors raise."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    versions = _versions(spark, path)
    if not versions:
        return spark.createDataFrame([], schema)
    try:
        found = spark.read.parquet(f"{path.rstrip('/')}/version={versions[-1]:06d}").select(*names)
        found.write.format("noop").mode("overwrite").save()  # damage inside the files shows only when they are read
    except (PySparkException, Py4JJavaError) as e:
        if not DAMAGED.search(str(e)) or FAILED.search(str(e)):
            raise
        return spark.createDataFrame([], schema)
    return found


def write_page_text(df: DataFrame, path: str) -> None:
    """Page Markdown ``(host, file, markdown)`` laid out by host; rows spread so that one big host is many files."""
    df.write.mode("overwrite").partitionBy("host").parquet(path)


def write_findings(df: DataFrame, path: str) -> None:
    """Append findings ``(doc, part, line, rule, message)``, laid out by rule."""
    df.select("doc", "part", "line", "rule", "message").write.mode("append").partitionBy("rule").parquet(path)


def run_passes(findings: DataFrame) -> bool:
    """A run passes when it has no findings."""
    return findings.isEmpty()
