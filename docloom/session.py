"""Session set-up and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def get_session(app: str = "docloom", master: str | None = None, partitions: int | None = None,
                driver_memory: str | None = None) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE, skew-join splitting)."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false"))
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a scratch folder only where none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = configured or tempfile.mkdtemp(prefix="docloom-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as a columnar table in the shared checkpoint folder and read it back.

    This cuts the lineage for loops and fixes results that are used several times: they are computed
    once, later reads see only the columns and row groups they need, join planning sees the true size,
    and a lost executor can change nothing that was computed.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    for owned in _owned:
        owned.append(path)
    return spark.read.schema(df.schema).parquet(path)


def wide(df: DataFrame) -> DataFrame:
    """The lookup side of a join that grows with the input: shuffled and sorted, never gathered on the driver for a broadcast.

    The planner goes by guesses that are far too small for rows out of ``explode``, a parser, or a few columns of a well
    compressed written table.
    """
    return df.hint("merge")


_owned: list[list[str]] = []  # tables of every open ``written_tables`` block


@contextmanager
def written_tables(spark: SparkSession) -> Iterator[None]:
    """Owner of the tables that ``materialize`` writes inside the block: they go when the block ends.

    Use results inside it (write or collect them), since they read those tables.
    """
    paths: list[str] = []
    _owned.append(paths)
    try:
        yield
    finally:
        _owned[:] = [x for x in _owned if x is not paths]
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in paths:
            table = hadoop.Path(path)
            table.getFileSystem(spark._jsc.hadoopConfiguration()).delete(table, True)
