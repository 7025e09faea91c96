"""Query registry: each query reads the given tables and names the SQL that must agree with it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


# ``FROM t EACH k BELOW n`` repeats every row n times with k = 0 .. n - 1, in either dialect.
EACH = re.compile(r"EACH (\w+) BELOW (\d+)")


class Tables:
    """Parquet tables of one folder; ``sql`` runs Spark SQL with ``{table}`` placeholders."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        text = EACH.sub(lambda m: f"LATERAL VIEW explode(sequence(0, {int(m[2]) - 1})) each_{m[1]} AS {m[1]}", text)
        names = set(re.findall(r"\{(\w+)\}", text)) - set(frames)
        return self.spark.sql(text, **{n: getattr(self, n) for n in names}, **frames)


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[Tables], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None, **derived: str):
        """Register a query.  ``derived`` names input SQL that the oracle sees as common tables."""

        def add(fn: Callable[[Tables], DataFrame]):
            self.queries[name] = fn
            if oracle is not None:
                self.oracles[name] = with_tables(oracle, **derived)
            return fn

        return add


def with_tables(sql: str, **derived: str) -> str:
    """Prefix the derived inputs as common table expressions in plain table names."""
    unnest = lambda m: f"CROSS JOIN (SELECT unnest(range({m[2]})) AS {m[1]}) each_{m[1]}"
    plain = {k: EACH.sub(unnest, re.sub(r"\{(\w+)\}", r"\1", v)).strip() for k, v in derived.items()}
    ctes = [f"{k} AS ({v})" for k, v in plain.items()]
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + body[len("WITH RECURSIVE"):].strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes) + ", " + body[5:].strip()
    return "WITH " + ", ".join(ctes) + " " + body
