"""Token usage and usage sessions over ``usage(session, event_id, ts, input, output, cache_creation, cache_read, window_size)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.numbers import cut
from docloom.operators.ordered import anchored, previous, running_total
from docloom.session import materialize

# Length of a session window, prompt limits and prices per million tokens.
WINDOW_SECONDS = 18_000
PROMPTS_AVERAGE = 125
PRICES = {"input": "3.00", "output": "15.00", "cache_creation": "3.75", "cache_read": "0.30"}


def with_total(usage: DataFrame) -> DataFrame:
    return usage.withColumn("total", sum((F.coalesce(F.col(c), F.lit(0)) for c in PRICES), F.lit(0).cast("long")))


def usage_bands(usage: DataFrame) -> DataFrame:
    """Adds total, percent of the window, and its band (below 50, below 80, above)."""
    u = with_total(usage)
    size = F.coalesce("window_size", F.lit(0))
    pct = F.when(size > 0, F.floor(F.col("total") * 100 / size).cast("long")).otherwise(0)
    return u.withColumn("percent", pct).withColumn("band", F.when(F.col("percent") < 50, "green").when(F.col("percent") < 80, "yellow").otherwise("red"))


def prompt_bands(df: DataFrame, prompts: str = "prompt_count") -> DataFrame:
    """Adds the percent of the assumed 125 prompts (cut at one decimal) and its band."""
    n = F.col(prompts)
    return (df.withColumn("limit_percent", cut(n.cast("decimal(18,0)") * 100 / PROMPTS_AVERAGE, 1))
            .withColumn("limit_band", F.when(n < 75, "green").when(n < PROMPTS_AVERAGE, "yellow").otherwise("red")))


def token_cost(usage: DataFrame) -> DataFrame:
    """Adds ``cost``: each product is cut at six decimals before the sum."""
    parts = [cut(F.coalesce(F.col(c), F.lit(0)).cast("decimal(18,0)") * F.lit(p).cast("decimal(6,2)") / F.lit(1000000).cast("decimal(10,0)"), 6) for c, p in PRICES.items()]
    return usage.withColumn("cost", sum(parts[1:], parts[0]).cast("decimal(28,6)"))


def anchored_sessions(usage: DataFrame) -> DataFrame:
    """Adds ``session_start`` (seconds), ``prev_total`` and ``prompt_count``.

    A session opens at its first event; an event more than 18,000 s after that start opens the next one.
    The count starts at 1 and rises when the total exceeds the previous total of the same key.  The clock
    has whole seconds, and every step works per (key, second), so one busy key spreads over many tasks.
    """
    u = with_total(usage).withColumn("_sec", F.unix_seconds(F.col("ts").cast("timestamp")))
    u = anchored(u, ["session"], "_sec", WINDOW_SECONDS, "session_start").withColumn("_now", F.struct("total", "_sec"))
    u = materialize(u)  # each step below reads its input twice: once per chunk, once per row
    second, order = F.col("_sec"), ["_sec", "ts", "event_id"]
    u = previous(u, ["session"], order, "_now", "_prev", second)
    opens = F.col("_prev").isNull() | (F.col("_prev._sec") < F.col("session_start"))
    rise = F.when(opens, 1).when(F.col("total") > F.col("_prev.total"), 1).otherwise(0)
    u = u.withColumn("prev_total", F.coalesce("_prev.total", F.lit(0))).withColumn("_rise", rise)
    u = running_total(materialize(u), ["session", "session_start"], order, F.col("_rise"), "prompt_count", second)
    return u.withColumn("seconds_in", F.col("_sec") - F.col("session_start")).drop("_sec", "_now", "_prev", "_rise")


def session_summary(sessions: DataFrame) -> DataFrame:
    """One row per session: events, prompts, and seconds until the window resets at its last event."""
    return sessions.groupBy("session", "session_start").agg(F.count(F.lit(1)).alias("n_events"), F.max("prompt_count").alias("prompts"),
                                                            (WINDOW_SECONDS - F.max("seconds_in")).alias("reset_in"))


def burn_rate(sessions: DataFrame) -> DataFrame:
    """Adds tokens per minute, cut at one decimal, once a session is over 60 s old.  The step is from the
    previous sample, the time is that of the whole session."""
    step = (F.col("total") - F.col("prev_total")) * 60
    return sessions.withColumn("tokens_per_min", F.when(F.col("seconds_in") > 60, cut(step.cast("decimal(20,0)") / F.col("seconds_in").cast("decimal(12,0)"), 1)))


def safe_batch(df: DataFrame, parsed: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Run expressions that may fail on single rows: ``parsed`` maps new columns to *try* expressions.

    Rows where every result is there go on; the others are set apart with the names of what failed.
    """
    out = df
    for name, expr in parsed.items():
        out = out.withColumn(name, F.expr(expr))
    failed = F.filter(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in parsed]), lambda x: x.isNotNull())
    out = out.withColumn("_failed", failed)
    return out.where(F.size("_failed") == 0).drop("_failed"), out.where(F.size("_failed") > 0).withColumn("error", F.concat_ws(",", "_failed")).drop("_failed")
