"""Sliding-window rate flag (W1) and rate keys.

Semantics per key: at each request second ``s`` the key's set holds the
distinct request seconds in ``(s - window, s]`` (several requests in one second
count once; the current one counts; rejected ones count too); the request is
flagged when that count exceeds ``limit``.

Plan: linear in the number of distinct (key, second) pairs, whatever the window.
A second adds one to the count at ``s`` and takes it away at ``s + window``, so the
count at any time is a running sum of these steps.  Steps are summed per (key,
chunk of time), and what a chunk starts with is a running sum over the chunks'
totals.  A hot key is spread over as many tasks as it has chunks; its events, which
may be many per second, are joined back on (key, second), where AQE splits them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import epoch_second


def rate_key(func: str | Column, key: Column | None = None) -> Column:
    """``rate_limit:{func}`` or ``rate_limit:{func}:{key}``."""
    f = F.lit(func) if isinstance(func, str) else func
    parts = [F.lit("rate_limit"), f.cast("string")]
    if key is not None:
        parts.append(key.cast("string"))
    return F.concat_ws(":", *parts)


#: Seconds of time that one task sums for a key: at most twice as many steps.
CHUNK_SECONDS = 65_536


def window_counts(seconds: DataFrame, window_seconds: int, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """(rate_key, sec, n_in_window) of the distinct (rate_key, sec) of ``seconds``, which may repeat.

    Steps are dealt once by (key, chunk); the running sums inside the chunks and the chunks'
    totals both read that exchange.
    """
    key = F.struct("rate_key").alias("_k")  # a struct equals itself also where the key is null
    steps = seconds.where("sec IS NOT NULL").select(key, F.explode(F.array(
        F.struct(F.col("sec").alias("t"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct((F.col("sec") + window_seconds).alias("t"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("s"))
    # A second that repeats is one step up and, a window later, one down.
    steps = steps.groupBy("_k", F.col("s.t").alias("t")).agg(F.max("s.up").alias("up"), F.max("s.down").alias("down"))
    chunk = F.floor(F.col("t") / chunk_seconds)
    steps = steps.repartition("_k", chunk).withColumn("_chunk", chunk)
    before = Window.partitionBy("_k").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = steps.groupBy("_k", "_chunk").agg(F.sum(F.col("up") - F.col("down")).alias("_total"), F.max("up").alias("_real"))
    starts = totals.select("_k", "_chunk", "_real", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_k", "_chunk").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = steps.withColumn("_here", F.sum(F.col("up") - F.col("down")).over(inside)).where("up = 1")
    # A left join: an inner one would put a filter below the left side's exchange only, and nothing could be shared.
    counted = counted.join(starts.where("_real = 1").drop("_real"), ["_k", "_chunk"], "left")
    return counted.select("_k.rate_key", F.col("t").alias("sec"), (F.col("_start") + F.col("_here")).alias("n_in_window"))


def flag_rate(events: DataFrame, key: str | Column, ts: str | Column, limit: int, window_seconds: int,
              chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Add ``rate_key``, ``sec``, ``n_in_window`` and ``flagged`` to every event.

    ``ts`` is a timestamp column (NTZ is read as UTC); the request second is
    its whole epoch second.  Events without a time stay, without count and flag.
    """
    if window_seconds < 1:
        raise ValueError("window_seconds must be positive")
    key_c = F.col(key) if isinstance(key, str) else key
    ts_c = F.col(ts) if isinstance(ts, str) else ts
    base = events.select("*", key_c.alias("rate_key"), epoch_second(ts_c).alias("sec"))
    counts = window_counts(base.select("rate_key", "sec"), window_seconds, chunk_seconds)
    counts = counts.select(F.col("rate_key").alias("_key"), F.col("sec").alias("_sec"), "n_in_window")
    same = base["rate_key"].eqNullSafe(counts["_key"]) & base["sec"].eqNullSafe(counts["_sec"])
    return (base.join(counts, same, "left").drop("_key", "_sec")
            .withColumn("flagged", F.col("n_in_window") > F.lit(limit)))
