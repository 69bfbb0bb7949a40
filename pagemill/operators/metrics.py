"""Labelled counters (G5) and cumulative latency histograms (G6) over an
event table.  Both are one grouped aggregate: map-side partial aggregation
means a hot label costs nothing extra in the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default histogram bucket bounds and their label text.
DEFAULT_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
INF_LABEL = "+Inf"


def bucket_label(b: float) -> str:
    return repr(float(b))


def count_by(events: DataFrame, *labels: str, name: str = "n") -> DataFrame:
    """Number of events per label combination (e.g. method, status)."""
    return events.groupBy(*labels).agg(F.count(F.lit(1)).alias(name))


def latency_histogram(events: DataFrame, label: str, value: str, buckets=DEFAULT_BUCKETS) -> DataFrame:
    """G6 long form: ``label, le, cumulative_count`` with one row per bucket
    bound plus ``+Inf`` (every observation), per label value."""
    aggs = [F.count_if(F.col(value) <= F.lit(float(b))).alias(f"b{i}") for i, b in enumerate(buckets)]
    aggs.append(F.count(F.col(value)).alias("binf"))
    g = events.groupBy(label).agg(*aggs)
    pairs = [F.struct(F.lit(bucket_label(b)).alias("le"), F.col(f"b{i}").alias("c")) for i, b in enumerate(buckets)]
    pairs.append(F.struct(F.lit(INF_LABEL).alias("le"), F.col("binf").alias("c")))
    return (g.select(label, F.explode(F.array(*pairs)).alias("x"))
            .select(label, F.col("x.le").alias("le"), F.col("x.c").cast("long").alias("cumulative_count")))


def latency_totals(events: DataFrame, label: str, value: str, digits: int | None = 6) -> DataFrame:
    """G6 companions: ``label, n, total`` (observation count and sum)."""
    total = F.sum(F.col(value))
    return events.groupBy(label).agg(
        F.count(F.col(value)).alias("n"),
        (F.round(total, digits) if digits is not None else total).alias("total"),
    )
