"""Exact medians of large groups by selection, without gathering or sorting a group.

Equal values of a group are counted first.  Each group then has a range of values that
holds its two middle ranks; the range is cut into equal steps, the values in each step
are counted (partial sums on the map side), and the step that holds the rank becomes the
new range.  That goes on until every range holds few different values, and only those
are put in order.  A group of any size is spread over all tasks, and each round reads
the counted values once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import written

#: Steps of a range in one round, and different values of a range that are put in order.
STEPS, SORTED_VALUES = 1024, 1_000


def _counted(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """The counted values inside each target's range."""
    inside = (F.col("v") >= F.col("lo")) & (F.col("v") < F.col("lo") + F.col("width"))
    return rows.join(targets, "_k").where(inside)


def _at_rank(counts: DataFrame, order: str) -> DataFrame:
    """The row of each target in which the running count passes the rank."""
    w = Window.partitionBy("_k", "which").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counts.withColumn("_upto", F.sum("n").over(w))
    return upto.where((F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("n") <= F.col("rank")))


def exact_medians(values: DataFrame, keys: list[str], value: str | Column, steps: int = STEPS, sorted_values: int = SORTED_VALUES) -> DataFrame:
    """(keys, median) per group of ``values``: the middle value, or the mean of the two middle ones.

    ``value`` is an integer column; nulls don't count, and a group of nothing else has no
    row.  A null key is a key.
    """
    v = F.col(value) if isinstance(value, str) else value
    rows = values.select(F.struct(*[F.col(k) for k in keys]).alias("_k"), v.cast("long").alias("v")).where("v IS NOT NULL")
    rows = written(rows.groupBy("_k", "v").agg(F.count(F.lit(1)).alias("n")), "median_values")
    bounds = rows.groupBy("_k").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranks = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.expr(e).alias("rank")) for i, e in enumerate(("(total - 1) DIV 2", "total DIV 2"))]))
    targets = bounds.select("_k", "lo", (F.col("hi") - F.col("lo") + 1).alias("width"), "distinct", ranks.alias("r")).select("_k", "r.*", "lo", "width", "distinct")
    targets = written(targets, "median_ranges")
    while (targets.agg(F.max("distinct")).first()[0] or 0) > sorted_values:
        step = F.ceil(F.col("width") / steps).cast("long")
        hist = _counted(rows, targets).withColumn("step", step).withColumn("bucket", F.expr("(v - lo) DIV step"))
        hist = hist.groupBy("_k", "which", "rank", "lo", "step", "bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct"))
        targets = _at_rank(hist, "bucket").select(
            "_k", "which", (F.col("rank") - (F.col("_upto") - F.col("n"))).alias("rank"),
            (F.col("lo") + F.col("bucket") * F.col("step")).alias("lo"), F.col("step").alias("width"), "distinct")
        targets = written(targets, "median_ranges")
    middle = _at_rank(_counted(rows, targets), "v")
    return middle.groupBy("_k").agg((F.sum("v") / F.lit(2.0)).alias("median")).select("_k.*", "median")
