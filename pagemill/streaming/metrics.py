"""Streaming request counters and latency histograms.

Event-time windows with a watermark: each (window, label) row is emitted
once, when the watermark passes the window end (append mode), so state stays bounded.

Spark's windowed aggregate drops rows whose window is closed.  ``start_counts_with_late``
keeps them: every micro-batch leaves its own counts per window, those of windows that the
watermark had passed before the batch marked late, and a log entry with the latest time
it has seen.  The watermark is the latest time of the batches before, less the delay, as
in Spark; it comes from the log, so a batch that runs again marks the same rows.
``window_figures`` adds the kept counts: a window's count in time and its late
corrections together are all its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators.metrics import DEFAULT_BUCKETS, INF_LABEL, bucket_label
from pagemill.sources import named_files as N


def _event_time(events: DataFrame, ts: str) -> DataFrame:
    """Watermarks need ``TIMESTAMP``; NTZ event times are read as UTC."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_counts(events: DataFrame, ts: str, labels: list[str], window: str, watermark: str) -> DataFrame:
    """G5 per event-time window: ``window_start, window_end, *labels, n``."""
    g = (_event_time(events, ts).withWatermark(ts, watermark)
         .groupBy(F.window(ts, window).alias("w"), *labels)
         .agg(F.count(F.lit(1)).alias("n")))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *labels, "n")


def windowed_histogram(events: DataFrame, ts: str, label: str, value: str, window: str, watermark: str,
                       buckets=DEFAULT_BUCKETS) -> DataFrame:
    """G6 per event-time window, wide form: ``le_*`` cumulative bucket counts,
    ``le_inf``, ``n`` and ``total``.  (Long form is a projection downstream.)"""
    aggs = [F.count_if(F.col(value) <= F.lit(float(b))).alias("le_" + bucket_label(b).replace(".", "_"))
            for b in buckets]
    aggs += [F.count(F.col(value)).alias("le_inf"), F.count(F.col(value)).alias("n"), F.sum(value).alias("total")]
    g = (_event_time(events, ts).withWatermark(ts, watermark)
         .groupBy(F.window(ts, window).alias("w"), label).agg(*aggs))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), label,
                    *[a for a in g.columns if a.startswith("le_") or a in ("n", "total")])


def long_form(hist: DataFrame, label: str, buckets=DEFAULT_BUCKETS) -> DataFrame:
    """Wide ``le_*`` columns to ``le, cumulative_count`` rows."""
    pairs = [F.struct(F.lit(bucket_label(b)).alias("le"), F.col("le_" + bucket_label(b).replace(".", "_")).alias("c"))
             for b in buckets]
    pairs.append(F.struct(F.lit(INF_LABEL).alias("le"), F.col("le_inf").alias("c")))
    return hist.select("window_start", "window_end", label, F.explode(F.array(*pairs)).alias("x")) \
               .select("window_start", "window_end", label, F.col("x.le").alias("le"),
                       F.col("x.c").alias("cumulative_count"))


def _log(spark: SparkSession, target: str) -> dict[int, int | None]:
    """The whole batches of a target and the latest time of each, in microseconds."""
    found = {}
    for name in N.read_names(spark, f"{target}/log"):
        _, batch, latest = name.split("_")
        found[int(batch)] = None if latest == "none" else int(latest)
    return found


def _passed(latest: list[int], watermark: str):
    """The watermark behind the latest times seen, or null before any."""
    return F.timestamp_micros(F.lit(max(latest) if latest else None).cast("long")) - F.expr(f"INTERVAL {watermark}")


def keep_counts(batch: DataFrame, batch_id: int, target: str, ts: str, labels: list[str], window: str, watermark: str) -> bool:
    """Keep one micro-batch's counts under ``target``; False if they were kept before.

    Rows without a time are in no window.  The log entry is written after the counts.
    """
    spark, log = batch.sparkSession, _log(batch.sparkSession, target)
    if batch_id in log:
        return False
    rows = _event_time(batch, ts).where(F.col(ts).isNotNull())
    counts = rows.groupBy(F.window(ts, window).alias("w"), *labels).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("latest"))
    before = _passed([t for b, t in log.items() if b < batch_id and t is not None], watermark)
    counts = counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *labels, "n", "latest",
                           F.coalesce(F.col("w.end") <= before, F.lit(False)).alias("late"))
    path = f"{target}/batch_{batch_id}"
    counts.write.mode("overwrite").parquet(path)
    latest = spark.read.schema(counts.schema).parquet(path).agg(F.unix_micros(F.max("latest"))).first()[0]
    entry = spark.createDataFrame([(f"batch_{batch_id}_{'none' if latest is None else latest}", "")], "name string, content string")
    N.write_files(entry, f"{target}/log", "append")
    return True


def window_figures(spark: SparkSession, target: str, labels: list[str], watermark: str) -> DataFrame:
    """``window_start, window_end, *labels, n_in_time, n_late, closed`` of the kept counts."""
    log = _log(spark, target)
    rows = spark.read.parquet(*[f"{target}/batch_{b}" for b in sorted(log)])
    now = _passed([t for t in log.values() if t is not None], watermark)
    sums = rows.groupBy("window_start", "window_end", *labels).agg(
        F.sum(F.when(~F.col("late"), F.col("n")).otherwise(0)).alias("n_in_time"), F.sum(F.when(F.col("late"), F.col("n")).otherwise(0)).alias("n_late"))
    return sums.withColumn("closed", F.coalesce(F.col("window_end") <= now, F.lit(False)))


def _start(frame: DataFrame, out: str, checkpoint: str, available_now: bool):
    q = frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="30 seconds")
    return q.start()


def start_windowed_counts(spark: SparkSession, src: str, schema, out: str, checkpoint: str, ts: str, labels: list[str],
                          window: str = "1 minute", watermark: str = "10 minutes", fmt: str = "parquet",
                          available_now: bool = True):
    """Run T2 counters: landed event files -> closed windows appended under ``out``."""
    stream = spark.readStream.schema(schema).format(fmt).load(src)
    return _start(windowed_counts(stream, ts, labels, window, watermark), out, checkpoint, available_now)


def start_counts_with_late(spark: SparkSession, src: str, schema, target: str, checkpoint: str, ts: str, labels: list[str],
                           window: str = "1 minute", watermark: str = "10 minutes", fmt: str = "parquet",
                           available_now: bool = True, max_files: int = 100) -> StreamingQuery:
    """Run T2 counters with late rows: landed event files -> counts per batch under ``target`` (see ``window_figures``)."""
    stream = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files).load(src)

    def keep(batch: DataFrame, batch_id: int) -> None:
        keep_counts(batch, batch_id, target, ts, labels, window, watermark)
    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="30 seconds")
    return q.start()


def start_windowed_histogram(spark: SparkSession, src: str, schema, out: str, checkpoint: str, ts: str, label: str, value: str,
                             window: str = "1 minute", watermark: str = "10 minutes", fmt: str = "parquet",
                             available_now: bool = True, max_files: int = 100):
    """Run T2 histograms: landed event files -> closed windows (wide form) appended under ``out``."""
    stream = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files).load(src)
    return _start(windowed_histogram(stream, ts, label, value, window, watermark), out, checkpoint, available_now)
