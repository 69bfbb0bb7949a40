"""Stream results equal batch results."""

import os
import time

from pyspark.sql import functions as F

from pagemill.operators import pages as P
from pagemill.operators import rate as R
from pagemill.sources import landed as A
from pagemill.sources import testdata as D
from pagemill.streaming import metrics as SM
from pagemill.streaming import pages as SP
from pagemill.streaming import rate as SR
from tests.conftest import SF_SMALL


def _land_in_time_order(df, path, n=4):
    """Write ``df`` as ``n`` files, one per time range, oldest first, so the
    file source reads them in event-time order."""
    bounds = df.select(F.unix_micros(F.min("ts").cast("timestamp")).alias("lo"),
                       F.unix_micros(F.max("ts").cast("timestamp")).alias("hi")).first()
    step = (bounds.hi - bounds.lo) // n + 1
    for i in range(n):
        t = F.unix_micros(F.col("ts").cast("timestamp"))
        part = df.filter((t >= bounds.lo + i * step) & (t < bounds.lo + (i + 1) * step))
        part.coalesce(1).write.mode("append").parquet(path)


def _run_memory(df, name, checkpoint, mode="append", files_per_trigger=None):
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination(600)
    return q


def test_t1_stream_equals_batch(spark, tmp_out):
    src, out, ck = (os.path.join(tmp_out, d) for d in ("src", "out", "ck"))
    D.wiki_pages_raw(spark, SF_SMALL).repartition(4).write.json(src)
    q = SP.start_processing(spark, src, out, ck, "http://w")
    q.awaitTermination(600)
    got = spark.read.json(out).select("id", "content", F.col("metadata.url").alias("url"))
    raw = A.read_raw_pages(spark, src)
    want = P.process_pages(A.flatten_pages(raw, "http://w").drop("space_key")).select(
        "id", "content", F.col("metadata.url").alias("url"))
    assert got.count() == want.count() == 50
    assert got.exceptAll(want).count() == 0


def test_t1_broken_records_are_dead_letters(spark, tmp_out):
    src, out, dead, ck = (os.path.join(tmp_out, d) for d in ("src", "out", "dead", "ck"))
    D.wiki_pages_raw_broken(spark, SF_SMALL).repartition(2).write.json(src)
    SP.start_processing(spark, src, out, ck + "1", "http://w").awaitTermination(600)
    SP.start_dead_letters(spark, src, dead, ck + "2").awaitTermination(600)
    ok, bad = A.split_raw_pages(A.read_raw_pages(spark, src))
    assert spark.read.json(out).count() == ok.count() and spark.read.json(dead).exceptAll(bad.select("error_type", "id", "message", "raw", "source_file")).count() == 0
    assert spark.read.json(dead).count() == bad.count() > 0


def test_t3_late_events_are_listed(spark, tmp_out):
    src = os.path.join(tmp_out, "ev")
    rows = [[(1, 1, "2024-01-02 00:00:00"), (2, 1, "2024-01-02 10:00:00")], [(3, 1, "2024-01-03 00:00:00")],
            [(4, 1, "2024-01-01 00:00:00"), (5, 1, "2024-01-03 00:30:00")]]
    for part in rows:
        df = spark.createDataFrame(part, "event_id long, user_id long, t string")
        df.select("event_id", "user_id", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files are read by modification time
    schema, out = spark.read.parquet(src).schema, os.path.join(tmp_out, "flags")
    SR.start_rate_flags(spark, src, schema, out, os.path.join(tmp_out, "ck"), "user_id", "ts", 1, 3600, max_files=1).awaitTermination(600)
    flagged = {r.event_id for r in spark.read.parquet(out).collect()}
    late = {r.event_id for r in SR.write_late_events(spark, src, schema, out, os.path.join(tmp_out, "late")).collect()}
    assert flagged | late == {1, 2, 3, 4, 5} and flagged & late == set() and late <= {4}


def test_t2_windowed_counts_equal_batch(spark, tmp_out):
    src = os.path.join(tmp_out, "ev")
    ev = D.requests(spark, SF_SMALL)
    _land_in_time_order(ev, src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    counts = SM.windowed_counts(stream, "ts", ["method"], "6 hours", "1 hour")
    _run_memory(counts, "t2_counts", os.path.join(tmp_out, "ck"))
    got = spark.table("t2_counts")
    want = (ev.groupBy(F.window("ts", "6 hours").alias("w"), "method").agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "method", "n"))
    assert got.count() > 0
    # every emitted (closed) window equals the batch figure
    assert got.exceptAll(want).count() == 0


def test_t2_histogram_long_form(spark):
    ev = D.requests(spark, SF_SMALL)
    h = SM.long_form(SM.windowed_histogram(ev, "ts", "method", "duration", "1 day", "1 hour"), "method")
    inf = h.filter(F.col("le") == "+Inf").groupBy().sum("cumulative_count").first()[0]
    assert inf == ev.count()


def test_t3_stream_equals_batch_on_ordered_input(spark, tmp_out):
    src = os.path.join(tmp_out, "ev")
    ev = D.table(spark, SF_SMALL, "events").select("event_id", "user_id", "ts")
    _land_in_time_order(ev, src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    flagged = SR.flag_rate_stream(stream, "user_id", "ts", limit=2, window_seconds=3 * 3600)
    _run_memory(flagged, "t3_flags", os.path.join(tmp_out, "ck"))
    got = spark.table("t3_flags").select("event_id", "n_in_window", "flagged")
    want = R.flag_rate(ev, "user_id", "ts", limit=2, window_seconds=3 * 3600).select(
        "event_id", "n_in_window", "flagged")
    assert got.count() == want.count() == 1000
    assert got.exceptAll(want).count() == 0
    assert want.filter("flagged").count() > 0


def test_stream_runners_write_sinks(spark, tmp_out):
    src = os.path.join(tmp_out, "ev")
    ev = D.table(spark, SF_SMALL, "events").select("event_id", "user_id", "event_type", "ts")
    _land_in_time_order(ev, src)
    q = SR.start_rate_flags(spark, src, ev.schema, os.path.join(tmp_out, "flags"), os.path.join(tmp_out, "ck1"),
                            "user_id", "ts", limit=2, window_seconds=3 * 3600)
    q.awaitTermination(600)
    got = spark.read.parquet(os.path.join(tmp_out, "flags")).select("event_id", "n_in_window", "flagged")
    want = R.flag_rate(ev, "user_id", "ts", limit=2, window_seconds=3 * 3600).select(
        "event_id", "n_in_window", "flagged")
    assert got.count() == 1000 and got.exceptAll(want).count() == 0
    q = SM.start_windowed_counts(spark, src, ev.schema, os.path.join(tmp_out, "counts"),
                                 os.path.join(tmp_out, "ck2"), "ts", ["event_type"], "6 hours", "1 hour")
    q.awaitTermination(600)
    counts = spark.read.parquet(os.path.join(tmp_out, "counts"))
    batch = (ev.withColumn("ts", F.col("ts").cast("timestamp"))
             .groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
             .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n"))
    assert counts.count() > 0 and counts.exceptAll(batch).count() == 0


def test_t3_null_keys_times_and_ids_equal_batch(spark, tmp_out):
    src = os.path.join(tmp_out, "ev")
    rows = [(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:00:05"), (3, None, "2024-01-01 00:00:05"), (4, None, "2024-01-01 00:00:06"),
            (None, "a", "2024-01-01 00:00:07"), (6, "a", None), (7, None, None), (2**53 + 1, "b", "2024-01-01 00:00:05"), (9, "a", "2024-01-01 00:00:05")]
    df = spark.createDataFrame(rows, "event_id long, user_id string, t string").select("event_id", "user_id", F.to_timestamp("t").alias("ts"))
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    _run_memory(SR.flag_rate_stream(stream, "user_id", "ts", limit=1, window_seconds=6), "t3_nulls", os.path.join(tmp_out, "ck"))
    cols = ["rate_key", "sec", "event_id", "n_in_window", "flagged"]
    got, want = spark.table("t3_nulls").select(cols), R.flag_rate(df, "user_id", "ts", limit=1, window_seconds=6).select(cols)
    assert got.count() == 9 and got.exceptAll(want).count() == 0


def test_t3_hot_key_over_many_batches_and_blocks(spark, tmp_out):
    """A key with more rows than an Arrow batch, over many blocks, in several micro-batches; the state is dropped behind the window."""
    src = os.path.join(tmp_out, "ev")
    ev = spark.range(6000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 10 < 9, "hot").otherwise((F.col("id") % 7).cast("string")).alias("user_id"),
                                  F.timestamp_seconds(F.lit(1704067200) + F.floor(F.col("id") * 37 + F.pmod(F.hash("id"), F.lit(30)))).alias("ts"))
    _land_in_time_order(ev, src, 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = _run_memory(SR.flag_rate_stream(stream, "user_id", "ts", limit=100, window_seconds=5000, watermark="1 minute"), "t3_hot", os.path.join(tmp_out, "ck"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    got = spark.table("t3_hot").select("event_id", "n_in_window", "flagged")
    want = R.flag_rate(ev, "user_id", "ts", limit=100, window_seconds=5000).select("event_id", "n_in_window", "flagged")
    assert got.count() == 6000 and got.exceptAll(want).count() == 0 and want.where("flagged").count() > 0
    states = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    blocks = 6000 * 37 / SR.BLOCK_SECONDS
    assert max(states) < 8 * 3 * blocks  # entries are blocks of seconds, not events


# -- late rows, children, edited pages ----------------------------------------------
def _land_parts(spark, parts, schema, src):
    for part in parts:
        spark.createDataFrame(part, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files are read by modification time


def test_t2_late_rows_are_counted(spark, tmp_out):
    src, out = os.path.join(tmp_out, "ev"), os.path.join(tmp_out, "out")
    parts = [[("GET", "2024-01-01 00:10:00"), ("GET", "2024-01-01 00:20:00"), (None, "2024-01-01 00:30:00")], [("GET", "2024-01-01 05:00:00")],
             [("PUT", "2024-01-01 00:40:00"), ("GET", "2024-01-01 00:50:00"), ("GET", "2024-01-01 05:10:00"), ("GET", None)],
             [("GET", "2024-01-03 00:00:00")], [("GET", "2024-01-01 05:20:00"), ("END", "2024-01-09 00:00:00")]]
    _land_parts(spark, parts, "method string, ts string", src)
    schema = spark.read.parquet(src).schema
    SM.start_counts_with_late(spark, src, schema, out, os.path.join(tmp_out, "ck"), "ts", ["method"], "1 hour", "1 minute", max_files=1).awaitTermination(600)
    hour = F.date_format("window_start", "yyyy-MM-dd HH").alias("h")
    figures = SM.window_figures(spark, out, ["method"], "1 minute").select("method", hour, "n_in_time", "n_late", "closed").collect()
    want = {}
    for m, t in ((m, t[:13]) for p in parts for m, t in p if t):
        want[m, t] = want.get((m, t), 0) + 1
    assert {(r.method, r.h): r.n_in_time + r.n_late for r in figures} == want
    assert {(r.method, r.h): r.n_late for r in figures if r.n_late} == {("PUT", "2024-01-01 00"): 1, ("GET", "2024-01-01 00"): 1, ("GET", "2024-01-01 05"): 1}
    assert {r.h for r in figures if not r.closed} == {"2024-01-09 00"}
    # a batch that runs again changes nothing
    again = spark.read.parquet(src)
    assert SM.keep_counts(again, 0, out, "ts", ["method"], "1 hour", "1 minute") is False


def test_t2_histogram_stream_equals_batch(spark, tmp_out):
    src, out = os.path.join(tmp_out, "ev"), os.path.join(tmp_out, "out")
    ev = D.requests(spark, SF_SMALL)
    _land_in_time_order(ev, src)
    SM.start_windowed_histogram(spark, src, ev.schema, out, os.path.join(tmp_out, "ck"), "ts", "method", "duration", "6 hours", "1 hour",
                                max_files=1).awaitTermination(600)
    got, want = SM.long_form(spark.read.parquet(out), "method"), SM.long_form(SM.windowed_histogram(ev, "ts", "method", "duration", "6 hours", "1 hour"), "method")
    # both ways: every emitted window is the batch's, and every window that the watermark has passed is emitted
    last = ev.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    closed = want.where(F.col("window_end") <= F.lit(last) - F.expr("INTERVAL 1 HOUR"))
    assert got.count() > 0 and got.exceptAll(want).count() == 0 and closed.exceptAll(got).count() == 0


def _land_json(folder, name, rows, at):
    import json
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    os.utime(path, (at, at))


def _raw_page(i, text="<p>text</p>", version=1, space="en"):
    return {"id": str(i), "title": f"T{i}", "body": {"storage": {"value": text}}, "version": {"number": version, "when": "2024-01-01"}, "space_key": space}


def _comment(i, k):
    return {"id": f"c{i}-{k}", "author": {"displayName": "Ann"}, "created": "2024-01-01", "body": {"storage": {"value": f"<b>said {k}</b>"}}}


def test_t1_pages_come_with_children_that_landed_before_and_after(spark, tmp_out):
    pages, atts, cmts, out = (os.path.join(tmp_out, d) for d in ("pages", "atts", "cmts", "out"))
    t = 1_700_000_000
    att = {"id": "a", "title": "f.txt", "metadata": {"mediaType": "text/plain"}, "extensions": {"fileSize": 7}}
    _land_json(pages, "1.json", [_raw_page(1), _raw_page(2), {"id": "broken"}], t)
    _land_json(pages, "2.json", [_raw_page(3), _raw_page(4)], t + 600)
    _land_json(cmts, "1.json", [{"page_id": "1", "results": [_comment(1, k) for k in (0, 1, 2)]}, {"page_id": "3", "results": [_comment(3, 0)]}], t + 300)
    _land_json(cmts, "2.json", [{"page_id": "none", "results": [_comment(9, 0)]}, {"page_id": "4", "results": []}], t + 300)
    _land_json(atts, "1.json", [{"page_id": "1", "results": [att]}, {"page_id": "3", "results": [att, {**att, "id": "b"}]}], t - 300)
    for folder, row in ((pages, _raw_page(99)), (cmts, {"page_id": "x", "results": [_comment(0, 0)]}), (atts, {"page_id": "x", "results": [att]})):
        _land_json(folder, "9.json", [row], t + 90_000)  # moves the watermark past all of the above
    q = SP.start_processing_with_children(spark, pages, atts, cmts, out, os.path.join(tmp_out, "ck"), "http://w")
    q.awaitTermination(600)
    got = {r.id: r for r in spark.read.json(out).collect()}
    raw = A.split_raw_pages(A.read_raw_pages(spark, pages))[0].where("id != '99'")
    from pagemill import schemas
    batch = P.process_pages(A.flatten_pages(raw, "http://w").drop("space_key"),
                            P.process_attachments(A.attachments(spark.read.schema(schemas.RAW_ATTACHMENTS).json(atts), "http://w")),
                            P.clean_comments(A.comments(spark.read.schema(schemas.RAW_COMMENTS).json(cmts))))
    want = {r.id: r for r in batch.collect()}
    assert set(got) == set(want) == {"1", "2", "3", "4"}
    for i, r in want.items():
        assert [c.asDict() for c in got[i].comments] == [c.asDict() for c in r.comments]
        assert [c.asDict() for c in got[i].attachments] == [c.asDict() for c in r.attachments]
        assert got[i].content == r.content and got[i].metadata.url == r.metadata.url
    assert [c.id for c in got["1"].comments] == ["c1-0", "c1-1", "c1-2"] and len(got["3"].attachments) == 2


def test_t1_edited_pages_newest_version_wins(spark, tmp_out):
    src, target, ck, state = (os.path.join(tmp_out, d) for d in ("src", "target", "ck", "state"))
    t = 1_700_000_000
    _land_json(src, "1.json", [_raw_page(1, "one", 1), _raw_page(2, "two", 1), _raw_page(1, "one", 1)], t)
    _land_json(src, "2.json", [_raw_page(1, "one again", 2), _raw_page(2, "two", 1), _raw_page(3, "three", 10)], t + 60)
    _land_json(src, "3.json", [_raw_page(3, "old three", 9), _raw_page(4, "four", 1)], t + 120)

    def run():
        SP.start_versions(spark, src, target, ck, "http://w", max_files=1, state=state).awaitTermination(600)
        return {r.id: r.content for r in SP.current_pages(spark, target).collect()}
    want = {"1": "one again", "2": "two", "3": "three", "4": "four"}
    assert run() == want
    kept = sum(spark.read.parquet(os.path.join(target, d)).count() for d in os.listdir(target) if d.startswith("batch-"))
    assert kept == 6  # of 8 records one repeats in its batch and one lands again
    # a batch that runs again changes nothing
    again = spark.read.parquet(os.path.join(target, "batch-0")).drop("_version", "_batch").withColumn("content", F.lit("changed"))
    assert SP.write_versions(again, 0, target) is False and run() == want
    from pagemill.operators import quality as Q
    assert Q.finish_summary(Q.merge_states(Q.read_states(spark, state))).first().total_pages == 6
    # a batch without its log entry is not read
    again.withColumn("_version", F.lit(99).cast("long")).withColumn("_batch", F.lit(77).cast("long")).write.parquet(os.path.join(target, "batch-77"))
    assert run() == want
    assert SP.current_pages(spark, os.path.join(tmp_out, "nothing")).count() == 0
