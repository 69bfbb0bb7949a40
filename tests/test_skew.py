"""Hot keys: one key holding a third of all rows must be split across tasks
and still give exact results (compared with brute force)."""

import datetime as dt
import time

from pyspark.sql import functions as F

from pagemill.operators import rate as R
from pagemill.sources import testdata as D


def _hot_events(spark, n=3000):
    rows = []
    base = dt.datetime(2024, 1, 1)
    for i in range(n):
        user = 7 if i % 3 == 0 else i % 97          # user 7 holds a third of all rows
        ts = base + dt.timedelta(seconds=(i * 1151) % (40 * 86400) + (i % 5))
        rows.append((i, user, ts))
    return spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")


def _brute(rows, limit, w):
    by_key = {}
    for eid, key, sec in rows:
        by_key.setdefault(key, set()).add(sec)
    out = {}
    for eid, key, sec in rows:
        n = sum(1 for s in by_key[key] if sec - w < s <= sec)
        out[eid] = (n, n > limit)
    return out


def test_rate_flag_hot_key_is_split_and_exact(spark):
    ev = _hot_events(spark)
    w, limit = 86400, 20
    got = R.flag_rate(ev, "user_id", "ts", limit=limit, window_seconds=w, chunk_seconds=w)
    secs = [(r.event_id, r.user_id, int(r.ts.replace(tzinfo=dt.timezone.utc).timestamp()))
            for r in ev.collect()]
    want = _brute(secs, limit, w)
    rows = got.select("event_id", "n_in_window", "flagged").collect()
    assert len(rows) == len(secs)
    assert all((r.n_in_window, r.flagged) == want[r.event_id] for r in rows)
    # the hot key is spread over many (key, chunk) window partitions
    chunks = got.filter("user_id = 7").select(F.floor(F.col("sec") / w).alias("c")).distinct().count()
    assert chunks >= 10


def test_rate_flag_dense_key_is_linear(spark):
    """One key with a request in every second, and many in some: counts are exact and the time
    follows the number of seconds, not its product with the window."""
    def run(n):
        ids = spark.range(n + n // 2)
        ev = ids.select("id", F.lit("k").alias("key"), F.timestamp_seconds(F.col("id") % n).alias("ts"))
        began = time.perf_counter()
        out = R.flag_rate(ev, "key", "ts", limit=1000, window_seconds=86_400)
        wrong = out.where(F.col("n_in_window") != F.least(F.col("sec") + 1, F.lit(86_400))).count()
        assert wrong == 0 and out.count() == n + n // 2
        return time.perf_counter() - began
    run(20_000)
    small, large = run(100_000), run(400_000)
    assert large < 4 * 4 * max(small, 0.5)


def test_rate_flag_keeps_null_keys_and_times(spark):
    rows = [(1, None, dt.datetime(2024, 1, 1)), (2, None, dt.datetime(2024, 1, 1)), (3, "a", None)]
    got = {r.id: r.n_in_window for r in R.flag_rate(
        spark.createDataFrame(rows, "id long, key string, ts timestamp"), "key", "ts", 1, 60).collect()}
    assert got == {1: 1, 2: 1, 3: None}


def test_table_pages_split_hot_order(spark):
    # order 1 holds 2,500 of 3,000 line items, numbered through
    rows = [(1 if i < 2500 else 2 + i % 100, i % 997, i % 13, i + 1 if i < 2500 else i % 7, float(i % 50), 100.0 + i, "N",
             dt.datetime(1995, 1, 1)) for i in range(3000)]
    li = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                                     "l_quantity double, l_extendedprice double, l_returnflag string, "
                                     "l_shipdate timestamp")
    sizes = {r.page_id: r.content.count("<tr><td>") for r in D.table_pages_from(li).collect()}
    assert {k: v for k, v in sizes.items() if k.startswith("1.")} == {"1.0": 999, "1.1": 1000, "1.2": 501}
    assert sum(sizes.values()) == 3000


def test_corpus_oldest_page_tie_goes_to_the_smallest_id(spark):
    from pagemill.operators import quality as Q
    rows = [(str(i), "w", (str(i), "2024-01-01T00:00:00")) for i in (3, 1, 2)]
    df = spark.createDataFrame(rows, "id string, content string, metadata struct<id:string,last_modified:string>")
    assert Q.corpus_summary(df).select("oldest_page_id", "newest_page_id").first() == ("1", "1")
