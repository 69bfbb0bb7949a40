"""Streaming sliding-window rate flag, per key, on a disk-backed state store.

State per key is a map from blocks of time to the request seconds in them, a bit per
second: an event touches one small entry, whatever the window, and the store keeps the
entries on disk.  A key's events of a micro-batch may be any number.  They come in
Arrow batches; each is put into the map and, if there are several, into a list state,
from which the flags are worked out batch by batch, so that a hot key needs the memory
of one batch and of one count per block.

A count is a difference of two ranks: the request seconds up to the event's, less those
up to a window before it.  Events that are not behind the watermark may come in any
order across batches; a flag counts the seconds known when its event is read, so on
input in time order it equals the batch operator W1.  A timer at event time drops blocks
that no event can reach any more.

Events without a time keep no state and get no count or flag, as in W1.  Events behind
the watermark can't be counted against a window that the state has left already;
``write_late_events`` lists them in a folder of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagemill.functions.text import epoch_second

OUTPUT_SCHEMA = "rate_key string, sec long, event_id long, n_in_window long, flagged boolean"
#: Event files that one micro-batch reads.
MAX_FILES = 100
#: Seconds of a block: an entry of the state is an eighth of it in bytes.
BLOCK_SECONDS = 4096
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packed(seconds: np.ndarray, known: bytes | None) -> bytes:
    """A block's entry with more seconds (counted from its start)."""
    bits = np.zeros(BLOCK_SECONDS, dtype=bool)
    bits[seconds] = True
    entry = np.packbits(bits)
    return (entry | np.frombuffer(known, dtype=np.uint8) if known else entry).tobytes()


class RateFlags(StatefulProcessor):
    """Flags the events of one key; see the module."""

    def __init__(self, limit: int, window_seconds: int):
        self.limit, self.window = limit, window_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "block long", "seconds binary")
        self.waiting = handle.getListState("waiting", "secs binary, ids binary, no_id binary")

    def _remember(self, secs: np.ndarray) -> None:
        seconds = np.unique(secs)
        block = seconds // BLOCK_SECONDS
        cuts = np.flatnonzero(np.diff(block)) + 1
        for part in np.split(seconds, cuts):
            at = (int(part[0] // BLOCK_SECONDS),)
            known = self.blocks.getValue(at)
            self.blocks.updateValue(at, (_packed(part % BLOCK_SECONDS, known[0] if known else None),))

    def _ranks(self, secs: np.ndarray, block_ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How many known seconds are not after each of ``secs``."""
        order = np.argsort(secs, kind="stable")
        ranks = np.empty(len(secs), dtype=np.int64)
        block = secs[order] // BLOCK_SECONDS
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(secs)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            at = int(block[i])
            k = int(np.searchsorted(block_ids, at))
            rank = np.full(j - i, before[k])
            if k < len(block_ids) and block_ids[k] == at:
                bits = np.unpackbits(np.frombuffer(self.blocks.getValue((at,))[0], dtype=np.uint8))
                rank += np.cumsum(bits, dtype=np.int64)[secs[order[i:j]] - at * BLOCK_SECONDS]
            ranks[order[i:j]] = rank
        return ranks

    def _known(self) -> tuple[np.ndarray, np.ndarray]:
        """Blocks in order, and the seconds known before each of them and after the last."""
        sizes = sorted((int(k[0]), int(np.bitwise_count(np.frombuffer(v[0], dtype=np.uint8)).sum())) for k, v in self.blocks.iterator())
        return np.array([k for k, _ in sizes], dtype=np.int64), np.concatenate([[0], np.cumsum([n for _, n in sizes], dtype=np.int64)])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for df in rows:
            if last is not None:
                self.waiting.appendValue(tuple(x.tobytes() for x in last))
            last = df["sec"].to_numpy(np.int64), df["event_id"].to_numpy(np.int64), df["no_id"].to_numpy(bool)
            self._remember(last[0])
        if last is None:
            return
        block_ids, before = self._known()

        def flagged(secs, ids, no_id):
            n = self._ranks(secs, block_ids, before) - self._ranks(secs - self.window, block_ids, before)
            return pd.DataFrame({"rate_key": pd.Series([key[0]] * len(secs), dtype=object), "sec": secs,
                                 "event_id": pd.Series(ids, dtype="Int64").mask(pd.Series(no_id)), "n_in_window": n, "flagged": n > self.limit})

        yield flagged(*last)
        for secs, ids, no_id in self.waiting.get():
            yield flagged(np.frombuffer(secs, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(no_id, bool))
        self.waiting.clear()
        self._wake(block_ids, timerValues.getCurrentWatermarkInMs())

    def _wake(self, block_ids: np.ndarray, watermark: int) -> None:
        """A timer for the time from which no event can reach the first block."""
        if len(block_ids):
            self.handle.registerTimer(max(self._out_of_reach(int(block_ids[0])), watermark + 1))

    def _out_of_reach(self, block: int) -> int:
        return ((block + 1) * BLOCK_SECONDS + self.window) * 1000

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        kept = []
        for block in sorted(int(k[0]) for k in self.blocks.keys()):
            if self._out_of_reach(block) <= watermark:
                self.blocks.removeKey((block,))
            else:
                kept.append(block)
        self._wake(np.array(kept, dtype=np.int64), watermark)
        return iter([])

    def close(self) -> None:
        pass


def _timed(events: DataFrame, key, ts: str) -> DataFrame:
    k = F.col(key) if isinstance(key, str) else key
    times, event_id = F.col(ts).cast("timestamp"), F.col("event_id").cast("long")
    return events.select(k.cast("string").alias("rate_key"), F.coalesce(event_id, F.lit(0)).alias("event_id"), event_id.isNull().alias("no_id"),
                         epoch_second(times).alias("sec"), times.alias("_ets"))


def flag_rate_stream(events: DataFrame, key, ts: str, limit: int, window_seconds: int,
                     watermark: str = "1 hour") -> DataFrame:
    """T3 over a streaming frame with ``event_id``: emits every event that isn't behind the
    watermark once with ``rate_key, sec, event_id, n_in_window, flagged`` (append mode).

    Events without a time come out with neither count nor flag; a null key is a key.
    The session's state store becomes RocksDB, which ``transformWithState`` needs.
    """
    if window_seconds < 1:
        raise ValueError("window_seconds must be positive")
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = _timed(events, key, ts)
    flagged = rows.where("sec IS NOT NULL").withWatermark("_ets", watermark).groupBy("rate_key").transformWithStateInPandas(
        RateFlags(limit, window_seconds), OUTPUT_SCHEMA, "append", "eventTime")
    untimed = rows.where("sec IS NULL").select(
        "rate_key", "sec", F.when(~F.col("no_id"), F.col("event_id")).alias("event_id"),
        F.lit(None).cast("long").alias("n_in_window"), F.lit(None).cast("boolean").alias("flagged"))
    return flagged.unionByName(untimed)


def late_events(batch: DataFrame, flagged: DataFrame) -> DataFrame:
    """Events of a micro-batch that got no flag: they came behind the watermark."""
    return batch.join(flagged.select("event_id").distinct(), "event_id", "left_anti")


def start_rate_flags(spark: SparkSession, src: str, schema, out: str, checkpoint: str, key: str, ts: str, limit: int,
                     window_seconds: int, watermark: str = "1 hour", fmt: str = "parquet",
                     available_now: bool = True, max_files: int = MAX_FILES):
    """Run T3: landed event files -> every event with its flag, appended under ``out``.

    A micro-batch reads up to ``max_files`` files.  Events behind the watermark have no
    flag; ``write_late_events`` lists them from the landed files and the output."""
    stream = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files).load(src)
    q = (flag_rate_stream(stream, key, ts, limit, window_seconds, watermark)
         .writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .outputMode("append"))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="30 seconds")
    return q.start()


def write_late_events(spark: SparkSession, src: str, schema, out: str, late: str, fmt: str = "parquet") -> DataFrame:
    """Write the landed events that the stream left without a flag under ``late`` and return them."""
    landed = spark.read.schema(schema).format(fmt).load(src)
    rows = late_events(landed, spark.read.schema(OUTPUT_SCHEMA).parquet(out))
    rows.write.mode("overwrite").parquet(late)
    return spark.read.schema(rows.schema).parquet(late)
