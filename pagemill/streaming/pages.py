"""Continuous page processing.

Files of raw pages land in a folder; the stream flattens and processes them
with the same stateless ``process_pages`` projection as the batch job and
appends processed JSON lines.  Exactly-once comes from the checkpoint.

Pages with children (J-1): comments and attachments land in folders of their own, before
or after their page.  A stream-stream outer join holds each side until the watermark
says that no partner can come any more, and an aggregate behind it nests the children;
a page comes out once, with all children that landed within ``wait`` of it.

Edited pages: a page lands again with a higher version.  ``start_versions`` keeps one
folder per micro-batch and a log of the batches that are whole; a batch that is run
again finds itself in the log and changes nothing.  ``current_pages`` reads the newest
version of each page, ``compact`` replaces the batches by that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pagemill import schemas
from pagemill.operators import pages as P
from pagemill.operators import quality as Q
from pagemill.sources import landed as A
from pagemill.sources import named_files as N


def page_stream(spark: SparkSession, src: str, fmt: str = "json", raw: bool = True,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming frame of pages landing under ``src`` (raw API records by default)."""
    if raw and fmt == "json":
        return A.typed(A.read_records(spark, src, stream=True, max_files=max_files_per_trigger), schemas.RAW_PAGE)
    r = spark.readStream.schema(schemas.RAW_PAGE if raw else schemas.PAGE).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(src)


def processed_stream(pages: DataFrame, base_url: str, raw: bool = True, parts=("text", "tables", "code")) -> DataFrame:
    """Flatten (when raw) and process each micro-batch; no state is kept.  Raw records
    without a required field are left to ``dead_letter_stream``."""
    flat = A.flatten_pages(A.split_raw_pages(pages)[0], base_url, "space") if raw else pages
    return P.process_pages(flat.select("id", "title", "content", "url", "version", "last_modified"), parts=parts)


def dead_letter_stream(raw: DataFrame) -> DataFrame:
    """P10: records of the stream that are no JSON, have a wrong type or miss a required field, as
    dead letters with the line and its file."""
    return A.split_raw_pages(raw)[1]


def start_dead_letters(spark: SparkSession, src: str, out: str, checkpoint: str, fmt: str = "json",
                       available_now: bool = True) -> StreamingQuery:
    """Run T1's dead letters: broken records under ``src`` -> JSON lines under ``out``."""
    q = (dead_letter_stream(page_stream(spark, src, fmt))
         .writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).outputMode("append"))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="30 seconds")
    return q.start()


def start_processing(spark: SparkSession, src: str, out: str, checkpoint: str, base_url: str,
                     fmt: str = "json", available_now: bool = True) -> StreamingQuery:
    """Run T1: ``src`` landed pages -> processed JSON lines under ``out``."""
    q = (processed_stream(page_stream(spark, src, fmt), base_url)
         .writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint)
         .option("ignoreNullFields", "false").outputMode("append"))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="30 seconds")
    return q.start()


# -- pages with children ---------------------------------------------------------
#: The column of a stream that says when its row landed.
LANDED = "landed_at"
CHILD = "struct<kind:string,pos:int,id:string,filename:string,size:bigint,media_type:string,author:string,created:string,content:string>"
CHILD_FIELDS = {"attachments": ("id", "filename", "size", "media_type"), "comments": ("id", "author", "created", "content")}


def landed_stream(spark: SparkSession, src: str, schema, fmt: str = "json", max_files: int | None = None) -> DataFrame:
    """A stream of landed records with the time their file came (``landed_at``)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(src).withColumn(LANDED, F.col("_metadata.file_modification_time"))


def _children(rows: DataFrame, kind: str) -> DataFrame:
    """Processed child rows as (page_id, landed_at, child) of one shape."""
    own = CHILD_FIELDS[kind]
    fields = [F.lit(kind).alias("kind"), F.col("pos")]
    fields += [(F.col(f) if f in own else F.lit(None)).alias(f) for f in ("id", "filename", "size", "media_type", "author", "created", "content")]
    return rows.select("page_id", LANDED, F.struct(*fields).cast(CHILD).alias("child"))


def pages_with_children(pages: DataFrame, attachments: DataFrame, comments: DataFrame, wait: str = "1 hour",
                        watermark: str = "10 minutes") -> DataFrame:
    """T1 x J-1: flat pages (``PAGE`` and ``landed_at``) with the arrays ``attachments`` and ``comments``.

    ``attachments`` and ``comments`` are raw child rows (A3 / A4 output and ``landed_at``).  A
    page waits ``wait`` for its children and takes those that landed up to ``wait`` before
    it; without any it comes with empty arrays.  A page that lands twice comes out twice.
    """
    kids = _children(P.process_attachments(attachments, keep=(LANDED,)), "attachments").unionByName(
        _children(P.clean_comments(comments, keep=(LANDED,)), "comments")).withWatermark(LANDED, watermark)
    page = pages.select("id", F.struct("title", "content", "url", "version", "last_modified").alias("page"), F.col(LANDED).alias("at"))
    page = page.withWatermark("at", watermark)
    near = F.expr(f"page_id = id AND {LANDED} >= at - INTERVAL {wait} AND {LANDED} <= at + INTERVAL {wait}")
    joined = page.join(kids, near, "leftOuter").select("at", "id", "page", "child")
    # The page's own columns make its group: a page that lands again in another version is another page.
    nested = joined.groupBy("at", "id", F.col("page.version").alias("version")).agg(F.first("page").alias("page"), F.collect_list("child").alias("kids"))

    def of(kind):
        mine = F.array_sort(F.transform(F.filter("kids", lambda c: c["kind"] == kind),
                                        lambda c: F.struct(c["pos"].alias("pos"), *[c[f].alias(f) for f in CHILD_FIELDS[kind]])))
        return F.transform(mine, lambda c: F.struct(*[c[f].alias(f) for f in CHILD_FIELDS[kind]]))
    return nested.select("id", "page.*", of("attachments").alias("attachments"), of("comments").alias("comments"))


def process_with_children(pages: DataFrame, parts=("text", "tables", "code")) -> DataFrame:
    """Processed pages (P9) of pages that carry their children as arrays."""
    named = pages.withColumnsRenamed({"attachments": "_atts", "comments": "_cmts"})
    out = P.process_pages(named, parts=parts, keep=("id", "_atts", "_cmts"))
    return out.select("id", "content", "metadata", "tables", "code_blocks", F.col("_atts").alias("attachments"), F.col("_cmts").alias("comments"), "errors")


def start_processing_with_children(spark: SparkSession, pages_src: str, attachments_src: str, comments_src: str, out: str, checkpoint: str,
                                   base_url: str, wait: str = "1 hour", watermark: str = "10 minutes", available_now: bool = True,
                                   max_files: int | None = None) -> StreamingQuery:
    """Run T1 x J-1: landed raw pages and children (API records, JSON lines) -> processed JSON lines under ``out``."""
    raw = landed_stream(spark, pages_src, schemas.RAW_PAGE, max_files=max_files)
    ok = A.split_raw_pages(raw)[0]
    pages = A.flatten_pages(ok, base_url, "space", keep=(LANDED,))
    atts = A.attachments(landed_stream(spark, attachments_src, schemas.RAW_ATTACHMENTS, max_files=max_files), base_url, keep=(LANDED,))
    cmts = A.comments(landed_stream(spark, comments_src, schemas.RAW_COMMENTS, max_files=max_files), keep=(LANDED,))
    q = (process_with_children(pages_with_children(pages, atts, cmts, wait, watermark))
         .writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint)
         .option("ignoreNullFields", "false").outputMode("append"))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="30 seconds")
    return q.start()


# -- edited pages ------------------------------------------------------------------
def _log(target: str) -> str:
    return f"{target.rstrip('/')}/log"


def _logged(spark: SparkSession, target: str) -> list[int]:
    """The whole batches of a target; the log has one small file for each."""
    return sorted(int(name.removeprefix("batch-")) for name in N.read_names(spark, _log(target)))


def write_versions(batch: DataFrame, batch_id: int, target: str) -> bool:
    """Keep one micro-batch of processed pages; False if it was kept before.

    The rows of an (id, version) that repeats within the batch are one.  The log entry is
    written after the data, so half a batch is never read and is replaced when it runs again.
    """
    spark = batch.sparkSession
    if batch_id in _logged(spark, target):
        return False
    rows = batch.withColumn("_version", F.col("metadata.version").try_cast("long")).dropDuplicates(["id", "_version"])
    rows.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{target}/batch-{batch_id}")
    entry = spark.createDataFrame([(f"batch-{batch_id}", "")], "name string, content string")
    N.write_files(entry, _log(target), "append")
    return True


def current_pages(spark: SparkSession, target: str) -> DataFrame:
    """The newest version of every page: by version number, then by batch; pages without a number are oldest.

    The newest key of each page is found on narrow rows; page contents are joined to it."""
    folders = [f"{target}/batch-{b}" for b in _logged(spark, target)]
    if not folders:
        return spark.createDataFrame([], T.StructType([T.StructField("id", T.StringType()), *schemas.PROCESSED.fields]))
    rows = spark.read.parquet(*folders)
    newest = rows.groupBy("id").agg(F.max(F.struct(F.coalesce("_version", F.lit(-1).cast("long")).alias("v"), "_batch")).alias("_newest"))
    key = F.struct(F.coalesce("_version", F.lit(-1).cast("long")).alias("v"), F.col("_batch"))
    newest = newest.withColumnRenamed("id", "_id")
    return rows.join(newest, rows["id"].eqNullSafe(newest["_id"]) & (key == F.col("_newest"))).drop("_id", "_newest", "_version", "_batch")


def start_versions(spark: SparkSession, src: str, target: str, checkpoint: str, base_url: str, watermark: str = "1 hour",
                   available_now: bool = True, max_files: int | None = None, state: str | None = None) -> StreamingQuery:
    """Run T1 for edited pages: raw pages (JSON lines) -> versions under ``target`` (see ``current_pages``).

    Records that land again with the id and version of one within the watermark are
    dropped by the stream.  With ``state`` each batch also leaves its corpus figures there (``quality.read_states``).
    """
    raw = landed_stream(spark, src, schemas.RAW_PAGE, max_files=max_files)
    pages = A.flatten_pages(A.split_raw_pages(raw)[0], base_url, "space", keep=(LANDED,))
    pages = pages.withWatermark(LANDED, watermark).dropDuplicatesWithinWatermark(["id", "version"])
    done = P.process_pages(pages.select("id", "title", "content", "url", "version", "last_modified"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        new = write_versions(batch, batch_id, target)
        if state and new:
            Q.write_state(Q.summary_state(batch.sparkSession.read.parquet(f"{target}/batch-{batch_id}")), state, batch_id)
    q = done.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="30 seconds")
    return q.start()
