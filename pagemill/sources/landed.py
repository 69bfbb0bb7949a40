"""Scans over landed exports.

The source tool pulled pages over REST, 100 at a time; here the export is
already landed as files and "pages of results" are simply more files, so a
scan is ``spark.read`` with an explicit schema plus a projection.
"""

from __future__ import annotations

import functools
import itertools
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import schemas
from pagemill.functions.text import py_strip

PAGE_COLUMNS = ["id", "title", "content", "url", "version", "last_modified"]


def as_records(lines: DataFrame) -> DataFrame:
    """(raw, source_file, record): landed JSON lines as they came, and as VARIANT.

    ``lines`` has ``value`` and maybe ``source_file``; blank lines are no records.  The
    VARIANT holds every field of a record, also those that no schema names; it is null
    for a line that is not JSON.
    """
    file = F.col("source_file") if "source_file" in lines.columns else F.lit(None).cast("string")
    kept = lines.select(F.col("value").alias("raw"), file.alias("source_file")).filter(F.trim(F.col("raw")) != "")
    return kept.withColumn("record", F.try_parse_json("raw"))


def read_records(spark: SparkSession, path: str, stream: bool = False, max_files: int | None = None) -> DataFrame:
    """``as_records`` of the JSON lines under ``path``, with the file of each; batch or stream."""
    reader = spark.readStream if stream else spark.read
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return as_records(reader.format("text").load(path).select("value", F.col("_metadata.file_path").alias("source_file")))


def typed(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Records with the columns of ``schema`` beside them, and ``problem``.

    A missing field is null, and so is one of another type than the schema says (at any
    depth); ``problem`` tells such a record (``type``) and a line that is not JSON
    (``json``) from sound ones (null).
    """
    cols = [F.try_variant_get("record", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in schema.fields]
    wrong = F.lit(False)
    for path, kind in _leaves(schema):
        there = F.try_variant_get("record", path, "variant")
        wrong = wrong | (there.isNotNull() & ~F.is_variant_null(there) & F.try_variant_get("record", path, kind).isNull())
    problem = F.when(F.col("record").isNull(), "json").when(wrong, "type")
    return records.select(*cols, problem.alias("problem"), *records.columns)


def _leaves(schema: T.StructType, path: str = "$") -> list[tuple[str, str]]:
    """Paths and types of the fields that are no structs themselves."""
    out = []
    for f in schema.fields:
        at = f"{path}.{f.name}"
        out += _leaves(f.dataType, at) if isinstance(f.dataType, T.StructType) else [(at, f.dataType.simpleString())]
    return out


def read_raw_pages(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Landed raw API pages (``RAW_PAGE``) from JSON lines or Parquet; JSON lines bring the line
    itself, its file and what is wrong with it (see ``typed``)."""
    if fmt == "json":
        return typed(read_records(spark, path), schemas.RAW_PAGE)
    return spark.read.schema(schemas.RAW_PAGE).format(fmt).load(path)


def flatten_pages(raw: DataFrame, base_url: str, url_style: str = "space", keep=()) -> DataFrame:
    """A1 / A2 projection of raw API pages to ``PAGE`` (+ ``space_key`` and the columns ``keep``).

    ``url_style='space'`` builds ``{base}/wiki/spaces/{space}/pages/{id}`` (the
    space scan); ``'page'`` builds ``{base}/wiki/pages/{id}`` (single lookup).
    """
    if url_style == "space":
        url = F.concat(F.lit(base_url + "/wiki/spaces/"), F.col("space_key"), F.lit("/pages/"), F.col("id"))
    else:
        url = F.concat(F.lit(base_url + "/wiki/pages/"), F.col("id"))
    return raw.select(
        F.col("id"),
        F.col("title"),
        F.col("body.storage.value").alias("content"),
        url.alias("url"),
        F.col("version.number").cast("string").alias("version"),
        F.col("version.when").alias("last_modified"),
        F.col("space_key"), *keep,
    )


REQUIRED_RAW_FIELDS = (("id", "id"), ("title", "title"), ("value", "body.storage.value"),
                       ("number", "version.number"), ("when", "version.when"))


# The error types of records that can't be read.
NOT_JSON, WRONG_TYPE, MISSING_FIELD = "JSONDecodeError", "ValueError", "KeyError"


def split_raw_pages(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A1 / A2 guard: raw pages that can't be read or miss a required field (the source tool
    raises ``KeyError``) go to a dead-letter frame instead of failing the scan.

    Returns ``(ok, bad)``; ``bad`` has ``id, error_type, message``, the message naming the
    first missing field, and for records that came as lines (``read_raw_pages``) the line
    ``raw`` and its ``source_file``, so that it can be repaired and landed again.  A
    missing key and a null value are the same here (D5).
    """
    first_missing = None
    for key, path in REQUIRED_RAW_FIELDS:
        cond = F.col(path).isNull()
        first_missing = F.when(cond, F.lit(key)) if first_missing is None else first_missing.when(cond, F.lit(key))
    kind, message = F.lit(MISSING_FIELD), F.concat(F.lit("'"), F.col("_missing"), F.lit("'"))
    lines = [c for c in ("raw", "source_file") if c in raw.columns]
    if "problem" in raw.columns:
        kind = F.when(F.col("problem") == "json", NOT_JSON).when(F.col("problem") == "type", WRONG_TYPE).otherwise(kind)
        message = (F.when(F.col("problem") == "json", "not a JSON record")
                   .when(F.col("problem") == "type", "a field has another type than expected").otherwise(message))
    tagged = raw.withColumn("_missing", first_missing)
    ok = tagged.filter(F.col("_missing").isNull()).drop("_missing", "problem", "raw", "source_file", "record")
    bad = tagged.filter(F.col("_missing").isNotNull()).select("id", kind.alias("error_type"), message.alias("message"), *lines)
    return ok, bad


def space_pages(raw: DataFrame, space_key: str | None, base_url: str) -> DataFrame:
    """A1: every page of a space (all spaces when ``space_key`` is None).
    Bag semantics: no dedup, no sort."""
    if space_key is not None:
        raw = raw.filter(F.col("space_key") == space_key)
    return flatten_pages(raw, base_url, "space")


def single_page(raw: DataFrame, page_id: str, base_url: str) -> DataFrame:
    """A2: one page by id; the filter reaches the scan."""
    return flatten_pages(raw.filter(F.col("id") == page_id), base_url, "page")


def attachments(raw_atts: DataFrame, base_url: str, keep=()) -> DataFrame:
    """A3: attachment rows (``ATTACHMENT_RAW`` and the columns ``keep``).

    Accepts either the API shape (one row per page with a ``results`` array) or
    one row per attachment with an ``att`` struct and ``pos``.
    """
    if "results" in raw_atts.columns:
        rows = raw_atts.select("page_id", *keep, F.posexplode(F.coalesce("results", F.array())).alias("pos", "att"))
    else:
        rows = raw_atts.select("page_id", *keep, "pos", "att")
    return rows.select(
        F.col("page_id").cast("string").alias("page_id"),
        F.col("pos").cast("int").alias("pos"),
        F.col("att.id").alias("id"),
        F.col("att.title").alias("title"),
        F.col("att.title").alias("filename"),
        F.coalesce(F.col("att.metadata.mediaType"), F.lit("")).alias("mediaType"),
        F.coalesce(F.col("att.extensions.fileSize"), F.lit(0)).cast("long").alias("size"),
        F.concat(F.lit(base_url + "/wiki/download/attachments/"), F.col("page_id").cast("string"),
                 F.lit("/"), F.col("att.title")).alias("url"), *keep,
    )


def comments(raw_comments: DataFrame, keep=()) -> DataFrame:
    """A4: comment rows (``COMMENT_RAW`` and the columns ``keep``); API ``results`` arrays or one
    row per comment with a ``cmt`` struct and ``pos``."""
    if "results" in raw_comments.columns:
        rows = raw_comments.select("page_id", *keep, F.posexplode(F.coalesce("results", F.array())).alias("pos", "cmt"))
    else:
        rows = raw_comments.select("page_id", *keep, "pos", "cmt")
    return rows.select(
        F.col("page_id").cast("string").alias("page_id"),
        F.col("pos").cast("int").alias("pos"),
        F.col("cmt.id").alias("id"),
        F.col("cmt.author.displayName").alias("author"),
        F.col("cmt.created").alias("created"),
        F.col("cmt.body.storage.value").alias("content"), *keep,
    )


def worklist_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """A5 + F1: strip each line (Python whitespace) and drop blank ones."""
    item = py_strip(F.col(col))
    return lines.select(item.alias("item")).filter(F.col("item") != "")


def read_worklist(spark: SparkSession, path: str) -> DataFrame:
    """A5: a text work list, one prefixed id per line."""
    return worklist_lines(spark.read.text(path))


def to_arrow_uri(path: str) -> str:
    if path.startswith("file:") and not path.startswith("file://"):
        return "file://" + path[len("file:"):]
    if path.startswith("/"):
        return "file://" + path
    return path.replace("s3a://", "s3://", 1)


def _from_arrow_path(uri_prefix: str, inner: str) -> str:
    return ("file:" + inner) if uri_prefix.startswith("file:") else uri_prefix.split("://", 1)[0] + "://" + inner


#: Entries of a folder that a task holds at once.
LISTING_ROWS = 10_000


def _entries(folder: str):
    """(path, name, length, is_dir) of what stands right in a folder, one after the other.

    A local folder is read as a stream; other file systems answer with the folder's listing.
    """
    from pyarrow import fs as pafs

    uri = to_arrow_uri(folder)
    filesystem, inner = pafs.FileSystem.from_uri(uri)
    if isinstance(filesystem, pafs.LocalFileSystem):
        with os.scandir(inner) as found:
            for e in found:
                if e.is_dir() or e.is_file():
                    yield _from_arrow_path(uri, e.path), e.name, 0 if e.is_dir() else e.stat().st_size, e.is_dir()
        return
    for info in filesystem.get_file_info(pafs.FileSelector(inner, recursive=False)):
        if info.type in (pafs.FileType.File, pafs.FileType.Directory):
            is_dir = info.type == pafs.FileType.Directory
            yield _from_arrow_path(uri, info.path), info.base_name, 0 if is_dir else int(info.size or 0), is_dir


def _list_children(batches):
    """mapInPandas body: list each directory one level deep (all names), ``LISTING_ROWS`` at a time."""
    for pdf in batches:
        entries = itertools.chain.from_iterable(map(_entries, pdf["dir"]))
        for rows in itertools.batched(entries, LISTING_ROWS):
            yield pd.DataFrame(rows, columns=["path", "name", "length", "is_dir"])


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Every regular file under ``root``, dot- and underscore-files included.

    Spark's file sources hide names starting with ``_`` or ``.``, so the tree is
    walked explicitly, level by level until no folder is left.  The folders of a
    level are dealt out over the tasks by path and listed there, and each level is
    checkpointed to the shared checkpoint folder, so no file entry passes through
    the driver and the lineage never grows with the depth of the tree.  A missing
    root gives an empty frame; a scheme that pyarrow can't open is an error.
    Returns ``FILE_ENTRY`` rows.
    """
    from pyarrow import fs as pafs

    from pagemill.session import checkpoint_dir, deal_by
    filesystem, inner = pafs.FileSystem.from_uri(to_arrow_uri(root))
    if filesystem.get_file_info(inner).type != pafs.FileType.Directory:
        return spark.createDataFrame([], schemas.FILE_ENTRY)
    checkpoint_dir(spark)
    frontier = spark.createDataFrame([(root,)], "dir string")
    levels = []
    while True:
        listed = deal_by(frontier, "dir").mapInPandas(_list_children, "path string, name string, length long, is_dir boolean")
        listed = listed.checkpoint(eager=True)
        levels.append(listed.filter(~F.col("is_dir")).select("path", "name", "length"))
        frontier = listed.filter("is_dir").select(F.col("path").alias("dir"))
        if frontier.isEmpty():
            break
    return functools.reduce(DataFrame.unionByName, levels)
