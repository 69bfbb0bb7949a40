"""Page-level operators: metadata, children, process_pages, dead letters.

``process_pages`` is one projection: a single ``parse_html`` call (Arrow UDF)
plus Catalyst expressions.  Child tables (comments, attachments) stay in long
form and are aggregated per page *before* any join, so a join emits one row
per page and no two child tables are ever joined flat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import schemas
from pagemill.functions.udf import ALL_PARTS, clean_text, parse_html, table_grids

# The source label every processed page carries, and the
# metadata fields in output order.
SOURCE = "confluence"
META_FIELDS = ("id", "title", "url", "version", "last_modified")


def metadata(df: DataFrame, source: str = SOURCE):
    """Metadata struct; missing fields and null values become ``""``."""
    return F.struct(
        *[(F.coalesce(F.col(f).cast("string"), F.lit("")) if f in df.columns else F.lit("")).alias(f)
          for f in META_FIELDS],
        F.lit(source).alias("source"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("processed_at"),
    )


def process_attachments(att_rows: DataFrame, keep=()) -> DataFrame:
    """Keep ``id, filename, size, media_type`` (title and url dropped), and the columns ``keep``."""
    return att_rows.select(
        "page_id", "pos", *keep,
        F.coalesce("id", F.lit("")).alias("id"),
        F.coalesce("filename", F.lit("")).alias("filename"),
        F.coalesce("size", F.lit(0)).cast("long").alias("size"),
        F.coalesce("mediaType", F.lit("")).alias("media_type"),
    )


def clean_comments(comment_rows: DataFrame, keep=()) -> DataFrame:
    """Comment rows with cleaned content; other fields default to ``""``.
    Each comment is its own row, so no large nested array crosses into Python."""
    return comment_rows.select(
        "page_id", "pos", *keep,
        F.coalesce("id", F.lit("")).alias("id"),
        F.coalesce("author", F.lit("")).alias("author"),
        F.coalesce("created", F.lit("")).alias("created"),
        clean_text(F.coalesce("content", F.lit(""))).alias("content"),
    )


def child_summary(pages: DataFrame, attachments: DataFrame | None = None,
                  comments: DataFrame | None = None, key: str = "id") -> DataFrame:
    """J-1 (aggregate form): per page the number of children (and attachment
    bytes), joined left to the pages.  Children are reduced per page with
    fixed-width hash aggregation (map-side partials) first, so the join sees
    one row per page."""
    out = pages
    if attachments is not None:
        a = attachments.groupBy("page_id").agg(
            F.count(F.lit(1)).alias("n_attachments"),
            F.sum("size").alias("attachment_bytes"),
        )
        out = out.join(a, out[key] == a.page_id, "left").drop(a.page_id)
        out = out.withColumn("n_attachments", F.coalesce("n_attachments", F.lit(0)))
        out = out.withColumn("attachment_bytes", F.coalesce("attachment_bytes", F.lit(0)))
    if comments is not None:
        c = comments.groupBy("page_id").agg(
            F.count(F.lit(1)).alias("n_comments"),
        )
        out = out.join(c, out[key] == c.page_id, "left").drop(c.page_id)
        out = out.withColumn("n_comments", F.coalesce("n_comments", F.lit(0)))
    return out


def nest(out: DataFrame, child: DataFrame, name: str, key: str) -> DataFrame:
    """``out`` with the child rows of each ``key`` as the array ``name``, ordered by ``pos``."""
    fields = [c for c in child.columns if c not in ("page_id", "pos")]
    elem = T.StructType([child.schema[c] for c in fields])
    g = child.groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", *fields))).alias("_kids"))
    out = out.join(g, out[key] == g.page_id, "left").drop(g.page_id)
    nested = F.transform("_kids", lambda x: F.struct(*[x[c].alias(c) for c in fields]))
    return out.withColumn(name, F.coalesce(nested, F.array().cast(T.ArrayType(elem)))).drop("_kids")


def nest_children(pages: DataFrame, attachments: DataFrame | None = None,
                  comments: DataFrame | None = None, key: str = "id") -> DataFrame:
    """J-1 (nested form, the processed-page layout): ``attachments`` and
    ``comments`` arrays of the child rows (all columns but ``page_id`` /
    ``pos``) ordered by ``pos``; ``[]`` for pages without children.

    Each child table is grouped by page and then left-joined; the arrays are
    the output format itself, so their size is the page's own child count.
    Use ``child_summary`` or the long-form tables when only figures are needed.
    """
    out = pages
    if attachments is not None:
        out = nest(out, attachments, "attachments", key)
    if comments is not None:
        out = nest(out, comments, "comments", key)
    return out


def process_pages(pages: DataFrame, attachments: DataFrame | None = None, comments: DataFrame | None = None,
                  parts=ALL_PARTS, source: str = SOURCE, keep=("id",)) -> DataFrame:
    """The processed page (``PROCESSED`` layout) for every input page.

    One HTML parse per page produces text, tables and code together; a part
    that fails gets its default and an entry in ``errors`` (the page survives).
    ``attachments`` / ``comments`` are long-form child rows (already passed
    through P8 / P7); when given they are nested in by page id.
    """
    parsed = pages.select(*keep, *[c for c in pages.columns if c not in keep],
                          parse_html(F.col("content"), parts).alias("_p"))
    cols = [*keep,
            (F.col("_p.content") if "text" in parts else F.lit("")).alias("content"),
            metadata(parsed, source).alias("metadata"),
            (table_grids(F.col("_p.tables")) if "tables" in parts
             else F.array().cast(T.ArrayType(schemas.TABLE))).alias("tables"),
            (F.col("_p.code_blocks") if "code" in parts
             else F.array().cast(T.ArrayType(schemas.CODE_BLOCK))).alias("code_blocks"),
            F.col("_p.errors").alias("errors")]
    out = parsed.select(*cols)
    if attachments is not None or comments is not None:
        out = nest_children(out, attachments, comments, key=keep[0])
    empty_att = F.array().cast("array<struct<id:string,filename:string,size:bigint,media_type:string>>")
    empty_cmt = F.array().cast("array<struct<id:string,author:string,created:string,content:string>>")
    if "attachments" not in out.columns:
        out = out.withColumn("attachments", empty_att)
    if "comments" not in out.columns:
        out = out.withColumn("comments", empty_cmt)
    return out.select(*keep, "content", "metadata", "tables", "code_blocks", "attachments", "comments", "errors")


def page_figures(pages: DataFrame, keep=("id",), source: str = SOURCE) -> DataFrame:
    """P9 for reports: ``keep``, ``content``, ``metadata``, ``n_tables`` and ``n_code_blocks`` of every page,
    from the same parse, without grids or blocks that only get counted."""
    parsed = pages.select(*keep, *[c for c in pages.columns if c not in keep],
                          parse_html(F.col("content"), ("text", "table_count", "code_count")).alias("_p"))
    return parsed.select(*keep, F.col("_p.content").alias("content"), metadata(parsed, source).alias("metadata"), "_p.n_tables", "_p.n_code_blocks")


# P10 ----------------------------------------------------------------------
# Error-record texts and the default status code.
UNEXPECTED_MESSAGE = "An unexpected error occurred"
UNEXPECTED_TYPE = "UnexpectedError"
PROCESSING_ERROR = "ProcessingError"
FAILED_PART_PREFIX = "Failed to process "
DEFAULT_STATUS = 500


def error_record(message, error_type, status_code=None, details=None):
    """P10 record: ``struct(message, error_type, status_code, details)``;
    ``status_code`` defaults to 500."""
    return F.struct(
        F.lit(message) if isinstance(message, str) else message,
        F.lit(error_type) if isinstance(error_type, str) else error_type,
        F.coalesce(F.lit(None).cast("int") if status_code is None else F.lit(status_code).cast("int"),
                   F.lit(DEFAULT_STATUS)).alias("status_code"),
        (details if details is not None else F.create_map().cast("map<string,string>")).alias("details"),
    )


def filter_after_parse(df: DataFrame, cond) -> DataFrame:
    """Filter on values the Python parse produced, without letting Catalyst
    move the predicate below the parse's projection (it would then run the
    UDF a second time, in the filter).  The condition becomes a generated
    column, and no predicate can be pushed beneath its ``Generate``."""
    return (df.select("*", F.explode_outer(F.array(cond)).alias("_keep"))
            .filter(F.col("_keep")).drop("_keep"))


def split_errors(processed: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """P10: split processed pages into (ok, dead letters).

    A dead letter is one row per failed part of a page:
    ``key, part, message, error_type, status_code, details``.  A page with a
    failed part still appears in ``ok`` with that part's default, as in the
    source tool; the dead-letter table records what went wrong.
    """
    failed = F.size(F.coalesce("errors", F.create_map())) > 0
    ok = filter_after_parse(processed, ~failed)
    dead = (processed.select(key, F.explode_outer("errors").alias("part", "error"))
            .filter(F.col("part").isNotNull())
            .select(key, "part",
                    F.concat(F.lit(FAILED_PART_PREFIX), F.col("part"), F.lit(": "), F.col("error")).alias("message"),
                    F.lit(PROCESSING_ERROR).alias("error_type"),
                    F.lit(DEFAULT_STATUS).alias("status_code"),
                    F.create_map(F.lit("page_id"), F.col(key).cast("string"), F.lit("part"), F.col("part"))
                    .alias("details")))
    return ok, dead
