"""Sinks K1-K11: CSV, JSON lines, single JSON documents, summaries, batch
results.  All are DataFrame writers; nothing is gathered on the driver except
one-row summaries."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.sources.named_files import write_files

FORMATS = ("raw", "processed", "all")

# Spark's CSV writer trims values unless told not to; HTML must survive as is.
CSV_OPTIONS = {"header": "true", "escape": '"', "quote": '"',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
CSV_READ_OPTIONS = {**CSV_OPTIONS, "multiLine": "true"}


def _flat_for_csv(df: DataFrame) -> DataFrame:
    """Nested columns become JSON text (the CSV writer takes scalars only)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1 / K2: header row, doubled-quote escaping; HTML with quotes and
    newlines reads back with ``read_csv`` (multi-line)."""
    _flat_for_csv(df).write.mode(mode).options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).options(**CSV_READ_OPTIONS).csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", partition_by: str | None = None) -> None:
    """One JSON object per line; null fields are kept."""
    w = df.write.mode(mode).option("ignoreNullFields", "false")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.json(path)


def json_document(df: DataFrame) -> Column:
    """All columns of a row as one indented JSON document; null fields are kept."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false", "pretty": "true"})


def write_single_json(df: DataFrame, path: str) -> None:
    """K5 / K6 / K7: a page, issue or summary as the indented JSON file ``path``.

    For a lookup result: each row writes the file, from the task that holds it, so the
    scan and the parse before it keep their tasks.  Without a row there is no file.
    """
    folder, _, name = path.rpartition("/")
    write_files(df.select(F.lit(name).alias("name"), json_document(df).alias("content")), folder or ".")


def write_json_documents(df: DataFrame, path: str, name: Column, mode: str = "overwrite") -> None:
    """One indented JSON file per row, named by ``name``, in a folder of their own."""
    write_files(df.select(name.alias("name"), json_document(df).alias("content")), path, mode)


def summary_row(spark: SparkSession, values: dict) -> DataFrame:
    """A one-row DataFrame of a summary dict (values JSON-encoded when nested)."""
    row = {k: (json.dumps(v) if isinstance(v, (dict, list, tuple)) else v) for k, v in values.items()}
    return spark.createDataFrame([row])


def write_summary(spark: SparkSession, values: dict, path: str) -> None:
    """K7 / K8: a small summary document (one row)."""
    write_single_json(summary_row(spark, values), path)


def space_summary(raw_pages: DataFrame, space_key: str, output_format: str) -> DataFrame:
    """K7: ``space_key, total_pages, extraction_time, output_formats``;
    ``total_pages`` counts raw pages in every format mode."""
    return raw_pages.agg(F.count(F.lit(1)).alias("total_pages")).select(
        F.lit(space_key).alias("space_key"), "total_pages",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("extraction_time"),
        F.lit(output_format).alias("output_formats"))


def sinks_for(output_format: str) -> tuple[bool, bool]:
    """(write raw, write processed).  Any other value writes only the
    summary, as the source tool does."""
    return output_format in ("raw", "all"), output_format in ("processed", "all")


def sprint_file_name(project_key: str, sprint_name: str) -> str:
    """``sprint_{project}_{name with spaces as _}``."""
    return f"sprint_{project_key}_{sprint_name.replace(' ', '_')}"


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, mode: str = "overwrite") -> None:
    """Save ``df`` as a table bucketed and sorted by ``key``.

    Landed pages saved this way (bucketed by page id) let every later join with
    per-page child summaries shuffle only the small child side: the page
    bodies are already partitioned by id and never move.  Join before the
    ``parse_html`` step - a Python evaluation does not carry the bucketed
    partitioning forward.
    """
    (df.write.mode(mode).format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table))


def page_file(key: str = "id", suffix: str = ".html") -> Column:
    """File name of a page: ``page_{id}.html``; what can't stand in a name becomes ``_``."""
    return F.concat(F.lit("page_"), F.regexp_replace(F.coalesce(F.col(key).cast("string"), F.lit("")), r"[^\w.-]", "_"), F.lit(suffix))


def write_rendered(df: DataFrame, path: str, fmt: str = "parquet", key: str = "id",
                   mode: str = "overwrite") -> None:
    """K12 sink: rendered pages (``key, html``) as one HTML file per page (``html``), as
    Parquet, or as text with one JSON-escaped document per line (the HTML itself spans lines)."""
    out = df.select(key, "html")
    if fmt == "html":
        write_files(out.select(page_file(key).alias("name"), F.col("html").alias("content")), path, mode)
    elif fmt == "parquet":
        out.write.mode(mode).parquet(path)
    else:
        out.select(F.to_json(F.struct(key, "html")).alias("value")).write.mode(mode).text(path)
