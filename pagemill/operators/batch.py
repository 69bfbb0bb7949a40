"""Batch work lists (F2, J-4, G7, U2) and output-tree inventories.

A work list is routed by prefix into one ``kind`` column; existence checks
are one left join against the distinct known (kind, ref) keys, so duplicated
items never multiply and unknown items never touch the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.session import deal_by

# Case-sensitive item prefixes and the kind each one routes to.
PREFIXES = (("SPACE_", "space"), ("CONF_", "page"), ("JIRA_", "issue"), ("PROJECT_", "project"))
LOOKUP_KINDS = ("page", "issue")          # must exist to succeed
COLLECTION_KINDS = ("space", "project")   # succeed even when empty


def route_items(items: DataFrame, col: str = "item") -> DataFrame:
    """add ``kind`` (space / page / issue / project / unknown) and ``ref``
    (the item without its prefix)."""
    c = F.col(col)
    kind = None
    ref = None
    for prefix, k in PREFIXES:
        cond = c.startswith(prefix)
        rest = F.substring(c, len(prefix) + 1, 1 << 30)
        kind = F.when(cond, F.lit(k)) if kind is None else kind.when(cond, F.lit(k))
        ref = F.when(cond, rest) if ref is None else ref.when(cond, rest)
    return items.withColumn("kind", kind.otherwise(F.lit("unknown"))).withColumn("ref", ref)


def known_keys(pages: DataFrame | None = None, issues: DataFrame | None = None,
               page_key: str = "id", issue_key: str = "key") -> DataFrame:
    """Distinct (kind, ref) of the items that exist."""
    parts = []
    if pages is not None:
        parts.append(pages.select(F.lit("page").alias("kind"), F.col(page_key).cast("string").alias("ref")))
    if issues is not None:
        parts.append(issues.select(F.lit("issue").alias("kind"), F.col(issue_key).cast("string").alias("ref")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def batch_outcome(routed: DataFrame, known: DataFrame, col: str = "item") -> DataFrame:
    """J-4 / U2: ``status`` successful / failed / skipped and ``error`` per item.

    Lookup items (page, issue) succeed when their key exists; space and project
    items succeed even with no rows; unknown items are skipped (they appear in
    neither the successful nor the failed list).

    One left join on (kind, ref): items that need no lookup have a null key there and
    find nothing.  Whether a side is broadcast is up to the optimizer's measurements.
    """
    lookup = F.col("kind").isin(*LOOKUP_KINDS)
    keyed = routed.withColumn("_kind", F.when(lookup, F.col("kind")))
    hit = known.select(F.col("kind").alias("_kind"), F.col("ref").alias("_ref"), F.lit(True).alias("_hit"))
    checked = keyed.join(hit, (keyed["_kind"] == hit["_kind"]) & (keyed["ref"] == hit["_ref"]), "left").drop("_kind", "_ref")
    status = (F.when(lookup & F.col("_hit").isNull(), F.lit("failed"))
              .when(F.col("kind") == "unknown", F.lit("skipped")).otherwise(F.lit("successful")))
    return checked.withColumn("status", status).drop("_hit").withColumn(
        "error", F.when(F.col("status") == "failed", F.concat(F.lit("not found: "), F.col(col))))


def batch_counts(outcome: DataFrame) -> DataFrame:
    """Number of items per status."""
    return outcome.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# -- output-tree inventory (G4) ----------------------------------------------
def with_file_flags(entries: DataFrame) -> DataFrame:
    """S6 + F5: lower-cased extension and the ``_error`` failure flag."""
    return entries.withColumn("ext", X.path_suffix(F.col("name"))) \
                  .withColumn("failed", F.col("name").contains("_error"))


def inventory(entries: DataFrame) -> DataFrame:
    """G4 one-row totals: files, successes, failures, bytes, readable bytes.

    Bytes are added as decimals.  ``total_size`` is a long, null if the sum is past its
    range; ``total_size_readable`` is of the exact sum."""
    e = with_file_flags(entries)
    g = e.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(~F.col("failed")).alias("successful_files"),
        F.count_if(F.col("failed")).alias("failed_files"),
        F.coalesce(F.sum(F.col("length").cast("decimal(19,0)")), F.lit(0)).alias("total_size"),
    )
    return g.withColumn("total_size_readable", X.readable_size(F.col("total_size"))) \
            .withColumn("total_size", F.col("total_size").try_cast("long"))


def file_types(entries: DataFrame) -> DataFrame:
    """G4 per extension (with the dot, ``""`` when none): ``ext, n``."""
    return with_file_flags(entries).groupBy("ext").agg(F.count(F.lit(1)).alias("n"))


def error_files(entries: DataFrame) -> DataFrame:
    """Entries of failed outputs (``_error`` in the name)."""
    return with_file_flags(entries).filter("failed").select("path", "name", "length")


def _read_text_files(batches):
    """mapInPandas body: read each listed file as UTF-8 text, one row at a time
    (unreadable files are skipped, as the source tool only warns about them)."""
    import pandas as pd
    import pyarrow as pa
    from pyarrow import fs as pafs

    for pdf in batches:
        for path in pdf["path"]:
            uri = path
            if uri.startswith("file:") and not uri.startswith("file://"):
                uri = "file://" + uri[len("file:"):]
            uri = uri.replace("s3a://", "s3://", 1)
            try:
                filesystem, inner = pafs.FileSystem.from_uri(uri)
                with filesystem.open_input_stream(inner) as f:
                    text = f.read().decode("utf-8")
            except (OSError, UnicodeDecodeError, pa.ArrowInvalid):
                continue
            yield pd.DataFrame({"file": [path], "error": [text]})


def error_contents(spark: SparkSession, entries: DataFrame) -> DataFrame:
    """G4 ``processing_errors``: ``file, error`` text of each ``_error`` file.

    Only the error files are read, each inside a task (Spark's file sources
    would skip names starting with ``_`` or ``.``), so bytes of the other
    outputs are never loaded and nothing passes through the driver.
    """
    paths = deal_by(error_files(entries).select("path"), "path")
    return paths.mapInPandas(_read_text_files, "file string, error string")
