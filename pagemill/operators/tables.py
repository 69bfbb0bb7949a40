"""Table operators over processed pages: long-form cells (P2), shapes, and
typed columns (P4).  Everything is Catalyst: higher-order functions on the
nested grid decide a column's type inside the page row, so no shuffle is
needed to type a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Fixed value: how a number may be written, besides commas between its digits.
NUMBER_PATTERN = r"^[\x20\t]*[-+]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?|[iI]nf(inity)?)[\x20\t]*$"


def _numeric(v):
    """A cell as a number, or null: digits with optional ``,`` thousands marks, point and
    exponent, or infinity.  Letters that a cast would accept behind digits (``1d``, ``3f``)
    are no number."""
    plain = F.replace(v, F.lit(","), F.lit(""))
    value = F.when(F.lower(plain).contains("inf"), F.concat(F.regexp_extract(plain, "^[\\x20\t]*([-+]?)", 1), F.lit("Infinity"))).otherwise(plain)
    return F.when(plain.rlike(NUMBER_PATTERN), value.try_cast("double"))


def _tables(processed: DataFrame, key: str) -> DataFrame:
    """One row per table.  ``posexplode_outer`` + a filter on the generated
    column: a plain ``posexplode`` would make Catalyst infer a filter on the
    parse output and push it below the parse, running the Python UDF twice."""
    return (processed.select(F.col(key).alias("page_id"), F.posexplode_outer("tables").alias("table_idx", "t"))
            .filter(F.col("t").isNotNull()))


def with_column_types(processed: DataFrame) -> DataFrame:
    """Add ``col_types`` (array of ``number`` / ``string``) to each table.

    A column is ``number`` when it has at least one value and every non-null
    value parses as a number after removing ``,``.
    """
    def typed(t):
        cols = F.coalesce(t["shape"]["cols"], F.lit(0))
        idx = F.sequence(F.lit(0), cols - 1)
        kind = F.transform(
            F.when(cols > 0, idx).otherwise(F.array().cast("array<int>")),
            lambda j: F.when(
                F.exists(t["data"], lambda r: r[j].isNotNull())
                & F.forall(t["data"], lambda r: r[j].isNull() | _numeric(r[j]).isNotNull()),
                F.lit("number")).otherwise(F.lit("string")))
        return t.withField("col_types", kind)

    return processed.withColumn("tables", F.transform("tables", typed))


def table_cells(processed: DataFrame, key: str = "id", typed: bool = True) -> DataFrame:
    """One row per cell: ``page_id, table_idx, row_idx, col_idx, header,
    value`` (+ ``value_type``, ``value_double`` when ``typed``).

    Each data row is zipped with the header (and column-type) arrays before it
    is exploded, so a cell row carries only its own values - never the whole
    table - and the work stays linear in the number of cells.
    """
    src = with_column_types(processed) if typed else processed
    t = _tables(src, key)
    meta = [F.col("t.headers").alias("h")] + ([F.col("t.col_types").alias("k")] if typed else [])
    r = t.select("page_id", "table_idx", *meta, F.posexplode("t.data").alias("row_idx", "row"))
    zipped = F.arrays_zip(*([F.col("h"), F.col("row")] + ([F.col("k")] if typed else [])))
    c = r.select("page_id", "table_idx", "row_idx", F.posexplode(zipped).alias("col_idx", "z"))
    cols = ["page_id", "table_idx", "row_idx", "col_idx",
            F.col("z.h").alias("header"), F.col("z.row").alias("value")]
    if typed:
        cols += [F.col("z.k").alias("value_type"),
                 F.when(F.col("z.k") == "number", _numeric(F.col("z.row"))).alias("value_double")]
    return c.select(*cols)


def table_shapes(processed: DataFrame, key: str = "id") -> DataFrame:
    """One row per extracted table: ``page_id, table_idx, n_rows, n_cols, headers``."""
    t = _tables(processed, key)
    return t.select(
        "page_id", "table_idx",
        F.col("t.shape.rows").alias("n_rows"),
        F.col("t.shape.cols").alias("n_cols"),
        F.array_join("t.headers", "|").alias("headers"),
    )


def column_types(processed: DataFrame, key: str = "id") -> DataFrame:
    """P4 per column: ``page_id, table_idx, col_idx, header, col_type``."""
    t = _tables(with_column_types(processed), key)
    c = t.select("page_id", "table_idx",
                 F.posexplode(F.arrays_zip(F.col("t.headers").alias("h"), F.col("t.col_types").alias("k")))
                 .alias("col_idx", "z"))
    return c.select("page_id", "table_idx", "col_idx", F.col("z.h").alias("header"), F.col("z.k").alias("col_type"))


def code_rows(processed: DataFrame, key: str = "id") -> DataFrame:
    """P5 long form: ``page_id, block_idx, language, content``."""
    return (processed.select(F.col(key).alias("page_id"), F.posexplode_outer("code_blocks").alias("block_idx", "b"))
            .filter(F.col("b").isNotNull())
            .select("page_id", "block_idx", F.col("b.language").alias("language"),
                    F.col("b.content").alias("content")))
