"""``parse_html``: the one Python step, an Arrow-batched UDF.

One parse per page yields the cleaned text, the tables and the code blocks
together (a registry of parts, X1).  Catalyst cannot prune fields inside a
Python UDF's struct, so callers pass ``parts`` and only pay for what they use.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pagemill import schemas
from pagemill.functions import html as H

# registry: part name -> (output field, Spark type, default when not wanted)
PARTS = {
    "text": ("content", T.StringType()),
    "tables": ("tables", T.ArrayType(schemas.TABLE_RUNS)),
    "code": ("code_blocks", T.ArrayType(schemas.CODE_BLOCK)),
    # How many there are, for reports: no table or block leaves Python.
    "table_count": ("n_tables", T.IntegerType()),
    "code_count": ("n_code_blocks", T.IntegerType()),
}
COUNTED = {"table_count": "tables", "code_count": "code"}
ALL_PARTS = ("text", "tables", "code")
#: Rows and bytes of HTML that are held parsed at a time, whatever the size of an Arrow batch.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20


def _slices(col: pa.Array) -> Iterator[pa.Array]:
    """``col`` in pieces of at most SLICE_ROWS rows and, unless a single row has more, SLICE_BYTES."""
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(col).to_pylist()):
        if i > start and (i - start == SLICE_ROWS or size + (n or 0) > SLICE_BYTES):
            yield col.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    yield col.slice(start)


def _return_type(parts: tuple[str, ...]) -> T.StructType:
    fields = [T.StructField(PARTS[p][0], PARTS[p][1], True) for p in parts]
    fields.append(T.StructField("errors", T.MapType(T.StringType(), T.StringType()), True))
    return T.StructType(fields)


@lru_cache(maxsize=None)
def _udf(parts: tuple[str, ...]):
    rtype = _return_type(parts)
    atype = to_arrow_type(rtype)
    want = {p: p in parts or any(COUNTED.get(c) == p for c in parts) for p in ALL_PARTS}

    def parse(col: pa.Array) -> pa.Array:
        cols = {p: [] for p in parts}
        errors = []
        for doc in col.to_pylist():
            r = H.read_page(doc, want["text"], want["tables"], want["code"])
            for p in parts:
                cols[p].append(len(r[COUNTED[p]]) if p in COUNTED else r[p])
            errors.append(list(r["errors"].items()))
        arrays = [pa.array(cols[p], type=atype.field(PARTS[p][0]).type) for p in parts]
        arrays.append(pa.array(errors, type=atype.field("errors").type))
        return pa.StructArray.from_arrays(arrays, fields=list(atype))

    def parse_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            yield from map(parse, _slices(col))

    return F.arrow_udf(parse_batches, rtype)


# Cell strings read as missing values.
NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def table_grids(tables: Column) -> Column:
    """Parsed tables (``TABLE_RUNS``) as ``TABLE``: runs of columns and rows expanded, missing values null."""
    def row(cells: Column) -> Column:
        return F.flatten(F.transform(cells, lambda c: F.array_repeat(F.when(~c["text"].isin(*NA_STRINGS), c["text"]), c["n"])))

    def grid(t: Column) -> Column:
        data = F.flatten(F.transform(t["rows"], lambda r: F.array_repeat(row(r["cells"]), r["n"])))
        n = F.aggregate(t["rows"], F.lit(0), lambda acc, r: acc + r["n"])
        return F.struct(t["headers"].alias("headers"), data.alias("data"),
                        F.struct(n.alias("rows"), F.size(t["headers"]).alias("cols")).alias("shape"))

    return F.transform(tables, grid)


def parse_html(col, parts=ALL_PARTS) -> Column:
    """Struct column ``{content?, tables?, code_blocks?, errors}`` of one parse."""
    parts = tuple(p for p in PARTS if p in set(parts))
    c = F.col(col) if isinstance(col, str) else col
    return _udf(parts)(c)


def clean_text(col) -> Column:
    """P1 as a column: cleaned text of an HTML column."""
    return parse_html(col, ("text",))["content"]
