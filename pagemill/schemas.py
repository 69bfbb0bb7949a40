"""Explicit schemas of the page / issue data model (never inferred)."""

from pyspark.sql import types as T

S = T.StringType()
L = T.LongType()
I = T.IntegerType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Raw API page as landed from the wiki export (one JSON object per page).
RAW_PAGE = _struct(
    ("id", S),
    ("title", S),
    ("body", _struct(("storage", _struct(("value", S))))),
    ("version", _struct(("number", L), ("when", S))),
    ("space_key", S),
)

# Flat page: the unit every page operator consumes.
PAGE = _struct(
    ("id", S), ("title", S), ("content", S), ("url", S), ("version", S), ("last_modified", S),
)

# Raw children as landed: one row per page with the API's `results` array.
RAW_ATTACHMENTS = _struct(
    ("page_id", S),
    ("results", T.ArrayType(_struct(
        ("id", S), ("title", S),
        ("metadata", _struct(("mediaType", S))),
        ("extensions", _struct(("fileSize", L))),
    ))),
)
RAW_COMMENTS = _struct(
    ("page_id", S),
    ("results", T.ArrayType(_struct(
        ("id", S),
        ("author", _struct(("displayName", S))),
        ("created", S),
        ("body", _struct(("storage", _struct(("value", S))))),
    ))),
)

# Normalised child rows (long form); `pos` keeps the API order.
COMMENT_RAW = _struct(
    ("page_id", S), ("pos", I), ("id", S), ("author", S), ("created", S), ("content", S),
)
ATTACHMENT_RAW = _struct(
    ("page_id", S), ("pos", I), ("id", S), ("title", S), ("filename", S), ("mediaType", S),
    ("size", L), ("url", S),
)

TABLE = _struct(
    ("headers", T.ArrayType(S)),
    ("data", T.ArrayType(T.ArrayType(S))),
    ("shape", _struct(("rows", I), ("cols", I))),
)
# A table as parsed: equal neighbours of a spanning cell, and rows that only spans reach, are runs.
TABLE_RUNS = _struct(
    ("headers", T.ArrayType(S)),
    ("rows", T.ArrayType(_struct(("n", I), ("cells", T.ArrayType(_struct(("n", I), ("text", S))))))),
)
CODE_BLOCK = _struct(("language", S), ("content", S))
ATTACHMENT = _struct(("id", S), ("filename", S), ("size", L), ("media_type", S))
COMMENT = _struct(("id", S), ("author", S), ("created", S), ("content", S))
METADATA = _struct(
    ("id", S), ("title", S), ("url", S), ("version", S), ("last_modified", S), ("source", S),
    ("processed_at", S),
)

PROCESSED = _struct(
    ("content", S),
    ("metadata", METADATA),
    ("tables", T.ArrayType(TABLE)),
    ("code_blocks", T.ArrayType(CODE_BLOCK)),
    ("attachments", T.ArrayType(ATTACHMENT)),
    ("comments", T.ArrayType(COMMENT)),
    ("errors", T.MapType(S, S)),
)

TABLE_CELL = _struct(
    ("page_id", S), ("table_idx", I), ("row_idx", I), ("col_idx", I), ("header", S), ("value", S),
)

# Tracker issue (the tracker half of the source tool ships no schema; ours).
ISSUE = _struct(
    ("key", S), ("title", S), ("description", S), ("type", S), ("status", S), ("priority", S),
    ("assignee", S), ("project", S), ("sprint", S),
    ("created", T.TimestampType()), ("updated", T.TimestampType()),
)
SPRINT = _struct(("id", L), ("name", S), ("project", S), ("start", T.TimestampType()),
                 ("end", T.TimestampType()))

FILE_ENTRY = _struct(("path", S), ("name", S), ("length", L))
BATCH_RESULT = _struct(("id", S), ("kind", S), ("status", S), ("error", S))
